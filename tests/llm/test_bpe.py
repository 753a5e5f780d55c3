import random

import pytest

from karst.llm import bpe, tokenize

PATH = bpe.vocabulary_path()


@pytest.fixture(scope="module")
def encoder():
    try:
        return bpe.encoder(PATH)
    except FileNotFoundError:
        pytest.skip("the vocabulary files are not here")


@pytest.fixture(scope="module")
def reference():
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_equal_to_the_merge_rule(encoder, reference):
    rng = random.Random(5)
    letters = "abcdeilnorstu éèß中🙂12 \t\n\r\x1c  '-.,ABC<|>"
    for n in (1, 3, 20, 300):
        for _ in range(150):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert encoder.encode(text) == reference.encode_ordinary(text), repr(text)
    for text in ("<|endoftext|> a", "a  b   c ", " \n\n x\r\n\r\n", "it's we'll", "a" * 9000, "x\x1cy", "é", "‍"):
        assert encoder.encode(text) == reference.encode_ordinary(text), repr(text)
        assert encoder.count(text) == len(encoder.encode(text)) and encoder.decode(encoder.encode(text)) == text


def test_prefix_table_appends_and_edits(encoder):
    v = encoder.v
    data = ("the quick brown fox, l'università di Padova " * 6).encode()
    whole = bpe.PrefixTable(v, data)
    grown = bpe.PrefixTable(v)
    for i in range(0, len(data), 7):
        grown.append(data[i : i + 7])
    assert grown.last == whole.last and grown.ids() == whole.ids()
    rng = random.Random(2)
    for _ in range(40):
        a = rng.randrange(len(data))
        b = min(len(data), a + rng.randrange(9))
        new = bytes(rng.choice(b"abc xyz") for _ in range(rng.randrange(6)))
        edited = bpe.PrefixTable(v, data).edit(a, b, new)
        fresh = bpe.PrefixTable(v, data[:a] + new + data[b:])
        assert edited.ids() == fresh.ids() and bytes(edited.data) == bytes(fresh.data)


def test_caches_never_change_ids(encoder):
    small = bpe.Encoder(encoder.v, limit=3, long=4)
    text = "uno due tre quattro cinque uno  due\n" * 5 + "x" * 500
    assert small.encode(text) == encoder.encode(text)


def test_corpus(spark, encoder):
    rows = [(1, None, "e"), (2, "", "e"), (3, "ciao mondo", None), (3, "ciao mondo", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")  # a clashing column
    got = sorted((r.doc_id, list(r.ids)) for r in tokenize.encode_corpus(df).collect())
    assert got == [(1, []), (2, []), (3, encoder.encode("ciao mondo")), (3, encoder.encode("ciao mondo"))]
    assert tokenize.encode_corpus(df.limit(0)).count() == 0
    assert sorted(r.tokens for r in tokenize.token_counts(df).collect())[:2] == [0, 0]
