import itertools
import random
import re

from karst.llm import neardup as N


def similarity(a, b):
    s = [set(zip(w, w[1:], w[2:])) for w in (re.findall(r"[^\W_]+", t.lower()) for t in (a, b))]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def corpus(seed, families=25, words=3000):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    texts = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 90))]
        texts.append(" ".join(base))
        for _ in range(3):
            t = list(base)
            for _ in range(rng.randrange(1, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                t.insert(rng.randrange(len(t)), "INSERTED")
            texts.append(" ".join(t))
    return texts


def test_recall_and_exactness(spark):
    texts = corpus(1)
    rows = [(f"k{i:04}", t) for i, t in enumerate(texts)]
    rows += [("copy1", texts[0]), ("copy2", texts[0]), ("copy2", texts[0]), ("null", None), ("empty", ""), ("short", "a b c"), ("short2", "a b c"), ("long", "z " * 50_000)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "id string, text string, class string").repartition(3)
    links, members = N.near_duplicates(df)
    got = {(r.id_a, r.id_b) for r in N.expand(links, members).collect()}
    distinct = sorted({(k, t) for k, t in rows if t and len(t.split()) >= 20})
    want = {(a, b) for (a, s), (b, t) in itertools.combinations(distinct, 2) if a != b and similarity(s, t) >= 0.6}
    assert got <= want and len(got) >= 0.97 * len(want)
    assert {("copy1", "copy2"), ("copy1", "k0000")} <= got
    assert not any("short" in a for a, _ in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, text string")
    links, members = N.near_duplicates(df)
    assert links.count() == 0 and members.count() == 0


def test_samples_agree_as_often_as_texts_are_alike():
    import numpy as np

    p = N.Params(bands=60, rows=5)
    base = [f"a{i}" for i in range(120)]
    other = base[:90] + [f"b{i}" for i in range(30)]
    s, doc, _ = N.shingles([" ".join(base), " ".join(other)], 3)
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    x = N.Sampler(p, np.empty(0, np.uint64), np.empty(0, np.float32)).samples(s, starts)
    assert abs((x[:, 0] == x[:, 1]).mean() - similarity(" ".join(base), " ".join(other))) < 0.08


def test_edited_copies_of_a_hot_text_are_found(spark):
    rng = random.Random(7)
    fresh = (f"u{i}" for i in itertools.count())
    texts = []
    for _ in range(2):  # each base is in a quarter of the rows, so what is shared weighs least and edits most
        base = [next(fresh) for _ in range(80)]
        texts += [" ".join(base + [next(fresh) for _ in range(rng.randrange(22, 26))]) for _ in range(20)]
    texts += [" ".join(next(fresh) for _ in range(60)) for _ in range(40)]
    links, members = N.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    got = {(r.id_a, r.id_b) for r in N.expand(links, members).collect()}
    want = {(a, b) for (a, s), (b, t) in itertools.combinations(enumerate(texts), 2) if similarity(s, t) >= 0.6}
    assert len(want) > 300 and got <= want and len(got) >= 0.95 * len(want)


def test_bands_suit_the_least_similarity_of_true_pairs():
    p = N.Params()
    assert p.bands <= 64 and p.chance(p.least_weighted) >= 0.98
