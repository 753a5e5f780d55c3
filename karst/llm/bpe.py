"""Byte-pair encoding by prefix dynamic programming.

For every byte prefix of a pre-token the encoder keeps one number, the last token of
that prefix's encoding. That token is unique: among the vocabulary entries that end at
the position, exactly one can follow the encoding of the remaining prefix without BPE
merging across the seam. Following the last tokens backwards gives the ids. Appending
bytes extends the table and never changes earlier entries; an edit drops the entries
behind its first byte and re-encodes from there.

Cost is linear in the bytes, also for a pre-token of a megabyte, where merging by rank
is quadratic or needs a heap.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable
from itertools import chain

import regex

#: Fixed values of the public byte-level vocabulary: white space of Unicode (not the
#: C0 separators that Python's `\\s` also takes) and the pre-token pattern.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PRETOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)

DEFAULT_DIR = "/opt/tokenizers"


class Vocabulary:
    """Ranks of a byte-level BPE, with what the dynamic program asks of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.longest = max(map(len, ranks))
        # lengths that occur, by last byte: few of them need a lookup at each position
        lengths: dict[int, set[int]] = {}
        for token in ranks:
            lengths.setdefault(token[-1], set()).add(len(token))
        self.lengths = {b: sorted(x, reverse=True) for b, x in lengths.items()}
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._joint: dict[tuple[int, int], bool] = {}

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made `token`; None for a single byte.

        The last merge of a token's own encoding joins the halves that merging with
        ranks below its own leaves behind.
        """
        if token not in self._parts:
            word = self.bytes_of[token]
            pieces = [word[i : i + 1] for i in range(len(word))]
            while len(pieces) > 2:
                pairs = [self.ranks.get(pieces[i] + pieces[i + 1], self.size) for i in range(len(pieces) - 1)]
                best = min(pairs)
                if best >= token:
                    break
                i = pairs.index(best)
                pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
            self._parts[token] = (self.ranks[pieces[0]], self.ranks[pieces[1]]) if len(pieces) == 2 else None
        return self._parts[token]

    def joint(self, left: int, right: int) -> bool:
        """Whether BPE keeps the seam between two adjacent tokens.

        Both are taken apart from the outside in, the later merge first. Should any
        pair across the seam have merged before the tokens beside it were complete,
        the seam is lost.
        """
        key = (left, right)
        if (known := self._joint.get(key)) is not None:
            return known
        limit, ok = self.size, True
        while True:
            merged = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], self.size)
            if merged < limit:
                ok = False
                break
            if left > right:
                limit = left
                split = self.parts(left)
                if split is None:
                    limit = right + 1
                    split = self.parts(right)
                    if split is None:
                        break
                    right = split[0]
                else:
                    left = split[1]
            else:
                limit = right + 1
                split = self.parts(right)
                if split is None:
                    limit = left
                    split = self.parts(left)
                    if split is None:
                        break
                    left = split[1]
                else:
                    right = split[0]
        if len(self._joint) > 2_000_000:  # a cache: emptied, it changes no result
            self._joint.clear()
        self._joint[key] = ok
        return ok


class PrefixTable:
    """The last token of each byte prefix; grows by `append`, changes by `edit`."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v = vocabulary
        self.data = bytearray()
        self.last: list[int] = []
        self.append(data)

    def append(self, data: bytes) -> PrefixTable:
        v, last = self.v, self.last
        ranks, lengths, of, joint = v.ranks, v.lengths, v.bytes_of, v.joint
        self.data += data
        base = max(0, len(last) - v.longest)  # no token reaches further back
        text = bytes(self.data[base:])
        for end in range(len(last) + 1, len(self.data) + 1):
            for n in lengths[text[end - 1 - base]]:
                start = end - n
                if start < 0:
                    continue
                token = ranks.get(text[start - base : end - base])
                if token is None or (v.parts(token) is None and n > 1):
                    continue
                if start == 0 or joint(last[start - 1], token):
                    last.append(token)
                    break
            else:
                raise ValueError(f"byte {of and text[end - 1 - base]} is not in the vocabulary")
        return self

    def edit(self, start: int, end: int, new: bytes) -> PrefixTable:
        """Replace bytes [start, end) and encode again from `start` on.

        Behind the replaced bytes the old table is taken over as soon as a whole
        longest-token window agrees with it; `joint` looks no further back.
        """
        old, shift = self.last, len(new) - (end - start)
        tail = bytes(self.data[end:])
        self.data, self.last = self.data[:start], old[:start]
        self.append(new)
        same = 0
        for i in range(len(tail)):
            self.append(tail[i : i + 1])
            same = same + 1 if self.last[-1] == old[len(self.last) - 1 - shift] else 0
            if same >= self.v.longest:
                self.data += tail[i + 1 :]
                self.last += old[len(self.last) - shift :]
                break
        return self

    def ids(self) -> list[int]:
        out, end = [], len(self.last)
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.v.bytes_of[token])
        return out[::-1]


class _Memo(dict):
    """Ids by string. Emptied when full: a cache, it never changes a result."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Encoder:
    """Text to ids, without special tokens: their strings are ordinary text.

    A text is cut before each white-space run; such a unit tokenizes alike in any
    text, so units and pre-tokens are looked up before they are encoded.
    """

    #: A blank beside other white space or at an end: there `str.split` would cut inside a run.
    edge = re.compile(r" \s|\s |\A\s|\s\Z").search

    def __init__(self, vocabulary: Vocabulary, limit: int = 200_000, long: int = 64):
        self.v = vocabulary
        self.units = regex.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self.pretokens = regex.compile(PRETOKEN).findall
        self.long = long
        self.unit_memo = _Memo(self._unit, limit)
        self.word_memo = _Memo(lambda word: self._unit(" " + word), limit)
        self.piece_memo = _Memo(self._piece, limit)

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "replace")
        token = self.v.ranks.get(data)
        if token is not None and (len(data) == 1 or self.v.parts(token)):
            return (token,)
        return tuple(PrefixTable(self.v, data).ids())

    def _unit(self, unit: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.pretokens(unit):
            out += self.piece_memo[piece] if len(piece) <= self.long else self._piece(piece)
        return tuple(out)

    def runs(self, text: str):
        """The ids of `text`, as an iterator of tuples."""
        words = text.split(" ")
        if len(text) > 4 * self.long * len(words) or self.edge(text):
            # huge units are not worth an entry of the cache
            return (self.unit_memo[u] if len(u) <= 4 * self.long else self._unit(u) for u in self.units(text))
        return chain((self.unit_memo[words[0]],), map(self.word_memo.__getitem__, words[1:]))

    def encode(self, text: str | None) -> list[int]:
        """Null and empty texts give an empty list."""
        return list(chain.from_iterable(self.runs(text))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, self.runs(text))) if text else 0

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.v.bytes_of[i] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary.from_file(path))
    return _ENCODERS[path]


def vocabulary_path(directory: str | None = None, name: str = "byte_bpe_50k.tiktoken") -> str:
    return os.path.join(directory or os.environ.get("KARST_TOKENIZERS", DEFAULT_DIR), name)
