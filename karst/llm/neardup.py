"""Problem 2: near-duplicate texts, by improved consistent weighted sampling.

1.  Exact copies share a class, the hash of their text; from here on classes stand for rows.
2.  Document frequencies of all word shingles give TF-IDF weights. A shingle counts once
    in a text, and the weight is the inverse document frequency held between `floor` and
    `ceiling`. Shingles under the ceiling are in more than a fixed share of all texts, so
    there are at most (mean shingles a text) / share of them, whatever the corpus: only
    those travel to the workers.
3.  Each class gets consistent weighted samples: a sample of two texts is equal with the
    probability of their weighted Jaccard similarity. Samples are banded; a band's row
    carries a sketch, two bits each of 64 plain min-wise samples, and two classes of a bucket
    become a candidate only if at least `agree` of these agree. Bands are chosen for the least
    weighted similarity that a true pair can have, the sketch for `threshold` (`Params.chance`).
4.  Candidates are verified on the whole texts, by weighted Jaccard similarity first and
    then by the exact similarity on distinct shingles.

A hot group of copies collapses to one row before sampling, other copies where a task reads
them; band rows are joined on the band's key, where adaptive execution splits a hot bucket. Texts that are in no candidate are left out by a filter of fixed size
before any text moves. Nothing is collected but the bounded table of frequent shingles.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.core.session import cut, staged

from .sieve import sieve

SKETCH = 64  # samples of the sketch, two bits each: two 64-bit numbers


@dataclass(frozen=True)
class Params:
    threshold: float = 0.6
    words: int = 3
    min_words: int = 20
    bands: int = 30
    rows: int = 3
    agree: int = 36  # of the 64 samples of the sketch
    floor: float = 2.8
    ceiling: float = 4.0

    @property
    def least_weighted(self) -> float:
        """The weighted similarity that `threshold` implies when all that differs has the
        greatest weight and all that is shared the least."""
        return self.threshold / (self.threshold + (1 - self.threshold) * self.ceiling / self.floor)

    def chance(self, weighted: float, similarity: float | None = None) -> float:
        """That a pair of this weighted similarity (and of `threshold` without weights) becomes a
        candidate, samples taken as independent."""
        plain = self.threshold if similarity is None else similarity
        q = plain + (1 - plain) / 4  # two bits of a sample agree by chance as well
        passes = sum(math.comb(SKETCH, k) * q**k * (1 - q) ** (SKETCH - k) for k in range(self.agree, SKETCH + 1))
        return passes * (1 - (1 - weighted**self.rows) ** self.bands)


_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


_BLOCK = 1 << 20  # code points looked at together


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each letter and digit (0 for others), powers of an odd base and of its inverse."""
    code = np.arange(0x110000, dtype=np.uint64)
    letter = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    base = 0x9E3779B97F4A7C15
    powers, inverse = (np.full(2 * _BLOCK, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
    powers[0] = inverse[0] = 1
    return np.where(letter, _mix((code + np.uint64(1)) * _M2) | np.uint64(1), np.uint64(0)), np.cumprod(powers), np.cumprod(inverse)


def _words_of(low: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the number of words of each text.

    A word's hash is a polynomial over its letters, modulo 2^64.
    """
    letters, powers, inverse = _tables()
    text = " ".join(low)
    values = letters[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    inside = values != 0
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    if len(values) > len(powers):  # one text longer than a block
        powers = np.cumprod(np.r_[np.uint64(1), np.full(len(values) - 1, powers[1])])
        inverse = np.cumprod(np.r_[np.uint64(1), np.full(len(values) - 1, inverse[1])])
    ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1)
    n = np.diff(np.r_[0, np.searchsorted(starts, ends)])
    if not len(starts):
        return np.empty(0, np.uint64), n
    return np.add.reduceat(values * powers[: len(values)], starts) * inverse[starts], n


def shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, the text each belongs to, and the words of each text.

    Words are the lower-cased longest runs of letters and digits.
    """
    low = [t.lower() for t in texts]
    parts, at = [], 0
    while at < len(low):
        end, size = at, 0
        while end < len(low) and (end == at or size + len(low[end]) < _BLOCK):
            size += len(low[end]) + 1
            end += 1
        parts.append(_words_of(low[at:end]))
        at = end
    h = np.concatenate([x for x, _ in parts]) if parts else np.empty(0, np.uint64)
    n = np.concatenate([x for _, x in parts]) if parts else np.empty(0, np.int64)
    total = len(h)
    doc = np.repeat(np.arange(len(texts)), n)
    if total < words:
        return np.empty(0, np.uint64), np.empty(0, np.int64), n
    size = total - words + 1
    out = np.zeros(size, np.uint64)
    for i in range(words):
        out = (out ^ h[i : i + size]) * _M1
        out ^= out >> np.uint64(29)
    inside = doc[:size] == doc[words - 1 :]
    return _mix(out[inside]), doc[:size][inside], n


def _distinct(s: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ordered by shingle, then text; `doc` must not decrease."""
    order = np.argsort(s, kind="stable")
    s, doc = s[order], doc[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[keep], doc[keep]


def document_frequencies(texts: DataFrame, p: Params) -> DataFrame:
    """shingle, df over all rows of `texts` (column text), summed per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, doc, n = shingles(batch.column(0).to_pylist(), p.words)
            s, doc = _distinct(s, doc)
            s = s[n[doc] >= p.min_words]
            starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
            s, c = s[starts], np.diff(np.r_[starts, len(s)])
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(c)], ["shingle", "c"])

    return texts.mapInArrow(run, "shingle bigint, c bigint").groupBy("shingle").agg(F.sum("c").alias("df"))


def frequent(texts: DataFrame, p: Params) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes and log weights of the shingles whose weight is under the ceiling, and the rows."""
    rows = texts.count()
    least = rows / math.expm1(p.ceiling)  # idf = ln(1 + rows / df)
    # bounded: the df of all shingles sum to the shingles of all texts
    found = document_frequencies(texts, p).where(F.col("df") > least).toPandas()
    s = found["shingle"].to_numpy(np.int64).view(np.uint64)
    w = np.log(np.clip(np.log1p(rows / found["df"].to_numpy(float)), p.floor, p.ceiling))
    order = np.argsort(s)
    return s[order], w[order].astype(np.float32), rows


class Sampler:
    """Improved consistent weighted sampling over shingle hashes.

    Per shingle and sample: r and c from Gamma(2, 1), beta uniform, drawn by the hash of
    both. t = floor(ln w / r + beta); the sample is the (shingle, t) with the least
    ln a = ln c - r (t - beta) - r. Quantiles of the gamma distribution are tabled.
    """

    def __init__(self, p: Params, table: np.ndarray, logs: np.ndarray):
        self.p, self.table, self.logs = p, table, logs
        grid = (np.arange(65536) + 0.5) / 65536
        x = np.full(65536, 1.0)
        low, high = np.zeros(65536), np.full(65536, 40.0)
        for _ in range(60):  # the quantile q solves 1 - (1 + x) exp(-x) = q
            x = (low + high) / 2
            below = 1 - (1 + x) * np.exp(-x) < grid
            low, high = np.where(below, x, low), np.where(below, high, x)
        self.r, self.inverse_r, self.log_c = (v.astype(np.float32) for v in (x, 1 / x, np.log(x)))
        rng = np.random.default_rng(20240229)
        self.odd = rng.integers(0, 2**63, p.bands * p.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plain = rng.integers(0, 2**31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def log_weights(self, s: np.ndarray) -> np.ndarray:
        out = np.full(len(s), np.log(self.p.ceiling), np.float32)
        if len(self.table):
            at = np.minimum(np.searchsorted(self.table, s), len(self.table) - 1)
            hit = self.table[at] == s
            out[hit] = self.logs[at[hit]]
        return out

    def samples(self, s: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """32-bit samples, one row for each sample number; texts are the runs of `s` that begin at `starts`."""
        return self.weighted(*np.unique(s, return_inverse=True), starts)

    def weighted(self, unique: np.ndarray, inverse: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """As `samples`, of the shingles `unique[inverse]`."""
        w = self.log_weights(unique)
        out = np.empty((len(self.odd), len(starts)), np.uint32)
        low = np.uint64(0xFFFF)
        for k, odd in enumerate(self.odd):
            x = _mix(unique * odd + np.uint64(k))
            a = (x & low).astype(np.uint16)
            r = self.r[a]
            beta = ((x >> np.uint64(16)) & low).astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(w * self.inverse_r[a] + beta)
            log_a = self.log_c[(x >> np.uint64(32)).astype(np.uint16)] - r * (t - beta) - r
            mark = ((x >> np.uint64(24)) + t.astype(np.int64).view(np.uint64) * _M2) & np.uint64(0xFFFFFFFF)
            rank = ((np.clip(log_a, -90, 30) + np.float32(96)) * np.float32(2**24)).astype(np.uint64)
            out[k] = np.minimum.reduceat(((rank << np.uint64(32)) | mark)[inverse], starts).astype(np.uint32)
        return out

    def keys(self, samples: np.ndarray) -> np.ndarray:
        """A row for each band: its key, of hash (58 bits) and band (6 bits)."""
        p = self.p
        keys = np.empty((p.bands, samples.shape[1]), np.uint64)
        for band in range(p.bands):
            h = np.zeros(samples.shape[1], np.uint64)
            for k in range(band * p.rows, (band + 1) * p.rows):
                h = _mix((h ^ samples[k]) * _M3)
            keys[band] = h << np.uint64(6) | np.uint64(band)
        return keys

    def sketches(self, unique: np.ndarray, inverse: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Two 64-bit numbers a text: two bits of each of 64 min-wise samples without weights."""
        base = (unique >> np.uint64(32)).astype(np.uint32) ^ (unique.astype(np.uint32) * np.uint32(0x9E3779B1))
        out = np.zeros((2, len(starts)), np.uint64)
        for k, odd in enumerate(self.plain):
            x = base * odd
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(13)
            least = np.minimum.reduceat(x[inverse], starts).astype(np.uint64)
            half = out[k // 32]
            half <<= np.uint64(2)
            half |= least & np.uint64(3)
        return out


def band_rows(classes: DataFrame, p: Params, table: np.ndarray, logs: np.ndarray) -> DataFrame:
    """band (its key), id, s1, s2 (its sketch): a row for each band of each class.

    Copies within a partition are sampled once; those of other partitions fall together later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(p, table, logs)
        seen: set[int] = set()
        ids: list[int] = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i not in seen:
                    seen.add(i)
                    ids.append(i)
                    texts.append(t)
                    size += len(t)
                    if size > 12_000_000:  # many texts at once share the work on their common shingles
                        yield from sampled(sampler, ids, texts)
                        ids, texts, size = [], [], 0
        if ids:
            yield from sampled(sampler, ids, texts)

    def sampled(sampler: Sampler, ids: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
        s, doc, n = shingles(texts, p.words)
        enough = n[doc] >= p.min_words
        s, doc = s[enough], doc[enough]
        if len(s):
            starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            unique, inverse = np.unique(s, return_inverse=True)
            flat = sampler.keys(sampler.weighted(unique, inverse, starts)).T.ravel().view(np.int64)
            own = np.repeat(np.array(ids, np.int64)[doc[starts]], p.bands)
            s1, s2 = (np.repeat(x.view(np.int64), p.bands) for x in sampler.sketches(unique, inverse, starts))
            for at in range(0, len(flat), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (flat, own, s1, s2)], ["band", "id", "s1", "s2"])

    return classes.mapInArrow(run, "band bigint, id bigint, s1 bigint, s2 bigint")


def candidates(bands: DataFrame, p: Params) -> DataFrame:
    """Distinct pairs a < b of classes that share a band and agree in their sketches.

    Both sides read one exchange; adaptive execution splits a hot bucket.
    """
    unlike = lambda c: F.bit_count(F.expr(f"((x.{c} ^ y.{c}) | shiftrightunsigned(x.{c} ^ y.{c}, 1)) & 6148914691236517205L"))  # noqa: E731  0101...
    alike = (F.col("x.id") < F.col("y.id")) & (unlike("s1") + unlike("s2") <= SKETCH - p.agree)
    pairs = bands.alias("x").join(bands.alias("y"), (F.col("x.band") == F.col("y.band")) & alike)
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def verify(pairs: DataFrame, classes: DataFrame, p: Params, table: np.ndarray, logs: np.ndarray) -> DataFrame:
    """a, b, similarity of the pairs that reach the threshold on their whole texts."""
    classes = sieve(classes, "class", pairs.select(F.explode(F.array("a", "b")).alias("class")))
    # partial aggregation leaves one row of a class in each map task, so a hot class doesn't pile up
    texts = classes.groupBy("class").agg(F.any_value("text").alias("text"))
    left = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(p, table, logs)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                yield kept(sampler, batch.slice(at, 1000))

    def kept(sampler: Sampler, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.num_rows
        texts = [t for pair in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()) for t in pair]
        s, doc, n = shingles(texts, p.words)
        s, doc = _distinct(s, doc)
        w = np.exp(sampler.log_weights(s).astype(float))
        order = np.argsort(doc // 2, kind="stable")  # by pair, then shingle: a shared one stands twice
        s, pair, w = s[order], doc[order] // 2, w[order]
        twice = np.flatnonzero((s[1:] == s[:-1]) & (pair[1:] == pair[:-1]))
        size, weight = np.bincount(pair, minlength=rows), np.bincount(pair, w, minlength=rows)
        shared, shared_weight = np.bincount(pair[twice], minlength=rows), np.bincount(pair[twice], w[twice], minlength=rows)
        with np.errstate(invalid="ignore", divide="ignore"):
            similarity = shared / (size - shared)
            weighted = shared_weight / (weight - shared_weight)
        good = (n.reshape(rows, 2).min(1) >= p.min_words) & (weighted >= p.least_weighted - 1e-6) & (similarity >= p.threshold)
        mask = pa.array(good)
        return pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), pa.array(similarity[good])], ["a", "b", "similarity"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, similarity double")


def near_duplicates(rows: DataFrame, key: str = "id", text: str = "text", p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(links, members). links: a, b, similarity between classes, a < b, and a = b for a
    class of at least `min_words` words with several keys. members: `key`, class.

    Null texts belong to no class; texts under `min_words` words have no link. Repeated
    rows of a key count once. Extra columns are not read. An empty table gives empty frames.
    """
    own = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    own = own.withColumn("class", F.xxhash64("text"))
    members = staged(own.select("key", "class").distinct())
    texts = own.select("class", "text")
    copies = staged(members.groupBy("class").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).where("lo <> hi"))
    table, logs, total = frequent(texts.select("text"), p)
    # one row stands for a hot text; there are at most a million texts of a millionth of the rows each
    hot = copies.where(F.col("n") >= max(1000, total / 1_000_000)).select("class", "lo")
    once = own.join(F.broadcast(hot), "class", "left").where("lo is null or lo = key").select("class", "text")
    pairs = candidates(band_rows(once, p, table, logs), p)
    pairs = cut(pairs.unionByName(copies.select(F.col("class").alias("a"), F.col("class").alias("b"))))
    return verify(pairs, texts, p, table, logs), members.select(F.col("key").alias(key), "class")


def expand(links: DataFrame, members: DataFrame, key: str = "id", a: str = "id_a", b: str = "id_b") -> DataFrame:
    """All pairs of different keys that `links` implies, the smaller key first."""
    x = members.select(F.col("class").alias("a"), F.col(key).alias("x"))
    y = members.select(F.col("class").alias("b"), F.col(key).alias("y"))
    pairs = links.join(x, "a").join(y, "b").where("(a <> b and x <> y) or (a = b and x < y)")
    return pairs.select(F.least("x", "y").alias(a), F.greatest("x", "y").alias(b))
