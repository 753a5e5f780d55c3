"""Problem 8: reading level by a familiar-word formula.

A document's difficulty follows from the share of its words outside lists of familiar words
and from the mean length of its sentences. The lists come from document frequencies over the
whole corpus and nothing else: list c of a language holds the words that a share c or more of
the language's documents use, for shares from the commonest to rare words. Levels and labels
play no part in them; only the weights of the formula, which turn shares and sentence length
into a level, are fitted on the labels.

A document's language is the tag whose frequent words it uses most; tags are read by their
first two letters, so a wrong or missing tag of a document does no harm.

The labelled sample is bounded (`max_labelled` documents, the first by hash of the key);
all frequencies behind the lists are counted over all documents. The lists are bounded: a word
of a list is in at least `least` of the documents of a language, so there are at most
(mean distinct words a document) / least of them for each of at most 1 / `tag_share` languages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.core.session import cut

LEVELS = 4
_WORDS = re.compile(r"[^\W\d_]+").findall
_LETTER = re.compile(r"[^\W\d_]").search
_SENTENCES = re.compile(r"[.!?…;]+(?=\s|$)|\n+").split


@dataclass(frozen=True)
class Params:
    min_words: int = 30
    max_labelled: int = 20_000
    shares: tuple[float, ...] = (0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.16, 0.13, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01, 0.005)  # of documents, for the lists
    tag_share: float = 0.02  # of all documents, for a language
    own: float = 0.2  # a word's share in a language counts from this part of its greatest share on
    rounds: int = 2000
    penalty: float = 1e-3

    @property
    def least(self) -> float:
        return self.shares[-1]


def words(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return _WORDS(text.lower())


class Lists:
    """The lists that a word is in, for each language: list numbers count from the commonest words on."""

    def __init__(self, counts: dict[str, np.ndarray], docs: np.ndarray, p: Params):
        self.p, self.languages = p, len(docs)
        share = np.array(list(counts.values())).reshape(-1, len(docs)) / np.maximum(docs, 1)
        share[share < p.own * share.max(1, keepdims=True)] = 0  # words of other languages in documents with a wrong tag
        self.row = {w: i for i, w in enumerate(counts, 1)}
        self.share = np.r_[np.zeros((1, len(docs))), share]  # row 0: words of no list
        # the first list that holds the word; as many as there are lists if none does
        self.first = (self.share[:, :, None] < np.array(p.shares)).sum(2).astype(np.uint8)

    def features(self, text: str, own: list[str]) -> np.ndarray:
        """For the document's language, shares of words outside each list and log mean sentence length; 0 for other languages."""
        n = len(self.p.shares)
        rows = np.fromiter((self.row.get(w, 0) for w in own), np.int64, len(own))
        language = int(np.argmax(self.share[rows].sum(0)))
        inside = np.cumsum(np.bincount(self.first[rows, language], minlength=n + 1)[:n]) / len(own)
        sentences = sum(1 for s in _SENTENCES(text) if _LETTER(s))
        out = np.zeros((self.languages, n + 2))
        out[language] = [*(1 - inside), np.log(len(own) / max(1, sentences)), 1]
        return out.ravel()


class Formula:
    """Levels from features by weights fitted on labels (softmax regression on standardised features)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, p: Params):
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-6
        z = np.c_[(x - self.mean) / self.sd, np.ones(len(x))]
        target = np.eye(LEVELS)[y - 1]
        self.w = np.zeros((z.shape[1], LEVELS))
        velocity = np.zeros_like(self.w)
        for _ in range(p.rounds):
            q = self._soft(z @ self.w)
            velocity = 0.9 * velocity - 0.5 * (z.T @ (q - target) / len(z) + p.penalty * self.w)
            self.w += velocity
        self.seen = np.unique(y)

    @staticmethod
    def _soft(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def levels(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[(x - self.mean) / self.sd, np.ones(len(x))]
        return self.seen[np.argmax((z @ self.w)[:, self.seen - 1], 1)]


def labelled(docs: DataFrame, labels: DataFrame, p: Params) -> DataFrame:
    """doc_id, text, level: one row for a document with a label, the mean of its grades rounded.

    Grades outside 1 to 4 and nulls are no labels. At most `max_labelled` documents.
    """
    grades = labels.where(F.col("reading_level").between(1, LEVELS)).select("doc_id", "grader", "reading_level").distinct()
    mean = grades.groupBy("doc_id").agg(F.round(F.avg("reading_level")).cast("int").alias("level"))
    sample = mean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_labelled)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most max_labelled rows


def document_frequencies(docs: DataFrame, p: Params) -> DataFrame:
    """word, tag, n: documents of the tag that contain the word; the word "" counts the documents.

    Documents without tag count under "". Summed in each batch before the shuffle.
    """
    least = p.min_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for text, tag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = words(text)
                if len(own) >= least:
                    c = counts.setdefault(tag, Counter())
                    c.update(set(own))
                    c[""] += 1
            for tag, c in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array([tag] * len(c), pa.string()), pa.array(c.values(), pa.int64())], ["word", "tag", "n"])

    tag = F.coalesce(F.lower(F.substring(F.trim("lang"), 1, 2)), F.lit(""))
    return docs.select("text", tag.alias("tag")).mapInArrow(run, "word string, tag string, n bigint").groupBy("word", "tag").agg(F.sum("n").alias("n"))


def familiar(docs: DataFrame, p: Params) -> Lists | None:
    """The lists of all languages; None for a corpus without running text."""
    counted = cut(document_frequencies(docs, p))
    per_tag = counted.where("word = ''").groupBy("tag").agg(F.sum("n").alias("docs"))
    total = per_tag.agg(F.sum("docs")).first()[0]
    if not total:
        return None
    # at most 1 / tag_share tags; a corpus in which no tag is common is one language
    languages = sorted((r.tag, r.docs) for r in per_tag.where((F.col("tag") != "") & (F.col("docs") >= p.tag_share * total)).collect())
    if not languages:
        counted = counted.groupBy("word").agg(F.sum("n").alias("n")).withColumn("tag", F.lit("*"))
        languages = [("*", total)]
    least = F.element_at(F.create_map(*(F.lit(x) for tag, n in languages for x in (tag, max(1.0, p.least * n)))), F.col("tag"))
    found = counted.where(F.col("tag").isin([t for t, _ in languages]) & (F.col("word") != "")).where(F.col("n") >= least).toPandas()
    column = {t: i for i, (t, _) in enumerate(languages)}
    counts: dict[str, np.ndarray] = {}
    for word, tag, n in found[["word", "tag", "n"]].itertuples(index=False):
        counts.setdefault(word, np.zeros(len(languages)))[column[tag]] = n
    return Lists(counts, np.array([n for _, n in languages], float), p)


def reading_levels(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, reading_level of each document with at least `min_words` words.

    Shorter, empty and null texts give no row; repeated rows give one. Without any usable
    label all levels are 2, the middle of the everyday. Extra columns are not read; a table
    without the column lang is one language.
    """
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    docs = docs.select("doc_id", "text", lang.alias("lang")).where(F.col("text").isNotNull())
    least = p.min_words
    lists = familiar(docs, p)
    if lists is None:
        return docs.select("doc_id", F.lit(2).alias("reading_level")).limit(0)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [], []
            for text, level in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = words(text)
                if len(own) >= least:
                    xs.append(lists.features(text, own))
                    ys.append(level)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.int32())], ["x", "level"])

    known = labelled(docs, labels, p)
    sample = known.select("text", "level").mapInArrow(measured, "x array<double>, level int").toPandas()  # at most max_labelled rows
    formula = Formula(np.array(sample["x"].tolist()), sample["level"].to_numpy(int), p) if len(sample) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, xs = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = words(text)
                if len(own) >= least:
                    ids.append(i)
                    xs.append(lists.features(text, own))
            levels = formula.levels(np.array(xs)) if formula and xs else np.full(len(ids), 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(levels.astype(np.int32))], ["doc_id", "reading_level"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, reading_level int").dropDuplicates(["doc_id"])
