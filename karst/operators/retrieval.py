"""Similarity search, fusion of rankings, reranking and caches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.core.session import staged
from karst.functions import text as T


def knn(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", block: int = 2048, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, `key`, score, rank: the `k` nearest rows of each query, ties by key.

    The query set goes out in blocks of at most `block` vectors (the bound of what is sent
    to the executors at once); each partition keeps its own `k` best of a query, so the
    shuffle holds k rows a query and partition. Null vectors and vectors of another
    length than the query's take no part.
    """
    kind = rows.schema[key].dataType.simpleString()
    q = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("v")).where(F.col("v").isNotNull())
    out = None
    for part in _blocks(q, "query_id", block):
        local = _scores(rows.select(F.col(key), F.col(vector)), part["query_id"].tolist(), part["v"].tolist(), k, metric, key, vector, kind)
        out = local if out is None else out.unionByName(local)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _blocks(rows: DataFrame, key: str, block: int) -> Iterator[pd.DataFrame]:
    """`rows` in blocks of about `block` rows by the hash of `key`, each in the order of keys.

    Several blocks are written once, a directory each, so a block is read without the others.
    """
    n = max(1, -(-rows.count() // block))
    if n == 1:
        yield rows.orderBy(key).toPandas()
        return
    kept = staged(rows.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), "__block")
    for i in range(n):
        yield kept.where(F.col("__block") == i).drop("__block").orderBy(key).toPandas()


def near_pairs(rows: DataFrame, least: float, block: int = 2048, key: str = "vec_id", vector: str = "embedding", queries: DataFrame | None = None) -> DataFrame:
    """a, b, score: all pairs a < b of rows whose cosine is over `least`; with `queries`, those with a in it.

    Every vector meets every other. Blocks of about `block` vectors go out to all rows; only
    pairs over `least` with the smaller key in the block leave a worker, so nothing is ranked and
    no other pair moves. Vectors of different lengths and null vectors make no pair.
    """
    kind = rows.schema[key].dataType.simpleString()
    some = lambda df: df.select(F.col(key).alias("b"), F.col(vector).alias("v")).where(F.col("b").isNotNull() & F.col("v").isNotNull())
    out = None
    for part in _blocks(some(rows if queries is None else queries), "b", block):
        near = _over(some(rows), part["b"].tolist(), part["v"].tolist(), least, kind)
        out = near if out is None else out.unionByName(near)
    return out


def _over(rows: DataFrame, ids: list, vectors: list, least: float, kind: str) -> DataFrame:
    blocks = {}
    for size in {len(v) for v in vectors}:
        own = [i for i, v in enumerate(vectors) if len(v) == size]
        blocks[size] = np.array([ids[i] for i in own]), _unit(np.array([np.asarray(vectors[i], float) for i in own]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf["v"].map(len)
            for size in set(sizes) & set(blocks):
                left, q = blocks[size]
                some = pdf[sizes == size]
                right, s = some["b"].to_numpy(), _unit(np.stack(some["v"].to_numpy()).astype(float)) @ q.T
                i, j = np.nonzero((s > least) & (left[None, :] < right[:, None]))
                yield pd.DataFrame({"a": left[j], "b": right[i], "score": s[i, j]})

    return rows.mapInPandas(run, f"a {kind}, b {kind}, score double")


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _scores(rows: DataFrame, ids: list, vectors: list, k: int, metric: str, key: str, vector: str, kind: str) -> DataFrame:
    q = np.array([np.asarray(v, float) for v in vectors]) if vectors else np.zeros((0, 1))
    name = metric.lower()
    if name not in ("cosine", "dot", "ip", "l2", "euclid"):
        raise ValueError(f"metric {metric!r}")

    names = np.array(ids)

    def best(owns: np.ndarray, js: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per query the k best, ties by key."""
        order = np.lexsort((owns, -scores, js))
        owns, js, scores = owns[order], js[order], scores[order]
        starts = np.flatnonzero(np.r_[True, js[1:] != js[:-1]]) if len(js) else np.empty(0, int)
        place = np.arange(len(js)) - np.repeat(starts, np.diff(np.r_[starts, len(js)]))
        kept = place < k
        return owns[kept], js[kept], scores[kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf[pdf[vector].map(lambda v: v is not None and len(v) == q.shape[1])]
            if not len(pdf) or not len(q):
                continue
            x = np.stack(pdf[vector].to_numpy()).astype(float)
            if name == "cosine":
                norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
                s = np.divide(x @ q.T, norms, out=np.zeros((len(x), len(q))), where=norms > 0)
            elif name in ("dot", "ip"):
                s = x @ q.T
            else:
                s = -np.sqrt(np.maximum((x**2).sum(1)[:, None] + (q**2).sum(1)[None, :] - 2 * x @ q.T, 0))
            s = np.round(s, 9) + 0.0
            least = np.partition(s, len(s) - k, axis=0)[len(s) - k] if len(s) > k else np.full(len(q), -np.inf)
            i, j = np.nonzero(s >= least[None, :])  # the k best of each query in the batch, with ties
            found = best(pdf[key].to_numpy()[i], j, s[i, j])
            held = found if held is None else best(*(np.concatenate(p) for p in zip(held, found)))
        if held is not None:
            yield pd.DataFrame({"query_id": names[held[1]], key: held[0], "score": held[2]})

    return rows.mapInPandas(run, f"query_id {kind}, {key} {kind}, score double")


def ranked(rows: DataFrame, score: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """`rank` from 1 by descending score, ties by key."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*(by or [])).orderBy(F.desc(score), tie)))


def rrf(rankings: list[DataFrame], key: str, weights: list[float] | None = None, k: int = 60, base: int = 1, by: list[str] | None = None) -> DataFrame:
    """Reciprocal rank fusion: `key`, rrf = sum of w / (k + rank), with ranks counted from `base`.

    `by` names columns that keep rankings apart (a query id). Rows without a key take no part.
    """
    weights = weights or [1.0] * len(rankings)
    if len(weights) != len(rankings):
        raise ValueError("a weight for each ranking is needed")
    parts = [r.where(F.col(key).isNotNull()).select(*(by or []), key, (F.lit(float(w)) / (k + F.col("rank") - 1 + base)).alias("__s")) for r, w in zip(rankings, weights)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(*(by or []), key).agg(F.sum("__s").alias("rrf"))


def minmax(rows: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """`normalised` in [0, 1]; 1 where all scores are equal."""
    w = Window.partitionBy(*(by or []))
    low, high = F.min(score).over(w), F.max(score).over(w)
    return rows.withColumn("normalised", F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low)))


def convex(dense: Column, sparse: Column, alpha: float) -> Column:
    """alpha * dense + (1 - alpha) * sparse; a missing side counts 0."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be within 0 and 1")
    return alpha * F.coalesce(dense, F.lit(0.0)) + (1 - alpha) * F.coalesce(sparse, F.lit(0.0))


def sparse_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """`key`, term, weight: sub-linear term frequency over lower-case words of two letters or more."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1)
    return docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg((1 + F.ln(F.count("*"))).alias("weight"))


def sparse_score(docs: DataFrame, key: str, text: str, query: dict[str, float]) -> DataFrame:
    """`key`, sparse: dot product of a text's terms, weighted as in `sparse_terms`, with the query's.

    Words that the query doesn't have are left out before anything is exploded, so only
    (text, query term) pairs are aggregated, never the terms of all texts.
    """
    if not query:
        return docs.select(key, F.lit(0.0).alias("sparse")).limit(0)
    asked = F.array(*(F.lit(t) for t in query))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.array_contains(asked, w) & (F.length(w) > 1))
    n = docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    weight = F.element_at(F.create_map(*(F.lit(x) for t, w in query.items() for x in (t, float(w)))), F.col("term"))
    return n.groupBy(key).agg(F.sum((1 + F.ln("n")) * weight).alias("sparse"))


def max_pool(parts: DataFrame, key: str) -> DataFrame:
    """Greatest weight of each term over the windows of a text: `key`, indices, values, sorted by term."""
    best = parts.groupBy(key, "term").agg(F.max("weight").alias("w"))
    pairs = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("p"))  # the terms of one text
    return pairs.select(key, F.transform("p", lambda x: x.term).alias("indices"), F.transform("p", lambda x: x.w).alias("values"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def word_windows(docs: DataFrame, key: str, text: str, size: int, overlap: int = 0) -> DataFrame:
    """`key`, part, window, words: windows of `size` words, each `overlap` words into the one before.

    A text is split once; its windows are slices of the words. Texts without words have no row.
    """
    split = docs.select(key, words_of(F.col(text)).alias("__words")).where(F.size("__words") > 0)
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.size("__words") - overlap - 1, F.lit(0)), F.lit(step))
    cut_ = split.select(key, "__words", F.posexplode(starts).alias("part", "__at"))
    window = F.slice("__words", F.col("__at") + 1, F.lit(size))
    return cut_.select(key, "part", window.alias("__w")).select(key, "part", F.array_join("__w", " ").alias("window"), F.size("__w").alias("words"))


def maxp_windows(docs: DataFrame, key: str, text: str, limit: int = 200, overlap_tokens: int = 40) -> DataFrame:
    """`key`, part, window: a text over `limit` estimated tokens in overlapping word windows, others whole."""
    size, overlap = int(limit / 1.8), int(overlap_tokens / 1.8)
    long = T.token_estimate(F.col(text)) > limit
    whole = docs.where(~long).select(key, F.lit(0).alias("part"), F.col(text).alias("window"))
    return word_windows(docs.where(long), key, text, size, overlap).select(key, "part", "window").unionByName(whole)


def rerank(rows: DataFrame, score: Column, k: int, key: str, by: list[str] | None = None) -> DataFrame:
    """The `k` best by `score`; a group of at most `k` rows stays as it is, in its rank order.

    Needs `rank`. Adds `final_rank`.
    """
    by = by or []
    n = F.count("*").over(Window.partitionBy(*by))
    s = rows.withColumns({"__s": score, "__n": n})
    order = [F.when(F.col("__n") > k, -F.col("__s")), F.when(F.col("__n") <= k, F.col("rank")), F.col(key)]
    return s.withColumn("final_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("final_rank") <= k).drop("__s", "__n")


def rank_score(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(n - rank + 1) / n of each row."""
    n = F.count("*").over(Window.partitionBy(*(by or [])))
    return rows.withColumn("rank_score", (n - F.col("rank") + 1) / n)


def first_of(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key; rows without a key go."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def batches_by_budget(lengths: DataFrame, key: str, length: str, budget: int, cap: int, bucket: Column | None = None) -> DataFrame:
    """`key`, batch: items by length in batches with (n + 1) * longest <= budget and n < cap; an oversize item alone.

    `bucket` splits the items first (a worker, a request); each bucket is packed in one
    task and must be of bounded size.
    """
    kind = lengths.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([length, key])
        out, n, batch = [], 0, -1
        for x in pdf[length]:
            if n == 0 or n >= cap or (n + 1) * x > budget:
                batch, n = batch + 1, 0
            out.append(batch)
            n += 1
        return pd.DataFrame({"bucket": pdf["bucket"], key: pdf[key], "batch": out})

    rows = lengths.select((bucket if bucket is not None else F.lit(0)).cast("long").alias("bucket"), key, length)
    return rows.groupBy("bucket").applyInPandas(run, f"bucket long, {key} {kind}, batch int")


def diverse(candidates: DataFrame, k: int, weight: float, by: str, key: str, relevance: str, vector: str) -> DataFrame:
    """Maximal marginal relevance: `k` of each group's candidates (a bounded top list), greedily. `by`, `key`, pick."""
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([relevance, key], ascending=[False, True]).reset_index(drop=True)
        x = np.stack(pdf[vector].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        rel, near, picked = pdf[relevance].to_numpy(float), np.zeros(len(pdf)), []
        while len(picked) < min(k, len(pdf)):
            gain = weight * rel - (1 - weight) * near
            gain[picked] = -np.inf
            i = int(np.argmax(np.round(gain, 9)))
            picked.append(i)
            sims = x @ x[i]
            near = sims if len(picked) == 1 else np.maximum(near, sims)
        return pd.DataFrame({by: pdf[by].iloc[picked], key: pdf[key].iloc[picked], "pick": np.arange(1, len(picked) + 1)})

    return candidates.select(by, key, relevance, vector).groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {key} {kinds[key]}, pick int")


def without_redundant(candidates: DataFrame, threshold: float, by: str, key: str, rank: str, vector: str) -> DataFrame:
    """Candidates of each group (a bounded top list) without those nearer than `threshold` to a kept one before them."""
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([rank, key]).reset_index(drop=True)
        x = np.stack(pdf[vector].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        kept: list[int] = []
        for i in range(len(pdf)):
            if threshold == 1 or not kept or float((x[kept] @ x[i]).max()) < threshold:
                kept.append(i)
        return pdf.loc[kept, [by, key, rank]]

    return candidates.select(by, key, rank, vector).groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {key} {kinds[key]}, {rank} {kinds[rank]}")


def hash_embedding(text: Column, size: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed word hashes."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(t: str | None):
            v = np.zeros(size, np.float32)
            for w in (t or "").lower().split():
                h = hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest()
                v[int.from_bytes(h[:4], "little") % size] += 1 if h[4] & 1 else -1
            return v
        return texts.map(one)

    return embed(text)


def cache_lookup(questions: DataFrame, cache: DataFrame, namespace: str = "namespace", question: str = "question") -> DataFrame:
    """Exact hits: the question's key among the entries of its namespace."""
    entries = cache.select(namespace, F.col("cache_key"), F.col("answer"))
    return questions.withColumn("cache_key", T.cache_key(F.col(question))).join(entries, [namespace, "cache_key"], "left").withColumn("hit", F.col("answer").isNotNull())


def scored_by(rows: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], query: str, text: str) -> DataFrame:
    """`score` by a vectorised cross-encoder stand-in over (query, text)."""
    return rows.withColumn("score", F.pandas_udf(scorer, "double")(F.col(query), F.col(text)))
