"""Hybrid search over stored chunks, the way of an item into a store, text search, and answers composed of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.functions import text as T
from karst.functions import vectors
from karst.operators import assist as A
from karst.operators import graph as G
from karst.operators import retrieval as R


def top(rows: DataFrame, score: Column, k: int, key: str, digits: int = 9) -> DataFrame:
    """`rows` with score and rank: the `k` best, ties by key. Each task keeps its own `k`."""
    best = rows.withColumn("score", F.round(score, digits)).orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # k rows


def dense_scores(rows: DataFrame, key: str, vector: Column, question: list[float]) -> DataFrame:
    """`key`, dense: cosine of each row's vector with the question's; rows without a vector have none."""
    asked = F.array(*(F.lit(float(x)) for x in question))
    return rows.select(key, vector.alias("__v")).where(F.col("__v").isNotNull()).select(key, vectors.cosine(F.col("__v"), asked).alias("dense"))


def hybrid_rrf(rows: DataFrame, key: str, text: str, vector: Column, question: list[float], terms: dict[str, float], k: int = 10, prefetch: int = 20) -> DataFrame:
    """`key`, rrf, rank: the `prefetch` best by dense and by sparse score of the same rows, fused by reciprocal ranks."""
    dense = top(dense_scores(rows, key, vector, question), F.col("dense"), prefetch, key)
    sparse = top(R.sparse_score(rows, key, text, terms), F.col("sparse"), prefetch, key)
    fused = R.rrf([dense.select(key, "rank"), sparse.select(key, "rank")], key)
    return top(fused, F.col("rrf"), k, key).select(key, F.col("score").alias("rrf"), "rank")


def hybrid_weighted(rows: DataFrame, key: str, text: str, vector: Column, question: list[float], terms: dict[str, float], alpha: float, k: int = 10) -> DataFrame:
    """`key`, score, rank by alpha * dense + (1 - alpha) * sparse, a missing side counting 0."""
    both = dense_scores(rows, key, vector, question).join(R.sparse_score(rows, key, text, terms), key, "full")
    return top(both, R.convex(F.col("dense"), F.col("sparse"), alpha), k, key).select(key, "score", "rank")


def add_items(items: DataFrame, key: str, text: str, split: Callable[[Column], Column], embed: Callable[[Column], Column], store: Any, **fields: Column) -> DataFrame:
    """Texts cut by `split`, embedded by `embed` and put into `store`: the chunks written.

    A chunk's id is the item's with its position; `fields` are further columns of the store,
    such as the namespace. Items with null or blank texts give no chunk, but lose their old ones
    only when they give new ones. The store replaces an item's chunks as a whole.
    """
    parts = items.where(F.length(F.trim(text)) > 0).withColumns(fields).select(F.col(key).cast("string").alias("metadata_id"), *fields, F.posexplode(split(F.col(text))).alias("chunk_index", "text"))
    rows = parts.where(F.length(F.trim("text")) > 0).withColumns({
        "id": F.concat_ws("#", "metadata_id", "chunk_index"), "embedding": embed(F.col("text")).cast("array<float>"),
        "metadata": F.create_map(F.lit("chunk_index"), F.col("chunk_index").cast("string")),
    })
    store.upsert(rows)
    return rows


# ---- text search ----


def text_hits(rows: DataFrame, key: str, columns: list[Column], words: list[str], k: int) -> DataFrame:
    """`key`, hits, rank: rows whose columns hold any of the words (tokens, not substrings), most words first."""
    tokens = F.flatten(F.array(*(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+") for c in columns)))
    hits = F.size(F.array_intersect(tokens, F.array(*(F.lit(w.lower()) for w in words))))
    found = rows.select(key, hits.alias("hits")).where("hits > 0")
    return top(found, F.col("hits").cast("double"), k, key).select(key, "hits", "rank")


def relevance(properties: Column, words: list[str]) -> Column:
    """Occurrences of the words in the values of a property map: how many (value, word) pairs match."""
    hit = lambda v: reduce(lambda a, b: a + b, (F.contains(F.lower(v), F.lit(w.lower())).cast("int") for w in words))
    return F.aggregate(F.map_values(properties), F.lit(0), lambda n, v: n + F.coalesce(hit(v), F.lit(0)))


def expression_of(conditions: dict[str, Any]) -> str:
    """The SQL text of nested conditions: $and, $or (lists), $not, and a field's $eq, $ne, $gt, $gte, $lt, $lte, $in."""
    signs = {"$eq": "=", "$ne": "<>", "$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}

    def value(x: Any) -> str:
        if isinstance(x, bool):
            return str(x).lower()
        return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"

    def one(field: str, want: Any) -> str:
        name = "`" + field.replace("`", "``") + "`"
        if not isinstance(want, dict):
            want = {"$eq": want}
        parts = []
        for op, x in want.items():
            if op == "$in":
                parts.append(f"{name} in ({', '.join(map(value, x))})")
            elif op in signs:
                parts.append(f"{name} {signs[op]} {value(x)}")
            else:
                raise ValueError(f"operator {op!r} is not known")
        return " and ".join(parts)

    parts = []
    for k, v in conditions.items():
        if k in ("$and", "$or"):
            parts.append("(" + f" {k[1:]} ".join(f"({expression_of(x)})" for x in v) + ")")
        elif k == "$not":
            parts.append(f"not ({expression_of(v)})")
        else:
            parts.append(f"({one(k, v)})")
    return " and ".join(parts) or "true"


def page_after(rows: DataFrame, key: str, size: int, after: Any = None) -> DataFrame:
    """The next `size` rows in the order of `key` behind `after`: pages without counting from the start."""
    return (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def first_seeds(lists: list[DataFrame], key: str) -> DataFrame:
    """`key`, position: union of ordered lists (key, position), each key once where it came first."""
    parts = [x.select(key, F.struct(F.lit(i).alias("list"), F.col("position").alias("at")).alias("p")) for i, x in enumerate(lists)]
    first = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.min("p").alias("p"))
    return first.select(key, F.row_number().over(Window.orderBy("p", key)).alias("position"))  # seeds: short lists


# ---- answers ----


def graph_answer(question: str, rows: DataFrame, key: str, text: str, vector: Column, embedded: list[float], terms: dict[str, float], nodes: DataFrame, edges: DataFrame, kind: str, per_chunk: int = 5, k: int = 10, hops: int = 10) -> dict[str, Any]:
    """Retrieval by the kind of a question: kind -> weights -> alpha -> hybrid search -> seeds -> expansion.

    alpha is the vector weight's share of vector and keyword. Seeds are at most `per_chunk`
    nodes of each of the `k` best chunks; the expansion takes int(hops * graph weight) nodes a hop,
    two hops for relational questions and one for others. Gives kind, alpha, chunks (`key`, score,
    rank), seeds (id) and nodes (id, hop).
    """
    weights = A.SEARCH_WEIGHTS.get(kind, A.SEARCH_WEIGHTS["exploratory"])
    alpha = weights["vector"] / (weights["vector"] + weights["keyword"])
    found = hybrid_weighted(rows, key, text, vector, embedded, terms, alpha, k)
    members = nodes.select(F.col("id").alias("__node"), F.explode("source_ids").alias("__chunk")).join(F.broadcast(found.select(F.col(key).alias("__chunk"))), "__chunk")  # k rows
    first = F.row_number().over(Window.partitionBy("__chunk").orderBy("__node"))
    seeds = members.withColumn("n", first).where(F.col("n") <= per_chunk).select(F.col("__node").alias("id")).distinct()
    reached = G.expand(edges, seeds, 2 if kind == "relational" else 1, per_hop=max(1, int(hops * weights["graph"])))
    return {"kind": kind, "alpha": alpha, "chunks": found, "seeds": seeds, "nodes": reached}


#: Words that name a type of relationship, tried in this order.
RELATION_WORDS = {
    "GUARANTEES": ["garanti", "guarantors", "fideiussori", "garante", "garanzie personali"],
    "HAS_LOAN": ["prestiti", "finanziamenti", "mutui", "loan", "debito"],
    "SECURED_BY": ["garanzie reali", "collateral", "ipoteca", "pegno", "garanzia reale"],
    "HAS_PAYMENT": ["pagamenti", "rate", "versamenti", "pagato"],
    "RECEIVED": ["comunicazioni", "lettere", "email", "pec", "contatti"],
    "HAS_LEGAL_ACTION": ["azioni legali", "procedimenti", "tribunale", "legale"],
}
#: Words that ask for everything.
FULL_WORDS = ["completa", "tutti", "tutto", "tutta", "intero", "interi", "full", "complete", "all"]
_NO_NAMES = (
    "mostrami dimmi mostra visualizza elenca lista quali quante quanti quanto qual quando chi cosa come dove perché perche se con senza "
    "tra fra sul sulla sullo nel nella nello dal dalla dallo al alla allo del della dello un una uno il lo la i gli le di a da in su per"
).split()


def question_parameters(text: Column) -> Column:
    """Struct (name, loan_id, is_full, relationship): what a question names.

    The name is the longest run of capitalised words that is no function word, the first of
    several as long; the id follows pratica, loan, id or contratto.
    """
    low = F.lower(text)
    runs = F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)*)\b"), F.lit(1)), lambda x: ~F.lower(x).isin(_NO_NAMES) & (F.length(x) > 2))
    longest = F.array_max(F.transform(runs, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("at"), x.alias("name"))))["name"]
    loan = F.nullif(F.regexp_extract(text, r"(?i)\b(?:pratica|loan|id|contratto)[:\s]+([A-Z0-9\-]+)\b", 1), F.lit(""))
    has = lambda words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    kind = reduce(lambda rest, kv: F.when(has(kv[1]), kv[0]).otherwise(rest), reversed(RELATION_WORDS.items()), F.lit(None).cast("string"))
    return F.struct(longest.alias("name"), loan.alias("loan_id"), has(FULL_WORDS).alias("is_full"), kind.alias("relationship"))


#: The path template of each intent, by the types of relationship it follows.
TEMPLATES = {"exposure": ["HAS_LOAN"], "guarantees": ["GUARANTEES", "SECURED_BY"], "payments": ["HAS_PAYMENT"], "contacts": ["RECEIVED"], "legal_actions": ["HAS_LEGAL_ACTION"], "relationship": list(RELATION_WORDS)}


def by_template(intent: str, relationship: str | None, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The edges that an intent's template takes from the seeds: its types, or the type the question names;
    of intents without types (timeline, general) every edge."""
    near = G.relationships_of(edges, seeds)
    types = [relationship] if relationship else TEMPLATES.get(intent)
    return near.where(F.col("type").isin(types)) if types else near


def relative_range(text: Column, today: Column) -> Column:
    """Struct (date_from, date_to) of what a question says in relation to `today`: yesterday, today, last week,
    this month, or a month by its Italian name in today's year; nulls for none."""
    low = F.lower(text)
    monday = F.date_trunc("week", today).cast("date")
    month = F.array_position(F.array(*(F.lit(m) for m in T.MONTHS_IT)), F.regexp_extract(low, r"\b(?:ad?|di|in) (" + "|".join(T.MONTHS_IT) + r")\b", 1)).cast("int")
    first = F.when(month > 0, F.make_date(F.year(today), month, F.lit(1)))
    pair = lambda a, b: F.struct(a.alias("date_from"), b.alias("date_to"))
    none = F.lit(None).cast("date")
    return (
        F.when(low.rlike(r"\b(ieri|yesterday)\b"), pair(F.date_sub(today, 1), F.date_sub(today, 1)))
        .when(low.rlike(r"\b(oggi|today)\b"), pair(today, today))
        .when(low.rlike(r"\b(settimana scorsa|last week)\b"), pair(F.date_sub(monday, 7), F.date_sub(monday, 1)))
        .when(low.rlike(r"\b(questo mese|this month)\b"), pair(F.trunc(today, "month"), today))
        .when(first.isNotNull(), pair(first, F.last_day(first)))
        .otherwise(pair(none, none))
    )
