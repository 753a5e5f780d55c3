"""The deterministic parts of answering: routing, evidence, fusion of sources, parsing of generated text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.core.session import cut
from karst.operators import retrieval as R

#: Multipliers of each kind of search by kind of question.
SEARCH_WEIGHTS = {
    "exploratory": {"vector": 1.5, "keyword": 0.5, "graph": 1.0, "community": 1.8},
    "technical": {"vector": 0.5, "keyword": 1.8, "graph": 0.5, "community": 0.3},
    "relational": {"vector": 1.0, "keyword": 1.0, "graph": 2.5, "community": 1.5},
}
#: Intents and the word starts that show them.
INTENTS = {
    "timeline": ["cronologia", "sequenza", "eventi", "storia", "timeline", "when", "quando", "completa", "tutti", "intero", "full", "complete"],
    "exposure": ["esposizione", "debito", "importo", "quanto", "how much", "exposure", "amount"],
    "guarantees": ["garanzie", "collateral", "security", "guarantee", "ipoteca", "pegno"],
    "payments": ["pagamenti", "versamenti", "payments", "transactions", "rata", "rate"],
    "contacts": ["contatti", "comunicazioni", "lettere", "email", "pec", "contacts"],
    "legal_actions": ["legale", "precetto", "ingiunzione", "tribunale", "legal", "court"],
    "debtor_info": ["debitore", "anagrafica", "chi è", "who is", "debtor", "informazioni"],
    "relationship": ["relazione", "collegamento", "legame", "relationship", "connected", "related", "garanti", "guarantors", "fideiussori", "garante"],
    "vespro": ["vespri", "vespro", "siciliani", "ferdinando", "aragona", "1282", "rivolta"],
}


def search_weights(kind: Column, base: dict[str, float] | None = None) -> Column:
    """Struct (vector, keyword, graph, community): `base` weights (1 each by default) times the
    multipliers of the question's kind; an unknown kind counts as exploratory."""
    base = base or {k: 1.0 for k in SEARCH_WEIGHTS["exploratory"]}

    def pick(name: str) -> Column:
        out = F.lit(SEARCH_WEIGHTS["exploratory"].get(name, 1.0))
        for k, weights in SEARCH_WEIGHTS.items():
            out = F.when(kind == k, weights.get(name, 1.0)).otherwise(out)
        return (F.lit(base[name]) * out).alias(name)

    return F.struct(*(pick(n) for n in base))


def intent_scores(questions: DataFrame, key: str, text: str, intents: dict[str, list[str]] = INTENTS) -> DataFrame:
    """`key`, intent, confidence: the intent with the most word starts in the question, min(hits / 3, 1);
    ties to the first name; general with 0.5 without a hit. Null questions have no row."""
    low = F.lower(F.col(text))
    hits = F.array(*(F.struct(sum(low.rlike(r"\b\Q" + w + r"\E").cast("int") for w in words).alias("hits"), F.lit(-i).alias("order"), F.lit(name).alias("intent")) for i, (name, words) in enumerate(intents.items())))
    best = questions.where(F.col(text).isNotNull()).select(key, F.array_max(hits).alias("b"))
    hit = F.col("b.hits") > 0
    return best.select(key, F.when(hit, F.col("b.intent")).otherwise("general").alias("intent"), F.when(hit, F.least(F.col("b.hits") / 3, F.lit(1.0))).otherwise(0.5).alias("confidence"))


def fused_context(sources: dict[str, DataFrame], score: str, key: str, k: int) -> DataFrame:
    """kind, `key`, score: the `k` best over several sources of evidence, each scaled to [0, 1] first."""
    parts = [R.minmax(df, score).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias(key), F.col("normalised").alias("score")) for kind, df in sources.items()]
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("score"), "kind", key).limit(k)


def evidence_sources(quotes: DataFrame, chunks: DataFrame, lengths: tuple[int, ...] = (200, 80, 40), fuzzy: float = 0.35) -> DataFrame:
    """quote_id, chunk_id, how: where each quote comes from, among the chunks of its document.

    In turn: the first 200, 80, 40 characters of the quote in a chunk; the most alike chunk
    from `fuzzy` on; the first chunk. quotes: quote_id, doc_id, quote; chunks: doc_id,
    chunk_id, text. A quote meets the chunks of its own document only.
    """
    both = quotes.join(chunks, "doc_id")
    steps = [F.when(F.contains("text", F.substring("quote", 1, n)) & (F.length("quote") > 0), i) for i, n in enumerate(lengths)]
    found = both.withColumn("step", F.coalesce(*steps))
    exact = found.where("step is not null").groupBy("quote_id").agg(F.min_by(F.struct("chunk_id", F.lit("text").alias("how")), F.struct("step", "chunk_id")).alias("x"))
    # only quotes that no chunk holds are compared letter by letter, in Arrow batches
    rest = found.join(exact.select("quote_id"), "quote_id", "left_anti")
    kinds = {f.name: f.dataType.simpleString() for f in rest.schema.fields}

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"quote_id": pdf["quote_id"], "chunk_id": pdf["chunk_id"], "r": [_alike(a, b) for a, b in zip(pdf["quote"], pdf["text"])]})

    near = rest.select("quote_id", "chunk_id", "quote", "text").mapInPandas(run, f"quote_id {kinds['quote_id']}, chunk_id {kinds['chunk_id']}, r double")
    near = near.groupBy("quote_id").agg(F.max_by(F.struct("chunk_id", "r"), F.struct("r", "chunk_id")).alias("b"), F.min("chunk_id").alias("first"))
    near = near.select("quote_id", F.when(F.col("b.r") >= fuzzy, F.struct(F.col("b.chunk_id").alias("chunk_id"), F.lit("alike").alias("how"))).otherwise(F.struct(F.col("first").alias("chunk_id"), F.lit("first").alias("how"))).alias("x"))
    return exact.unionByName(near).select("quote_id", "x.chunk_id", "x.how")


def _alike(a: str | None, b: str | None) -> float:
    """Share of matching letters of two whole texts, 0 to 1."""
    if not a or not b:
        return 0.0
    m = SequenceMatcher(None, a.lower(), b.lower(), autojunk=False)
    return m.ratio() if m.real_quick_ratio() >= 0.05 else 0.0


def references_to_tables(texts: DataFrame, tables: DataFrame) -> DataFrame:
    """element_id, table_id of texts that name a table of their document ("Tabella 3"). tables: doc_id, table_id, number."""
    numbers = F.transform(F.regexp_extract_all("text", F.lit(r"(?i)\b(?:tabella|table|tabla|tab\.)\s*(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    named = texts.select("element_id", "doc_id", F.explode(F.array_distinct(numbers)).alias("number"))
    return named.join(tables, ["doc_id", "number"]).select("element_id", "table_id")


def questions_of(text: str, most: int = 10) -> list[str]:
    """Questions from generated text: numbered, bulleted or `Q1:` lines, quotes off, a mark at the end, repeats once."""
    out: list[str] = []
    for line in text.splitlines():
        m = re.match(r"^\s*(?:q(?:uestion)?\s*\d*\s*[:.)]|\d+\s*[.):]|[-*•])\s*(.+)$", line, re.I)
        q = (m[1] if m else line if line.strip().endswith("?") else "").strip().strip("\"'«»").strip()
        if len(q) > 5:
            q = q if q.endswith("?") else q.rstrip(".") + "?"
            if q not in out:
                out.append(q)
    return out[:most]


def json_of(text: str) -> dict | None:
    """The outermost JSON object in generated text; null if there is none that parses."""
    m = re.search(r"\{.*\}", text or "", re.S)
    try:
        found = json.loads(m[0]) if m else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def extraction_records(text: str, record: str = "\n", field: str = "|") -> tuple[list[dict], list[dict]]:
    """(entities, relationships) of delimited records.

    entity|NAME|TYPE|DESCRIPTION with a type of at most three words; relationship|SOURCE|
    TARGET|TYPE|DESCRIPTION|WEIGHT with an optional date; others are dropped. A weight that
    isn't a number counts 1, and 0 stays.
    """
    entities, links = [], []
    for line in text.split(record):
        parts = [p.strip().strip("\"'()") for p in line.split(field)]
        kind = parts[0].lower()
        if kind == "entity" and len(parts) == 4 and parts[1] and len(parts[2].split()) <= 3:
            entities.append({"name": parts[1].upper(), "type": parts[2].upper(), "description": parts[3]})
        elif kind == "relationship" and len(parts) in (6, 7) and parts[1] and parts[2]:
            try:
                weight = float(parts[5].replace(",", "."))
            except ValueError:
                weight = 1.0
            links.append({"src": parts[1].upper(), "dst": parts[2].upper(), "type": parts[3].upper().replace(" ", "_"), "description": parts[4], "weight": weight, "date": parts[6] if len(parts) == 7 else None})
    return entities, links


def requirements_of(csv: DataFrame, text: str) -> DataFrame:
    """req_id (REQ-001, ...), requirement of one column table, header rows left out."""
    rows = csv.where(~F.lower(F.col(text)).startswith("requisit") & (F.length(F.trim(text)) > 0)).withColumn("__n", F.monotonically_increasing_id())
    n = F.row_number().over(Window.orderBy("__n"))  # a list of requirements, written by hand
    return rows.select(F.concat(F.lit("REQ-"), F.lpad(n.cast("string"), 3, "0")).alias("req_id"), F.trim(text).alias("requirement"))


def summary_tree(leaves: DataFrame, each: int, summarise: Callable[[Column], Column], most_levels: int = 8) -> DataFrame:
    """tree of node_id, level, parent_id, text: groups of `each` neighbours are summarised, level by level, to one root.

    leaves: doc_id, position, text. A group holds `each` texts at most; groups are numbered
    by position, so every level has a `each`-th of the nodes below it.
    """
    level = cut(leaves.select("doc_id", F.col("position").cast("long").alias("position"), "text"))
    out = None
    for n in range(most_levels + 1):
        node = F.concat_ws("/", F.col("doc_id").cast("string"), F.lit(str(n)), F.col("position").cast("string"))
        last = level.groupBy("doc_id").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
        top = last <= 1 or n == most_levels
        parent = F.when(F.lit(top), F.lit(None).cast("string")).otherwise(F.concat_ws("/", F.col("doc_id").cast("string"), F.lit(str(n + 1)), F.floor(F.col("position") / each).cast("string")))
        rows = level.select("doc_id", node.alias("node_id"), F.lit(n).alias("level"), parent.alias("parent_id"), "text")
        out = rows if out is None else out.unionByName(rows)
        if top:
            return out
        groups = level.groupBy("doc_id", F.floor(F.col("position") / each).alias("position")).agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("parts"))
        level = cut(groups.select("doc_id", "position", summarise(F.transform("parts", lambda x: x.text)).alias("text")))
    return out


def tree_errors(tree: DataFrame) -> DataFrame:
    """node_id, error of nodes whose parent is missing or not one level above."""
    up = tree.select(F.col("node_id").alias("parent_id"), F.col("level").alias("above"))
    bad = tree.where("parent_id is not null").join(up, "parent_id", "left").where("above is null or above <> level + 1")
    return bad.select("node_id", F.when(F.col("above").isNull(), "no parent").otherwise("wrong level").alias("error"))


def mixture_size(vectors: DataFrame, vector: str, most: int = 12, patience: int = 3, seed: int = 42) -> int:
    """How many Gaussians describe the vectors best, by the Bayesian information criterion; the search ends after
    `patience` sizes without a better one."""
    import math

    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    rows = cut(vectors.select(array_to_vector(F.col(vector).cast("array<double>")).alias("__v")))
    n = rows.count()
    if n < 3:
        return max(1, min(n, 1))
    width = len(vectors.select(vector).first()[0])
    best, at = math.inf, 1
    for k in range(1, min(most, n - 1) + 1):
        model = GaussianMixture(featuresCol="__v", k=max(k, 1), seed=seed, maxIter=40).fit(rows) if k > 1 else None
        free = k * (width + width * (width + 1) / 2) + k - 1
        likelihood = model.summary.logLikelihood if model else _one_gaussian(rows, n, width)
        score = free * math.log(n) - 2 * likelihood
        if score < best:
            best, at = score, k
        elif k - at >= patience:
            break
    return at


def _one_gaussian(rows: DataFrame, n: int, width: int) -> float:
    """Log likelihood of a single Gaussian with the sample's mean and covariance."""
    import math

    import numpy as np
    from pyspark.ml.functions import vector_to_array

    x = rows.select(vector_to_array("__v").alias("x"))
    pairs = x.select(F.posexplode("x").alias("i", "a"), "x").select("i", "a", F.posexplode("x").alias("j", "b"))
    sums = pairs.groupBy("i", "j").agg(F.avg(F.col("a") * F.col("b")).alias("ab"), F.avg("a").alias("a"), F.avg("b").alias("b")).collect()  # width squared rows
    cov = np.zeros((width, width))
    for r in sums:
        cov[r.i, r.j] = r.ab - r.a * r.b
    _, logdet = np.linalg.slogdet(cov + 1e-9 * np.eye(width))
    return -0.5 * n * (width * math.log(2 * math.pi) + logdet + width)


def soft_clusters(vectors: DataFrame, key: str, vector: str, k: int, least: float = 0.1, seed: int = 42) -> DataFrame:
    """`key`, cluster, probability: Gaussian mixture on a principal-component projection; memberships over `least`."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("__v"))
    small = PCA(k=min(8, len(vectors.select(vector).first()[0])), inputCol="__v", outputCol="__p").fit(rows).transform(rows)
    model = GaussianMixture(featuresCol="__p", probabilityCol="__q", k=k, seed=seed, maxIter=30).fit(small)
    q = model.transform(small).select(key, F.posexplode(vector_to_array("__q")).alias("cluster", "probability"))
    return q.where(F.col("probability") > least)
