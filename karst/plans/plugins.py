"""Plug-in points: named functions, embedding and scoring providers, SQL on a table."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from karst.functions import vectors
from karst.operators.retrieval import hash_embedding

TOOLS: dict[str, Callable[..., Any]] = {}


def tool(name: str) -> Callable:
    """Registers a function under a name, once."""

    def put(f: Callable) -> Callable:
        if name in TOOLS:
            raise ValueError(f"{name} is registered twice")
        TOOLS[name] = f
        return f

    return put


_FORBIDDEN = re.compile(r"(?i)\b(insert|update|delete|merge|drop|create|alter|truncate|replace|grant|copy|load|set|use|cache|refresh|analyze)\b")


def read_only(sql: str) -> str:
    """The statement, if it is one SELECT; else ValueError. Literals may hold any word."""
    bare = re.sub(r"'(?:[^']|'')*'", "''", sql).strip().rstrip(";")
    if ";" in bare or not re.match(r"(?is)^(select|with)\b", bare) or _FORBIDDEN.search(bare):
        raise ValueError("only one SELECT is allowed")
    return sql.strip().rstrip(";")


def ask_table(df: DataFrame, sql: str) -> DataFrame:
    """Result of a read-only statement in which {t} stands for the table."""
    name = f"t_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    try:
        return df.sparkSession.sql(read_only(sql).replace("{t}", name))
    finally:
        df.sparkSession.catalog.dropTempView(name)


CLUSTERINGS: dict[str, Callable[..., DataFrame]] = {}


def clustering(name: str, f: Callable[..., DataFrame] | None = None) -> Callable[..., DataFrame]:
    """The clustering of a name, (rows, key, by) -> key, cluster; with `f`, registers it first."""
    if f is not None:
        CLUSTERINGS[name] = f
    if name not in CLUSTERINGS:
        raise ValueError(f"clustering {name!r} is none of {sorted(CLUSTERINGS)}")
    return CLUSTERINGS[name]


clustering("by_label", lambda rows, key, by: rows.select(key, F.col(by).cast("string").alias("cluster")))
clustering("sequential", lambda rows, key, by: rows.select(key, F.concat_ws("/", F.col(by).cast("string"), F.floor((F.row_number().over(Window.partitionBy(by).orderBy(key)) - 1) / 10).cast("string")).alias("cluster")))


EMBEDDINGS: dict[str, Callable[[Column], Column]] = {"letters": vectors.letter_vector, "hash": hash_embedding}


def embedding(name: str, f: Callable[[Column], Column] | None = None) -> Callable[[Column], Column]:
    """The embedding provider of a name, text -> vector; with `f`, registers it first."""
    if f is not None:
        EMBEDDINGS[name] = f
    if name not in EMBEDDINGS:
        raise ValueError(f"embedding {name!r} is none of {sorted(EMBEDDINGS)}")
    return EMBEDDINGS[name]


def prompt(profiles: Mapping[str, Mapping[str, str]], profile: str, name: str, **fields: str) -> str:
    """A profile's prompt, else the default's, with its fields filled in."""
    text = profiles.get(profile, {}).get(name) or profiles["default"][name]
    return text.format(**fields)


Step = Callable[[dict[str, Any]], tuple[str | None, dict[str, Any]]]


def run_workflow(steps: Mapping[str, Step], start: str, state: dict[str, Any], most: int = 50) -> list[tuple[str, dict[str, Any]]]:
    """(node, state behind it) of each step: a node gives the next node, or None at the end.

    Runs on the driver: states are small, their data are frames. Over `most` steps is an error.
    """
    trace: list[tuple[str, dict[str, Any]]] = []
    node: str | None = start
    while node is not None:
        if len(trace) >= most:
            raise RuntimeError(f"the workflow didn't end within {most} steps")
        at = node
        node, state = steps[at](state)
        trace.append((at, state))
    return trace


class TableLock:
    """One writer a table: a file in the shared folder that only one creation makes."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.where = jvm.org.apache.hadoop.fs.Path(path + "/_writer")
        self.fs = self.where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.held = False

    def take(self) -> bool:
        """Whether the lock is now held; false if another writer holds it."""
        self.fs.mkdirs(self.where.getParent())
        self.held = self.fs.createNewFile(self.where)
        return self.held

    def release(self) -> None:
        if self.held:
            self.fs.delete(self.where, False)
            self.held = False
