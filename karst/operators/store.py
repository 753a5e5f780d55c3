"""Stores on parquet: chunks, graphs, caches, artefacts and a catalogue of extracted tables.

A store is a directory partitioned by namespace (graphs: also by kind and label). Writes
replace the partitions they touch: a new version of a partition is written beside the old
one and swapped in by Spark's dynamic partition overwrite, one writer a table.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.core.session import cut
from karst.functions import filters, vectors
from karst.functions import text as T


class _Table:
    def __init__(self, spark: SparkSession, path: str, schema: str, partition_by: list[str]):
        self.spark, self.path, self.schema, self.partition_by = spark, path, schema, partition_by

    def read(self) -> DataFrame:
        """All rows; an empty frame before the first write. Partition predicates prune directories."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def replace(self, rows: DataFrame) -> None:
        """The partitions of `rows` get these rows and no others."""
        rows = cut(rows)  # the rows may come from the very files that are replaced
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.partition_by).parquet(self.path)

    def drop(self, where: Column, keys: list[str]) -> None:
        """Delete the rows of `where`: their partitions are rewritten without them, or removed when none is left."""
        all_ = self.read()
        gone = F.coalesce(where, F.lit(False))
        touched = cut(all_.where(gone).select(*self.partition_by).distinct())
        kept = cut(all_.join(touched, self.partition_by, "left_semi").where(~gone))
        empty = [r for r in touched.join(kept.select(*self.partition_by).distinct(), self.partition_by, "left_anti").collect()]  # one row a partition
        if kept.columns:
            self.replace(kept.select(*all_.columns))
        jvm = self.spark.sparkContext._jvm
        for r in empty:
            where_ = jvm.org.apache.hadoop.fs.Path("/".join([self.path, *(f"{c}={r[c]}" for c in self.partition_by)]))
            where_.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where_, True)


CHUNK = "id string, metadata_id string, metadata_source string, metadata_type string, text string, page int, tags array<string>, metadata map<string,string>, embedding array<float>, namespace string"


class ChunkStore:
    """Chunks by namespace. `upsert` replaces documents, `search` filters before it ranks."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = _Table(spark, path, CHUNK, ["namespace"])

    def upsert(self, rows: DataFrame) -> None:
        """Delete, then insert: documents (namespace, metadata_id) of `rows` lose their old chunks.

        Missing columns are null, but namespace is `default`, tags are empty and the page is 1.
        Rows without an id are left out; of a repeated id one stays.
        """
        fields = [f.strip().split(" ", 1) for f in CHUNK.split(", ")]
        new = rows.select(*((F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in fields)).where("id is not null")
        new = new.withColumns({"namespace": F.coalesce("namespace", F.lit("default")), "tags": F.coalesce("tags", F.array().cast("array<string>")), "page": F.coalesce("page", F.lit(1))})
        new = cut(new.dropDuplicates(["namespace", "id"]))
        spaces = new.select("namespace").distinct()
        documents = new.select("namespace", "metadata_id").distinct()
        old = self.table.read().join(spaces, "namespace", "left_semi").join(documents, ["namespace", "metadata_id"], "left_anti").join(new.select("namespace", "id"), ["namespace", "id"], "left_anti")
        self.table.replace(old.select(*new.columns).unionByName(new))

    def get(self, namespace: str | None = None, tags: str | list[str] | None = None, where: dict[str, Any] | None = None, ids: Iterable[str] | None = None, with_text: bool = True) -> DataFrame:
        rows = self.table.read()
        if namespace is not None:
            rows = rows.where(F.col("namespace") == namespace)
        if ids is not None:
            rows = rows.where(F.col("id").isin(list(ids)))
        rows = rows.where(filters.tag_filter(tags) & filters.metadata_filter(where))
        return rows if with_text else rows.drop("text", "embedding")

    def delete(self, namespace: str, metadata_id: str | None = None, chunk_id: str | None = None) -> None:
        where = F.col("namespace") == namespace
        if metadata_id is not None:
            where = where & (F.col("metadata_id") == metadata_id)
        if chunk_id is not None:
            where = where & (F.col("id") == chunk_id)
        self.table.drop(where, ["id"])

    def namespaces(self) -> DataFrame:
        return self.table.read().groupBy("namespace").agg(F.count("*").alias("chunks"))

    def describe(self, namespace: str) -> DataFrame:
        return self.get(namespace).groupBy("metadata_id").agg(F.count("*").alias("chunks"), F.min("metadata_source").alias("source"))


class GraphStore:
    """Nodes by namespace and label, relationships by namespace and type; ids are unique in a namespace."""

    def __init__(self, spark: SparkSession, path: str):
        self.nodes = _Table(spark, path + "/nodes", "id string, name string, properties map<string,string>, source_ids array<string>, namespace string, label string", ["namespace", "label"])
        self.edges = _Table(spark, path + "/edges", "id string, src string, dst string, weight double, properties map<string,string>, namespace string, type string", ["namespace", "type"])

    @staticmethod
    def _merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
        return old.join(new.select(*keys), keys, "left_anti").unionByName(new.dropDuplicates(keys))

    def put_nodes(self, rows: DataFrame) -> None:
        """Insert or replace by (namespace, label, id)."""
        old = self.nodes.read()
        rows = rows.select(*old.columns)
        touched = rows.select("namespace", "label").distinct()
        self.nodes.replace(self._merged(old.join(touched, ["namespace", "label"], "left_semi").select(*rows.columns), rows, ["namespace", "label", "id"]))

    def put_edges(self, rows: DataFrame) -> None:
        """Insert or replace by (namespace, type, src, dst); loops are dropped."""
        old = self.edges.read()
        rows = rows.where("src <> dst").select(*old.columns)
        touched = rows.select("namespace", "type").distinct()
        self.edges.replace(self._merged(old.join(touched, ["namespace", "type"], "left_semi").select(*rows.columns), rows, ["namespace", "type", "src", "dst"]))

    def delete(self, namespace: str) -> None:
        for t in (self.nodes, self.edges):
            t.drop(F.col("namespace") == namespace, ["id"])


class TreeStore:
    """Trees of summaries by namespace: nodes with parent, level and text."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = _Table(spark, path, "node_id string, parent_id string, level int, text string, namespace string", ["namespace"])

    def put(self, rows: DataFrame) -> None:
        """The namespaces of `rows` get these trees and no others."""
        self.table.replace(rows.select("node_id", "parent_id", "level", "text", "namespace").dropDuplicates(["namespace", "node_id"]))

    def get(self, namespace: str, level: int | None = None) -> DataFrame:
        rows = self.table.read().where(F.col("namespace") == namespace)
        return rows if level is None else rows.where(F.col("level") == level)

    def list(self) -> DataFrame:
        return self.table.read().groupBy("namespace").agg(F.count("*").alias("nodes"), F.max("level").alias("depth"))

    def delete(self, namespace: str) -> None:
        self.table.drop(F.col("namespace") == namespace, ["node_id"])


class AnswerCache:
    """Answers by namespace and question key, each until its time is over."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = _Table(spark, path, "cache_key string, question string, answer string, embedding array<float>, expires_at timestamp, namespace string", ["namespace"])

    def store(self, rows: DataFrame, hours: float = 24.0) -> None:
        """namespace, question, answer and perhaps embedding; a question asked again is replaced."""
        new = rows.withColumns({"cache_key": T.cache_key(F.col("question")), "expires_at": F.current_timestamp() + F.expr(f"interval {int(hours * 3600)} seconds")})
        if "embedding" not in new.columns:
            new = new.withColumn("embedding", F.lit(None).cast("array<float>"))
        old = self.table.read()
        new = new.select(*old.columns)
        touched = new.select("namespace").distinct()
        live = old.where(F.col("expires_at") > F.current_timestamp()).join(touched, "namespace", "left_semi").select(*new.columns)
        self.table.replace(GraphStore._merged(live, new, ["namespace", "cache_key"]))

    def live(self) -> DataFrame:
        return self.table.read().where(F.col("expires_at") > F.current_timestamp())

    def lookup(self, questions: DataFrame, least: float = 0.92) -> DataFrame:
        """namespace, question, answer, how: exact (the question's key), near (the nearest stored question of
        the namespace with a cosine of `least` or more) or none. questions: namespace, question, embedding.

        Only questions without an exact entry are compared, with the entries of their own namespace.
        """
        live = self.live()
        asked = questions.withColumn("cache_key", T.cache_key(F.col("question")))
        first = asked.join(live.select("namespace", "cache_key", "answer"), ["namespace", "cache_key"], "left")
        exact = first.where("answer is not null").select("namespace", "question", "answer", F.lit("exact").alias("how"))
        rest = first.where("answer is null").drop("answer")
        entries = live.where("embedding is not null").select("namespace", F.col("embedding").alias("__e"), F.col("answer").alias("__a"), F.col("cache_key").alias("__k"))
        scored = rest.join(entries, "namespace", "left").withColumn("s", F.when(F.col("__e").isNotNull(), F.round(vectors.cosine(F.col("embedding"), F.col("__e")), 9)))
        best = scored.groupBy("namespace", "question").agg(F.min_by(F.struct("s", F.col("__a").alias("answer")), F.struct(-F.coalesce("s", F.lit(-2.0)), F.col("__k"))).alias("b"))
        hit = F.coalesce(F.col("b.s") >= least, F.lit(False))
        near = best.select("namespace", "question", F.when(hit, F.col("b.answer")).alias("answer"), F.when(hit, "near").otherwise("none").alias("how"))
        return exact.unionByName(near)

    def invalidate(self, namespace: str) -> None:
        self.table.drop(F.col("namespace") == namespace, ["cache_key"])

    def stats(self) -> DataFrame:
        return self.live().groupBy("namespace").agg(F.count("*").alias("entries"))


def register_tables(spark: SparkSession, catalogue: DataFrame) -> int:
    """A temporary view for each extracted table: catalogue has name and path (a row a table, few)."""
    n = 0
    for r in catalogue.select("name", "path").distinct().collect():
        spark.read.parquet(r["path"]).createOrReplaceTempView(r["name"])
        n += 1
    return n
