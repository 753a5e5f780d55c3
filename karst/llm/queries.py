"""The pN_ queries, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.core.session import table

from . import mainbody, names, neardup, pack, reading, scanned, split, tokenize


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.pairs_of(names.same_names(table(spark, sf_dir, "extracted_entities"), table(spark, sf_dir, "graph_nodes")))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record and the entity it means."""
    return names.same_names(table(spark, sf_dir, "extracted_entities"), table(spark, sf_dir, "graph_nodes"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, members = neardup.near_duplicates(table(spark, sf_dir, "chunks").select("id", "text"))
    return neardup.expand(links, members)


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with a text, its class of exact copies and the class's links to other classes."""
    links, members = neardup.near_duplicates(table(spark, sf_dir, "chunks").select("id", "text"))
    ends = links.where("a <> b").select(F.explode(F.array("a", "b")).alias("class"))
    return members.join(ends.groupBy("class").agg(F.count("*").alias("links")), "class", "left").select("id", "class", F.coalesce("links", F.lit(0)).alias("links"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainbody.main_body(table(spark, sf_dir, "scraped_pages"), table(spark, sf_dir, "scrape_params"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.repair(table(spark, sf_dir, "page_bodies"), table(spark, sf_dir, "text_elements")).spots


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.paragraphs(scanned.repair(table(spark, sf_dir, "page_bodies"), table(spark, sf_dir, "text_elements")))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = split.stored_items(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "page_bodies"))
    return split.split_oversized(items, table(spark, sf_dir, "ingestion_settings"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that the operator cuts; the pieces are made with their text, as `p5_pieces` has them."""
    return p5_pieces(spark, sf_dir).where("piece_no = 0").select("item_kind", "item_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tokenize.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pack.pack(tokens, table(spark, sf_dir, "pack_capacities"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p1_entities": p1_entities,
    "p2_found": p2_found, "p2_classes": p2_classes,
    "p3_found": p3_found,
    "p4_found": p4_found, "p4_paragraphs": p4_paragraphs,
    "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_ids": p6_ids, "p7_containers": p7_containers, "p8_found": p8_found,
}

_LIMITS = """
WITH s AS (
  SELECT namespace, item_kind, min(CASE WHEN max_chars >= 1 THEN max_chars END) AS m FROM ingestion_settings GROUP BY ALL
), items AS (
  SELECT 'chunk' AS item_kind, id AS item_id, namespace, text FROM chunks
  UNION ALL SELECT 'page_body', body_id, namespace, body FROM page_bodies
)
"""

ORACLE: dict[str, str] = {
    "p5_found": _LIMITS + """
SELECT DISTINCT i.item_kind, i.item_id
FROM items i
LEFT JOIN s own ON own.namespace = i.namespace AND own.item_kind = i.item_kind AND own.namespace <> '*'
LEFT JOIN s d ON d.namespace = '*' AND d.item_kind = i.item_kind
WHERE length(i.text) > coalesce(own.m, d.m)
""",
}
