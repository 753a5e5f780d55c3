from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from karst.functions import filters, vectors
from karst.functions import text as T


def values(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t")).alias("x")).collect()]


def test_amounts(spark):
    got = values(spark, ["€ 1.234,56", "EUR 1,234.56", "1.234", "12,5", "none", None, "7"], T.amount)
    assert got == [Decimal("1234.56"), Decimal("1234.56"), Decimal("1234.00"), Decimal("12.50"), None, None, Decimal("7.00")]


def test_dates(spark):
    got = values(spark, ["2024-03-01", "2024-03-01T10:00:00Z", "01/03/2024", "1 marzo 2024", "12 July 2024", "31/02/2024", "Date not defined", None], T.calendar_date)
    assert got == [date(2024, 3, 1)] * 4 + [date(2024, 7, 12), None, None, None]


def test_token_estimate_counts_unicode_words(spark):
    assert values(spark, ["über alles, ja!", "", None], T.token_estimate) == [9, 0, 0]


def test_types_magic_before_extension(spark):
    df = spark.createDataFrame([("JVBERi0xLjQK", "a.csv", "x"), (None, "a.csv", "x"), (None, None, "https://a.example/x"), (None, None, None)], "p string, n string, s string")
    got = [r[0] for r in df.select(T.source_type(F.col("s"), F.lit(""), F.col("n"), F.col("p"))).collect()]
    assert got == ["pdf", "csv", "url", None]


def test_entities_and_citations(spark):
    got = values(spark, ["CIG 0F06D5EB89 del 02/01/2024 (2024-01-02) per 1.000,00 € n. 5"], T.entities)[0]
    assert [(e.type, e.name) for e in got] == [("CIG", "0f06d5eb89"), ("DATE_IT", "02/01/2024"), ("MONEY", "1.000,00 €"), ("QUANTITY", "5")]
    assert values(spark, ["a [2] b [1][2]"], T.citation_ids) == [[1, 2]]


def test_heading_levels(spark):
    assert values(spark, ["## a", "1.2 Scope", "IV. Scope", "B. Scope", "text"], T.heading_level) == [2, 2, 1, 2, 0]


@pytest.mark.parametrize(
    "expression, kept",
    [("a", [1, 2]), ("a & b", [2]), ("a | c", [1, 2, 3]), ("!a", [3, 4, 5]), ("!!a", [1, 2]), ("tags: a & !b", [1]), ("!(a | c)", [4, 5]), ("a | b & c", [1, 2]), (None, [1, 2, 3, 4, 5]), ("  ", [1, 2, 3, 4, 5]), (["a", "b"], [2]), ([], [1, 2, 3, 4, 5])],
)
def test_tag_filter(spark, expression, kept):
    df = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["c"]), (4, None), (5, [])], "id int, tags array<string>")
    assert sorted(r.id for r in df.where(filters.tag_filter(expression)).collect()) == kept


@pytest.mark.parametrize("bad", ["a &", "& a", "(a", "a)", "a | | b", "!"])
def test_tag_errors(bad):
    with pytest.raises(filters.TagSyntaxError):
        filters.tag_filter(bad)


def test_metadata_filter(spark):
    df = spark.createDataFrame([(1, 5, "2024-01-05"), (2, 9, "2024-02-01"), (3, None, None)], "id int, page int, day string")
    ids = lambda c: sorted(r.id for r in df.where(filters.metadata_filter(c)).collect())
    assert ids({"page": {"$gte": 5, "$lt": 9}}) == [1]
    assert ids({"page": {"$ne": 5}}) == [2, 3]
    assert ids({"day": {"$gte": "2024-01-31"}}) == [2]
    assert ids({"page": {"$in": [5, 9]}, "id": 2}) == [2]
    assert ids({}) == [1, 2, 3]
    with pytest.raises(ValueError):
        filters.metadata_filter({"page": {"$near": 1}})


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    rows = df.select(vectors.cosine(F.col("a"), F.col("b")), vectors.l2(F.col("a"), F.col("b"))).collect()
    assert [round(r[0], 6) for r in rows] == [0, 1, 0] and round(rows[0][1], 6) == round(5**0.5, 6)
    with pytest.raises(ValueError):
        vectors.similarity("hamming", F.col("a"), F.col("b"))


def test_cleaned_strings_keeps_texts_with_entities(spark, tmp_path):
    import duckdb

    from karst.registry import ORACLE, QUERIES

    rows = [("a", "R&D"), ("b", "&quot;x &amp; y&quot;"), ("c", "&lt;p&gt; l&#39;uno&nbsp;"), ("d", "plain\x01"), ("e", None)]
    spark.createDataFrame(rows, "element_id string, text string").write.parquet(f"{tmp_path}/text_elements.parquet")
    want = {"a": "R&D", "b": "x & y", "c": "<p> l'uno", "d": "plain"}
    assert {r.element_id: r.text for r in QUERIES["cleaned_strings_whole"](spark, str(tmp_path)).collect()} == want
    con = duckdb.connect()
    con.execute(f"create view text_elements as select * from '{tmp_path}/text_elements.parquet/*.parquet'")
    assert dict(con.execute(ORACLE["cleaned_strings_whole"]).fetchall()) == want
