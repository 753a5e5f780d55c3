"""Digests, usage, histories, compliance, trees, and relational queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.core.session import table
from karst.functions import text as T
from karst.operators import digest as D
from karst.operators import retrieval as R
from karst.registry import query

from .search import CHUNKS, LATEST, chunks


def events(spark, d) -> DataFrame:
    return table(spark, d, "events")


_DAILY = """WITH p AS (SELECT ts::DATE AS day, event_type, count(*) AS n, sum(value) AS v FROM events GROUP BY ALL)"""


@query("digest_daily", _DAILY + """ SELECT day AS window_start, day AS window_end, map_from_entries(list({'k': event_type, 'v': n} ORDER BY event_type)) AS kinds, sum(n)::BIGINT AS rows, round(sum(v), 2) AS total FROM p GROUP BY day""")
def digest_daily(spark, d):
    out = D.digest(events(spark, d), F.to_date("ts"), F.col("event_type"), F.col("value"), "daily")
    return out.withColumn("total", F.round("total", 2))


@query("digest_weekly", """SELECT date_trunc('week', ts)::DATE AS window_start, (date_trunc('week', ts) + INTERVAL 6 DAY)::DATE AS window_end, count(*) AS rows, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def digest_weekly(spark, d):
    out = D.digest(events(spark, d), F.to_date("ts"), F.col("event_type"), F.col("value"), "weekly")
    return out.select("window_start", "window_end", "rows", F.round("total", 2).alias("total"))


@query("digest_monthly_by_user", """SELECT user_id, date_trunc('month', ts)::DATE AS window_start, last_day(ts::DATE) AS window_end, count(*) AS rows, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def digest_monthly_by_user(spark, d):
    out = D.digest(events(spark, d), F.to_date("ts"), F.col("event_type"), F.col("value"), "monthly", ["user_id"])
    return out.select("user_id", "window_start", "window_end", "rows", F.round("total", 2).alias("total"))


@query("digest_rollup", """WITH c AS (SELECT ts::DATE AS day, count(*) AS rows, sum(value) AS total FROM events GROUP BY ALL)
SELECT date_trunc('week', day)::DATE AS window_start, (date_trunc('week', day) + INTERVAL 6 DAY)::DATE AS window_end, count(*) AS children, sum(rows)::BIGINT AS rows, round(sum(total), 2) AS total, count(*) >= 3 AS complete FROM c GROUP BY ALL""")
def digest_rollup(spark, d):
    daily = D.digest(events(spark, d), F.to_date("ts"), F.col("event_type"), F.col("value"), "daily")
    return D.rollup(daily, "weekly").withColumn("total", F.round("total", 2))


@query("digest_missing", """WITH w AS (SELECT unnest(generate_series(DATE '2023-12-25', DATE '2024-02-10', INTERVAL 1 DAY))::DATE AS day)
SELECT day AS window_start, day AS window_end FROM w WHERE day NOT IN (SELECT DISTINCT ts::DATE FROM events)""")
def digest_missing(spark, d):
    have = events(spark, d).select(F.to_date("ts").alias("window_start"), F.to_date("ts").alias("window_end")).distinct()
    return D.missing(D.windows("2023-12-25", "2024-02-10", "daily", spark), have)


@query("calendar_windows", """WITH w AS (SELECT unnest(generate_series(DATE '2024-01-03', DATE '2024-02-15', INTERVAL 1 DAY))::DATE AS day)
SELECT DISTINCT greatest(date_trunc('week', day)::DATE, DATE '2024-01-03') AS window_start, least((date_trunc('week', day) + INTERVAL 6 DAY)::DATE, DATE '2024-02-15') AS window_end FROM w""")
def calendar_windows(spark, d):
    """Weeks of a range, clipped at both ends."""
    return D.windows("2024-01-03", "2024-02-15", "weekly", spark)


@query("digest_sources", f"""WITH {CHUNKS}, x AS (SELECT id, namespace, coalesce(try_strptime(regexp_extract(date_text, '^(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '%Y-%m-%d'), try_strptime(date_text, '%d/%m/%Y'))::DATE AS day FROM c)
SELECT namespace, date_trunc('month', day)::DATE AS window_start, count(*) AS chunks FROM x WHERE day IS NOT NULL GROUP BY ALL""")
def digest_sources(spark, d):
    """Chunks of each namespace and month by the date in their metadata."""
    c = chunks(spark, d).withColumn("day", T.calendar_date(F.col("date_text"))).where("day is not null")
    return c.groupBy("namespace", F.trunc("day", "month").alias("window_start")).agg(F.count("*").alias("chunks"))


@query("date_entity_chunks", LATEST + r""", x AS (SELECT id, namespace, text FROM c)
SELECT id, day FROM (SELECT id, try_strptime(unnest(regexp_extract_all(text, '\b(\d{4}-\d{2}-\d{2})\b', 1)), '%Y-%m-%d')::DATE AS day FROM x) WHERE day BETWEEN DATE '2025-01-01' AND DATE '2025-06-30' GROUP BY ALL""")
def date_entity_chunks(spark, d):
    """Chunks that name a date of the range in their text."""
    days = F.explode(F.regexp_extract_all("text", F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1)))
    c = chunks(spark, d).select("id", days.alias("raw")).select("id", F.try_to_timestamp("raw", F.lit("yyyy-MM-dd")).cast("date").alias("day"))
    return c.where("day between date'2025-01-01' and date'2025-06-30'").distinct()


@query("evidence_budget", LATEST + """, k AS (SELECT namespace, id, least(length(text), 900) AS n FROM c WHERE text IS NOT NULL AND namespace IS NOT NULL),
b AS (SELECT *, sum(n) OVER (PARTITION BY namespace ORDER BY id ROWS UNBOUNDED PRECEDING) AS used FROM k) SELECT namespace, id, used::BIGINT AS used FROM b WHERE used <= 20000""")
def evidence_budget(spark, d):
    """Evidence of a namespace, 900 characters a chunk, until 20,000 are used."""
    c = chunks(spark, d).where("text is not null and namespace is not null").select("namespace", "id", F.least(F.length("text"), F.lit(900)).alias("n"))
    w = Window.partitionBy("namespace").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return c.withColumn("used", F.sum("n").over(w)).where("used <= 20000").select("namespace", "id", "used")


# ---- usage ----


@query("usage_rollup", "SELECT event_type, ts::DATE AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ROLLUP (event_type, day)")
def usage_rollup(spark, d):
    return events(spark, d).rollup("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("usage_cube", "SELECT event_type, hour(ts)::INT AS hour, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY CUBE (event_type, hour)")
def usage_cube(spark, d):
    return events(spark, d).cube("event_type", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("token_usage", """SELECT user_id, sum((props->>'k')::INT)::BIGINT AS prompt, sum((props->>'k')::INT * 2)::BIGINT AS completion, sum((props->>'k')::INT * 3)::BIGINT AS total, count(*) AS calls FROM events GROUP BY user_id""")
def token_usage(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return events(spark, d).groupBy("user_id").agg(F.sum(k).alias("prompt"), F.sum(k * 2).alias("completion"), F.sum(k * 3).alias("total"), F.count("*").alias("calls"))


@query("embedding_cost", r"""WITH t AS (SELECT source, floor(1.8 * coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')), 0)) AS n, CASE WHEN length(text) > 2000 THEN 0.13 ELSE 0.02 END AS price FROM documents)
SELECT source, sum(n)::BIGINT AS tokens, round(sum(n * price) / 1000000, 8) AS cost FROM t GROUP BY source""")
def embedding_cost(spark, d):
    """Tokens by price per million of the model that a text's length calls for."""
    t = table(spark, d, "documents").select("source", T.token_estimate(F.col("text")).alias("n"), F.when(F.length("text") > 2000, 0.13).otherwise(0.02).alias("price"))
    return t.groupBy("source").agg(F.sum("n").alias("tokens"), F.round(F.sum(F.col("n") * F.col("price")) / 1000000, 8).alias("cost"))


@query("latency_histogram", "SELECT event_type, CASE WHEN value < 5 THEN 5 WHEN value < 10 THEN 10 WHEN value < 25 THEN 25 WHEN value < 50 THEN 50 ELSE 1000 END AS le, count(*) AS n FROM events GROUP BY ALL")
def latency_histogram(spark, d):
    le = F.when(F.col("value") < 5, 5).when(F.col("value") < 10, 10).when(F.col("value") < 25, 25).when(F.col("value") < 50, 50).otherwise(1000)
    return events(spark, d).groupBy("event_type", le.alias("le")).agg(F.count("*").alias("n"))


@query("latest_status", "SELECT user_id, max_by(event_type, event_id) AS status, max(ts) AS ts FROM events GROUP BY user_id")
def latest_status(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.max("ts").alias("ts"))


@query("duplicate_deliveries", "SELECT user_id, event_type, value, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_deliveries(spark, d):
    return events(spark, d).groupBy("user_id", "event_type", "value").agg(F.count("*").alias("n")).where("n > 1")


# ---- histories: a user's events as turns ----


@query("last_n_turns", "SELECT user_id, event_id, n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 5")
def last_n_turns(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return events(spark, d).withColumn("n", F.row_number().over(w).cast("long")).where("n <= 5").select("user_id", "event_id", "n")


@query("history_split", "SELECT user_id, count(*) FILTER (WHERE n > 5) AS old, count(*) FILTER (WHERE n <= 5) AS recent FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) GROUP BY user_id")
def history_split(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    e = events(spark, d).withColumn("n", F.row_number().over(w))
    return e.groupBy("user_id").agg(F.count_if(F.col("n") > 5).alias("old"), F.count_if(F.col("n") <= 5).alias("recent"))


@query("history_text", "SELECT user_id, string_agg(event_type || ': ' || (props->>'k'), chr(10) ORDER BY event_id) AS history FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 10 GROUP BY user_id")
def history_text(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    e = events(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 10")
    turn = F.struct("event_id", F.concat("event_type", F.lit(": "), F.get_json_object("props", "$.k")).alias("t"))
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x.t), "\n").alias("history"))


@query("running_budget", "SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 2) AS used FROM events")
def running_budget(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, d).select("event_id", "user_id", F.round(F.sum("value").over(w), 2).alias("used"))


@query("lag_lead", "SELECT event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after, round(epoch(ts - lag(ts) OVER w), 3) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def lag_lead(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (ts - F.lag(ts).over(w)) / 1e6
    return events(spark, d).select("event_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"), F.round(gap, 3).alias("gap"))


# ---- judgements: reading labels and lines as graded criteria ----


@query("compliance_summary", """SELECT grader, count(*) AS total, count(*) FILTER (WHERE reading_level >= 3) AS compliant, count(*) FILTER (WHERE reading_level IS NULL) AS unverifiable,
round(count(*) FILTER (WHERE reading_level >= 3) / nullif(count(*) FILTER (WHERE reading_level IS NOT NULL), 0), 4) AS rate FROM reading_labels GROUP BY grader""")
def compliance_summary(spark, d):
    level = F.col("reading_level")
    good, seen = F.count_if(level >= 3), F.count_if(level.isNotNull())
    return table(spark, d, "reading_labels").groupBy("grader").agg(
        F.count("*").alias("total"), good.alias("compliant"), F.count_if(level.isNull()).alias("unverifiable"), F.round(F.try_divide(good, seen), 4).alias("rate")
    )


@query("proportional_score", "SELECT l_orderkey, l_linenumber, l_suppkey, round(l_quantity / max(l_quantity) OVER (PARTITION BY l_orderkey) * 10, 2) AS points FROM lineitem")
def proportional_score(spark, d):
    """Ten points for the greatest quantity of an order, the others in proportion."""
    most = F.max("l_quantity").over(Window.partitionBy("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.round(F.when(most > 0, F.col("l_quantity") / most * 10), 2).alias("points"))


@query("lot_ranking", """WITH s AS (SELECT l_returnflag AS lot, l_suppkey, round(sum(l_extendedprice), 2) AS points FROM lineitem GROUP BY ALL)
SELECT lot, l_suppkey, points, row_number() OVER (PARTITION BY lot ORDER BY points DESC, l_suppkey) AS place FROM s""")
def lot_ranking(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("lot"), "l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("points"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("lot").orderBy(F.desc("points"), "l_suppkey")).cast("long"))


@query("review_items", """SELECT doc_id, 'disagree' AS reason FROM (SELECT doc_id FROM reading_labels GROUP BY doc_id HAVING min(reading_level) <> max(reading_level)) UNION ALL SELECT DISTINCT doc_id, 'missing' FROM reading_labels WHERE reading_level IS NULL""")
def review_items(spark, d):
    """What a person must look at: graders that disagree, grades that are missing."""
    r = table(spark, d, "reading_labels")
    apart = r.groupBy("doc_id").agg(F.min("reading_level").alias("a"), F.max("reading_level").alias("b")).where("a <> b").select("doc_id", F.lit("disagree").alias("reason"))
    return apart.unionByName(r.where("reading_level is null").select("doc_id", F.lit("missing").alias("reason")).distinct())


@query("mode_scores", """SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN round(least(greatest(l_discount * 10, 0), 1) * 5, 2) WHEN 'N' THEN CASE WHEN l_tax > 0.04 THEN 5.0 ELSE 0.0 END END AS score, l_discount < 0.02 AS review FROM lineitem""")
def mode_scores(spark, d):
    """Coefficient times points, all or nothing, or none, by the criterion's mode; weak evidence goes to review."""
    clamp = F.least(F.greatest(F.col("l_discount") * 10, F.lit(0.0)), F.lit(1.0))
    score = F.when(F.col("l_returnflag") == "A", F.round(clamp * 5, 2)).when(F.col("l_returnflag") == "N", F.when(F.col("l_tax") > 0.04, 5.0).otherwise(0.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", score.alias("score"), (F.col("l_discount") < 0.02).alias("review"))


@query("product_mentions", """WITH p AS (SELECT DISTINCT split_part(lower(properties['name']), ' ', 1) AS word FROM graph_nodes WHERE length(split_part(lower(properties['name']), ' ', 1)) >= 6),
w AS (SELECT DISTINCT id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS word FROM chunks) SELECT word, count(DISTINCT id) AS chunks FROM w JOIN p USING (word) GROUP BY word""")
def product_mentions(spark, d):
    """Chunks that hold the first word of a node's name: containment by word, not by nested loops."""
    first = F.element_at(F.split(F.lower(F.try_element_at("properties", F.lit("name"))), " "), 1)
    p = table(spark, d, "graph_nodes").select(first.alias("word")).where("length(word) >= 6").distinct()
    w = table(spark, d, "chunks").select("id", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
    return w.join(p, "word").groupBy("word").agg(F.count_distinct("id").alias("chunks"))


# ---- trees: labels of the vectors as clusters ----


@query("tree_level_stats", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def tree_level_stats(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@query("cluster_coherence", """WITH u AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
n AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM u GROUP BY vec_id), s AS (SELECT label, i, sum(x / norm) AS s FROM u JOIN n USING (vec_id) GROUP BY ALL), q AS (SELECT label, sum(s * s) AS q FROM s GROUP BY label), k AS (SELECT label, count(*) AS k FROM embeddings GROUP BY label)
SELECT label, CASE WHEN k < 2 THEN 1.0 ELSE round((q - k) / (k * (k - 1)), 6) END AS coherence FROM q JOIN k USING (label)""")
def cluster_coherence(spark, d):
    """Mean cosine over the pairs of a cluster, without forming the pairs: (|sum of unit vectors|^2 - n) / (n (n - 1))."""
    e = table(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = e.select("label", F.posexplode(F.transform("v", lambda x: x / norm)).alias("i", "x"))
    sums = unit.groupBy("label", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    q = sums.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    return q.select("label", F.when(F.col("n") < 2, 1.0).otherwise(F.round((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6)).alias("coherence"))


@query("sequential_clusters", "SELECT vec_id, label, ((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 10)::BIGINT AS cluster FROM embeddings")
def sequential_clusters(spark, d):
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, d, "embeddings").select("vec_id", "label", F.floor((F.row_number().over(w) - 1) / 10).alias("cluster"))


@query("tree_validation", "WITH l AS (SELECT CASE WHEN l_linenumber = 7 THEN -l_orderkey ELSE l_orderkey END AS l_orderkey, l_linenumber FROM lineitem) SELECT l.l_orderkey, l.l_linenumber FROM l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderkey IS NULL")
def tree_validation(spark, d):
    """Children whose parent doesn't exist: every seventh line is given one that doesn't."""
    lines = table(spark, d, "lineitem").withColumn("l_orderkey", F.when(F.col("l_linenumber") == 7, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")))
    return lines.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("chunk_positions", LATEST + " SELECT id, row_number() OVER w - 1 AS chunk_index, count(*) OVER (PARTITION BY metadata_id) AS total_chunks FROM c WINDOW w AS (PARTITION BY metadata_id ORDER BY page NULLS LAST, id)")
def chunk_positions(spark, d):
    w = Window.partitionBy("metadata_id").orderBy(F.asc_nulls_last("page"), "id")
    return chunks(spark, d).select("id", (F.row_number().over(w) - 1).cast("long").alias("chunk_index"), F.count("*").over(Window.partitionBy("metadata_id")).alias("total_chunks"))


# ---- the star schema: SQL over stored tables ----


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2003-09-02' GROUP BY ALL""")
def pricing_summary(spark, d):
    l = table(spark, d, "lineitem").where("l_shipdate <= timestamp'2003-09-02'")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("revenue_by_nation", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY n_name""")
def revenue_by_nation(spark, d):
    """Five tables; small sides are broadcast where Spark finds them small."""
    t = lambda n: table(spark, d, n)
    j = t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(t("orders").select("o_orderkey", "o_custkey"), F.expr("o_orderkey = l_orderkey"))
    j = j.join(t("customer").select("c_custkey", "c_nationkey"), F.expr("c_custkey = o_custkey")).join(t("nation"), F.expr("n_nationkey = c_nationkey")).join(t("region"), F.expr("r_regionkey = n_regionkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("table_question", "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS mean_price FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL")
def table_question(spark, d):
    """A read-only SQL question on a registered table, as the table assistant runs it."""
    from karst.plans.plugins import ask_table

    return ask_table(table(spark, d, "orders"), "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS mean_price FROM {t} WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")


@query("top_orders_per_customer", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_orders_per_customer(spark, d):
    return R.ranked(table(spark, d, "orders"), "o_totalprice", "o_orderkey", ["o_custkey"]).where("rank <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("customers_without_orders", "SELECT c_custkey FROM (SELECT c_custkey FROM customer UNION ALL SELECT -n_nationkey - 1 FROM nation) WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def customers_without_orders(spark, d):
    """Customers, with one of each nation added who never ordered."""
    added = table(spark, d, "nation").select((-F.col("n_nationkey") - 1).cast("long").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").unionByName(added).join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")
