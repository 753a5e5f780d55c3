"""Reports of communities: written, kept, searched and answered from; trees of summaries; snapshots and increments of graphs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.core.session import cut
from karst.operators.hybrid import top

KEY = ["community", "level"]


def reports(members: DataFrame, nodes: DataFrame, edges: DataFrame, budget: int = 18_000, least_line: int = 8) -> DataFrame:
    """community, level, title, size, edges, rating, summary: a report of each community's induced subgraph.

    members: id, community, level; nodes: id, name; edges: id, src, dst, type, weight. The title is
    the best connected member, ties by id. The summary has a line for each relationship, heaviest first,
    as far as `budget` characters reach; lines have `least_line` characters at least, so no more than
    budget / least_line relationships of a community are ever sorted together. rating is ln(1 + edges).
    """
    a = members.select(F.col("id").alias("src"), *KEY)
    b = members.select(F.col("id").alias("dst"), *KEY)
    names = nodes.select("id", "name")
    inside = edges.select("id", "src", "dst", "type", "weight").join(a, "src").join(b, ["dst", *KEY])
    degree = inside.select(*KEY, F.explode(F.array("src", "dst")).alias("id")).groupBy(*KEY, "id").agg(F.count("*").alias("degree"))
    best = members.join(degree, [*KEY, "id"], "left").join(names, "id", "left")
    head = best.groupBy(*KEY).agg(F.min_by("name", F.struct(-F.coalesce("degree", F.lit(0)), F.col("id"))).alias("title"), F.count("*").alias("size"))
    w = Window.partitionBy(*KEY).orderBy(F.desc("weight"), "id")
    counted = inside.groupBy(*KEY).agg(F.count("*").alias("edges"))
    few = inside.withColumn("n", F.row_number().over(w)).where(F.col("n") <= budget // least_line)
    few = few.join(names.select(F.col("id").alias("src"), F.col("name").alias("x")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("y")), "dst")
    few = few.withColumn("line", F.concat_ws(" ", "x", "type", "y")).withColumn("run", F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lines = few.where(F.col("run") <= budget).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    text = lines.select(*KEY, F.array_join(F.transform("l", lambda x: x.line), "\n").alias("summary"))
    out = head.join(counted, KEY, "left").join(text, KEY, "left")
    edges_ = F.coalesce("edges", F.lit(0))
    return out.select(*KEY, "title", "size", edges_.alias("edges"), F.log1p(edges_).alias("rating"), F.coalesce("summary", F.lit("")).alias("summary"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old reports without those that `new` replaces, and the new ones; the key is (community, level)."""
    return old.join(new.select(*KEY), KEY, "left_anti").select(*new.columns).unionByName(new)


def keyword_search(rows: DataFrame, question: str, k: int) -> DataFrame:
    """Reports whose title or summary holds one of the question's first five words of over three letters;
    best rating first, then the lowest level, then the community."""
    words = [w for w in question.lower().split() if len(w) > 3][:5]
    hit = reduce(lambda a, b: a | b, (F.col(c).ilike(f"%{w}%") for c in ("title", "summary") for w in words), F.lit(False))
    return rows.where(hit).orderBy(F.desc("rating"), "level", "community").limit(k)


def prefix_search(rows: DataFrame, question: str, k: int = 5, letters: int = 15) -> DataFrame:
    """Reports that hold the first letters of the question, the highest level first."""
    start = question[:letters].replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return rows.where(F.col("title").ilike(f"%{start}%") | F.col("summary").ilike(f"%{start}%")).orderBy(F.desc("level"), "community").limit(k)


def global_answer(rows: DataFrame, score: Column, again: Column, each: Callable[[Column], Column], most: int = 20, keep: int = 5) -> DataFrame:
    """One row: answer, reports. The `most` best reports by `score`, the `keep` best of them by `again`, an
    answer from each by `each` (a language model, or an expression), joined in their order."""
    first = top(rows, score, most, "community").drop("rank", "score")
    best = top(first, again, keep, "community")
    parts = best.select("rank", each(F.col("summary")).alias("part"))
    joined = parts.agg(F.array_sort(F.collect_list(F.struct("rank", "part"))).alias("p"))  # `keep` rows
    return joined.select(F.array_join(F.transform("p", lambda x: x.part), "\n").alias("answer"), F.size("p").alias("reports"))


def questions_of_report(title: Column, summary: Column) -> Column:
    """Questions that a report answers, where no model wrote any: at most five."""
    subject = F.trim(F.replace(title, F.lit("Community Report:"), F.lit("")))
    named = F.when(F.length(title) > 0, F.array(F.concat(F.lit("What is "), subject, F.lit("?")), F.concat(F.lit("Tell me about "), subject, F.lit(".")), F.concat(F.lit("Can you explain "), subject, F.lit("?"))))
    words = F.array_join(F.slice(F.filter(F.split(summary, r"\s+"), lambda w: w != ""), 1, 10), " ")
    focus = F.when(F.length(summary) > 0, F.array(F.concat(F.lit("What does this community focus on: "), words, F.lit("?"))))
    none = F.array().cast("array<string>")
    return F.slice(F.concat(F.coalesce(named, none), F.coalesce(focus, none), F.array(F.lit("What are the main topics covered in this community?"))), 1, 5)


def report_text(title: Column, summary: Column, questions: Column) -> Column:
    """A report as it is indexed: its questions, title and summary."""
    asked = F.concat(F.lit("Questions this report answers:\n"), F.array_join(F.transform(questions, lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q)), "\n"), F.lit("\n"))
    return F.concat_ws("\n", F.when(F.size(questions) > 0, asked), F.when(F.length(title) > 0, F.concat(F.lit("Title: "), title)), F.when(F.length(summary) > 0, F.concat(F.lit("Summary: "), summary)))


# ---- trees ----


def traverse(tree: DataFrame, score: Column, level: int, steps: int = 6) -> DataFrame:
    """tree, step, node_id: from each tree's best node of `level` down to its best child, level by level.

    tree: tree, node_id, parent_id, level, and the columns of `score`. Ties go to the least node id.
    All trees walk at once; a walk ends at a leaf or after `steps`.
    """
    rows = cut(tree.select("tree", "node_id", "parent_id", "level", score.alias("score")))
    order = F.struct(-F.col("score"), F.col("node_id"))
    at = cut(rows.where(F.col("level") == level).groupBy("tree").agg(F.min_by("node_id", order).alias("node_id")).withColumn("step", F.lit(0)))
    out = at
    for n in range(1, steps + 1):
        below = rows.join(at.select("tree", F.col("node_id").alias("parent_id")), ["tree", "parent_id"])
        at = cut(below.groupBy("tree").agg(F.min_by("node_id", order).alias("node_id")).withColumn("step", F.lit(n)))
        if at.isEmpty():
            break
        out = out.unionByName(at)
    return out.select("tree", "step", "node_id")


# ---- graphs ----


def bridge(entities: DataFrame) -> DataFrame:
    """Nodes of a snapshot's entity rows: renamed to id, name, label (the type, else the first label, else ENTITY), sources from JSON."""
    label = F.coalesce(F.nullif(F.upper(F.trim("entity_type")), F.lit("")), F.upper(F.get("labels", 0)), F.lit("ENTITY"))
    return entities.select(F.col("node_id").alias("id"), "name", label.alias("label"), "description", "namespace", F.coalesce(F.from_json("source_ids", "array<string>"), F.array().cast("array<string>")).alias("source_ids"))


def windows_of(chunks: DataFrame, key: str, by: str, each: int, done: DataFrame | None = None) -> DataFrame:
    """`by`, window, `key`, position: chunks in windows of `each`, without those already `done`.

    Windows are numbered over the chunks that remain, so a run that was broken off goes on where it stopped.
    """
    rest = chunks if done is None else chunks.join(done.select(key), key, "left_anti")
    w = Window.partitionBy(by).orderBy(key)
    n = F.row_number().over(w) - 1
    return rest.select(by, key).withColumn("position", n).withColumn("window", F.floor(F.col("position") / each)).select(by, "window", key, "position")


def increment(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, communities to refresh): what is new is appended, known ids and (src, dst, type) stay.

    A community is refreshed if one of its members is at an end of a new edge."""
    fresh = new_nodes.dropDuplicates(["id"]).join(nodes.select("id"), "id", "left_anti").select(*nodes.columns)
    links = new_edges.where("src <> dst").dropDuplicates(["src", "dst", "type"]).join(edges.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti").select(*edges.columns)
    touched = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.unionByName(fresh), edges.unionByName(links), members.join(touched, "id", "left_semi").select(*KEY).distinct()
