"""Property graphs as two DataFrames: nodes(id, ...) and edges(src, dst, type, weight, ...).

Traversals are joins; loops run on the driver and cut the lineage each round. Joins are
on node ids, where adaptive execution splits the rows of a hub; aggregations combine on
the map side before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.core.session import cut, staged


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge as (src, dst, weight), the greatest weight of parallel edges, no loops."""
    e = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return e.where("src <> dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def relationships_of(edges: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """Edges that leave (`out`), reach (`in`) or touch (`both`) the nodes of `ids` (column id)."""
    out = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").select(*edges.columns)
    into = edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)
    if direction == "out":
        return out
    if direction == "in":
        return into
    if direction == "both":
        return out.unionByName(into).distinct()
    raise ValueError(f"direction {direction!r}")


def neighbours(edges: DataFrame, seeds: DataFrame, visited: DataFrame | None = None) -> DataFrame:
    """Distinct ids one undirected hop from `seeds` (column id), without those of `visited`."""
    near = undirected(edges).join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return near if visited is None else near.join(visited.select("id"), "id", "left_anti")


def expand(edges: DataFrame, seeds: DataFrame, hops: int, per_hop: int | None = None, least_new: int = 1, most: int | None = None) -> DataFrame:
    """id, hop: nodes within `hops` of the seeds.

    A hop keeps the `per_hop` nodes with the heaviest edge (null: all), and expansion ends
    when a hop finds fewer than `least_new` nodes or `most` nodes are reached.
    """
    ways = cut(undirected(edges))
    seen = cut(seeds.select("id", F.lit(0).alias("hop")).distinct())
    total = seen.count()
    front = seen
    for hop in range(1, hops + 1):
        found = ways.join(front.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("w"))
        found = found.join(seen.select("id"), "id", "left_anti")
        if per_hop:
            found = found.orderBy(F.desc("w"), "id").limit(per_hop)
        front = cut(found.select("id", F.lit(hop).alias("hop")))
        new = front.count()
        seen = seen.unionByName(front)
        total += new
        if new < least_new or (most and total >= most):
            break
    return seen


def paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, longest: int = 3) -> DataFrame:
    """path (array of ids), length: simple undirected paths of at most `longest` edges from `sources` to `targets`."""
    ways = undirected(edges).select("src", "dst")
    ends = targets.select(F.col("id").alias("dst"))
    level = sources.select(F.array("id").alias("path"), F.col("id").alias("at"))
    out = None
    for n in range(1, longest + 1):
        step = level.join(ways, level["at"] == ways["src"]).where(~F.array_contains("path", F.col("dst")))
        level = step.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
        hit = level.join(ends, level["at"] == ends["dst"], "left_semi").select("path", F.lit(n).alias("length"))
        out = hit if out is None else out.unionByName(hit)
    return out


def network(nodes: DataFrame, edges: DataFrame, per_label: int) -> tuple[DataFrame, DataFrame]:
    """At most `per_label` nodes of each label, by id, and the distinct edges with both ends among them."""
    kept = nodes.withColumn("__n", F.row_number().over(Window.partitionBy("label").orderBy("id"))).where(F.col("__n") <= per_label).drop("__n")
    inside = edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")
    return kept, inside.dropDuplicates(["src", "dst", "type"])


def remap(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    """Edges with duplicate ends (canonical: id, root) replaced by their root, loops and repeats gone.

    Of repeated (src, dst, type) the one with the least edge id stays.
    """
    m = canonical.select("id", "root")
    e = edges.join(m.select(F.col("id").alias("src"), F.col("root").alias("__s")), "src", "left").join(m.select(F.col("id").alias("dst"), F.col("root").alias("__d")), "dst", "left")
    e = e.withColumns({"src": F.coalesce("__s", "src"), "dst": F.coalesce("__d", "dst")}).where("src <> dst")
    return e.groupBy("src", "dst", "type").agg(F.min_by(F.struct("id", "weight"), "id").alias("x")).select("src", "dst", "type", "x.id", "x.weight")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, root: the least id of each node's component, by label propagation with pointer jumping."""
    ways = cut(undirected(edges.select("src", "dst", F.lit(1.0).alias("weight"))).select("src", "dst"))
    state = cut(nodes.select("id", F.col("id").alias("root")).distinct())
    while True:
        heard = ways.join(state.select(F.col("id").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("root").alias("heard"))
        step = state.join(heard, "id", "left").select("id", "root", F.least("root", "heard").alias("next"))
        jump = step.select(F.col("id").alias("next"), F.col("next").alias("beyond"))
        step = cut(step.join(jump, "next", "left").select("id", "root", F.least("next", "beyond").alias("new")))
        if step.where("new <> root").isEmpty():
            return step.select("id", "root")
        state = step.select("id", F.col("new").alias("root"))


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-8, block: int = 8) -> DataFrame:
    """id, score: personalised PageRank over undirected weighted edges.

    Restarts and the mass of dangling nodes go to the seeds, evenly; without a seed among
    the nodes, to all nodes. `block` rounds are one plan, written once: a round is a join and an
    aggregation, every node having an edge of no weight to itself that carries its restart.
    Stops when the scores move by less than `tolerance` in total over a block, or after `rounds`.
    No nodes, no rows.
    """
    ways = undirected(edges)
    ids = nodes.select("id").distinct()
    # edges to ids that are no nodes take their share of a node's score with them
    out = ways.groupBy("src").agg(F.sum("weight").alias("total")).where("total > 0")
    start = ids.withColumn("seed", F.lit(0.0)) if seeds is None else ids.join(seeds.select("id", F.lit(1.0).alias("seed")).distinct(), "id", "left").na.fill(0.0, ["seed"])
    start = staged(start.join(out.select(F.col("src").alias("id"), F.lit(False).alias("loose")), "id", "left").withColumn("loose", F.coalesce("loose", F.lit(True))))
    n, hits, bare, bare_seeds = start.agg(F.count("*"), F.sum("seed"), F.count_if("loose"), F.sum(F.when(F.col("loose"), F.col("seed")).otherwise(0.0))).first()
    if not n:
        return start.select("id", F.lit(0.0).alias("score"))
    personal = F.col("seed") / hits if hits else F.lit(1.0 / n)
    share = ways.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")).join(start.select(F.col("id").alias("dst")), "dst", "left_semi")
    own = start.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("share"), personal.alias("p"))
    ways = staged(share.select("src", "dst", "share", F.lit(None).cast("double").alias("p")).unionByName(own))
    state = start.select("id", personal.alias("score"))
    # nothing reaches a dangling node but restarts, so their mass follows from the round before
    restart_of_bare = bare_seeds / hits if hits else bare / n
    loose, done = restart_of_bare, 0
    while done < rounds:
        step = state
        for _ in range(min(block, rounds - done)):
            told = ways.join(step.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id"))
            base = 1 - damping + damping * loose
            step = told.agg((damping * F.sum(F.col("score") * F.col("share")) + base * F.max("p")).alias("score"))
            loose = base * restart_of_bare
            done += 1
        step = staged(step)
        change = step.join(state.select("id", F.col("score").alias("old")), "id").agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
        state = step
        if change < tolerance:
            break
    return state.select("id", "score")


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 6, least_size: int = 1) -> DataFrame:
    """id, community: synchronous weighted label propagation, damped and with deterministic ties.

    In even rounds only nodes with even hash may move, in odd rounds the others, so two
    neighbours never swap labels for ever. A node without edges is its own community.
    Ids are not those of Leiden or Louvain; the partition covers every node. Communities
    under `least_size` are left out.
    """
    ways = cut(undirected(edges))
    state = cut(nodes.select("id", F.col("id").alias("community")).distinct())
    for i in range(rounds):
        votes = ways.join(state.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("w"))
        best = votes.groupBy("id").agg(F.max_by("community", F.struct("w", "community")).alias("wish"))
        moves = F.pmod(F.xxhash64("id"), F.lit(2)) == i % 2
        step = cut(state.join(best, "id", "left").select("id", F.col("community").alias("old"), F.when(moves & F.col("wish").isNotNull(), F.col("wish")).otherwise(F.col("community")).alias("community")))
        still = step.where("old <> community").isEmpty()
        state = step.select("id", "community")
        if still and i:
            break
    if least_size > 1:
        state = state.join(state.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= least_size).select("community"), "community", "left_semi")
    return state.select("id", "community")


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, levels: int = 4, rounds: int = 8, least_size: int = 1) -> DataFrame:
    """id, community: modularity by local moves and aggregation, level by level.

    In a round a node joins the neighbouring community with the greatest gain k_in - resolution *
    k * total / 2m, if it beats its own; a hash parts the nodes into halves that move in turn, so
    neighbours don't swap. When none moves, or after `rounds`, communities become nodes and the
    next level begins; a level that doesn't raise modularity is not taken, and ends it. Ids are
    those of the least member. Communities under `least_size` are left out. Rounds are written as
    parquet: a checkpoint hands on what is known of its columns, which grows with every round.
    """
    ways = undirected(edges).join(nodes.select(F.col("id").alias("src")).distinct(), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    ways = staged(ways.select("src", "dst", "weight"))
    m2 = ways.agg(F.sum("weight")).first()[0]
    member = staged(nodes.select("id", F.col("id").alias("community")).distinct())
    if not m2:
        return member if least_size <= 1 else member.limit(0)
    best = None
    for _ in range(levels):
        degree = ways.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k"))
        state = staged(degree.withColumn("community", F.col("id")))
        still = 0
        for i in range(rounds):
            total = state.groupBy("community").agg(F.sum("k").alias("total"))
            seen = ways.where("src <> dst").join(state.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("weight").alias("inside"))
            own = state.select("id", "community", F.lit(0.0).alias("inside"))
            options = seen.unionByName(own).groupBy("id", "community").agg(F.sum("inside").alias("inside")).join(total, "community")
            options = options.join(state.select("id", "k", F.col("community").alias("now")), "id")
            rest = F.col("total") - F.when(F.col("community") == F.col("now"), F.col("k")).otherwise(0.0)
            gain = F.round(F.col("inside") - resolution * F.col("k") * rest / m2, 9)
            best_of = options.groupBy("id").agg(F.max_by(F.struct("community", "k", "now"), F.struct(gain, F.col("community") == F.col("now"), "community")).alias("b"))
            moves = F.pmod(F.xxhash64("id"), F.lit(2)) == i % 2
            step = staged(best_of.select("id", "b.k", "b.now", F.when(moves, F.col("b.community")).otherwise(F.col("b.now")).alias("community")))
            still = still + 1 if step.where("now <> community").isEmpty() else 0
            state = step.select("id", "k", "community")
            if still == 2:
                break
        q = _quality(ways, state, m2, resolution)
        if best is not None and q <= best + 1e-9:
            break
        best = q
        least = state.groupBy("community").agg(F.min("id").alias("root"))
        state = state.join(least, "community").select("id", F.col("root").alias("community"))
        told = state.select(F.col("id").alias("community"), F.col("community").alias("next"))
        member = staged(member.join(told, "community", "left").select("id", F.coalesce("next", "community").alias("community")))
        a = state.select(F.col("id").alias("src"), F.col("community").alias("a"))
        b = state.select(F.col("id").alias("dst"), F.col("community").alias("b"))
        ways = staged(ways.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")))
    if least_size > 1:
        member = member.join(member.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= least_size).select("community"), "community", "left_semi")
    return member.select("id", "community")


def _quality(ways: DataFrame, state: DataFrame, m2: float, resolution: float) -> float:
    a = state.select(F.col("id").alias("src"), F.col("community").alias("a"))
    b = state.select(F.col("id").alias("dst"), F.col("community").alias("b"))
    inside = ways.join(a, "src").join(b, "dst").where("a = b").agg(F.sum("weight")).first()[0] or 0.0
    spread = state.groupBy("community").agg(F.sum("k").alias("t")).agg(F.sum(F.pow(F.col("t") / m2, 2))).first()[0] or 0.0
    return inside / m2 - resolution * spread


def community_levels(nodes: DataFrame, edges: DataFrame, resolutions: tuple[float, ...] = (0.05, 0.15, 0.35), rounds: int = 8) -> DataFrame:
    """id, community, level: a partition for each resolution, the coarsest first."""
    out = None
    for level, r in enumerate(resolutions):
        part = louvain(nodes, edges, r, levels=2, rounds=rounds).withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
    return out


def modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: modularity of a partition (id, community) over undirected edges."""
    ways = undirected(edges)
    p = parts.select("id", "community")
    both = ways.join(p.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(p.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    total = ways.agg(F.sum("weight").alias("m2"))
    inside = both.where("a = b").groupBy(F.col("a").alias("community")).agg(F.sum("weight").alias("inside"))
    degree = both.groupBy(F.col("a").alias("community")).agg(F.sum("weight").alias("degree"))
    m2 = total.scalar()
    return degree.join(inside, "community", "left").agg(F.sum(F.coalesce("inside", F.lit(0.0)) / m2 - F.pow(F.col("degree") / m2, 2)).alias("modularity"))


# ---- light graph: chunks, entities, co-occurrence ----


def term_frequencies(mentions: DataFrame) -> DataFrame:
    """chunk_id, name, tf: share of a chunk's mentions that name the entity."""
    n = mentions.groupBy("chunk_id", "name").agg(F.count("*").alias("n"))
    return n.withColumn("tf", F.col("n") / F.sum("n").over(Window.partitionBy("chunk_id"))).select("chunk_id", "name", "tf")


def cooccurrence(mentions: DataFrame, least: int = 2, threshold: float = 0.1) -> DataFrame:
    """src < dst, count, npmi of entity names in common chunks.

    Probabilities are shares of chunks, logarithms natural; npmi = ln(p_xy / (p_x p_y)) /
    -ln(p_xy + 1e-12). A chunk holds few entities, so its pairs are bounded by the chunk.
    """
    each = mentions.select("chunk_id", "name").distinct()
    chunks = each.agg(F.count_distinct("chunk_id").alias("n"))
    single = each.groupBy("name").agg(F.count("*").alias("c"))
    a, b = each.alias("a"), each.alias("b")
    pairs = a.join(b, F.expr("a.chunk_id = b.chunk_id and a.name < b.name")).groupBy(F.col("a.name").alias("src"), F.col("b.name").alias("dst")).agg(F.count("*").alias("count"))
    pairs = pairs.where(F.col("count") >= least)
    pairs = pairs.join(single.select(F.col("name").alias("src"), F.col("c").alias("ca")), "src").join(single.select(F.col("name").alias("dst"), F.col("c").alias("cb")), "dst")
    pairs = pairs.withColumn("n", chunks.scalar())
    pxy = F.col("count") / F.col("n")
    npmi = F.ln(pxy / ((F.col("ca") / F.col("n")) * (F.col("cb") / F.col("n")))) / -F.ln(pxy + 1e-12)
    return pairs.withColumn("npmi", npmi).where(F.col("npmi") >= threshold).select("src", "dst", "count", "npmi")


def light_graph(mentions: DataFrame, least: int = 2, threshold: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): chunks as c:id and entities as e:name, HAS_ENTITY weighted by tf, CO_OCCURS by npmi."""
    tf = term_frequencies(mentions)
    has = tf.select(F.concat(F.lit("c:"), "chunk_id").alias("src"), F.concat(F.lit("e:"), "name").alias("dst"), F.lit("HAS_ENTITY").alias("type"), F.col("tf").alias("weight"))
    co = cooccurrence(mentions, least, threshold).select(F.concat(F.lit("e:"), "src").alias("src"), F.concat(F.lit("e:"), "dst").alias("dst"), F.lit("CO_OCCURS").alias("type"), F.col("npmi").alias("weight"))
    edges = has.unionByName(co)
    nodes = has.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes, edges


def boosted(scores: DataFrame, chunk_communities: DataFrame, top_communities: DataFrame, each: float = 0.15, most: float = 0.5) -> DataFrame:
    """id, score raised by min(each * shared communities, most) of itself; chunk_communities: id, community."""
    shared = chunk_communities.join(top_communities.select("community").distinct(), "community", "left_semi").groupBy("id").agg(F.count_distinct("community").alias("n"))
    return scores.join(shared, "id", "left").withColumn("score", F.col("score") * (1 + F.least(each * F.coalesce("n", F.lit(0)), F.lit(most)))).select("id", "score")


def most_common(value: Column, by: list[str], rows: DataFrame) -> DataFrame:
    """`by`, value: the most frequent value of each group, ties to the least; pre-aggregated."""
    n = rows.where(value.isNotNull()).groupBy(*by, value.alias("value")).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
