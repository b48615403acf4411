"""Searches over a graph: seeds from pivots, beam search, and the relational refinement of reservoir candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from vecloom.functions.vectors import emit, sq_l2
from vecloom.operators.blocks import every, join_blocks
from vecloom.operators.exact import knn_pairs, nearest_in_block, top_k, with_self
from vecloom.session import checkpointed
from vecloom.sources.vectors import subsample

#: Seeds of a query.
SEEDS = 16
#: Of a frontier of over HUB_ROWS rows, points with over 1 / HUBS of the rows are dealt with apart; their neighbours' vectors take HUB_BYTES at most.
HUB_ROWS, HUBS, HUB_BYTES = 1 << 20, 128, 64 << 20

#: A search is held to this share of the exact neighbours of SAMPLE of its queries; doubling that adds less than GAIN to it is in vain.
RECALL, SAMPLE, GAIN = 0.96, 512, 0.002


def pivot_count(n: int, beam: int) -> int:
    """About 4 sqrt(n), at least the beam, at most 2,048 and n."""
    return min(max(int(4 * n**0.5), beam), 2048, n)


def pivots(points: DataFrame, n: int, count: int) -> DataFrame:
    """Every (n / count)-th point of points with dense ids 0..n-1, the first `count` of them."""
    step = max(1, n // count)
    return points.where((F.col("id") % step == 0) & (F.col("id") < step * count))


def seeds(queries: DataFrame, pivot_points: DataFrame, many: int = SEEDS) -> DataFrame:
    """(id, rank, nbr, d2): each query's nearest pivots. There are at most 2,048 pivots: one block."""
    parts = 4 * queries.sparkSession.sparkContext.defaultParallelism
    base = pivot_points.select(every(parts), "id", "vec")
    asked = queries.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("block"), "id", "vec")
    return top_k(join_blocks(base, asked, nearest_in_block(many, False), "id long, nbr long, d2 double"), many)


def hubs(frontier: DataFrame, rows: int, most: int) -> DataFrame | None:
    """(nbr): points that over 1 / HUBS of the frontier's rows stand at, `most` of them at most; None for few rows, which no task minds."""
    if rows <= HUB_ROWS:
        return None
    shares = frontier.groupBy("nbr").count().where(F.col("count") > rows / HUBS)
    return shares.orderBy(F.desc("count"), "nbr").limit(most).select("nbr")


def with_table(rows: DataFrame, table: DataFrame, hot: DataFrame | None) -> DataFrame:
    """rows joined with a table by nbr, which is bucketed so and is not exchanged; what the table has of hot ones is broadcast, so that their rows stay where they are."""
    if hot is None:
        return rows.join(table, "nbr")
    named = F.broadcast(hot)
    own = rows.join(named, "nbr", "left_semi").join(F.broadcast(table.join(named, "nbr", "left_semi")), "nbr")
    return rows.join(named, "nbr", "left_anti").join(table, "nbr").unionByName(own)


def beam_search(points: DataFrame, edges: DataFrame, queries: DataFrame, start: DataFrame, width: int, d: int, r: int = 64, parts: int | None = None) -> DataFrame:
    """(id, nbr, d2): beams that begin as the `width` nearest of start (id, nbr, d2) and advance by joins; at every size.

    A round expands all unvisited members of each beam at once, scores the neighbours not scored before, and keeps
    the `width` nearest, equals by nbr; the rounds end when no beam has an unvisited member. points (by id) and edges (by
    src) are best bucketed tables of `parts` buckets: then a round moves the frontier's ids to the edges, ids of
    neighbours to the queries, and a query's vector to each new neighbour's bucket; points and edges stay. Small
    tables are broadcast where Spark finds them small enough. r: a bound on degrees, for what hubs may broadcast.

    What was scored is written round by round, beams in a folder of their own; the driver sees one count a round."""
    spark = points.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = min(HUBS, HUB_BYTES // (8 * (d + 2) * (r + 1)))
    q, p = queries.select("id", F.col("vec").alias("q")), points.select(F.col("id").alias("nbr"), "vec")
    out = edges.select(F.col("src").alias("nbr"), "dst")
    place = F.row_number().over(Window.partitionBy("id").orderBy("d2", "nbr"))
    state, seen = start.groupBy("id", "nbr").agg(F.min("d2").alias("d2")).withColumn("visited", F.lit(False)), None
    while True:
        watch = Observation()
        ranked = state.withColumn("kept", place <= width).observe(watch, F.count_if(F.col("kept") & ~F.col("visited")).alias("open"))
        state = checkpointed(ranked, "beam", by="kept")
        beam, scored = state.where("kept"), state.select("id", "nbr")
        if not (rows := watch.get["open"]):
            return beam.select("id", "nbr", "d2")
        seen = scored if seen is None else seen.unionAll(scored)
        fresh = beam.where("not visited").select("id", "nbr")
        hot = hubs(fresh, rows, most)
        near = None if hot is None else out.join(F.broadcast(hot), "nbr", "left_semi").select(F.col("dst").alias("nbr")).distinct()
        hop = with_table(fresh, out, hot).select("id", F.col("dst").alias("nbr"), F.lit(0).alias("old"))
        new = hop.unionAll(seen.withColumn("old", F.lit(1))).repartition(parts, "id").groupBy("id", "nbr").agg(F.max("old").alias("old")).where("old = 0")
        met = with_table(new.select("id", "nbr").join(q, "id"), p, near)
        state = beam.select("id", "nbr", "d2", F.lit(True).alias("visited")).unionAll(met.select("id", "nbr", sq_l2(F.col("q"), F.col("vec"), d).alias("d2"), F.lit(False)))


def sampled(points: DataFrame, queries: DataFrame, n: int, k: int, skip_self: bool) -> tuple[DataFrame, DataFrame]:
    """(id, vec) of SAMPLE queries by hash, and (id, nbr): their k nearest of all n points, compared with every one."""
    few = checkpointed(subsample(queries, SAMPLE), "sample")
    return few, checkpointed(knn_pairs(points, few, n, max(k, 1), skip_self).select("id", "nbr"), "wanted")


def share_found(found: DataFrame, wanted: DataFrame) -> float:
    """The share of wanted pairs (id, nbr) that are among found ones."""
    hits = wanted.join(found.select("id", "nbr", F.lit(1).alias("hit")).distinct(), ["id", "nbr"], "left")
    return hits.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]


def widened(walk: Callable[[DataFrame, int, int | None], DataFrame], points: DataFrame, queries: DataFrame, n: int, k: int, width: int, skip_self: bool) -> DataFrame:
    """(id, nbr, d2): what walk(queries, width, number of queries or None) finds, at `width` or wider.

    Beams of a sample are doubled until they hold RECALL of its exact neighbours, or gain no more; then all queries walk once,
    at that width. How wide is enough depends on how many points there are, and on how they lie, so it is measured."""
    few, wanted = sampled(points, queries, n, k, skip_self)
    share, before = share_found(walk(few, width, SAMPLE), wanted), -1.0
    while share < RECALL and width < n and share >= before + GAIN:
        width, before = min(2 * width, n), share
        share = share_found(walk(few, width, SAMPLE), wanted)
    return walk(queries, width, n if queries is points else None)


def expand(candidates: DataFrame, edges: DataFrame, nearest: int = 6) -> DataFrame:
    """(id, nbr): candidates (src, dst, norm), each point's own graph neighbours, and those of its `nearest` nearest candidates."""
    own = candidates.select(F.col("src").alias("id"), F.col("dst").alias("nbr"), F.col("norm").alias("d2"))
    first = top_k(own, nearest).select("id", F.col("nbr").alias("src"))
    hop = edges.select("src", F.col("dst").alias("nbr"))
    out = own.select("id", "nbr").union(hop.select(F.col("src").alias("id"), "nbr")).union(first.join(hop, "src").select("id", "nbr"))
    return out.where("id <> nbr").distinct()


def score(pairs: DataFrame, points: DataFrame, d: int | None = None) -> DataFrame:
    """(id, nbr, d2): exact squared distances of pairs (id, nbr)."""
    a, b = points.select("id", F.col("vec").alias("a")), points.select(F.col("id").alias("nbr"), F.col("vec").alias("b"))
    return pairs.join(a, "id").join(b, "nbr").select("id", "nbr", sq_l2(F.col("a"), F.col("b"), d).alias("d2"))


def reservoir_knn(candidates: DataFrame, edges: DataFrame, points: DataFrame, k: int, metric: str = "euclidean", refine: bool = True, d: int | None = None) -> DataFrame:
    """(id, rank, nbr, dist): self-kNN from reservoir candidates alone, or refined by one step along the graph. Joins and windows only."""
    pairs = expand(candidates, edges) if refine else candidates.select(F.col("src").alias("id"), F.col("dst").alias("nbr")).where("id <> nbr").distinct()
    return with_self(top_k(score(pairs, points, d), k), points, metric)


def shown(found: DataFrame, k: int, metric: str) -> DataFrame:
    """(id, rank from 1, nbr, dist) of (id, nbr, d2)."""
    return top_k(found, k).select("id", F.col("rank").cast("long").alias("rank"), "nbr", emit(F.col("d2"), metric).alias("dist"))
