"""Recall, contract checks, and the small statistics of benchmark reports, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.vectors import sq_l2
from vecloom.session import checkpointed
from vecloom.sources.vectors import hash_order


def recall_at_k(approx: DataFrame, exact: DataFrame, k: int, sample: DataFrame | None = None) -> DataFrame:
    """One row (k, recall): the mean share of exact neighbours found, the point itself left out.

    sample (id) restricts both to some ids; an id that approx lacks counts as nothing found."""
    keep = lambda df: df.where("nbr <> id").select("id", "nbr").distinct()
    a, e = keep(approx), keep(exact)
    if sample is not None:
        e = e.join(sample.select("id"), "id", "left_semi")
    hits = e.join(a.withColumn("hit", F.lit(1)), ["id", "nbr"], "left")
    each = hits.groupBy("id").agg((F.coalesce(F.sum("hit"), F.lit(0)) / k).alias("r"))
    return each.agg(F.lit(k).cast("long").alias("k"), F.avg("r").alias("recall"))


def sample_ids(points: DataFrame, n: int = 4000, seed: int = 1) -> DataFrame:
    """(id): n ids of lowest hash."""
    return points.select("id").orderBy(hash_order(F.col("id"), seed), "id").limit(n)


def top_k_of_sparse(coo: DataFrame, k: int) -> DataFrame:
    """(id, rank, nbr, dist) of sparse rows (row, col, value): the k smallest of each row, the row itself left out."""
    rank = F.row_number().over(Window.partitionBy("row").orderBy("value", "col"))
    kept = coo.where("row <> col").withColumn("rank", rank).where(F.col("rank") <= k)
    return kept.select(F.col("row").alias("id"), F.col("rank").cast("long").alias("rank"), F.col("col").alias("nbr"), F.col("value").alias("dist"))


def contract(knn: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """One row of counts, all zero but ids for a sound self-kNN: wrong sizes, self not first, self not at 0, descents, bad distances."""
    ahead = F.lag("dist").over(Window.partitionBy("id").orderBy("rank"))
    top = 2.0 if metric == "cosine" else float("inf")
    rows = knn.withColumn("before", ahead)
    each = rows.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(((F.col("rank") == 0) & (F.col("nbr") != F.col("id"))).cast("int")).alias("other_first"),
        F.max(((F.col("rank") == 0) & (F.col("dist") != 0)).cast("int")).alias("far_first"),
        F.sum((F.col("dist") < F.col("before")).cast("int")).alias("descents"),
        F.sum(((F.col("dist") < 0) | F.isnan("dist") | (F.col("dist") > top)).cast("int")).alias("bad"),
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return each.agg(
        F.count(F.lit(1)).alias("ids"),
        zero((F.col("n") != k + 1).cast("int")).alias("wrong_size"),
        zero("other_first").alias("self_not_first"),
        zero("far_first").alias("self_not_zero"),
        zero("descents").alias("descents"),
        zero("bad").alias("bad_distances"),
    )


def measured(knn: DataFrame, points: DataFrame, d: int | None = None, room: float = 1e-9) -> DataFrame:
    """One row (close): whether both ends of every pair of knn (id, nbr, dist) are points, and its distance is theirs, but for `room`."""
    a, b = points.select("id", F.col("vec").alias("a")), points.select(F.col("id").alias("nbr"), F.col("vec").alias("b"))
    both = knn.select("id", "nbr", "dist").join(a, "id", "left").join(b, "nbr", "left")
    true = F.abs(F.sqrt(sq_l2(F.col("a"), F.col("b"), d)) - F.col("dist")) <= room
    return both.agg(F.coalesce(F.min(F.coalesce(true, F.lit(False))), F.lit(True)).alias("close"))


def distance_histogram(knn: DataFrame, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, n) of the distances to others: bins of equal width, 0 below lo and bins + 1 from hi on."""
    at = F.when(F.col("dist") < lo, 0).when(F.col("dist") >= hi, bins + 1).otherwise(F.floor((F.col("dist") - lo) / ((hi - lo) / bins)) + 1)
    return knn.where("nbr <> id").groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def majority_label(knn: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label, vote): each point's label and the most frequent one of its neighbours, ties to the smaller."""
    voted = knn.where("nbr <> id").join(labels.select(F.col("id").alias("nbr"), F.col("label").alias("vote")), "nbr").groupBy("id", "vote").count()
    top = voted.groupBy("id").agg(F.min_by("vote", F.struct(-F.col("count"), "vote")).alias("vote"))
    return labels.select("id", "label").join(top, "id")


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (ari): agreement of two labellings, from their contingency counts. Both constant or both all distinct: 1."""
    choose = lambda c: (c * (c - 1) / 2).cast("double")
    both = checkpointed(pairs.groupBy(a, b).count(), "contingency")  # read three times
    sum_of = lambda key: both.groupBy(key).agg(F.sum("count").alias("c")).agg(F.sum(choose(F.col("c"))).alias("s")).first()["s"] or 0.0
    cells = both.agg(F.sum(choose(F.col("count"))).alias("s"), F.sum("count").alias("n")).first()
    s, n, x, y = cells["s"] or 0.0, cells["n"] or 0, sum_of(a), sum_of(b)
    total = n * (n - 1) / 2
    expected = x * y / total if total else 0.0
    top = (x + y) / 2 - expected
    return pairs.sparkSession.createDataFrame([(1.0 if not top else float((s - expected) / top),)], "ari double")


def derived(results: DataFrame) -> DataFrame:
    """Adds rows_per_second_m (millions) and seconds_per_million to (n, seconds, ...)."""
    return results.withColumn("rows_per_second_m", F.col("n") / F.col("seconds") / 1e6).withColumn("seconds_per_million", F.col("seconds") / (F.col("n") / 1e6))


def crossover(results: DataFrame, a: str, b: str) -> DataFrame:
    """(n): where the times a and b cross between consecutive sizes, on a log-log line between them."""
    gap = F.log(F.col(a)) - F.log(F.col(b))
    w = Window.orderBy("n")
    rows = results.select("n", gap.alias("g")).withColumn("n2", F.lead("n").over(w)).withColumn("g2", F.lead("g").over(w))
    at = F.exp(F.log("n") + F.col("g") / (F.col("g") - F.col("g2")) * (F.log("n2") - F.log("n")))
    return rows.where((F.col("g") * F.col("g2") <= 0) & (F.col("g") != F.col("g2"))).select(at.alias("n"))


def first_matching(results: DataFrame, target: float, room: float = 0.002) -> DataFrame:
    """The row of the smallest build_k whose recall is at least target - room."""
    return results.where(F.col("recall") >= target - room).orderBy("build_k").limit(1)
