"""Random ball carving into overlapping leaves.

Level by level: each node that is too large gets leaders (its points of lowest hash), its points go to their
nearest leader, and so on until nodes fit. Then each point joins the nearest of the other leaves' centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.vectors import product_sq_l2
from vecloom.operators.blocks import batch, every, join_blocks, matrix, smallest, vectors
from vecloom.operators.exact import nearest_in_block, top_k
from vecloom.session import checkpointed
from vecloom.sources.vectors import hash_order

#: Leaders of a node, and clamp(2 size / c_max, 2, LEADERS) of them.
LEADERS = 64
#: Deepest level; nodes that are still too large there are cut up by hash.
DEPTH = 24
#: Rows of a node that are ranked in one task, aimed at.
RANKED = 65_536
#: Bytes of leaders or centroids that are broadcast at most; beyond, points meet them by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Centroids that a point is compared with directly; beyond, it is routed through groups of centroids.
DIRECT = 256
#: Pairs of rows and centres that are compared at once.
TILE = 1 << 21


def leaders(points: DataFrame, c_max: int, seed: int) -> DataFrame:
    """(node, place, id, vec): of each node of points (node, id, vec) clamp(2 * size / c_max, 2, 64) leaders, lowest hash first."""
    sizes = points.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    want = F.greatest(F.lit(2), F.least(F.lit(LEADERS), F.floor(F.col("size") * 2 / c_max)))
    place = F.row_number().over(Window.partitionBy("node").orderBy(hash_order(F.col("id"), seed), "id"))
    first = points.withColumn("place", place).where(F.col("place") <= LEADERS)  # limited before the shuffle
    return first.join(sizes, "node").where(F.col("place") <= want).select("node", (F.col("place") - 1).cast("long").alias("place"), "id", "vec")


def nearest_leader(x: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The place of each row's nearest leader, the first of equals: chosen by a product, settled by direct differences, in tiles of TILE pairs."""
    out = np.zeros(len(x), np.int64)
    size = (lead * lead).sum(1).max(initial=0)
    step = max(1, TILE // max(len(lead), 1))
    for i in range(0, len(x), step):
        own = x[i : i + step]
        d2 = product_sq_l2(own, lead)
        out[i : i + step] = d2.argmin(1)
        close = d2 <= d2.min(1, keepdims=True) + 1e-9 * ((own * own).sum(1) + size + 1)[:, None]
        for r in np.flatnonzero(close.sum(1) > 1):
            c = np.flatnonzero(close[r])
            out[i + r] = c[((lead[c] - own[r]) ** 2).sum(1).argmin()]
    return out


def assign(points: DataFrame, lead: DataFrame, most: int | None = None) -> DataFrame:
    """(node, id, vec, place): each point's nearest leader of its node; most: a bound on the bytes of leaders, if known.

    Leaders are broadcast while they take at most BROADCAST_BYTES; else there are so many nodes that each is a
    small group, which meets its leaders in one task."""
    if most is None:
        first = lead.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
        most = first["n"] * (first["d"] or 0) * 8
    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in ("node", "id", "vec"))
    if most <= BROADCAST_BYTES:
        by_node: dict[int, list] = {}
        for r in lead.orderBy("node", "place").collect():
            by_node.setdefault(r["node"], []).append(r["vec"])
        shared = points.sparkSession.sparkContext.broadcast({k: np.array(v) for k, v in by_node.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                node = b.column("node").to_numpy()
                x = matrix(b.column("vec"))
                place = np.zeros(len(node), np.int64)
                for k in np.unique(node):
                    own = node == k
                    place[own] = nearest_leader(x[own], shared.value[k])
                yield batch(node=b.column("node"), id=b.column("id"), vec=b.column("vec"), place=place)

        return points.select("node", "id", "vec").mapInArrow(run, f"{kinds}, place long")

    def meet(_, left: pa.Table, right: pa.Table) -> pa.Table:
        lead = matrix(right.sort_by("lead_place").column("lead_vec").combine_chunks())
        place = nearest_leader(matrix(left.column("vec").combine_chunks()), lead)
        return left.append_column("place", pa.array(place))

    apart = lead.select("node", "place", "id", "vec").toDF("lead_node", "lead_place", "lead_id", "lead_vec")
    together = points.select("node", "id", "vec").groupBy("node").cogroup(apart.groupBy("lead_node"))
    return together.applyInArrow(meet, f"{kinds}, place long")


def chunk(points: DataFrame, sizes: DataFrame, c_max: int, seed: int) -> DataFrame:
    """(node, id, vec, place): nodes cut into chunks of c_max (the last may be smaller) in the order of (hash, id), whatever their points are.

    A large node is ranked in ranges of the hash, so that no task holds it; repeated ids are points of their own."""
    hashed = points.join(sizes, "node").select("node", "id", "vec", "size", hash_order(F.col("id"), seed + 1).alias("hash"))
    ranges = F.ceil(F.col("size") / RANKED)
    hashed = hashed.withColumn("range", F.floor(F.col("hash") * ranges / float(1 << 32)))
    before = F.sum("n").over(Window.partitionBy("node").orderBy("range")) - F.col("n")
    counted = hashed.groupBy("node", "range").agg(F.count(F.lit(1)).alias("n")).select("node", "range", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("node", "range").orderBy("hash", "id"))
    ranked = hashed.withColumn("own", own).join(counted, ["node", "range"])
    return ranked.select("node", "id", "vec", F.floor((F.col("before") + F.col("own") - 1) / c_max).cast("long").alias("place"))


def carve(points: DataFrame, c_max: int = 2048, seed: int = 0) -> DataFrame:
    """(leaf_id, id, vec): disjoint leaves of at most c_max points.

    The driver sees sums of sizes only. A child that holds over 9/10 of its node (equal points, above all) is cut
    up by hash, and so is any node left at the deepest level; every point ends in one leaf."""
    first = points.select(F.size("vec").alias("d")).first()
    level = points.select(F.lit(0).cast("long").alias("node"), "id", "vec", F.lit(False).alias("stuck"))
    done = []
    for depth in range(DEPTH + 2):
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.max("stuck").alias("stuck"))
        sizes = checkpointed(sizes, "sizes")
        counted = level.drop("stuck").join(sizes, "node")
        done.append(counted.where(F.col("size") <= c_max).select(F.col("node").alias("leaf_id"), "id", "vec"))
        large = sizes.where(F.col("size") > c_max)
        nodes = large.count()
        if not nodes:
            break
        if depth > DEPTH:
            raise RuntimeError(f"{nodes} nodes are too large below the deepest level")
        at_end = depth >= DEPTH
        rest = counted.where(F.col("size") > c_max)
        even = rest.where(F.lit(not at_end) & ~F.col("stuck")).select("node", "id", "vec")
        split = assign(even, leaders(even, c_max, seed + depth), nodes * LEADERS * first["d"] * 8)
        odd = rest.where(F.lit(at_end) | F.col("stuck")).select("node", "id", "vec")
        split = split.unionByName(chunk(odd, large.select("node", "size"), c_max, seed + depth))
        split = checkpointed(split, "level")
        child = F.xxhash64(F.lit(depth), "node", "place")
        grown = split.groupBy("node", "place").agg(F.count(F.lit(1)).alias("n")).join(large.select("node", "size"), "node")
        grown = grown.select(child.alias("child"), (F.col("n") > F.col("size") * 0.9).alias("stuck"))
        level = split.select(child.alias("child"), "id", "vec").join(grown, "child").select(F.col("child").alias("node"), "id", "vec", "stuck")
    out = done[0]
    for leaf in done[1:]:
        out = out.union(leaf)
    return out


def centroids(members: DataFrame, key: str = "leaf_id") -> DataFrame:
    """(key, vec): the mean of each group's vectors, summed before the shuffle."""
    at = members.select(key, F.posexplode("vec").alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x"))
    return at.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).select(key, F.col("v.x").alias("vec"))


def group_centroids(centres: DataFrame, seed: int = 0) -> DataFrame:
    """(block, id, vec) of centroids (leaf_id, vec): sqrt(leaves) of them, of lowest hash, lead groups; block is the nearest one's place."""
    groups = max(1, int(centres.count() ** 0.5))
    heads = centres.orderBy(hash_order(F.col("leaf_id"), seed), "leaf_id").limit(groups).collect()
    shared = centres.sparkSession.sparkContext.broadcast(np.array([r["vec"] for r in heads]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield batch(block=nearest_leader(matrix(b.column("vec")), shared.value), id=b.column("leaf_id"), vec=b.column("vec"))

    return centres.select("leaf_id", "vec").mapInArrow(run, "block long, id long, vec array<double>")


def nearest_groups(points: DataFrame, centres: DataFrame | np.ndarray, probes: int, residual: bool = False) -> DataFrame:
    """(block, id, vec): each row of points once for each of its `probes` nearest group centres, which are few: (block, vec), or rows of an array.

    residual: vec less the centre."""
    if isinstance(centres, DataFrame):
        rows = centres.orderBy("block").collect()
        blocks, c = np.array([r["block"] for r in rows], np.int64), np.array([r["vec"] for r in rows])
    else:
        blocks, c = np.arange(len(centres)), centres
    shared = points.sparkSession.sparkContext.broadcast((blocks, c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, c = shared.value
        step, most = max(1, TILE // max(len(c), 1)), min(probes, len(c))
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                b = whole.slice(i, step)
                x = matrix(b.column("vec"))
                d2 = product_sq_l2(x, c)
                row, near = np.nonzero(d2 <= np.partition(d2, most - 1, axis=1)[:, most - 1 : most])
                top = smallest(row, d2[row, near], near, most)
                row, near = row[top], near[top]
                vec = vectors(x[row] - c[near]) if residual else b.column("vec").take(pa.array(row))
                yield batch(block=blocks[near], id=b.column("id").take(pa.array(row)), vec=vec)

    return points.select("id", "vec").mapInArrow(run, "block long, id long, vec array<double>")


def halo(home: DataFrame, centres: DataFrame, fanout: int, direct: int = DIRECT, probes: int = 3, seed: int = 0) -> DataFrame:
    """(leaf_id, id, is_home): home (leaf_id, id, vec) and, for each point, the fanout - 1 nearest other leaves' centroids.

    Up to `direct` centroids are one block that points are compared with. Beyond, they form sqrt(leaves) groups,
    and a point meets the members of its `probes` nearest groups, by an equi-join on the group."""
    first = home.select("leaf_id", "id", F.lit(True).alias("is_home"))
    if fanout < 2:
        return first
    if centres.count() <= direct:
        parts = 4 * home.sparkSession.sparkContext.defaultParallelism
        base = centres.select(every(parts), F.col("leaf_id").alias("id"), "vec")
        asked = home.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("block"), "id", "vec")
    else:
        base = checkpointed(group_centroids(centres, seed), "centroid-groups")
        asked = nearest_groups(home, centroids(base, "block"), probes)
    met = join_blocks(base, asked, nearest_in_block(fanout, False), "id long, nbr long, d2 double")
    others = met.join(home.select("id", "leaf_id"), "id").where("nbr <> leaf_id").select("id", "nbr", "d2")
    near = top_k(others, fanout - 1)
    return first.union(near.select(F.col("nbr").alias("leaf_id"), "id", F.lit(False)))


def partition(points: DataFrame, c_max: int = 2048, fanout: int = 2, seed: int = 0) -> DataFrame:
    """(leaf_id, id, vec, is_home): carved leaves and their halo."""
    home = checkpointed(carve(points, c_max, seed), "leaves")
    if fanout < 2:
        return home.withColumn("is_home", F.lit(True))
    joined = halo(home, centroids(home), fanout, seed=seed)
    return joined.join(points.select("id", "vec"), "id").select("leaf_id", "id", "vec", "is_home")
