"""Approximate nearest neighbours: a forest of random-projection trees, searched through one shared priority queue.

The trees are fitted on a bounded sample; every row is indexed, by its leaf in every tree. A query's walk pops the
most promising node of all trees at once until it has visited its budget of leaves. Queries and vectors meet by
leaf, where candidates are ranked exactly on their original vectors."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as common
from .vectors import best, by_cell, finite, matrix, one_for_each_id, with_parts

#: Rows the trees are fitted on: at least so many, and one of each SAMPLE_SHARE rows while they take at most SAMPLE_BYTES on the driver.
SAMPLE_ROWS, SAMPLE_SHARE, SAMPLE_BYTES = 16_384, 32, 64 << 20
#: Sample rows that are broadcast: those in a query's visited leaves give it a first floor for its k-th best score.
FLOOR_ROWS, FLOOR_BYTES = 16_384, 32 << 20
#: Sample rows for each leaf of a tree, so that cuts are near medians.
ROWS_PER_LEAF = 16
#: Bits of a leaf's number and, with the tree's, of a cell.
LEAF_BITS, CELL_BITS = 24, 32
#: Rows of a leaf that meet in one task; a fuller leaf is dealt out to several.
LEAF_ROWS = 16_384
TREES = 8


def along(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Products of rows, the same for equal rows wherever they lie, as a matrix product's are not."""
    return (x * planes).sum(1)


@dataclass(frozen=True)
class Forest:
    """Complete binary trees: planes (trees, nodes, d) and cuts (trees, nodes), nodes in heap order."""

    planes: np.ndarray
    cuts: np.ndarray
    depth: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Each row's leaf in each tree, (trees, n)."""
        out = np.zeros((len(self.planes), len(x)), np.int64)
        for t in range(len(self.planes)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (along(x, self.planes[t, node]) > self.cuts[t, node])
            out[t] = node - (2**self.depth - 1)
        return out

    def walk(self, margins: np.ndarray, budget: int, sizes: np.ndarray, least: int) -> list[tuple[int, int]]:
        """The (tree, leaf) pairs that a query visits; margins: its signed distances from all planes, (trees, nodes).

        Beyond its budget it goes on until the leaves of one tree (sizes: rows, (trees, leaves)) hold `least` rows."""
        first_leaf = 2**self.depth - 1
        queue = [(-math.inf, t, 0) for t in range(len(self.planes))]
        heapq.heapify(queue)
        visited, held = [], [0] * len(self.planes)
        while queue and (len(visited) < budget or max(held) < least):
            worst, t, node = heapq.heappop(queue)
            if node >= first_leaf:
                visited.append((t, node - first_leaf))
                held[t] += int(sizes[t, node - first_leaf])
                continue
            m = margins[t, node]
            heapq.heappush(queue, (max(worst, m), t, 2 * node + 1))
            heapq.heappush(queue, (max(worst, -m), t, 2 * node + 2))
        return visited


def grow(sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 0) -> Forest:
    """A node's plane is normal to the line between two of its sample rows and cuts them at their median."""
    rng = np.random.default_rng(seed)
    d, nodes = sample.shape[1], 2**depth - 1
    planes, cuts = np.zeros((trees, nodes, d)), np.zeros((trees, nodes))
    for t in range(trees):
        members = {0: np.arange(len(sample))}
        for node in range(nodes):
            own = members.pop(node)
            normal = rng.standard_normal(d)
            if len(own) >= 2:
                a, b = sample[rng.choice(own, 2, replace=False)]
                if not np.array_equal(a, b):
                    normal = a - b
            normal /= np.linalg.norm(normal)
            at = along(sample[own], normal)
            cut = float(np.median(at)) if len(own) else 0.0
            planes[t, node], cuts[t, node] = normal, cut
            members[2 * node + 1], members[2 * node + 2] = own[at <= cut], own[at > cut]
    return Forest(planes, cuts, depth)


def room(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each row of q, above what the rounding of two products with rows of x can change in their order."""
    return 4 * q.shape[1] * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0.0)


def first_copies(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Indices of the rows that fewer than `most` equal rows of smaller ids precede."""
    order = np.lexsort((ids, np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * x.itemsize}").ravel(), return_inverse=True)[1]))
    own = x[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]).any(1)
    first = np.flatnonzero(new)
    return order[np.arange(len(own)) - np.repeat(first, np.diff(first, append=len(own))) < most]


def search(vectors: DataFrame, queries, k: int = 20, trees: int = TREES, leaf_rows: int = 768, effort: float = 0.6, seed: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score: of every query the k largest inner products found among the other vectors.

    vectors has id and vec (finite, not zero); queries is a condition on id. The depth grows with the rows, for
    leaves of about leaf_rows, as far as the bounded sample has ROWS_PER_LEAF rows for each; a query visits
    effort * (all leaves) ^ 0.8 of them, and more where these hold too few rows: it gets k others, or all if there
    are fewer. Ties go to smaller ids. One row stands for each id, null ids take no part; no rows give none.
    A leaf that many equal vectors crowd is dealt out by id, and its queries go to all of its parts."""
    spark = vectors.sparkSession
    kind = vectors.schema["vec"].dataType.simpleString()
    rows, d = one_for_each_id(vectors, "vectors")
    n = rows.count()
    fitted = max(min(max(SAMPLE_ROWS, n // SAMPLE_SHARE), SAMPLE_BYTES // (8 * max(d, 1))), 1)
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(fitted).select("id", "vec").toArrow()
    sample_ids = drawn.column("id").to_numpy()
    sample = matrix(drawn.column("vec").combine_chunks(), d)
    most = int(math.log2(max(len(sample) / ROWS_PER_LEAF, 1)))
    depth = min(max(math.ceil(math.log2(max(n / leaf_rows, 1))), 0), most)
    forest = grow(sample, depth, trees, seed)
    total = trees * 2**depth
    budget = min(total, math.ceil(max(effort * total**0.8, trees)))
    sample_ids, sample = (x[: max(min(FLOOR_ROWS, FLOOR_BYTES // (8 * max(d, 1))), 1)] for x in (sample_ids, sample))
    shared = spark.sparkContext.broadcast((forest, sample_ids, sample, forest.leaves(sample)))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value[0]
        for batch in batches:
            leaf = forest.leaves(matrix(batch.column("vec"), d))
            cell = leaf | (np.arange(len(leaf))[:, None] << LEAF_BITS)
            for t in range(len(leaf)):
                yield pa.RecordBatch.from_arrays([pa.array(cell[t]), batch.column("id"), batch.column("vec")], ["cell", "id", "vec"])

    indexed = rows.select("id", "vec").mapInArrow(cells, f"cell long, id long, vec {kind}")
    only = rows.select("id", "vec").mapInArrow(lambda b: (x.select(["cell"]) for x in cells(b)), "cell long")
    filled = only.groupBy("cell").count().collect()  # at most all leaves of the forest
    asking = rows.where(queries).count()
    shares = max(1, -(-asking * budget // (total * common.QUERY_PART)))  # a leaf is visited by about budget / total of all queries
    parts = {r["cell"]: -(-r["count"] // LEAF_ROWS) for r in filled if r["count"] > LEAF_ROWS}
    sizes = np.zeros((trees, 2**depth), np.int64)
    for r in filled:
        sizes[r["cell"] >> LEAF_BITS, r["cell"] & ((1 << LEAF_BITS) - 1)] = r["count"]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cells(batches):
            cell = batch.column("cell").to_numpy().astype(np.int64)
            part = np.zeros(len(cell), np.int64)
            for c, p in parts.items():
                own = cell == c
                part[own] = batch.column("id").to_numpy()[own] % p
            yield pa.RecordBatch.from_arrays([pa.array(cell | part << CELL_BITS), batch.column("id"), batch.column("vec")], ["cell", "id", "vec"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, ids, sample, leaf_of = shared.value
        for batch in batches:
            own, q = batch.column("id").to_numpy(), matrix(batch.column("vec"), d)
            for i in range(0, len(own), 256):
                part = slice(i, i + 256)
                score = q[part] @ sample.T
                score[own[part][:, None] == ids[None, :]] = -np.inf
                margins = (q[part] @ forest.planes.reshape(-1, d).T if depth else np.zeros((len(q[part]), 0))).reshape(len(q[part]), len(forest.planes), -1) - forest.cuts
                row, cell = [], []
                for r in range(len(q[part])):
                    met = np.zeros(sizes.shape, bool)
                    for t, leaf in forest.walk(margins[r], budget, sizes, min(k + 1, n)):
                        met[t, leaf] = True
                        c = t << LEAF_BITS | leaf
                        for p in range(parts.get(c, 1)):
                            row.append(i + r)
                            cell.append(c | p << CELL_BITS)
                    score[r, ~np.take_along_axis(met, leaf_of, 1).any(0)] = -np.inf  # only what the leaves give again
                floor = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(q[part]), -np.inf)
                floor = floor - room(q[part], sample)
                row = np.array(row, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(cell, np.int64) * shares + own[row] % shares), pa.array(own[row]), batch.column("vec").take(pa.array(row)), pa.array(floor[row - i])], ["cell", "id", "vec", "floor"])

    def rank_leaf(ids, x, query_ids, q, floors):
        some = first_copies(ids, x, k + 1)  # k others and the query itself precede the rest
        ids, x = ids[some], x[some]
        for i in range(0, len(query_ids), 256):
            part = slice(i, i + 256)
            score, spare = q[part] @ x.T, room(q[part], x)
            a, b = np.nonzero((score >= (floors[part] - spare)[:, None]) & (ids[None, :] != query_ids[part][:, None]))
            score = score[a, b]
            top = best(a, score, ids[b], k)
            kth = np.full(len(spare), np.inf)
            np.minimum.at(kth, a[top], score[top])
            near = score >= (kth - spare)[a]  # all that can be among the k best once the products are summed in order
            a, b = a[near], b[near]
            exact = np.zeros(len(a))
            for c in range(d):
                exact += q[part][a, c] * x[b, c]
            top = best(a, exact, ids[b], k)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[part][a[top]]), pa.array(ids[b[top]]), pa.array(exact[top])], ["query_id", "vec_id", "score"])

    placed = rows.select("id", "vec").mapInArrow(dealt, f"cell long, id long, vec {kind}") if parts else indexed
    asked = rows.where(queries).select("id", "vec").mapInArrow(route, f"cell long, id long, vec {kind}, floor double")
    stream = with_parts(placed, shares).select("cell", F.lit(0).alias("role"), "id", "vec", F.lit(0.0).alias("floor")).union(asked.select("cell", F.lit(1).alias("role"), "id", "vec", "floor"))
    found = stream.repartition("cell").sortWithinPartitions("cell", "role").mapInArrow(by_cell(rank_leaf, d, np.float64), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # a pair can meet in several trees
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """search of embeddings by inner product; queries are the rows whose vec_id is divisible by `every`."""
    vec = F.col("embedding")
    rows = embeddings.where(finite(vec) & F.exists(vec, lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("id"), vec.alias("vec"))
    return search(rows, F.col("id") % every == 0, k)
