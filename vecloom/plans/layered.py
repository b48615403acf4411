"""Layered graphs: every layer is a graph over some of the points of the layer below, and a search descends through them by joins.

A point's highest layer follows the geometric law of hierarchical small worlds, from the hash of its id, so a layer
has about 1 / m of the points below it. Each layer is built as any graph here is (leaves, reservoirs, pruning, reverse
edges), all points at once, not point by point; a search begins at the nearest of the top layer's few points, walks
each layer with a narrow beam, and the lowest with a wide one."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.operators import exact, quantize, search
from vecloom.plans.index import VectorIndex
from vecloom.plans.params import BuildParams, HnswParams
from vecloom.session import checkpointed
from vecloom.sources.vectors import hash_order

#: Fixed value: the highest layer.
TOP_LAYER = 24
#: A layer of at most so many points is the top: queries meet all of them.
ENTRY_POINTS = 64


def layer_of(id_col: Column, m: int, seed: int = 0) -> Column:
    """floor(-ln(u) / ln(m)), at most TOP_LAYER, u from the hash of the id in (0, 1]."""
    u = (hash_order(id_col, seed + 977) + 1) / float(1 << 32)
    return F.least(F.lit(TOP_LAYER), F.floor(-F.log(u) / math.log(max(m, 2)))).cast("int")


@dataclass
class LayeredGraph:
    """layers: an index of each layer, the one of all points first; top: the points of the layer above them, at most ENTRY_POINTS unless no layer is so small; n: all points."""

    layers: list[VectorIndex]
    top: DataFrame
    params: HnswParams

    @classmethod
    def build(cls, points: DataFrame, params: HnswParams, build: BuildParams) -> LayeredGraph:
        """points (id, vec): the graph's degrees are 2 m in the lowest layer and m above, its candidates ef_construction at most, pruned without slack."""
        m = params.m
        own = build.with_(metric="euclidean", alpha=1.0, l_max=min(max(params.ef_construction, m), 4 * build.l_max))
        layers: list[VectorIndex] = []
        level, rest = 0, points
        while True:
            layers.append(VectorIndex.of(rest, own.with_(r=m if level else 2 * m)))
            level += 1
            upper = layers[-1].points.where(layer_of(F.col("id"), m, build.seed) >= level)
            n = upper.count()
            if n <= ENTRY_POINTS or level == TOP_LAYER:
                top = upper if n else layers[-1].points.orderBy("id").limit(1)
                return cls(layers, top, params)
            rest = upper

    def search(self, queries: DataFrame, width: int, many: int | None = None, asked: int | None = None) -> DataFrame:
        """(id, nbr, d2) of queries (id, vec): of each its `many` nearest (all: None) of beams of the lowest layer, in each shard."""
        found = search.seeds(queries, self.top, self.params.m)
        for index in reversed(self.layers[1:]):
            found = exact.top_k(index._beam(queries, found.select("id", "nbr", "d2"), self.params.m, asked=asked), self.params.m)
        return self.layers[0]._beam(queries, found.select("id", "nbr", "d2"), width, many, asked)

    def found(self, queries: DataFrame, k: int, width: int, skip_self: bool, many: int | None = None) -> DataFrame:
        """(id, nbr, d2): the search's `many` nearest (all: None), by beams as wide as the recall of a sample asks for."""
        base = self.layers[0]
        most = min(k, base.n - 1 if skip_self else base.n)
        walk = lambda some, width, asked: self.search(some, width, many, asked)
        return search.widened(walk, base.points, queries, base.n, most, width, skip_self)

    def query(self, queries: DataFrame, k: int) -> DataFrame:
        """(id, rank 1..k, nbr, d2) of held-out queries (id, vec)."""
        return exact.top_k(self.found(checkpointed(queries, "queries"), k, max(self.params.ef_search, k), False, k), k)


def self_knn(points: DataFrame, k: int, params: HnswParams, build: BuildParams) -> DataFrame:
    """(id, rank 0..k, nbr, dist). Under sq8 the graph is built and walked on codes' values, and what it finds is ranked by the vectors."""
    coarse = points
    if params.quantize == "sq8":
        spans = quantize.ranges(points)
        coarse = quantize.decoded(quantize.encode(points, spans), spans)
    graph = LayeredGraph.build(coarse, params, build)
    found = graph.found(graph.layers[0].points, k, max(params.ef_search, k + 1), True, None if coarse is not points else k + 1).where("id <> nbr")
    if params.quantize == "sq8":
        found = search.score(found.select("id", "nbr"), points, graph.layers[0].d)
    return exact.with_self(exact.top_k(found, k), points, build.metric)
