"""What users call: self-kNN graphs, k-NN joins, and an index that is built once, queried often, saved and loaded."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.vectors import parse_metric
from vecloom.operators import exact, ivf, search, walks
from vecloom.operators.blocks import block_count
from vecloom.operators.candidates import hyperplanes, leaf_pairs, reservoir
from vecloom.operators.graph import robust_prune, symmetrize
from vecloom.operators.partition import partition
from vecloom.plans.params import BuildParams, HnswParams, IvfParams, SearchParams
from vecloom.session import bucketed, bucketed_at, checkpointed, ship
from vecloom.sources.sinks import padded, to_coo
from vecloom.sources.vectors import from_table, validate

#: Self-kNN of at most min(c_max, this) points is exact.
EXACT_ROWS = 2048


def build_graph(points: DataFrame, d: int, params: BuildParams) -> tuple[DataFrame, DataFrame]:
    """(edges (src, dst, d2), not written yet, and candidates (src, dst, code, norm)): leaves of all runs feed one reservoir for each point, which is pruned and made symmetric.

    Shuffles: one by leaf for each run, one by source for the reservoir, one by id for vectors, one by source after the union with reverses."""
    planes = hyperplanes(params.m, d, params.seed)
    pairs = None
    for run in range(params.runs):
        leaves = checkpointed(partition(points, params.c_max, params.fanout, params.seed + 7919 * run), "members")
        own = leaf_pairs(leaves, planes, params.l_max, norm_mode=params.norm_mode)
        pairs = own if pairs is None else pairs.union(own)
    candidates = checkpointed(reservoir(pairs, params.l_max, params.norm_mode), "reservoir")
    pruned = robust_prune(candidates, points, params.alpha, params.r)
    return symmetrize(pruned, points, params.r, d), candidates


def build_shards(points: DataFrame, d: int, params: BuildParams, shards: int) -> tuple[DataFrame, DataFrame]:
    """build_graph for the points of each shard: no edge or candidate leaves one."""
    edges = candidates = None
    for shard in range(shards):
        own = points if shards == 1 else points.where(walks.shard_of(F.col("id"), shards) == shard)
        more, near = build_graph(own, d, params)
        edges, candidates = (more, near) if edges is None else (edges.union(more), candidates.union(near))
    return edges, candidates


@dataclass
class VectorIndex:
    """Points, edges and reservoir candidates, each a DataFrame in the shared folder; points are bucketed by id, edges by src.

    shards: so many graphs, each over the points of a shard, which searches walk one by one; 0: one graph over points of any
    number, walked by joins."""

    points: DataFrame
    edges: DataFrame
    candidates: DataFrame
    n: int
    d: int
    params: BuildParams
    buckets: int
    shards: int = 0

    @classmethod
    def build(cls, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", params: BuildParams | None = None, **options) -> VectorIndex:
        params = params or BuildParams(**options)
        ship(df.sparkSession)
        return cls.of(from_table(df, id_col, vec_col, params.metric), params)

    @classmethod
    def of(cls, points: DataFrame, params: BuildParams) -> VectorIndex:
        """The index of points (id, vec), which are normalised already under cosine."""
        n, d = validate(points)
        buckets = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), block_count(n))
        points = bucketed(points, "points", "id", buckets)
        shards = walks.shard_count(n, d)
        edges, candidates = build_shards(points, d, params, shards)
        return cls(points, bucketed(edges, "edges", "src", buckets), candidates, n, d, params, buckets, shards)

    def _starts(self, queries: DataFrame, beam: int) -> DataFrame:
        """(id, nbr, d2): pivots near each query. Pivots are chosen by the hash order of ids, so ids need not be dense."""
        from vecloom.sources.vectors import subsample

        return search.seeds(queries, subsample(self.points, search.pivot_count(self.n, beam), self.params.seed))

    def _beam(self, queries: DataFrame, start: DataFrame, width: int, many: int | None = None, asked: int | None = None) -> DataFrame:
        """(id, nbr, d2): the `many` nearest of beams (all: None), in each shard; asked: the number of queries, if known."""
        if not self.shards:
            return search.beam_search(self.points, self.edges, queries, start, width, self.d, self.params.r, self.buckets)
        asked = queries.count() if asked is None else asked
        return walks.walk(self.points, self.edges, walks.started(queries, start), asked, width, many or width, self.shards)

    def query(self, df: DataFrame, k: int = 10, beam: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """(id, rank 1..k, nbr, dist) of held-out queries; ValueError where their dimension differs."""
        queries = from_table(df, id_col, vec_col, self.params.metric)
        validate(queries, self.d)
        queries = checkpointed(queries, "queries")  # no table: queries may come as a stream of batches
        walk = lambda some, width, asked: self._beam(some, self._starts(some, beam), width, k, asked)
        return search.shown(search.widened(walk, self.points, queries, self.n, min(k, self.n), max(beam, k), False), k, self.params.metric)

    def self_knn(self, k: int = 15, params: SearchParams | None = None) -> DataFrame:
        """(id, rank 0..k, nbr, dist) by the strategy of params; auto is beam."""
        params = params or SearchParams()
        way = "beam" if params.strategy == "auto" else params.strategy
        if way == "exact":
            return exact.self_knn(self.points, self.n, k, self.params.metric)
        if way == "reservoir":
            edges, candidates = self.edges, self.candidates
            if self.shards > 1:  # nothing walks here: candidates come from all points
                edges, candidates = build_graph(self.points, self.d, self.params)
            return search.reservoir_knn(candidates, edges, self.points, k, self.params.metric, params.refine, self.d)
        start = self.points.select("id", F.col("id").alias("nbr"))
        if way == "warm":
            start = start.union(self.candidates.select(F.col("src").alias("id"), F.col("dst").alias("nbr")).where("id <> nbr"))
        if not self.shards:
            start = search.score(start, self.points, self.d)
        mine = lambda some: start.join(F.broadcast(some.select("id")), "id", "left_semi")
        walk = lambda some, width, asked: self._beam(some, start if some is self.points else mine(some), width, k + 1, asked)
        found = search.widened(walk, self.points, self.points, self.n, min(k, self.n - 1), max(params.beam, k + 1), True)
        return exact.with_self(exact.top_k(found.where("id <> nbr"), k), self.points, self.params.metric)

    def save(self, path: str) -> None:
        """Points, edges and candidates as Parquet, the first two in buckets, parameters as one line of JSON text. What stood at path before goes."""
        spark = self.points.sparkSession
        for name, key in (("points", "id"), ("edges", "src")):
            bucketed(getattr(self, name), name, key, self.buckets, f"{path}/{name}", "overwrite")
        self.candidates.write.mode("overwrite").parquet(f"{path}/candidates")
        line = json.dumps(asdict(self.params) | {"n": self.n, "d": self.d, "buckets": self.buckets, "shards": self.shards})
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        own = json.loads(ship(spark).read.text(f"{path}/params").first()["value"])
        n, d, buckets, shards = own.pop("n"), own.pop("d"), own.pop("buckets"), own.pop("shards", 0)
        points, edges = (bucketed_at(spark, f"{path}/{name}", name, key, buckets) for name, key in (("points", "id"), ("edges", "src")))
        return cls(points, edges, spark.read.parquet(f"{path}/candidates"), n, d, BuildParams(**own), buckets, shards)


def self_knn(df: DataFrame, k: int = 15, id_col: str = "vec_id", vec_col: str = "embedding", params: BuildParams | None = None, search_params: SearchParams | None = None, hnsw_params: HnswParams | None = None, ivf_params: IvfParams | None = None) -> DataFrame:
    """(id, rank, nbr, dist): each vector itself at rank 0 and its k nearest others; k is held to n - 1.

    Small inputs (at most min(c_max, 2048) rows) are answered exactly, larger ones by a graph, unless the strategy
    says otherwise: exact, beam, warm, reservoir, hnsw, or ivf."""
    params, search_params = params or BuildParams(), search_params or SearchParams()
    ship(df.sparkSession)
    points = from_table(df, id_col, vec_col, params.metric)
    n, d = validate(points)
    k = min(k, n - 1)
    way = search_params.strategy
    if way == "exact" or way == "auto" and n <= min(params.c_max, EXACT_ROWS):
        return exact.self_knn(points, n, k, params.metric)
    if way == "hnsw":
        from vecloom.plans import layered

        return layered.self_knn(points, k, hnsw_params or HnswParams(), params)
    if way == "ivf":
        i = ivf_params or IvfParams()
        return ivf.self_knn(points, n, d, k, params.metric, i.lists(n), i.nprobe, i.pq_m, seed=params.seed)
    return VectorIndex.build(df, id_col, vec_col, params).self_knn(k, search_params)


def knn_join(base: DataFrame, queries: DataFrame, k: int = 15, id_col: str = "vec_id", vec_col: str = "embedding", params: BuildParams | None = None, beam: int = 64, strategy: str = "graph") -> DataFrame:
    """(id, rank 1..k, nbr, dist): for each query its nearest base vectors, through a graph or exactly."""
    params = params or BuildParams()
    if strategy == "exact":
        ship(base.sparkSession)
        b, q = from_table(base, id_col, vec_col, params.metric), from_table(queries, id_col, vec_col, params.metric)
        n, d = validate(b)
        validate(q, d)
        return exact.query_knn(b, q, n, min(k, n), params.metric)
    return VectorIndex.build(base, id_col, vec_col, params).query(queries, k, beam, id_col, vec_col)


class _KnnParams(Params):
    idCol = Param(Params._dummy(), "idCol", "id column", TypeConverters.toString)
    vecCol = Param(Params._dummy(), "vecCol", "vector column", TypeConverters.toString)
    nNeighbors = Param(Params._dummy(), "nNeighbors", "neighbours besides the point itself", TypeConverters.toInt)
    metric = Param(Params._dummy(), "metric", "euclidean or cosine", TypeConverters.toString)
    strategy = Param(Params._dummy(), "strategy", "auto, exact, beam, warm, reservoir, hnsw or ivf", TypeConverters.toString)
    cMax = Param(Params._dummy(), "cMax", "rows of a leaf", TypeConverters.toInt)
    beam = Param(Params._dummy(), "beam", "candidates a search keeps", TypeConverters.toInt)
    runs = Param(Params._dummy(), "runs", "partitionings", TypeConverters.toInt)
    randomState = Param(Params._dummy(), "randomState", "seed", TypeConverters.toInt)


class KnnGraph(Estimator, _KnnParams, DefaultParamsWritable, DefaultParamsReadable):
    """fit(df) gives a model whose transform returns the graph of the fitted rows in coordinate form (row, col, value, rank)."""

    @keyword_only
    def __init__(self, *, idCol="vec_id", vecCol="embedding", nNeighbors=15, metric="euclidean", strategy="auto", cMax=2048, beam=64, runs=1, randomState=0):
        super().__init__()
        self._setDefault(idCol="vec_id", vecCol="embedding", nNeighbors=15, metric="euclidean", strategy="auto", cMax=2048, beam=64, runs=1, randomState=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> KnnGraphModel:
        get = lambda name: self.getOrDefault(name)
        n = dataset.count()
        if get("nNeighbors") >= n:
            raise ValueError(f"n_neighbors ({get('nNeighbors')}) must be below the number of rows ({n})")
        return self._copyValues(KnnGraphModel(checkpointed(to_coo(self._found(dataset, get)), "graph")))

    def _found(self, dataset: DataFrame, get) -> DataFrame:
        params = BuildParams(metric=parse_metric(get("metric")), c_max=get("cMax"), runs=get("runs"), seed=get("randomState"))
        return self_knn(dataset, get("nNeighbors"), get("idCol"), get("vecCol"), params, SearchParams(beam=get("beam"), strategy=get("strategy")))


class KnnGraphModel(Model, _KnnParams, MLWritable, MLReadable):
    """The graph of the fitted rows; save and load write and read it with its parameters."""

    def __init__(self, graph: DataFrame | None = None):
        super().__init__()
        self.graph = graph

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """(row, col, value, rank) of the fitted rows that dataset has, by its id column: all of them for the fitted table itself, none for rows not fitted."""
        asked = dataset.select(F.col(self.getOrDefault("idCol")).cast("long").alias("row")).distinct()
        return self.graph.join(asked, "row", "left_semi").select("row", "col", "value", "rank")

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, model: KnnGraphModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.graph.write.parquet(f"{path}/graph")


class _ModelReader(MLReader):
    def load(self, path: str) -> KnnGraphModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = KnnGraphModel(self.sparkSession.read.parquet(f"{path}/graph"))
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def knn_join_array(spark: SparkSession, x, queries, k: int = 15, beam: int = 64, strategy: str = "graph", **options) -> tuple[np.ndarray, np.ndarray]:
    """(queries, k) arrays of positions in x and distances; short rows are filled with their last neighbour."""
    base, asked = (spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(np.ascontiguousarray(a, np.float32))], "vec_id long, embedding array<float>") for a in (x, queries))
    rows = padded(knn_join(base, asked, k, params=BuildParams(**options), beam=beam, strategy=strategy), min(k, len(x)), False).toPandas().sort_values(["id", "rank"])
    return rows["nbr"].to_numpy().reshape(len(queries), -1), rows["dist"].to_numpy().reshape(len(queries), -1)


def self_knn_array(spark: SparkSession, x, k: int = 15, **options) -> tuple[np.ndarray, np.ndarray]:
    """(n, k + 1) arrays of positions and distances of an array that the driver holds; k is held to n - 1."""
    x = np.ascontiguousarray(x, np.float32)
    if x.ndim != 2 or not len(x):
        raise ValueError("a non-empty two-dimensional array is needed")
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    strategy = options.pop("strategy", "auto")
    rows = self_knn(df, k, params=BuildParams(**options), search_params=SearchParams(strategy=strategy)).toPandas().sort_values(["id", "rank"])
    return rows["nbr"].to_numpy().reshape(len(x), -1), rows["dist"].to_numpy().reshape(len(x), -1)
