"""One query for each operator over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.operators import candidates as C
from vecloom.operators import evaluate as E
from vecloom.operators import communities, descent, exact, fuzzy, graph, ivf, partition, preprocess, quantize, search
from vecloom.plans import index as I
from vecloom.plans.params import BuildParams, HnswParams, IvfParams, SearchParams
from vecloom.session import checkpointed
from vecloom.sources import sinks
from vecloom.sources import vectors as S

DIMENSIONS, PLANES, SEED, K = 64, 12, 0, 15
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_R = lambda c, n=6: F.round(c, n)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _points(spark: SparkSession, sf_dir: str, metric: str = "euclidean") -> DataFrame:
    return S.from_table(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), metric=metric)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _knn(knn: DataFrame) -> DataFrame:
    return knn.select("id", "rank", "nbr", _R(F.col("dist")).alias("dist"))


# ---- SQL pieces ------------------------------------------------------------------------------------

_E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
_D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _d2(a: str, b: str) -> str:
    return _D2.format(a=a, b=b)


def _self_knn_sql(points: str, k: int, shown: str) -> str:
    return f"""WITH {points},
p AS (SELECT a.id, b.id AS nbr, {_d2("a.v", "b.v")} AS d2 FROM e a JOIN e b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, nbr) AS rank FROM p)
SELECT id, 0::BIGINT AS rank, id AS nbr, 0.0::DOUBLE AS dist FROM e
UNION ALL SELECT id, rank::BIGINT, nbr, round({shown}, 6) FROM r WHERE rank <= {k}"""


_SCALED = """s AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 7)) AS w FROM embeddings),
e AS (SELECT id, list_transform(w, lambda x: x / sqrt(list_sum(list_transform(w, lambda y: y * y)))) AS v FROM s)"""
_PLANE_LIST = "[" + ", ".join("[" + ", ".join(repr(float(x)) for x in row) + "]" for row in C.hyperplanes(PLANES, DIMENSIONS, SEED)) + "]"
_H = f"h AS (SELECT j::BIGINT AS j, {_PLANE_LIST}[j + 1] AS w FROM range({PLANES}) t(j))"
_SK = "sk AS (SELECT e.id, h.j, list_sum(list_transform(list_zip(e.v, h.w), lambda p: p[1] * p[2])) AS s FROM e, h)"
_HASH = "(({x} % 2147483648) * 2654435761 + ({x} >> 31) * 668265261 + {seed}) % 4294967296"


def _hash(x: str, seed: int) -> str:
    return _HASH.format(x=x, seed=seed)


def _leaf_pairs_sql(cap: int, leaf: str = "id % 8", name: str = "lp") -> str:
    return f"""{name} AS (SELECT src, dst, d2 FROM (SELECT a.id AS src, b.id AS dst, {_d2("a.v", "b.v")} AS d2,
row_number() OVER (PARTITION BY a.id ORDER BY {_d2("a.v", "b.v")}, b.id) AS rn
FROM e a JOIN e b ON a.{leaf} = b.{leaf} AND a.id <> b.id) WHERE rn <= {cap})"""


_BF16 = "CASE WHEN {x} = 0 THEN {x} ELSE round_even({x} / pow(2, floor(log2({x})) - 7), 0) * pow(2, floor(log2({x})) - 7) END"


# ---- sources, functions ----------------------------------------------------------------------------


@query(_self_knn_sql(_E, K, "sqrt(d2)"))
def exact_self_knn_l2(spark, sf_dir):
    return _knn(I.self_knn(_raw(spark, sf_dir), K, search_params=SearchParams(strategy="exact")))


@query(_self_knn_sql(_SCALED, K, "d2 / 2"))
def exact_self_knn_cosine(spark, sf_dir):
    scaled = _raw(spark, sf_dir).withColumn("embedding", F.transform(V.as_doubles(F.col("embedding")), lambda x: x * (1 + F.col("vec_id") % 7)))
    return _knn(I.self_knn(scaled, K, params=BuildParams(metric="cosine"), search_params=SearchParams(strategy="exact")))


@query(f"""WITH {_E}, r AS (SELECT q.id, b.id AS nbr, {_d2("q.v", "b.v")} AS d2,
row_number() OVER (PARTITION BY q.id ORDER BY {_d2("q.v", "b.v")}, b.id) AS rank
FROM e q JOIN e b ON q.id % 10 = 0 AND b.id % 10 <> 0)
SELECT id, rank::BIGINT AS rank, nbr, round(sqrt(d2), 6) AS dist FROM r WHERE rank <= 10""")
def exact_query_knn(spark, sf_dir):
    rows = _raw(spark, sf_dir)
    return _knn(I.knn_join(rows.where("vec_id % 10 <> 0"), rows.where("vec_id % 10 = 0"), 10, strategy="exact"))


@query(f"WITH {_E} SELECT id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS sq_norm FROM e")
def row_norms(spark, sf_dir):
    return _points(spark, sf_dir).select("id", _R(V.sq_norm(F.col("vec"))).alias("sq_norm"))


@query(f"WITH {_SCALED} SELECT id, (t.pos - 1)::BIGINT AS pos, round(v[t.pos], 6) AS x FROM e, range(1, {DIMENSIONS + 1}) t(pos)")
def normalized_vectors(spark, sf_dir):
    scaled = _points(spark, sf_dir).select("id", F.transform("vec", lambda x: x * (1 + F.col("id") % 7)).alias("vec"))
    return scaled.select("id", F.posexplode(V.normalize(F.col("vec"))).alias("pos", "x")).select("id", F.col("pos").cast("long"), _R(F.col("x")).alias("x"))


@query("""SELECT count(*) AS n, count(*) FILTER (embedding IS NULL) AS n_null, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim,
count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0) AS n_bad FROM embeddings""")
def input_profile(spark, sf_dir):
    return S.profile(_points(spark, sf_dir))


@query(f"WITH {_E} SELECT id FROM e ORDER BY {_hash('id', 5)}, id LIMIT 100")
def hash_subsample(spark, sf_dir):
    return S.subsample(_points(spark, sf_dir), 100, 5).select("id")


@query(f"""WITH {_E}, p AS (SELECT a.id, b.id AS nbr, a.v AS x, b.v AS y FROM e a JOIN e b ON b.id = a.id + 1)
SELECT id, round({_d2("x", "y")}, 6) AS d2, round(list_sum(list_transform(list_zip(x, y), lambda p: p[1] * p[2])), 6) AS dot,
round(sqrt({_d2("x", "y")}), 6) AS l2, round({_d2("x", "y")} / 2, 6) AS cosine FROM p""")
def pair_distances(spark, sf_dir):
    p = _points(spark, sf_dir)
    q = p.select((F.col("id") - 1).alias("id"), F.col("vec").alias("y"))
    d2 = V.sq_l2(F.col("vec"), F.col("y"), DIMENSIONS)
    return p.join(q, "id").select(
        "id", _R(d2).alias("d2"), _R(V.dot(F.col("vec"), F.col("y"), DIMENSIONS)).alias("dot"),
        _R(V.emit(d2, "euclidean")).alias("l2"), _R(V.emit(d2, "cosine")).alias("cosine"),
    )


@query(f"SELECT l_orderkey AS id, l_linenumber::BIGINT AS line, {_BF16.format(x='l_extendedprice')} AS rounded FROM lineitem")
def bf16_rounding(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("line"), V.bf16(F.col("l_extendedprice")).alias("rounded"))


# ---- partitioning ------------------------------------------------------------------------------------


@query(f"""WITH {_E}, m AS (SELECT list(x ORDER BY pos) AS c FROM (SELECT t.pos, avg(v[t.pos]) AS x FROM e, range(1, {DIMENSIONS + 1}) t(pos) GROUP BY t.pos)),
d AS (SELECT id, {_d2("v", "c")} AS d2 FROM e, m) SELECT id, round(d2, 6) AS d2 FROM d ORDER BY d2, id LIMIT 1""")
def medoid(spark, sf_dir):
    return graph.medoid(_points(spark, sf_dir), DIMENSIONS).select("id", _R(F.col("d2")).alias("d2"))


_LEADERS = f"l AS (SELECT id AS lid, v AS lv, row_number() OVER (ORDER BY {_hash('id', 3)}, id) AS place FROM e QUALIFY place <= least(64, greatest(2, (SELECT count(*) FROM e) * 2 // 64)))"
_ASSIGN = f"""a AS (SELECT id, lid AS leaf_id, v FROM (SELECT e.id, e.v, lid, row_number() OVER (PARTITION BY e.id ORDER BY {_d2("e.v", "lv")}, place) AS rn FROM e, l) WHERE rn = 1)"""


def _led(spark, sf_dir) -> DataFrame:
    points = _points(spark, sf_dir).withColumn("node", F.lit(0).cast("long"))
    lead = partition.leaders(points, 64, 3)
    placed = partition.assign(points, lead)
    return placed.join(lead.select("place", F.col("id").alias("leaf_id")), "place").select("leaf_id", "id", "vec")


@query(f"WITH {_E}, {_LEADERS}, {_ASSIGN} SELECT id, leaf_id FROM a")
def leader_assignment(spark, sf_dir):
    return _led(spark, sf_dir).select("id", "leaf_id")


@query(f"WITH {_E}, {_LEADERS}, {_ASSIGN} SELECT leaf_id, (t.pos - 1)::BIGINT AS pos, round(avg(v[t.pos]), 6) AS x FROM a, range(1, {DIMENSIONS + 1}) t(pos) GROUP BY ALL")
def leaf_centroids(spark, sf_dir):
    at = partition.centroids(_led(spark, sf_dir)).select("leaf_id", F.posexplode("vec").alias("pos", "x"))
    return at.select("leaf_id", F.col("pos").cast("long"), _R(F.col("x")).alias("x"))


def _leaf_sizes(leaves: DataFrame) -> DataFrame:
    return leaves.join(leaves.groupBy("leaf_id").agg(F.count(F.lit(1)).alias("size")), "leaf_id").select("id", "size")


@query("SELECT vec_id AS id, 1::BIGINT AS homes, true AS fits FROM embeddings")
def carve_leaves(spark, sf_dir):
    sizes = _leaf_sizes(partition.carve(_points(spark, sf_dir), 48, 1))
    return sizes.groupBy("id").agg(F.count(F.lit(1)).alias("homes"), (F.max("size") <= 48).alias("fits"))


@query(f"""WITH w AS (SELECT vec_id * 8589934592 AS id FROM embeddings), r AS (SELECT id, (row_number() OVER (ORDER BY {_hash('id', 3)}, id) - 1) // 48 AS leaf FROM w)
SELECT id, count(*) OVER (PARTITION BY leaf) AS size FROM r""")
def carve_equal_points(spark, sf_dir):
    """Equal vectors, ids as monotonically_increasing_id makes them: the first level's one child is cut up by hash."""
    wide = _points(spark, sf_dir).select(F.shiftleft("id", 33).alias("id"), F.array(F.lit(1.0), F.lit(2.0)).alias("vec"))
    return _leaf_sizes(partition.carve(wide, 48, 1))


@query(f"""WITH {_E} SELECT id, ((row_number() OVER (ORDER BY {_hash('id', 2)}, id) - 1) // 50)::BIGINT AS chunk FROM e""")
def degenerate_chunks(spark, sf_dir):
    points = _points(spark, sf_dir).withColumn("node", F.lit(0).cast("long"))
    sizes = points.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    return partition.chunk(points, sizes, 50, 1).select("id", F.col("place").alias("chunk"))


def _homes(spark, sf_dir, leaves: int) -> DataFrame:
    return _points(spark, sf_dir).select((F.col("id") % leaves).alias("leaf_id"), "id", "vec")


def _centres_sql(leaves: int) -> str:
    return f"""c AS (SELECT leaf_id, list(x ORDER BY pos) AS c FROM (SELECT id % {leaves} AS leaf_id, t.pos, avg(v[t.pos]) AS x FROM e, range(1, {DIMENSIONS + 1}) t(pos) GROUP BY ALL) GROUP BY leaf_id)"""


@query(f"""WITH {_E}, {_centres_sql(10)}, r AS (SELECT e.id, c.leaf_id, row_number() OVER (PARTITION BY e.id ORDER BY {_d2("v", "c")}, c.leaf_id) AS rn
FROM e JOIN c ON c.leaf_id <> e.id % 10)
SELECT id % 10 AS leaf_id, id, true AS is_home FROM e UNION ALL SELECT leaf_id, id, false FROM r WHERE rn <= 2""")
def halo_assignment(spark, sf_dir):
    home = _homes(spark, sf_dir, 10)
    return partition.halo(home, partition.centroids(home), 3)


@query(f"""WITH {_E}, {_centres_sql(30)},
hd AS (SELECT leaf_id, c AS hc, row_number() OVER (ORDER BY {_hash('leaf_id', 0)}, leaf_id) - 1 AS place FROM c QUALIFY place < 5),
g AS (SELECT leaf_id, c, block FROM (SELECT c.leaf_id, c.c, place AS block, row_number() OVER (PARTITION BY c.leaf_id ORDER BY {_d2("c.c", "hc")}, place) AS rn FROM c, hd) WHERE rn = 1),
gc AS (SELECT block, list(x ORDER BY pos) AS gc FROM (SELECT block, t.pos, avg(c[t.pos]) AS x FROM g, range(1, {DIMENSIONS + 1}) t(pos) GROUP BY ALL) GROUP BY block),
near AS (SELECT id, v, block FROM (SELECT e.id, e.v, gc.block, row_number() OVER (PARTITION BY e.id ORDER BY {_d2("v", "gc")}, gc.block) AS rn FROM e, gc) WHERE rn <= 3),
r AS (SELECT n.id, g.leaf_id, row_number() OVER (PARTITION BY n.id ORDER BY {_d2("n.v", "g.c")}, g.leaf_id) AS rn FROM near n JOIN g ON n.block = g.block AND g.leaf_id <> n.id % 30)
SELECT id % 30 AS leaf_id, id, true AS is_home FROM e UNION ALL SELECT leaf_id, id, false FROM r WHERE rn <= 1""")
def halo_routed(spark, sf_dir):
    home = _homes(spark, sf_dir, 30)
    return partition.halo(home, partition.centroids(home), 2, direct=0)


# ---- candidates and graph ------------------------------------------------------------------------


@query(f"WITH {_E}, {_H}, {_SK} SELECT id, j, round(s, 6) AS s FROM sk")
def lsh_sketch(spark, sf_dir):
    rows = C.sketch(_points(spark, sf_dir), C.hyperplanes(PLANES, DIMENSIONS, SEED))
    return rows.select("id", F.posexplode("sketch").alias("j", "s")).select("id", F.col("j").cast("long"), _R(F.col("s")).alias("s"))


@query(f"""WITH {_E}, {_H}, {_SK} SELECT a.id, b.id AS nbr, sum(CASE WHEN b.s - a.s >= 0 THEN pow(2, a.j) ELSE 0 END)::BIGINT AS code
FROM sk a JOIN sk b ON b.id = a.id + 1 AND a.j = b.j GROUP BY a.id, b.id""")
def residual_codes(spark, sf_dir):
    s = C.sketch(_points(spark, sf_dir), C.hyperplanes(PLANES, DIMENSIONS, SEED)).select("id", "sketch")
    t = s.select((F.col("id") - 1).alias("id"), F.col("id").alias("nbr"), F.col("sketch").alias("to"))
    return s.join(t, "id").select("id", "nbr", C.residual_code(F.col("sketch"), F.col("to"), PLANES).cast("long").alias("code"))


def _pairs(spark, sf_dir, cap: int, leaf: int = 8, keep_codes: bool = False, norm_mode: str = "exact") -> DataFrame:
    leaves = _points(spark, sf_dir).withColumn("leaf_id", F.col("id") % leaf)
    return C.leaf_pairs(leaves, C.hyperplanes(PLANES, DIMENSIONS, SEED), cap, keep_codes, norm_mode)


@query(f"WITH {_E}, {_leaf_pairs_sql(10)} SELECT src, dst, round(d2, 6) AS norm FROM lp")
def leaf_all_pairs_topk(spark, sf_dir):
    return _pairs(spark, sf_dir, 10).select("src", "dst", _R(F.col("norm")).alias("norm"))


def _reservoir_sql(parts: str, cap: int, norm: str) -> str:
    return f"""cd AS (SELECT DISTINCT src, dst, d2 FROM ({parts})),
cc AS (SELECT src, dst, any_value(d2) AS d2, sum(CASE WHEN b.s - a.s >= 0 THEN pow(2, a.j) ELSE 0 END)::BIGINT AS code
FROM cd JOIN sk a ON a.id = src JOIN sk b ON b.id = dst AND a.j = b.j GROUP BY src, dst),
nn AS (SELECT src, dst, code, {norm} AS norm FROM cc),
pc AS (SELECT *, row_number() OVER (PARTITION BY src, code ORDER BY norm, dst) AS rn FROM nn),
rs AS (SELECT src, dst, code, norm FROM pc WHERE rn = 1 QUALIFY row_number() OVER (PARTITION BY src ORDER BY norm, dst) <= {cap})"""


@query(f"WITH {_E}, {_H}, {_SK}, {_leaf_pairs_sql(40)}, {_reservoir_sql('SELECT * FROM lp', 12, _BF16.format(x='d2'))} SELECT src, dst, code, norm FROM rs")
def hashprune_reservoir(spark, sf_dir):
    return C.reservoir(_pairs(spark, sf_dir, 40, keep_codes=True, norm_mode="bf16"), 12).select("src", "dst", F.col("code").cast("long"), "norm")


@query(f"""WITH {_E}, {_H}, {_SK}, {_leaf_pairs_sql(20)}, {_leaf_pairs_sql(20, "id % 5", "lq")},
{_reservoir_sql('SELECT * FROM lp UNION ALL SELECT * FROM lq', 16, 'd2')} SELECT src, dst, code, round(norm, 6) AS norm FROM rs""")
def multi_run_candidates(spark, sf_dir):
    both = _pairs(spark, sf_dir, 20, 8, True).union(_pairs(spark, sf_dir, 20, 5, True))
    return C.reservoir(both, 16, "exact").select("src", "dst", F.col("code").cast("long"), _R(F.col("norm")).alias("norm"))


def _prune_sql(alpha: float, r: int) -> str:
    return f"""WITH {_E}, {_leaf_pairs_sql(24, "id % 4")},
cs AS (SELECT src, list([{{'id': dst, 'd2': d2, 'v': e.v}}] ORDER BY d2, dst) AS c FROM lp JOIN e ON e.id = dst GROUP BY src),
kp AS (SELECT src, list_reduce(c, lambda acc, z: CASE WHEN len(acc) < {r} AND
len(list_filter(acc, lambda y: {alpha * alpha} * {_d2("y.v", "z[1].v")} < z[1].d2)) = 0 THEN list_concat(acc, z) ELSE acc END) AS k FROM cs)
SELECT src, u.id AS dst, round(u.d2, 6) AS norm FROM (SELECT src, unnest(k) AS u FROM kp)"""


def _pruned(spark, sf_dir, alpha: float, r: int) -> DataFrame:
    pairs = _pairs(spark, sf_dir, 24, 4).select("src", "dst", "norm")
    return graph.robust_prune(pairs, _points(spark, sf_dir), alpha, r).select("src", "dst", _R(F.col("norm")).alias("norm"))


@query(_prune_sql(1.0, 16))
def robust_prune_tight(spark, sf_dir):
    return _pruned(spark, sf_dir, 1.0, 16)


@query(_prune_sql(1.2, 16))
def robust_prune_default(spark, sf_dir):
    return _pruned(spark, sf_dir, 1.2, 16)


def _edges_sql(r: int) -> str:
    return f"""bo AS (SELECT src, dst FROM lp UNION SELECT dst, src FROM lp),
ed AS (SELECT src, dst, d2 FROM (SELECT bo.src, bo.dst, {_d2("a.v", "b.v")} AS d2, row_number() OVER (PARTITION BY bo.src ORDER BY {_d2("a.v", "b.v")}, bo.dst) AS rn
FROM bo JOIN e a ON a.id = bo.src JOIN e b ON b.id = bo.dst WHERE bo.src <> bo.dst) WHERE rn <= {r})"""


def _edges(spark, sf_dir, cap: int = 10, r: int = 12) -> DataFrame:
    return graph.symmetrize(_pairs(spark, sf_dir, cap), _points(spark, sf_dir), r, DIMENSIONS)


@query(f"WITH {_E}, {_leaf_pairs_sql(10)}, {_edges_sql(12)} SELECT src, dst, round(d2, 6) AS d2 FROM ed")
def symmetrized_graph(spark, sf_dir):
    return _edges(spark, sf_dir).select("src", "dst", _R(F.col("d2")).alias("d2"))


@query(f"""WITH {_E}, {_leaf_pairs_sql(10)}, {_edges_sql(12)}
SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM ed UNION ALL SELECT dst, 0, 1 FROM ed) GROUP BY id""")
def graph_degrees(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


# ---- search ----------------------------------------------------------------------------------------


def _scored_sql(pairs: str, k: int) -> str:
    return f"""sc AS (SELECT p.id, p.nbr, {_d2("a.v", "b.v")} AS d2 FROM ({pairs}) p JOIN e a ON a.id = p.id JOIN e b ON b.id = p.nbr),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, nbr) AS rank FROM sc)
SELECT id, 0::BIGINT AS rank, id AS nbr, 0.0::DOUBLE AS dist FROM e UNION ALL SELECT id, rank::BIGINT, nbr, round(sqrt(d2), 6) FROM rk WHERE rank <= {k}"""


@query(f"WITH {_E}, {_leaf_pairs_sql(10)}, {_scored_sql('SELECT src AS id, dst AS nbr FROM lp', 8)}")
def reservoir_knn(spark, sf_dir):
    p = _points(spark, sf_dir)
    return _knn(search.reservoir_knn(_pairs(spark, sf_dir, 10), _edges(spark, sf_dir), p, 8, refine=False, d=DIMENSIONS))


_EXPAND = """SELECT src AS id, dst AS nbr FROM lp UNION SELECT src, dst FROM ed UNION
SELECT f.src, ed.dst FROM (SELECT src, dst FROM lp QUALIFY row_number() OVER (PARTITION BY src ORDER BY d2, dst) <= 6) f JOIN ed ON ed.src = f.dst WHERE f.src <> ed.dst"""


@query(f"WITH {_E}, {_leaf_pairs_sql(10)}, {_edges_sql(12)}, {_scored_sql(_EXPAND, 8)}")
def reservoir_knn_refined(spark, sf_dir):
    p = _points(spark, sf_dir)
    return _knn(search.reservoir_knn(_pairs(spark, sf_dir, 10), _edges(spark, sf_dir), p, 8, refine=True, d=DIMENSIONS))


@query(f"""WITH {_E}, n AS (SELECT count(*) AS n, least(greatest(floor(4 * sqrt(count(*)))::BIGINT, 64), 2048, count(*)) AS m FROM e),
pv AS (SELECT id, v FROM e, n WHERE id % greatest(1, n // m) = 0 AND id < greatest(1, n // m) * m),
r AS (SELECT q.id, p.id AS nbr, row_number() OVER (PARTITION BY q.id ORDER BY {_d2("q.v", "p.v")}, p.id) AS rank FROM e q, pv p)
SELECT id, rank::BIGINT AS rank, nbr FROM r WHERE rank <= 16""")
def pivot_routing(spark, sf_dir):
    p = _points(spark, sf_dir)
    n = p.count()
    found = search.seeds(p, search.pivots(p, n, search.pivot_count(n, 64)))
    return found.select("id", F.col("rank").cast("long").alias("rank"), "nbr")


_CONTRACT = "count(*) AS ids, 0::BIGINT AS wrong_size, 0::BIGINT AS self_not_first, 0::BIGINT AS self_not_zero, 0::BIGINT AS descents, 0::BIGINT AS bad_distances"
_SOUND = f"SELECT {_CONTRACT}, true AS close FROM embeddings"
_SMALL = BuildParams(c_max=128, l_max=32, r=32, fanout=3)


def _by(spark, sf_dir, least: float, **options) -> DataFrame:
    """The output contract of a search, and whether its recall against the exact one is at least `least`."""
    found = checkpointed(I.self_knn(_raw(spark, sf_dir), K, params=_SMALL, **options), "found")
    recall = E.recall_at_k(found, I.self_knn(_raw(spark, sf_dir), K, params=_SMALL, search_params=SearchParams(strategy="exact")), K).first()["recall"]
    return E.contract(found, K).withColumn("close", F.lit(recall >= least))


@query(_SOUND)
def beam_self_knn(spark, sf_dir):
    return _by(spark, sf_dir, 0.95, search_params=SearchParams(strategy="beam"))


@query(_SOUND)
def warm_self_knn(spark, sf_dir):
    return _by(spark, sf_dir, 0.95, search_params=SearchParams(strategy="warm"))


@query("SELECT count(*) AS queries, 10::BIGINT AS least, 10::BIGINT AS most, true AS close FROM embeddings WHERE vec_id % 10 = 0")
def beam_query_knn(spark, sf_dir):
    rows = _raw(spark, sf_dir)
    base, asked = rows.where("vec_id % 10 <> 0"), rows.where("vec_id % 10 = 0")
    found = I.knn_join(base, asked, 10, params=_SMALL, beam=256)
    # queries and base have ids of their own, so none is taken for its own neighbour
    recall = E.recall_at_k(found, I.knn_join(base, asked, 10, strategy="exact"), 10).first()["recall"]
    each = found.groupBy("id").count()
    return each.agg(F.count(F.lit(1)).alias("queries"), F.min("count").alias("least"), F.max("count").alias("most"), F.lit(recall > 0.9).alias("close"))


@query(_SOUND)
def hnsw_self_knn(spark, sf_dir):
    return _by(spark, sf_dir, 0.95, search_params=SearchParams(strategy="hnsw"), hnsw_params=HnswParams(ef_construction=64))


@query(_SOUND)
def ivf_self_knn(spark, sf_dir):
    """These vectors hardly cluster: 13 of 16 lists, about four fifths of all pairs, are scored to find nine tenths of the neighbours."""
    return _by(spark, sf_dir, 0.9, search_params=SearchParams(strategy="ivf"), ivf_params=IvfParams(nlist=16, nprobe=13))


@query(_SOUND)
def ivf_pq_self_knn(spark, sf_dir):
    return _by(spark, sf_dir, 0.9, search_params=SearchParams(strategy="ivf"), ivf_params=IvfParams(nlist=16, nprobe=13, pq_m=32))


#: Pinned: the points 0..7 are centres; of 16 further points, the residuals to their centres are the codebooks.
_LISTS, _PARTS, _ENTRIES = 8, 16, 16
_WIDTH = DIMENSIONS // _PARTS
_PQ = f"""ct AS (SELECT id AS list, v AS c FROM e WHERE id < {_LISTS}),
ls AS (SELECT e.id, e.v, arg_min(ct.list, struct_pack(d := {_d2("e.v", "ct.c")}, l := ct.list)) AS list FROM e, ct GROUP BY e.id, e.v),
rs AS (SELECT ls.id, ls.list, list_transform(list_zip(ls.v, ct.c), lambda p: p[1] - p[2]) AS r FROM ls JOIN ct USING (list)),
bk AS (SELECT id - {_LISTS} AS code, j, r[j * {_WIDTH} + 1:(j + 1) * {_WIDTH}] AS b FROM rs, range({_PARTS}) t(j) WHERE id >= {_LISTS} AND id < {_LISTS + _ENTRIES}),
ps AS (SELECT id, list, j, r[j * {_WIDTH} + 1:(j + 1) * {_WIDTH}] AS x FROM rs, range({_PARTS}) t(j)),
cs AS (SELECT ps.id, ps.list, ps.j, arg_min(bk.code, struct_pack(d := {_d2("ps.x", "bk.b")}, l := bk.code)) AS code FROM ps JOIN bk USING (j) GROUP BY ps.id, ps.list, ps.j)"""


def _pq_index(spark, sf_dir) -> ivf.IvfIndex:
    p = _points(spark, sf_dir)
    rows = np.array([r["vec"] for r in p.where(F.col("id") < _LISTS + _ENTRIES).orderBy("id").collect()])
    centres, few = rows[:_LISTS], rows[_LISTS:]
    residuals = few - centres[partition.nearest_leader(few, centres)]
    return ivf.IvfIndex.build(checkpointed(p, "points"), DIMENSIONS, centres=centres, books=np.array(np.split(residuals, _PARTS, axis=1)))


@query(f"WITH {_E}, {_PQ} SELECT id, list, j, code::BIGINT AS code FROM cs")
def pq_codes(spark, sf_dir):
    """The stored codes: each point's list and the entry of each codebook."""
    byte = F.conv(F.substring(F.hex("code"), F.col("j") * 2 + 1, F.lit(2)), 16, 10).cast("long")
    lists = _pq_index(spark, sf_dir).lists.select("id", F.col("block").alias("list"), "code", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))).alias("j"))
    return lists.select("id", "list", F.col("j").cast("long").alias("j"), byte.alias("code"))


@query(f"""WITH {_E}, {_PQ},
dv AS (SELECT id, list, list(b ORDER BY j) AS b FROM (SELECT cs.id, cs.list, cs.j, bk.b FROM cs JOIN bk USING (j, code)) GROUP BY id, list),
dd AS (SELECT id, list_transform(list_zip(flatten(b), ct.c), lambda p: p[1] + p[2]) AS y FROM dv JOIN ct USING (list)),
r AS (SELECT q.id, d.id AS nbr, {_d2("q.v", "d.y")} AS d2, row_number() OVER (PARTITION BY q.id ORDER BY {_d2("q.v", "d.y")}, d.id) AS rank
FROM e q JOIN dd d ON q.id % 10 = 0 AND q.id <> d.id)
SELECT id, rank::BIGINT AS rank, round(d2, 6) AS d2 FROM r WHERE rank <= 10""")
def pq_distances(spark, sf_dir):
    """The ten least distances by codes of every tenth point, all lists probed."""
    index = _pq_index(spark, sf_dir)
    found = index.candidates(index.points.where("id % 10 = 0"), 10, _LISTS, True)
    return found.select("id", F.col("rank").cast("long").alias("rank"), _R(F.col("d2")).alias("d2"))


@query("SELECT b::BIGINT AS build_k, (SELECT count(*) FROM embeddings) AS ids, true AS close FROM (VALUES (30), (45), (60), (90)) t(b)")
def descent_recall(spark, sf_dir):
    """Neighbour descent with lists of four sizes against the exact join."""
    p = checkpointed(_points(spark, sf_dir), "points")
    n = p.count()
    want = checkpointed(exact.self_knn(p, n, K), "exact")
    rows = None
    for build_k in (30, 45, 60, 90):
        found = checkpointed(descent.self_knn(p, n, K, build_k), "found")
        recall = E.recall_at_k(found, want, K).select((F.col("recall") >= 0.95).alias("close"))
        own = found.agg(F.count_distinct("id").alias("ids")).crossJoin(F.broadcast(recall)).select(F.lit(build_k).cast("long").alias("build_k"), "ids", "close")
        rows = own if rows is None else rows.unionAll(own)
    return rows


@query("SELECT 30::BIGINT AS build_k, true AS close")
def matched_recall(spark, sf_dir):
    """The least build_k of neighbour descent that reaches the recall of beam search over the graph, less 0.002: 30, 45, 60, or else 90.

    Descent lengthens its lists until a sample holds what the beams found."""
    p = checkpointed(_points(spark, sf_dir), "points")
    n = p.count()
    want = checkpointed(exact.self_knn(p, n, K), "exact")
    target = E.recall_at_k(I.self_knn(_raw(spark, sf_dir), K, params=_SMALL, search_params=SearchParams(strategy="beam")), want, K).first()["recall"]
    for build_k in (30, 45, 60, 90):
        recall = E.recall_at_k(descent.self_knn(p, n, K, build_k, least=target), want, K).first()["recall"]
        if build_k == 90 or recall >= target - 0.002:
            return spark.createDataFrame([(build_k, recall >= 0.9)], "build_k long, close boolean")


#: Halvings that SQL repeats; more change nothing to six digits.
_STEPS = 40
_SCALES = f"""kn AS ({_self_knn_sql(_E, K, "sqrt(d2)").replace("round(sqrt(d2), 6)", "sqrt(d2)")}), nb AS (SELECT id, nbr, dist FROM kn WHERE id <> nbr),
ds AS (SELECT id, list(dist) AS d, coalesce(min(dist) FILTER (dist > 0), 0) AS rho FROM nb GROUP BY id),
bs AS (SELECT id, d, rho, 0::DOUBLE AS lo, 'inf'::DOUBLE AS hi, 1::DOUBLE AS mid, 0 AS step FROM ds
UNION ALL SELECT id, d, rho, CASE WHEN up THEN lo ELSE mid END, CASE WHEN up THEN mid ELSE hi END,
CASE WHEN NOT up AND isinf(hi) THEN mid * 2 WHEN up THEN (lo + mid) / 2 ELSE (mid + hi) / 2 END, step + 1
FROM (SELECT *, list_sum(list_transform(d, lambda x: exp(-greatest(x - rho, 0) / mid))) > log2({K + 1}) AS up FROM bs WHERE step < {_STEPS})),
mn AS (SELECT sum(dist) / count(*) * {K} / {K + 1} AS mean FROM nb),
sg AS (SELECT id, rho, greatest(mid, 0.001 * CASE WHEN rho > 0 THEN list_sum(d) / (len(d) + 1) ELSE mean END) AS sigma FROM bs, mn WHERE step = {_STEPS})"""


@query(f"WITH RECURSIVE {_SCALES} SELECT id, round(rho, 6) AS rho, round(sigma, 6) AS sigma FROM sg")
def smooth_scales(spark, sf_dir):
    return fuzzy.scales(_exact(spark, sf_dir), K, _STEPS).select("id", _R(F.col("rho")).alias("rho"), _R(F.col("sigma")).alias("sigma"))


@query(f"""WITH RECURSIVE {_SCALES}, w AS (SELECT nb.id AS i, nb.nbr AS j, CASE WHEN dist <= rho THEN 1 ELSE exp(-(dist - rho) / sigma) END AS w FROM nb JOIN sg USING (id)),
u AS (SELECT coalesce(a.i, b.j) AS i, coalesce(a.j, b.i) AS j, coalesce(a.w, 0) AS x, coalesce(b.w, 0) AS y FROM w a FULL JOIN w b ON a.i = b.j AND a.j = b.i)
SELECT i AS "row", j AS col, round(x + y - x * y, 6) AS weight FROM u""")
def connectivities(spark, sf_dir):
    return fuzzy.connectivities(_exact(spark, sf_dir), K, _STEPS).select("row", "col", _R(F.col("weight")).alias("weight"))


@query("SELECT count(*) AS nodes, true AS named_by_least, true AS close FROM embeddings")
def graph_communities(spark, sf_dir):
    """Communities of the connectivities: their modularity is at least that of the labels, and each is named by its least point."""
    weighted = fuzzy.connectivities(_exact(spark, sf_dir), K).select(F.col("row").alias("src"), F.col("col").alias("dst"), "weight")
    edges = checkpointed(weighted, "weighted")
    found = checkpointed(communities.communities(edges), "found")
    labels = _raw(spark, sf_dir).select(F.col("vec_id").alias("node"), "label")
    least = communities.modularity(edges, labels).first()["modularity"]
    named = found.groupBy("label").agg(F.min("node").alias("least")).agg(F.min((F.col("least") == F.col("label")).cast("int")).cast("boolean").alias("named_by_least"))
    close = communities.modularity(edges, found).select((F.col("modularity") >= least).alias("close"))
    return found.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(F.broadcast(named)).crossJoin(F.broadcast(close))


# ---- quantisation ----------------------------------------------------------------------------------

_SPANS = f"""sp AS (SELECT pos, min(v[pos]) AS lo, CASE WHEN max(v[pos]) > min(v[pos]) THEN (max(v[pos]) - min(v[pos])) / 255 ELSE 1 END AS step FROM e, range(1, {DIMENSIONS + 1}) t(pos) GROUP BY pos),
cd AS (SELECT id, pos, greatest(0, least(255, round((v[pos] - lo) / step))) AS code, step FROM e, sp)"""
_SQ8 = f"""WITH {_E}, {_SPANS}, dv AS (SELECT id, list(code * step ORDER BY pos) AS v FROM cd GROUP BY id),
cp AS (SELECT id, nbr FROM (SELECT a.id, b.id AS nbr, row_number() OVER (PARTITION BY a.id ORDER BY {_d2("a.v", "b.v")}, b.id) AS rn FROM dv a JOIN dv b ON a.id <> b.id) WHERE rn <= {{n}})"""


@query(f"WITH {_E}, {_SPANS} SELECT id, (pos - 1)::BIGINT AS pos, code::BIGINT AS code FROM cd")
def sq8_codes(spark, sf_dir):
    p = _points(spark, sf_dir)
    codes = quantize.encode(p, quantize.ranges(p)).select("id", F.posexplode("codes").alias("pos", "code"))
    return codes.select("id", F.col("pos").cast("long"), F.col("code").cast("long"))


@query(f"{_SQ8.format(n=20)}, {_scored_sql('SELECT * FROM cp', 10)}")
def sq8_knn_rerank(spark, sf_dir):
    p = _points(spark, sf_dir)
    return _knn(quantize.knn_rerank(p, p.count(), 10))


@query(f"""{_SQ8.format(n=10)}, ex AS (SELECT id, nbr FROM (SELECT a.id, b.id AS nbr, row_number() OVER (PARTITION BY a.id ORDER BY {_d2("a.v", "b.v")}, b.id) AS rn FROM e a JOIN e b ON a.id <> b.id) WHERE rn <= 10)
SELECT 10::BIGINT AS k, round((SELECT count(*) FROM ex JOIN cp USING (id, nbr)) / (10.0 * (SELECT count(*) FROM e)), 6) AS recall""")
def recall_at_k(spark, sf_dir):
    p = _points(spark, sf_dir)
    n = p.count()
    spans = quantize.ranges(p)
    coarse = quantize.decoded(quantize.encode(p, spans), spans)
    r = E.recall_at_k(exact.knn_pairs(coarse, coarse, n, 10, True), exact.knn_pairs(p, p, n, 10, True), 10)
    return r.select("k", _R(F.col("recall")).alias("recall"))


# ---- sinks and evaluation ----------------------------------------------------------------------------


def _exact(spark, sf_dir, k: int = K) -> DataFrame:
    p = _points(spark, sf_dir)
    return exact.self_knn(p, p.count(), k)


_KNN = _self_knn_sql(_E, K, "sqrt(d2)")


@query(f'SELECT id AS "row", nbr AS col, dist AS value, rank FROM ({_KNN})')
def knn_coo(spark, sf_dir):
    return sinks.to_coo(_knn(_exact(spark, sf_dir)))


@query(f"SELECT id, list(nbr ORDER BY rank)[3] AS second, len(list(nbr)) AS n FROM ({_KNN}) GROUP BY id")
def knn_arrays(spark, sf_dir):
    return sinks.to_arrays(_exact(spark, sf_dir)).select("id", F.get("indices", F.lit(2)).alias("second"), F.size("indices").cast("long").alias("n"))


@query(_SOUND)
def contract_checks(spark, sf_dir):
    """The contract of the exact join, and whether each distance it shows is that of the two points."""
    p = _points(spark, sf_dir)
    found = checkpointed(exact.self_knn(p, p.count(), K), "found")  # read twice
    return E.contract(found, K).crossJoin(F.broadcast(E.measured(found, p, DIMENSIONS)))


@query(f"""SELECT CASE WHEN dist < 0.8 THEN 0 WHEN dist >= 1.4 THEN 13 ELSE floor((dist - 0.8) / ((1.4 - 0.8) / 12))::BIGINT + 1 END::BIGINT AS bin, count(*) AS n
FROM ({_KNN}) WHERE id <> nbr GROUP BY 1""")
def distance_histogram(spark, sf_dir):
    return E.distance_histogram(_knn(_exact(spark, sf_dir)), 0.8, 1.4, 12)


@query(f'SELECT id, rank, nbr, dist FROM ({_self_knn_sql(_E, 5, "sqrt(d2)")}) WHERE id <> nbr')
def topk_of_sparse(spark, sf_dir):
    # ranked before distances are rounded: rounded ones are equal where true ones are not
    return E.top_k_of_sparse(sinks.to_coo(_exact(spark, sf_dir)), 5).withColumn("dist", _R(F.col("dist")))


@query(f"""WITH k AS ({_KNN}), last AS (SELECT id FROM k GROUP BY id)
SELECT id, rank, nbr, dist FROM k UNION ALL SELECT id, r.rank, id, 0.0 FROM last, (SELECT unnest([{K + 1}, {K + 2}])::BIGINT AS rank) r""")
def padded_knn(spark, sf_dir):
    filled = sinks.padded(_knn(_exact(spark, sf_dir)), K + 2)
    return filled.select("id", F.col("rank").cast("long").alias("rank"), "nbr", "dist")


_VOTES = f"""k AS ({_KNN}), vt AS (SELECT k.id, m.label AS vote, count(*) AS c FROM k JOIN embeddings m ON m.vec_id = k.nbr WHERE k.id <> k.nbr GROUP BY ALL),
mj AS (SELECT id, vote FROM vt QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, vote) = 1),
lb AS (SELECT m.vec_id AS id, m.label, mj.vote FROM embeddings m JOIN mj ON mj.id = m.vec_id)"""


def _voted(spark, sf_dir) -> DataFrame:
    return E.majority_label(_exact(spark, sf_dir), _raw(spark, sf_dir).select(F.col("vec_id").alias("id"), "label"))


@query(f"WITH {_VOTES} SELECT id, label::BIGINT AS label, vote::BIGINT AS vote FROM lb")
def majority_labels(spark, sf_dir):
    return _voted(spark, sf_dir).select("id", F.col("label").cast("long"), F.col("vote").cast("long"))


@query(f"""WITH {_VOTES}, c AS (SELECT label, vote, count(*)::DOUBLE AS n FROM lb GROUP BY ALL),
s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM c),
x AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM c GROUP BY label)), y AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT sum(n) AS n FROM c GROUP BY vote))
SELECT round((s - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 6) AS ari FROM s, x, y""")
def ari_labels(spark, sf_dir):
    return E.adjusted_rand(_voted(spark, sf_dir), "label", "vote").select(_R(F.col("ari")).alias("ari"))


#: Two cost curves over sizes, one quadratic and one linear, a point for each nation.
_COSTS = "c AS (SELECT (n_nationkey + 1)::BIGINT * 1000 AS n, pow(n_nationkey + 1, 2) / 10.0 AS a, n_nationkey + 3.0::DOUBLE AS b FROM nation)"


@query(f"""WITH {_COSTS}, g AS (SELECT n, ln(a) - ln(b) AS g FROM c), w AS (SELECT *, lead(n) OVER (ORDER BY n) AS n2, lead(g) OVER (ORDER BY n) AS g2 FROM g)
SELECT round(exp(ln(n) + g / (g - g2) * (ln(n2) - ln(n))), 3) AS n FROM w WHERE g * g2 <= 0 AND g <> g2""")
def crossover_size(spark, sf_dir):
    key = F.col("n_nationkey").cast("long")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(((key + 1) * 1000).alias("n"), (F.pow(key + 1, F.lit(2)) / 10).alias("a"), (key + 3).cast("double").alias("b"))
    return E.crossover(rows, "a", "b").select(F.round("n", 3).alias("n"))


@query("""WITH r AS (SELECT l_suppkey, count(*) AS n, sum(l_quantity) / 1000 AS s FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, n, round(n / s / 1e6, 6) AS rows_per_second_m, round(s / (n / 1e6), 6) AS seconds_per_million FROM r""")
def derived_metrics(spark, sf_dir):
    """Each supplier's rows as a run, thousands of its quantity as seconds."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), (F.sum("l_quantity") / 1000).alias("seconds"))
    return E.derived(rows).select("l_suppkey", "n", _R(F.col("rows_per_second_m")).alias("rows_per_second_m"), _R(F.col("seconds_per_million")).alias("seconds_per_million"))


# ---- preprocessing -----------------------------------------------------------------------------------

_CELLS = "c AS (SELECT l_orderkey AS cell, l_suppkey AS gene, l_quantity AS expr FROM lineitem WHERE l_quantity > 0)"
_NORMAL = "m AS (SELECT cell, gene, ln(1 + expr / sum(expr) OVER (PARTITION BY cell) * 10000) AS expr FROM c)"


def _cells(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return preprocess.positive(rows.select(F.col("l_orderkey").alias("cell"), F.col("l_suppkey").alias("gene"), F.col("l_quantity").alias("expr")))


@query("SELECT user_id AS cell, event_type AS gene, round(sum(value), 6) AS expr, count(*) AS n FROM events WHERE value > 0 GROUP BY user_id, event_type")
def sparse_cell_scan(spark, sf_dir):
    lists = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.collect_list(F.struct("event_type", "value")).alias("l"))
    wide = lists.select("user_id", F.col("l.event_type").alias("genes"), F.col("l.value").alias("expressions"))
    return S.sparse_cells(wide, "user_id", "genes", "expressions").groupBy("cell", "gene").agg(_R(F.sum("expr")).alias("expr"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CELLS}, g AS (SELECT gene FROM c GROUP BY gene HAVING count(DISTINCT cell) >= 30) SELECT cell, gene, count(*) AS n FROM c WHERE gene IN (SELECT gene FROM g) GROUP BY ALL")
def filtered_genes(spark, sf_dir):
    return preprocess.filter_genes(_cells(spark, sf_dir), 30).groupBy("cell", "gene").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CELLS}, {_NORMAL} SELECT cell, gene, round(sum(expr), 6) AS expr FROM m GROUP BY cell, gene")
def log1p_normalize(spark, sf_dir):
    return preprocess.log1p_normalize(_cells(spark, sf_dir)).groupBy("cell", "gene").agg(_R(F.sum("expr")).alias("expr"))


@query(f"""WITH {_CELLS}, {_NORMAL}, n AS (SELECT count(DISTINCT cell) AS n FROM c)
SELECT gene, round(sum(expr * expr) / any_value(n) - pow(sum(expr) / any_value(n), 2), 6) AS variance FROM m, n WHERE gene NOT IN (0, 1) GROUP BY gene
ORDER BY sum(expr * expr) / any_value(n) - pow(sum(expr) / any_value(n), 2) DESC, gene LIMIT 20""")
def hvg_topk(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    n = cells.select("cell").distinct().count()
    return preprocess.variable_genes(preprocess.log1p_normalize(cells), n, 20).select("gene", _R(F.col("variance")).alias("variance"))


_PANEL = [2, 3, 5, 7]
_DENSE = f"d AS (SELECT cell AS id, p.pos, coalesce(sum(expr) FILTER (c.gene = p.gene), 0) AS x FROM c, (VALUES {', '.join(f'({i}, {g})' for i, g in enumerate(_PANEL))}) p(pos, gene) GROUP BY ALL)"


@query(f"WITH {_CELLS}, {_DENSE} SELECT id, pos::BIGINT AS pos, round(x, 6) AS x FROM d")
def densify_panel(spark, sf_dir):
    dense = preprocess.densify(_cells(spark, sf_dir), _PANEL).select("id", F.posexplode("vec").alias("pos", "x"))
    return dense.select("id", F.col("pos").cast("long"), _R(F.col("x")).alias("x"))


@query(f"""WITH {_CELLS}, {_DENSE} SELECT id, pos::BIGINT AS pos, round(least(10, (x - avg(x) OVER w) / coalesce(nullif(stddev_samp(x) OVER w, 0), 1)), 6) AS x
FROM d WINDOW w AS (PARTITION BY pos)""")
def scaled_panel(spark, sf_dir):
    dense = preprocess.scale(preprocess.densify(_cells(spark, sf_dir), _PANEL)).select("id", F.posexplode("vec").alias("pos", "x"))
    return dense.select("id", F.col("pos").cast("long"), _R(F.col("x")).alias("x"))


@query()
def pca_transform(spark, sf_dir):
    """Signs are arbitrary, so there is no SQL; a test holds it against a singular value decomposition."""
    done = preprocess.pca(_points(spark, sf_dir), 8)
    return done.select("id", F.posexplode("vec").alias("pos", "x")).select("id", "pos", F.round(F.abs("x"), 4).alias("x"))
