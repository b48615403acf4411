"""Recall, contracts and invariants on seeded synthetic vectors, and edge cases of the inputs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.operators import candidates, evaluate, graph, partition, preprocess, search, walks
from vecloom.plans import estimators, layered
from vecloom.plans import index as I
from vecloom.plans.params import BuildParams, HnswParams, IvfParams, SearchParams
from vecloom.sources import sinks
from vecloom.sources import vectors as S


def frame(spark, x):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>")


def truth(x, k, cosine=False):
    x = x.astype(np.float64)
    if cosine:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d2, -1)
    return np.argsort(d2, axis=1, kind="stable")[:, : k + 1]


def recall(knn, want):
    rows = knn.toPandas()
    got = {i: set(g.nbr) for i, g in rows[rows.nbr != rows.id].groupby("id")}
    return np.mean([len(got.get(i, set()) & set(w[1:])) / (len(w) - 1) for i, w in enumerate(want)])


@pytest.fixture(scope="module")
def blobs():
    return S.gaussian_clusters(1200, 16, 8, 5.0, 2)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_exact_is_exact(spark, metric):
    x = S.gaussian_clusters(300, 20, seed=1)
    knn = I.self_knn(frame(spark, x), 10, params=BuildParams(metric=metric)).toPandas().sort_values(["id", "rank"])
    assert (knn.nbr.to_numpy().reshape(300, 11) == truth(x, 10, metric == "cosine")).all()


def test_exact_join_in_parts_is_the_same(spark, monkeypatch):
    x = S.gaussian_clusters(300, 8, seed=4)
    base, asked = frame(spark, x[:200]), frame(spark, x[200:])
    ways = lambda: [sorted(map(tuple, d.collect())) for d in (I.self_knn(base, 5), I.knn_join(base, asked, 5, strategy="exact"))]
    whole = ways()
    monkeypatch.setattr(I.exact, "QUERY_PART", 40)
    assert ways() == whole


@pytest.mark.parametrize("strategy,least", [("beam", 0.95), ("warm", 0.95), ("reservoir", 0.9)])
def test_graph_recall_and_contract(spark, blobs, strategy, least):
    params = BuildParams(c_max=256, l_max=48, r=32)
    knn = I.self_knn(frame(spark, blobs), 10, params=params, search_params=SearchParams(strategy=strategy)).cache()
    assert recall(knn, truth(blobs, 10)) >= least
    assert tuple(evaluate.contract(knn, 10).first()) == (1200, 0, 0, 0, 0, 0)


def test_same_seed_same_graph(spark, blobs):
    ways = [I.VectorIndex.build(frame(spark, blobs[:500]), params=BuildParams(c_max=100, seed=42)).edges.toPandas() for _ in range(2)]
    a, b = (w.sort_values(["src", "dst"]).reset_index(drop=True) for w in ways)
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("quantize,least", [(None, 0.95), ("sq8", 0.85)])
def test_hnsw_recall(spark, blobs, quantize, least):
    x = blobs[:600]
    knn = I.self_knn(frame(spark, x), 10, search_params=SearchParams(strategy="hnsw"), hnsw_params=HnswParams(ef_construction=60, quantize=quantize))
    assert recall(knn, truth(x, 10)) >= least


@pytest.mark.parametrize("pq,least", [(None, 0.9), (8, 0.5)])
def test_ivf_recall(spark, blobs, pq, least):
    knn = I.self_knn(frame(spark, blobs), 10, search_params=SearchParams(strategy="ivf"), ivf_params=IvfParams(nlist=16, nprobe=6, pq_m=pq))
    assert recall(knn, truth(blobs, 10)) >= least


def test_held_out_queries_and_persistence(spark, blobs, tmp_path):
    base, asked = frame(spark, blobs[:1000]), frame(spark, blobs[1000:])
    index = I.VectorIndex.build(base, params=BuildParams(c_max=200))
    index.save(f"file://{tmp_path}/index")
    found = index.query(asked, 10, 128).toPandas().sort_values(["id", "rank"]).reset_index(drop=True)
    again = I.VectorIndex.load(spark, f"file://{tmp_path}/index").query(asked, 10, 128).toPandas().sort_values(["id", "rank"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(found, again)
    exact = I.knn_join(base, asked, 10, strategy="exact")
    assert evaluate.recall_at_k(spark.createDataFrame(found).withColumn("id", F.col("id") + 100000), exact.withColumn("id", F.col("id") + 100000), 10).first()["recall"] >= 0.95
    with pytest.raises(ValueError):
        index.query(frame(spark, blobs[:5, :7]))


def test_beam_agrees_with_exact(spark, blobs):
    index = I.VectorIndex.build(frame(spark, blobs[:400]), params=BuildParams(c_max=100))
    asked = S.from_table(frame(spark, blobs[400:420])).withColumn("id", F.col("id") + 5000)
    found = search.beam_search(index.points, index.edges, asked, index._starts(asked, 32), 32, index.d)
    exact = I.exact.query_knn(index.points, asked, 400, 10)
    assert evaluate.recall_at_k(found, exact, 10).first()["recall"] >= 0.95


def plain_beams(x, edges, q, starts, width):
    """The same rounds one query at a time, with sets and sorted lists."""
    out = {}
    for i, v in q.items():
        measure = lambda j, v=v: float(((x[j] - v) ** 2).sum())
        seen = set(starts[i])
        beam = sorted((measure(j), j) for j in seen)[:width]
        done = set()
        while fresh := [j for _, j in beam if j not in done]:
            done |= set(fresh)
            new = {n for j in fresh for n in edges.get(j, ())} - seen
            seen |= new
            beam = sorted([*beam, *((measure(j), j) for j in new)])[:width]
        out[i] = [j for _, j in beam]
    return out


@pytest.mark.parametrize("hubs", [False, True])
def test_beams_match_plain_walks(spark, blobs, monkeypatch, hubs):
    if hubs:  # every round then deals with its most frequented points apart
        monkeypatch.setattr(search, "HUB_ROWS", 0)
    x = blobs[:500].astype(float)
    index = I.VectorIndex.build(frame(spark, blobs[:500]), params=BuildParams(c_max=100))
    edges = index.edges.toPandas().groupby("src")["dst"].apply(list).to_dict()
    own = index.self_knn(8, SearchParams(beam=20)).where("rank > 0").toPandas().sort_values(["id", "rank"]).groupby("id")["nbr"].apply(list).to_dict()
    want = plain_beams(x, edges, dict(enumerate(x)), {i: [i] for i in range(500)}, 20)
    assert own == {i: [j for j in w if j != i][:8] for i, w in want.items()}
    asked = frame(spark, blobs[500:530])
    starts = index._starts(S.from_table(asked), 16).toPandas().groupby("id")["nbr"].apply(list).to_dict()
    got = index.query(asked, 5, 16).toPandas().sort_values(["id", "rank"]).groupby("id")["nbr"].apply(list).to_dict()
    want = plain_beams(x, edges, dict(enumerate(blobs[500:530].astype(float))), starts, 16)
    assert got == {i: w[:5] for i, w in want.items()}


def test_rounds_leave_points_and_edges_where_they_are(spark, blobs):
    """Joins with the index's tables read their buckets; only frontiers and candidates are exchanged."""
    index = I.VectorIndex.build(frame(spark, blobs[:300]), params=BuildParams(c_max=100))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = index.points.select("id", ((F.col("id") * 7 + 1) % 300).alias("nbr"))
        hop = search.with_table(rows, index.edges.select(F.col("src").alias("nbr"), "dst"), None)
        met = search.with_table(rows, index.points.select(F.col("id").alias("nbr"), "vec"), None)
        for df, exchanges in ((hop, 1), (met, 1)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == exchanges, plan
            assert "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_queries_as_a_stream(spark, blobs, tmp_path):
    from vecloom.streaming.search import query_stream

    index = I.VectorIndex.build(frame(spark, blobs[:300]), params=BuildParams(c_max=100))
    frame(spark, blobs[300:320]).write.parquet(f"{tmp_path}/in")
    got = []
    stream = spark.readStream.schema("vec_id long, embedding array<float>").parquet(f"{tmp_path}/in")
    q = query_stream(index, stream, lambda rows, number: got.append(rows.count()), 5).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and sum(got) == 100


def test_carving_invariants(spark, blobs):
    x = np.concatenate([blobs, np.repeat(blobs[:1], 500, axis=0)])  # a third of all points are equal
    points = S.from_table(frame(spark, x))
    leaves = partition.partition(points, 128, 3, 1).toPandas()
    home = leaves[leaves.is_home]
    assert sorted(home.id) == list(range(len(x)))
    assert home.groupby("leaf_id").size().max() <= 128
    assert leaves.groupby("id").size().max() <= 3
    assert not leaves.duplicated(["leaf_id", "id"]).any()


def test_carving_keeps_equal_points_of_wide_ids(spark, monkeypatch):
    for ranked in (65_536, 30):
        monkeypatch.setattr(partition, "RANKED", ranked)
        points = spark.createDataFrame([(i << 33, [1.0, 2.0]) for i in range(400)] + [(7, [1.0, 2.0])] * 100, "id long, vec array<double>")
        leaves = partition.carve(points, 48).toPandas()
        assert sorted(leaves.id) == sorted([i << 33 for i in range(400)] + [7] * 100)
        assert sorted(leaves.groupby("leaf_id").size()) == [20, *[48] * 10]


def test_leaders_by_shuffle_agree(spark, blobs, monkeypatch):
    points = S.from_table(frame(spark, blobs[:300])).withColumn("node", F.col("id") % 3)
    lead = partition.leaders(points, 20, 4)
    one = partition.assign(points, lead).select("id", "place").toPandas().sort_values("id").place.tolist()
    monkeypatch.setattr(partition, "BROADCAST_BYTES", 0)
    assert partition.assign(points, lead).select("id", "place").toPandas().sort_values("id").place.tolist() == one


def test_reservoir_is_order_free_and_as_known(spark):
    # fixed values: the known case of six candidates and its result
    rows = [(10, 1, 5.0), (11, 2, 3.0), (12, 1, 2.0), (13, 4, 8.0), (14, 8, 1.0), (15, 2, 9.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(0, *r) for r in order], "src long, dst long, code int, norm double")
        kept = candidates.drain(candidates.reservoir(df, 4)).first()["slots"]
        assert [s["dst"] for s in kept] == [14, 12, 11, 13]


def test_reservoir_matches_sequential_inserts(spark):
    rng = np.random.default_rng(5)
    rows = [(int(d), int(rng.integers(0, 30)), float(V.bf16_array(rng.random(1))[0])) for d in rng.permutation(400)]
    slots: dict[int, tuple] = {}
    for d, code, norm in rows:
        if code in slots:
            slots[code] = min(slots[code], (norm, d))
        elif len(slots) < 12:
            slots[code] = (norm, d)
        elif (norm, d) < max(slots.values()):
            del slots[max(slots, key=lambda c: slots[c])]
            slots[code] = (norm, d)
    df = spark.createDataFrame([(0, *r) for r in rows], "src long, dst long, code int, norm double")
    assert sorted((r["norm"], r["dst"]) for r in candidates.reservoir(df, 12).collect()) == sorted(slots.values())


def test_prune_keeps_no_dominated_neighbour(spark):
    x = np.random.default_rng(0).standard_normal((40, 4))
    d2 = ((x - x[0]) ** 2).sum(1)
    order = np.argsort(d2)[1:]
    kept = graph.kept_by_diversity(d2[order], x[order], 1.2, 8)
    for j, z in enumerate(kept):
        assert all(1.44 * ((x[order[y]] - x[order[z]]) ** 2).sum() >= d2[order[z]] for y in kept[:j])


def test_symmetric_edges_have_no_loops_and_bounded_degree(spark, blobs):
    points = S.from_table(frame(spark, blobs[:200]))
    pairs = candidates.leaf_pairs(points.withColumn("leaf_id", F.lit(0)), candidates.hyperplanes(8, 16), 20)
    e = graph.symmetrize(pairs, points, 7).toPandas()
    assert (e.src != e.dst).all() and e.groupby("src").size().max() <= 7


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [1.0, None])], [(0, [1.0]), (1, [1.0, 2.0])], [(0, [float("nan")])], [(0, [])]])
def test_bad_inputs_raise(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    with pytest.raises(ValueError):
        I.self_knn(df, 1)


def test_ties_and_few_rows(spark):
    x = np.zeros((5, 3), np.float32)
    knn = I.self_knn(frame(spark, x), 15).toPandas().sort_values(["id", "rank"])
    assert knn.nbr.to_numpy().reshape(5, 5).tolist() == [[i, *(j for j in range(5) if j != i)] for i in range(5)]
    assert (knn.dist == 0).all()


def test_parameters():
    assert V.parse_metric("Angular") == "cosine" and V.largest_divisor(50, 32) == 25
    for bad in ({"metric": "manhattan"}, {"m": 17}, {"r": 0}):
        with pytest.raises(ValueError):
            BuildParams(**bad)
    assert BuildParams(runs=0).runs == 1
    with pytest.raises(ValueError):
        SearchParams(strategy="guess")


def test_estimator(spark, blobs):
    df = frame(spark, blobs[:100])
    est = I.KnnGraph(nNeighbors=5)
    graph_rows = est.copy({est.metric: "cosine"}).fit(df).transform(df)
    assert graph_rows.count() == 600 and graph_rows.where("rank = 0 and (row <> col or value <> 0)").isEmpty()
    data, indices, indptr = sinks.to_csr(I.self_knn(df, 5))
    assert len(data) == len(indices) == indptr[-1] == 600
    with pytest.raises(ValueError):
        I.KnnGraph(nNeighbors=100).fit(df)


def test_estimators_keep_their_parameters_and_models(spark, blobs, tmp_path):
    df = frame(spark, blobs[:120])
    want = {tuple(r) for r in I.self_knn(df, 4, search_params=SearchParams(strategy="exact")).select("id", "nbr").collect()}
    for k, est in enumerate((estimators.LayeredKnnGraph(nNeighbors=4, m=8, efConstruction=40), estimators.ListKnnGraph(nNeighbors=4, nlist=4, nprobe=3), estimators.ListKnnGraph(nNeighbors=4, nlist=4, nprobe=4, pqM=8))):
        est.save(f"{tmp_path}/est{k}")
        again = type(est).load(f"{tmp_path}/est{k}")
        assert {p.name: again.getOrDefault(p) for p in again.params} == {p.name: est.getOrDefault(p) for p in est.params}
        model = again.fit(df)
        rows = {tuple(r) for r in model.transform(df).select("row", "col").collect()}
        assert len(rows) == 600 and len(rows & want) >= 0.9 * 600
        model.save(f"{tmp_path}/model{k}")
        loaded = I.KnnGraphModel.load(f"{tmp_path}/model{k}")
        assert {tuple(r) for r in loaded.transform(df).select("row", "col").collect()} == rows and loaded.getOrDefault("nNeighbors") == 4
        few = model.transform(df.where("vec_id < 10"))
        assert few.count() == 50 and few.where("row >= 10").isEmpty()


def test_arrays_in_and_out(spark, blobs):
    nbr, dist = I.self_knn_array(spark, blobs[:50], 4)
    assert nbr.shape == dist.shape == (50, 5) and (nbr[:, 0] == np.arange(50)).all()
    held, far = I.knn_join_array(spark, blobs[:50], blobs[50:60], 4, strategy="exact")
    assert held.shape == far.shape == (10, 4) and (np.diff(far, axis=1) >= 0).all()


def test_merge_records(spark):
    old = spark.createDataFrame([(1, 0.5), (2, 0.7)], "n long, seconds double")
    new = spark.createDataFrame([(2, 0.6), (3, 0.9)], "n long, seconds double")
    assert [tuple(r) for r in sinks.merge_records(old, new, ["n"]).collect()] == [(1, 0.5), (2, 0.6), (3, 0.9)]


def test_generators_repeat():
    assert (S.lcg_uniform(50, 3) == S.lcg_uniform(50, 3)).all() and np.abs(S.lcg_uniform(50, 3)).max() <= 1
    assert abs(S.lcg_gaussian(400, 5).std() - 1) < 0.1
    assert V.bf16_array(np.array([0.0, 1.0, 3.14159])).tolist() == [0.0, 1.0, 3.140625]


def test_layers_follow_the_law(spark):
    top = spark.range(20000).select(layered.layer_of(F.col("id"), 16).alias("top")).toPandas()["top"].to_numpy()
    assert abs((top > 0).mean() - 1 / 16) < 0.01 and abs((top > 1).mean() - 1 / 256) < 0.003 and top.max() <= 24


def test_layers_are_nested_and_bounded(spark, blobs):
    graph = layered.LayeredGraph.build(S.from_table(frame(spark, blobs[:700])), HnswParams(m=4, ef_construction=32), BuildParams(c_max=200))
    ids = [{r["id"] for r in index.points.select("id").collect()} for index in graph.layers]
    assert len(ids) >= 2 and all(b < a for a, b in zip(ids, ids[1:])) and 0 < graph.top.count() <= layered.ENTRY_POINTS
    for level, index in enumerate(graph.layers):
        assert index.edges.groupBy("src").count().agg(F.max("count")).first()[0] <= (4 if level else 8)
    asked = S.from_table(frame(spark, blobs[700:730]))
    found = graph.query(asked, 5).select((F.col("id") + 10_000).alias("id"), "nbr")
    exact = I.exact.query_knn(S.from_table(frame(spark, blobs[:700])), asked.withColumn("id", F.col("id") + 10_000), 700, 5)
    assert evaluate.recall_at_k(found, exact, 5).first()["recall"] >= 0.9


def test_pca_matches_svd(spark, blobs):
    x = blobs[:200].astype(np.float64)
    got = np.array([r["vec"] for r in preprocess.pca(S.from_table(frame(spark, blobs[:200])), 3).orderBy("id").collect()])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-6)


def test_recipe_and_matching(spark):
    rng = np.random.default_rng(0)
    cells = spark.createDataFrame([(int(c), int(g), float(v)) for c in range(60) for g, v in enumerate(rng.poisson(2, 12))], "cell long, gene long, expr double")
    dense = preprocess.recipe(cells, 60, 8, 4)
    assert dense.count() == 60 and dense.where(F.size("vec") != 4).isEmpty()
    rows = spark.createDataFrame([(30, 0.8), (45, 0.97), (60, 0.99)], "build_k long, recall double")
    assert evaluate.first_matching(rows, 0.971).first()["build_k"] == 45
    assert evaluate.sample_ids(S.from_table(frame(spark, rng.standard_normal((30, 2)).astype(np.float32))), 7).count() == 7


def test_sql_functions(spark):
    V.register(spark)
    row = spark.sql("SELECT l2_sq(array(1D, 2D), array(4D, 6D)) a, cosine_dist(array(1D, 0D), array(0D, 2D)) b, unit_vector(array(3D, 4D)) c").first()
    assert row["a"] == 25 and row["b"] == 1 and row["c"] == [0.6, 0.8]


def test_sparse_rows_are_ranked_before_they_are_rounded(spark, tmp_path):
    """Distances that are equal to six digits stood in the order of ids."""
    from vecloom.queries import QUERIES

    x = np.zeros((8, 2), np.float32)
    x[1:, 0] = 1 - np.arange(7) * 2e-7
    frame(spark, x).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = QUERIES["topk_of_sparse"](spark, str(tmp_path)).where("id = 0").orderBy("rank").collect()
    assert [r["nbr"] for r in rows] == [7, 6, 5, 4, 3] and {round(r["dist"], 5) for r in rows} == {1.0}


def test_cells_are_grouped_in_tasks_of_bounded_size(spark, monkeypatch):
    """Tasks that group cells were as many at every size of the table."""
    rows = [(c, g, float(1 + (c * g) % 5)) for c in range(60) for g in range(1 + c % 7)] + [(3, 0, 2.0), (None, 6, 1.0)]
    cells = spark.createDataFrame(rows, "cell long, gene long, expr double")
    ways = lambda: [sorted(map(tuple, d.groupBy("gene").count().collect())) for d in (preprocess.filter_genes(cells, 17), preprocess.log1p_normalize(cells))]
    whole = ways()
    assert [g for g, _ in whole[0]] == [g for g in range(7) if len({c for c, h, _ in rows if h == g and c is not None}) >= 17]
    monkeypatch.setattr(preprocess, "CELL_ROWS", 20)
    assert ways() == whole
    assert preprocess.log1p_normalize(cells).rdd.getNumPartitions() == -(-len(rows) // 20) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_beams_widen_until_a_sample_finds_its_neighbours(spark):
    """Points that hardly cluster: beams of 16 over few links held under nine tenths of the neighbours."""
    x = np.random.default_rng(5).standard_normal((1500, 32)).astype(np.float32)
    index = I.VectorIndex.build(frame(spark, x), params=BuildParams(c_max=64, l_max=8, r=8))
    want = truth(x, 10)
    own = index.points.select("id", F.col("id").alias("nbr"), F.lit(0.0).alias("d2"))
    narrow = recall(I.exact.top_k(index._beam(index.points, own, 16).where("id <> nbr"), 10), want)
    wide = recall(index.self_knn(10, SearchParams(strategy="beam", beam=16)), want)
    assert narrow < 0.9 and wide >= 0.95


def test_queries_walk_every_shard(spark, monkeypatch):
    """Beams moved a vector for each pair of query and point, in rounds of joins, and had not ended at 10,256 points after minutes."""
    monkeypatch.setattr(walks, "SHARD", 400)
    x = np.random.default_rng(6).standard_normal((1000, 12)).astype(np.float32)
    x[7:10] = x[6]
    index = I.VectorIndex.build(frame(spark, x), params=BuildParams(c_max=100))
    place = {r["id"]: r["shard"] for r in index.points.select("id", walks.shard_of(F.col("id"), 3).alias("shard")).collect()}
    assert index.shards == 3 and set(place.values()) == {0, 1, 2} and all(place[r["src"]] == place[r["dst"]] for r in index.edges.collect())
    knn = index.self_knn(10, SearchParams(strategy="beam")).cache()
    assert recall(knn, truth(x, 10)) >= 0.95 and tuple(evaluate.contract(knn, 10).first()) == (1000, 0, 0, 0, 0, 0)
    found = index.query(frame(spark, x[:40]), 5)
    assert {r["nbr"] for r in found.where("id = 8 and rank <= 4").collect()} == {6, 7, 8, 9}
    exact = I.exact.query_knn(index.points, index.points.where("id < 40"), 1000, 5)
    assert found.join(exact, ["id", "rank", "nbr"]).count() >= 0.9 * 200
    assert recall(index.self_knn(10, SearchParams(strategy="reservoir")), truth(x, 10)) >= 0.7  # its candidates come from all points


def test_walks_of_one_shard_are_plain_walks():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, (200, 3)).astype(float)  # equals and ties
    ids = rng.permutation(10**6)[:200] - 500_000
    edges = {int(i): [int(j) for j in rng.choice(ids, rng.integers(0, 6), replace=False)] for i in ids}
    shard = walks.Shard(ids, x, [np.array(edges[i], np.int64) for i in ids.tolist()])
    at = {int(i): x[p] for p, i in enumerate(ids)}
    for v in rng.integers(0, 4, (30, 3)).astype(float):
        start = [int(i) for i in rng.choice(ids, 3, replace=False)]
        for width in (1, 4, 30):
            got = shard.walk(v, shard.at(np.array(start)), width, width)
            assert got[0].tolist() == plain_beams(at, edges, {0: v}, {0: start}, width)[0]
    assert not shard.seen[:-1].any()


def test_contract_checks_measure_the_distances(spark, sf_dir):
    """A distance that is not its points' passed, as the query had lost the column close."""
    from vecloom import queries

    rows = queries.QUERIES["contract_checks"](spark, sf_dir)
    assert rows.columns[-1] == "close" and rows.first()["close"]
    points = S.from_table(frame(spark, np.array([[0, 0], [3, 4], [0, 1]], np.float32)))
    close = lambda *pairs: evaluate.measured(spark.createDataFrame(pairs, "id long, nbr long, dist double"), points, 2).first()["close"]
    assert close((0, 0, 0.0), (0, 1, 5.0)) and not close((0, 1, 5.0), (0, 2, 1.1)) and not close((0, 7, 1.0))


def test_matched_recall_is_that_of_beams(spark, sf_dir, monkeypatch):
    """The target came from the reservoirs, without a search, and lists of 60 and 90 were left out."""
    from vecloom import queries

    asked, found = [], queries.I.self_knn(queries._raw(spark, sf_dir), 15, search_params=SearchParams(strategy="exact"))
    none = found.where("rank = 0")
    monkeypatch.setattr(queries.I, "self_knn", lambda *a, search_params, **kw: asked.append(search_params.strategy) or found)
    monkeypatch.setattr(queries.descent, "self_knn", lambda p, n, k, build_k, **kw: asked.append(build_k) or (found if build_k == 60 else none))
    row = queries.QUERIES["matched_recall"](spark, sf_dir).first()
    assert asked == ["beam", 30, 45, 60] and tuple(row) == (60, True)
