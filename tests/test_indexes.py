"""Inverted lists with product codes, neighbour descent, and connectivities, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import blocks, candidates, communities, descent, evaluate, exact, fuzzy, ivf, quantize
from vecloom.operators.blocks import codes, packed
from vecloom.operators.partition import nearest_leader
from vecloom.sources import vectors as S


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(3)
    return (np.repeat(rng.standard_normal((6, 16)) * 4, 100, axis=0) + rng.standard_normal((600, 16))).astype(np.float32)


@pytest.fixture(scope="module")
def points(spark, x):
    return S.from_array(spark, x).cache()


def test_bytes_there_and_back():
    rows = np.random.default_rng(0).integers(0, 256, (7, 5)).astype(np.uint8)
    column = packed(rows)
    assert column.to_pylist() == [bytes(r) for r in rows] and (codes(column) == rows).all()
    assert (codes(column.slice(2, 3)) == rows[2:5]).all() and codes(column.slice(7)).shape == (0, 0)


def test_tiles_change_no_leader(monkeypatch):
    from vecloom.operators import partition

    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((300, 4)), rng.standard_normal((40, 4))
    b[7] = b[3]  # equals: the first counts
    whole = nearest_leader(a, b)
    monkeypatch.setattr(partition, "TILE", 100)
    assert (nearest_leader(a, b) == whole).all() and 7 not in whole
    assert (whole == [int(((b - v) ** 2).sum(1).argmin()) for v in a]).all()


def test_codes_are_nearest_entries_of_residuals(spark, points, x):
    index = ivf.IvfIndex.build(points, 16, 8, 4)
    own = nearest_leader(x.astype(float), index.centres)
    rows = {r["id"]: (r["block"], bytes(r["code"])) for r in index.lists.collect()}
    assert len(rows) == 600 and {i: b for i, (b, _) in rows.items()} == dict(enumerate(own.tolist()))
    for i in range(0, 600, 7):
        parts = np.split(x[i].astype(float) - index.centres[own[i]], 4)
        assert list(rows[i][1]) == [int(((book - part) ** 2).sum(1).argmin()) for book, part in zip(index.books, parts, strict=True)]


def test_distance_tables_measure_decoded_residuals(spark, points, x):
    index = ivf.IvfIndex.build(points, 16, 8, 4)
    code = {r["id"]: (r["block"], list(bytes(r["code"]))) for r in index.lists.collect()}
    decoded = np.array([index.centres[code[i][0]] + np.concatenate([book[c] for book, c in zip(index.books, code[i][1], strict=True)]) for i in range(600)])
    for r in index.candidates(points.where("id < 5"), 6, 8, True).collect():
        assert abs(r["d2"] - ((x[r["id"]] - decoded[r["nbr"]]) ** 2).sum()) < 1e-6
    few = index.candidates(points.where("id < 5"), 6, 8, True).groupBy("id").count().collect()
    assert [r["count"] for r in few] == [6] * 5


def test_stored_index_finds_what_it_found(spark, points, x, tmp_path):
    index = ivf.IvfIndex.build(points, 16, 8, 8)
    asked = S.from_array(spark, x[:40] + np.float32(0.01)).withColumn("id", F.col("id") + 9000)
    found = index.search(asked, 10, 6).select("id", "rank", "nbr")
    want = exact.query_knn(points, asked, 600, 10)
    assert evaluate.recall_at_k(found, want, 10).first()["recall"] >= 0.9
    index.save(f"file://{tmp_path}/ivf")
    again = ivf.IvfIndex.load(spark, f"file://{tmp_path}/ivf")
    assert sorted(map(tuple, again.search(asked, 10, 6).select("id", "rank", "nbr").collect())) == sorted(map(tuple, found.collect()))
    assert 0 < index.share(asked, 2) < index.share(asked, 6) <= 1 and index.share(asked, 8) == 1


def test_packed_codes_are_the_codes(spark, points):
    spans = quantize.ranges(points)
    ints = {r["id"]: r["codes"] for r in quantize.encode(points, spans).collect()}
    assert {r["id"]: list(bytes(r["code"])) for r in quantize.encode_packed(points, spans).collect()} == ints


@pytest.mark.parametrize("k", [5, 12])
def test_descent_finds_the_neighbours(spark, points, k):
    found = descent.self_knn(points, 600, k, 20).cache()
    assert evaluate.recall_at_k(found, exact.self_knn(points, 600, k), k).first()["recall"] >= 0.97
    assert tuple(evaluate.contract(found, k).first()) == (600, 0, 0, 0, 0, 0)


def test_descent_of_few_and_of_equal_points(spark):
    few = S.from_array(spark, np.arange(8, dtype=np.float32)[:, None])
    assert sorted(map(tuple, descent.self_knn(few, 8, 3).collect())) == sorted(map(tuple, exact.self_knn(few, 8, 3).collect()))
    equal = S.from_array(spark, np.ones((120, 3), np.float32))
    found = descent.self_knn(equal, 120, 4, 8)
    assert found.agg(F.max("dist")).first()[0] == 0 and found.count() == 120 * 5
    one = S.from_array(spark, np.ones((1, 3), np.float32))
    assert [tuple(r) for r in descent.self_knn(one, 1, 4).collect()] == [(0, 0, 0, 0.0)]


def plain_scale(d, k, steps=64):
    rho = min((v for v in d if v > 0), default=0.0)
    lo, hi, mid = 0.0, np.inf, 1.0
    for _ in range(steps):
        if sum(np.exp(-max(v - rho, 0) / mid) for v in d) > np.log2(k + 1):
            hi = mid
        else:
            lo = mid
        mid = mid * 2 if np.isinf(hi) else (lo + hi) / 2
    return rho, mid


def test_connectivities_match_plain_ones(spark, points):
    k = 6
    knn = exact.self_knn(points.where("id < 150"), 150, k).cache()
    near = {i: [] for i in range(150)}
    for r in knn.where("id <> nbr").collect():
        near[r["id"]].append((r["nbr"], r["dist"]))
    w = {}
    for i, own in near.items():
        rho, sigma = plain_scale([d for _, d in own], k)
        w |= {(i, j): 1.0 if d <= rho else float(np.exp(-(d - rho) / sigma)) for j, d in own}
    want = {(i, j): w.get((i, j), 0) + w.get((j, i), 0) - w.get((i, j), 0) * w.get((j, i), 0) for i, j in {*w, *((j, i) for i, j in w)}}
    got = {(r["row"], r["col"]): r["weight"] for r in fuzzy.connectivities(knn, k).collect()}
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 for e in want)
    assert all(abs(got[j, i] - v) < 1e-12 for (i, j), v in got.items())


def test_scales_of_equal_and_short_rows(spark):
    rows = [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (1, 1, 0, 0.0), (1, 2, 2, 2.0), (2, 1, 0, 1.0)]
    knn = spark.createDataFrame(rows, "id long, rank long, nbr long, dist double")
    got = {r["id"]: (r["rho"], r["sigma"]) for r in fuzzy.scales(knn, 2).collect()}
    assert got[0][0] == 0 and got[1][0] == 2.0 and got[2][0] == 1.0 and all(s > 0 for _, s in got.values())
    assert {r["weight"] for r in fuzzy.connectivities(knn, 2).where("row = 0 and col = 1").collect()} == {1.0}
    assert fuzzy.connectivities(knn.limit(0), 2).count() == 0


def plain_modularity(edges, label):
    total = sum(edges.values())
    inner = sum(w for (i, j), w in edges.items() if label[i] == label[j])
    sums = {}
    for (i, _), w in edges.items():
        sums[label[i]] = sums.get(label[i], 0) + w
    return inner / total - sum(s * s for s in sums.values()) / total**2


def test_communities_of_linked_cliques(spark):
    """Eight cliques in a ring: the communities are the cliques, as any split or merger of these has less modularity."""
    edges = {}
    for c in range(8):
        members = range(10 * c, 10 * c + 6)
        edges |= {(i, j): 1.0 for i in members for j in members if i != j}
        a, b = 10 * c, (10 * c + 11) % 80
        edges |= {(a, b): 0.5, (b, a): 0.5}
    frame = spark.createDataFrame([(i, j, w) for (i, j), w in edges.items()], "src long, dst long, weight double")
    found = {r["node"]: r["label"] for r in communities.communities(frame).collect()}
    assert found == {i: i - i % 10 for i, _ in edges}
    got = communities.modularity(frame, spark.createDataFrame(list(found.items()), "node long, label long")).first()[0]
    assert got == pytest.approx(plain_modularity(edges, found))
    assert communities.communities(frame.limit(0)).count() == 0


def test_communities_of_a_graph_are_those_of_its_clusters(spark, points):
    """Communities of connectivities agree with the six clusters that the points came from, by approximate neighbours."""
    k = 10
    truth = spark.createDataFrame([(i, i // 100) for i in range(600)], "node long, cluster long")
    edges = fuzzy.connectivities(descent.self_knn(points, 600, k, 20), k).select(F.col("row").alias("src"), F.col("col").alias("dst"), "weight")
    found = communities.communities(edges)
    assert evaluate.adjusted_rand(found.join(truth, "node"), "label", "cluster").first()["ari"] >= 0.9


def test_single_precision_chooses_what_doubles_choose():
    rng = np.random.default_rng(3)
    ids = rng.permutation(900)
    for scale, shift in ((1.0, 0.0), (1e-3, 100.0), (1e25, 0.0)):
        x = rng.standard_normal((900, 8)) * scale + shift
        x[100:500] = x[7]
        x[500:600, 0] = np.nextafter(x[7, 0], np.inf)  # equal in single precision
        row, col, d2 = blocks.Block(ids, x).nearest(ids[:64], x[:64], 12, True)
        want = ((x[:64, None] - x[None]) ** 2).sum(2)
        want[np.arange(64), np.arange(64)] = np.inf
        order = np.array([np.lexsort((ids, w))[:12] for w in want])
        assert (row.reshape(64, 12) == np.arange(64)[:, None]).all() and (col.reshape(64, 12) == order).all()
        assert (d2.reshape(64, 12) == np.take_along_axis(want, order, 1)).all()


@pytest.mark.parametrize("keep_codes,norm_mode", [(False, "exact"), (True, "exact"), (True, "bf16")])
def test_large_leaves_in_blocks_are_the_same(spark, points, monkeypatch, keep_codes, norm_mode):
    """A leaf went whole into one task, whatever its size."""
    leaves = points.withColumn("leaf_id", F.when(F.col("id") < 400, F.col("id") % 3).otherwise(F.lit(7)))
    leaves = leaves.unionByName(leaves.where("id < 90").withColumn("leaf_id", F.lit(7)))  # points of two leaves
    ways = lambda: sorted(map(tuple, candidates.leaf_pairs(leaves, candidates.hyperplanes(8, points.first()["vec"].__len__()), 9, keep_codes, norm_mode).collect()))
    whole = ways()
    tasks = []
    monkeypatch.setattr(candidates, "LEAF_ROWS", 100)
    monkeypatch.setattr(candidates, "join_blocks", lambda *a, **kw: tasks.append(1) or blocks.join_blocks(*a, **kw))
    assert ways() == whole and tasks


def test_lists_lengthen_until_a_sample_finds_its_neighbours(spark):
    """Points that hardly cluster: lists of 10 held too few of the neighbours."""
    many = S.from_array(spark, np.random.default_rng(5).standard_normal((1200, 32)).astype(np.float32)).cache()
    want = exact.self_knn(many, 1200, 10).cache()
    share = lambda found: evaluate.recall_at_k(found, want, 10).first()["recall"]
    assert share(descent.nearest_lists(many, 1200, 10)) < 0.9 and share(descent.self_knn(many, 1200, 10, 10)) >= 0.95


def test_meetings_of_blocks_are_those_of_all_pairs(spark, monkeypatch):
    """A vector travelled with each member of each list; now lists carry ids, and tasks hold blocks of points, one or two."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 5, (90, 3)).astype(float)
    far = {i: float(rng.integers(4, 20)) if i % 3 else np.inf for i in range(90)}
    members = {(at, int(u)): bool(rng.random() < 0.4) for at in range(25) for u in rng.choice(90, 9, replace=False)}
    table = spark.createDataFrame([(i, x[i].tolist(), far[i]) for i in range(90)], "u long, vec array<double>, far double")
    rows = spark.createDataFrame([(at, u, new) for (at, u), new in members.items()], "at long, u long, new boolean")
    want: dict[int, set] = {}
    for (at, u), new in members.items():
        for (b, v), other in members.items():
            if at == b and u != v and (new or other) and (d := float(((x[u] - x[v]) ** 2).sum())) <= far[u]:
                want.setdefault(u, set()).add((d, v))
    for gathered in (descent.GATHERED, 50):
        monkeypatch.setattr(descent, "GATHERED", gathered)
        for blocks_ in (1, 3):
            got: dict[int, set] = {}
            for r in descent._meetings(rows, table, 90, 4, blocks_).collect():
                got.setdefault(r["id"], set()).add((r["d2"], r["nbr"]))
            assert all(got[u] <= own for u, own in want.items()) and got.keys() == want.keys()
            assert all(sorted(got[u])[:4] == sorted(own)[:4] for u, own in want.items())


def test_longer_lists_go_on_from_shorter_ones(spark):
    many = S.from_array(spark, np.random.default_rng(6).standard_normal((900, 24)).astype(np.float32)).cache()
    short = descent.nearest_lists(many, 900, 10, rounds=1)
    longer = descent.nearest_lists(many, 900, 20, rounds=0, lists=short)
    assert short.join(longer, ["id", "nbr"], "left_anti").count() == 0 and longer.groupBy("id").count().where("count <> 20").count() == 0
