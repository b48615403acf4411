"""Top-k and forest search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.llm import ann_forest, exact_topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [None if e is None else float(e) for e in v], "s") for i, v in zip(ids, x, strict=True)], SCHEMA).repartition(3)


def brute(x, ids, k, every, score):
    out = []
    for i in np.flatnonzero(ids % every == 0):
        s = score(x, x[i])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), r + 1, int(ids[j]), s[j]) for r, j in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["gaussian", "low rank", "unequal lengths", "ties", "large"])
def test_top_k_is_exact(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 12)).astype(np.float32)
    if kind == "low rank":
        x = (rng.standard_normal((700, 3)) @ rng.standard_normal((3, 12))).astype(np.float32)
    if kind == "unequal lengths":
        x *= np.exp(rng.standard_normal((700, 1)) * 2).astype(np.float32)
    if kind == "ties":
        x = rng.integers(-1, 2, (700, 12)).astype(np.float32)
        x[:250] = x[0]
    if kind == "large":
        x *= np.float32(3e5)
    ids = rng.permutation(700)
    q = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    want = brute(q, ids, 10, 100, lambda a, b: (a * b).sum(1))
    got = exact_topk.top_k_embeddings(frame(spark, x, ids)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == want


def test_top_k_odd_rows(spark):
    rows = [[1, 2], None, [1, None], [float("nan"), 1], [float("inf"), 0], [], [3, 1], [0, 0], [1, 2, 3]]
    df = frame(spark, rows, [0, 1, 2, 3, 4, 5, 100, 7, 200]).union(frame(spark, [[1, 2]], [0]))  # a repeated row
    got = sorted(map(tuple, exact_topk.top_k_embeddings(df).collect()))
    m = 1024 * 1024
    assert got == [(0, 1, 100, 5 * m), (0, 2, 7, 0), (100, 1, 0, 5 * m), (100, 2, 7, 0)]
    assert exact_topk.top_k_embeddings(frame(spark, [])).count() == 0


def test_buckets_prune_without_loss(spark):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((900, 8)) * np.exp(rng.standard_normal((900, 1)))).astype(np.float32)
    rows = frame(spark, x).select(F.col("vec_id").alias("id"), exact_topk.quantized(F.col("embedding")).alias("vec"))
    got = exact_topk.top_k(rows, F.col("id") % 50 == 0, 7, buckets=9).collect()
    q = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    assert sorted(map(tuple, got)) == brute(q, np.arange(900), 7, 50, lambda a, b: (a * b).sum(1))


def test_parts_of_queries_lose_nothing(spark, monkeypatch):
    from vecloom.llm import vectors

    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 8)).astype(np.float32)
    whole = [sorted(map(tuple, f(frame(spark, x)).collect())) for f in (lambda d: exact_topk.top_k_embeddings(d, every=3), lambda d: ann_forest.search_embeddings(d, every=3))]
    monkeypatch.setattr(vectors, "QUERY_PART", 30)
    parted = [sorted(map(tuple, f(frame(spark, x)).collect())) for f in (lambda d: exact_topk.top_k_embeddings(d, every=3), lambda d: ann_forest.search_embeddings(d, every=3))]
    assert parted == whole


def test_forest_recall_and_scores(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows], np.float64), np.array([r["vec_id"] for r in rows])
    want = brute(x, ids, 20, 20, lambda a, b: (a * b).sum(1))
    got = [tuple(r) for r in ann_forest.search_embeddings(df).collect()]
    found = {(q, v): s for q, _, v, s in got}
    assert np.mean([(q, v) in found for q, _, v, _ in want]) >= 0.9
    exact = {i: v for i, v in zip(ids, x, strict=True)}
    assert all(abs(s - (exact[q] * exact[v]).sum()) < 1e-12 for (q, v), s in found.items())


def test_forest_recall_of_a_larger_table(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((9000, 32)).astype(np.float32)
    x[:3000] = x[0]  # a third of all rows are one vector
    got = {}
    for r in ann_forest.search_embeddings(frame(spark, x), every=900).collect():
        got.setdefault(r["query_id"], []).append(r["score"])
    y = x.astype(np.float64)
    shares = []
    for i in range(0, 9000, 900):
        s = np.delete(y @ y[i], i)
        kth = np.sort(s)[-20]
        assert len(got[i]) == 20 and got[i] == sorted(got[i], reverse=True)
        shares.append(np.mean(np.array(got[i]) >= kth - 1e-9))
    assert np.mean(shares) >= 0.9


def test_forest_odd_rows(spark):
    df = frame(spark, [[1, 2], None, [1, None], [float("nan"), 1], [0, 0], [3, 1], [1, 2, 3], [2, 2]], [0, 1, 2, 3, 4, 20, 6, 7])
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann_forest.search_embeddings(df).collect())
    assert got == [(0, 1, 7, 6.0), (0, 2, 20, 5.0), (20, 1, 7, 8.0), (20, 2, 0, 5.0)]
    assert ann_forest.search_embeddings(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("trees", "leaf_rows", "effort"), [(8, 64, 0.1), (1, 16, 0.01)])
def test_forest_returns_k_rows_of_every_query(spark, trees, leaf_rows, effort):
    x = np.random.default_rng(5).standard_normal((2000, 16)).astype(np.float32)
    rows = frame(spark, x).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    got = {}
    for r in ann_forest.search(rows, F.col("id") % 20 == 0, 20, trees, leaf_rows, effort).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sorted(got) == list(range(0, 2000, 20)) and {len(v) for v in got.values()} == {20}
    y = x.astype(np.float64)
    want = brute(y, np.arange(2000), 20, 20, lambda a, b: a @ b)
    assert np.mean([v in got[q] for q, _, v, _ in want]) < 1


def test_forest_ties_go_to_smaller_ids(spark, monkeypatch):
    kernels, by_cell = [], ann_forest.by_cell
    monkeypatch.setattr(ann_forest, "by_cell", lambda kernel, *a: kernels.append(kernel) or by_cell(kernel, *a))
    rng = np.random.default_rng(6)
    ann_forest.search_embeddings(frame(spark, rng.standard_normal((40, 64)), range(40)))
    # the smallest ids lie last, where a matrix product rounds otherwise
    x, q = np.repeat(rng.standard_normal((1, 64)), 3003, 0), rng.standard_normal((200, 64))
    found = list(kernels[0](np.arange(3003)[::-1], x, np.arange(5000, 5200), q, np.full(200, -np.inf)))
    rows = [r for batch in found for r in batch.to_pylist()]
    for i in range(5000, 5200):
        own = [r for r in rows if r["query_id"] == i]
        best = sorted(own, key=lambda r: (-r["score"], r["vec_id"]))[:20]
        assert [r["vec_id"] for r in best] == list(range(20)) and len({r["score"] for r in own}) == 1
