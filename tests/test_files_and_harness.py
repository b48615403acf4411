import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import exact
from vecloom.plans import harness
from vecloom.plans import index as I
from vecloom.plans.params import BuildParams
from vecloom.sources import files, sinks
from vecloom.sources import vectors as S


def test_npy_by_ranges(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(0).standard_normal((100, 3)).astype(np.float32)
    np.save(tmp_path / "x.npy", x)
    monkeypatch.setattr(files, "ROWS", 7)
    got = files.from_npy(spark, str(tmp_path / "x.npy"), 50).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in got] == list(range(50)) and np.allclose([r["embedding"] for r in got], x[:50])
    np.save(tmp_path / "flat.npy", x[0])
    with pytest.raises(ValueError):
        files.from_npy(spark, str(tmp_path / "flat.npy"))


def test_npy_folder_round_trip(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(1).standard_normal((100, 3)).astype(np.float32)
    df = spark.createDataFrame([(i * 2, x[i].tolist(), "more") for i in range(100)], "vec_id long, embedding array<float>, text string")
    monkeypatch.setattr(files, "ROWS", 7)
    folder = str(tmp_path / "arrays")
    assert files.to_npy(df.repartition(5), folder) == 100
    got = files.from_npy(spark, folder).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in got] == list(range(100)) and np.array_equal(np.array([r["embedding"] for r in got], np.float32), x)
    assert files.from_npy(spark, folder, 0).count() == 0
    with pytest.raises(FileExistsError):
        files.to_npy(df, folder)
    assert files.to_npy(df.limit(0), str(tmp_path / "empty")) == 0 and files.from_npy(spark, str(tmp_path / "empty")).count() == 0


def test_npy_folder_of_uneven_vectors_is_refused(spark, tmp_path):
    for name, vector in (("null", None), ("short", [1.0])):
        df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, vector), (2, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
        with pytest.raises(Exception, match="one length"):
            files.to_npy(df, str(tmp_path / name))
        with pytest.raises(ValueError, match="finished"):
            files.from_npy(spark, str(tmp_path / name))


def test_json_records_are_merged_as_versions(spark, tmp_path):
    path = str(tmp_path / "records")
    assert sinks.read_json_records(spark, path) is None
    assert sinks.upsert_json(spark.createDataFrame([], "n long, s double"), path, ["n"]) == -1
    assert sinks.upsert_json(spark.createDataFrame([(1, 0.5), (2, 1.0)], "n long, s double"), path, ["n"]) == 0
    assert sinks.upsert_json(spark.createDataFrame([(2, 0.25, "again"), (3, None, "new")], "n long, s double, note string"), path, ["n"]) == 1
    got = sinks.read_json_records(spark, path).orderBy("n").select("n", "s", "note").collect()
    assert [tuple(r) for r in got] == [(1, 0.5, None), (2, 0.25, "again"), (3, None, "new")]
    with pytest.raises(ValueError):
        sinks.upsert_json(spark.range(1).withColumn(sinks.VERSION, F.lit(1)), path, ["id"])


def test_hdf5_is_gated(spark):
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            files.from_hdf5(spark, "absent.h5")


def test_sweep_and_comparison(spark):
    x = S.gaussian_clusters(300, 8, 4, seed=3)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    base, asked = df.where("vec_id >= 30"), df.where("vec_id < 30")
    exact = I.knn_join(base, asked, 5, strategy="exact")
    rows = harness.sweep(spark, base, asked, exact, 5, [8, 64], params=BuildParams(c_max=64)).orderBy("beam").collect()
    assert len(rows) == 2 and rows[1]["recall"] >= 0.9 and rows[1]["queries_per_second"] > 0
    compared = harness.compare(df, 5, ["exact", "ivf"], repeats=1)
    assert compared.where((F.col("strategy") == "exact") & (F.col("recall") == 1)).count() == 1


def test_csr_files_equal_the_arrays(spark, tmp_path):
    x = S.gaussian_clusters(300, 8, 4, seed=3)
    df = S.from_array(spark, x).withColumn("id", F.col("id") * 3 + 5)  # ids with gaps
    knn = exact.self_knn(df, 300, 7)
    folder = f"{tmp_path}/csr"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges, however small
    try:
        assert files.to_csr_npy(knn, folder) == 2400
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for got, want in zip(files.from_csr_npy(folder), sinks.to_csr(knn), strict=True):
        assert (got == want).all()
    assert len([n for n in os.listdir(folder) if n.startswith("data-")]) > 1
    assert files.to_csr_npy(knn.limit(0), f"{tmp_path}/none") == 0
    os.remove(f"{folder}/_SUCCESS")
    with pytest.raises(ValueError):
        files.from_csr_npy(folder)


def test_generated_rows_equal_the_sequential_ones(spark):
    state, plain = 9, []
    for _ in range(50):
        state = (state * S.LCG_MULTIPLIER + S.LCG_INCREMENT) % 2**64
        plain.append((state >> 33) / 2**31)
    assert S.lcg(0, 50, 9).tolist() == plain and S.lcg(17, 20, 9).tolist() == plain[17:37]
    for kind, whole in (("uniform", S.lcg_uniform(100, 6, 3)), ("gaussian", S.lcg_gaussian(100, 6, 3))):
        rows = S.generated(spark, 100, 6, kind, 3, rows=16).orderBy("vec_id").collect()
        assert [r["vec_id"] for r in rows] == list(range(100))
        assert np.array_equal(np.array([r["embedding"] for r in rows], np.float32), whole)
    with pytest.raises(ValueError):
        S.generated(spark, 1, 1, "other")
