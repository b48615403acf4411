"""Measuring: cold and warm times, sweeps of search width against recall, and the strategies by name."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from statistics import median

from pyspark.sql import DataFrame, SparkSession

from vecloom.operators.evaluate import recall_at_k
from vecloom.plans.index import VectorIndex, self_knn
from vecloom.plans.params import BuildParams, HnswParams, SearchParams

#: Self-kNN by name: (df, k, build parameters) -> (id, rank, nbr, dist).
STRATEGIES: dict[str, Callable[[DataFrame, int, BuildParams], DataFrame]] = {
    name: (lambda df, k, params, name=name: self_knn(df, k, params=params, search_params=SearchParams(strategy=name)))
    for name in ("exact", "beam", "warm", "reservoir", "hnsw", "ivf")
} | {"hnsw-sq8": lambda df, k, params: self_knn(df, k, params=params, search_params=SearchParams(strategy="hnsw"), hnsw_params=HnswParams(quantize="sq8"))}


def timed(make: Callable[[], DataFrame], repeats: int = 3) -> dict[str, float]:
    """Seconds of the first run (cold), and the least and the median of the repeats (warm); rows go to Spark's noop sink."""
    times = []
    for _ in range(repeats + 1):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - began)
    warm = times[1:] or times
    return {"cold": times[0], "warm": min(warm), "median": median(warm)}


def compare(df: DataFrame, k: int, names: Iterable[str], params: BuildParams | None = None, repeats: int = 2) -> DataFrame:
    """(strategy, cold, warm, median, recall) against the exact join."""
    params = params or BuildParams()
    exact = STRATEGIES["exact"](df, k, params)
    rows = []
    for name in names:
        t = timed(lambda name=name: STRATEGIES[name](df, k, params), repeats)
        rows.append((name, t["cold"], t["warm"], t["median"], recall_at_k(STRATEGIES[name](df, k, params), exact, k).first()["recall"]))
    return df.sparkSession.createDataFrame(rows, "strategy string, cold double, warm double, median double, recall double")


def sweep(spark: SparkSession, base: DataFrame, queries: DataFrame, exact: DataFrame, k: int, beams: Iterable[int], runs: Iterable[int] = (1,), params: BuildParams | None = None) -> DataFrame:
    """(runs, beam, build_seconds, queries_per_second, recall): what each width of search gains and costs."""
    n, rows = queries.count(), []
    for r in runs:
        began = time.perf_counter()
        index = VectorIndex.build(base, params=(params or BuildParams()).with_(runs=r))
        built = time.perf_counter() - began
        for beam in beams:
            t = timed(lambda index=index, beam=beam: index.query(queries, k, beam), 1)["warm"]
            rows.append((r, beam, built, n / t, recall_at_k(index.query(queries, k, beam), exact, k).first()["recall"]))
    return spark.createDataFrame(rows, "runs long, beam long, build_seconds double, queries_per_second double, recall double")
