"""Held-out queries that arrive as a stream: stateless, so each micro-batch is a k-NN join against a fixed index."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vecloom.plans.index import VectorIndex


def query_stream(index: VectorIndex, queries: DataFrame, sink, k: int = 10, beam: int = 64, id_col: str = "vec_id", vec_col: str = "embedding"):
    """A started-able writer: sink(found, batch number) gets (id, rank, nbr, dist) of each micro-batch; empty ones are left out."""

    def each(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            sink(index.query(rows, k, beam, id_col, vec_col), number)

    return queries.writeStream.foreachBatch(each)
