"""Every operator has a query; those with SQL give DuckDB's rows; all return the contract's columns."""

import duckdb
import pytest

from vecloom.llm.queries import oracle_sql, queries

COLUMNS = {
    "op1_": ["query_id", "rank", "vec_id", "score"],
    "op2_": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op3_": ["query_id", "rank", "vec_id", "score"],
    "op4_": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op5_": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op6_": ["doc_id", "fingerprint", "component_id"],
    "op7_": ["page_id", "host", "path", "rule", "verdict"],
    "op8_": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9_": ["doc_id", "held_out", "score", "predicted"],
    "op10_": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op11_": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op12_": ["doc_id", "held_out", "lang_pred", "score"],
    "op13_": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
}


@pytest.mark.parametrize("name", sorted(queries()))
def test_columns_and_rows(spark, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    assert set(COLUMNS[name.split("_")[0] + "_"]) <= set(df.columns)
    number = name[2:].split("_")[0]
    table = "embeddings" if number in ("1", "3") else "pages" if number in ("4", "7") else "documents"
    rows, whole = df.count(), spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    if number == "11":
        assert 0 < rows <= 2000 * df.select("lang").distinct().count()
        return
    assert rows >= whole if table != "embeddings" else rows == {"op1_exact_topk": 50, "op3_ann_forest": 500}[name]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got, want = queries()[name](spark, sf_dir), con.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)
