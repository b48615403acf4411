"""Every query with SQL gives DuckDB's rows."""

import duckdb
import pytest

from vecloom.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (df[columns].sort_values(columns).reset_index(drop=True) for df in (got, want))
    assert len(got) == len(want)
    for c in columns:
        assert (got[c].astype(object) == want[c].astype(object)).all(), c


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 500 * 16
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
