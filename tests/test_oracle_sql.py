"""Every oracle SQL text runs on DuckDB over the sf0.001 tables and names its
columns like the Spark query (checked for a subset in test_pipeline)."""

import duckdb
import pytest

from contrail.plans.registry import all_oracle

TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def con(smoke_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{smoke_dir}/{t}.parquet')")
    return c


def test_all_oracle_sql_runs(con):
    bad = {}
    for name, sql in all_oracle().items():
        try:
            rel = con.sql(sql)
            cols = rel.columns
            rel.fetchall()
            assert len(cols) == len(set(cols)), "duplicate column names"
        except Exception as e:  # noqa: BLE001
            bad[name] = str(e)[:200]
    assert not bad, bad
