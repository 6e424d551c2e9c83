import os

import duckdb
import pytest

import corpus_pipeline
from contrail.llm import queries

from .conftest import HARD, frame


def test_stages_take_hard_rows(spark, hard, smoke_dir):
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, hard, smoke_dir)
        assert out.columns == hard.columns, name
        rows = out.collect()
        ids = [r.doc_id for r in rows]
        assert set(ids) >= {None, 1, 2, 3, 4, 6, 7, 8, 9}, name
        if name == "near_copies":
            assert sorted(i or 0 for i in ids) == [0, 1, 2, 3, 4, 6, 7, 8, 9]
        else:
            assert len(rows) == len(HARD)
    assert {r.doc_id for r in corpus_pipeline.packed(spark, hard, smoke_dir).collect()} == {r[0] for r in HARD}


def test_stages_take_no_rows(spark, empty, smoke_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, smoke_dir).count() == 0


def test_repeated_rows_leave_one(spark, hard, smoke_dir):
    docs = hard.where("doc_id = 5")
    assert docs.count() == 2 and corpus_pipeline.without_near_copies(spark, docs, smoke_dir).count() == 1


def test_unrelated_texts_of_one_id_stay(spark, smoke_dir):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in ((5, one), (5, one + " more"), (5, two), (5, ""), (5, None), (6, two))])
    found = corpus_pipeline.without_near_copies(spark, docs, smoke_dir).collect()
    texts = [r.text for r in found]
    assert all(r.doc_id == 5 for r in found) and len(texts) == 4
    assert sum((t or "").startswith(one) for t in texts) == 1 and {two, "", None} <= set(texts)


def test_run(spark, smoke_dir):
    from contrail.llm.textkit import documents

    kept = {r.doc_id for r in corpus_pipeline.run(spark, smoke_dir).collect()}
    every = {r.doc_id for r in documents(spark, smoke_dir).collect()}
    assert kept < every and len(kept) > 0.6 * len(every)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, smoke_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{os.path.join(smoke_dir, table)}.parquet')")
    expected = con.execute(queries.oracle_sql()[name]).df()
    found = queries.queries()[name](spark, smoke_dir).toPandas()
    key = ["item_id", "rank"] if "rank" in found.columns else [found.columns[0]]
    columns = sorted(found.columns)
    assert sorted(expected.columns) == columns
    a, b = (x[columns].sort_values(key).astype(object).where(x[columns].sort_values(key).notna(), None).values.tolist() for x in (found, expected))
    assert a == b
