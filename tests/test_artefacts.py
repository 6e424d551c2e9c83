"""One-file extracts and the model bundle: whole, in order, and torn writes are seen."""

import os

import pytest
from pyspark.ml.classification import RandomForestClassifier

from contrail.operators import churn as M
from contrail.plans import bundle as B
from contrail.sources import files


def test_one_csv_file(spark, tmp_path):
    rows = [(i, f'a,"{i}" \\ ß' if i % 3 else None, i / 7) for i in range(1000)]
    df = spark.createDataFrame(rows, 'id long, `na,"me` string, x double').repartition(7)
    path = files.write_one_csv(df, str(tmp_path / "out" / "all.csv"), ["id"])
    assert os.path.isfile(path) and [f for f in os.listdir(tmp_path / "out") if not f.startswith(".")] == ["all.csv"]
    with open(path, encoding="utf-8") as f:
        lines = f.read().splitlines()
    assert len(lines) == 1001 and lines[0].startswith("id,") and lines[1].startswith("0,") and lines[-1].startswith("999,")
    back = spark.read.schema(df.schema).option("header", True).csv(path)
    assert [tuple(r) for r in back.collect()] == rows
    assert spark.read.option("header", True).csv(path).columns == df.columns
    # again at the same place, and without rows
    files.write_one_csv(df.limit(0), path)
    with open(path, encoding="utf-8") as f:
        assert len(f.read().splitlines()) == 1


@pytest.fixture
def saved(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 9), "ab"[i % 2], float(i % 9 > 4)) for i in range(90)], "a double, c string, cancelled double")
    prep = M.preprocessor(["a"], ["c"]).fit(df)
    ready = prep.transform(df)
    model = RandomForestClassifier(labelCol=M.LABEL, numTrees=2, seed=1).fit(ready)
    bundle = B.Bundle(prep, model, ["a", "c"], {"roc_auc": 0.9}, M.feature_names(prep, df=ready))
    return df, B.save(spark, str(tmp_path / "bundle"), bundle, df.schema, "key"), bundle


def test_bundle_round_trip(spark, saved):
    df, path, bundle = saved
    again = B.load(spark, path, "key", df.schema)
    assert (again.columns, again.metrics, again.names) == (bundle.columns, bundle.metrics, bundle.names) and len(again.names) > 2
    score = lambda b: [r["score"] for r in M.with_score(b.model.transform(b.preprocessor.transform(df))).collect()]
    assert score(again) == score(bundle)
    with pytest.raises(B.BundleError, match="exists"):
        B.save(spark, path, bundle, df.schema, "key")


def test_torn_and_foreign_bundles_are_refused(spark, saved):
    df, path, _ = saved
    with pytest.raises(B.BundleError, match="other data"):
        B.load(spark, path, "another")
    with pytest.raises(B.BundleError, match="other columns"):
        B.load(spark, path, "key", df.drop("a").schema)
    data = next(os.path.join(d, f) for d, _, names in os.walk(os.path.join(path, "model")) for f in names if f.endswith(".parquet"))
    with open(data, "rb") as f:
        whole = f.read()
    with open(data, "wb") as f:
        f.write(whole[: len(whole) // 2])
    with pytest.raises(B.BundleError, match="torn"):
        B.load(spark, path, "key")
    os.remove(data)
    with pytest.raises(B.BundleError, match="torn"):
        B.load(spark, path, "key")
    os.remove(os.path.join(path, B.MANIFEST))
    with pytest.raises(B.BundleError, match="no manifest"):
        B.load(spark, path, "key")
