import math

import pytest
from pyspark.sql import functions as F

from scour.operators import splits


def _ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "k")


@pytest.mark.parametrize("n", [10, 11, 101])
def test_train_test_sizes(spark, n):
    out = splits.train_test_split(_ids(spark, n), 0.2, key="k")
    assert out.where(F.col("split") == "test").count() == math.ceil(0.2 * n)
    assert out.count() == n


@pytest.mark.parametrize("n,k", [(10, 2), (11, 3), (101, 10)])
def test_kfold_sizes_disjoint_complete(spark, n, k):
    out = splits.kfold(_ids(spark, n), k, key="k")
    sizes = {r["fold"]: r["rows"] for r in splits.split_counts(out, "fold").collect()}
    assert [sizes[i] for i in range(1, k + 1)] == splits.fold_sizes(n, k)
    assert out.select("k").distinct().count() == n


def test_rejects_bad_arguments(spark):
    with pytest.raises(ValueError):
        splits.train_test_split(_ids(spark, 20), 0.5, key="k")
    with pytest.raises(ValueError):
        splits.kfold(_ids(spark, 20), 11, key="k")
    with pytest.raises(ValueError):
        splits.kfold(_ids(spark, 5), 3, key="k")
    with pytest.raises(ValueError):
        splits.train_test_split(_ids(spark, 9), 0.2, key="k")


def test_duplicate_keys_split_exactly(spark):
    # many rows share one key: the tie group straddling the split point is ordered by content
    df = spark.range(60).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    out = splits.train_test_split(df, 0.25, key="k")
    assert out.where(F.col("split") == "test").count() == 15


def test_percent_split_and_stratified(spark):
    df = _ids(spark, 50)
    out = splits.percent_split(df, 80, key="k")
    assert out.where(F.col("split") == "train").count() == 40
    strat = spark.range(30).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    s = splits.stratified_split(strat, "y", 0.2, key="k")
    got = {(r["y"], r["split"]): r["n"] for r in s.groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    assert got[(1, "test")] == 2 and got[(0, "test")] == 4
