"""One value holds a third of all rows: results stay whole and exact."""

from pyspark.sql import functions as F

from scour.functions import stats
from scour.operators import consistency, features, missing, splits


def _hot(spark, n=3000):
    # a third of the rows carry key 7 and identical content
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("s"),
        F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise(F.col("id") / 7.0).alias("x"))


def test_hot_value_mode_median_and_dedup(spark):
    df = _hot(spark)
    assert stats.modes(df, ["s"])["s"] == "hot"
    xs = sorted(r["x"] for r in df.collect())
    n = len(xs)
    assert stats.medians(df, ["x"])["x"] == (xs[(n - 1) // 2] + xs[n // 2]) / 2
    assert consistency.drop_exact_duplicates(df).count() == 2001


def test_hot_value_factorize_keeps_every_row(spark):
    df = _hot(spark)
    out = features.factorize(df, "s")
    assert out.count() == 3000
    assert out.where(F.col("s") == 0).count() == 1000  # 'hot' sorts first


def test_hot_key_split_is_exact(spark):
    df = _hot(spark)
    out = splits.train_test_split(df, 0.2, key="k")
    assert out.where(F.col("split") == "test").count() == 600
    folds = splits.kfold(df, 3, key="k")
    assert sorted(r["rows"] for r in splits.split_counts(folds, "fold").collect()) == [1000, 1000, 1000]


def test_hot_value_fill(spark):
    df = _hot(spark).select(F.when(F.col("k") == 7, None).otherwise(F.col("s")).alias("s"))
    out = missing.ensure_complete(df)
    assert out.where(F.col("s").isNull()).count() == 0 and out.count() == 3000


def test_hot_key_stratified_split(spark):
    df = _hot(spark).withColumn("y", (F.col("k") % 2).cast("int"))
    out = splits.stratified_split(df, "y", 0.2, key="k")
    got = {r["y"]: r["n"] for r in out.where(F.col("split") == "test").groupBy("y").agg(F.count("*").alias("n")).collect()}
    sizes = {r["y"]: r["n"] for r in df.groupBy("y").agg(F.count("*").alias("n")).collect()}
    import math
    assert got == {y: math.ceil(0.2 * n) for y, n in sizes.items()}
