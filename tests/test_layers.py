import pytest
from pyspark.sql import functions as F

from scour.operators import consistency, features, missing, outliers, steps


def test_missing_layer_drop_indicator_fill(spark):
    rows = [(1.0, None, "a"), (None, None, "b"), (3.0, None, None), (5.0, 1.0, "b")]
    df = spark.createDataFrame(rows, "x double, sparse double, s string")
    p = missing.fit_missing(df)
    assert [d["column"] for d in p["dropped_columns"]] == ["sparse"]
    out = missing.apply_missing(df, p)
    assert out.columns == ["x", "s", "x_was_missing", "s_was_missing"]
    vals = out.orderBy("x_was_missing", "x").collect()
    assert [r["x"] for r in vals] == [1.0, 3.0, 5.0, 3.0]
    assert out.where(F.col("s").isNull()).count() == 0
    assert out.where(F.col("s_was_missing") == 1).collect()[0]["s"] == "b"


def test_all_missing_text_gets_unknown(spark):
    df = spark.createDataFrame([(None,), (None,)], "s string")
    assert [r[0] for r in missing.basic_impute(df).collect()] == ["unknown", "unknown"]


def test_clip_swaps_crossing_bounds_but_flag_does_not(spark):
    vals = [-100.0, -90.0, -80.0, -70.0, -60.0, -50.0, -400.0]
    df = spark.createDataFrame([(v,) for v in vals], "amount double")
    p = outliers.fit_outliers(df)
    a = p["actions"][0]
    assert a["lower"] == 0.0 and a["upper"] < 0
    out = outliers.apply_outliers(df, p).collect()
    lo, hi = a["upper"], a["lower"]
    assert all(lo <= r["amount"] <= hi for r in out)
    assert all(r["amount_outlier_flag"] == 1 for r in out)  # every value is below lower = 0


def test_constant_columns_and_rules(spark):
    rows = [(1, None, "k", -3.0, 150.0), (1, None, "k", 5.0, 50.0), (1, None, "k", 5.0, 50.0)]
    df = spark.createDataFrame(rows, "c int, allnull string, same string, price double, rate double")
    p = consistency.fit_consistency(df)
    assert p["duplicates_removed"] == 1
    assert set(p["constant_columns_dropped"]) == {"c", "allnull", "same"}
    out = consistency.apply_consistency(df, p).orderBy("price").collect()
    assert [r["price"] for r in out] == [0.0, 5.0]
    assert [r["rate"] for r in out] == [100.0, 50.0]


def test_minmax_constant_and_normalize_all(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "k double, v double")
    out, _ = steps.scale_minmax(df, "k")
    assert [r["k"] for r in out.collect()] == [0.0, 0.0]
    out2, done = steps.normalize_all(df)
    assert done == ["v"] and sorted(r["k"] for r in out2.collect()) == [2.0, 2.0]
    std, p = steps.scale_standard(df, "k")
    assert p["scale"] == 1.0


def test_one_hot_and_factorize(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "s string")
    oh = features.one_hot(df, "s")
    assert oh.columns == ["s_a", "s_b", "s_c"]
    assert oh.where(~F.col("s_a") & ~F.col("s_b") & ~F.col("s_c")).count() == 1
    codes = sorted((r["s"] for r in features.factorize(df, "s").collect()))
    assert codes == [-1, 0, 1, 2]
    lab = sorted(r["s"] for r in features.label_encode(df, "s").collect())
    assert lab == [0, 1, 2, 3]  # missing is the class 'nan', after 'c'


def test_unknown_step_column_is_logged(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    out, skipped, acts = steps.apply_steps(df, [{"column": "nope", "action": "impute", "method": "mean"}])
    assert [x.column for x in skipped] == ["nope"] and not acts


def test_factorize_first_appearance(spark):
    df = spark.createDataFrame([(1, "z"), (2, "a"), (3, "z"), (4, None), (5, "m")], "t int, s string")
    out = {r["t"]: r["s"] for r in features.factorize(df, "s", order_by="t").collect()}
    assert out == {1: 0, 2: 1, 3: 0, 4: -1, 5: 2}


def test_token_keyword_match():
    from scour.functions import vocab
    assert vocab.name_has("percentage", vocab.POSITIVE_KEYWORDS)  # substring: 'age'
    assert not vocab.name_has("percentage", vocab.POSITIVE_KEYWORDS, match="token")
    assert vocab.name_has("buyer_age", vocab.POSITIVE_KEYWORDS, match="token")


def test_scaler_is_chosen_by_the_distribution(spark):
    from pyspark.sql import functions as F
    from scour.operators.steps import Step, apply_steps, choose_scalers, scale_auto
    from scour.plans.recipe import _replay_steps
    df = spark.range(4000).select(
        F.col("id").alias("flat"), F.exp(F.col("id") / 400.0).alias("skewed"), F.lit(3.0).alias("same"), F.lit(None).cast("double").alias("none"),
        (F.rand(1) + F.rand(2) + F.rand(3) + F.rand(4) + F.rand(5)).alias("bell"), F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("id")).alias("gaps"))
    want = {"flat": "minmax", "skewed": "robust", "same": "none", "none": "none", "bell": "standard", "gaps": "minmax"}
    assert {c: v["method"] for c, v in choose_scalers(df).items()} == want
    out, chosen = scale_auto(df)
    row = out.agg(F.min("flat"), F.max("flat"), F.round(F.avg("bell"), 9), F.round(F.stddev_pop("bell"), 9), F.min("same"), F.expr("percentile(skewed, 0.5)")).first()
    assert tuple(row)[:5] == (0.0, 1.0, 0.0, 1.0, 3.0) and abs(row[5]) < 1e-12
    # The action holds the choice, so a replay on other rows scales alike.
    done, _, actions = apply_steps(df, [Step(c, "scale", "auto") for c in ("flat", "skewed", "same")])
    assert [a["method"] for a in actions] == ["minmax", "robust", "none"]
    again = _replay_steps(df.where("id % 2 = 0" if "id" in df.columns else "flat % 2 = 0"), {"actions": actions})
    assert again.where("flat > 0.5").count() == done.where("flat > 0.5").count() // 2
