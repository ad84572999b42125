"""Path lengths against a plain walk, planted outliers, missing and extreme values."""

import math

import numpy as np
from pyspark.sql import functions as F

from scour.operators import isolation, steps
from scour.plans.recipe import Recipe


def _frame(spark, n=600):
    r = np.random.default_rng(4)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.normal(size=(n, 2)))]
    rows += [(1000 + i, 8.0 + i, -9.0) for i in range(4)]
    return spark.createDataFrame(rows, "id int, x double, y double")


def _walk(forest, row):
    total = 0.0
    for at in forest["roots"]:
        while forest["feature"][at] >= 0:
            v = row[forest["feature"][at]]
            at = forest["left"][at] if v is not None and v < forest["cut"][at] else forest["right"][at]
        total += forest["path"][at]
    return 2.0 ** (-total / len(forest["roots"]) / isolation.mean_path(forest["sample"]))


def test_scores_equal_a_plain_walk_and_find_planted_rows(spark):
    df = _frame(spark)
    forest = isolation.fit_isolation(df, ["x", "y"], trees=50)
    other = isolation.fit_isolation(df.repartition(7), ["x", "y"], trees=50)
    assert forest == other  # the layout doesn't matter
    got = isolation.isolation_score(df, forest).collect()
    for r in got[::40]:
        assert math.isclose(r.isolation_score, _walk(forest, (r.x, r.y)), rel_tol=1e-12)
    top = sorted(got, key=lambda r: -r.isolation_score)[:4]
    assert {r.id for r in top} == {1000, 1001, 1002, 1003}
    usual = np.median([r.isolation_score for r in got])
    assert usual < 0.5 < min(r.isolation_score for r in top)


def test_missing_extreme_constant_and_empty(spark):
    rows = [(None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0), (-1e308, 1.0), (1e308, 1.0)] * 3 + [(0.5, 1.0)] * 300
    df = spark.createDataFrame(rows, "x double, isolation_score double")
    out = isolation.isolation_outliers(df, ["x"], trees=20)
    assert out.columns == ["x", "isolation_score", "isolation_flag"]
    assert out.where(F.col("isolation_score").isNull() | F.isnan("isolation_score")).count() == 0 and out.count() == len(rows)
    flat = isolation.isolation_outliers(spark.createDataFrame([(1.0,)] * 40, "x double"), ["x"])
    assert flat.select("isolation_score").distinct().count() == 1 and flat.agg(F.sum("isolation_flag")).first()[0] == 0
    assert isolation.isolation_outliers(df.limit(0), ["x"]).count() == 0
    assert isolation.isolation_outliers(df.limit(1), ["x"]).first().isolation_score == 0.5


def test_step_and_replay(spark):
    df = _frame(spark)
    out, _, acts = steps.apply_steps(df, [{"column": "x", "action": "outliers", "method": "isolation", "params": {"columns": ["y"]}}])
    assert {r.id for r in out.where("x_isolation_flag = 1").collect()} >= {1000, 1001, 1002, 1003}
    r = Recipe()
    r.add("steps", {"actions": acts})
    again = Recipe.from_json(r.to_json()).apply(df)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
