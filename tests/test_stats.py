import math
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scour.functions import stats


def _frame(spark, values, name="x"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"{name} double")


def test_order_statistics_match_sort(spark):
    rng = np.random.default_rng(7)
    vals = rng.normal(size=20000)
    df = _frame(spark, vals)
    ranks = [0, 1, 4999, 10000, 19998, 19999]
    # few buckets force many passes
    got = stats.order_statistics(df, {"x": F.col("x")}, [("x", r) for r in ranks], bits=4, exact_rows=10)
    s = np.sort(vals)
    for r in ranks:
        assert got[("x", r)] == pytest.approx(s[r], abs=0, rel=0)


def test_order_statistics_with_a_hot_value(spark):
    # one value holds a third of all rows
    vals = [5.0] * 3000 + list(np.arange(6000, dtype=float))
    df = _frame(spark, vals)
    s = np.sort(vals)
    ranks = [0, 2999, 3000, 4500, 8999]
    got = stats.order_statistics(df, {"x": F.col("x")}, [("x", r) for r in ranks], bits=3, exact_rows=5)
    for r in ranks:
        assert got[("x", r)] == s[r]


def test_quantiles_and_median_match_pandas(spark):
    vals = [3.0, 1.0, None, 7.5, 2.0, 2.0, 10.0, float("nan")]
    df = _frame(spark, vals)
    ser = pd.Series(vals, dtype=float)
    q = stats.quantiles(df, ["x"], [0.25, 0.5, 0.75])["x"]
    for got, p in zip(q, [0.25, 0.5, 0.75]):
        assert got == pytest.approx(ser.quantile(p))
    assert stats.medians(df, ["x"])["x"] == pytest.approx(ser.median())


def test_quantiles_all_missing_and_single_row(spark):
    df = spark.createDataFrame([(None, 4.0)], "a double, b double")
    q = stats.quantiles(df, ["a", "b"], [0.25, 0.75])
    assert q["a"] == [None, None]
    assert q["b"] == [4.0, 4.0]


def test_mode_ties_pick_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert stats.modes(df, ["s"])["s"] == "a"
    empty = spark.createDataFrame([(None,)], "s string")
    assert stats.modes(empty, ["s"])["s"] is None


def test_column_counts_samples_and_distinct(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, None), (3, "y")], "a bigint, s string")
    cc = stats.column_counts(df, ["a", "s"], samples=3)
    assert cc["a"].n_distinct == 3 and cc["a"].samples == [1, 1, 2]
    assert cc["s"].n_distinct == 2 and cc["s"].n_values == 3 and cc["s"].top_cnt == 2 and cc["s"].mode == "y"


def test_skew_adjusted_matches_pandas(spark):
    from scour.functions.exprs import skew_adjusted
    vals = [1.0, 2.0, 2.0, 3.0, 10.0, 40.0]
    df = _frame(spark, vals)
    g = df.agg(skew_adjusted(F.count("x"), F.skewness("x"))).collect()[0][0]
    assert g == pytest.approx(pd.Series(vals).skew())
    two = _frame(spark, [1.0, 2.0]).agg(skew_adjusted(F.count("x"), F.skewness("x"))).collect()[0][0]
    assert two is None
    const = _frame(spark, [2.0, 2.0, 2.0]).agg(skew_adjusted(F.count("x"), F.skewness("x"))).collect()[0][0]
    assert const == 0.0 and not math.isnan(const)


def test_distinct_counts_are_exact(spark):
    from scour.functions import stats
    rows = [(None if i % 5 == 0 else i % 3, None if i % 4 == 0 else float("nan") if i % 4 == 1 else (-1) ** i * 0.0, f"{i % 700}" * (i % 40),
             Decimal(i % 11) * Decimal("1e20"), None, [i % 6]) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, `b.c` double, t string, d decimal(38,0), e string, l array<int>")
    got = stats.distinct_counts(df, df.columns)
    assert got == {"a": 3, "b.c": 1, "t": len({r[2] for r in rows}), "d": 11, "e": 0, "l": 6}
    assert stats.distinct_counts(df.limit(0), ["a"]) == {"a": 0} and stats.distinct_counts(df, []) == {}


def test_decisions_are_the_same_with_and_without_metrics(spark):
    from scour.operators.schema import fit_schema
    # the share of distinct values lies a little under and over the threshold of an ID: no estimate would tell them apart
    n = 4000
    for ratio in (0.89, 0.91, 0.94, 0.951, 0.979, 0.985):
        df = spark.createDataFrame([(f"0{i % int(n * ratio):06d}", f"w{i % int(n * ratio)}", i % int(n * ratio)) for i in range(n)], "k string, t string, v int")
        plain, full = fit_schema(df), fit_schema(df, quality=True)
        assert all(plain[x] == full[x] for x in ("conversions", "roles", "type_conversions"))
        assert full["quality"]["k"]["uniqueness"] == int(n * ratio) / n
