"""Imputation by nearest rows against a comparison of all pairs; hot points, missing columns, clashing names."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scour.operators import neighbours, steps
from scour.plans.recipe import Recipe


def _plain(rows, donors, cols, k, scale):
    """Fills of all missing values by comparing every pair."""
    m = len(cols)
    present = [[None if v is None or not math.isfinite(v) else v for v in r] for r in donors]
    out = {}
    for i, r in enumerate(rows):
        r = [None if v is None or not math.isfinite(v) else v for v in r]
        for t in range(m):
            if r[t] is not None:
                continue
            near = []
            for d in present:
                both = [j for j in range(m) if r[j] is not None and d[j] is not None]
                if d[t] is None or not both:
                    continue
                total = 0.0
                for j in both:
                    diff = r[j] / scale[j] - d[j] / scale[j]
                    total += diff * diff
                near.append((total * (m / len(both)), d[t]))
            near.sort()
            if near:
                last = near[min(k, len(near)) - 1][0]
                values = [v for d, v in near if d <= last]
                out[i, t] = sum(values) / len(values)
            else:
                have = [d[t] for d in present if d[t] is not None]
                out[i, t] = float(np.median(have)) if have else None
    return out


def _check(spark, rows, cols, k=5, scaled=True, **limits):
    schema = "id int, " + ", ".join(f"{c} double" for c in cols)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema).repartition(5)
    got = {r.id: r[1:] for r in neighbours.knn_impute(df, cols, k=k, scaled=scaled, **limits).collect()}
    assert len(got) == len(rows)
    scale = neighbours._scales(df, cols) if scaled else [1.0] * len(cols)
    want = _plain(rows, rows, cols, k, scale)
    for i, r in enumerate(rows):
        for t, v in enumerate(r):
            if v is not None and not math.isnan(v):
                assert got[i][t] == v
            elif want[i, t] is None:
                assert got[i][t] is None
            else:
                assert math.isclose(got[i][t], want[i, t], rel_tol=1e-9, abs_tol=1e-12), (i, t)


def _random(n, m, share, seed, digits=None):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(6, m)) * 10
    x = centre[r.integers(0, 6, n)] + r.normal(size=(n, m))
    x = x if digits is None else np.round(x, digits)
    return [tuple(None if lost else float(v) for v, lost in zip(a, b, strict=True)) for a, b in zip(x, r.random((n, m)) < share, strict=True)]


def test_equals_all_pairs_on_2000_rows_with_a_third_missing(spark):
    _check(spark, _random(2000, 4, 0.3, 1), ["a", "b", "c", "d"])


def test_ties_hot_points_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "PIVOTS", 9)
    rows = _random(300, 3, 0.3, 2, digits=0)
    rows += [(1.0, 2.0, 3.0)] * 150 + [(1.0, None, 3.0)] * 40
    _check(spark, rows, ["a", "b", "c"], k=3, scaled=False)


def test_rare_patterns_are_compared_without_bounds(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PATTERNS", 2)
    _check(spark, _random(250, 4, 0.4, 3), ["a", "b", "c", "d"], k=4)


def test_edge_values(spark):
    inf, nan = float("inf"), float("nan")
    _check(spark, [(None, None), (1.0, None), (nan, 2.0), (inf, 3.0), (5.0, 4.0), (5.0, -inf), (-0.0, 1.0), (0.0, None)], ["a", "b"], k=2)
    _check(spark, [(None, 1.0), (None, 2.0)], ["a", "b"])  # no value at all: stays missing
    _check(spark, [(1.0, None), (None, 2.0)], ["a", "b"])  # no row shares a column: the median
    _check(spark, [(1e300, None), (-1e300, 2.0), (1e308, 3.0)], ["a", "b"], k=1, scaled=False)  # distances overflow


def test_other_columns_targets_types_and_empty(spark):
    df = spark.createDataFrame([(1, "x", 1, 10, 1.0), (2, None, 2, None, 2.0), (3, "z", 3, 30, None)], "v int, `row` string, `a.b` int, fills bigint, q double")
    out = neighbours.knn_impute(df, ["a.b", "fills", "q"], ["fills"], k=1, scaled=False)
    assert out.columns == df.columns and dict(out.dtypes)["fills"] == "double" and dict(out.dtypes)["a.b"] == "int"
    got = {r.v: tuple(r) for r in out.collect()}
    assert got[2][3] == 20.0 and got[2][1] is None and got[3][4] is None  # a tie: (1 + 1) * 3/2 and 1 * 3/1
    assert neighbours.knn_impute(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        neighbours.knn_impute(df, ["q"], ["v"])


def test_step_and_replay_on_new_rows(spark):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(20)] + [(3.2, None)], "x double, y double")
    step = {"column": "y", "action": "impute", "method": "knn", "params": {"columns": ["x"], "k": 1}}
    out, skipped, acts = steps.apply_steps(df, [step])
    assert not skipped and out.where("x = 3.2").first().y == 9.0 and out.where(F.col("y").isNull()).count() == 0
    assert acts[0]["columns"] == ["y", "x"] and acts[0]["k"] == 1
    r = Recipe()
    r.add("steps", {"actions": [{k: v for k, v in acts[0].items() if k != "_dictionary"}]})
    r.dictionaries["step:y"] = acts[0]["_dictionary"]
    new = spark.createDataFrame([(7.1, None), (100.0, 5.0)], "x double, y double")
    assert sorted(map(tuple, r.apply(new).collect())) == [(7.1, 49.0), (100.0, 5.0)]
