from pyspark.sql import functions as F

from scour.operators import splits
from scour.plans import auto
from scour.plans.recipe import Recipe
from scour.sources.fixtures import dirty
from scour.sources.tables import table

from .conftest import SF


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_auto_layers_end_to_end_and_replay(spark):
    d = dirty(spark, SF)
    out, r = auto.auto_layers(d, metrics=False)
    assert out.count() > 0
    # ML-ready: no missing values left, no boolean columns
    row = out.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(out.columns)]).collect()[0]
    assert sum(row) == 0
    assert "boolean" not in dict(out.dtypes).values()
    again = Recipe.from_json(r.to_json())
    again.dictionaries = r.dictionaries
    a = sorted(map(tuple, out.collect()))
    b = sorted(map(tuple, again.apply(dirty(spark, SF)).collect()))
    assert a == b
    assert r.log_df(spark).count() >= 5


def test_no_python_udf_and_no_single_partition_window(spark):
    o = table(spark, SF, "orders")
    out = splits.kfold(o, 5, key="o_orderkey")
    p = _plan(out)
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "SinglePartition" not in p


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 11
    assert set(E.oracle_sql()) <= set(E.queries())


def test_auto_clean_and_run_modes(spark):
    from scour.plans.auto import auto_clean, run_mode
    d = dirty(spark, SF)
    out, r = auto_clean(d, split_percent=80, key="o_orderkey")
    n = out.count()
    assert out.where(F.col("split") == "train").count() == int(0.8 * n)
    assert any(layer == "auto_clean" and what == "rows" for layer, _, what, *_ in r.log)
    o = table(spark, SF, "orders")
    folds, meta = run_mode(o, "clean_and_cv", step_list=[{"column": "o_custkey", "action": "drop"}], n_folds=3,
                           key="o_orderkey")
    assert "o_custkey" not in folds.columns and sum(v["val"] for v in meta["rows_per_fold"].values()) == o.count()
    import pytest
    with pytest.raises(ValueError):
        run_mode(o, "bogus")


def test_recipe_save_and_load(spark):
    from scour.plans.recipe import Recipe
    from scour.session import checkpoint_dir
    import uuid
    d = dirty(spark, SF)
    out, r = auto.auto_layers(d, metrics=False)
    path = f"{checkpoint_dir(spark).rstrip('/')}/recipe-test-{uuid.uuid4().hex[:6]}"
    r.save(path)
    back = Recipe.load(spark, path)
    assert sorted(map(tuple, back.apply(dirty(spark, SF)).collect())) == sorted(map(tuple, out.collect()))


def test_prepare_label_step_replays_with_frozen_dictionary(spark):
    from scour.operators.steps import Step
    from scour.plans.auto import prepare
    o = table(spark, SF, "orders")
    out, r = prepare(o, [Step("o_orderdate", "encode", "label")], metrics=False)
    assert "step:o_orderdate" in r.dictionaries
    # replay on later rows keeps the codes of the fit (a refit would renumber them from 0)
    first = o.agg(F.min("o_orderdate")).collect()[0][0]
    sub = o.where(F.col("o_orderdate") > F.lit(first))
    got = {row["o_orderkey"]: row["o_orderdate"] for row in r.apply(sub).select("o_orderkey", "o_orderdate").collect()}
    want = {row["o_orderkey"]: row["o_orderdate"] for row in out.select("o_orderkey", "o_orderdate").collect()}
    assert got and all(want[k] == v for k, v in got.items()) and min(got.values()) >= 1
