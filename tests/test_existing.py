"""Derived columns whose names exist already are replaced, not duplicated."""

import pytest
from pyspark.sql import functions as F

from scour.operators import features, missing, outliers, schema
from scour.plans import auto
from scour.plans.decisions import Decision
from scour.sources.fixtures import dirty
from scour.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_derived_columns_twice(spark):
    o = table(spark, SF, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    once = features.date_parts(o)
    assert features.date_parts(once).columns == once.columns
    df = spark.createDataFrame([(1.0, 9, "a b"), (None, 9, "c"), (100.0, 9, None)] * 5 + [(5000.0, 9, "x")], "x double, x_was_missing int, s string")
    out = missing.missing_indicators(df)
    assert out.columns == ["x", "x_was_missing", "s", "s_was_missing"]
    assert {(r.x is None, r.x_was_missing) for r in out.collect()} == {(True, 1), (False, 0)}
    text = features.text_features(df, ["s"])
    assert features.text_features(text, ["s"]).columns == text.columns
    flagged = outliers.flag_outliers(df.drop("x_was_missing"))
    assert "x_outlier_flag" in flagged.columns
    again = outliers.flag_outliers(flagged)
    assert again.columns == flagged.columns and again.agg(F.sum("x_outlier_flag")).first()[0] == 1
    hot = features.one_hot(spark.createDataFrame([("u", 7), ("v", 7)], "k string, k_u int"), "k", as_int=True)
    assert sorted(map(tuple, hot.select("k_u", "k_v").collect())) == [(0, 1), (1, 0)]
    logged = features.log1p_skewed(df)
    assert features.log1p_skewed(logged.select("x", "x_log1p")).columns[:2] == ["x", "x_log1p"]


def test_layers_on_their_own_output(spark):
    out, _ = auto.auto_layers(dirty(spark, SF))
    again, recipe = auto.auto_layers(out)
    assert len(set(again.columns)) == len(again.columns) and again.count() > 0
    assert recipe.log_df(spark).where("decision = 'rows'").count() == 2


@pytest.mark.parametrize("names,want", [
    ([" First Name ", "first-name", "First_Name", "%%", "a", "A", "a_1", "é"], ["first_name", "first_name_1", "first_name_2", "col", "a", "a_1", "a_1_1", "col_1"]),
    (["a", "a_1", "a"], ["a", "a_1", "a_2"])])
def test_names(names, want):
    allocate = schema.NameAllocator()
    assert [allocate(schema.snake_name(n)) for n in names] == want


def test_decisions_follow_the_parameters(spark):
    _, r = auto.auto_layers(dirty(spark, SF))
    rows = {(x.layer, x.column, x.decision): x.number for x in r.log_df(spark).collect()}
    assert rows["missing", "promo_value", "sparse_dropped"] == pytest.approx(2 / 3)
    assert rows["consistency", None, "copies_removed"] == 30
    assert ("semantic", "gender", "categorical_standardized") in rows and ("features", "order_notes", "text_features_added") in rows
    assert rows["ml_ready", None, "rows"] == r.stats["ml_ready"]["rows"]
    assert set(r.stats["post_quality_metrics"]) and set(r.stats["quality_metrics"])
    back = type(r).from_json(r.to_json())
    assert back.log_df(spark).collect() == r.log_df(spark).collect()
    assert Decision("missing", "a", "fill_by_median", 2.0).text() == "fill by median [a] = 2"


def test_run_mode_reports_what_it_did(spark):
    o = table(spark, SF, "orders")
    steps = [{"column": "o_custkey", "action": "drop"}, {"column": "o_orderpriority", "action": "encode", "method": "label"},
             {"column": "nope", "action": "scale"}, {"column": "o_totalprice", "action": "normalize"}]
    out, meta = auto.run_mode(o, "clean_and_split", step_list=steps, key="o_orderkey")
    assert [a["action"] for a in meta["actions"]] == ["drop", "encode", "scale"] and len(meta["log"]) == 3
    assert [s["column"] for s in meta["skipped_steps"]] == ["nope"]
    assert meta["dictionaries"]["o_orderpriority"][1] == 5
    assert meta["columns"] == [c for c in out.columns if c != "split"]
    assert sum(meta["rows_per_output"].values()) == meta["rows_before"]
