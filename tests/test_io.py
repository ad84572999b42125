import os
import uuid

from pyspark.sql import functions as F

from scour.sources import io


def test_dedupe_headers():
    assert io.dedupe_headers(["a", "b", "a", "a", "a.1"]) == ["a", "b", "a.1", "a.2", "a.1.1"]


def test_csv_round_trip_with_tokens_and_inference(spark, tmp_path):
    p = os.path.join(str(tmp_path), f"t-{uuid.uuid4().hex}.csv")
    with open(p, "w") as f:
        f.write("id,name,id,amount,flag,code\n")
        f.write("1, x ,7,1.5,True,007\n")
        f.write("2,NA,8,,False,010\n")
        f.write("3,unknown,9,n/a,True,abc\n")
    df = io.read_table(spark, p)
    assert df.columns == ["id", "name", "id.1", "amount", "flag", "code"]
    types = dict(df.dtypes)
    assert types["id"] == "bigint" and types["amount"] == "double" and types["flag"] == "boolean"
    assert types["code"] == "string" and types["name"] == "string"
    rows = df.orderBy("id").collect()
    assert rows[0]["name"] == " x " and rows[1]["name"] is None and rows[2]["name"] == "unknown"
    assert rows[1]["amount"] is None and rows[2]["amount"] is None


def test_narrow_types(spark):
    df = spark.createDataFrame([(1, 300, 70000, 2.5, 1234.56789)], "a bigint, b bigint, c bigint, d double, e double")
    out = io.narrow_types(df, floats=True)
    assert [t for _, t in out.dtypes] == ["tinyint", "smallint", "int", "float", "double"]


def test_unsupported_format(spark):
    import pytest
    with pytest.raises(ValueError):
        io.read_table(spark, "/tmp/whatever.xlsx")


def test_csv_keeps_quotes_and_newlines(spark, tmp_path):
    from scour.sources.io import read_table, write_table
    rows = [("a", 'say "hi", ok'), ("b", "line one\nline two"), ("c", "plain")]
    write_table(spark.createDataFrame(rows, "k string, t string"), str(tmp_path / "t.csv"), "csv")
    assert sorted(tuple(r) for r in read_table(spark, str(tmp_path / "t.csv")).collect()) == rows


def test_table_prunes_and_pushes_down(spark):
    from pyspark.sql import functions as F
    from scour.sources.tables import table
    plan = table(spark, "/root/testdata/sf0.001", "orders").where(F.col("o_custkey") > 5).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_custkey), GreaterThan(o_custkey,5)]" in plan and "o_comment" not in plan


def test_wall_clock_keeps_fractions(spark):
    from scour.operators.semantic import wall_clock_text
    row = spark.sql("SELECT '2024-01-02T03:04:05.250Z' AS a, '2024-01-02 03:04:05+02:00' AS b").select(wall_clock_text("a").alias("a"), wall_clock_text("b").alias("b")).first()
    assert row.a.microsecond == 250_000 and row.b.second == 5
    texts = {"2024-01-02T03:04:05.123456789Z": (5, 123456), "2024-01-02 03:04": (0, 0), "2024-01-02T03:04+02": (0, 0), "2024-01-02 03:04:05 -0730": (5, 0)}
    rows = spark.createDataFrame([(t,) for t in texts] + [("2024-01-02 03",), (None,)], "t string").select("t", wall_clock_text("t").alias("w")).collect()
    assert {r.t: (r.w.second, r.w.microsecond) for r in rows if r.w} == texts and all(r.w is None or (r.w.hour, r.w.minute) == (3, 4) for r in rows)


def test_recipe_dictionaries_never_share_a_folder(spark, tmp_path):
    from scour.plans.recipe import Recipe
    d = {k: (spark.createDataFrame([(k, 0)], "value string, code int"), 1) for k in ("step:c", "step_c")}
    r = Recipe([], {}, [], {})
    r.dictionaries = d
    r.save(str(tmp_path / "r"))
    back = Recipe.load(spark, str(tmp_path / "r"))
    assert {k: v[0].first()[0] for k, v in back.dictionaries.items()} == {"step:c": "step:c", "step_c": "step_c"}


def test_all_missing_boolean_fills_as_text(spark):
    from pyspark.sql import types as T
    from scour.operators.missing import fill_expr
    df = spark.createDataFrame([(None,)], "flag boolean")
    assert df.select(fill_expr("flag", T.BooleanType(), {"strategy": "mode", "value": "unknown"}).alias("flag")).first()[0] == "unknown"


def test_suffixed_numbers_stay_text_and_one_hot_has_no_limit(spark):
    from pyspark.sql import functions as F
    from scour.operators.features import one_hot
    from scour.sources.io import infer_types
    got = infer_types(spark.createDataFrame([("1d", "1.5"), ("2f", "-2e3")], "a string, b string"))
    assert dict(got.dtypes) == {"a": "string", "b": "double"}
    wide = spark.range(1100).select(F.col("id").cast("string").alias("c"))
    assert len(one_hot(wide, "c", None).columns) >= 1100


def test_csv_ragged_records_raise_or_stand_apart(spark, tmp_path):
    import pytest
    p = str(tmp_path / "r.csv")
    with open(p, "w") as f:
        f.write('a,b\n1,2\n3,4,5\n6\n"7,x",8\n9,,10\n')
    with pytest.raises(Exception, match="more than 2 fields"):
        io.read_table(spark, p, infer=False).select("a").collect()
    got = io.read_table(spark, p, ragged="apart", infer=False)
    assert sorted(map(tuple, got.collect())) == [("1", "2"), ("6", None), ("7,x", "8")]
    assert got.select("b").where("b = '8'").count() == 1
    assert sorted(r["record"] for r in io.ragged_records(spark, p).collect()) == ["3,4,5", "9,,10"]


def test_csv_reads_files_whole_only_for_open_quotes(spark, tmp_path):
    plain, open_ended = str(tmp_path / "p.csv"), str(tmp_path / "q.csv")
    with open(plain, "w") as f:
        f.write('k,t\n' + "".join(f'{i},"say ""hi"" {i}"\n' for i in range(20_000)))
    with open(open_ended, "w") as f:
        f.write('"first\nname",second,third\n1,"x\ny",3\n')
    assert not io.has_open_quotes(spark, plain) and io.has_open_quotes(spark, open_ended)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = io.read_table(spark, plain, infer=False)
        assert df.rdd.getNumPartitions() > 3 and df.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    back = io.read_table(spark, open_ended)
    assert back.columns == ["first\nname", "second", "third"] and tuple(back.first()) == (1, "x\ny", 3)
