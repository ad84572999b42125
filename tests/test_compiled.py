"""Wide tables must not run in generated methods that the JVM refuses to compile, nor shuffle whole rows twice."""

from pyspark.sql import functions as F

from scour import session
from scour.operators import consistency, schema
from scour.plans.auto import auto_layers


def _largest_method(df) -> int:
    stages = df._jdf.queryExecution().debug().codegenToSeq()
    return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))


def _wide(spark):
    rows = [("12", " 1,5 ", "yes", "2020-01-02", "0012", None), ("x", "-", "no", "2020-02-30", "0013", "1-2"),
            ("7.", ".5", "0", "2020-01-03", "9", "n/a"), (None, "1.2.3", "1", "03.01.2020", "", "a  b")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string")
    return df.select(*[F.col(c).alias(f"{c}{i}") for i in range(6) for c in df.columns], F.lit(1.5).alias("n"))


def test_schema_fit_is_compiled_and_counts_each_column_alone(spark, monkeypatch):
    df = _wide(spark)
    ran, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: ran.append(self) or collect(self))
    seen = schema.fit_schema(df)
    monkeypatch.undo()
    tests = [d for d in ran if "dt0" in d.columns or "dt0_0" in d.columns]
    assert tests and max(map(_largest_method, tests)) <= session.COMPILED_BYTES
    for c in ("a0", "b3", "c1", "d5", "e2", "f4", "n"):
        one = schema.fit_schema(df.select(c))
        assert one["roles"][c] == seen["roles"][c] and one["conversions"].get(c) == seen["conversions"].get(c)


def test_numeric_text_accepts_what_a_cast_accepts(spark):
    from scour.functions.exprs import numeric_text
    texts = ["1", "-1", ".5", "-.5", "5.", "-5.", "-", ".", "-.", "", "1-2", "--1", "1.2.3", "$ 1,234.50", "007", None, "9" * 400, "x", "2020-01-02", "3-"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    bare = F.regexp_replace("t", r"[^0-9.\-]", "")
    for r in df.select("t", numeric_text("t").alias("got"), bare.try_cast("double").alias("want")).collect():
        assert r["got"] == r["want"], r


def test_whole_rows_are_shuffled_once(spark, monkeypatch):
    calls, drop = [], consistency.drop_exact_duplicates
    monkeypatch.setattr(consistency, "drop_exact_duplicates", lambda df: calls.append(1) or drop(df))
    df = spark.createDataFrame([(i // 2, float(i // 2 % 7), "ab"[i // 2 % 2]) for i in range(40)], "k long, price double, s string")
    out, r = auto_layers(df)
    assert len(calls) == 1 and out.count() == 20
    assert r.params("consistency")["dedup"] and r.params("consistency")["duplicates_removed"] == 20


def test_queries_ask_for_compiled_code(spark):
    import __spark_entry__ as entry
    key = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(key)
    entry.queries()["preview"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get(key) == str(session.COMPILED_BYTES)
    spark.conf.set(key, "100")
    entry.queries()["preview"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get(key) == "100"
    spark.conf.unset(key)
