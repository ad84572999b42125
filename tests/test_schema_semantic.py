import pytest
from pyspark.sql import functions as F

from scour.functions.exprs import numeric_text, word_count
from scour.operators import schema, semantic


def test_snake_names_and_collisions():
    assert schema.snake_name(" First Name ") == "first_name"
    assert schema.snake_name("first-name") == "first_name"
    assert schema.snake_name("%%") == "col"
    cols = [" First Name ", "first-name", "First_Name", "%%", "a", "A", "a_1"]
    ren = schema.fit_names(cols)
    out = [ren.get(c, c) for c in cols]
    assert out == ["first_name", "first_name_1", "first_name_2", "col", "a", "a_1", "a_1_1"]


@pytest.mark.parametrize("text,expected", [
    ("$1,200.50", 1200.5), ("12 abc", 12.0), ("Brand#45", 45.0), ("2024-01-15", None),
    ("01/02/2024", 1022024.0), ("1-URGENT", None), ("(100)", 100.0), ("5.", 5.0), ("-.5", -0.5),
    ("-.", None), ("1e5", 15.0), ("", None), (None, None), (" 5  LOW ", 5.0),
])
def test_numeric_text(spark, text, expected):
    df = spark.createDataFrame([(text,)], "s string")
    got = df.select(numeric_text(F.col("s"))).collect()[0][0]
    assert got == expected


def test_schema_precedence_on_small_frame(spark):
    rows = [(f"0{i:04d}", f"${i},00", "2024-01-0%d" % (1 + i % 9), "yes" if i % 2 else "no", "abc"[i % 3])
            for i in range(40)]
    df = spark.createDataFrame(rows, "code string, price string, day string, flag string, cat string")
    p = schema.fit_schema(df)
    conv = {c: v["to"] for c, v in p["conversions"].items()}
    assert conv == {"code": "id", "price": "numeric", "day": "datetime", "flag": "boolean", "cat": "trim"}
    assert p["roles"]["cat"] == "categorical_feature"
    out = schema.apply_schema(df, p)
    assert dict(out.dtypes)["day"] == "timestamp_ntz"
    assert out.where(F.col("flag") == 1).count() == 20


def test_semantic_tokens_gender_and_collapse(spark):
    df = spark.createDataFrame([(" M ", "a  b", "N/A"), ("woman", "c", "x"), ("unknown", "d", "y")],
                               "gender string, notes string, other string")
    p = semantic.fit_semantic(df, {"notes": "text"})
    out = semantic.apply_semantic(df, p).collect()
    assert [r["gender"] for r in out] == ["male", "female", None]
    assert [r["notes"] for r in out] == ["a b", "c", "d"]
    assert [r["other"] for r in out] == [None, "x", "y"]


def test_word_count_and_unicode_strip(spark):
    df = spark.createDataFrame([("\t hello   world \n",), ("",)], "s string")
    got = [r[0] for r in df.select(word_count(F.col("s"))).collect()]
    assert got == [2, 0]
    trimmed = schema.trim_strings(df).collect()[0][0]
    assert trimmed == "hello   world"


def test_white_space_classes_match_every_white_character(spark):
    from pyspark.sql import functions as F

    from scour.functions.exprs import collapse_ws, has_double_ws
    chars = spark.range(0x110000).where("id not between 55296 and 57343").select(F.col("id"), F.call_function("char", F.col("id")).alias("low"))
    # UTF-16 code units of the plane that holds all white space, and letters around them
    chars = chars.where("id < 65536").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    got = chars.select("id", F.col("c").rlike(r"(?U)^\s$").alias("want"), has_double_ws(F.concat("c", "c")).alias("double"),
                       (collapse_ws(F.concat(F.lit("a"), "c", "c", F.lit("b"))) == "a b").alias("run"))
    assert got.where("want != double or want != run").count() == 0
    assert got.where("want").count() > 20


def test_date_formats_are_tried_only_on_text_of_their_shape(spark):
    from scour.operators import schema
    rows = [("2020-01-02", "12.34", "07.01.2020"), ("2020-02-30", "note 5-LOW", "1.2.2020"), ("2020/01/03", "0012345678", None), (" 2020-01-04 ", "2020", "31.12.1999")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    fit = schema.fit_schema(df, datetime_ratio=0.5)
    assert fit["conversions"]["a"] == {"to": "datetime", "format": "yyyy-MM-dd"} and fit["conversions"]["c"]["format"] == "dd.MM.yyyy"
    assert "shaped" in [x for d in [schema._str_flags(schema.vocab.DATETIME_FORMATS)] for x in ("shaped",) if x in str(d)]
    assert schema.fit_schema(df, formats=())["conversions"]["a"]["to"] != "datetime"
