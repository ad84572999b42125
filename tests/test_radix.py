"""Order-preserving codes and radix selection, on values where bits, signs and types matter."""

import datetime as dt
import decimal
import math
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scour.functions import radix, stats
from scour.operators import splits

DOUBLES = [0.0, -0.0, 1.0, -1.0, 0.1, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308,
           math.inf, -math.inf, 1e-310, 3.0, 1e300, 2.0 ** 52, 2.0 ** 53 + 2, *[2.0 ** e for e in range(-1074, 1024, 7)],
           *[math.nextafter(2.0 ** e, 0) for e in range(-1000, 1024, 13)], *[math.nextafter(2.0 ** e, math.inf) for e in range(-1000, 1023, 13)]]


def test_double_codes_are_the_ieee_bits(spark):
    rows = spark.createDataFrame([(x,) for x in DOUBLES], "x double").select("x", radix.double_code(F.col("x")).alias("c")).collect()
    for r in rows:
        bits = struct.unpack(">q", struct.pack(">d", abs(r.x)))[0]
        assert r.c == (-bits if r.x < 0 else bits), r.x
        assert radix.value_of(r.c, T.DoubleType()) == r.x


@pytest.mark.parametrize("bits,exact", [(12, 1 << 14), (3, 4), (5, 1)])
def test_select_doubles_with_infinities(spark, bits, exact):
    df = spark.createDataFrame([(x,) for x in DOUBLES] + [(None,)], "x double").repartition(5)
    want = sorted(DOUBLES)
    ranks = [0, 1, 2, 50, 200, len(want) - 2, len(want) - 1]
    got = stats.order_statistics(df, {"x": F.col("x")}, [("x", r) for r in ranks + [len(want), -1]], bits=bits, exact_rows=exact)
    assert [got["x", r] for r in ranks] == [want[r] for r in ranks]
    assert got["x", len(want)] is None and got["x", -1] is None


def test_select_bigint_beyond_2_to_53(spark):
    r = random.Random(1)
    values = [r.choice([1, -1]) * ((1 << r.randint(0, 62)) + r.randint(0, 3)) for _ in range(500)] + [(1 << 63) - 1, -(1 << 63)] + [(1 << 60) + 1] * 250
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    want = sorted(values)
    got = radix.select(df, {"x": F.col("x")}, [("x", i) for i in range(0, len(want), 25)], bits=6, exact_rows=8)
    for (_, i), s in got.items():
        assert (s.code, s.lt, s.eq) == (want[i], want.index(want[i]), want.count(want[i]))
    assert stats.medians(spark.createDataFrame([((1 << 60) + 1,)] * 3, "x bigint"), ["x"])["x"] == (1 << 60) + 1


def test_select_decimal_and_several_columns_share_passes(spark):
    rows = [(decimal.Decimal(i * 37 % 101) / 100, i * 17 % 101, float(i)) for i in range(101)]
    df = spark.createDataFrame(rows, "d decimal(10,2), l int, x double")
    q = stats.quantiles(df, ["d", "l", "x"], [0.25, 0.5, 1.0])
    assert q == {"d": [0.25, 0.5, 1.0], "l": [25.0, 50.0, 100.0], "x": [25.0, 50.0, 100.0]}


def _split_tail(df, key, n_test):
    out = splits.train_test_split(df, n_test / df.count(), shuffle=False, key=key)
    return out.where("split = 'test'")


UTC = dt.timezone.utc
KEYS = {
    "decimal(30,4)": [decimal.Decimal(s) for s in ["-99999999999999999999.5", "-1.5", "-1.4", "0", "0.0001", "1", "12345678901234567890.1", "12345678901234567890.2"]],
    "decimal(9,2)": [decimal.Decimal(s) for s in ["-10.5", "-10.25", "0", "0.01", "7", "1600.99", "1999.99", "2000"]],
    "date": [dt.date(1, 1, 1), dt.date(1969, 12, 31), dt.date(1970, 1, 1), dt.date(2000, 2, 29), dt.date(9999, 12, 31)],
    "timestamp": [dt.datetime(1960, 1, 1, tzinfo=UTC), dt.datetime(2020, 1, 1, 0, 0, 0, 1, tzinfo=UTC), dt.datetime(2020, 1, 1, 0, 0, 0, 2, tzinfo=UTC)],
    "timestamp_ntz": [dt.datetime(1960, 1, 1, 23, 59, 59, 999999), dt.datetime(2021, 3, 28, 2, 30), dt.datetime(2021, 3, 28, 3, 0, 0, 1), dt.datetime(2021, 3, 28, 3, 0, 0, 2)],
    "string": ["", "a", "a\0", "aaaaaaa", "aaaaaaaa", "aaaaaaab", "aaaaaaabbbbbbbbbbb", "b", "é", "z" * 40, "z" * 40 + "a", "😀"],
    "boolean": [False, True],
    "float": [-math.inf, -1.5, 0.0, 0.25, math.inf],
    "binary": [b"", b"\0", b"\0\0", b"\x7f", b"\xff", b"\xff\xff\xff\xff\xff\xff\xff\0"],
}


@pytest.mark.parametrize("kind", list(KEYS))
def test_unshuffled_split_by_any_key(spark, kind):
    values = KEYS[kind]
    rows = [(i, values[i % len(values)] if i % 10 >= 3 else None) for i in range(60)]  # 30 % missing
    df = spark.createDataFrame(rows, f"id int, k {kind}").repartition(4)
    test = _split_tail(df, "k", 15)
    kept = [r.k for r in test.select("k").collect()]
    rank = {v if not isinstance(v, bytes) else bytes(v): i for i, v in enumerate(values)}
    want = sorted((rank[v] if v is not None else -1) for _, v in rows)[-15:]
    got = sorted(-1 if v is None else rank[v.astimezone(UTC) if kind == "timestamp" else bytes(v) if kind == "binary" else v] for v in kept)
    assert got == want


def test_unshuffled_by_two_columns_and_nan(spark):
    rows = [(None if i % 4 == 0 else float("nan") if i % 4 == 1 else float(i % 3), f"t{i % 7}", i) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b string, i int")
    order = sorted(rows, key=lambda r: ((0, 0) if r[0] is None else (1, 0) if r[0] != r[0] else (2, r[0]), r[1]))
    test = {r.i for r in _split_tail(df, ["a", "b"], 25).collect()}
    edge = order[-25][:2]
    assert {r[2] for r in order[-25:] if r[:2] != edge} <= test and len(test) == 25
    folds = splits.kfold(df, 4, shuffle=False, key=["a", "b"])
    assert sorted(r["rows"] for r in splits.split_counts(folds, "fold").collect()) == [25] * 4
    with pytest.raises(ValueError):
        splits.train_test_split(df.withColumn("m", F.array("i")), 0.2, shuffle=False, key="m")


def test_identical_rows_are_apportioned(spark):
    # two thirds of the rows are one row, and both fold ends fall into it
    df = spark.range(90).select(F.when(F.col("id") < 60, 7).otherwise(F.col("id")).cast("int").alias("k")).repartition(6)
    for shuffle in (True, False):
        out = splits.kfold(df, 3, shuffle=shuffle, key="k")
        assert sorted(r["rows"] for r in splits.split_counts(out, "fold").collect()) == [30, 30, 30]
        assert sorted(r.k for r in out.collect()) == sorted(r.k for r in df.collect())
    one = spark.createDataFrame([(1, "a")] * 25, "k int, s string")
    out = splits.train_test_split(one, 0.2, key="k")
    assert {r["split"]: r["rows"] for r in splits.split_counts(out).collect()} == {"test": 5, "train": 20}
    # a split point may be settled before the identical rows begin
    mixed = spark.createDataFrame([(i, "x") for i in range(10)] + [(100, "same")] * 30, "k int, s string")
    out = splits.kfold(mixed, 4, shuffle=False, key="k")
    assert sorted(r["rows"] for r in splits.split_counts(out, "fold").collect()) == [10] * 4
    assert {r.k for r in out.where("fold = 1").collect()} == set(range(10))


@pytest.mark.parametrize("widths", [{}, {"bits": 3, "exact_rows": 4}])
def test_stratified_with_many_strata(spark, widths):
    # a third of the rows in one stratum, others of one to three rows, a NULL stratum, equal keys and identical rows
    rows = [("hot", i) for i in range(300)] + [(f"s{i // 2}", i) for i in range(400)] + [(None, i % 4) for i in range(40)] + [("same", 1)] * 50
    df = spark.createDataFrame(rows, "y string, k int").repartition(5)
    out = splits.stratified_split(df, "y", 0.2, key="k", **widths)
    sizes, got = {}, {}
    for y, _ in rows:
        sizes[y] = sizes.get(y, 0) + 1
    for r in out.collect():
        got[r.y, r.split] = got.get((r.y, r.split), 0) + 1
    assert {y: got.get((y, "test"), 0) for y in sizes} == {y: math.ceil(0.2 * n) for y, n in sizes.items()}
    assert sorted(map(str, out.select("y", "k").collect())) == sorted(map(str, df.collect()))
    two = splits.stratified_split(df.withColumn("z", F.col("k") % 2), ["y", "z"], 0.5, key="k", **widths)
    assert two.count() == len(rows)
