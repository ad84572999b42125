"""Exact selection by rank without sorting: radix passes over order-preserving 64-bit codes.

Every value becomes one or more BIGINT words whose order is the order of the values: numbers, booleans, dates and
timestamps one word, wide decimals three, text one for each seven bytes; NULL comes first.  A pass counts rows by
the leading bits of a word inside the few intervals that hold a wanted rank; plain counts are combined in the map tasks,
so a value that a third of all rows share is one row a task, and a window over an interval's buckets (at most
2^BUCKET_BITS of them, or EXACT_ROWS values) finds the next, narrower interval.  Nothing depends on the number of
tasks, and every width of word is done after at most 64 / BUCKET_BITS passes.
"""

from __future__ import annotations

import decimal
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scour.functions import types as KT
from scour.functions.exprs import qcol

BUCKET_BITS = 12
#: An interval with so few rows is counted value by value.
EXACT_ROWS = 1 << 14
_MANTISSA = float(1 << 52)
_INFINITY = 2047 << 52
TEXT_BYTES = 7
_DIGITS = 13


def _big(x: int) -> Column:
    return F.lit(x).cast("bigint")


def double_steps(c: Column) -> list:
    """The steps from a double to its code, each a function of the steps before: value, exponent, mantissa, code.

    The exponent is guessed by a logarithm; a mantissa outside [1, 2) shows a wrong guess and corrects it exactly,
    since scaling by powers of two is exact.  As columns of their own the steps are computed once each.
    """
    def exponent(v):
        return F.greatest(F.floor(F.log2(F.abs(v))).cast("double"), F.lit(-1022.0))

    def mantissa(v, e):
        return F.abs(v) / F.pow(F.lit(2.0), F.least(e, F.lit(1023.0))) * F.when(e > 1023, 0.5).otherwise(1.0)

    def code(v, e, m):
        def bits(e, m):
            return (e + 1022).cast("bigint") * _big(1 << 52) + (m * F.lit(_MANTISSA)).cast("bigint")

        own = F.when(F.abs(v) == 0, _big(0)).when(F.abs(v) == F.lit(float("inf")), _big(_INFINITY)).when(m >= 2, bits(e + 1, m / 2)).when(
            (m < 1) & (e > -1022), bits(e - 1, m * 2)).otherwise(bits(e, m))
        return F.when(v < 0, -own).when(v.isNotNull(), own)

    return [lambda: c.cast("double"), exponent, mantissa, code]


def double_code(c: Column) -> Column:
    """The IEEE bits of a double as a signed number of the same order (both zeros give 0; NaN must be gone)."""
    value, exponent, mantissa, code = double_steps(c)
    v = value()
    e = exponent(v)
    return code(v, e, mantissa(v, e))


def with_codes(df: DataFrame, values: dict[str, tuple[Column, T.DataType]]) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` reduced to the codes of ``values`` (name -> column, type)."""
    out = df.select(*[(double_steps(c)[0]() if isinstance(dt, (T.FloatType, T.DoubleType)) else code_of(c, dt)).alias(f"v{i}")
                      for i, (c, dt) in enumerate(values.values())])
    doubles = [i for i, (_, dt) in enumerate(values.values()) if isinstance(dt, (T.FloatType, T.DoubleType))]
    for step, names in enumerate(["e", "m", "x"], 1):
        more = {f"{names}{i}": double_steps(F.col(f"v{i}"))[step](*[F.col(f"{n}{i}") for n in "vem"[:step]]) for i in doubles}
        out = out.withColumns(more) if more else out
    return out, {n: F.col(f"x{i}" if i in doubles else f"v{i}") for i, n in enumerate(values)}


def _double(code: int) -> float:
    x = struct.unpack(">d", struct.pack(">q", abs(code)))[0]
    return -x if code < 0 else x


def _micros(c: Column) -> Column:
    """Microseconds of a zoneless timestamp's wall clock since 1970, whatever the session's zone."""
    days = F.date_diff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    second = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    return days * 86_400_000_000 + F.hour(c).cast("bigint") * 3_600_000_000 + F.minute(c).cast("bigint") * 60_000_000 + second


def code_of(c: Column, dt: T.DataType) -> Column:
    """One BIGINT word of the order of ``c``, for types that one word can hold."""
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return double_code(c)
    if isinstance(dt, T.DecimalType):
        return (c.cast(T.DecimalType(min(38, dt.precision + 1), dt.scale)) * F.lit(decimal.Decimal(10 ** dt.scale))).cast("bigint")
    if isinstance(dt, T.DateType):
        return F.date_diff(c, F.lit("1970-01-01").cast("date")).cast("bigint")
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dt, T.TimestampNTZType):
        return _micros(c)
    return c.cast("bigint")


def value_of(code: int | None, dt: T.DataType):
    """The number that a code of ``code_of`` stands for (dates and timestamps stay codes)."""
    if code is None:
        return None
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return _double(code)
    if isinstance(dt, T.DecimalType):
        return decimal.Decimal(code).scaleb(-dt.scale)
    return code


def one_word(dt: T.DataType) -> bool:
    return not (KT.is_string(dt) or isinstance(dt, (T.BinaryType, T.DecimalType)) and not (isinstance(dt, T.DecimalType) and dt.precision <= 18))


class Words:
    """The words of a sort key: several columns one after the other, each NULL first."""

    def __init__(self, df: DataFrame, columns: list[str]):
        self.columns = [(c, KT.dtype_of(df, c)) for c in columns]
        for c, dt in self.columns:
            if isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
                raise ValueError(f"column {c} of type {dt.simpleString()} has no order to split by")

    def start(self) -> Iterator:
        return self._walk()

    def _walk(self):
        """A generator of words; send it the value found in each word, and it gives the next one that may still differ."""
        for name, dt in self.columns:
            c = qcol(name)
            if isinstance(dt, (T.FloatType, T.DoubleType)):
                c = F.when(~F.isnan(c), c)
            known = yield c.isNotNull().cast("bigint")
            if known == 0:
                if not isinstance(dt, (T.FloatType, T.DoubleType)):
                    continue
                yield F.coalesce(qcol(name).isNotNull().cast("bigint"), _big(0))  # NaN counts as missing, after NULL
            elif one_word(dt):
                yield F.coalesce(code_of(c, dt), _big(0))
            elif isinstance(dt, T.DecimalType):
                digits = F.lpad(F.replace(F.abs(c).cast("string"), F.lit("."), F.lit("")), 3 * _DIGITS, "0")
                sign = F.when(c < 0, _big(-1)).otherwise(_big(1))
                for i in range(3):
                    yield F.coalesce(sign * F.substring(digits, 1 + i * _DIGITS, _DIGITS).cast("bigint"), _big(0))
            else:
                raw, j, full = c.cast("binary"), 0, TEXT_BYTES
                while full == TEXT_BYTES:  # a part that isn't full ends the text
                    part = F.substring(raw, j * TEXT_BYTES + 1, TEXT_BYTES)
                    number = F.conv(F.rpad(F.hex(part), 2 * TEXT_BYTES, "0"), 16, 10).cast("bigint")
                    value = yield F.coalesce(number * 8 + F.octet_length(part), _big(0))
                    full, j = value & 7, j + 1


@dataclass
class Selected:
    """The word at a rank: its code, how many rows are smaller and how many equal."""

    code: int
    lt: int
    eq: int


def select(df: DataFrame, codes: dict[str, Column], targets: list[tuple[str, int]], *, bits: int = BUCKET_BITS,
           exact_rows: int = EXACT_ROWS, known: dict[str, tuple[int, int, int]] | None = None) -> dict[tuple[str, int], Selected | None]:
    """What stands at each (name, ascending rank from 0) of the BIGINT ``codes``; NULLs don't count, ranks outside give None.

    All names share each pass over ``df``.  Where ``known`` has (rows, least, most possible code) of all names the pass that
    counts them is spared.
    """
    targets = sorted(set(targets))
    if not targets:
        return {}
    names = sorted({t[0] for t in targets})
    base = df.select(*[codes[n].alias(f"c{i}") for i, n in enumerate(names)])
    col = {n: F.col(f"c{i}") for i, n in enumerate(names)}
    if known is None:
        row = base.agg(*[F.struct(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"s{i}") for i, c in enumerate(col.values())]).first()
        known = {n: row[f"s{i}"] for i, n in enumerate(names)}
    out: dict = {}
    # interval (name, lo, hi, rows, rows below it) -> ranks inside it by target
    live: dict[tuple, dict] = {}
    for t in targets:
        n, lo, hi = known[t[0]]
        if not 0 <= t[1] < n:
            out[t] = None
        else:
            live.setdefault((t[0], lo, hi, n, 0), {})[t] = t[1]
    while True:
        for at in [a for a in live if a[1] == a[2]]:
            out.update({t: Selected(at[1], at[4], at[3]) for t in live.pop(at)})
        if not live:
            return out
        wanted, order = [], list(live)
        place: dict[str, Column] = {}
        shift: dict[str, Column] = {}
        for i, (name, lo, hi, n, _) in enumerate(order):
            # the intervals of a name don't overlap: a row lies in one of them at most
            c = col[name]
            inside = (c >= _big(lo)) & (c <= _big(hi))
            by = F.lit(0 if n <= exact_rows else max(0, (hi - lo).bit_length() - bits))
            place[name] = place[name].when(inside, i) if name in place else F.when(inside, i)
            shift[name] = shift[name].when(inside, by) if name in shift else F.when(inside, by)
            wanted += [(i, r) for r in sorted(set(live[order[i]].values()))]
        # Rows outside all intervals are counted as -1 instead of filtered out: a filter would be pushed below the codes
        # and compute them once more for every comparison.
        structs = [F.struct(place[n].otherwise(-1).cast("int").alias("i"), shift[n].otherwise(63).cast("int").alias("s"), F.coalesce(col[n], F.lit(0)).alias("c"))
                   for n in place]
        rows = base.select(F.inline(F.array(*structs))) if len(structs) > 1 else base.select(structs[0].alias("x")).select("x.*")
        rows = rows.select("i", F.expr("shiftright(c, s)").alias("b"), "c")
        hist = rows.groupBy("i", "b").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"))
        upto = Window.partitionBy("i").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("upto", F.sum("n").over(upto))
        ranks = df.sparkSession.createDataFrame(wanted, "i int, r bigint")
        hits = hist.join(F.broadcast(ranks), "i").where((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("n"))).collect()
        found = {(h["i"], h["r"]): h for h in hits}
        after: dict[tuple, dict] = {}
        for i, at in enumerate(order):
            for t, r in live[at].items():
                h = found[i, r]
                before = h["upto"] - h["n"]
                after.setdefault((at[0], h["lo"], h["hi"], h["n"], at[4] + before), {})[t] = r - before
        live = after


def select_by_group(rows: DataFrame, groups: DataFrame, keys: list[str], code: str, write, *, bits: int = BUCKET_BITS,
                    exact_rows: int = EXACT_ROWS) -> DataFrame:
    """For each group of ``groups`` (keys, need) the ``need``-th smallest ``code`` (from 1) among its ``rows``.

    Returns (keys, need, code, eq): need is now the place among the eq rows that hold the code.  Codes must be whole
    numbers from 0 to 2^62.  The intervals of all groups are one table that is joined to the rows, so any number of
    groups will do; a group that holds a third of all rows is split by the join's skew handling and combined in the map
    tasks.  ``write`` materialises a table and returns it.
    """
    def joined(table: DataFrame) -> DataFrame:
        t = table.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], *[c for c in table.columns if c not in keys])
        on = F.lit(True)
        for i, k in enumerate(keys):
            on = on & rows[k].eqNullSafe(t[f"_{i}"])
        return rows.join(t, on).drop(*[f"_{i}" for i in range(len(keys))])

    first = joined(groups).groupBy(*keys, "need").agg(F.min(code).alias("lo"), F.max(code).alias("hi"), F.count(F.lit(1)).alias("m"))
    live, done = write(first), []
    while True:
        done.append(live.where("lo = hi").select(*keys, "need", F.col("lo").alias(code), F.col("m").alias("eq")))
        live = live.where("lo < hi")
        if live.limit(1).count() == 0:
            break
        shift = F.when(F.col("m") <= exact_rows, F.lit(0)).otherwise(F.greatest(F.lit(0), F.length(F.bin(F.col("hi") - F.col("lo"))) - bits))
        inside = joined(live.select(*keys, "need", "lo", "hi", shift.alias("shift"))).where(f"{code} between lo and hi")
        hist = inside.groupBy(*keys, "need", F.expr(f"shiftright({code}, shift)").alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min(code).alias("lo"), F.max(code).alias("hi"))
        upto = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("upto", F.sum("n").over(upto)).where((F.col("need") <= F.col("upto")) & (F.col("need") > F.col("upto") - F.col("n")))
        live = write(hist.select(*keys, (F.col("need") - F.col("upto") + F.col("n")).alias("need"), "lo", "hi", F.col("n").alias("m")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return write(out)
