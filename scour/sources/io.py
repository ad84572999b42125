"""Sources and sinks: CSV / JSON / parquet reading with NA tokens and type inference (S1-S3),
table and split writers (S4, S5), preview (S6) and integer / float narrowing (S7).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scour.functions import types as KT
from scour.functions.exprs import qcol

# --- fixed values -------------------------------------------------------------
# Text read as missing in CSV input (exact, case-sensitive match of the whole field).
CSV_NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                 "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# ------------------------------------------------------------------------------

_INT_RE = r"^[+-]?[0-9]+$"
_BOOL_TOKENS = ("True", "False", "TRUE", "FALSE", "true", "false")
_FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".parquet": "parquet", ".pq": "parquet"}


def dedupe_headers(names: list[str]) -> list[str]:
    """Duplicate header names become ``a``, ``a.1``, ``a.2`` ..."""
    seen: dict[str, int] = {}
    used: set[str] = set()
    out = []
    for n in names:
        if n not in used:
            out.append(n)
            used.add(n)
            seen.setdefault(n, 0)
            continue
        k = seen.get(n, 0) + 1
        while f"{n}.{k}" in used:
            k += 1
        seen[n] = k
        cand = f"{n}.{k}"
        out.append(cand)
        used.add(cand)
    return out


#: Holds a record whose number of fields isn't the header's.
_RECORD = "_record"


def _csv_reader(spark: SparkSession, sep: str, multi_line: bool):
    return (spark.read.option("sep", sep).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .option("nullValue", "\u0000").option("emptyValue", "").option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line).option("mode", "PERMISSIVE"))


def has_open_quotes(spark: SparkSession, path: str) -> bool:
    """Whether some line holds an odd number of quotes, as the first line of a field with a newline does.  Where none
    does, records are lines and files can be read in many pieces."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return spark.read.text(path).where(quotes % 2 == 1).limit(1).count() > 0


def _header(spark: SparkSession, path: str, sep: str, multi_line: bool) -> list[str]:
    """Names in the first record, read with the same quoting as the rest; a name may hold a newline."""
    first = _csv_reader(spark, sep, multi_line).option("header", False).csv(path).first() if spark.read.text(path).limit(1).count() else None
    if first is None:
        raise ValueError("empty file")
    return [n or f"Unnamed: {i}" for i, n in enumerate(first)]


def _fields(record: Column, sep: str) -> Column:
    """Number of fields of a raw record: separators outside of quotes, and one."""
    bare = F.regexp_replace(record, '"[^"]*"', "")
    return (F.length(bare) - F.length(F.replace(bare, F.lit(sep)))) / len(sep) + 1


def _csv_records(spark: SparkSession, path: str, sep: str, multi_line: bool | None) -> tuple[DataFrame, list[str]]:
    """All records as text columns _c0.. and _record, which is null unless the record has another number of fields."""
    if multi_line is None:
        multi_line = has_open_quotes(spark, path)
    names = dedupe_headers(_header(spark, path, sep, multi_line))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*(f"_c{i}" for i in range(len(names))), _RECORD]])
    # Where columns are pruned, the parser doesn't see how many fields a record has.
    return _csv_reader(spark, sep, multi_line).option("header", True).option("enforceSchema", True).option("columnPruning", False) \
        .option("columnNameOfCorruptRecord", _RECORD).schema(schema).csv(path), names


def ragged_records(spark: SparkSession, path: str, *, sep: str = ",", multi_line: bool | None = None) -> DataFrame:
    """Records of a CSV file that have more fields than its header: the fields that have a name, and the whole ``record``."""
    raw, names = _csv_records(spark, path, sep, multi_line)
    long = raw.where(F.coalesce(_fields(F.col(_RECORD), sep) > len(names), F.lit(False)))
    return long.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)], F.col(_RECORD).alias("record"))


#: What counts as a number: a cast alone would also take "1d" and "2f".
_NUM_RE = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def infer_types(df: DataFrame) -> DataFrame:
    """Per text column, one aggregate decides: all present values integers -> bigint,
    numbers -> double, True/False -> boolean, otherwise text."""
    cols = df.columns
    aggs = [F.count(qcol(c)).alias(f"n{i}") for i, c in enumerate(cols)]
    aggs += [F.count_if(qcol(c).rlike(_INT_RE) & qcol(c).try_cast("bigint").isNotNull()).alias(f"i{i}")
             for i, c in enumerate(cols)]
    aggs += [F.count_if(qcol(c).rlike(_NUM_RE) & qcol(c).try_cast("double").isNotNull()).alias(f"d{i}") for i, c in enumerate(cols)]
    aggs += [F.count_if(qcol(c).isin(list(_BOOL_TOKENS))).alias(f"b{i}") for i, c in enumerate(cols)]
    row = df.agg(*aggs).collect()[0]
    out = []
    for i, c in enumerate(cols):
        n = row[f"n{i}"]
        if n and row[f"i{i}"] == n:
            out.append(qcol(c).try_cast("bigint").alias(c))
        elif n and row[f"d{i}"] == n:
            out.append(qcol(c).try_cast("double").alias(c))
        elif n and row[f"b{i}"] == n:
            out.append(F.lower(qcol(c)).eqNullSafe(F.lit("true")).alias(c))
        else:
            out.append(qcol(c))
    return df.select(*out)


def read_table(spark: SparkSession, path: str, fmt: str | None = None, *, sep: str = ",",
               infer: bool = True, na_tokens=CSV_NA_TOKENS, multi_line: bool | None = None,
               ragged: str = "raise") -> DataFrame:
    """Read CSV (header, NA tokens to NULL, de-duplicated names, own type inference that
    keeps text columns as text), JSON or parquet; other formats are an error.

    Quoted newlines need ``multi_line``, which reads each file in one task.  By default a scan of the lines tells whether
    a quote is left open at the end of one; only then files are read whole, else they are split.

    A record with fewer fields than the header is filled with NULL.  One with more is an error when it is read
    (``ragged="raise"``), or left out and listed by ``ragged_records`` (``ragged="apart"``)."""
    if fmt is None:
        ext = os.path.splitext(path.rstrip("/"))[1].lower()
        fmt = _FORMATS.get(ext)
        if fmt is None and os.path.isdir(path):
            fmt = "parquet"
    if fmt == "csv":
        if ragged not in ("raise", "apart"):
            raise ValueError(ragged)
        raw, names = _csv_records(spark, path, sep, multi_line)
        # A query that reads nothing but the record is refused, so the first field takes part; its length is never below 0.
        fits = F.coalesce((_fields(F.col(_RECORD), sep) <= len(names)) | (F.length("_c0") < 0), F.lit(True))
        if ragged == "raise":
            fits = F.when(fits, True).otherwise(F.raise_error(F.concat(F.lit(f"record with more than {len(names)} fields: "), F.col(_RECORD))).cast("boolean"))
        raw = raw.where(fits)
        tokens = list(na_tokens)
        df = raw.select(*[F.when(F.col(f"_c{i}").isin(tokens) | F.col(f"_c{i}").isNull(), None)
                          .otherwise(F.col(f"_c{i}")).alias(n) for i, n in enumerate(names)])
        return infer_types(df) if infer else df
    if fmt == "json":
        return spark.read.json(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError("Unsupported file format")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write the cleaned table (CSV with a header, no index)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
         .option("ignoreTrailingWhiteSpace", False).csv(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError("Unsupported file format")


def write_splits(df: DataFrame, path: str, by: str | None = None, fmt: str = "parquet") -> None:
    """One folder per split (``split=train`` / ``split=test``) or per fold (``fold=i``);
    a fold's training set is every other fold folder, so no K copies are stored."""
    by = by or ("split" if "split" in df.columns else "fold")
    w = df.write.mode("overwrite").partitionBy(by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def read_fold(spark: SparkSession, path: str, i: int) -> tuple[DataFrame, DataFrame]:
    """(train, validation) of fold ``i`` from a ``write_splits`` folder (partition pruning)."""
    d = spark.read.parquet(path)
    return d.where(F.col("fold") != i), d.where(F.col("fold") == i)


def preview(df: DataFrame, n: int = 20, order_by=None) -> DataFrame:
    """The first ``n`` rows (by ``order_by`` when given; Spark has no implicit row order)."""
    if order_by is not None:
        return df.orderBy(order_by).limit(n)
    return df.limit(n)


_INT_TYPES = ((T.ByteType(), -128, 127), (T.ShortType(), -32768, 32767),
              (T.IntegerType(), -2147483648, 2147483647))


def narrow_types(df: DataFrame, floats: bool = False, atol: float = 1e-8) -> DataFrame:
    """Integers to the smallest integer type holding their range; with ``floats`` doubles
    to float when every value survives the round trip within ``atol``."""
    ints = [c for c in df.columns if KT.is_integral(KT.dtype_of(df, c))]
    dbls = [c for c in df.columns if isinstance(KT.dtype_of(df, c), T.DoubleType)] if floats else []
    if not ints and not dbls:
        return df
    aggs = [F.struct(F.min(qcol(c)), F.max(qcol(c))).alias(f"i{k}") for k, c in enumerate(ints)]
    aggs += [F.count_if(F.abs(qcol(c).cast("float").cast("double") - qcol(c)) > atol).alias(f"f{k}")
             for k, c in enumerate(dbls)]
    row = df.agg(*aggs).collect()[0]
    target = {}
    for k, c in enumerate(ints):
        lo, hi = row[f"i{k}"]
        if lo is None:
            continue
        for t, a, b in _INT_TYPES:
            if a <= lo and hi <= b:
                target[c] = t
                break
    for k, c in enumerate(dbls):
        if row[f"f{k}"] == 0:
            target[c] = T.FloatType()
    return df.select(*[qcol(c).cast(target[c]).alias(c) if c in target else qcol(c) for c in df.columns])
