"""Column kind tests on a Spark schema (the table's dtype families)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
_DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_number(dt: T.DataType) -> bool:
    """Integral or fractional, not boolean (the 'number' family)."""
    return isinstance(dt, _INTEGRAL + _FRACTIONAL)


def is_numeric(dt: T.DataType) -> bool:
    """Number or boolean (booleans count as numeric for imputation and roles)."""
    return is_number(dt) or isinstance(dt, T.BooleanType)


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, _INTEGRAL)


def is_fractional(dt: T.DataType) -> bool:
    return isinstance(dt, _FRACTIONAL)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, _DATETIME)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def is_bool(dt: T.DataType) -> bool:
    return isinstance(dt, T.BooleanType)


def columns_where(df: DataFrame, pred) -> list[str]:
    return [f.name for f in df.schema.fields if pred(f.dataType)]


def kind(dt: T.DataType) -> str:
    """Coarse family name reported by profiles: numeric, datetime, boolean or text."""
    if is_bool(dt):
        return "boolean"
    if is_number(dt):
        return "numeric"
    if is_datetime(dt):
        return "datetime"
    return "text"
