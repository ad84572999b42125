"""Semantic layer: missing tokens (M1), white-space collapse (M2), gender (M3) and
boolean (M4) canonical forms, time-zone drop (M5).

``fit_semantic`` is one aggregate over the string columns; ``apply_semantic``
is one ``select``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scour.functions import types as KT
from scour.functions import vocab
from scour.functions.exprs import collapse_ws, has_double_ws, lower_strip, map_lookup, qcol, strip


def null_token_expr(c, tokens=vocab.MISSING_TOKENS) -> Column:
    """M1: trimmed text, NULL where the lower-cased trimmed text is a missing token."""
    s = strip(c)
    return F.when(~F.lower(s).isin(list(tokens)), s)


def fit_semantic(df: DataFrame, roles: dict[str, str] | None = None, *,
                 tokens=vocab.MISSING_TOKENS) -> dict:
    """Per string column: has missing tokens, needs collapse, canonical mapping (gender/boolean)."""
    roles = roles or {}
    strings = KT.columns_where(df, KT.is_string)
    dates = [c for c in df.columns if isinstance(KT.dtype_of(df, c), T.TimestampType)]
    if not strings:
        return {"columns": {}, "dates": dates, "missing_tokens": [], "canonical_mappings": {}}
    aggs = [F.count(F.lit(1)).alias("_n")]
    bool_tokens = list(vocab.BOOLEAN_TRUE + vocab.BOOLEAN_FALSE)
    for i, c in enumerate(strings):
        low = lower_strip(qcol(c))
        masked = null_token_expr(qcol(c), tokens)
        aggs += [
            # a NULL is the text "nan" to the source, itself a missing token
            F.coalesce(F.bool_or(low.isin(list(tokens)) | low.isNull()), F.lit(False)).alias(f"tok{i}"),
            F.coalesce(F.bool_or(has_double_ws(masked)), F.lit(False)).alias(f"ws{i}"),
            F.count_if(low.isin(bool_tokens)).alias(f"bool{i}"),
        ]
    row = df.agg(*aggs).collect()[0]
    n = row["_n"]
    cols, missing, mappings = {}, [], {}
    for i, c in enumerate(strings):
        spec = {"tokens": bool(row[f"tok{i}"]), "collapse": bool(row[f"ws{i}"]), "mapping": None}
        if spec["tokens"]:
            missing.append(c)
        if roles.get(c) != "text":
            if vocab.name_has(c, vocab.GENDER_NAME_KEYWORDS):
                spec["mapping"] = "gender"
            elif n and row[f"bool{i}"] / n > vocab.SEMANTIC_BOOLEAN_RATIO:
                spec["mapping"] = "boolean"
            if spec["mapping"]:
                mappings[c] = spec["mapping"]
        else:
            spec["text"] = True
        cols[c] = spec
    return {"columns": cols, "dates": dates, "missing_tokens": missing, "canonical_mappings": mappings}


_BOOL_MAP = {**{t: "yes" for t in vocab.BOOLEAN_TRUE}, **{t: "no" for t in vocab.BOOLEAN_FALSE}}


def semantic_expr(name: str, spec: dict, tokens=vocab.MISSING_TOKENS) -> Column:
    c = qcol(name)
    std = null_token_expr(c, tokens)
    if spec.get("collapse"):
        std = collapse_ws(std)
    if spec.get("mapping") == "gender":
        low = F.lower(std)
        return F.coalesce(map_lookup(low, vocab.GENDER_MAP), low)
    if spec.get("mapping") == "boolean":
        # values masked as missing stay missing; the rest are lower-cased and mapped
        low = lower_strip(c)
        return F.when(std.isNotNull(), F.coalesce(map_lookup(low, _BOOL_MAP), low))
    return std


def apply_semantic(df: DataFrame, params: dict, tokens=vocab.MISSING_TOKENS) -> DataFrame:
    cols = params["columns"]
    dates = set(params.get("dates", []))
    out = []
    for c in df.columns:
        if c in cols:
            out.append(semantic_expr(c, cols[c], tokens).alias(c))
        elif c in dates:
            out.append(qcol(c).cast("timestamp_ntz").alias(c))
        else:
            out.append(qcol(c))
    return df.select(*out)


def semantic_clean(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    return apply_semantic(df, fit_semantic(df, roles))


def null_tokens(df: DataFrame, tokens=vocab.MISSING_TOKENS, columns: list[str] | None = None) -> DataFrame:
    """M1 alone: trimmed text with missing tokens turned into NULL."""
    columns = columns or KT.columns_where(df, KT.is_string)
    return df.select(*[null_token_expr(qcol(c), tokens).alias(c) if c in columns else qcol(c) for c in df.columns])


def collapse_whitespace(df: DataFrame) -> DataFrame:
    """M2 alone: in columns where some value has 2+ consecutive white space, runs become one space."""
    strings = KT.columns_where(df, KT.is_string)
    if not strings:
        return df
    row = df.agg(*[F.coalesce(F.bool_or(has_double_ws(qcol(c))), F.lit(False)).alias(f"w{i}")
                   for i, c in enumerate(strings)]).collect()[0]
    hit = {c for i, c in enumerate(strings) if row[f"w{i}"]}
    return df.select(*[collapse_ws(qcol(c)).alias(c) if c in hit else qcol(c) for c in df.columns])


def canonicalize(df: DataFrame, column: str, mapping: dict | str) -> DataFrame:
    """M3/M4 alone: lower-case, map through ``mapping`` ('gender', 'boolean' or a dict);
    unmapped values stay lower-cased."""
    if mapping == "gender":
        mapping = vocab.GENDER_MAP
    elif mapping == "boolean":
        mapping = _BOOL_MAP
    low = lower_strip(qcol(column))
    expr = F.coalesce(map_lookup(low, mapping), low)
    return df.select(*[expr.alias(c) if c == column else qcol(c) for c in df.columns])


def drop_timezone(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """M5: zoned timestamps to wall-clock (``timestamp_ntz``) in the session time zone.

    Text with an explicit offset keeps the written wall clock: strip the
    offset before parsing (see ``wall_clock_text``).
    """
    columns = columns or [c for c in df.columns if isinstance(KT.dtype_of(df, c), T.TimestampType)]
    return df.select(*[qcol(c).cast("timestamp_ntz").alias(c) if c in columns else qcol(c) for c in df.columns])


def wall_clock_text(c, fmt: str = "yyyy-MM-dd HH:mm[:ss][.SSSSSS]") -> Column:
    """Parse timestamp text that may end in an offset (Z, +02, +02:00, +0200) keeping the written wall clock.  Seconds may
    be missing; of a fraction the microseconds count, which is what a timestamp holds."""
    bare = F.regexp_replace(strip(c), r"(:\d{2}(?:\.\d+)?) ?(?:Z|[+-]\d{2}(?::?\d{2})?)$", "$1")
    bare = F.regexp_replace(bare, r"(\.\d{6})\d+$", "$1")
    return F.try_to_timestamp(F.regexp_replace(bare, "T", " "), F.lit(fmt)).cast("timestamp_ntz")
