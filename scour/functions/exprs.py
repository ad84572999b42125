"""Reusable column expressions (all built-in, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scour.functions import vocab

# Java regexes: (?U) makes \s match Unicode white space like Python's str methods; the class listed matches the same
# characters without looking up each one's properties.
_WS = r"[\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_LEAD_TRAIL_WS = r"(?U)^\s+|\s+$"
_ANY_WS = r"(?U)\s"
_WS_RUN = _WS + "+"
_WS_DOUBLE = _WS + "{2}"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def qcol(name: str) -> Column:
    """Reference a column whose name may hold dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


# Every character Python's str.strip() removes (derived from str.isspace, not listed by hand).
UNICODE_WS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(c) -> Column:
    """Trim Unicode white space at both ends (Spark's trim only removes spaces); no regex."""
    return F.btrim(col(c), F.lit(UNICODE_WS))


def lower_strip(c) -> Column:
    return F.lower(strip(c))


def collapse_ws(c) -> Column:
    return F.regexp_replace(col(c), _WS_RUN, " ")


def has_double_ws(c) -> Column:
    return col(c).rlike(_WS_DOUBLE)


def nan_to_null(c, dt: T.DataType) -> Column:
    """Float NaN becomes SQL NULL so that counts, quantiles and sorts treat it as missing."""
    c = col(c)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(c), F.lit(None).cast(dt)).otherwise(c)
    return c


def numeric_text(c) -> Column:
    """Greedy numeric parse of text: drop currency, commas, white space and every other char
    outside ``0-9 . -`` (one regex: the first removals are subsumed by the last), then parse;
    unparsable text is NULL (told by its shape, since each failing cast costs an exception)."""
    s = F.regexp_replace(col(c), r"[^0-9.\-]+", "")
    return F.when(s.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"), s.try_cast("double"))


def strict_numeric_text(c) -> Column:
    """Whole-value numeric parse: currency, commas and white space removed, then the rest
    must be one number."""
    s = strip(c)
    s = F.regexp_replace(s, "[" + vocab.CURRENCY_CHARS.replace("$", r"\$") + "]", "")
    s = F.regexp_replace(s, _ANY_WS, "")
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))


def word_count(c) -> Column:
    """Number of white-space separated words (empty text gives 0)."""
    return F.size(F.filter(F.split(col(c), _WS_RUN), lambda w: w != F.lit("")))


def skew_adjusted(n: Column, g1: Column) -> Column:
    """Bias-corrected sample skewness G1 from population skewness g1 and count n.

    NULL for n < 3; a constant column (g1 NULL with n >= 3) gives 0.
    """
    nd = n.cast("double")
    factor = F.sqrt(nd * (nd - 1)) / F.when(nd - 2 > 0, nd - 2)
    return F.when(n >= 3, F.coalesce(g1, F.lit(0.0)) * factor)


def in_tokens(c, tokens) -> Column:
    return lower_strip(c).isin(list(tokens))


def map_lookup(c, mapping: dict) -> Column:
    """Lookup in a literal map; NULL when the key is absent."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*items), col(c))


def put(kept: list[str], extra: dict[str, Column], values: dict[str, Column] | None = None) -> list[Column]:
    """The columns ``kept`` (or their new ``values``) and the ``extra`` ones; an extra name that exists already takes the
    place of the old column, others come last."""
    out = {c: (values or {}).get(c, qcol(c)) for c in kept}
    out.update(extra)
    return [e.alias(n) for n, e in out.items()]
