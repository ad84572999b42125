"""Fixed vocabularies.

FIXED VALUES: these must equal the source behaviour for results to match.
They are stated plainly and in their natural order; every operator that
uses them accepts an override argument.
"""

# --- fixed values -----------------------------------------------------------
# Tokens that mean "missing" (compared after trim + lower-case).
MISSING_TOKENS = ("na", "n/a", "none", "null", "?", "unknown", "nan", "", "not available")

# Boolean tokens for the semantic layer (includes t / f).
BOOLEAN_TRUE = ("true", "yes", "y", "1", "t")
BOOLEAN_FALSE = ("false", "no", "n", "0", "f")

# Boolean tokens for the schema layer's coercion to 0/1 (no t / f).
COERCE_TRUE = ("true", "yes", "y", "1")
COERCE_FALSE = ("false", "no", "n", "0")

# Gender canonical forms.
GENDER_MAP = {
    "m": "male",
    "male": "male",
    "f": "female",
    "female": "female",
    "woman": "female",
    "man": "male",
    "other": "other",
    "non-binary": "non_binary",
}

# Name keywords (case-insensitive substring match).
POSITIVE_KEYWORDS = ("age", "amount", "price", "salary", "revenue", "distance", "quantity", "count", "score", "duration")
PERCENTAGE_KEYWORDS = ("percent", "percentage", "ratio", "rate")
TEXT_KEYWORDS = ("description", "notes", "comment", "text", "summary", "review")
GENDER_NAME_KEYWORDS = ("gender", "sex")
DATE_START_TOKENS = ("start", "from")
DATE_END_TOKENS = ("end", "to")

# Thresholds.
NUMERIC_RATIO = 0.8
DATETIME_RATIO = 0.6
BOOLEAN_RATIO = 0.9
SEMANTIC_BOOLEAN_RATIO = 0.6
ID_DIGIT_RATIO = 0.9
ID_UNIQUE_RATIO = 0.9
NUMERIC_KEY_RATIO = 0.85
HIGH_CARDINALITY_RATIO = 0.5
TEXT_MEAN_LENGTH = 40
SPARSE_COLUMN_RATIO = 0.6
IQR_FACTOR = 1.5
SKEW_LIMIT = 1.0
ONE_HOT_MAX = 15
AGE_BOUNDS = (0.0, 120.0)
PERCENT_BOUNDS = (0.0, 100.0)
# Currency symbols removed before numeric parsing.
CURRENCY_CHARS = "$€£¥₹,"
# ---------------------------------------------------------------------------

# Datetime formats tried by the schema layer, most specific first (our own list).
DATETIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd.MM.yyyy",
)


# "substring" (source behaviour: 'age' matches 'percentage') or "token" (whole name parts only).
KEYWORD_MATCH = "substring"


def name_has(name: str, keywords, match: str | None = None) -> bool:
    """Case-insensitive test of a column name against keywords (see ``KEYWORD_MATCH``)."""
    lowered = name.lower()
    if (match or KEYWORD_MATCH) == "token":
        import re
        parts = set(re.split(r"[^0-9a-z]+", lowered))
        return any(k in parts for k in keywords)
    return any(k in lowered for k in keywords)

# Choice of a scaler by the moments of a column (our own rule; a uniform column has an excess kurtosis of -1.2).
SCALER_SKEW, SCALER_TAIL, SCALER_FLAT = 1.0, 3.0, -1.0
