"""Write PLANS.md: the physical plans of the operators that decide scale behaviour."""

from __future__ import annotations

import io
import os
import sys
from contextlib import redirect_stdout

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from scour.functions import stats  # noqa: E402
from scour.operators import consistency, features, outliers, splits  # noqa: E402
from scour.session import get_session  # noqa: E402
from scour.sources.tables import table  # noqa: E402


def plan(df, execute: bool = False) -> str:
    """The physical plan; for small aggregate results, the final adaptive plan after running
    (it shows the code-generation stages, marked ``*(n)``)."""
    if execute:
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString().strip()
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("simple")
    return buf.getvalue().strip()


def _schema_fit_group(spark, sf):
    """The tests of the schema fit over the DIRTY view (as fit_schema builds it)."""
    from scour.functions import vocab
    from scour.functions.exprs import qcol, strip
    from scour.operators import schema
    from scour.sources.fixtures import dirty
    d = dirty(spark, sf)
    cols = d.columns
    strings = [c for c, t in d.dtypes if t == "string"]
    tall = d.select(F.inline(F.array(*[F.struct(F.lit(i).alias("cid"), qcol(c).alias("r")) for i, c in enumerate(cols) if c in strings])))
    tested = tall.select("cid", "r", strip(F.col("r")).alias("s")).select("cid", "r", *schema._str_flags(vocab.DATETIME_FORMATS))
    return tested.groupBy("cid").agg(*schema._str_stats(vocab.DATETIME_FORMATS))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session()
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders")
    v = F.col("l_extendedprice")
    band = stats._Band("x", 1000.0, 2000.0)
    sections = [
        ("Value histogram (distinct counts, modes, top shares): map-side combine, then a fixed-size min_by per column",
         stats.histogram_summary(stats.value_histogram(li, ["l_returnflag", "l_quantity", "l_shipdate"])), True),
        ("One bracketing pass of an exact order statistic: a global aggregate of fixed-size sketches",
         li.agg(F.count_if(v.between(1000.0, 2000.0)),
                F.percentile_approx(F.when(v.between(1000.0, 2000.0), v), [i / 256 for i in range(257)], 10000),
                F.count_if(v < 1000.0)), True),
        ("Schema fit, text columns unpivoted: per-row regex / parse tests packed into bitmasks in a code-generated "
         "projection, then plain counts", _schema_fit_group(spark, sf), True),
        ("K-fold assignment: a projection against literal split points (no exchange)",
         splits.kfold(li.select("l_orderkey", "l_linenumber", "l_quantity"), 5, key=["l_orderkey", "l_linenumber"]),
         False),
        ("Outlier row removal: range filters pushed to the parquet scan",
         outliers.remove_outlier_rows(li.select("l_orderkey", "l_quantity"), ["l_quantity"]), False),
        ("Factorize: checkpointed dictionary joined back (broadcast only under the checked size)",
         features.factorize(li.select("l_orderkey", "l_returnflag"), "l_returnflag"), False),
        ("Exact duplicates: one hash aggregate over the full row with partial aggregation",
         consistency.drop_exact_duplicates(o), False),
    ]
    del band
    out = ["# Physical plans of the scale-deciding operators", "",
           f"Generated by `scripts/show_plans.py` on `{os.path.basename(sf)}` (local mode).", ""]
    for title, df, execute in sections:
        raw = "".join(ch if ch == "\n" or ch.isprintable() and not ch.isspace() or ch == " " else f"\\u{ord(ch):04x}"
                      for ch in plan(df, execute))
        text = "\n".join(line if len(line) <= 300 else line[:300] + " ..." for line in raw.split("\n"))
        out += [f"## {title}", "", "```", text, "```", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
