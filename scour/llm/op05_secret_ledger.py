"""Secret scan with an incremental blob ledger; DataFrame functions only.

Every version of a text is content-addressed by SHA-256.  The ledger is a Parquet table of
(blob, rule_version, spans) in the shared folder: one row for every pair that was ever scanned, findings or
not.  A scan takes the distinct blobs, drops the pairs that the ledger has, scans the rest, appends them, and
joins the findings back to every path that holds the blob.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from scour.llm.common import plain_text, scratch

#: Fixed values of the contract.  (kind, version, pattern, group whose length counts, least length)
#: `[0-9a-f]{32,}` and `AKIA[A-Z0-9]{12,}` match exactly the maximal runs that pass the length test of the base patterns.
RULES = (
    ("assign", "assign-1", "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8),
    ("access", "access-1", "AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", "hex-1", "[0-9a-f]{32,}", 0, 32),
)
SPANS = "array<struct<start:int,kind_no:int,kind:string,end:int>>"


def spans_of(text: Column, kind_no: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans (code points, end exclusive) of one rule: the pieces between matches give the positions."""
    p = F.lit(pattern)
    whole, counted = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
    gaps = F.split(text, pattern, -1)
    sizes = F.transform(F.arrays_zip(gaps.alias("gap"), whole.alias("hit"), counted.alias("val")), lambda x: F.struct(
        F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["val"]).alias("val")))
    # The last piece has no match after it, so it is cut off.
    sizes = F.slice(sizes, F.lit(1), F.size(whole))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(kind_no).alias("kind_no"), F.lit(kind).alias("kind"), (begin + x["hit"]).alias("end"))
        return F.struct((begin + x["hit"]).alias("at"),
                        F.when(x["val"] >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    found = F.aggregate(sizes, start, step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def read_ledger(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def scan(docs: DataFrame, ledger_path: str, rules=RULES, path_col: str = "doc_id") -> DataFrame:
    """(path, blob, spans) for every row of ``docs``; ``spans`` has all kinds, by start, then rule order.

    Only blobs that lack a ledger row for some rule version are read again, and of those only the missing
    rules run.  Null text is the empty blob; repeated rows and copies share a blob; an empty table gives an
    empty result.  The ledger is append-only: the append is one atomic write job, and a run that fails
    before it leaves the ledger as it was.
    """
    spark = docs.sparkSession
    text = plain_text()
    versions = docs.select(F.col(path_col).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))
    blobs = versions.select("blob", "text").distinct()
    ledger = read_ledger(spark, ledger_path)
    if ledger is None:
        todo = blobs.withColumn("done", F.array().cast("array<string>"))
    else:
        seen = ledger.where(F.col("rule_version").isin([r[1] for r in rules])).groupBy("blob").agg(
            F.collect_set("rule_version").alias("done"))  # at most one element for each rule
        todo = blobs.join(seen, "blob", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
        todo = todo.where(F.size("done") < len(rules))
    pairs = F.array(*[F.when(~F.array_contains("done", v), F.struct(F.lit(v).alias("rule_version"),
                             spans_of(F.col("text"), i, kind, p, g, least).alias("spans")))
                      for i, (kind, v, p, g, least) in enumerate(rules)])
    fresh = todo.select("blob", F.explode(F.filter(pairs, lambda x: x.isNotNull())).alias("pair")).select("blob", "pair.*")
    fresh.write.mode("append").option("compression", "zstd").parquet(ledger_path)

    findings = spark.read.parquet(ledger_path).where(F.col("rule_version").isin([r[1] for r in rules]) & (F.size("spans") > 0))
    findings = findings.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))  # one row for each rule at most
    return versions.select("path", "blob").join(findings, "blob", "left").select(
        "path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def secrets(docs: DataFrame) -> DataFrame:
    """The contract's digest of a first scan (empty ledger): doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs, scratch(docs.sparkSession, "ledger"))
    joined = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    count = [of(kind) for kind, *_ in RULES]
    return found.select(F.col("path").alias("doc_id"), *count, F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))
