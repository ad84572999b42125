"""The corpus pipeline: language ID, exact dedup, near-dedup, benchmark decontamination, byte-level BPE.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet to the shared folder and read again as the
next one's documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scour.llm.common import plain_text, ship, small_batches, written
from scour.llm.op02_langid import identify
from scour.llm.op07_bpe import encode_documents
from scour.llm.op08_decontam import decontaminate
from scour.llm.op09_exact_dedup import SPACES, exact_dedup
from scour.llm.op10_minhash import SIEVE_BITS, near_dedup, row_pick


def _ready(spark: SparkSession) -> None:
    ship(spark)
    small_batches(spark)


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns as a struct: no further column whose name a helper's could clash with."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("_")).alias("row"))


def _columns(docs: DataFrame) -> list:
    return [F.col(f"row.`{c}`").alias(c) for c in docs.columns]


def _unpacked(docs: DataFrame) -> list:
    return [F.col(c) if c in ("doc_id", "text") else F.col(f"row.`{c}`").alias(c) for c in docs.columns]


def _without(rows: DataFrame, gone: DataFrame, same) -> DataFrame:
    """``rows`` that meet no row of ``gone`` (gone_id and more) under ``same``, which asks for equal ids at least.

    A bitmap of the hashes of the ids in ``gone`` is sent to all tasks (at most SIEVE_BITS / 64 numbers at every size).
    Rows whose id isn't in it stay where they are; only the others, few beyond those that go, are joined.
    """
    cell, bit = F.pmod(F.xxhash64("gone_id"), F.lit(SIEVE_BITS)), F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE_BITS))
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), (c % 64).cast("int"))
    words = gone.groupBy(F.shiftright(cell, 6).alias("gone_w")).agg(F.bit_or(one(cell)).alias("gone_v"))
    rows = rows.join(F.broadcast(words), F.shiftright(bit, 6) == F.col("gone_w"), "left")
    hit = F.coalesce(F.col("gone_v").bitwiseAND(one(bit)) != 0, F.lit(False))
    names = ["doc_id", "text", "row"]
    return rows.where(~hit).select(*names).unionByName(rows.where(hit).select(*names).join(gone, same, "left_anti"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; null texts and texts without a letter go.  Where no language can be learned
    every text is `und`, so texts with letters stay whatever their language.  An empty table gives an empty one; columns
    of any name are carried along."""
    _ready(spark)
    return identify(docs, carry=True).where((F.col("lang_pred") != "und") | F.col("row.text").rlike("\\p{L}")).select(*_columns(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each set of equal texts.  Ids needn't be unique or given: a row goes by the decision on its own id,
    text and length, and of rows that are alike in all three the one with the smallest text stays.  An empty table gives
    an empty one; columns of any name are carried along."""
    _ready(spark)
    rows = _packed(docs)
    found = exact_dedup(rows, lengths=True)
    gone = written(found.where(~F.col("kept")).select(
        F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha"), F.col("n").alias("gone_n")).distinct(), "gone")
    sha = F.sha2(F.regexp_replace(plain_text(), SPACES, ""), 256)
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (sha == F.col("gone_sha"))
    out = _without(rows, gone, same & (F.length(plain_text()) == F.col("gone_n")))
    again = found.where("kept and group_size > 1").groupBy(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")).agg(
        F.count(F.lit(1)).alias("c")).where("c > 1")
    if again.limit(1).count() == 0:
        return out.select(*_unpacked(docs))
    first = F.min_by(F.struct("text", "row"), F.struct("text", F.to_json("row"))).alias("first")
    one = out.join(again, same, "left_semi").groupBy("doc_id", sha.alias("sha")).agg(first).select("doc_id", "first.text", "first.row")
    return _without(out, again, same).unionByName(one).select(*_unpacked(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, similarity 0.8 or more): the one with the smallest id.
    Each row goes by the decision on its own id and text; a row without an id stays if its group has no row with one,
    and then one of them."""
    _ready(spark)
    rows = _packed(docs)
    gone = written(near_dedup(rows, picks=True).where(~F.col("stands")).select(
        F.col("doc_id").alias("gone_id"), F.col("pick").alias("gone_pick")).distinct(), "gone")
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (row_pick() == F.col("gone_pick"))
    return _without(rows, gone, same).select(*_unpacked(docs))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark.  Null and empty texts hold none and stay; rows that repeat are judged
    alike.  An empty table gives an empty one, an empty benchmark keeps every row; columns of any name are carried along."""
    _ready(spark)
    benchmark = spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet"))
    return decontaminate(docs, benchmark, carry=True).where(~F.col("contaminated")).select(*_columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of the ids and of the decoded bytes, for every row.  Null and empty texts
    have no ids; rows that repeat each have their row.  An empty table gives an empty one; other columns are left out."""
    _ready(spark)
    return encode_documents(docs)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", clean), ("bpe", encode)]

#: Language ID, similarity search and BPE can't be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
