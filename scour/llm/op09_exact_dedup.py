"""Exact dedup over an extendible-hash index kept as files in the shared folder.

Keys are 64-bit hashes of the normalised text.  The directory starts at depth 0; a bucket that holds more keys than its
capacity splits by one more bit of its own, and the directory doubles when a bucket is deeper than it; slots that no
split has parted share one bucket.  Each bucket has one owner task, which inserts the texts of its key range in order:
texts that share a key are compared byte by byte and chained where they differ.

Only keys of more than one row need a comparison, so a bitmap of those keys, of a fixed size, keeps all other texts
where they are; a false hit only sends a text more.  A text with many copies is folded in ``SALTS`` pieces before its
owner sees it, and the rows of a key with over ``HOT`` rows meet the index in pieces too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scour.llm.common import plain_text, written

#: Fixed value of the contract: the characters that normalising deletes.
SPACES = "[\\x20\\x09-\\x0D]"
#: Keys a bucket holds before it splits.
CAPACITY = 512
#: Bits of the directory that one pass over the keys looks ahead.
GRAIN = 8
#: Pieces in which the copies of a text are folded, and in which the rows of a hot key are joined.
SALTS = 16
#: Rows of a key beyond which its rows are joined in pieces.
HOT = 1000
#: Size of the bitmaps, at most MAP_BITS / 64 numbers each.
MAP_BITS = 1 << 25


def _prefix(depth: int) -> Column:
    """The top ``depth`` bits of the key."""
    return F.shiftrightunsigned(F.col("key"), 64 - depth) if depth else F.lit(0).cast("bigint")


def _shift(name: str, value: Column, bits: Column) -> Column:
    return F.call_function(name, value, bits.cast("int"))


def build_directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(slot, bucket, local_depth) for every slot of the directory that a key can fall into, and its global depth.

    ``bucket`` is the first slot of the bucket.  ``keys`` (key) are distinct, so every overfull bucket can be split.  A
    pass counts the keys of the buckets still to be split ``GRAIN`` bits ahead; all depths in between follow from those
    counts.  The driver holds the depth and a yes or no.
    """
    base, todo, leaves = 0, keys, []
    while True:
        deep = base + GRAIN
        cells = todo.groupBy(_prefix(deep).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        tree = cells.select(F.explode(F.sequence(F.lit(base), F.lit(deep))).alias("depth"), "cell", "n")
        tree = tree.groupBy("depth", _shift("shiftrightunsigned", F.col("cell"), F.lit(deep) - F.col("depth")).alias("bucket"))
        tree = written(tree.agg(F.sum("n").alias("n")), "tree")
        parents = tree.where(F.col("n") > capacity).select((F.col("depth") + 1).alias("depth"), F.col("bucket").alias("parent"))
        split = tree.withColumn("parent", F.shiftrightunsigned("bucket", 1)).join(parents, ["depth", "parent"], "left_semi")
        split = split.unionByName(tree.where(F.col("depth") == 0).withColumn("parent", F.lit(0).cast("bigint")))
        leaves.append(split.where(F.col("n") <= capacity).select(F.col("depth").alias("local_depth"), "bucket"))
        over = tree.where((F.col("depth") == deep) & (F.col("n") > capacity)).select(F.col("bucket").alias("full"))
        if deep >= 64 or over.limit(1).count() == 0:
            break
        todo, base = todo.join(over, _prefix(deep) == F.col("full"), "left_semi"), deep
    buckets = leaves[0]
    for more in leaves[1:]:
        buckets = buckets.unionByName(more)
    buckets = written(buckets, "buckets")
    depth = buckets.agg(F.max("local_depth")).first()[0] or 0
    unused = F.lit(depth) - F.col("local_depth")
    first = _shift("shiftleft", F.col("bucket"), unused)
    last = first + _shift("shiftleft", F.lit(1).cast("bigint"), unused) - 1
    slots = buckets.select(F.explode(F.sequence(first, last)).alias("slot"), first.alias("bucket"), "local_depth")
    return written(slots, "directory"), depth


def _bitmap(keys: DataFrame, name: str) -> DataFrame:
    """(<name>_w, <name>_v): the 64-bit words of a bitmap of the keys' cells."""
    cell = F.pmod(F.xxhash64("key"), F.lit(MAP_BITS))
    bit = _shift("shiftleft", F.lit(1).cast("bigint"), cell % 64)
    return written(keys.groupBy(F.shiftright(cell, 6).alias(f"{name}_w")).agg(F.bit_or(bit).alias(f"{name}_v")), name)


def _marked(rows: DataFrame, words: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: whether the bitmap holds the key's cell; the bitmap is sent to all tasks."""
    cell = F.pmod(F.xxhash64("key"), F.lit(MAP_BITS))
    rows_in = rows.join(F.broadcast(words), F.shiftright(cell, 6) == F.col(f"{name}_w"), "left")
    bit = _shift("shiftleft", F.lit(1).cast("bigint"), cell % 64)
    return rows_in.select(*rows.columns, F.coalesce(F.col(f"{name}_v").bitwiseAND(bit) != 0, F.lit(False)).alias(name))


def _insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's work: rows (key, body, copies) sorted by bucket and key become one row for each chained text.  Only the
    chain of one key is held."""
    key, chain, out = None, [], ([], [], [], [])

    def close() -> None:
        for place, (body, copies) in enumerate(chain):
            for column, value in zip(out, (key, place, hashlib.sha256(body).hexdigest(), copies), strict=True):
                column.append(value)

    def batch() -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.string(), pa.int64())
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["key", "place", "sha", "copies"])
        for c in out:
            c.clear()
        return made

    for rows in batches:
        for at, body, copies in zip(rows.column("key").to_pylist(), rows.column("body"), rows.column("copies").to_pylist(), strict=True):
            body = body.as_py()
            if at != key:
                close()
                key, chain = at, []
            same = next((i for i, (other, _) in enumerate(chain) if other == body), None)
            if same is None:
                chain.append((body, copies))
            else:
                chain[same] = (body, chain[same][1] + copies)
        if out[0]:
            yield batch()
    close()
    yield batch()


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, lengths: bool = False, key_bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs`` (doc_id, text).

    Texts are equal when identical after deleting white space.  Of equal texts the row with the most code
    points in the original text stays, then the smallest doc_id (a null id comes last).  Null text counts as
    empty; empty texts are equal to each other.  Rows that repeat both id and text share one decision.  An
    empty table gives an empty result; other columns are ignored.  With ``lengths`` there is a column n, the code
    points of the original text: doc_id, text_sha256 and n together tell which rows a decision is about.
    ``key_bits`` below 64 make texts share keys, as tests do; the result is the same.
    """
    text = plain_text()
    rows = docs.select("doc_id", F.length(text).alias("n"), F.regexp_replace(text, SPACES, "").alias("norm"))
    key = F.xxhash64("norm")
    key = key if key_bits >= 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - key_bits), 64 - key_bits)
    rows = rows.withColumn("key", key)

    keys = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")), "keys")
    directory, depth = build_directory(keys.select("key"), capacity)
    again = _bitmap(keys.where("c > 1"), "again")
    hot = _bitmap(keys.where(F.col("c") > HOT), "hot")
    rows = _marked(rows, again, "again")

    # copies are folded in pieces; the owner of the bucket decides which of the folded texts are equal
    texts = rows.where("again").withColumn("slot", _prefix(depth)).join(directory, "slot")
    salt = F.pmod(F.xxhash64("doc_id", "n"), F.lit(SALTS)).cast("int")
    texts = texts.groupBy("bucket", "key", salt.alias("salt"), "norm").agg(F.count(F.lit(1)).alias("copies"))
    owned = texts.repartition("bucket").sortWithinPartitions("bucket", "key")
    index = owned.select("key", F.col("norm").cast("binary").alias("body"), "copies")
    index = written(index.mapInArrow(_insert, "key bigint, place int, sha string, copies bigint"), "index")

    # rows meet their text's place in the chain; those of hot keys in pieces
    members = written(rows.where("again").select("key", F.sha2("norm", 256).alias("sha"), "doc_id", "n"), "members")
    best = members.groupBy("key", "sha").agg(F.min(F.struct((-F.col("n")).alias("a"), F.col("doc_id").isNull().alias("b"), "doc_id")).alias("best"))
    best = best.select("key", "sha", F.col("best.doc_id").alias("keep_id"), (-F.col("best.a")).alias("keep_n"))
    index = _marked(written(index.join(best, ["key", "sha"]), "chosen"), hot, "hot")
    members = _marked(members, hot, "hot")
    plain = members.where("not hot").join(index.where("not hot"), ["key", "sha"])
    pieces = index.where("hot").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    split = members.where("hot").withColumn("salt", salt).join(pieces, ["key", "sha", "salt"])
    names = ["doc_id", "n", "sha", "copies", "keep_id", "keep_n"]
    found = written(plain.select(*names).unionByName(split.select(*names)), "found")

    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))
    more = ["n"] if lengths else []
    out = found.select("doc_id", "keep_id", F.col("copies").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"), *more)
    alone = rows.where("not again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
                                           F.lit(True).alias("kept"), F.sha2("norm", 256).alias("text_sha256"), *more)
    return alone.unionByName(out)
