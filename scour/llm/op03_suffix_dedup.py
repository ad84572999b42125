"""Suffix-array dedup: remove every byte that a repeated ``span``-byte string covers.

Sorting every suffix of the corpus would move each byte ``span`` times.  Here the suffixes that can't matter are
left out first, without loss.  Every string of ``span`` bytes holds an anchor: a place whose half-span block has
the least hash of its neighbourhood.  Equal strings have their anchors at equal places, so a string repeats only
if the block at its anchor does.  An anchor whose whole surrounding repeats settles all strings around it; the
others are narrowed once more, in groups of ``PIECE`` neighbouring starts.  What is left are the suffixes near the
ends of repeated passages: these are range-partitioned at sampled splitters by their leading bytes, sorted in each
bucket by multikey quicksort, and compared across bucket boundaries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scour.llm.common import KERNEL_BYTES, bucketed, plain_text, steps, text_buffers, written
from scour.llm.textkit import U, Rolling, mix

#: Neighbouring starts that are settled together after the anchors.
PIECE = 13
_MAX = U(0xFFFFFFFFFFFFFFFF)


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) of every ``width`` neighbours, by doubling."""
    done = 1
    out = x
    while done * 2 <= width:
        out = op(out[:-done], out[done:])
        done *= 2
    return op(out[:len(out) - (width - done)], out[width - done:]) if done < width else out


def anchors(data: np.ndarray, offsets: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the row, block hash, and hash of the surrounding (what all strings around the place read)."""
    block, width = span // 2, span - span // 2 + 1
    none = np.zeros(0, np.int64)
    if len(data) < span:
        return none, none, none.view(U), none.view(U)
    roll = Rolling(data)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    end = offsets[1:][row]
    at = np.arange(len(data) - block + 1)
    h = roll.of(at, at + block) | U(1)
    h[at + block > end[at]] = _MAX
    least = sliding(h, width, np.minimum)
    s = np.arange(len(least))
    least[s + span > end[s]] = 0
    # A place is an anchor if some string that holds its block has no smaller block.
    padded = np.concatenate([np.zeros(width - 1, U), least, np.zeros(width - 1, U)])
    p = np.flatnonzero(h == sliding(padded, width, np.maximum)[:len(h)])
    begin, stop = np.maximum(p - (span - block), offsets[row[p]]), np.minimum(p + span, end[p])
    with np.errstate(over="ignore"):
        around = mix(roll.of(begin, stop) * U(3) + (p - begin).astype(U) + U(1))
    return row[p], p - offsets[row[p]], h[p], around


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """Multikey quicksort of rows of 64-bit words: three-way split on one word at a time, equal parts go on with the next."""
    n = len(words[0])
    order, todo = np.arange(n), [(0, n, 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == len(words):
            continue
        part = order[lo:hi]
        v = words[depth][part]
        if hi - lo <= 4096:
            order[lo:hi] = part[np.lexsort([w[part] for w in reversed(words[depth:])])]
            continue
        pivot = np.partition(v[:: max(1, len(v) // 255)], len(v[:: max(1, len(v) // 255)]) // 2)[len(v[:: max(1, len(v) // 255)]) // 2]
        less, same, more = part[v < pivot], part[v == pivot], part[v > pivot]
        order[lo:hi] = np.concatenate([less, same, more])
        a, b = lo + len(less), lo + len(less) + len(same)
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def repeated_suffixes(suffixes: DataFrame) -> DataFrame:
    """(rep, start) of every suffix (lead, fp, rep, start) whose (lead, fp) occurs again.

    Splitters come from Spark's sample of the keys; a key that fills more than a bucket is spread over several by
    the place of the suffix.  A bucket settles its inner runs alone; only its first and last run, two rows a
    bucket, are compared with those of other buckets.
    """
    schema = "lead bigint, fp bigint, n bigint, edge boolean, rep binary, start array<int>"

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        lead, fp = (table[c].to_numpy() for c in ("lead", "fp"))
        order = multikey_order([lead, fp])
        lead, fp = lead[order], fp[order]
        new = np.flatnonzero(np.concatenate([[True], (lead[1:] != lead[:-1]) | (fp[1:] != fp[:-1])]))
        size = np.diff(np.append(new, len(lead)))
        edge = np.zeros(len(new), bool)
        edge[[0, -1]] = True
        keep = np.repeat((size > 1) | edge, size)
        at, run = order[keep], np.repeat(np.arange(len(new)), size)[keep]
        take = pa.array(at)
        ends = np.arange(len(at) + 1, dtype=np.int32)
        for i in range(0, len(at), 50_000):
            j = min(len(at), i + 50_000)
            part = take.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([
                pa.array(lead[keep][i:j]), pa.array(fp[keep][i:j]), pa.array(size[run[i:j]]), pa.array(edge[run[i:j]]),
                table["rep"].take(part).combine_chunks(), pa.ListArray.from_arrays(pa.array(ends[:j - i + 1]), table["start"].take(part).combine_chunks())],
                ["lead", "fp", "n", "edge", "rep", "start"])

    spread = suffixes.repartitionByRange("lead", "fp", "rep", "start")
    found = written(spread.mapInArrow(bucket, schema), "suffix-runs").select("lead", "fp", "n", "edge", "rep", F.col("start")[0].alias("start"))
    inner = found.where("n > 1").select("rep", "start")
    # Runs of one row at a bucket's end: settled by the same key at another bucket's end.
    ends = found.where("edge").groupBy("lead", "fp").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    across = found.where("edge and n = 1").join(ends, ["lead", "fp"]).select("rep", "start")
    return inner.union(across)


PLACES = "rep binary, at int, kh bigint, eh bigint"


def pieces(data: np.ndarray, ats: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start of each piece around the anchors (may be below 0), hash of what all its strings share, and hash
    of all that they read.  Pieces lie alike around equal anchors; their ends may be cut off by the text's."""
    back, n = span - span // 2, len(data)
    u = np.unique((ats[:, None] - back + np.arange(0, back + 1, PIECE)).ravel())
    u = u[(u + PIECE > 0) & (u + span <= n)]
    v = u + PIECE - 1
    roll = Rolling(data, seed=17)
    begin, stop = np.maximum(u, 0), np.minimum(v + span, n)
    with np.errstate(over="ignore"):
        around = mix(roll.of(begin, stop) * U(3) + (begin - u).astype(U) * U(5) + U(1))
    return u, roll.of(v, u + span), around


def settle(near: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Of places (rep, at, kh, eh) that share ``kh`` with another: those whose ``eh`` repeats too, and, one for each
    ``eh``, the members of the groups where some ``eh`` does not."""
    groups = written(near.groupBy("kh", "eh").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rep", "at")).alias("one")), f"{name}-groups")
    sure = near.join(groups.where("n > 1").select("kh", "eh"), ["kh", "eh"]).select("rep", "at")
    mixed = groups.groupBy("kh").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("c")).where("least = 1 and c > 1").select("kh")
    return sure, groups.join(mixed, "kh").select("one.rep", "one.at")


def repeated_keys(places: DataFrame, name: str) -> DataFrame:
    """The places whose ``kh`` occurs again."""
    twice = places.groupBy("kh").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("kh")
    return written(places.join(twice, "kh"), name)


def by_text(places: DataFrame) -> DataFrame:
    return places.groupBy("rep").agg(F.sort_array(F.collect_list("at")).alias("ats"))  # at most one for each byte of the text


#: Rows that leave a Python task together at least, where each text has few.
OUT_ROWS = 20_000


def together(parts: Iterator[tuple[pa.Array, list[np.ndarray]]], names: list[str], least: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of ``least`` rows or more, but for the last, of the parts: a text's ``rep`` as an array of one, which is
    repeated and comes first, and columns of numbers."""
    held, rows = [], 0

    def batch() -> pa.RecordBatch:
        ids = pa.concat_arrays([one for one, _ in held]).take(pa.array(np.repeat(np.arange(len(held)), [len(cols[0]) for _, cols in held])))
        cols = [pa.array(np.concatenate(x)) for x in zip(*(cols for _, cols in held), strict=True)]
        return pa.RecordBatch.from_arrays([ids, *cols], ["rep", *names])

    for part in parts:
        held.append(part)
        rows += len(part[1][0])
        if rows >= least:
            yield batch()
            held, rows = [], 0
    if rows:
        yield batch()


def suffix_dedup(docs: DataFrame, span: int = 200, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row; with ``keep_text`` also ``kept`` (binary).

    A byte goes if a ``span``-byte string over it starts anywhere else in ``docs`` too, same document included.
    Null counts as empty; texts shorter than ``span`` lose nothing; rows with equal texts of ``span`` bytes or more
    lose everything.  Repeated ids are judged row by row; an empty table gives an empty result; other columns are
    ignored.  Strings are compared by their first eight bytes and a 64-bit hash of the whole.
    """
    block = span // 2
    back = span - block
    given = docs.select("doc_id", plain_text().alias("text"))
    whole = given.select("doc_id", F.substring(F.unhex(F.sha2("text", 256)), 1, 12).alias("rep"), F.octet_length("text").cast("bigint").alias("n_bytes"), "text")
    texts = bucketed(whole.where(F.col("n_bytes") >= span).groupBy("rep").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), "rep", "texts")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in steps(offsets, KERNEL_BYTES):
                row, at, h, around = anchors(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], span)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(row)), pa.array(at.astype(np.int32)),
                                                  pa.array(h.view(np.int64)), pa.array(around.view(np.int64))], ["rep", "at", "kh", "eh"])

    # Copies are folded, so an anchor counts once for a text and again only where other places have it.
    near = repeated_keys(texts.select("rep", "text").mapInArrow(find, PLACES), "anchors")
    sure, members = settle(near, "anchors")

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i in range(batch.num_rows):
                u, core, around = pieces(data[offsets[i]:offsets[i + 1]], batch.column(2).slice(i, 1).flatten().to_numpy(), span)
                yield batch.column(0).slice(i, 1), [u.astype(np.int32), core.view(np.int64), around.view(np.int64)]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from together(pieces_of(batches), ["at", "kh", "eh"])

    # One member stands for each settled surrounding, so that strings near an end find their partners there.
    small = repeated_keys(texts.select("rep", "text").join(by_text(members), "rep").mapInArrow(split, PLACES), "pieces")
    sure_small, members = settle(small, "pieces")
    members = by_text(members)

    def suffixes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i in range(batch.num_rows):
                own = data[offsets[i]:offsets[i + 1]]
                p = batch.column(2).slice(i, 1).flatten().to_numpy()
                s = np.unique((p[:, None] + np.arange(PIECE)).ravel())
                s = s[(s >= 0) & (s + span <= len(own))]
                fp = Rolling(own, seed=31).of(s, s + span).view(np.int64)
                lead = np.zeros(len(s), np.int64)
                for k in range(8):
                    lead = (lead << 8) | own[s + k]
                for a in range(0, len(s), 50_000):
                    b = min(len(s), a + 50_000)
                    yield batch.column(0).slice(i, 1), [lead[a:b], fp[a:b], s[a:b].astype(np.int32)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from together(suffixes_of(batches), ["lead", "fp", "start"])

    suffixes = texts.select("rep", "text").join(members, "rep").mapInArrow(cut, "rep binary, lead bigint, fp bigint, start int")
    again = repeated_suffixes(suffixes)
    at = F.col("at")
    hits = sure.select("rep", (at - back).alias("a"), at.alias("b")).union(sure_small.select("rep", at.alias("a"), (at + PIECE - 1).alias("b")))
    hits = hits.select("rep", F.greatest("a", F.lit(0)).alias("a"), "b").union(again.select("rep", F.col("start").alias("a"), F.col("start").alias("b")))
    hits = hits.groupBy("rep").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))  # a few for each byte of the text at most

    schema = "rep binary, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            copies, out = batch.column(2).to_numpy(), []
            for i in range(batch.num_rows):
                own = data[offsets[i]:offsets[i + 1]]
                gone = np.full(len(own), copies[i] > 1 and len(own) >= span)
                if batch.column(3)[i].is_valid and not gone.any():
                    a, b = (batch.column(k).slice(i, 1).flatten().to_numpy() for k in (3, 4))
                    ok = a <= np.minimum(b, len(own) - span)
                    a, b = a[ok], np.minimum(b[ok], len(own) - span) + span
                    depth = np.bincount(a, minlength=len(own) + 1) - np.bincount(b, minlength=len(own) + 1)
                    gone = np.cumsum(depth)[:len(own)] > 0
                runs = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]])))
                left = own[~gone].tobytes()
                out.append((int(gone.sum()), runs, hashlib.sha256(left).hexdigest(), left))
            removed, runs, sha, left = zip(*out, strict=True) if out else ((), (), (), ())
            cols = [batch.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())]
            names = ["rep", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                cols, names = [*cols, pa.array(left, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names)

    judged = texts.join(hits, "rep", "left").select("rep", "text", "copies", "a", "b").mapInArrow(strip, schema)
    ids = whole.select("doc_id", "rep", "n_bytes")
    short = F.sha2("text", 256)
    long_ = ids.where(F.col("n_bytes") >= span).join(judged, "rep").drop("rep")
    brief = whole.where(F.col("n_bytes") < span).select("doc_id", "n_bytes", F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"),
                                                        short.alias("kept_sha256"), *([F.col("text").cast("binary").alias("kept")] if keep_text else []))
    return long_.unionByName(brief)
