"""LM scoring by cross-entropy difference.

A target model is learned from documents that are labelled good, a background model from all documents.  They are
matched: same order, same smoothing, one vocabulary of every word that occurs, and the background's counts scaled to the
target's size.  A document's score is the mean over its tokens of background loss minus target loss: higher is nearer
the target.  All documents are counted, in two halves by a hash of the id; each half is scored by the models of the
other, so no document meets its own counts.

Every word and every pair has a count of its own.  The loss of a token w after v is

    log(c(v) + strength) - log(strength) - log p(w) - log(1 + c(v, w) / (strength * p(w)))

so a pair matters only where the other half has it, and words enter one by one.  Words and pairs that a sample finds
frequent are counted exactly in the map tasks and added there; this only spares the shuffle and spreads the heavy keys.
All others are dealt out by word or pair, counted there, and their losses are summed by document.  Of these, only what
both halves hold has a count in the models that are asked: a bitmap of their hashes spares all others the shuffle.  A
hash that meets another's bit costs a row and never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scour.llm.common import KERNEL_BYTES, plain_text, steps, text_buffers, written
from scour.llm.textkit import U, mix, word_hashes

SAMPLE = 20_000  # documents that choose the frequent words and pairs; the result doesn't depend on them
FEW_LABELS = 1 << 20  # up to so many good ids are sent to all tasks instead of shuffling texts
SIEVE_BITS = (20, 29)  # powers of two between which the bitmap has one bit for each byte of text: 64 MB at most
SENT = 1 << 20
CHUNK = 1 << 12  # bytes of the bitmap that travel as one row
SCALE = float(1 << 28)  # losses are summed as whole numbers, so no order of adding changes them


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of every word; the places after the first of their row, and the hash of the pair that ends there."""
    h, rows = word_hashes(data, offsets)
    at = np.flatnonzero(rows[1:] == rows[:-1]) + 1 if len(rows) > 1 else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        return h, rows, at, mix(h[at - 1] * U(0x9E3779B97F4A7C15) + h[at])


class Places:
    """Places of hashes in a sorted list of distinct hashes; those of equal leading bits are tried one after the other."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.bits = hashes, len(hashes).bit_length() + 1
        starts = np.arange(1 << self.bits, dtype=U) << U(64 - self.bits)
        self.first = np.r_[np.searchsorted(hashes, starts), len(hashes)].astype(np.int32)

    def __len__(self) -> int:
        return len(self.hashes)

    def of(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        out = np.full(len(h), -1)
        lead = (h >> U(64 - self.bits)).astype(np.int64)
        at, end = self.first[lead], self.first[lead + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.hashes[at[left]] == h[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


def counted(rows: np.ndarray, h: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (row, hash), how often each occurs, and the sums of further columns."""
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
    return (rows[first], h[first], np.diff(np.r_[first, len(h)]), *(np.add.reduceat(s[order], first) if len(first) else s[:0] for s in sums))


def half_of_id() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(2)).cast("int")


def row_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), plain_text())


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """key, text, half and whether the document is labelled good.  An id that is labelled more than once is good only
    if all labels say so."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    good = good.select("doc_id", F.lit(True).alias("good"))
    rows = docs.select("doc_id", row_key().alias("key"), plain_text().alias("text"), half_of_id().alias("half"))
    if good.count() <= FEW_LABELS:
        rows = rows.join(F.broadcast(good), "doc_id", "left")
    else:  # rows without an id aren't joined: they would all go to one task
        rows = rows.where("doc_id is not null").join(good, "doc_id", "left").unionByName(
            rows.where("doc_id is null").withColumn("good", F.lit(None).cast("boolean")))
    return rows.select("key", "text", "half", F.coalesce("good", F.lit(False)).cast("int").alias("good"))


def frequent(docs: DataFrame, most: int, n_docs: int) -> tuple[Places, Places]:
    """The ``most`` words and pairs that are most frequent in a sample; a pair's last word is among the words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for i, j in steps(offsets):
                h, _, at, pair = tokens(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                word, n = np.unique(h, return_counts=True)
                both, first, m = np.unique(pair, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[word, both].view(np.int64)), pa.array(np.r_[word, h[at][first]].view(np.int64)),
                                                  pa.array(np.repeat([False, True], [len(word), len(both)])), pa.array(np.r_[n, m])], ["h", "w", "pair", "n"])

    rate = min(1.0, SAMPLE / max(1, n_docs))
    part = docs.select(plain_text().alias("text")).where(F.rand(7) < rate)
    found = written(part.mapInArrow(count, "h bigint, w bigint, pair boolean, n bigint").groupBy("pair", "h").agg(F.sum("n").alias("n"), F.min("w").alias("w")), "sampled")
    top = [found.where(F.col("pair") == kind).orderBy(F.desc("n"), "h").limit(most).select("h", "w").toArrow() for kind in (False, True)]
    words = Places(np.sort(top[0]["h"].to_numpy().view(U)))
    pairs = top[1]["h"].to_numpy().view(U)[words.of(top[1]["w"].to_numpy().view(U)) >= 0]
    return words, Places(np.sort(pairs))


def count_frequent(rows: DataFrame, words: Places, pairs: Places) -> tuple[np.ndarray, int]:
    """Exact counts (half, model, cell) over all documents, the cells being the frequent words, their pairs and all tokens;
    and the number of distinct words of any kind."""
    width = len(words) + len(pairs) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 * width, np.int64)
        sent = np.zeros(SENT, U)  # rare words that were sent lately: a word may go twice, but mostly goes once
        sent[0] = 1  # no hash of this place
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            half, good = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for i, j in steps(offsets, KERNEL_BYTES):
                h, at_row, at, pair = tokens(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                w, p = words.of(h), pairs.of(pair)
                kind = (half[i:j] * 2 + good[i:j]).astype(np.int64)[at_row] * width
                for cell in (kind[w >= 0] + w[w >= 0], kind[at][p >= 0] + len(words) + p[p >= 0], kind + width - 1):
                    np.add.at(total, cell, 1)
                rare = h[w < 0]
                rare = np.unique(rare[sent[(rare % U(SENT)).astype(np.int64)] != rare])
                sent[(rare % U(SENT)).astype(np.int64)] = rare
                rare = rare.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rare), pa.nulls(len(rare), pa.binary())], ["h", "piece"])
        # Counts go by the piece, the same byte of all numbers together, which compresses well.
        total = np.pad(total, (0, -len(total) % CHUNK)).reshape(-1, CHUNK)
        for c in np.flatnonzero(total.any(1)):
            piece = pa.compress(total[c].view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([piece], pa.binary())], ["h", "piece"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        rare = np.zeros(0, np.int64)
        for batch in batches:
            whole = batch.column(1).is_valid()
            rare = np.union1d(rare, batch.column(0).filter(pc.invert(whole)).to_numpy())
            part = batch.filter(whole)
            for c, piece in zip(part.column(0).to_pylist(), part.column(1)):
                new = np.frombuffer(pa.decompress(piece.as_buffer(), 8 * CHUNK, "zstd"), np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()
                have[c] = have[c] + new if c in have else new
        for c, piece in have.items():
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([piece.tobytes()], pa.binary())], ["h", "piece"])
        yield pa.RecordBatch.from_arrays([pa.array([len(rare)]), pa.nulls(1, pa.binary())], ["h", "piece"])

    kind = "h bigint, piece binary"
    table = rows.select("text", "half", "good").mapInArrow(count, kind).repartition("h").mapInArrow(add, kind).toArrow()
    total, n_rare = np.zeros(-(-4 * width // CHUNK) * CHUNK, np.int64), 0
    for h, piece in zip(table["h"].to_pylist(), table["piece"]):
        if piece.is_valid:
            total[h * CHUNK:(h + 1) * CHUNK] = np.frombuffer(piece.as_buffer(), np.int64)
        else:
            n_rare += h
    out = total[:4 * width].astype(float).reshape(2, 2, width)
    # The target has the good ones, the background all.
    return np.stack([out[:, 1], out[:, 0] + out[:, 1]], 1), len(words) + n_rare


def set_bits(bitmap: np.ndarray, cells: np.ndarray) -> None:
    for bit in range(8):  # repeated places are harmless, as all write the same
        bitmap[cells[cells & 7 == bit] >> 3] |= np.uint8(1 << bit)


def cells_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h ^ U(0x5851F42D4C957F2D)) >> U(64 - bits)).astype(np.int64)


def has_bits(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    cell = cells_of(h, len(bitmap).bit_length() + 2)
    return (bitmap[cell >> 3] >> (cell & 7).astype(np.uint8) & 1) > 0


def sparse(piece: np.ndarray, at: np.ndarray) -> bytes:
    """The bytes of a piece at the places ``at``, behind the gaps between them: their low bytes, their high bytes."""
    gaps = np.diff(at, prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2)
    return np.concatenate([gaps.T.ravel(), piece[at]]).tobytes()


def from_sparse(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n places and bytes that ``sparse`` has packed."""
    return np.cumsum(data[:n].astype(np.int64) + (data[n:2 * n].astype(np.int64) << 8)), data[2 * n:]


def in_both_halves(rows: DataFrame, words: Places, pairs: Places, bits: int) -> np.ndarray:
    """Bitmap that has the bit of every word and pair which occurs in both halves and isn't frequent.

    A task marks both halves' hashes and sends the pieces that aren't empty, compressed; pieces are united as they
    arrive, so a task of the second stage holds the bitmap once, however many tasks the first stage has.  The driver gets
    the pieces that aren't empty, compressed."""
    size = 2 * CHUNK

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros((2, 1 << bits - 3), np.uint8)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            half = batch.column(1).to_numpy()
            for i, j in steps(offsets, KERNEL_BYTES):
                h, at_row, at, pair = tokens(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                rare, rare_pair, side = words.of(h) < 0, pairs.of(pair) < 0, half[i:j][at_row]
                for b in (0, 1):
                    set_bits(have[b], cells_of(np.r_[h[rare & (side == b)], pair[rare_pair & (side[at] == b)]], bits))
        full = np.flatnonzero(have.reshape(2, -1, CHUNK).any((0, 2)))
        for k in range(0, len(full), 1024):
            some, sizes, pieces = full[k:k + 1024], [], []
            for c in some:
                piece = have[:, c * CHUNK:(c + 1) * CHUNK].ravel()
                at = np.flatnonzero(piece)
                sizes.append(len(at) if 4 * len(at) < size else size)
                pieces.append(pa.compress(sparse(piece, at) if sizes[-1] < size else piece.tobytes(), "zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sizes), pa.array(pieces, pa.binary())], ["c", "n", "piece"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, n, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if c not in have:
                    have[c] = np.zeros(size, np.uint8)
                if n < size:
                    at, value = from_sparse(np.frombuffer(pa.decompress(piece.as_buffer(), 3 * n, "zstd"), np.uint8), n)
                    have[c][at] |= value
                else:
                    have[c] |= np.frombuffer(pa.decompress(piece.as_buffer(), size, "zstd"), np.uint8)
        for c, piece in have.items():
            both = piece[:CHUNK] & piece[CHUNK:]
            if both.any():
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([pa.compress(both.tobytes(), "zstd", asbytes=True)], pa.binary())], ["c", "piece"])

    kind = "c bigint, piece binary"
    got = rows.select("text", "half").mapInArrow(mark, "c bigint, n bigint, piece binary").repartition("c").mapInArrow(unite, kind).toArrow()
    out = np.zeros(1 << bits - 3, np.uint8)
    for c, piece in zip(got["c"].to_pylist(), got["piece"]):
        out[c * CHUNK:(c + 1) * CHUNK] = np.frombuffer(pa.decompress(piece.as_buffer(), CHUNK, "zstd"), np.uint8)
    return out


def packed(kind, flag: np.ndarray, n: np.ndarray, ends=0) -> np.ndarray:
    """Kind (2 bits), good, half, whether the word ends its document, and how often it occurs, as one number."""
    return n.astype(np.int64) << 5 | ends << 4 | flag.astype(np.int64) << 2 | kind


def score(docs: DataFrame, labels: DataFrame, strength: float = 50.0, frequent_cells: int = 1 << 18) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for every row of ``docs``; losses are mean nats a token.

    Null, empty and blank texts have no tokens and zeros.  Where the other half has no good document the score is 0.
    Equal texts of a half score alike, an empty table gives an empty result, other columns are ignored.
    ``frequent_cells`` bounds what each task holds; any value gives the same result.
    """
    n_docs, n_bytes = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    words, pairs = frequent(docs, frequent_cells, n_docs)
    rows = with_labels(docs, labels)
    # As a broadcast the bitmap is written to a file once; in the function it would be copied with each of its pickles.
    sieve = docs.sparkSession.sparkContext.broadcast(
        in_both_halves(rows, words, pairs, min(max(int(n_bytes).bit_length(), SIEVE_BITS[0]), SIEVE_BITS[1])))
    counts, n_words = count_frequent(rows, words, pairs)
    total = counts[..., -1]
    factor = [[1.0, total[b, 0] / total[b, 1] if total[b].all() else 1.0] for b in (0, 1)]
    whole = [[total[b, k] * factor[b][k] + 0.5 * (n_words + 1) for k in (0, 1)] for b in (0, 1)]
    usable = [bool(total[1 - b, 0]) for b in (0, 1)]
    # By the half of the document: the models are those of the other half.
    scaled = (counts * np.array(factor)[..., None])[::-1]
    one = (scaled[..., :len(words)] + 0.5) / np.array(whole)[::-1, :, None]
    as_word, as_first = -np.log(one), np.log1p(scaled[..., :len(words)] / strength)
    pair_count = scaled[..., len(words):-1]
    unseen = np.log(2 * np.array(whole)[::-1])  # loss of a word that the other half doesn't have

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sieve.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            keys, halves, goods = (batch.column(c).to_numpy() for c in (0, 2, 3))
            for i, j in steps(offsets, KERNEL_BYTES):
                h, at_row, at, pair = tokens(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                key, half, good = keys[i:j], halves[i:j], goods[i:j]
                w, p = words.of(h), pairs.of(pair)
                before = np.zeros(len(h), bool)
                before[at - 1] = True
                known, known_pair = np.flatnonzero(w >= 0), np.flatnonzero(p >= 0)
                rare, rare_pair = w < 0, p < 0
                rare[rare] = has_bits(both, h[rare])
                rare_pair[rare_pair] = has_bits(both, pair[rare_pair])
                alone = np.flatnonzero((w < 0) & ~rare)
                base = []
                for k in (0, 1):
                    x = np.zeros(len(h))
                    b = half[at_row[known]]
                    x[known] = as_word[b, k, w[known]] + before[known] * as_first[b, k, w[known]]
                    x[alone] = unseen[half[at_row[alone]], k]
                    b, end = half[at_row[at[known_pair]]], at[known_pair]
                    x[end] -= np.log1p(pair_count[b, k, p[known_pair]] / (strength * one[b, k, w[end]]))
                    base.append(np.rint(np.bincount(at_row, x, j - i) * SCALE).astype(np.int64))
                n = np.bincount(at_row, minlength=j - i)
                rare, rare_pair = np.flatnonzero(rare), np.flatnonzero(rare_pair)
                r1, h1, n1, m1 = counted(at_row[rare], h[rare], before[rare].astype(np.int64))
                end = at[rare_pair]
                # The last word of a pair: its place where it is frequent, else its hash.
                last, hot = np.where(w[end] >= 0, w[end], h[end].view(np.int64)), (w[end] >= 0).astype(np.int64)
                r2, h2, n2, _ = counted(at_row[end], pair[rare_pair], hot)
                order = np.lexsort((pair[rare_pair], at_row[end]))
                pick = order[np.r_[0, np.cumsum(n2)[:-1]]] if len(n2) else order
                flag = half * 2 + good
                # kind 0: a document (its base losses, number of words); 1: a word; 2: a pair after a rare word; 3: a pair
                # These rows are most of what is shuffled: four numbers each, the last of which packs the small ones.
                is_hot, hot_last = hot[pick] > 0, last[pick]
                word, pair_hash = h1.view(np.int64), h2.view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.r_[key, word, np.where(is_hot, pair_hash, hot_last)]),
                    pa.array(np.r_[base[0], np.zeros(len(r1), np.int64), np.where(is_hot, hot_last, pair_hash)]),
                    pa.array(np.r_[base[1], key[r1], key[r2]]),
                    pa.array(np.r_[packed(0, flag, n), packed(1, flag[r1], n1, n1 - m1), packed(2 + hot[pick], flag[r2], n2)])], ["a", "b", "c", "d"])

    out = rows.mapInArrow(emit, "a bigint, b bigint, c bigint, d bigint").repartition("a")
    kind, half, good, n = (F.col("d").bitwiseAND(3), F.shiftright("d", 3).bitwiseAND(1), F.shiftright("d", 2).bitwiseAND(1) == 1, F.shiftright("d", 5))
    is_word, is_pair = kind == 1, kind >= 2
    m = n - F.shiftright("d", 4).bitwiseAND(1)

    def of_other_half(name: str, which: Column, over) -> list[Column]:
        """Target and background count over the group, in the half that the row isn't in."""
        sums = [[F.sum(F.when(which & (half == b) & ok, n).otherwise(F.lit(0))).over(over) for ok in (good, F.lit(True))] for b in (0, 1)]
        return [(F.when(half == 0, sums[1][k] * F.lit(factor[1][k])).otherwise(sums[0][k] * F.lit(factor[0][k]))).alias(f"{name}{k}") for k in (0, 1)]

    # One exchange by ``a`` serves both groupings.
    out = out.select("*", *of_other_half("pair", is_pair, Window.partitionBy("a", "b"))).where((kind < 2) | (F.col("pair1") > 0))
    out = out.select("*", *of_other_half("word", is_word, Window.partitionBy("a")))
    spark = docs.sparkSession
    table = pa.table({"place": np.arange(len(words)), **{f"one{b}{k}": one[b, k] for b in (0, 1) for k in (0, 1)}})
    known = spark.createDataFrame(table)
    out = out.join(F.broadcast(known), (kind == 3) & (F.col("b") == F.col("place")), "left")
    terms = []
    for k in (0, 1):
        rare = (F.col(f"word{k}") + 0.5) / F.when(half == 0, F.lit(whole[1][k])).otherwise(F.lit(whole[0][k]))
        first = F.log1p(F.col(f"word{k}") / F.lit(strength))
        p = F.when(kind == 3, F.when(half == 0, F.col(f"one0{k}")).otherwise(F.col(f"one1{k}"))).otherwise(rare)
        x = F.when(is_word, m * first - n * F.log(rare)).otherwise(-n * F.log1p(F.col(f"pair{k}") / (F.lit(strength) * p)))
        terms.append(F.sum(F.when(kind == 0, F.col("bc"[k])).otherwise(F.rint(x * SCALE).cast("bigint"))).alias(f"x{k}"))
    # Rows that repeat both id and text share one key.
    sums = out.groupBy(F.when(kind == 0, F.col("a")).otherwise(F.col("c")).alias("key")).agg(
        *terms, F.sum(F.when(kind == 0, n)).alias("n"), F.count(F.when(kind == 0, 1)).alias("copies"))
    loss = [F.when(F.col("n") > 0, F.col(f"x{k}") / F.lit(SCALE) / F.col("n")).otherwise(F.lit(0.0)) for k in (0, 1)]
    able = F.when(F.col("own") == 0, F.lit(usable[0])).otherwise(F.lit(usable[1]))
    ids = docs.select("doc_id", row_key().alias("key"), half_of_id().alias("own"))
    return ids.join(sums, "key").select("doc_id", F.expr("n div copies").alias("n_tokens"), loss[0].alias("target_loss"), loss[1].alias("background_loss"),
                                        F.when(able, loss[1] - loss[0]).otherwise(F.lit(0.0)).alias("score"))
