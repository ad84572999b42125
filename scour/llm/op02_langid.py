"""Language identification with error-correcting output codes.

Every language has a codeword of +1/-1 bits.  For each bit a linear classifier over hashed byte trigrams tells
the languages with +1 from those with -1.  Decoding sums, over the bits, a logistic loss of the margin against
the codeword, weighted by how reliable the bit proved on tuning rows; the codeword with the least loss wins,
and a text whose two best codewords are nearly equal is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scour.llm.common import KERNEL_BYTES, crc_of_id, plain_text, steps, text_buffers, unit_hash

BITS = 16  # of the trigram hash
_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram and row; bytes that can't be part of a letter count as blanks, blank pairs are left out."""
    b = _LETTER[data].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    ok = (b[1:-1] != 0x20) | ((b[:-2] != 0x20) & (b[2:] != 0x20))
    last = offsets[1:][np.diff(offsets) > 0] - 1
    cross = np.zeros(len(b), bool)
    cross[last] = True
    cross[np.maximum(last - 1, 0)] = True
    at = np.flatnonzero(ok & ~cross[:-2])
    return ((code[at] * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64), np.searchsorted(offsets, at, side="right") - 1


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of +1/-1: the exhaustive code up to six languages, else the best of many seeded random codes."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 6:
        cols = 2 ** (n - 1) - 1
        out = np.ones((n, cols))
        for row in range(1, n):
            out[row] = np.where((np.arange(cols) + 1) >> (n - 1 - row) & 1, -1, 1)
        return out
    rng, best, found = np.random.default_rng(seed), -1, None
    width = max(31, 4 * int(np.ceil(np.log2(n))))
    for _ in range(200):
        code = np.where(rng.random((n, width)) < 0.5, -1.0, 1.0)
        code = code[:, np.abs(code.sum(0)) < n]
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if apart > best:
            best, found = apart, code
    return found


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weight: np.ndarray  # bits x buckets
    scale: np.ndarray  # of each bit's margin
    trust: np.ndarray  # of each bit

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        idx, rows = trigrams(data, offsets)
        n = len(offsets) - 1
        size = np.maximum(np.bincount(rows, minlength=n), 1)
        return np.stack([np.bincount(rows, w[idx], n) / size for w in self.weight], 1) if len(self.weight) else np.zeros((n, 0))

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score and lead over the second best, for each row."""
        z = margins * self.scale
        loss = np.stack([(np.logaddexp(0, -z * c) * self.trust).sum(1) for c in self.code], 1)
        best = loss.argmin(1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        top = np.sort(loss, 1)
        lead = top[:, 1] - top[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return best, 1 / p.sum(1), lead


def _counts(df: DataFrame, langs: list[str]) -> np.ndarray:
    """Trigram counts of the sample, languages x buckets; each task sends its own sums."""
    number = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), 1 << BITS), np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            lang = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for i, j in steps(offsets):
                idx, rows = trigrams(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                total += np.bincount(lang[i:j][rows] << BITS | idx, minlength=total.size).reshape(total.shape)
        flat = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(total.ravel()[flat])], ["cell", "n"])

    table = df.select("text", "lang").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((len(langs), 1 << BITS))
    out.ravel()[table["cell"].to_numpy()] = table["n"].to_numpy()
    return out


def _margins(df: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    number = {x: i for i, x in enumerate(model.langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            lang = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for i, j in steps(offsets):
                m = model.margins(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([pa.array(lang[i:j]), pa.array(list(m), pa.list_(pa.float64()))], ["lang", "m"])

    got = df.select("text", "lang").mapInArrow(run, "lang bigint, m array<double>").toArrow()
    return got["lang"].to_numpy(), np.array(got["m"].to_pylist()).reshape(-1, model.code.shape[1])


def train(docs: DataFrame, per_language: int = 1500) -> Model:
    """Fit on rows with a language whose crc32(doc_id) mod 3 is not 1.

    The sample is bounded: about ``per_language`` rows of each language fit the classifiers and a third as many
    others tune the bits (whole texts, chosen by a hash of id and text).  Only these bounded counts and
    margins reach the driver.
    """
    pool = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_of_id() % 3 != 1))
    known = {r["lang"]: r["n"] for r in pool.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(known, key=lambda x: (-known[x], x))
    code = codewords(len(langs))
    if len(langs) < 2:
        return Model(langs, code, np.zeros((0, 1 << BITS)), np.zeros(0), np.zeros(0))
    u, rate = unit_hash("doc_id", "text"), F.lit(0.0)
    for x in langs:
        rate = F.when(F.col("lang") == x, F.lit(min(1.0, per_language / known[x]))).otherwise(rate)
    counts = _counts(pool.where(u < rate * 0.75), langs)
    weight = []
    for bit in code.T:
        # Languages count alike, however many rows they have.
        share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
        weight.append(np.log(share[bit > 0].mean(0)) - np.log(share[bit < 0].mean(0)))
    model = Model(langs, code, np.array(weight, np.float32), np.ones(code.shape[1]), np.ones(code.shape[1]))
    lang, m = _margins(pool.where((u >= rate * 0.75) & (u < rate)), model)
    if len(lang):
        signed = m * code[lang]
        model.scale = 4.0 / np.maximum(np.abs(m).mean(0), 1e-9)
        model.trust = np.maximum((signed > 0).mean(0) - 0.5, 0.01) * 2
    return model


def identify(docs: DataFrame, model: Model | None = None, lead: float = 0.5, carry: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) for every row; ``model`` defaults to one trained on ``docs``.

    Null text, or text without a letter, is ``und`` with score 0.  A text with letters always gets a learned
    language; one whose best two codewords differ by less than ``lead`` in loss is ``ambiguous``.  Without any
    learned language every row is ``und``.  Predictions read the text only; ties go to the language with more
    training rows.  Repeated rows are scored alike, an empty table gives an empty result, other columns are
    ignored, or with ``carry`` returned as the struct ``row``.
    """
    model = model or train(docs)
    id_type, text = docs.schema["doc_id"].dataType.simpleString(), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, "und"], object)
        for batch in batches:
            data, offsets = text_buffers(batch.column(3).field(text) if carry else batch.column(3))
            letter = np.array(batch.column(2).to_pylist(), bool)
            for i, j in steps(offsets, KERNEL_BYTES):
                ok = letter[i:j] & bool(model.langs)
                if model.langs:
                    best, score, gap = model.decode(model.margins(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]))
                else:
                    best, score, gap = np.zeros(j - i, int), np.zeros(j - i), np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(names[np.where(ok, best, -1)], pa.string()),
                    pa.array(np.where(ok, score, 0.0)), pa.array(ok & (gap < lead)), *(batch.column(3).slice(i, j - i) for _ in range(carry))],
                    ["doc_id", "held_out", "lang_pred", "score", "ambiguous", *["row"] * carry])

    # With ``carry`` the text travels once, in the row.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    given = docs.select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), plain_text().rlike("\\p{L}").alias("letter"), whole if carry else plain_text().alias("text"))
    row = f", row {given.schema['row'].dataType.simpleString()}" if carry else ""
    return given.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, ambiguous boolean{row}")
