"""Quality classifier: hashed word n-grams, logistic regression fitted by follow-the-regularised-leader (FTRL-proximal).

A text's features are its distinct hashed words and word pairs (A-Z lower-cased, words between ASCII white space), and
hashed shapes of words: what their marks, digits and capitals look like, so that words never met still tell something.
Values are log-damped counts scaled to unit length, so texts of any length weigh alike. The score is the logistic
function of a sparse dot product.

Fitting reads a bounded sample of the labelled rows (``max_rows``; those with the least hash of their id, so the sample
does not depend on order): tasks turn their whole texts into features, ``epochs`` passes over these are made on the driver,
which gets at most ``max_rows`` times ``2 ** bits`` indexes and counts. Scoring reads whole texts, in the tasks that hold
them, without a shuffle; the weights (``2 ** bits`` floats) go to each task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import releasing, table, with_field

BITS = 18
MAX_ROWS = 6_000
EPOCHS = 3
MEMO_WORDS = 200_000
PAIR = np.uint64(0x9E3779B97F4A7C15)
_SHAPES = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


class Features:
    """Hashed features of a text as (indexes, values); remembers words it has met, up to a fixed number."""

    def __init__(self, bits: int):
        self.bits, self.memo = bits, {}

    def _word(self, w: bytes) -> tuple[int, int]:
        shape = w.translate(_SHAPES)
        squeezed = bytes(b for k, b in enumerate(shape) if not k or b != shape[k - 1])
        return xxhash.xxh3_64_intdigest(w.lower()), xxhash.xxh3_64_intdigest(squeezed, 1)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        raw = (text or "").encode("utf-8", "surrogatepass").split()
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        for w in set(raw).difference(self.memo):
            self.memo[w] = self._word(w)
        both = np.array(list(map(self.memo.__getitem__, raw)), np.uint64).reshape(-1, 2)
        words, shapes = both[:, 0], both[:, 1]
        pairs = (words[:-1] * PAIR) ^ words[1:]
        pairs = np.where(words[:-1] == words[1:], np.uint64(1), pairs)  # a word said twice, whatever the word
        hashed = np.concatenate((words, pairs * PAIR, shapes, (shapes[:-1] * PAIR) ^ shapes[1:] ^ PAIR)) >> np.uint64(64 - self.bits)
        return np.unique(hashed.astype(np.int64), return_counts=True)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        at, counts = self.counts(text)
        return at, unit(counts)


def unit(counts: np.ndarray) -> np.ndarray:
    """Log-damped counts scaled to unit length."""
    values = 1 + np.log(counts)
    return values / max(np.sqrt((values * values).sum()), 1e-9)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """FTRL-proximal weights (the last is the intercept) from (indexes, counts, label 0 or 1) rows, in their order."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    w = np.zeros(size)
    for _ in range(epochs):
        for at, counts, y in rows:
            at, x = np.append(at, size - 1), np.append(unit(counts), 1.0)
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] += g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)).astype(np.float32)


def held_out(doc_id) -> F.Column:
    """Of the id as text, whether its CRC-32 is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_rows: int = MAX_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights from the labelled, not held-out rows; at most ``max_rows``, picked by the hash of their id.

    Null labels, ids and texts do not count; of an id with several labels the least counts, of repeated rows all.
    Without any labelled row every score is one half.
    """
    known = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg((F.min(label) > 0).cast("int").alias("y"))
    known = known.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").filter("text is not null").select("doc_id", "y", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = Features(bits)
        for batch in batches:
            found = [counted.counts(t.as_py()) for t in batch.column(2)]
            packed = [pa.array([x[k].astype("<i4").tobytes() for x in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *packed], names=["doc_id", "y", "at", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(releasing(features), f"doc_id {kind}, y int, at binary, counts binary").collect()  # bounded by max_rows and 2 ** bits
    rows = sorted((zlib.crc32(str(r.doc_id).encode()), r.doc_id, bytes(r["at"]), bytes(r["counts"]), r.y) for r in rows)
    return fit([(np.frombuffer(at, "<i4"), np.frombuffer(counts, "<i4"), y) for _, _, at, counts, y in rows], bits)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` and its score (0 to 1; null and empty texts have the intercept's). Repeated rows score alike; an empty table
    stays empty; texts of any length are read whole. A column named ``out_col`` is replaced, all others stay."""
    docs = docs.drop(out_col)
    at = docs.columns.index(text_col)
    bits = (len(weights) - 1).bit_length() - 1
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(bits), sent.value
        for batch in batches:
            out = []
            for text in batch.column(at):
                k, x = features(text.as_py())
                out.append(1 / (1 + np.exp(-np.clip(w[k] @ x + w[-1], -35, 35))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(releasing(rows), with_field(docs, out_col, "double"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a classifier fitted on the labelled ones that are not held out. A null id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(spark, docs, table(spark, sf_dir, "labels"))
    scored = score(docs, weights)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
