"""Operator 1: a quality classifier over hashed word n-grams, trained with FTRL-proximal updates.

Features of a text: hashed lower-cased words and word pairs, hashed word shapes (runs of letter case, digits
and the other characters as they stand) of one to three words, and a marker for a word that repeats its
neighbour. A text's score is the logistic of a bias plus the mean weight of each family of its n-grams: a
sparse dot product with counts divided by the family's length, so long and short texts compare.

Training uses at most ``MOST_LABELLED`` labelled rows (those with the smallest crc32 of their id, so the
choice does not depend on the layout), dealt to ``SHARDS`` tasks. Each runs FTRL over its rows and the weights
are averaged; the driver sees SHARDS vectors of 2**BITS floats whatever the corpus holds.

Edge cases: a null or empty text scores the bias alone. Rows with a null id are scored, held_out false.
Labels with a null id or a value other than 0 and 1 are ignored; of several labels for one id the lowest
counts. With no labels at all every score is 0.5. Repeated rows give repeated rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm import text_arrays as ta

BITS = 18
#: The largest number of labelled rows that training reads; crc32 of the id picks them.
MOST_LABELLED = 16_384
SHARDS = 8
EPOCHS = 4
FAMILIES = 6
SCALE = 6.0
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.002, 0.01
THRESHOLD = 0.7
HELD_OUT_MOD, HELD_OUT = 4, 2

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = 65
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[48:58] = 48


def _shapes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of word shapes: character classes with runs written once."""
    kind = _CLASS[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[start] = True
    rank = np.concatenate(([0], np.cumsum(keep)))
    return ta.span_hash(ta.prefix_code(ta.BYTE_CODE[kind[keep]]), rank[start], rank[end])


def features(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family: the feature number and the row of each n-gram."""
    start, end, row = ta.words(raw, offsets)
    if len(start) == 0:
        return [(np.zeros(0, np.int64), row)] * FAMILIES
    word = ta.word_hashes(raw, start, end)
    shape = _shapes(raw, start, end)
    same = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    repeat = np.zeros(len(word), np.uint64)
    repeat[1:] = same
    families = [(word, row), ta.ngrams(word, row, 2), (shape, row), ta.ngrams(shape, row, 2), ta.ngrams(shape, row, 3), (repeat, row)]
    return [((ta.mix(c + ta.U(97 * k + 1)) >> ta.U(64 - BITS)).astype(np.int64), r) for k, (c, r) in enumerate(families)]


def margins(weights: np.ndarray, bias: float, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    total = np.full(n, bias)
    for idx, row in features(raw, offsets):
        if len(idx):
            count = np.bincount(row, minlength=n)
            total += SCALE * np.bincount(row, weights[idx], n) / np.maximum(count, 1)
    return total


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Per-coordinate FTRL-proximal logistic regression; the last weight is the bias (feature 2**BITS, value 1)."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for (idx, value), y in zip(rows, labels, strict=True):
            zi, root = z[idx], np.sqrt(n[idx])
            w = np.where(np.abs(zi) <= L1, 0, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2))
            g = (1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ value))))) - y) * value
            square = n[idx] + g * g
            z[idx] = zi + g - (np.sqrt(square) - root) / ALPHA * w
            n[idx] = square
    return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _train_shard(table: pa.Table) -> pa.Table:
    table = table.sort_by([("order", "ascending"), ("doc_id", "ascending")])
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for _, _, raw, offsets in ta.slices(table["text"].combine_chunks()):
        n = len(offsets) - 1
        parts = []
        for idx, row in features(raw, offsets):
            count = np.maximum(np.bincount(row, minlength=n), 1)
            parts.append((row, idx, SCALE / count[row]))
        row, idx, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        key, at = np.unique(row * (1 << BITS) + idx, return_inverse=True)
        total = np.bincount(at, value, len(key))
        cuts = np.searchsorted(key, np.arange(n + 1) * (1 << BITS))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows.append((np.append(key[a:b] % (1 << BITS), 1 << BITS), np.append(total[a:b], 1.0)))
    weights = ftrl(rows, table["label"].to_numpy())
    return pa.table({"shard": [table["shard"][0].as_py()], "weights": [weights.astype(np.float32).tobytes()]}, schema=pa.schema([("shard", pa.int64()), ("weights", pa.binary())]))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[np.ndarray, float]:
    """Weights (2**BITS floats) and bias learnt from labelled rows that are not held out."""
    order = F.crc32(F.col("doc_id").cast("string"))
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
        .select("doc_id", "label", order.alias("order"))
        .where(F.col("order") % HELD_OUT_MOD != HELD_OUT)
        .orderBy("order", "doc_id").limit(most)
    )
    # At most ``most`` rows of three numbers: a size known before the job runs.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    shards = rows.withColumn("shard", F.floor(F.col("order") / 7) % SHARDS)
    found = shards.groupBy("shard").applyInArrow(_train_shard, "shard long, weights binary").orderBy("shard").collect()
    if not found:
        return np.zeros(1 << BITS, np.float32), 0.0
    mean = np.mean([np.frombuffer(r.weights, np.float32) for r in found], axis=0)
    return mean[:-1].astype(np.float32), float(mean[-1])


def score(docs: DataFrame, weights: np.ndarray, bias: float, keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` columns of docs with the score as ``name``, which must be none of them."""
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))
    schema = docs.select(*keep).schema.add(name, "double")
    at = keep.index("text") if "text" in keep else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, end, raw, offsets in ta.slices(batch.column(at if at >= 0 else batch.num_columns - 1)):
                out[first:end] = sigmoid(margins(w, b, raw, offsets))
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out)], names=[*keep, name])

    return docs.select(*keep, *([] if at >= 0 else ["text"])).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns (doc_id) with score and predicted (1 if score >= threshold)."""
    out = score(docs, *train(docs, labels), keep or ["doc_id"])
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score ``threshold`` or more, with their columns, whatever their names."""
    plain = ta.by_place(docs)
    return score(plain, *train(docs, labels), plain.columns, "score").where(F.col("score") >= threshold).drop("score").toDF(*docs.columns)
