"""Operator 4: document fingerprints from closed syncmers.

A window of ``K`` bytes is a closed syncmer when its least inner ``S``-byte hash stands at either edge. Whether a
window is chosen depends on the window alone, so the same passage gives the same anchors wherever it stands. A
fingerprint keeps all anchors, repeated ones too, each with its position, written in text order as
``hash.position`` joined by blanks. Likeness is the share of the anchors of both fingerprints together (the k-th of
one hash meets the k-th) that stand in both and in the same order (the longest increasing chain of positions).

For the query, each text also meets the next document by ascending doc_id: documents are dealt into ranges of
doc_id, the first of each range is sent to the range before it as well, and each range streams in order.

Edge cases: a null text counts as empty; an empty text has the empty fingerprint (likeness 1 to another empty
one, else 0); a text without a chosen window has one anchor, the hash of all its bytes. Rows with a null doc_id
come before all others; equal ids are ordered by text. A single document is its own next. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.llm import text_arrays as ta

K, S = 24, 12
INNER = K - S + 1
SLICE = 1 << 18
#: Bytes of text whose anchors and strings a task makes at a time.
PART = 1 << 21
LEAST = -(1 << 63)


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position in its row, row) of every closed syncmer."""
    total = ta.prefix_code(ta.BYTE_CODE[raw])
    _, down = ta.powers(len(total))
    m = len(raw) - K + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = ta.mix((total[S:] - total[:-S]) * down[: len(raw) - S + 1])
    least, width = inner, 1
    while 2 * width <= INNER:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < INNER:
        least = np.minimum(least[: len(least) - (INNER - width)], least[INNER - width :])
    at = np.flatnonzero((inner[:m] == least[:m]) | (inner[INNER - 1 : INNER - 1 + m] == least[:m]))
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + K <= offsets[row + 1]
    at, row = at[inside], row[inside]
    return ta.span_hash(total, at, at + K), at - offsets[row], row


#: (positions, 32-bit hashes, hashes with how many of the same stand before) of a text's anchors by position.
Print = tuple[np.ndarray, np.ndarray, np.ndarray]


def fingerprints(texts: pa.Array) -> list[Print]:
    """All anchors of each text."""
    out: list[Print] = []
    for a, b, raw, offsets in ta.slices(texts, SLICE):
        code, at, row = anchors(raw, offsets)
        code = code >> ta.U(32)
        order = np.lexsort((at, code, row))
        new = np.r_[True, (code[order][1:] != code[order][:-1]) | (row[order][1:] != row[order][:-1])] if len(code) else np.zeros(0, bool)
        place = np.arange(len(order))
        nth = np.empty(len(order), np.uint64)
        nth[order] = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
        key, short = code << ta.U(32) | nth, code.astype(np.uint32)
        cut = np.searchsorted(row, np.arange(b - a + 1)).tolist()
        whole = ta.span_hash(ta.prefix_code(ta.BYTE_CODE[raw]), offsets[:-1], offsets[1:]) >> ta.U(32)
        for i in range(b - a):
            own = slice(cut[i], cut[i + 1])
            if cut[i] == cut[i + 1] and offsets[i] < offsets[i + 1]:
                out.append((np.zeros(1, np.int64), whole[i : i + 1].astype(np.uint32), whole[i : i + 1] << ta.U(32)))
            else:
                out.append((at[own], short[own], key[own]))
    return out


def likeness(x: Print, y: Print) -> float:
    if np.array_equal(x[0], y[0]) and np.array_equal(x[2], y[2]):
        return 1.0
    _, i, j = np.intersect1d(x[2], y[2], assume_unique=True, return_indices=True)
    if len(i) == 0:
        return 0.0
    there = y[0][j[np.argsort(i)]]
    long = len(there)
    if (there[1:] < there[:-1]).any():
        chain: list[int] = []
        for p in there.tolist():
            k = bisect_left(chain, p)
            chain[k : k + 1] = [p]
        long = len(chain)
    return long / (len(x[2]) + len(y[2]) - len(i))


def written(own: Print) -> str:
    h = own[1].astype(">u4").tobytes().hex()
    return " ".join([f"{h[8 * k : 8 * k + 8]}.{p}" for k, p in enumerate(own[0].tolist())])


def sketch(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of docs with the ``fingerprint`` of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = pa.array([written(f) for f in fingerprints(batch.column(len(keep)))], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), said], names=[*keep, "fingerprint"])

    return docs.select(*keep, docs["text"].alias("_text")).mapInArrow(run, docs.select(*keep).schema.add("fingerprint", "string"))


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, last, doc_id, text) come in order; each but the last of a bucket meets the next one.

    Anchors and their strings are made for some rows at a time, about PART bytes of text.
    """
    held: tuple | None = None
    for batch in (whole.slice(a, b - a) for whole in batches for a, b, _, _ in ta.slices(whole.column(3), PART)):
        prints = fingerprints(batch.column(3))
        rows = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), [t or "" for t in batch.column(3).to_pylist()], prints, strict=True))
        rows = rows if held is None else [held, *rows]
        held = rows[-1]
        pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if a[0] == b[0]]
        edited = []
        for (_, _, text, _), (_, _, after, _) in pairs:
            half = len(text) // 2
            edited.append(text[: len(text) - half] + after[:half])
        new = fingerprints(pa.array(edited, pa.large_string()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([a[1] for a, _ in pairs], pa.int64()),
                pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([written(a[3]) for a, _ in pairs], pa.string()),
                pa.array([written(f) for f in new], pa.string()),
                pa.array([likeness(a[3], f) for (a, _), f in zip(pairs, new, strict=True)], pa.float64()),
                pa.array([likeness(a[3], b[3]) for a, b in pairs], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )
    ta.release()


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the key, by halving steps over one constant array."""
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)] if bounds else []
    if not steps:
        return F.lit(0)
    there = F.lit(bounds)
    further = lambda at, step: (at + step <= len(bounds)) & (F.get(there, at + step - 1) <= key)
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document."""
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(LEAST)))
    bounds = sorted(set(rows.approxQuantile("key", [k / ranges for k in range(1, ranges)], 0.2 / ranges)))
    rows = rows.withColumn("bucket", _range_of(F.col("key"), [int(b) for b in bounds]))
    heads = rows.groupBy("bucket").agg(F.min(F.struct("key", "text")).alias("head"))
    full = sorted(r.bucket for r in rows.groupBy("bucket").count().select("bucket").collect())  # at most ``ranges`` numbers
    if not full:
        full = [0]
    before = dict(zip(full, [full[-1], *full[:-1]], strict=True))
    earlier = F.get(F.lit([before.get(b, 0) for b in range(full[-1] + 1)]), F.col("bucket"))
    sent = heads.select(earlier.alias("bucket"), F.lit(1).alias("last"), F.lit(None).cast("long").alias("doc_id"), "head.text", "head.key")
    both = rows.select("bucket", F.lit(0).alias("last"), "doc_id", "text", "key").unionByName(sent)
    ordered = both.repartition("bucket").sortWithinPartitions("bucket", "last", "key", "text").select("bucket", "last", "doc_id", "text")
    return ordered.mapInArrow(_with_next, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
