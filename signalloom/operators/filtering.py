"""Filters and spectra of signals held as one array a channel (rec, ch, x), in Arrow batches; rows stay where they are."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.functions import filters


#: Samples of a block, and of its neighbours on both sides that its filters see.
BLOCK, MARGIN = 1 << 16, 1 << 12


def as_blocks(signal: DataFrame, block: int = BLOCK, margin: int = MARGIN) -> DataFrame:
    """Long rows (rec, ch, t, v) to arrays (rec, ch, blk, x) in order of t, each with ``margin`` samples of its neighbours.

    No array grows with a record. Null samples are left out; t counts from 0 without holes.
    """
    own = F.floor(F.col("t") / block)
    spread = F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("t") - margin) / block)), F.floor((F.col("t") + margin) / block)))
    there = signal.where(F.col("v").isNotNull())
    # One number a channel, joined; no window holds a channel's samples.
    last = there.groupBy("rec", "ch").agg(F.max(own).alias("_last"))
    rows = there.join(last, ["rec", "ch"]).select("rec", "ch", "t", "v", "_last", spread.alias("blk")).where(F.col("blk") <= F.col("_last"))
    return rows.groupBy("rec", "ch", "blk").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda s: s["v"]).alias("x"))


def over_arrays(df: DataFrame, column: str, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Replaces an array column by ``f`` of it; arrays of one length in a batch are given together as a matrix.

    Null and empty arrays stay as they are.
    """
    names, at = df.columns, df.columns.index(column)
    schema = T.StructType([T.StructField(c.name, T.ArrayType(T.DoubleType()) if k == at else c.dataType) for k, c in enumerate(df.schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list = batch.column(at).to_pylist()
            lengths: dict[int, list[int]] = {}
            for i, x in enumerate(found):
                if x:
                    lengths.setdefault(len(x), []).append(i)
            for own in lengths.values():
                for i, y in zip(own, f(np.array([found[i] for i in own], float)), strict=True):
                    found[i] = y
            columns = [*batch.columns]
            columns[at] = pa.array([None if x is None else list(x) for x in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, schema)


def clean(blocks: DataFrame, fs: float, low: float = 0.5, high: float = 45.0, hum: float = 50.0, down: int = 2, block: int = BLOCK, margin: int = MARGIN) -> DataFrame:
    """(rec, ch, blk, x): blocks after notch, band-pass and decimation, in this order, without their margins.

    A filter forgets what lies further off than the margin, so the blocks join up to what the whole record would give.
    ``block`` and ``margin`` are multiples of ``down``.
    """

    def f(x: np.ndarray) -> np.ndarray:
        y = filters.both_ways(x, filters.notch(hum, 30.0, fs))
        return filters.decimate(filters.both_ways(y, filters.bandpass(low, high, fs)), down)

    begin = F.when(F.col("blk") == 0, 1).otherwise(1 + margin // down)
    return over_arrays(blocks, "x", f).withColumn("x", F.slice("x", begin, block // down)).where(F.size("x") > 0)


def resample(signal: DataFrame, up: int, down: int, block: int = BLOCK) -> DataFrame:
    """(rec, ch, blk, first, x): long rows (rec, ch, t, v) at up / down times their rate, in blocks; ``first`` is the place of x's first sample.

    The low-pass sees 10 * max(up, down) / up samples on each side, and so do the blocks' margins: they join up exactly.
    """
    g = math.gcd(up, down)
    up, down = up // g, down // g
    reach = -(-10 * max(up, down) // up) + 1
    margin, size = -(-reach // down) * down, max(1, block // down) * down
    found = over_arrays(as_blocks(signal, size, margin), "x", lambda x: filters.resample(x, up, down))
    begin = F.when(F.col("blk") == 0, 0).otherwise(margin // down * up)
    core = F.slice("x", (begin + 1).cast("int"), size // down * up)
    # A last block ends where its samples do; margins of a neighbour beyond it hold no samples of their own.
    return found.select("rec", "ch", "blk", (F.col("blk") * (size // down * up)).alias("first"), core.alias("x")).where(F.size("x") > 0)


def segments(signal: DataFrame, most: int = 256) -> DataFrame:
    """(rec, ch, seg, x): half-overlapping segments of ``most`` samples of long rows (rec, ch, t, v, n); one of all samples of a shorter record."""
    size = F.least(F.lit(most), F.col("n")).cast("long")
    hop = F.greatest(size - F.floor(size / 2), F.lit(1).cast("long"))
    count = F.floor((F.col("n") - size) / hop) + 1
    low, high = F.greatest(F.lit(0), F.ceil((F.col("t") - size + 1) / hop)), F.least(F.floor(F.col("t") / hop), count - 1)
    rows = signal.where(low <= high).select("rec", "ch", "t", "v", F.explode(F.sequence(low, high)).alias("seg"))
    return rows.groupBy("rec", "ch", "seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda s: s["v"]).alias("x"))


def welch(signal: DataFrame, fs: float, most: int = 256) -> DataFrame:
    """(rec, ch, k, f, density): mean density of all segments at each frequency; segments are transformed in batches."""
    found = over_arrays(segments(signal, most), "x", lambda x: filters.welch(x, fs, most)[1])
    size = F.least(F.lit(most), F.col("n"))
    n = signal.groupBy("rec", "ch").agg(F.max(size).alias("size"))
    rows = found.select("rec", "ch", F.posexplode("x").alias("k", "p")).groupBy("rec", "ch", "k").agg(F.avg("p").alias("density"))
    return rows.join(n, ["rec", "ch"]).select("rec", "ch", "k", (F.col("k") * fs / F.col("size")).alias("f"), "density")
