"""Two decodes of the same recordings held against each other, packet by packet, and figures that a wrong decode can't hide.

``packet_table`` gives a row for each packet with its channels, the place where it ends and its values, by the library's decoder or by a
plain one that reads a byte at a time; each range of an index is a unit of work. ``compare`` joins two such tables by packet and tells,
for each file, how many packets differ in which way and where the first does. ``figures`` gives each channel's deviation, range
and mean, those of both halves, and the shares of energy in bands: steps with a wrong sign turn a signal into a random walk, whose
halves and bands give it away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.operators.spectral import BANDS
from signalloom.sources.ranges import _form, opened
from signalloom.sources.recordings import ESCAPE, STEP_GROUPS, Layout, packets

PACKETS = "path string, packet long, channels array<int>, end long, values array<long>"


def fast(raw: bytes, form: Layout) -> Iterator[tuple[list[int], list[int], list[bool], int]]:
    for own, values, whole, end in packets(raw, form, None, 0):
        yield own.tolist(), values.tolist(), whole.tolist(), end


def plain(raw: bytes, form: Layout) -> Iterator[tuple[list[int], list[int], list[bool], int]]:
    """The same by reading one number after another: mask bits, then a step for each channel, then absolute values."""
    at = 0
    signed = lambda a, n: int.from_bytes(raw[a : a + n], "little", signed=True)
    while at < len(raw):
        at += 1
        factor = -1
        if form.grouped:
            bit = 0
            while bit < 8 and at < len(raw) and not raw[at] >> bit & 1:
                bit += 1
            if bit not in STEP_GROUPS:
                return
            factor = STEP_GROUPS[bit]
            at += 1
        own = [c for c in range(form.n) if form.shorted[c] == 0 and factor in (-1, int(form.group[c]))]
        mask, at = at, at + (form.n + 7) // 8
        values, whole = [], []
        for c in own:
            if mask + c // 8 < len(raw) and raw[mask + c // 8] >> c % 8 & 1:
                absolute = raw[at : at + 2] == ESCAPE.to_bytes(2, "little")
                values.append(signed(at, 2))
                whole.append(absolute)
                at += 2
            else:
                values.append(signed(at, 1))
                whole.append(False)
                at += 1
        for i, absolute in enumerate(whole):
            if absolute:
                values[i] = signed(at, 4)
                at += 4
        if at > len(raw):
            return
        yield own, values, whole, at


DECODERS = {"fast": fast, "plain": plain}


def packet_table(index: DataFrame, decoder: str = "fast") -> DataFrame:
    """(path, packet, channels, end, values) of every packet of an index's ranges; ``end`` counts from the file's begin."""
    decode = DECODERS[decoder]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.int64())]
        for batch in batches:
            for r in batch.to_pylist():
                form, state, rows = _form(r), list(r["state"]), []
                with opened(r["path"]) as source:
                    source.seek(r["offset"])
                    raw = source.read(r["bytes"])
                for k, (own, values, whole, end) in enumerate(decode(raw, form)):
                    for c, v, absolute in zip(own, values, whole, strict=True):
                        state[c] = v if absolute else state[c] + v
                    rows.append((r["path"], r["first"] + k, own, r["offset"] + end, list(state)))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "packet", "channels", "end", "values"])

    return index.where("error is null and n > 0").mapInArrow(run, PACKETS)


def compare(one: DataFrame, two: DataFrame) -> DataFrame:
    """(path, n_packets, n_missing, n_channels, n_ends, n_values, first_packet, first_kind): packets of two decodes by what differs.

    A packet counts under the first of: missing in one, other channels, another end, other values.
    """
    b = two.select("path", "packet", F.array_sort("channels").alias("_c"), F.col("end").alias("_e"), F.col("values").alias("_v"))
    both = one.withColumn("channels", F.array_sort("channels")).join(b, ["path", "packet"], "full")
    kind = (
        F.when(F.col("end").isNull() | F.col("_e").isNull(), "missing").when(F.col("channels") != F.col("_c"), "channels")
        .when(F.col("end") != F.col("_e"), "end").when(F.col("values") != F.col("_v"), "values")
    )
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    first = F.min(F.when(F.col("kind").isNotNull(), F.struct("packet", "kind")))
    return both.withColumn("kind", kind).groupBy("path").agg(
        F.count("*").alias("n_packets"), n("missing").alias("n_missing"), n("channels").alias("n_channels"), n("end").alias("n_ends"), n("values").alias("n_values"),
        first["packet"].alias("first_packet"), first["kind"].alias("first_kind"),
    )


def _stats(x: Column, name: str) -> list[Column]:
    n = F.size(x)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    square = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    mean = F.try_divide(total, n)
    return [mean.alias(f"mean{name}"), F.sqrt(F.greatest(F.try_divide(square, n) - mean * mean, F.lit(0.0))).alias(f"std{name}")]


def figures(parts: DataFrame) -> DataFrame:
    """(record_id, ch, n, std, ptp, mean, and those of both halves, shares of energy by band) of a window's parts (record_id, ch, sfreq, first, x)."""
    joined = parts.where("error is null").groupBy("record_id", "ch", "sfreq").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "x"))), lambda s: s["x"])).cast("array<double>").alias("x"))
    half = F.floor(F.size("x") / 2).cast("int")
    names = list(BANDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = []
            for fs, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x = np.array(x, float)
                power = np.abs(np.fft.rfft(x - x.mean())) ** 2 if len(x) else np.zeros(0)
                f = np.fft.rfftfreq(len(x), 1 / fs) if len(x) else np.zeros(0)
                low, high = min(a for a, _ in BANDS.values()), max(b for _, b in BANDS.values())
                total = power[(f >= low) & (f <= high)].sum() or 1.0
                shares.append([float(power[(f >= a) & (f < b)].sum() / total) for a, b in BANDS.values()])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([s[i] for s in shares], pa.float64()) for i in range(len(names)))], names=[*batch.schema.names, *names])

    kinds = f"record_id string, ch int, sfreq double, x array<double>, {', '.join(f'`{n}` double' for n in names)}"
    found = joined.mapInArrow(run, kinds)
    return found.select(
        "record_id", "ch", F.size("x").alias("n"), *_stats(F.col("x"), ""), (F.array_max("x") - F.array_min("x")).alias("ptp"),
        *_stats(F.slice("x", F.lit(1), half), "_first"), *_stats(F.slice("x", half + 1, half), "_second"), *names,
    )
