"""Recordings in the European Data Format: fixed-width headers, then records of 16-bit samples, channel after channel.

Files are listed by the binaryFile reader and decoded one in a task, in the same rows as the other recordings. A file
that cannot be read gives one row with an ``error`` and no samples; an incomplete last record is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from signalloom.sources.recordings import SCHEMA

# Fixed values of the format: bytes of the common header, and of each field of all channels.
HEAD = 256
FIELDS = {"label": 16, "transducer": 80, "unit": 8, "low": 8, "high": 8, "digital_low": 8, "digital_high": 8, "filter": 80, "samples": 8, "reserved": 32}


@dataclass(frozen=True)
class Header:
    labels: list[str]
    #: Samples of each channel in a record, seconds of a record, and value = gain * sample + offset.
    samples: np.ndarray
    seconds: float
    gain: np.ndarray
    offset: np.ndarray
    size: int


def header(raw: bytes) -> Header:
    try:
        n, seconds = int(raw[252:256]), float(raw[244:252])
        fields, at = {}, HEAD
        for name, width in FIELDS.items():
            fields[name] = [raw[at + k * width : at + (k + 1) * width].decode("latin-1").strip() for k in range(n)]
            at += n * width
        number = lambda name: np.array([float(x) for x in fields[name]])
        low, high, first, last = (number(f) for f in ("low", "high", "digital_low", "digital_high"))
        gain = (high - low) / np.where(last == first, 1.0, last - first)
        return Header(fields["label"], np.array([int(x) for x in fields["samples"]]), seconds, gain, low - gain * first, at)
    except ValueError as e:
        raise ValueError(f"no header of this format: {e}") from e


def decode(raw: bytes) -> tuple[Header, list[np.ndarray]]:
    """The header and the samples of each channel."""
    form = header(raw)
    width = int(form.samples.sum())
    if width == 0:
        return form, [np.zeros(0, np.float32) for _ in form.labels]
    body = np.frombuffer(raw, "<i2", (len(raw) - form.size) // (2 * width) * width, form.size).reshape(-1, width)
    ends = np.cumsum(form.samples)
    return form, [(body[:, b - n : b].ravel() * g + o).astype(np.float32) for n, b, g, o in zip(form.samples, ends, form.gain, form.offset, strict=True)]


def scan(spark: SparkSession, folder: str, channels: list[int] | None = None) -> DataFrame:
    """A row for each file and channel, with all of its samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                record = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    form, x = decode(raw)
                    rate = form.samples / form.seconds if form.seconds > 0 else np.zeros(len(x))
                    rows = [(path, record, 0, float(rate[c]), c, x[c], None) for c in (range(len(x)) if channels is None else channels) if c < len(x)]
                except ValueError as e:
                    rows = [(path, record, 0, None, None, None, str(e))]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 7
                kinds = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.float32()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "record_id", "segment", "sfreq", "ch", "x", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{edf,EDF}").load(folder)
    return files.select("path", "content").mapInArrow(run, SCHEMA)
