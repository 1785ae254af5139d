"""Operator 6: texts stored as WAV media, short-time Fourier transforms and spectral-peak pair fingerprints.

A text's UTF-8 bytes, padded with blanks to a positive multiple of ``FRAME``, become the 8-bit samples of a mono
WAV file written and read by the wave module. Frames of ``FRAME`` samples, half overlapping and Hann-weighted,
are transformed by a table of whole numbers, so that all sums are exact and equal texts give equal values in any
batch. In each zone of ``ZONE`` frames the strongest bin of each band is a peak; each peak is paired with the
next ``FAN`` ones. A pair is one number: its time, the two bins and the time between them.

Edge cases: null and empty texts store one frame of blanks; a constant sound has no peaks and the empty feature.
Repeated rows give repeated rows; other columns are ignored. Memory follows slices of SLICE bytes or one text.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAME, HOP = 192, 96
RATE = 8000
ZONE, FAN, REACH = 8, 3, 63
#: Bins of each band, ends excluded.
BANDS = ((1, 4), (4, 10), (10, 22), (22, 48))
SLICE = 1 << 18

_bins = np.arange(1, 48)
_hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)
_phase = 2 * np.pi * np.outer(np.arange(FRAME), _bins) / FRAME
#: Hann-weighted cosine and sine tables in units of 2**-20: products with samples sum exactly in a double.
TABLE = np.rint(np.concatenate([np.cos(_phase), np.sin(_phase)], 1) * _hann[:, None] * (1 << 20))


def payload(text: bytes) -> bytes:
    return text + b" " * (-len(text) % FRAME or (FRAME if not text else 0))


def stored(samples: bytes) -> bytes:
    """A WAV file of 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def samples(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def power(sound: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Spectral power of the frames that begin at ``start``."""
    frames = np.lib.stride_tricks.sliding_window_view(sound, FRAME)[start].astype(np.float64)
    frames -= frames[:, :1]  # a constant has no power, whatever the table's rounding leaks
    both = frames @ TABLE
    half = len(_bins)
    return both[:, :half] ** 2 + both[:, half:] ** 2


def pairs(sounds: list[bytes]) -> list[list[int]]:
    """Fingerprint of each sound: time << 18 | bin << 12 | other bin << 6 | time between, in time order."""
    size = np.array([len(s) for s in sounds])
    begin = np.r_[0, np.cumsum(size)[:-1]]
    count = size // HOP - 1
    doc = np.repeat(np.arange(len(sounds)), count)
    time = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    energy = power(np.frombuffer(b"".join(sounds), np.uint8), begin[doc] + HOP * time)
    new = np.r_[True, (doc[1:] != doc[:-1]) | (time[1:] // ZONE != time[:-1] // ZONE)]
    zone, first = np.cumsum(new) - 1, np.flatnonzero(new)
    found = []
    for lo, hi in BANDS:
        part = energy[:, lo - 1 : hi - 1]
        top = part.max(1)
        hit = np.flatnonzero((top == np.maximum.reduceat(top, first)[zone]) & (top > 0))
        hit = hit[np.unique(zone[hit], return_index=True)[1]]
        found.append(np.stack([doc[hit], time[hit], lo + part[hit].argmax(1)]))
    peak = np.concatenate(found, 1)
    d, t, f = peak[:, np.lexsort((peak[2], peak[1], peak[0]))]
    out_d, out_i, out_v = [], [], []
    for k in range(1, FAN + 1):
        gap = t[k:] - t[:-k]
        ok = np.flatnonzero((d[k:] == d[:-k]) & (gap <= REACH))
        out_d.append(d[ok])
        out_i.append(ok * FAN + k)
        out_v.append((t[ok] << 18) | (f[ok] << 12) | (f[ok + k] << 6) | gap[ok])
    d, i, v = (np.concatenate(x) for x in (out_d, out_i, out_v))
    order = np.argsort(i, kind="stable")
    d, v = d[order], v[order]
    cut = np.searchsorted(d, np.arange(len(sounds) + 1))
    return [v[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "pairs"]
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def done(ids: pa.Array, facts: list[tuple], sounds: list[bytes]) -> pa.RecordBatch:
        columns = [pa.array(x) for x in zip(*facts, strict=True)]
        return pa.RecordBatch.from_arrays([ids, *columns, pa.array(pairs(sounds), pa.list_(pa.int64()))], names=names)

    for batch in batches:
        facts, sounds, a, held = [], [], 0, 0
        for i, text in enumerate(batch.column(1)):
            raw = (text.as_py() or "").encode()
            media = stored(payload(raw))
            back = samples(media)
            facts.append((len(raw), len(back), sha(back), zlib.crc32(back[-16:]), len(media), sha(media)))
            sounds.append(back)
            held += len(back)
            if held >= SLICE or i == batch.num_rows - 1:
                yield done(batch.column(0).slice(a, len(facts)), facts, sounds)
                facts, sounds, a, held = [], [], i + 1, 0


def features(docs: DataFrame) -> DataFrame:
    """Facts of every text's payload and stored form, with ``pairs`` as a time-coded array."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_facts, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pairs array<long>")


def media(docs: DataFrame) -> DataFrame:
    """doc_id and the stored WAV bytes of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([stored(payload((text.as_py() or "").encode()))], pa.binary())], names=["doc_id", "wav"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, wav binary")


def as_text(pairs_column: str = "pairs") -> Column:
    """The array as one string of numbers."""
    return F.array_join(F.transform(pairs_column, lambda p: p.cast("string")), ",")
