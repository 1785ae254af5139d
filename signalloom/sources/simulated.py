"""Synthetic epochs as a source: each row's samples depend on (seed, subject, epoch) only, never on partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS = ((0.5, 4.0, 1.0), (4.0, 8.0, 0.6), (8.0, 13.0, 0.8), (13.0, 30.0, 0.4))
SCHEMA = "subject long, ep int, label int, x array<array<float>>"


def band_noise(rng: np.random.Generator, shape: tuple[int, int], fs: float, low: float, high: float) -> np.ndarray:
    """Noise of unit deviation within a band."""
    spectrum = np.fft.rfft(rng.standard_normal(shape), axis=1)
    f = np.fft.rfftfreq(shape[1], 1 / fs)
    spectrum[:, (f < low) | (f > high)] = 0
    x = np.fft.irfft(spectrum, shape[1], axis=1)
    return x / np.maximum(x.std(1, keepdims=True), 1e-12)


def epoch(seed: int, subject: int, ep: int, label: int, channels: int, samples: int, fs: float) -> np.ndarray:
    """Bands with a front-to-back gradient, noise at the subject's own level, and spikes where the label is abnormal."""
    own = np.random.default_rng((seed, subject))
    gain, snr = own.uniform(0.8, 1.25), own.uniform(6, 18)
    rng = np.random.default_rng((seed, subject, ep + 1))
    x = sum(a * band_noise(rng, (channels, samples), fs, lo, hi) for lo, hi, a in BANDS) * np.linspace(1.3, 0.7, channels)[:, None]
    if label:
        t = np.arange(samples) / fs
        for at in rng.uniform(0, samples / fs, 2 * label):
            x += 4 * label * np.exp(-(((t - at) / 0.02) ** 2)) * rng.uniform(0.5, 1, (channels, 1))
    noise = rng.standard_normal(x.shape) * x.std() / 10 ** (snr / 20)
    return (20 * gain * (x + noise)).astype(np.float32)


def simulate(spark: SparkSession, subjects: int, epochs: int, channels: int = 19, samples: int = 500, fs: float = 250.0, seed: int = 42) -> DataFrame:
    """``epochs`` rows for each subject; labels 0, 1, 2 in turn by subject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                subject, ep = divmod(i, epochs)
                x = epoch(seed, subject, ep, subject % 3, channels, samples, fs)
                values = pa.array([x.tolist()], pa.list_(pa.list_(pa.float32())))
                yield pa.RecordBatch.from_arrays([pa.array([subject]), pa.array([ep], pa.int32()), pa.array([subject % 3], pa.int32()), values], names=["subject", "ep", "label", "x"])

    return spark.range(subjects * epochs).mapInArrow(run, SCHEMA)


def long_rows(epochs: DataFrame) -> DataFrame:
    """(subject, ep, label, ch, t, v) of epochs."""
    by_ch = epochs.select("subject", "ep", "label", F.posexplode("x").alias("ch", "row"))
    return by_ch.select("subject", "ep", "label", "ch", F.posexplode("row").alias("t", "v")).withColumn("v", F.col("v").cast("double"))
