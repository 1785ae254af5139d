"""One way in for all kinds of recordings, and what is asked of them alike: channels, spans, lengths, checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.sources import edf, recordings

#: By ending; another kind of recording is added by adding its scan here.
SCANS: dict[str, Callable[[SparkSession, str, list[int] | None], DataFrame]] = {"erd": recordings.scan, "edf": edf.scan}


def channel_list(text: str | None, most: int = 19) -> list[int]:
    """Channels of a text such as "0-18,20"; the first ``most`` where there is none."""
    if not text or not text.strip():
        return list(range(most))
    out: list[int] = []
    for part in text.split(","):
        a, _, b = part.strip().partition("-")
        out += range(int(a), int(b or a) + 1)
    return list(dict.fromkeys(out))


def scan(spark: SparkSession, folder: str, kind: str | None = None, channels: str | None = None) -> DataFrame:
    """Segments of all recordings of a folder, of one kind or of a path's own ending; an unknown kind is refused."""
    kind = (kind or folder.rstrip("/").rsplit(".", 1)[-1]).lower()
    if kind not in SCANS:
        raise ValueError(f"no reader for {kind!r}, only for {', '.join(sorted(SCANS))}")
    return SCANS[kind](spark, folder, None if channels is None else channel_list(channels))


def lengths(segments: DataFrame) -> DataFrame:
    """(record_id, sfreq, n_channels, n_samples, seconds) of every record that could be read."""
    by_ch = segments.where("error is null").groupBy("record_id", "ch").agg(F.max("sfreq").alias("sfreq"), F.sum(F.size("x")).alias("n"))
    found = by_ch.groupBy("record_id").agg(F.max("sfreq").alias("sfreq"), F.count("*").alias("n_channels"), F.max("n").alias("n_samples"))
    return found.withColumn("seconds", F.try_divide("n_samples", "sfreq"))


def self_check(signal: DataFrame) -> DataFrame:
    """(rec, ch, mean, std, min, max, drift) of long rows (rec, ch, t, v, n); drift is the second half's mean less the first's, over the deviation."""
    half = lambda late: F.avg(F.when((F.col("t") * 2 >= F.col("n")) == late, F.col("v")))
    std = F.stddev_pop("v")
    return signal.groupBy("rec", "ch").agg(
        F.avg("v").alias("mean"), std.alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.coalesce(F.try_divide(half(True) - half(False), std), F.lit(0.0)).alias("drift")
    )
