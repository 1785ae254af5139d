"""Sliding epochs over signals and features of each epoch, as partial aggregates over long rows (rec, ch, ep, t, v)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalloom.functions import quality


def epoch_rows(signal: DataFrame, size: int = 64, hop: int = 32) -> DataFrame:
    """A row for each sample and epoch that holds it; incomplete tails are left out. Null samples stay null."""
    last = F.floor(F.col("t") / hop)
    ep = F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("t") - size + 1) / hop)), last))
    return signal.where(F.col("n") >= size).withColumn("ep", ep).where(F.col("ep") * hop + size <= F.col("n"))


def time_features(rows: DataFrame) -> DataFrame:
    """Amplitude statistics of each epoch and channel; moments are of the population and excess, null where constant."""
    v = F.col("v")
    return rows.groupBy("rec", "ch", "ep").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt"),
        F.sqrt(F.avg(v * v)).alias("rms"), (F.max(v) - F.min(v)).alias("ptp"), F.max(F.abs(v)).alias("max_abs"), F.var_pop(v).alias("var"),
    )


def differences(rows: DataFrame) -> DataFrame:
    """First and second differences within each epoch; null where there is no earlier sample."""
    w = W.partitionBy("rec", "ch", "ep").orderBy("t")
    return rows.withColumn("d1", F.col("v") - F.lag("v").over(w)).withColumn("d2", F.col("d1") - F.lag("d1").over(w))


def hjorth(rows: DataFrame, guard: float = 1e-12) -> DataFrame:
    """Activity, mobility and complexity."""
    a = differences(rows).groupBy("rec", "ch", "ep").agg(*(F.var_pop(c).alias(n) for c, n in (("v", "a"), ("d1", "b"), ("d2", "c"))))
    mobility = F.sqrt(F.col("b") / (F.col("a") + guard))
    return a.select("rec", "ch", "ep", F.col("a").alias("activity"), mobility.alias("mobility"), (F.sqrt(F.col("c") / (F.col("b") + guard)) / (mobility + guard)).alias("complexity"))


def zero_crossing(rows: DataFrame) -> DataFrame:
    """Half the sum of sign changes over the number of samples; the sign of 0 is 0."""
    s = F.signum("v")
    signed = rows.withColumn("step", F.abs(s - F.lag(s).over(W.partitionBy("rec", "ch", "ep").orderBy("t"))))
    return signed.groupBy("rec", "ch", "ep").agg((F.coalesce(F.sum("step"), F.lit(0.0)) / (2 * F.count("*"))).alias("zcr"))


def block_energy(rows: DataFrame, blocks: tuple[int, ...], size: int = 64, hop: int = 32) -> DataFrame:
    """Mean and deviation of the energies of whole non-overlapping blocks, one row for each block width."""
    at = F.col("t") - F.col("ep") * hop
    wide = rows.withColumn("w", F.explode(F.array(*map(F.lit, blocks)))).withColumn("blk", F.floor(at / F.col("w"))).where((F.col("blk") + 1) * F.col("w") <= size)
    energy = wide.groupBy("rec", "ch", "ep", "w", "blk").agg(F.avg(F.col("v") * F.col("v")).alias("e"))
    return energy.groupBy("rec", "ch", "ep", "w").agg(F.avg("e").alias("mean"), F.stddev_pop("e").alias("std"))


def reject(rows: DataFrame, low: float, high: float, least_std: float) -> DataFrame:
    """Whether each epoch stays: its widest channel under clip(3 * median, low, high), no channel flat."""
    per_ch = rows.groupBy("rec", "ep", "ch").agg((F.max("v") - F.min("v")).alias("ptp"), F.stddev_pop("v").alias("std"))
    per_ep = per_ch.groupBy("rec", "ep").agg(F.max("ptp").alias("ptp"), F.min("std").alias("std"))
    limits = per_ep.groupBy("rec").agg(F.least(F.greatest(3 * F.median("ptp"), F.lit(low)), F.lit(high)).alias("threshold"))
    return per_ep.join(limits, "rec").select("rec", "ep", "ptp", "threshold", ((F.col("ptp") <= F.col("threshold")) & (F.col("std") >= least_std)).alias("kept"))


def uniform_sample(units: DataFrame, most: int) -> DataFrame:
    """At most ``most`` epochs of each record, evenly spaced: rows (rec, ep) with their place k."""
    w = W.partitionBy("rec")
    placed = units.withColumn("i", F.row_number().over(w.orderBy("ep")) - 1).withColumn("m", F.count("*").over(w))
    # The place k whose evenly spaced index is i, where there is one.
    k = F.ceil(F.col("i") * (most - 1) / F.greatest(F.col("m") - 1, F.lit(1)))
    return placed.withColumn("k", F.when(F.col("m") <= most, F.col("i")).otherwise(k).cast("long")).where((F.col("m") <= most) | (F.floor(F.col("k") * (F.col("m") - 1) / (most - 1)) == F.col("i"))).select("rec", "ep", "k")


def average_reference(signal: DataFrame) -> DataFrame:
    """Each sample less the mean of all channels at its time."""
    return signal.withColumn("v", F.col("v") - F.avg("v").over(W.partitionBy("rec", "t")))


def zscore(signal: DataFrame, least: float = 1e-8) -> DataFrame:
    """Each sample by its channel's mean and deviation over all records; the two numbers of each channel are joined."""
    stats = signal.groupBy("ch").agg(F.avg("v").alias("m"), F.greatest(F.stddev_pop("v"), F.lit(least)).alias("s"))
    return signal.join(stats, "ch").withColumn("z", (F.col("v") - F.col("m")) / F.col("s")).drop("m", "s")


def snr(signal: DataFrame, width: int = 5) -> DataFrame:
    """Signal-to-noise of each record in dB, from a centred moving average; flat channels count -10, results lie in [-10, 40]."""
    w = W.partitionBy("rec", "ch").orderBy("t").rowsBetween(-(width // 2), (width - 1) // 2)
    smooth = signal.withColumn("s", F.sum("v").over(w) / width)
    per_ch = smooth.groupBy("rec", "ch").agg(F.var_pop("s").alias("sig"), F.var_pop(F.col("v") - F.col("s")).alias("res"), F.stddev_pop("v").alias("std"))
    noise = F.col("res") / (1 - 1 / width)
    db = F.when((F.col("std") < 1e-9) | (noise <= 0), -10.0).otherwise(10 * F.log10(F.col("sig") / noise))
    return per_ch.groupBy("rec").agg(F.least(F.greatest(F.avg(db), F.lit(-10.0)), F.lit(40.0)).alias("snr_db"))


def artifact_ratio(signal: DataFrame, high: float, least_std: float = 0.5) -> DataFrame:
    """Per record, means over channels: 0.6 share of samples beyond ``high``, 0.2 share of steps over eight medians, 0.2 flat channels.

    A channel is flat when its deviation is under ``least_std``. Records of under four samples a channel count as 1.
    """
    d = F.abs(F.col("v") - F.lag("v").over(W.partitionBy("rec", "ch").orderBy("t")))
    steps = signal.withColumn("d", d)
    usual = steps.groupBy("rec", "ch").agg(F.median("d").alias("med"))
    share = lambda c: F.avg(c.cast("double"))
    by_ch = steps.join(usual, ["rec", "ch"]).groupBy("rec", "ch").agg(
        share(F.abs("v") > high).alias("amp"), share(F.col("d") > 8 * (F.col("med") + 1e-9)).alias("jump"), (F.stddev_pop("v") < least_std).cast("double").alias("flat"), F.count("*").alias("n")
    )
    ratio = 0.6 * F.avg("amp") + 0.2 * F.avg("jump") + 0.2 * F.avg("flat")
    return by_ch.groupBy("rec").agg(F.when(F.max("n") < 4, 1.0).otherwise(F.least(ratio, F.lit(1.0))).alias("artifact_ratio"))


def amplitude_quality(signal: DataFrame) -> DataFrame:
    """Per record, mean over channels of half an amplitude score and half a variance score, from 0 to 1."""
    by_ch = signal.groupBy("rec", "ch").agg(F.max(F.abs("v")).alias("a"), F.var_pop("v").alias("s"))
    amp = F.when(F.col("a") < 100, 1.0).when(F.col("a") < 500, F.greatest(F.lit(0.0), 1 - (F.col("a") - 100) / 400)).otherwise(0.0)
    var = F.when(F.col("s") > 1, 1.0).when(F.col("s") > 0.1, F.col("s")).otherwise(0.1)
    return by_ch.groupBy("rec").agg(F.avg(0.5 * amp + 0.5 * var).alias("quality"))


def standardise_epoch(rows: DataFrame, keys: list[str], value: str = "v", more: float = 1e-8) -> DataFrame:
    """Adds z: each value less the mean of its epoch, over its deviation plus ``more``."""
    own = W.partitionBy(*keys)
    return rows.withColumn("z", (F.col(value) - F.avg(value).over(own)) / (F.stddev_pop(value).over(own) + more))


def epoch_quality(rows: DataFrame, fs: float, most: float = 100.0) -> DataFrame:
    """(rec, ep, snr_db, artifact_ratio) of epochs in long rows (rec, ep, ch, t, v); an epoch's channels go to a task together."""
    by_ch = rows.groupBy("rec", "ep", "ch").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda s: s["v"].cast("double")).alias("x"))
    arrays = by_ch.groupBy("rec", "ep").agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", "x"))), lambda s: s["x"]).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.array(r, float)[None] for r in batch.column(2).to_pylist()]
            found = [pa.array([float(f(r)[0]) for r in x], pa.float64()) for f in (lambda r: quality.snr_db(r, fs), lambda r: quality.artifact_ratio(r, most))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], names=["rec", "ep", "snr_db", "artifact_ratio"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("rec", "ep"))
    return arrays.mapInArrow(run, f"{kinds}, snr_db double, artifact_ratio double")


def quality_level(snr_db: Column, artifact: Column) -> Column:
    """high over 10 dB, low under 5 dB or beyond 0.3 artifacts, else medium (also where the SNR is null)."""
    return F.when(artifact > 0.30, "low").when(snr_db > 10, "high").when(snr_db < 5, "low").otherwise("medium")


def quality_score(snr_db: Column, artifact: Column) -> Column:
    return 0.7 * F.least(F.greatest(snr_db / 20, F.lit(0.0)), F.lit(1.0)) + 0.3 * (1 - artifact)


def manifest(signal: DataFrame, kept: DataFrame) -> DataFrame:
    """(rec, n_all, n_kept, status, error, keep_rate) of every record, from ``reject``: ok, or error with no_epoch or all_rejected."""
    n = kept.groupBy("rec").agg(F.count("*").alias("n_all"), F.sum(F.col("kept").cast("long")).alias("n_kept"))
    all_recs = signal.select("rec").distinct().join(n, "rec", "left")
    error = F.when(F.col("n_all").isNull(), "no_epoch").when(F.col("n_kept") == 0, "all_rejected").otherwise("")
    status = F.when(error == "", "ok").otherwise("error")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return all_recs.select("rec", none("n_all").alias("n_all"), none("n_kept").alias("n_kept"), status.alias("status"), error.alias("error"), F.coalesce(F.col("n_kept") / F.col("n_all"), F.lit(0.0)).alias("keep_rate"))


#: The features of a channel, in the order of its part of a vector (fixed values).
TIME_FEATURES = ("mean", "std", "skew", "kurt", "rms", "ptp", "zcr", "activity", "mobility", "complexity", "max_abs", "var")


def time_vector(rows: DataFrame) -> DataFrame:
    """(rec, ep, x): the time-domain features of all channels of an epoch in one array, channel after channel; nulls count 0."""
    keys = ["rec", "ch", "ep"]
    wide = time_features(rows).join(hjorth(rows), keys).join(zero_crossing(rows), keys)
    own = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in TIME_FEATURES))
    return wide.groupBy("rec", "ep").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ch", own.alias("v")))), lambda s: s["v"])).alias("x"))
