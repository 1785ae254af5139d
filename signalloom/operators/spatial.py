"""Coherence between channels of short epochs, on long rows (id, ch, t, x)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.functions import filters
from signalloom.operators.filtering import over_arrays


def spectra(rows: DataFrame, size: int) -> DataFrame:
    """(id, ch, k, re, im) of each channel under a symmetric Hann window; size / 2 + 1 bins."""
    bins = rows.sparkSession.range(size // 2 + 1).select(F.col("id").cast("int").alias("k"))
    x = F.col("x") * (0.5 - 0.5 * F.cos(F.col("t") * (2 * math.pi / (size - 1))))
    angle = F.col("t") * F.col("k") * (2 * math.pi / size)
    return rows.crossJoin(F.broadcast(bins)).groupBy("id", "ch", "k").agg(F.sum(x * F.cos(angle)).alias("re"), F.sum(-x * F.sin(angle)).alias("im"))


def coherence(spectrum: DataFrame, low: int, high: int) -> DataFrame:
    """(id, ch_a, ch_b, coh) over the bins from low to high: one row a pair with ch_a < ch_b; 0 where a channel is silent."""
    own = spectrum.where(F.col("k").between(low, high))
    a, b = own.alias("a"), own.alias("b")
    pairs = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.ch") < F.col("b.ch")))
    re = F.sum(F.col("a.re") * F.col("b.re") + F.col("a.im") * F.col("b.im"))
    im = F.sum(F.col("a.im") * F.col("b.re") - F.col("a.re") * F.col("b.im"))
    power = lambda s: F.sum(F.col(f"{s}.re") * F.col(f"{s}.re") + F.col(f"{s}.im") * F.col(f"{s}.im"))
    coh = F.coalesce(F.try_divide(F.sqrt(re * re + im * im), F.sqrt(power("a") * power("b"))), F.lit(0.0))
    return pairs.groupBy(F.col("a.id").alias("id"), F.col("a.ch").alias("ch_a"), F.col("b.ch").alias("ch_b")).agg(F.least(coh, F.lit(1.0)).alias("coh"))


def matrix_stats(coh: DataFrame) -> DataFrame:
    """Mean, deviation, 90th percentile and share over one half, of the pairs off the diagonal."""
    return coh.groupBy("id").agg(F.avg("coh").alias("mean"), F.stddev_pop("coh").alias("std"), F.percentile("coh", F.lit(0.9)).alias("p90"), F.avg(F.when(F.round("coh", 6) > 0.5, 1.0).otherwise(0.0)).alias("density"))


def node_strength(coh: DataFrame) -> DataFrame:
    """Each channel's mean coherence with the others; both ends of a pair come from one row."""
    ends = F.inline(F.array(F.struct(F.col("ch_a").alias("ch"), "coh"), F.struct(F.col("ch_b").alias("ch"), "coh")))
    return coh.select("id", ends).groupBy("id", "ch").agg(F.avg("coh").alias("strength"))


def band_stats(spectrum: DataFrame, hz: float, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """(id, band, mean, std, p90, density) of the coherence in each band and, as ``broadband``, from 0.5 to 45 Hz; all bins where a band has none."""
    out = None
    last = 1 << 20
    for name, (low, high) in [*bands.items(), ("broadband", (0.5, 45.0))]:
        a, b = math.ceil(low / hz - 1e-9), math.floor(high / hz + 1e-9)
        found = matrix_stats(coherence(spectrum, *((a, b) if a <= b else (0, last)))).withColumn("band", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def morphology(rows: DataFrame) -> DataFrame:
    """By channel of wide-band samples x: unbiased excess kurtosis (null counts 0), peak over RMS, asymmetry of the energy below and above zero."""
    n, g2, x = F.count("x"), F.kurtosis("x"), F.col("x")
    unbiased = F.coalesce(F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6), F.lit(0.0))
    low, high = F.avg(F.pow(F.least(x, F.lit(0.0)), 2)), F.avg(F.pow(F.greatest(x, F.lit(0.0)), 2))
    return rows.groupBy("id", "ch").agg(
        unbiased.alias("kurt"), (F.max(F.abs(x)) / F.greatest(F.sqrt(F.avg(x * x)), F.lit(1e-10))).alias("peak_rms"), ((low - high) / F.greatest(low + high, F.lit(1e-10))).alias("negative")
    )


def event_globals(shapes: DataFrame, correlation: DataFrame) -> DataFrame:
    """By id: sum, greatest and deviation of the kurtoses, greatest peak, left against right (even and odd ones of the first 16 channels), greatest correlation.

    ``correlation`` (id, ch_a, ch_b, r) counts over the first 16 channels, and only with eight channels or more.
    """
    side = lambda k: F.avg(F.when((F.col("ch") < 16) & (F.col("ch") % 2 == k), F.col("kurt")))
    left, right = side(0), side(1)
    lateral = F.coalesce((left - right) / (left + right + 1e-8), F.lit(0.0))
    own = shapes.groupBy("id").agg(
        F.sum("kurt").alias("kurt_sum"), F.max("kurt").alias("kurt_max"), F.stddev_pop("kurt").alias("kurt_std"), F.max("peak_rms").alias("peak_max"), lateral.alias("lateral"), F.count("*").alias("_n")
    )
    most = correlation.where("ch_a < 16 and ch_b < 16").groupBy("id").agg(F.max(F.abs("r")).alias("_r"))
    return own.join(most, "id", "left").withColumn("corr_max", F.when(F.col("_n") >= 8, F.coalesce("_r", F.lit(0.0))).otherwise(0.0)).drop("_n", "_r")


def correlations(rows: DataFrame) -> DataFrame:
    """(id, ch_a, ch_b, r) of pairs of channels with ch_a < ch_b; 0 where one is constant."""
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.ch") < F.col("b.ch")))
    r = F.when((F.stddev_pop("a.x") > 0) & (F.stddev_pop("b.x") > 0), F.corr("a.x", "b.x")).otherwise(0.0)
    return pairs.groupBy(F.col("a.id").alias("id"), F.col("a.ch").alias("ch_a"), F.col("b.ch").alias("ch_b")).agg(r.alias("r"))


def event_features(arrays: DataFrame, fs: float) -> tuple[DataFrame, DataFrame]:
    """Of arrays (id, ch, x): by channel the morphology of 1 to 30 Hz and the power ratio of 13-30 to 1-12 Hz, and by id the globals."""
    band = lambda lo, hi: over_arrays(arrays, "x", lambda x: filters.both_ways(x, filters.bandpass(lo, hi, fs)))
    power = lambda df, name: df.select("id", "ch", F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v).alias(name))
    long = lambda df: df.select("id", "ch", F.posexplode("x").alias("t", "x"))
    ratio = power(band(13.0, 30.0), "_h").join(power(band(1.0, 12.0), "_l"), ["id", "ch"]).join(arrays.select("id", "ch", F.size("x").alias("_n")), ["id", "ch"])
    shapes = morphology(long(band(1.0, 30.0))).join(ratio.select("id", "ch", (F.col("_h") / F.greatest(F.col("_l"), F.col("_n") * 1e-10)).alias("high_low")), ["id", "ch"])
    return shapes, event_globals(shapes, correlations(long(arrays)))
