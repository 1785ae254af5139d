"""Discrete Fourier power of short epochs and band features, on long rows (id, ch, pos, x)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Frequency bands in Hz, both ends closed (fixed values).
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 45.0)}


def power(rows: DataFrame, size: int) -> DataFrame:
    """One-sided power at each frequency bin; the bins are a table of size / 2 + 1 rows, summed as they are joined."""
    spark = rows.sparkSession
    bins = spark.range(size // 2 + 1).select(F.col("id").cast("int").alias("k"))
    angle = F.col("pos") * F.col("k") * (2 * math.pi / size)
    both = rows.crossJoin(F.broadcast(bins)).groupBy("id", "k").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"))
    scale = F.when((F.col("k") == 0) | (F.col("k") == size // 2), 1.0).otherwise(2.0) / size
    return both.select("id", "k", ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) * scale).alias("pw"))


def band_powers(spectrum: DataFrame, hz: float) -> DataFrame:
    """Share of the total power in each band; ``hz`` is the width of a bin."""
    f = F.col("k") * hz
    total = F.sum("pw")
    return spectrum.groupBy("id").agg(*((F.sum(F.when((f >= a) & (f <= b), F.col("pw")).otherwise(0.0)) / total).alias(n) for n, (a, b) in BANDS.items()))


def edge(spectrum: DataFrame, hz: float, share: float = 0.95) -> DataFrame:
    """The lowest frequency up to which ``share`` of the power lies, and the peak frequency."""
    w = W.partitionBy("id")
    cum = F.sum("pw").over(w.orderBy("k")) / F.sum("pw").over(w)
    found = spectrum.withColumn("cum", cum).groupBy("id").agg(F.min(F.when(F.col("cum") >= share - 1e-12, F.col("k"))).alias("k"), F.min(F.struct((-F.col("pw")).alias("p"), "k")).alias("top"))
    return found.select("id", (F.col("k") * hz).alias("edge"), (F.col("top.k") * hz).alias("peak"))


def entropy(spectrum: DataFrame) -> DataFrame:
    """Spectral entropy in nats; bins without power are left out."""
    q = spectrum.withColumn("q", F.col("pw") / F.sum("pw").over(W.partitionBy("id"))).where("q > 0")
    return q.groupBy("id").agg(F.sum(-F.col("q") * F.log("q")).alias("entropy"))


def band_vector(density: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of the bands, peak frequency, 95 % edge and entropy in nats of densities (keys, f, density); zero without power."""
    w = W.partitionBy(*keys)
    total = F.sum("density").over(w)
    cum = F.sum("density").over(w.orderBy("f"))
    q = F.try_divide(F.col("density"), total)
    rows = density.withColumn("q", F.coalesce(q, F.lit(0.0))).withColumn("edge", (cum >= 0.95 * total * (1 - 1e-12)) & (total > 0))
    share = lambda a, b: F.sum(F.when(F.col("f").between(a, b), F.col("q")).otherwise(0.0))
    peak = F.min(F.when(F.col("q") > 0, F.struct((-F.round("q", 12)).alias("q"), "f")))["f"]
    return rows.groupBy(*keys).agg(
        *(share(a, b).alias(n) for n, (a, b) in BANDS.items()), F.coalesce(peak, F.lit(0.0)).alias("peak"),
        F.coalesce(F.min(F.when(F.col("edge"), F.col("f"))), F.lit(0.0)).alias("edge"), F.sum(F.when(F.col("q") > 0, -F.col("q") * F.log("q")).otherwise(0.0)).alias("entropy"),
    )


def amplitude_shares(spectrum: DataFrame, keys: list[str]) -> DataFrame:
    """Percentages of the mean amplitude from 0.5 to 45 Hz in each band, upper ends excluded, from (keys, f, a)."""
    inside = F.sum(F.when(F.col("f").between(0.5, 45.0), F.col("a")).otherwise(0.0))
    own = lambda lo, hi: F.sum(F.when((F.col("f") >= lo) & (F.col("f") < hi), F.col("a")).otherwise(0.0))
    return spectrum.groupBy(*keys).agg(*((100 * F.try_divide(own(lo, hi), inside)).alias(n) for n, (lo, hi) in BANDS.items()))
