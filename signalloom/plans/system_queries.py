"""Queries on connectivity, morphology, quality-aware weights, trained scorers and the whole diagnosis."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalloom.operators import scorers
from signalloom.operators import spatial as sp
from signalloom.operators.spectral import BANDS, amplitude_shares
from signalloom.plans.model_queries import rows_only
from signalloom.plans.registry import query, rounded
from signalloom.sources.tables import VECTORS, probabilities, vectors

R = lambda sql, k=4: f"(round({sql} + 1e-9, {k}) + 0)"
CHANNELS = f"WITH {VECTORS}, c AS (SELECT id, (pos // 16)::INT AS ch, (pos % 16)::INT AS t, x FROM e)"
COHERENCE = (
    CHANNELS
    + """, s AS (SELECT id, ch, k::INT AS k, sum(x * (0.5 - 0.5 * cos(2 * pi() * t / 15)) * cos(2 * pi() * t * k / 16)) AS re, -sum(x * (0.5 - 0.5 * cos(2 * pi() * t / 15)) * sin(2 * pi() * t * k / 16)) AS im FROM c, (SELECT unnest(range(1, 9)) AS k) GROUP BY ALL),
q AS (SELECT a.id, a.ch AS ch_a, b.ch AS ch_b, least(1, sqrt(pow(sum(a.re * b.re + a.im * b.im), 2) + pow(sum(a.im * b.re - a.re * b.im), 2)) / sqrt(sum(a.re * a.re + a.im * a.im) * sum(b.re * b.re + b.im * b.im))) AS coh
FROM s a JOIN s b ON a.id = b.id AND a.k = b.k AND a.ch < b.ch GROUP BY ALL)"""
)


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", F.floor(F.col("pos") / 16).cast("int").alias("ch"), (F.col("pos") % 16).alias("t"), "x")


def _coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.coherence(sp.spectra(_channels(spark, sf_dir), 16), 1, 8)


@query(COHERENCE + f" SELECT id, {R('avg(coh)')} AS mean, {R('stddev_pop(coh)')} AS std, {R('quantile_cont(coh, 0.9)')} AS p90, {R('avg((round(coh, 6) > 0.5)::INT)')} AS density FROM q GROUP BY id")
def coherence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.matrix_stats(_coherence(spark, sf_dir)).select("id", *(rounded(c).alias(c) for c in ("mean", "std", "p90", "density")))


@query(COHERENCE + f" SELECT id, ch, {R('avg(coh)')} AS strength FROM (SELECT id, ch_a AS ch, coh FROM q UNION ALL SELECT id, ch_b, coh FROM q) GROUP BY ALL")
def node_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.node_strength(_coherence(spark, sf_dir)).withColumn("strength", rounded("strength"))


@query(CHANNELS + f""" SELECT id, ch, {R('kurtosis(x)')} AS kurt, {R('max(abs(x)) / greatest(sqrt(avg(x * x)), 1e-10)')} AS peak_rms,
{R('(avg(pow(least(x, 0), 2)) - avg(pow(greatest(x, 0), 2))) / greatest(avg(pow(least(x, 0), 2)) + avg(pow(greatest(x, 0), 2)), 1e-10)')} AS negative FROM c GROUP BY ALL""")
def event_morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.morphology(_channels(spark, sf_dir)).select("id", "ch", *(rounded(c).alias(c) for c in ("kurt", "peak_rms", "negative")))


EIGHT = f"WITH {VECTORS}, c AS (SELECT id, (pos // 8)::INT AS ch, (pos % 8)::INT AS t, x FROM e)"


@query(EIGHT + f""", k AS (SELECT id, ch, kurtosis(x) AS kurt, max(abs(x)) / greatest(sqrt(avg(x * x)), 1e-10) AS p FROM c GROUP BY ALL),
r AS (SELECT a.id, a.ch AS ch_a, b.ch AS ch_b, corr(a.x, b.x) AS r FROM c a JOIN c b ON a.id = b.id AND a.t = b.t AND a.ch < b.ch GROUP BY ALL), m AS (SELECT id, max(abs(r)) AS r FROM r GROUP BY id),
s AS (SELECT id, sum(kurt) AS ks, max(kurt) AS km, stddev_pop(kurt) AS kd, max(p) AS pm, avg(kurt) FILTER (ch % 2 = 0) AS l, avg(kurt) FILTER (ch % 2 = 1) AS q FROM k GROUP BY id)
SELECT id, {R('ks')} AS kurt_sum, {R('km')} AS kurt_max, {R('kd')} AS kurt_std, {R('pm')} AS peak_max, {R('(l - q) / (l + q + 1e-8)', 2)} AS lateral, {R('r')} AS corr_max FROM s JOIN m USING (id)""")
def event_globals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vectors(spark, sf_dir).select("id", F.floor(F.col("pos") / 8).cast("int").alias("ch"), (F.col("pos") % 8).alias("t"), "x")
    g = sp.event_globals(sp.morphology(c), sp.correlations(c))
    return g.select("id", *(rounded(n).alias(n) for n in ("kurt_sum", "kurt_max", "kurt_std", "peak_max", "corr_max")), rounded("lateral", 2).alias("lateral"))


#: Channels of 16 samples at 96 Hz have bins 6 Hz apart; a band without a bin takes them all.
BAND_BINS = {"delta": (0, 8), "theta": (1, 1), "alpha": (2, 2), "beta": (3, 5), "gamma": (5, 7), "broadband": (1, 7)}


@query(CHANNELS + """, s AS (SELECT id, ch, k::INT AS k, sum(x * (0.5 - 0.5 * cos(2 * pi() * t / 15)) * cos(2 * pi() * t * k / 16)) AS re, -sum(x * (0.5 - 0.5 * cos(2 * pi() * t / 15)) * sin(2 * pi() * t * k / 16)) AS im FROM c, (SELECT unnest(range(0, 9)) AS k) GROUP BY ALL),
bb AS (SELECT * FROM (VALUES """ + ", ".join(f"('{n}', {a}, {b})" for n, (a, b) in BAND_BINS.items()) + f""") v(band, lo, hi)),
q AS (SELECT a.id, band, a.ch AS ch_a, b.ch AS ch_b, least(1, sqrt(pow(sum(a.re * b.re + a.im * b.im), 2) + pow(sum(a.im * b.re - a.re * b.im), 2)) / sqrt(sum(a.re * a.re + a.im * a.im) * sum(b.re * b.re + b.im * b.im))) AS coh
FROM s a JOIN s b ON a.id = b.id AND a.k = b.k AND a.ch < b.ch JOIN bb ON a.k BETWEEN lo AND hi GROUP BY ALL)
SELECT id, band, {R('avg(coh)')} AS mean, {R('stddev_pop(coh)')} AS std, {R('quantile_cont(coh, 0.9)')} AS p90, {R('avg((round(coh, 6) > 0.5)::INT)')} AS density FROM q GROUP BY ALL""")
def spatial_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherence statistics of five bands and the broad one."""
    found = sp.band_stats(sp.spectra(_channels(spark, sf_dir), 16), 6.0, BANDS)
    return found.select("id", "band", *(rounded(c).alias(c) for c in ("mean", "std", "p90", "density")))


@query(f"""WITH {VECTORS}, c AS (SELECT id, (pos // 16)::INT AS ch, (pos % 16)::INT AS t, x - avg(x) OVER (PARTITION BY id, pos // 16) AS x FROM e),
z AS (SELECT id, ch, k, sqrt(pow(sum(x * cos(2 * pi() * t * k / 16)), 2) + pow(sum(x * sin(2 * pi() * t * k / 16)), 2)) AS a FROM c, (SELECT unnest(range(0, 9)) AS k) GROUP BY ALL),
f AS (SELECT id, k * 6.0::DOUBLE AS f, avg(a) AS a FROM z GROUP BY ALL)
SELECT id, """ + ", ".join(f"{R(f'100 * sum(CASE WHEN f >= {a} AND f < {b} THEN a ELSE 0 END) / sum(CASE WHEN f BETWEEN 0.5 AND 45 THEN a ELSE 0 END)')} AS {n}" for n, (a, b) in BANDS.items()) + " FROM f GROUP BY id")  # fmt: skip
def amplitude_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentages of the mean amplitude in each band."""
    c = _channels(spark, sf_dir)
    c = c.withColumn("x", F.col("x") - F.avg("x").over(W.partitionBy("id", "ch")))
    bins = spark.range(9).select(F.col("id").cast("int").alias("k"))
    angle = F.col("t") * F.col("k") * (2 * math.pi / 16)
    s = c.crossJoin(F.broadcast(bins)).groupBy("id", "ch", "k").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"))
    a = s.groupBy("id", (F.col("k") * 6.0).alias("f")).agg(F.avg(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("a"))
    return amplitude_shares(a, ["id"]).select("id", *(rounded(n).alias(n) for n in BANDS))


@rows_only
def trained_scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long probabilities of two fitted models over the vectors."""
    rows = vectors(spark, sf_dir).groupBy("id", "subject", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("x"))
    train = rows.where("id % 5 <> 0")
    return scorers.fit_and_score(train, rows, "forest", ["id", "subject", "y"]).unionByName(scorers.fit_and_score(train, rows, "logistic", ["id", "subject", "y"]))


@rows_only
def stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacked subject probabilities."""
    probs = probabilities(spark, sf_dir)
    return scorers.stack(probs.withColumn("agent", F.col("agent").cast("string")), probs.where("subject % 5 <> 0").select("subject").distinct(), ["0", "1", "2", "3"])
