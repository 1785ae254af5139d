"""Queries on signals: epochs, features, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalloom.operators import epochs as ep
from signalloom.plans.registry import query, rounded
from signalloom.session import ship
from signalloom.sources.tables import SIGNALS, signals

ROWS = "WITH " + SIGNALS + ", w AS (SELECT rec, ch, t, v, unnest(range(greatest(0, t // 32 - 1), t // 32 + 1)) AS ep, n FROM r WHERE n >= 64), x AS (SELECT rec, ch, t, v, ep FROM w WHERE ep * 32 + 64 <= n)"
KEYS = ("rec", "ch", "ep")
R = lambda sql, k=4: f"(round({sql} + 1e-9, {k}) + 0)"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.epoch_rows(signals(spark, sf_dir))


@query(f"""{ROWS}, c AS (SELECT *, v - avg(v) OVER (PARTITION BY rec, ch, ep) AS u FROM x)
SELECT rec, ch, ep, {R("avg(v)", 2)} AS mean, {R("stddev_pop(v)", 2)} AS std, {R("avg(u * u * u) / pow(avg(u * u), 1.5)")} AS skew, {R("avg(u * u * u * u) / pow(avg(u * u), 2) - 3")} AS kurt,
{R("sqrt(avg(v * v))", 2)} AS rms, {R("max(v) - min(v)", 2)} AS ptp, {R("max(abs(v))", 2)} AS max_abs FROM c GROUP BY ALL""")
def epoch_time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ep.time_features(_rows(spark, sf_dir))
    return f.select(*KEYS, *(rounded(c, 2).alias(c) for c in ("mean", "std", "rms", "ptp", "max_abs")), *(rounded(c).alias(c) for c in ("skew", "kurt")))


@query(f"""{ROWS}, d AS (SELECT *, v - lag(v) OVER o AS d1 FROM x WINDOW o AS (PARTITION BY rec, ch, ep ORDER BY t)),
f AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY rec, ch, ep ORDER BY t) AS d2 FROM d), g AS (SELECT rec, ch, ep, var_pop(v) AS a, var_pop(d1) AS b, var_pop(d2) AS c FROM f GROUP BY ALL)
SELECT rec, ch, ep, {R("a", 1)} AS activity, {R("sqrt(b / (a + 1e-12))")} AS mobility, {R("sqrt(c / (b + 1e-12)) / (sqrt(b / (a + 1e-12)) + 1e-12)")} AS complexity FROM g""")
def hjorth_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.hjorth(_rows(spark, sf_dir)).select(*KEYS, rounded("activity", 1).alias("activity"), rounded("mobility").alias("mobility"), rounded("complexity").alias("complexity"))


@query(f"""{ROWS}, c AS (SELECT rec, ch, ep, t, sign(v - 38000) AS s FROM x), d AS (SELECT *, abs(s - lag(s) OVER (PARTITION BY rec, ch, ep ORDER BY t)) AS d FROM c)
SELECT rec, ch, ep, {R("coalesce(sum(d), 0) / (2 * count(*))")} AS zcr FROM d GROUP BY ALL""")
def zero_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings of a level within the range of the prices, which have no negative samples."""
    rows = _rows(spark, sf_dir).withColumn("v", F.col("v") - 38000)
    return ep.zero_crossing(rows).select(*KEYS, rounded("zcr").alias("zcr"))


@query(f"""{ROWS}, k AS (SELECT rec, ch, ep, b.w, (t - ep * 32) // b.w AS k, v / 1000 AS v FROM x, (SELECT unnest([8, 16, 24]) AS w) b),
b AS (SELECT rec, ch, ep, w, k, avg(v * v) AS e FROM k WHERE (k + 1) * w <= 64 GROUP BY rec, ch, ep, w, k)
SELECT rec, ch, ep, w, {R("avg(e)")} AS mean, {R("stddev_pop(e)")} AS std FROM b GROUP BY ALL""")
def timefreq_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("v", F.col("v") / 1000)
    return ep.block_energy(rows, (8, 16, 24)).select(*KEYS, "w", rounded("mean").alias("mean"), rounded("std").alias("std"))


@query(f"""{ROWS}, c AS (SELECT rec, ep, ch, max(v) - min(v) AS ptp, stddev_pop(v) AS std FROM x GROUP BY ALL), e AS (SELECT rec, ep, max(ptp) AS ptp, min(std) AS std FROM c GROUP BY ALL),
l AS (SELECT rec, least(greatest(3 * median(ptp), 400), 99000) AS threshold FROM e GROUP BY rec)
SELECT rec, ep, {R("ptp", 2)} AS ptp, {R("threshold", 2)} AS threshold, ptp <= threshold AND std >= 0.5 AS kept FROM e JOIN l USING (rec)""")
def adaptive_epoch_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.reject(_rows(spark, sf_dir), 400.0, 99000.0, 0.5).withColumn("ptp", rounded("ptp", 2)).withColumn("threshold", rounded("threshold", 2))


@query(f"""{ROWS}, u AS (SELECT DISTINCT rec, ep FROM x), i AS (SELECT rec, ep, row_number() OVER (PARTITION BY rec ORDER BY ep) - 1 AS i, count(*) OVER (PARTITION BY rec) AS m FROM u)
SELECT rec, ep, k FROM i JOIN (SELECT unnest(range(0, 4)) AS k) ON CASE WHEN m <= 4 THEN k = i ELSE i = k * (m - 1) // 3 END""")
def epoch_uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.uniform_sample(_rows(spark, sf_dir).select("rec", "ep").distinct(), 4)


@query(f"WITH {SIGNALS} SELECT rec, ch, t, {R('v - avg(v) OVER (PARTITION BY rec, t)')} AS v FROM r")
def average_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.average_reference(signals(spark, sf_dir)).select("rec", "ch", "t", rounded("v").alias("v"))


@query(f"WITH {SIGNALS}, s AS (SELECT ch, avg(v) AS m, greatest(stddev_pop(v), 1e-8) AS s FROM r GROUP BY ch) SELECT rec, ch, t, {R('(v - m) / s')} AS z FROM r JOIN s USING (ch)")
def channel_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.zscore(signals(spark, sf_dir)).select("rec", "ch", "t", rounded("z").alias("z"))


SNR = f"""WITH {SIGNALS}, s AS (SELECT *, sum(v) OVER (PARTITION BY rec, ch ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS s FROM r),
c AS (SELECT rec, ch, var_pop(s) AS sig, var_pop(v - s) / 0.8 AS noise, stddev_pop(v) AS std FROM s GROUP BY ALL),
q AS (SELECT rec, least(greatest(avg(CASE WHEN std < 1e-9 OR noise <= 0 THEN -10 ELSE 10 * log10(sig / noise) END), -10), 40) AS snr_db FROM c GROUP BY rec)"""
ART = """, d AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY rec, ch ORDER BY t)) AS d FROM r), u AS (SELECT rec, ch, median(d) AS med FROM d GROUP BY ALL),
ac AS (SELECT rec, ch, avg((abs(v) > 90000)::INT) AS amp, avg((d > 8 * (med + 1e-9))::INT) AS jump, (stddev_pop(v) < 0.5)::INT AS flat, count(*) AS n FROM d JOIN u USING (rec, ch) GROUP BY rec, ch),
a AS (SELECT rec, CASE WHEN max(n) < 4 THEN 1 ELSE least(0.6 * avg(amp) + 0.2 * avg(jump) + 0.2 * avg(flat), 1) END AS art FROM ac GROUP BY rec)"""


@query(SNR + f" SELECT rec, {R('snr_db')} AS snr_db FROM q")
def snr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.snr(signals(spark, sf_dir)).select("rec", rounded("snr_db").alias("snr_db"))


@query(SNR + ART + f" SELECT rec, {R('art')} AS artifact_ratio FROM a")
def artifact_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.artifact_ratio(signals(spark, sf_dir), 90000.0).select("rec", rounded("artifact_ratio").alias("artifact_ratio"))


@query(SNR + ART + f""" SELECT rec, CASE WHEN art > 0.3 THEN 'low' WHEN snr_db > 10 THEN 'high' WHEN snr_db < 5 THEN 'low' ELSE 'medium' END AS quality_level,
{R("0.7 * least(greatest(snr_db / 20, 0), 1) + 0.3 * (1 - art)")} AS quality_score FROM q JOIN a USING (rec)""")
def quality_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir)
    both = ep.snr(s).join(ep.artifact_ratio(s, 90000.0), "rec")
    args = F.col("snr_db"), F.col("artifact_ratio")
    return both.select("rec", ep.quality_level(*args).alias("quality_level"), rounded(ep.quality_score(*args)).alias("quality_score"))


@query(f"""WITH {SIGNALS}, c AS (SELECT rec, ch, max(abs(v / 250)) AS a, var_pop(v / 250) AS s FROM r GROUP BY ALL)
SELECT rec, {R("avg(0.5 * CASE WHEN a < 100 THEN 1 WHEN a < 500 THEN greatest(0, 1 - (a - 100) / 400) ELSE 0 END + 0.5 * CASE WHEN s > 1 THEN 1 WHEN s > 0.1 THEN s ELSE 0.1 END)")} AS quality FROM c GROUP BY rec""")
def amplitude_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.amplitude_quality(signals(spark, sf_dir).withColumn("v", F.col("v") / 250)).select("rec", rounded("quality").alias("quality"))


@query(f"""{ROWS}, z AS (SELECT rec, ch, ep, t, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s, v FROM x WINDOW w AS (PARTITION BY rec, ep))
SELECT rec, ch, ep, t, {R("(v - m) / (s + 1e-8)")} AS z FROM z""")
def epoch_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each epoch's samples by the mean and deviation of all its channels."""
    return ep.standardise_epoch(_rows(spark, sf_dir), ["rec", "ep"]).select(*KEYS, "t", rounded("z").alias("z"))


@query(f"""{ROWS}, u AS (SELECT DISTINCT rec, ep FROM x), i AS (SELECT rec, ep, row_number() OVER (PARTITION BY rec ORDER BY ep) - 1 AS i, count(*) OVER (PARTITION BY rec) AS m FROM u),
k AS (SELECT rec, ep FROM i WHERE i % greatest(m // 5, 1) = 0 AND i // greatest(m // 5, 1) < 5), y AS (SELECT rec, ep, ch, t, v / 1000 AS v, t - ep * 32 AS i FROM x JOIN k USING (rec, ep)),
s AS (SELECT *, sum(v) OVER w / 5 AS s, abs(v - lag(v) OVER (PARTITION BY rec, ep, ch ORDER BY t)) AS d FROM y WINDOW w AS (PARTITION BY rec, ep, ch ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), md AS (SELECT rec, ep, ch, median(d) AS med FROM s GROUP BY ALL),
c AS (SELECT rec, ep, ch, CASE WHEN stddev_pop(v) < 1e-9 THEN -10 ELSE 10 * log10(greatest(var_pop(s), 1e-12) / greatest(var_pop(v - s) / 0.8, 1e-12)) END AS db, avg((abs(v) > 90)::INT) AS amp, avg((d > 8 * (med + 1e-9))::INT) AS jump, (stddev_pop(v) < 0.5)::INT AS flat FROM s JOIN md USING (rec, ep, ch) GROUP BY ALL),
q AS (SELECT rec, ep, least(greatest(avg(db), -10), 40) AS snr, least(0.6 * avg(amp) + 0.2 * avg(jump) + 0.2 * avg(flat), 1) AS art FROM c GROUP BY ALL)
SELECT rec, count(*) AS n_probes, {R("avg(snr)")} AS snr_db, {R("avg(art)")} AS artifact_ratio FROM q GROUP BY rec""")
def probe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean signal-to-noise and artifacts of each record's probes: every (n // 5)-th of its n epochs, five at most."""
    rows = _rows(ship(spark), sf_dir)
    own = W.partitionBy("rec")
    units = rows.select("rec", "ep").distinct().withColumn("i", F.row_number().over(own.orderBy("ep")) - 1)
    step = F.greatest(F.floor(F.count("*").over(own) / 5), F.lit(1))
    probes = units.withColumn("step", step).where((F.col("i") % F.col("step") == 0) & (F.col("i") / F.col("step") < 5)).select("rec", "ep")
    found = ep.epoch_quality(rows.join(probes, ["rec", "ep"]).withColumn("v", F.col("v") / 1000), 250.0, 90.0)
    return found.groupBy("rec").agg(F.count("*").alias("n_probes"), rounded(F.avg("snr_db")).alias("snr_db"), rounded(F.avg("artifact_ratio")).alias("artifact_ratio"))


@query(f"""{ROWS}, c AS (SELECT rec, ep, ch, max(v) - min(v) AS ptp, stddev_pop(v) AS std FROM x GROUP BY ALL), e AS (SELECT rec, ep, max(ptp) AS ptp, min(std) AS std FROM c GROUP BY ALL),
l AS (SELECT rec, least(greatest(3 * median(ptp), 400), 99000) AS threshold FROM e GROUP BY rec), k AS (SELECT rec, count(*) AS n_all, sum((ptp <= threshold AND std >= 0.5)::INT)::BIGINT AS n_kept FROM e JOIN l USING (rec) GROUP BY rec),
s AS (SELECT DISTINCT rec FROM r)
SELECT rec, coalesce(n_all, 0) AS n_all, coalesce(n_kept, 0) AS n_kept, CASE WHEN n_kept > 0 THEN 'ok' ELSE 'error' END AS status, CASE WHEN n_all IS NULL THEN 'no_epoch' WHEN n_kept = 0 THEN 'all_rejected' ELSE '' END AS error, {R("coalesce(n_kept / n_all, 0)")} AS keep_rate FROM s LEFT JOIN k USING (rec)""")
def epoch_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each record on its way to epochs: status, epochs made and kept."""
    s = signals(spark, sf_dir)
    m = ep.manifest(s, ep.reject(ep.epoch_rows(s), 400.0, 99000.0, 0.5))
    return m.withColumn("keep_rate", rounded("keep_rate"))
