"""Queries on experiments out of fold: blocks and agents left out, age taken off, boosted trees."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.operators import boosting as bo
from signalloom.operators import evaluation as ev
from signalloom.operators import out_of_fold as oof
from signalloom.operators.decision import DecisionEstimator, DecisionModel
from signalloom.operators.protocol import Scorer, score_rows
from signalloom.plans.arbitration_queries import LEVEL, P2, VARIANTS
from signalloom.plans.model_queries import rows_only
from signalloom.plans.registry import query, rounded
from signalloom.session import checkpoint_dir, ship
from signalloom.sources.tables import PROBS, VECTORS, probabilities, vectors

R = lambda sql, k=4: f"(round({sql} + 1e-9, {k}) + 0)"
FOLD = "subject % 5"
BLOCKS = ["time", "frequency", "wavelet", "spatial", "event"]

METRICS = f"""cm AS (SELECT variant, y, label, count(*) AS n FROM pred GROUP BY ALL), cs AS (SELECT variant, c, sum(t) AS t, sum(s) AS s, sum(k) AS k FROM (SELECT variant, y AS c, n AS t, 0 AS s, CASE WHEN y = label THEN n ELSE 0 END AS k FROM cm UNION ALL SELECT variant, label, 0, n, 0 FROM cm) GROUP BY variant, c),
ms AS (SELECT variant, sum(k) / sum(t) AS accuracy, avg(2 * k / (s + t)) AS macro_f1 FROM cs GROUP BY variant)
SELECT variant, {R('accuracy')} AS accuracy, {R('macro_f1')} AS macro_f1, {R("(SELECT accuracy FROM ms WHERE variant = 'all') - accuracy")} AS drop FROM ms"""


def centroids(source: str, prefix: str = "") -> str:
    """CTEs from rows (id, fold, y, pos, x) to distances (id, y, c, block, d)."""
    p = prefix
    return f"""{p}fo AS (SELECT DISTINCT fold AS out FROM {source}), {p}st AS (SELECT out, pos, CASE WHEN stddev_pop(x) > 1e-8 THEN stddev_pop(x) ELSE 1 END AS std FROM {source} JOIN {p}fo ON fold <> out GROUP BY ALL),
{p}cn AS (SELECT out, pos, y AS c, avg(x) AS mean FROM {source} JOIN {p}fo ON fold <> out GROUP BY ALL),
{p}di AS (SELECT id, s.y, c, (s.pos // 13)::INT AS block, sum(pow((x - mean) / std, 2)) AS d FROM {source} s JOIN {p}cn ON out = fold AND {p}cn.pos = s.pos JOIN {p}st ON {p}st.out = fold AND {p}st.pos = s.pos GROUP BY ALL)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).withColumn("fold", F.col("subject") % 5)


def _metrics(pred: DataFrame) -> DataFrame:
    found = oof.drops_by_metric(pred)
    return found.select("variant", *(rounded(c).alias(c) for c in ("accuracy", "macro_f1", "drop")))


@query(f"""WITH {VECTORS}, f AS (SELECT *, {FOLD} AS fold FROM e), {centroids("f")}, nm AS (SELECT unnest({BLOCKS}) AS name, unnest(range(0, 5)) AS b),
va AS (SELECT 'all' AS variant, id, y, c, sum(d) AS d FROM di GROUP BY ALL UNION ALL SELECT 'no_' || name, id, y, c, sum(CASE WHEN block <> b THEN d ELSE 0 END) FROM di, nm GROUP BY ALL),
pred AS (SELECT variant, id, y, arg_min(c, (round(d, 9), c)) AS label FROM va GROUP BY ALL), {METRICS}""")
def oof_block_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five blocks of features left out in turn, by class means and norms that the scored fold has no part in."""
    return _metrics(oof.nearest(oof.block_drops(_rows(spark, sf_dir), F.floor(F.col("pos") / 13).cast("int"), BLOCKS), ["variant"]))


@query(f"""WITH {PROBS}, b AS (SELECT id, {FOLD} AS fold, y, agent, arg_min(c, (-p, c)) AS l FROM p GROUP BY ALL), fo AS (SELECT DISTINCT fold AS out FROM b),
w AS (SELECT out, agent, avg((l = y)::INT) AS w FROM b JOIN fo ON fold <> out GROUP BY ALL), v AS (SELECT id, y, c, p.agent, w * p AS wp FROM p JOIN w ON out = {FOLD} AND w.agent = p.agent),
va AS (SELECT 'all' AS variant, id, y, c, -sum(wp) AS d FROM v GROUP BY ALL UNION ALL SELECT 'no_' || a, id, y, c, -sum(CASE WHEN agent <> a THEN wp ELSE 0 END) FROM v, (SELECT unnest(range(0, 4)) AS a) GROUP BY ALL),
pred AS (SELECT variant, id, y, arg_min(c, (round(d, 9), c)) AS label FROM va GROUP BY ALL), {METRICS}""")
def oof_agent_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents left out in turn, voting by the accuracies that they have in the other folds."""
    probs = probabilities(spark, sf_dir).withColumn("fold", F.col("subject") % 5)
    return _metrics(oof.agent_drops(probs, [0, 1, 2, 3]))


@query(f"""WITH {VECTORS}, f AS (SELECT *, {FOLD} AS fold, 3 + subject % 17 + y AS age FROM e), li AS (SELECT out, pos, regr_slope(x, age) AS b, avg(x) AS mx, avg(age) AS ma FROM f JOIN (SELECT DISTINCT fold AS out FROM f) ON fold <> out GROUP BY ALL),
g AS (SELECT id, fold, y, f.pos, x - (mx + b * (age - ma)) AS x FROM f JOIN li ON out = fold AND li.pos = f.pos), {centroids("f", "a")}, {centroids("g", "b")},
va AS (SELECT 'all' AS variant, id, y, c, sum(d) AS d FROM adi GROUP BY ALL UNION ALL SELECT 'residual', id, y, c, sum(d) FROM bdi GROUP BY ALL),
pred AS (SELECT variant, id, y, arg_min(c, (round(d, 9), c)) AS label FROM va GROUP BY ALL), {METRICS}""")
def oof_age_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as they are, and less their line on age that the other folds give."""
    rows = _rows(spark, sf_dir).withColumn("age", 3 + F.col("subject") % 17 + F.col("y"))
    summed = lambda r, name: oof.distances(r, F.lit(0)).select(F.lit(name).alias("variant"), "id", "y", "c", "d")
    both = summed(rows, "all").unionByName(summed(oof.residuals(rows, "age"), "residual"))
    return _metrics(oof.nearest(both, ["variant"]))


@rows_only
def boosted_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees out of fold over all features, without the first block, and of the first class against the last: metrics of each.

    Few rounds keep the query short; all models and folds grow in the same jobs.
    """
    rows = _rows(ship(spark), sf_dir).groupBy("id", "fold", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("x"))
    settings = bo.Settings(rounds=3, rate=0.3, leaves=4, bins=16)
    specs = [bo.Spec(name, f, own, classes) for f in range(5) for name, own, classes in (("all", None, (0, 1, 2)), ("no_time", tuple(range(13, 64)), (0, 1, 2)), ("ends", None, (0, 2)))]
    probs = bo.fit(rows, specs, settings).predict(rows, ("id", "y"))
    pred = probs.groupBy("model", "id", "y").agg(F.min(F.struct((-F.col("p")).alias("v"), "c")).alias("b")).select(F.col("model").alias("variant"), "id", "y", F.col("b.c").alias("label"))
    found = ev.metrics(pred.where("variant <> 'ends' or y <> 1"), ["variant"])
    return found.select("variant", *(rounded(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "macro_f1")))


#: Epochs of four channels by sixteen samples, in units in which some are clean and some are not.
RAW = f"""{VECTORS}, w AS (SELECT id, subject, y, (pos // 16)::INT AS ch, (pos % 16)::INT AS t, 400 * x AS x FROM e), nm AS (SELECT ch, avg(x) AS m, CASE WHEN stddev_pop(x) >= 1e-8 THEN stddev_pop(x) ELSE 1 END AS s FROM w WHERE subject % 5 <> 0 GROUP BY ch),
z AS (SELECT id, subject, y, ch, t, (x - m) / s AS z FROM w JOIN nm USING (ch)), fe AS (SELECT id, subject, y, ch, avg(z) AS a, stddev_pop(z) AS b, max(z) - min(z) AS r FROM z GROUP BY ALL),
fk AS (SELECT id, subject, y, unnest([ch * 3, ch * 3 + 1, ch * 3 + 2]) AS k, unnest([a, b, r]) AS v FROM fe), fn AS (SELECT k, avg(v) AS m, CASE WHEN stddev_pop(v) >= 1e-8 THEN stddev_pop(v) ELSE 1 END AS s FROM fk WHERE subject % 5 <> 0 GROUP BY k),
zz AS (SELECT z.*, q.z AS o FROM z JOIN z q ON q.id = z.id AND q.ch = z.ch AND q.t = 15 - z.t WHERE z.ch > 0),
al AS (SELECT id, subject, y, 0 AS agent, k, (v - m) / s AS v, (v - m) / s AS o FROM fk JOIN fn USING (k) UNION ALL SELECT id, subject, y, ch, t, z, o FROM zz),
ce AS (SELECT agent, k, y AS c, avg(v) AS m FROM al WHERE subject % 5 <> 0 GROUP BY ALL), ds AS (SELECT id, subject, y, agent, c, -0.5 * sum(pow(v - m, 2)) AS d, -0.5 * sum(pow(o - m, 2)) AS u FROM al JOIN ce USING (agent, k) GROUP BY ALL),
ex AS (SELECT *, exp(d - max(d) OVER g) AS ed, exp(u - max(u) OVER g) AS eu FROM ds WINDOW g AS (PARTITION BY id, agent)), so AS (SELECT *, ed / sum(ed) OVER g AS pd, eu / sum(eu) OVER g AS pu FROM ex WINDOW g AS (PARTITION BY id, agent)),
qq AS (SELECT *, greatest((pd + pu) / 2, 1e-8) AS q FROM so), p AS (SELECT id, subject, y, agent, c, round(pd + 1e-9, 6) AS p FROM so), p2 AS (SELECT id, subject, y, agent, c, round(CASE WHEN agent = 0 THEN pd ELSE q / sum(q) OVER (PARTITION BY id, agent) END + 1e-9, 6) AS p FROM qq),
sn AS (SELECT id, ch, t, x, coalesce(sum(x) OVER (PARTITION BY id, ch ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) / 5 AS s, abs(x - lag(x) OVER (PARTITION BY id, ch ORDER BY t)) AS d FROM w),
md AS (SELECT id, ch, median(d) AS med FROM sn GROUP BY ALL), qc AS (SELECT id, ch, CASE WHEN stddev_pop(x) < 1e-9 THEN -10 ELSE 10 * log10(greatest(var_pop(s), 1e-12) / greatest(var_pop(x - s) / 0.8, 1e-12)) END AS db, avg((abs(x) > 100)::INT) AS amp, avg((d > 8 * (med + 1e-9))::INT) AS jump, (stddev_pop(x) < 0.5)::INT AS flat FROM sn JOIN md USING (id, ch) GROUP BY ALL),
ql AS (SELECT id, least(greatest(avg(db), -10), 40) AS snr, least(0.6 * avg(amp) + 0.2 * avg(jump) + 0.2 * avg(flat), 1) AS art FROM qc GROUP BY id), lv AS (SELECT id, CASE WHEN art > 0.3 THEN 'low' WHEN snr > 10 THEN 'high' WHEN snr < 5 THEN 'low' ELSE 'medium' END AS level FROM ql)"""
DECIDED = VARIANTS.replace(P2, f"WITH {RAW}").replace(LEVEL, "(SELECT any_value(lv.level) FROM lv WHERE lv.id = m2.id)")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(ship(spark), sf_dir).withColumn("x", 400 * F.col("x"))
    rows = v.groupBy("id", "subject", "y", F.floor(F.col("pos") / 16).alias("ch")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("row"))
    return rows.groupBy("id", "subject", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", "row"))), lambda s: s["row"]).alias("x"))


@query(DECIDED + f" SELECT vl.id, label, {R('confidence')} AS confidence, arbitrated, level FROM vl JOIN lv USING (id) WHERE mode = 'full'")
def decided_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision of every raw epoch by a model that was fitted, written and read again."""
    raw = _raw(spark, sf_dir)
    folder = f"{checkpoint_dir(spark)}/decision-{uuid.uuid4().hex}"
    DecisionEstimator().fit(raw.where("subject % 5 <> 0")).save(spark, folder)
    found = DecisionModel.load(spark, folder).transform(raw)
    return found.select("id", "label", rounded("confidence").alias("confidence"), "arbitrated", "level")


def _sign(rows: np.ndarray) -> np.ndarray:
    high = (rows[:, :, -1] > rows[:, :, 0]).mean(1)
    return np.stack([1 - high, high], 1)


def _picky(rows: np.ndarray) -> np.ndarray:
    if (rows.sum(1) < 0).any():
        raise ValueError("the sum is negative")
    return np.tile([0.25, 0.5, 0.25], (len(rows), 1))


@query(f"""WITH {VECTORS}, f AS (SELECT id, sum(x) FILTER (pos < 16) AS s FROM e GROUP BY id), h AS (SELECT id, pos // 16 AS ch, sum(x) FILTER (pos % 16 = 0) AS a, sum(x) FILTER (pos % 16 = 15) AS b FROM e GROUP BY ALL),
g AS (SELECT id, greatest((avg((b > a)::INT) + avg((a > b)::INT)) / 2, 1e-8) AS high, greatest(1 - (avg((b > a)::INT) + avg((a > b)::INT)) / 2, 1e-8) AS low FROM h GROUP BY id)
SELECT id, 'picky' AS scorer, unnest([0, 1, 2]) AS c, unnest([0.25, 0.5, 0.25])::DOUBLE AS p, false AS augmented, NULL AS error FROM f WHERE s >= 0
UNION ALL SELECT id, 'picky', NULL, NULL, false, 'ValueError: the sum is negative' FROM f WHERE s < 0
UNION ALL SELECT id, 'sign', unnest([0, 1]), {R("unnest([low / (low + high), high / (low + high)])")}, false, NULL FROM g
UNION ALL SELECT id, 'wide', unnest([0, 1, 2]), {R("unnest([1.0, 2.0, 3.0]) / 6")}, true, NULL FROM f
UNION ALL SELECT id, 'narrow', NULL, NULL, false, 'takes 5 features, got 16' FROM f""")
def own_scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four scorers of different inputs in one second round: one fails on some rows, one falls back, one gets augmented features, one can't be served."""
    raw = _raw(spark, sf_dir).withColumn("x", F.transform("x", lambda r: F.transform(r, lambda v: v / 400)))
    rows = raw.withColumn("base", F.get("x", F.lit(0))).withColumn("more", F.concat("base", F.get("x", F.lit(1))))
    wide = lambda x: np.tile([1.0, 2.0, 3.0], (len(x), 1))
    scorers = [Scorer("picky", 0, "features", _picky, 16), Scorer("sign", 1, "signal", _sign, classes=2), Scorer("wide", 2, "features", wide, 32), Scorer("narrow", 3, "features", wide, 5)]
    found = score_rows(rows, scorers, ["id"], second=True)
    return found.select("id", "scorer", "c", rounded("p").alias("p"), "augmented", "error")
