"""Queries on the second round: credibility, arbitration, variants of the decision and its calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.operators import evaluation as ev
from signalloom.operators import fusion as fu
from signalloom.plans.fusion_queries import BASE, SHAPE
from signalloom.plans.registry import query, rounded
from signalloom.session import cut
from signalloom.sources.tables import PROBS2, probabilities

R = lambda sql, k=4: f"(round({sql} + 1e-9, {k}) + 0)"
P2 = "WITH " + PROBS2
LEVEL = "CASE id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END"
FITS = "CASE level " + " ".join(f"WHEN '{k}' THEN CASE agent " + " ".join(f"WHEN {a} THEN {x:.2f}::DOUBLE" for a, x in t.items()) + " END" for k, t in fu.FITS.items()) + " END"
BOOST = f"{BASE} * CASE WHEN level = 'high' AND agent IN (1, 3) THEN 1.10::DOUBLE WHEN level = 'low' AND agent = 0 THEN 1.15::DOUBLE ELSE 1 END"
CRED = f""", c1 AS (SELECT id, agent, max(p) AS c1 FROM p GROUP BY ALL), m2 AS (SELECT *, avg(p) OVER (PARTITION BY id, c) AS m FROM p2),
f2 AS (SELECT id, agent, {LEVEL} AS level, least(greatest(sum(p * m) / (sqrt(sum(p * p)) * (sqrt(sum(m * m)) + 1e-12) + 1e-12), 0), 1) AS cos, max(p) AS c2 FROM m2 GROUP BY ALL),
cr AS (SELECT id, agent, level, cos, c2 - c1 AS gain, {FITS} AS fit FROM f2 JOIN c1 USING (id, agent)),
cd AS (SELECT *, 0.40 * cos + 0.35 * least(greatest((gain + 0.05) / 0.1, 0), 1) + 0.25 * fit AS cred FROM cr)"""
FLAG = ", fl AS (SELECT id, round(max_diff, 6) > 0.3 OR majority < 0.6 OR entropy > 1.099 AS disagree FROM h JOIN j USING (id))"
VARIANTS = (
    P2
    + SHAPE
    + FLAG
    + CRED
    + f""", mo AS (SELECT unnest(['full', 'no_arbitration', 'fixed_weights', 'equal_weights']) AS mode),
b0 AS (SELECT id, agent, mode, disagree, cred, CASE mode WHEN 'fixed_weights' THEN {BASE} WHEN 'equal_weights' THEN 1 ELSE {BOOST} END AS w FROM cd JOIN fl USING (id), mo),
b1 AS (SELECT *, least(greatest(w / sum(w) OVER (PARTITION BY id, mode), 0.05), 0.6) AS h FROM b0),
b2 AS (SELECT id, agent, mode, cred, CASE mode WHEN 'fixed_weights' THEN w ELSE h / sum(h) OVER (PARTITION BY id, mode) END AS w, disagree AND mode <> 'no_arbitration' AS arbitrated FROM b1),
b3 AS (SELECT *, least(greatest(w * cred / sum(w * cred) OVER (PARTITION BY id, mode), 0.05), 0.6) AS h FROM b2),
bw AS (SELECT id, agent, mode, arbitrated, CASE WHEN arbitrated THEN h / sum(h) OVER (PARTITION BY id, mode) ELSE w END AS w FROM b3),
bp AS (SELECT p.id, p.subject, p.y, p.agent, p.c, p.p AS q1, p2.p AS q2 FROM p JOIN p2 USING (id, agent, c)),
vt AS (SELECT id, subject, y, mode, c, arbitrated, round(sum(w * CASE WHEN arbitrated THEN q2 ELSE q1 END) / sum(w) + 1e-9, 6) AS p FROM bp JOIN bw USING (id, agent) GROUP BY ALL),
vl AS (SELECT id, subject, y, mode, arbitrated, arg_min(c, (-p, c)) AS label, max(p) AS confidence FROM vt GROUP BY ALL),
sm AS (SELECT mode, subject, c, round(avg(p) + 1e-9, 6) AS p, arg_min(y, id) AS y, min(id) AS f FROM vt GROUP BY ALL),
sl AS (SELECT mode, subject, arg_min(c, (-p, c)) AS label, arg_min(y, f) AS y FROM sm GROUP BY ALL)"""
)
MACRO = """{0} AS (WITH n AS (SELECT mode, y, label, count(*) AS n FROM {1} GROUP BY ALL), k AS (SELECT mode, y AS c, n AS t, 0 AS s, CASE WHEN y = label THEN n ELSE 0 END AS tp FROM n UNION ALL SELECT mode, label, 0, n, 0 FROM n),
g AS (SELECT mode, c, sum(t) AS t, sum(s) AS s, sum(tp) AS tp FROM k GROUP BY ALL) SELECT mode, sum(tp) / sum(t) AS acc, avg(2 * tp / (s + t)) AS f1, sum(t * coalesce(tp / nullif(s, 0), 0)) / sum(t) AS pr,
sum(t * coalesce(tp / nullif(t, 0), 0)) / sum(t) AS re, sum(t * 2 * tp / (s + t)) / sum(t) AS wf FROM g GROUP BY mode)"""


def _levels(probs: DataFrame) -> DataFrame:
    return probs.select("id").distinct().withColumn("level", F.when(F.col("id") % 3 == 0, "high").when(F.col("id") % 3 == 1, "low").otherwise("medium"))


def _rounds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    first = probabilities(spark, sf_dir)
    return first, fu.second_opinion(first, probabilities(spark, sf_dir, True)).withColumn("p", F.round("p", 6))


def _votes(spark: SparkSession, sf_dir: str, modes: tuple[str, ...] = fu.MODES) -> DataFrame:
    first, second = _rounds(spark, sf_dir)
    flags = fu.disagreement(first).select("id", "disagree")
    return fu.weigh(first, second.join(flags.where("disagree"), "id", "left_semi"), _levels(first), flags, modes)


@query(P2 + " SELECT id, agent, c, p FROM p2")
def second_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounds(spark, sf_dir)[1].select("id", "agent", "c", "p")


@query(P2 + CRED + f" SELECT id, agent, {R('cos')} AS cos, {R('gain')} AS gain, fit, {R('cred')} AS cred FROM cd")
def credibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _rounds(spark, sf_dir)
    return fu.credibility(second, first, _levels(first)).select("id", "agent", rounded("cos").alias("cos"), rounded("gain").alias("gain"), "fit", rounded("cred").alias("cred"))


@query(P2 + CRED + f""", w AS (SELECT id, agent, {BASE} * cred AS w FROM cd), n AS (SELECT id, agent, least(greatest(w / sum(w) OVER (PARTITION BY id), 0.05), 0.6) AS w FROM w)
SELECT id, agent, {R('w / sum(w) OVER (PARTITION BY id)')} AS w FROM n""")
def arbitration_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _rounds(spark, sf_dir)
    w = fu.credibility(second, first, _levels(first)).withColumn("w", fu.lookup(fu.BASE, F.col("agent"), 0.25) * F.col("cred"))
    return fu.clamped(w, "w", ["id"]).select("id", "agent", rounded("w").alias("w"))


_UNITS = f", u AS (SELECT id, agent, {LEVEL} AS level FROM p WHERE c = 0)"


@query(P2 + _UNITS + f", b AS (SELECT *, {BOOST} AS w FROM u), n AS (SELECT id, agent, level, least(greatest(w / sum(w) OVER (PARTITION BY id), 0.05), 0.6) AS w FROM b) SELECT id, agent, level, {R('w / sum(w) OVER (PARTITION BY id)')} AS w FROM n")
def dynamic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = probabilities(spark, sf_dir).where("c = 0").select("id", "agent")
    rows = rows.join(_levels(rows), "id")
    w = fu.lookup(fu.BASE, F.col("agent"), 0.25) * fu.quality_boost(F.col("level"), F.col("agent"))
    return fu.clamped(rows.withColumn("w", w), "w", ["id"]).withColumn("w", rounded("w"))


@query(P2 + f""", u AS (SELECT id, agent, (id % 101) / 100 AS q FROM p WHERE c = 0),
b AS (SELECT *, {BASE} * CASE WHEN q >= 0.8 THEN CASE WHEN agent = 0 THEN 1 - (q - 0.5) * 0.4 * 0.3 ELSE 1 + (q - 0.5) * 0.4 * 0.5 END
  WHEN q <= 0.5 THEN CASE agent WHEN 0 THEN 1 - (q - 0.5) * 0.4 * 0.5 WHEN 3 THEN 1 + (q - 0.5) * 0.4 * 0.3 ELSE 1 END ELSE 1 END AS w FROM u),
n AS (SELECT id, agent, least(greatest(w / sum(w) OVER (PARTITION BY id), 0.05), 0.6) AS w FROM b) SELECT id, agent, {R('w / sum(w) OVER (PARTITION BY id)')} AS w FROM n""")
def quality_shift_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by a quality from 0 to 1."""
    rows = probabilities(spark, sf_dir).where("c = 0").select("id", "agent", ((F.col("id") % 101) / 100).alias("q"))
    w = fu.lookup(fu.BASE, F.col("agent"), 0.25) * fu.quality_shift(F.col("q"), F.col("agent"))
    return fu.clamped(rows.withColumn("w", w), "w", ["id"]).select("id", "agent", rounded("w").alias("w"))


@query(VARIANTS + f" SELECT id, label, {R('confidence')} AS confidence, arbitrated FROM vl WHERE mode = 'full'")
def diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole decision of every epoch; only those whose agents disagree are scored a second time."""
    first = probabilities(spark, sf_dir)
    found = fu.diagnose(first, probabilities(spark, sf_dir, True), _levels(first))
    return found.select("id", "label", rounded("confidence").alias("confidence"), "arbitrated")


@query(VARIANTS + ", " + MACRO.format("me", "vl") + ", " + MACRO.format("ms", "sl") + f" SELECT mode, {R('me.acc')} AS epoch_acc, {R('me.f1')} AS epoch_macro_f1, {R('ms.acc')} AS subject_acc, {R('ms.f1')} AS subject_macro_f1 FROM me JOIN ms USING (mode)")
def ablation_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs' and subjects' accuracy and F1 of every way of weighing."""
    votes = _votes(spark, sf_dir)
    of = lambda pred, name: ev.metrics(pred, ["mode"]).select("mode", rounded("accuracy").alias(f"{name}_acc"), rounded("macro_f1").alias(f"{name}_macro_f1"))
    return of(fu.best(votes, ["id", "mode", "y"], "p"), "epoch").join(of(ev.by_subject_label(votes, ["mode"]), "subject"), "mode")


@query(VARIANTS + ", " + MACRO.format("me", "vl") + f" SELECT mode, {R('acc')} AS accuracy, {R('pr')} AS precision, {R('re')} AS recall, {R('wf')} AS f1, {R('f1')} AS macro_f1 FROM me")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ev.metrics(fu.best(_votes(spark, sf_dir), ["id", "mode", "y"], "p"), ["mode"])
    return m.select("mode", *(rounded(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "macro_f1")))


@query(VARIANTS + f""", zq AS (SELECT mode, c, y = c AS pos, rank() OVER (PARTITION BY mode, c ORDER BY p) + (count(*) OVER (PARTITION BY mode, c, p) - 1) / 2 AS r FROM vt),
za AS (SELECT mode, c, (sum(r) FILTER (pos) - sum(pos::INT) * (sum(pos::INT) + 1) / 2) / (sum(pos::INT) * sum((NOT pos)::INT)) AS auc, sum(pos::INT) AS n FROM zq GROUP BY ALL)
SELECT mode, {R('sum(auc * n) / sum(n)')} AS auc FROM za GROUP BY mode""")
def weighted_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.ovr_auc(_votes(spark, sf_dir), ["mode"]).withColumn("auc", rounded("auc"))


@query(VARIANTS + f""", zf AS (SELECT subject, label = y AS ok FROM sl WHERE mode = 'full'), zk AS (SELECT mode, sum((zf.ok AND label <> y)::INT)::BIGINT AS b, sum((NOT zf.ok AND label = y)::INT)::BIGINT AS c FROM sl JOIN zf USING (subject) WHERE mode <> 'full' GROUP BY mode),
zt AS (SELECT mode, b, c, unnest(range(0, least(b, c) + 1)) AS k FROM zk)
SELECT mode, b, c, {R("CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2)))) END")} AS p FROM zt GROUP BY mode, b, c""")
def variant_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each variant's subjects against those of the full system, paired."""
    right = ev.by_subject_label(_votes(spark, sf_dir), ["mode"]).select("mode", "subject", (F.col("label") == F.col("y")).alias("ok"))
    full = right.where("mode = 'full'").select("subject", F.col("ok").alias("first"))
    return ev.mcnemar(right.where("mode <> 'full'").withColumnRenamed("ok", "second").join(full, "subject"), ["mode"]).withColumn("p", rounded("p"))


@query(VARIANTS + f", zl AS (SELECT *, {LEVEL} AS level FROM vl) SELECT level, mode, count(*) AS n, {R('avg((label = y)::INT)')} AS accuracy FROM zl GROUP BY ALL")
def quality_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of each variant by the epochs' quality."""
    best = fu.best(_votes(spark, sf_dir), ["id", "mode", "y"], "p")
    return best.join(_levels(best), "id").groupBy("level", "mode").agg(F.count("*").alias("n"), rounded(F.avg((F.col("label") == F.col("y")).cast("int"))).alias("accuracy"))


@query(VARIANTS + f", zl AS (SELECT subject, bool_or({LEVEL} <> 'high') AS has_low FROM vl WHERE mode = 'full' GROUP BY subject) SELECT has_low, mode, count(*) AS n, {R('avg((label = y)::INT)')} AS accuracy FROM sl JOIN zl USING (subject) GROUP BY ALL")
def subject_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of each variant over subjects with and without an epoch below high quality."""
    votes = _votes(spark, sf_dir)
    low = votes.select("id", "subject").distinct().join(_levels(votes), "id").groupBy("subject").agg(F.max(F.col("level") != "high").alias("has_low"))
    found = ev.by_subject_label(votes, ["mode"]).join(low, "subject")
    return found.groupBy("has_low", "mode").agg(F.count("*").alias("n"), rounded(F.avg((F.col("label") == F.col("y")).cast("int"))).alias("accuracy"))


@query(VARIANTS + f""", za AS (SELECT id, y, label FROM vl WHERE mode = 'full'), zb AS (SELECT id, label AS before FROM vl WHERE mode = 'no_arbitration')
SELECT {R('avg(disagree::INT)')} AS disagreement_rate, sum(disagree::INT)::BIGINT AS n_arbitrated, {R('coalesce(avg((before = y)::INT) FILTER (disagree), 0)')} AS acc_before, {R('coalesce(avg((label = y)::INT) FILTER (disagree), 0)')} AS acc_after FROM za JOIN zb USING (id) JOIN fl USING (id)""")
def mechanism_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often agents disagree, and what arbitration does for those epochs."""
    best = fu.best(_votes(spark, sf_dir, ("full", "no_arbitration")), ["id", "mode", "y"], "p")
    wide = best.groupBy("id").pivot("mode", ["full", "no_arbitration"]).agg(F.max((F.col("label") == F.col("y")).cast("int")))
    wide = wide.join(fu.disagreement(probabilities(spark, sf_dir)).select("id", "disagree"), "id")
    of = lambda c: rounded(F.coalesce(F.avg(F.when(F.col("disagree"), F.col(c))), F.lit(0.0)))
    return wide.agg(rounded(F.avg(F.col("disagree").cast("int"))).alias("disagreement_rate"), F.sum(F.col("disagree").cast("long")).alias("n_arbitrated"), of("no_arbitration").alias("acc_before"), of("full").alias("acc_after"))


SPREADS, MAJORITIES, ENTROPIES = [round(0.15 + 0.05 * k, 2) for k in range(18)], [0.5, 0.6], [round(0.8 + 0.01 * k, 3) for k in range(31)]
#: Both products of every epoch: votes of the first round by quality, and of the arbitrated one as if all epochs disagreed.
GRID = (
    VARIANTS.replace(FLAG, ", fl AS (SELECT id, true AS disagree FROM h JOIN j USING (id))")
    + f""", always AS (SELECT id, subject, y, c, p FROM vt WHERE mode = 'full'), never AS (SELECT id, subject, y, c, p FROM vt WHERE mode = 'no_arbitration'),
g AS (SELECT t1::DOUBLE AS t1, t2::DOUBLE AS t2, t3::DOUBLE AS t3 FROM (SELECT unnest({SPREADS}) AS t1), (SELECT unnest({MAJORITIES}) AS t2), (SELECT unnest({ENTROPIES}) AS t3)),
sh AS (SELECT id, round(max_diff, 6) AS max_diff, majority, round(entropy, 6) AS entropy FROM h JOIN j USING (id)),
tr AS (SELECT g.*, id, max_diff > t1 OR majority < t2 OR entropy > t3 AS hit FROM sh, g),
rt AS (SELECT t1, t2, t3, avg(hit::INT) AS rate FROM tr GROUP BY ALL HAVING avg(hit::INT) <= 0.5),
pp AS (SELECT t1, t2, t3, id, n.subject, n.y, c, CASE WHEN hit THEN a.p ELSE n.p END AS p FROM tr SEMI JOIN rt USING (t1, t2, t3) JOIN never n USING (id) JOIN always a USING (id, c)),
ea AS (SELECT t1, t2, t3, avg((label = y)::INT) AS epoch_acc FROM (SELECT t1, t2, t3, id, y, arg_min(c, (-p, c)) AS label FROM pp GROUP BY ALL) GROUP BY ALL),
ss AS (SELECT t1, t2, t3, subject, c, round(sum(p) / count(*) + 1e-9, 6) AS p, arg_min(y, id) AS y, min(id) AS f FROM pp GROUP BY ALL),
sa AS (SELECT t1, t2, t3, avg((label = y)::INT) AS subject_acc FROM (SELECT t1, t2, t3, subject, arg_min(c, (-p, c)) AS label, arg_min(y, f) AS y FROM ss GROUP BY ALL) GROUP BY ALL),
gr AS (SELECT t1, t2, t3, {R('rate')} AS rate, {R('epoch_acc')} AS epoch_acc, {R('subject_acc')} AS subject_acc FROM rt JOIN ea USING (t1, t2, t3) JOIN sa USING (t1, t2, t3))"""
)


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _rounds(spark, sf_dir)
    shape = fu.disagreement(first).select("id", F.round("max_diff", 6).alias("max_diff"), "majority", F.round("entropy", 6).alias("entropy"))
    every = first.select("id").distinct().withColumn("disagree", F.lit(True))
    votes = cut(fu.weigh(first, second, _levels(first), every, ("full", "no_arbitration")))
    of = lambda mode: votes.where(F.col("mode") == mode).select("id", "subject", "y", "c", "p")
    return ev.threshold_grid(ev.grid_cells(shape, of("no_arbitration"), of("full"), SPREADS, MAJORITIES, ENTROPIES), SPREADS, MAJORITIES, ENTROPIES)


@query(GRID + " SELECT * FROM gr")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and accuracies of 1116 settings, those that trigger more than half of the epochs left out."""
    return _grid(spark, sf_dir)


@query(GRID + " SELECT * FROM gr ORDER BY subject_acc DESC, rate, t2, t1, t3 LIMIT 10")
def best_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the ten best settings."""
    return _grid(spark, sf_dir).orderBy(F.desc("subject_acc"), "rate", "t2", "t1", "t3").limit(10)


@query(GRID + " SELECT * FROM gr WHERE round((SELECT max(subject_acc) FROM gr) - subject_acc, 6) <= 0.005 ORDER BY rate, subject_acc DESC, t2, t1, t3 LIMIT 1")
def recommended_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.recommended(_grid(spark, sf_dir))


@query(GRID + ", o AS (SELECT *, coalesce(max(subject_acc) OVER (ORDER BY rate, subject_acc DESC, t2, t1, t3 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS b FROM gr) SELECT * EXCLUDE (b) FROM o WHERE subject_acc > b")
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings more accurate than all with smaller rates; the grid has 1116 rows at most, so one window holds it."""
    return ev.frontier(_grid(spark, sf_dir))


_Q = [0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


@query(P2 + SHAPE + ", s AS (SELECT * FROM h JOIN j USING (id)) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {x}::DOUBLE AS q, {R(f'quantile_cont({m}::DOUBLE, {x})')} AS value FROM s" for m in ("max_diff", "majority", "entropy") for x in _Q))
def metric_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fu.disagreement(probabilities(spark, sf_dir))
    out = [ev.quantiles(d, m, _Q) for m in ("max_diff", "majority", "entropy")]
    return out[0].unionByName(out[1]).unionByName(out[2]).withColumn("value", rounded("value"))
