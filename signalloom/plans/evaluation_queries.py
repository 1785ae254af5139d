"""Queries on evaluation, sampling and the caches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.operators import epochs as ep
from signalloom.operators import evaluation as ev
from signalloom.operators import fusion as fu
from signalloom.operators.ranking import evenly
from signalloom.plans import report
from signalloom.plans.epoch_queries import ROWS
from signalloom.plans.fusion_queries import BASE, H, LABELS, P
from signalloom.plans.registry import query, rounded
from signalloom.session import checkpoint_dir, read
from signalloom.sources import cache, readers
from signalloom.sources.tables import SIGNALS, VECTORS, probabilities, signals, vectors

R = lambda sql, k=4: f"(round({sql} + 1e-9, {k}) + 0)"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fu.best(probabilities(spark, sf_dir), ["id", "subject", "y", "agent"], "p")


@query(P + LABELS + ", n AS (SELECT subject, agent, label, count(*) AS n FROM a GROUP BY ALL) SELECT subject, agent, arg_min(label, (-n, label)) AS label FROM n GROUP BY ALL")
def majority_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject's commonest label by agent."""
    return ev.majority_label(_labels(spark, sf_dir), ["subject", "agent"])


@query(f"WITH n AS (SELECT vec_id % 50 AS subject, label % 3 AS y, count(*) AS n FROM embeddings GROUP BY ALL) SELECT subject, {R('max(n) / sum(n)')} AS baseline FROM n GROUP BY subject")
def majority_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.majority_baseline(vectors(spark, sf_dir).where("pos = 0"), ["subject"]).withColumn("baseline", rounded("baseline"))


AUCS = f"""WITH {VECTORS}, q AS (SELECT pos, y > 0 AS pos_, rank() OVER (PARTITION BY pos ORDER BY x) + (count(*) OVER (PARTITION BY pos, x) - 1) / 2 AS r FROM e),
au AS (SELECT pos, (sum(r) FILTER (pos_) - sum(pos_::INT) * (sum(pos_::INT) + 1) / 2) / (sum(pos_::INT) * sum((NOT pos_)::INT)) AS auc FROM q GROUP BY pos)"""


def _aucs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.feature_aucs(vectors(spark, sf_dir).select(F.col("pos").alias("feature"), (F.col("y") > 0).alias("pos"), F.col("x").alias("s")), "feature")


@query(AUCS + f" SELECT pos AS feature, {R('auc')} AS auc, {R('abs(auc - 0.5)')} AS dev FROM au")
def feature_aucs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aucs(spark, sf_dir).select("feature", rounded("auc").alias("auc"), rounded("dev").alias("dev"))


@query(AUCS + f" SELECT {R('median(abs(auc - 0.5))')} AS median_dev, {R('max(abs(auc - 0.5))')} AS max_dev FROM au")
def feature_auc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aucs(spark, sf_dir).agg(rounded(F.median("dev")).alias("median_dev"), rounded(F.max("dev")).alias("max_dev"))


@query(f"WITH {VECTORS} SELECT subject, pos, {R('avg(x)')} AS mean FROM e GROUP BY ALL")
def subject_feature_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).groupBy("subject", "pos").agg(rounded(F.avg("x")).alias("mean"))


@query(P + LABELS + f""", f AS (SELECT a.*, fold FROM a JOIN (SELECT vec_id AS id, ((row_number() OVER (PARTITION BY label % 3 ORDER BY {H}, vec_id) - 1) % 5)::INT AS fold FROM embeddings) USING (id)),
g AS (SELECT agent, fold, avg((label = y)::INT) AS acc FROM f GROUP BY ALL) SELECT agent, {R('avg(acc)')} AS mean_acc, {R('stddev_pop(acc)')} AS std_acc, count(*) AS folds FROM g GROUP BY agent""")
def fold_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean accuracy over five stratified folds."""
    folds = ev.kfold(vectors(spark, sf_dir).where("pos = 0").select("id", "y"), "id", "y").select("id", "fold")
    acc = ev.metrics(_labels(spark, sf_dir).join(folds, "id"), ["agent", "fold"])
    return acc.groupBy("agent").agg(rounded(F.avg("accuracy")).alias("mean_acc"), rounded(F.stddev_pop("accuracy")).alias("std_acc"), F.count("*").alias("folds"))


@query(P + LABELS + ", n AS (SELECT agent, label, count(*) AS n FROM a GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY n DESC, label) AS k FROM n) SELECT agent, label, n FROM k WHERE k <= 2")
def vote_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two commonest labels of each agent."""
    return report.counters(_labels(spark, sf_dir), ["agent"], "label", 2)


@query(f"WITH k AS (SELECT vec_id AS id, vec_id % 50 AS subject, row_number() OVER (PARTITION BY vec_id % 50 ORDER BY {H}, vec_id) AS k FROM embeddings) SELECT id, subject FROM k WHERE k <= 3")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three epochs of each subject, by the hash of their ids."""
    return ev.sampled(vectors(spark, sf_dir).where("pos = 0").select("id", "subject"), "id", ["subject"], 3)


@query(f"WITH s AS (SELECT DISTINCT vec_id % 50 AS subject, label % 3 AS y, vec_id FROM embeddings), f AS (SELECT subject, arg_min(y, vec_id) AS y FROM s GROUP BY subject), k AS (SELECT subject, y, row_number() OVER (PARTITION BY y ORDER BY {H.replace('vec_id', 'subject')}, subject) AS k FROM f) SELECT subject, y FROM k WHERE k <= 4")
def balanced_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four subjects of each class."""
    units = vectors(spark, sf_dir).where("pos = 0").groupBy("subject").agg(F.min_by("y", "id").alias("y"))
    return ev.sampled(units, "subject", ["y"], 4)


@query(f"WITH s AS (SELECT DISTINCT vec_id % 50 AS subject FROM embeddings), k AS (SELECT subject, row_number() OVER (ORDER BY {H.replace('vec_id', 'subject')}, subject) - 1 AS k, count(*) OVER () AS n FROM s) SELECT subject, CASE WHEN k < round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN k < round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM k")
def subject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects dealt to three splits; all epochs of one stay together."""
    units = vectors(spark, sf_dir).where("pos = 0").select("subject").distinct().withColumn("all", F.lit(1))
    return ev.stratified_split(units, "subject", "all").select("subject", "split")


BY_SUBJECT = """, sm AS (SELECT agent, subject, c, round(avg(p) + 1e-9, 6) AS p, arg_min(y, id) AS y, min(id) AS f FROM p GROUP BY ALL), k AS (SELECT agent, subject, CASE WHEN subject % 2 = 0 THEN 'project' ELSE 'raw_index' END AS source, arg_min(c, (-p, c)) AS label, arg_min(y, f) AS y FROM sm GROUP BY ALL),
n AS (SELECT agent, source, y, count(*) AS n FROM k GROUP BY ALL), b AS (SELECT agent, source, max(n) / sum(n) AS base FROM n GROUP BY ALL), m AS (SELECT agent, source, count(*) AS n, avg((label = y)::INT) AS acc FROM k GROUP BY ALL)"""


def _source_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("subject") % 2 == 0, "project").otherwise("raw_index")
    return ev.margins(ev.by_subject_label(probabilities(spark, sf_dir), ["agent"]).withColumn("source", source), ["agent", "source"])


@query(P + BY_SUBJECT + f"""
SELECT agent, source, n, {R('acc')} AS accuracy, {R('base')} AS baseline, {R('acc - base')} AS margin FROM m JOIN b USING (agent, source)""")
def label_source_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects' accuracy over the majority's, by where the labels come from."""
    m = _source_margins(spark, sf_dir)
    return m.select("agent", "source", "n", *(rounded(c).alias(c) for c in ("accuracy", "baseline", "margin")))


@query(P + BY_SUBJECT + f""", df AS (SELECT avg(acc - base) FILTER (source = 'project') - avg(acc - base) FILTER (source = 'raw_index') AS diff FROM m JOIN b USING (agent, source))
SELECT {R('diff')} AS diff, CASE WHEN diff > 0.05 THEN 'unreliable' WHEN diff > 0.02 THEN 'weaker' ELSE 'alike' END AS verdict FROM df""")
def label_source_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.verdict(_source_margins(spark, sf_dir)).withColumn("diff", rounded("diff"))


@query(P + f""", sm AS (SELECT agent, subject, c, round(avg(p) + 1e-9, 6) AS p, arg_min(y, id) AS y, min(id) AS f FROM p GROUP BY ALL), sl AS (SELECT agent, subject, arg_min(c, (-p, c)) AS label, arg_min(y, f) AS y FROM sm GROUP BY ALL),
ac AS (SELECT agent, round(avg((label = y)::INT) + 1e-9, 4) AS acc FROM sl GROUP BY agent), bs AS (SELECT max(n) / sum(n) AS base FROM (SELECT y, count(*) AS n FROM sl WHERE agent = 0 GROUP BY y)),
mg AS (SELECT agent, acc, greatest(acc - base, 0) AS w FROM ac, bs), n AS (SELECT agent, acc, CASE WHEN sum(w) OVER () > 0 THEN w / sum(w) OVER () ELSE 1 / count(*) OVER () END AS w FROM mg), h AS (SELECT agent, acc, least(greatest(w, 0.05), 0.6) AS w FROM n)
SELECT agent, acc, {R('w / sum(w) OVER ()')} AS w FROM h""")
def subject_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of agents by their subjects' accuracy over the majority's."""
    labels = ev.by_subject_label(probabilities(spark, sf_dir), ["agent"])
    acc = labels.groupBy("agent").agg(rounded(F.avg((F.col("label") == F.col("y")).cast("int"))).alias("acc"))
    base = ev.majority_baseline(labels.where("agent = 0"), []).first()["baseline"]
    return fu.accuracy_weights(acc, base).select("agent", "acc", rounded("w").alias("w"))


@query(P + f" SELECT id, agent, {R('sum(p) FILTER (c = 0)', 6)} AS p0, {R('sum(p) FILTER (c > 0)', 6)} AS p1, (sum(p) FILTER (c > 0) >= 0.5)::INT AS abnormal, (any_value(y) >= 1)::INT AS y FROM p GROUP BY id, agent")
def binary_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three classes as two: the abnormal ones together."""
    b = ev.binary(probabilities(spark, sf_dir), ["id", "agent"])
    return b.select("id", "agent", rounded("p0", 6).alias("p0"), rounded("p1", 6).alias("p1"), (F.col("p1") >= 0.5).cast("int").alias("abnormal"), "y")


@query(f"""{ROWS}, k AS (SELECT DISTINCT rec, ep, row_number() OVER (ORDER BY rec, ep) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT rec, ep FROM x WHERE rec % 10 < 7)),
s AS (SELECT rec, ep FROM k JOIN (SELECT unnest(range(0, 20000)) AS j) ON i = CASE WHEN m <= 20000 THEN j ELSE j * (m - 1) // 19999 END)
SELECT ch, {R('avg(v)', 2)} AS mean, {R('greatest(stddev_pop(v), 1e-8)', 2)} AS std FROM x JOIN s USING (rec, ep) GROUP BY ch""")
def training_norms(spark: SparkSession, sf_dir: str, most: int = 20_000) -> DataFrame:
    """Means and deviations of the channels, from at most 20,000 evenly spaced epochs of the training records."""
    rows = ep.epoch_rows(signals(spark, sf_dir)).where("rec % 10 < 7")
    few = evenly(rows.select("rec", "ep").distinct(), [], ["rec", "ep"], most).select("rec", "ep")
    return rows.join(few, ["rec", "ep"]).groupBy("ch").agg(rounded(F.avg("v"), 2).alias("mean"), rounded(F.greatest(F.stddev_pop("v"), F.lit(1e-8)), 2).alias("std"))


@query(f"""WITH d AS (SELECT code, n_chars::DOUBLE AS v FROM (SELECT n_chars, CASE quality WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS code FROM documents LEFT JOIN labels USING (doc_id)))
SELECT code, count(v) AS n, {R('avg(v)', 2)} AS mean, {R('stddev_samp(v)', 2)} AS std, min(v) AS min, {R('median(v)', 2)} AS median, max(v) AS max FROM d GROUP BY code""")
def described_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean, sample deviation, median and range of a value by label."""
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    v, code = F.col("n_chars").cast("double"), F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, 2).when(F.col("quality") == 2, 1)
    return docs.groupBy(code.alias("code")).agg(F.count(v).alias("n"), rounded(F.avg(v), 2).alias("mean"), rounded(F.stddev_samp(v), 2).alias("std"), F.min(v).alias("min"), rounded(F.median(v), 2).alias("median"), F.max(v).alias("max"))


@query(f"WITH {SIGNALS}, h AS (SELECT *, t * 2 >= n AS late FROM r) SELECT rec, ch, {R('avg(v)', 2)} AS mean, {R('stddev_pop(v)', 2)} AS std, min(v) AS min, max(v) AS max, {R('(avg(v) FILTER (late) - avg(v) FILTER (NOT late)) / stddev_pop(v)')} AS drift FROM h GROUP BY ALL")
def signal_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = readers.self_check(signals(spark, sf_dir))
    return c.select("rec", "ch", rounded("mean", 2).alias("mean"), rounded("std", 2).alias("std"), "min", "max", rounded("drift").alias("drift"))


@query(f"""{ROWS}, c AS (SELECT rec, ep, ch, max(v) - min(v) AS ptp, stddev_pop(v) AS std FROM x GROUP BY ALL), e AS (SELECT rec, ep, max(ptp) AS ptp, min(std) AS std FROM c GROUP BY ALL),
l AS (SELECT rec, least(greatest(3 * median(ptp), 400), 99000) AS threshold FROM e GROUP BY rec), k AS (SELECT rec, ep FROM e JOIN l USING (rec) WHERE ptp <= threshold AND std >= 0.5)
SELECT rec, ep, ch, count(*) AS n, {R('avg(v)', 2)} AS mean FROM x SEMI JOIN k USING (rec, ep) WHERE rec % 3 = 0 GROUP BY ALL""")
def epoch_cache_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept epochs written by split with their manifest, and the training split read again."""
    s = signals(spark, sf_dir)
    rows = ep.epoch_rows(s)
    kept = ep.reject(rows, 400.0, 99000.0, 0.5)
    split = F.when(F.col("rec") % 3 == 0, "train").otherwise("test")
    folder = f"{checkpoint_dir(spark)}/epochs-{uuid.uuid4().hex}"
    cache.write_epochs(rows.join(kept.where("kept").select("rec", "ep"), ["rec", "ep"]).select("rec", "ep", "ch", "t", "v").withColumn("split", split), ep.manifest(s, kept).withColumnRenamed("n_kept", "n_epochs").withColumn("split", split), folder)
    return cache.read_epochs(spark, folder, "train").groupBy("rec", "ep", "ch").agg(F.count("*").alias("n"), rounded(F.avg("v"), 2).alias("mean"))


@query(f"""{ROWS}, d AS (SELECT *, v - lag(v) OVER o AS d1 FROM x WINDOW o AS (PARTITION BY rec, ch, ep ORDER BY t)), f AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY rec, ch, ep ORDER BY t) AS d2, abs(sign(v) - sign(lag(v) OVER (PARTITION BY rec, ch, ep ORDER BY t))) AS z, v - avg(v) OVER (PARTITION BY rec, ch, ep) AS u FROM d),
g AS (SELECT rec, ch, ep, avg(v) AS m, stddev_pop(v) AS s, avg(u * u * u) / pow(avg(u * u), 1.5) AS sk, avg(u * u * u * u) / pow(avg(u * u), 2) - 3 AS ku, sqrt(avg(v * v)) AS r, max(v) - min(v) AS p, coalesce(sum(z), 0) / (2 * count(*)) AS zc, var_pop(v) AS a, sqrt(var_pop(d1) / (var_pop(v) + 1e-12)) AS mo,
  sqrt(var_pop(d2) / (var_pop(d1) + 1e-12)) / (sqrt(var_pop(d1) / (var_pop(v) + 1e-12)) + 1e-12) AS co, max(abs(v)) AS mx FROM f GROUP BY ALL)
SELECT rec, ep, count(*) * 12 AS n_features, {R('sum(m + s + sk + ku + r + p + zc + mo + co + mx) / 1000', 2)} AS total FROM g GROUP BY rec, ep""")
def time_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve features of each channel in one vector an epoch, channel after channel; its size and sum without the variances."""
    v = ep.time_vector(ep.epoch_rows(signals(spark, sf_dir)))
    total = F.aggregate(F.filter("x", lambda _, i: ~F.pmod(i, F.lit(12)).isin(7, 11)), F.lit(0.0), lambda a, y: a + y)
    return v.select("rec", "ep", F.size("x").cast("long").alias("n_features"), rounded(total / 1000, 2).alias("total"))
