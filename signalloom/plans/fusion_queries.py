"""Queries on scorer probabilities: votes, weights, disagreement, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.operators import evaluation as ev
from signalloom.operators import fusion as fu
from signalloom.plans.registry import query, rounded
from signalloom.sources.tables import PROBS, VECTORS, probabilities, vectors

R = lambda sql, k=4: f"(round({sql} + 1e-9, {k}) + 0)"
P = "WITH " + PROBS
BASE = "CASE agent WHEN 0 THEN 0.2::DOUBLE WHEN 1 THEN 0.3::DOUBLE ELSE 0.25::DOUBLE END"
VOTE = f", s AS (SELECT id, subject, y, c, round(sum({BASE} * p) / sum({BASE}) + 1e-9, 6) AS p FROM p GROUP BY ALL), v AS (SELECT id, subject, y, arg_min(c, (-p, c)) AS label, max(p) AS confidence FROM s GROUP BY ALL)"
LABELS = ", a AS (SELECT id, subject, y, agent, arg_min(c, (-p, c)) AS label FROM p GROUP BY ALL)"


def _soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = probabilities(spark, sf_dir)
    return fu.soft_vote(p, fu.lookup(fu.BASE, F.col("agent"), 0.25)).withColumn("p", rounded("p", 6))


def _voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fu.best(_soft(spark, sf_dir), ["id", "subject", "y"], "p")


@query(P + VOTE + f" SELECT id, y, label, {R('confidence')} AS confidence FROM v")
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voted(spark, sf_dir).select("id", "y", "label", rounded("confidence").alias("confidence"))


@query(P + ", q AS (SELECT id, y, agent, sum(p) AS q FROM p WHERE c > 0 GROUP BY ALL) SELECT id, y, (2 * sum((q >= 0.5)::INT) > count(*))::INT AS label FROM q GROUP BY ALL")
def hard_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fu.hard_vote(probabilities(spark, sf_dir))


@query(P + f" SELECT id, c, {R('avg(p)')} AS p FROM p GROUP BY ALL")
def soft_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fu.soft_vote(probabilities(spark, sf_dir), F.lit(1.0)).select("id", "c", rounded("p").alias("p"))


@query(P + f", sm AS (SELECT subject, agent, c, avg(p) AS p FROM p GROUP BY ALL) SELECT subject, c, {R(f'sum({BASE} * p) / sum({BASE})')} AS p FROM sm GROUP BY ALL")
def subject_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = probabilities(spark, sf_dir).groupBy("subject", "agent", "c").agg(F.avg("p").alias("p"))
    w = fu.lookup(fu.BASE, F.col("agent"), 0.25)
    return m.groupBy("subject", "c").agg(rounded(F.sum(w * F.col("p")) / F.sum(w)).alias("p"))


@query(P + LABELS + f""", c AS (SELECT agent, avg((label = y)::INT) AS acc FROM a GROUP BY agent), mg AS (SELECT agent, acc, greatest(acc - 0.33, 0) AS w FROM c),
n AS (SELECT agent, acc, CASE WHEN sum(w) OVER () > 0 THEN w / sum(w) OVER () ELSE 1 / count(*) OVER () END AS w FROM mg), h AS (SELECT agent, acc, least(greatest(w, 0.05), 0.6) AS w FROM n)
SELECT agent, {R('acc')} AS acc, {R('w / sum(w) OVER ()')} AS w FROM h""")
def accuracy_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = fu.best(probabilities(spark, sf_dir), ["id", "y", "agent"], "p")
    acc = labels.groupBy("agent").agg(F.avg((F.col("label") == F.col("y")).cast("int")).alias("acc"))
    return fu.accuracy_weights(acc, 0.33).select("agent", rounded("acc").alias("acc"), rounded("w").alias("w"))


SHAPE = LABELS + """, k AS (SELECT id, c, max(p) - min(p) AS s, avg(p) AS m, stddev_pop(p) AS d FROM p GROUP BY ALL),
h AS (SELECT id, max(s) AS max_diff, sum(-m * ln(m + 1e-10)) AS entropy, avg(d) AS std FROM k GROUP BY id),
l AS (SELECT id, label, count(*) AS n FROM a GROUP BY ALL), j AS (SELECT id, max(n) / sum(n) AS majority FROM l GROUP BY id)"""


@query(P + SHAPE + f" SELECT id, {R('max_diff')} AS max_diff, {R('entropy')} AS entropy, {R('majority')} AS majority, round(max_diff, 6) > 0.3 OR majority < 0.6 OR entropy > 1.099 AS disagree FROM h JOIN j USING (id)")
def disagreement_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fu.disagreement(probabilities(spark, sf_dir))
    return d.select("id", *(rounded(c).alias(c) for c in ("max_diff", "entropy", "majority")), "disagree")


@query(P + SHAPE + f""", q AS (SELECT id, majority AS agreement, std, entropy / ln(3) AS entropy, {R("0.5 * majority + 0.3 * greatest(0, 1 - 5 * std) + 0.2 * (1 - entropy / ln(3))")} AS score FROM h JOIN j USING (id))
SELECT id, {R('agreement')} AS agreement, {R('std')} AS std, {R('entropy')} AS entropy, score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS level, score < 0.6 AS review FROM q""")
def consistency_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fu.consistency(probabilities(spark, sf_dir))
    return c.select("id", *(rounded(x).alias(x) for x in ("agreement", "std", "entropy")), "score", "level", "review")


@query(P + VOTE + f" SELECT subject, c, {R('avg(p)')} AS mean, {R('max(p)')} AS max, {R('quantile_cont(p, 0.9)')} AS p90 FROM s GROUP BY ALL")
def subject_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.by_subject(_soft(spark, sf_dir)).select("subject", "c", *(rounded(x).alias(x) for x in ("mean", "max", "p90")))


@query(P + VOTE + " SELECT id, CASE WHEN p < 0.35 THEN 0 WHEN p > 0.65 THEN 2 ELSE 1 END AS band FROM s WHERE c = 2")
def borderline_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _soft(spark, sf_dir).where("c = 2").select("id", ev.borderline(F.col("p")).alias("band"))


@query(P + VOTE + ", o AS (SELECT id, list(p ORDER BY p DESC) AS q FROM s GROUP BY id) SELECT id, round(q[1] - q[2] + 1e-9, 5) AS margin, round(q[1] - q[2] + 1e-9, 5) < 0.1 AS suspicious FROM o")
def margin_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.sort_array(F.collect_list("p"), asc=False)
    m = _soft(spark, sf_dir).groupBy("id").agg(rounded(q[0] - q[1], 5).alias("margin"))
    return m.withColumn("suspicious", F.col("margin") < 0.1)


@query(P + VOTE + " SELECT y, label, count(*) AS n FROM v GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion(_voted(spark, sf_dir))


@query(P + VOTE + f""", t AS (SELECT y AS c, count(*) AS t, sum((y = label)::INT) AS tp FROM v GROUP BY y), l AS (SELECT label AS c, count(*) AS s FROM v GROUP BY label)
SELECT c, {R('coalesce(tp / nullif(s, 0), 0)')} AS precision, {R('tp / t')} AS recall, {R('2 * tp / (coalesce(s, 0) + t)')} AS f1 FROM t LEFT JOIN l USING (c)""")
def class_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.f1_by_class(_voted(spark, sf_dir)).select("c", *(rounded(x).alias(x) for x in ("precision", "recall", "f1")))


@query(P + f""", q AS (SELECT agent, c, y = c AS pos, p, rank() OVER (PARTITION BY agent, c ORDER BY p) + (count(*) OVER (PARTITION BY agent, c, p) - 1) / 2 AS r FROM p)
SELECT agent, c, {R("coalesce((sum(r) FILTER (pos) - sum(pos::INT) * (sum(pos::INT) + 1) / 2) / nullif(sum(pos::INT) * sum((NOT pos)::INT), 0), 0.5)")} AS auc FROM q GROUP BY ALL""")
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = probabilities(spark, sf_dir).select("agent", "c", (F.col("y") == F.col("c")).alias("pos"), F.col("p").alias("s"))
    return ev.auc(s, ["agent", "c"]).select("agent", "c", rounded("auc").alias("auc"))


@query(f"WITH n AS (SELECT label % 3 AS y, count(*) AS n FROM embeddings GROUP BY 1) SELECT y, n, {R('(1 / n) / sum(1 / n) OVER () * count(*) OVER ()')} AS weight FROM n")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = vectors(spark, sf_dir).where("pos = 0")
    return ev.class_weights(units).select("y", "n", rounded("weight").alias("weight"))


@query(P + LABELS + """, w AS (SELECT id, bool_or(agent = 1 AND label = y) AS f, bool_or(agent = 2 AND label = y) AS s FROM a GROUP BY id),
n AS (SELECT sum((f AND NOT s)::INT)::BIGINT AS b, sum((s AND NOT f)::INT)::BIGINT AS c FROM w),
t AS (SELECT b, c, unnest(range(0, least(b, c) + 1)) AS k FROM n)
SELECT b, c, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2)))) END + 1e-9, 6) AS p FROM t GROUP BY b, c""")
def mcnemar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = fu.best(probabilities(spark, sf_dir).where("agent in (1, 2)"), ["id", "y", "agent"], "p")
    right = F.col("label") == F.col("y")
    pairs = labels.groupBy("id").agg(F.max((F.col("agent") == 1) & right).alias("first"), F.max((F.col("agent") == 2) & right).alias("second"))
    return ev.mcnemar(pairs).select("b", "c", rounded("p", 6).alias("p"))


H = "((vec_id::HUGEINT % 4294967296) * 2654435761) % 4294967296"


@query(f"""WITH k AS (SELECT vec_id, label % 3 AS y, row_number() OVER (PARTITION BY label % 3 ORDER BY {H}, vec_id) - 1 AS k, count(*) OVER (PARTITION BY label % 3) AS n FROM embeddings)
SELECT vec_id AS id, y, CASE WHEN k < round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN k < round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM k""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.stratified_split(vectors(spark, sf_dir).where("pos = 0").select("id", "y"), "id", "y")


@query(f"SELECT vec_id AS id, label % 3 AS y, ((row_number() OVER (PARTITION BY label % 3 ORDER BY {H}, vec_id) - 1) % 5)::INT AS fold FROM embeddings")
def kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.kfold(vectors(spark, sf_dir).where("pos = 0").select("id", "y"), "id", "y")


BINS = f"WITH {VECTORS}, b AS (SELECT id, y, pos, ((10 * row_number() OVER (PARTITION BY pos ORDER BY x, id) - 1) // count(*) OVER (PARTITION BY pos))::INT AS bin FROM e)"


@query(BINS + " SELECT id, pos, bin FROM b")
def equal_freq_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.equal_bins(vectors(spark, sf_dir), ["pos"], "x", "id").select("id", "pos", "bin")


@query(BINS + f""", n AS (SELECT pos, bin, y, count(*)::DOUBLE AS n FROM b GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY pos) AS a, sum(n) OVER (PARTITION BY pos, bin) AS na, sum(n) OVER (PARTITION BY pos, y) AS nb FROM n)
SELECT pos, {R("sum(n / a * ln(n * a / (na * nb)))", 6)} AS mi FROM m GROUP BY pos""")
def feature_label_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ev.equal_bins(vectors(spark, sf_dir), ["pos"], "x", "id")
    return ev.mutual_information(b, ["pos"], "bin", "y").select("pos", rounded("mi", 6).alias("mi"))
