"""Signals, epochs and scorer probabilities from the driver's tables, in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalloom.session import read


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, ch, t, v, n): one supplier is a record, a return flag a channel, prices in shipping order its samples."""
    li = read(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_suppkey", "l_returnflag").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return li.select(
        F.col("l_suppkey").alias("rec"), F.col("l_returnflag").alias("ch"), (F.row_number().over(order) - 1).cast("long").alias("t"),
        F.col("l_extendedprice").alias("v"), F.count("*").over(W.partitionBy("l_suppkey", "l_returnflag")).alias("n"),
    )


SIGNALS = """r AS (SELECT l_suppkey AS rec, l_returnflag AS ch,
  row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS t,
  l_extendedprice AS v, count(*) OVER (PARTITION BY l_suppkey, l_returnflag) AS n FROM lineitem)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, subject, y, pos, x): one row a vector component."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 50).alias("subject"), (F.col("label") % 3).alias("y"), F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


VECTORS = """e AS (SELECT vec_id AS id, vec_id % 50 AS subject, label % 3 AS y, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)"""


def probabilities(spark: SparkSession, sf_dir: str, reverse: bool = False) -> DataFrame:
    """(id, subject, y, agent, c, p): four scorers, each a softmax of distances to class centroids in its own 16 components.

    ``reverse`` scores each scorer's components in reverse order, against the same centroids.
    """
    e = vectors(spark, sf_dir)
    # 3 classes x 64 components, whatever the table holds.
    centroids = F.broadcast(e.groupBy(F.col("y").alias("c"), "pos").agg(F.avg("x").alias("m")))
    if reverse:
        e = e.withColumn("pos", F.floor(F.col("pos") / 16) * 16 + 15 - F.col("pos") % 16)
    far = e.withColumn("agent", F.floor(F.col("pos") / 16).cast("int")).join(centroids, "pos").groupBy("id", "subject", "y", "agent", "c").agg(F.sum(F.pow(F.col("x") - F.col("m"), 2)).alias("d"))
    raw = F.exp(-32 * F.col("d"))
    return far.withColumn("p", F.round(raw / F.sum(raw).over(W.partitionBy("id", "agent")), 6)).drop("d")


_FAR = "{0} AS (SELECT id, subject, y, (pos // 16)::INT AS agent, c, sum(pow(x - m, 2)) AS d FROM {1} JOIN cen USING (pos) GROUP BY ALL)"
_SOFT = "{0} AS (SELECT id, subject, y, agent, c, round(exp(-32 * d) / sum(exp(-32 * d)) OVER (PARTITION BY id, agent), 6) AS p FROM {1})"
PROBS = ", ".join([VECTORS, "cen AS (SELECT y AS c, pos, avg(x) AS m FROM e GROUP BY 1, 2)", _FAR.format("d", "e"), _SOFT.format("p", "d")])
#: With the scores of reversed components (pr) and the second round (p2) beside the first (p).
PROBS2 = ", ".join([
    PROBS, "er AS (SELECT id, subject, y, (pos // 16) * 16 + 15 - pos % 16 AS pos, x FROM e)", _FAR.format("dr", "er"), _SOFT.format("pr", "dr"),
    "pt AS (SELECT p.*, greatest((p.p + pr.p) / 2, 1e-8) AS q FROM p JOIN pr USING (id, subject, y, agent, c))",
    "p2 AS (SELECT id, subject, y, agent, c, round(CASE WHEN agent = 0 THEN p ELSE q / sum(q) OVER (PARTITION BY id, agent) END + 1e-9, 6) AS p FROM pt)",
])
