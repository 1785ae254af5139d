"""Scorers: Spark ML models that give long probability rows, and stacking on top of them."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Name to estimator; another scorer is added by adding its maker here.
MAKERS = {
    "forest": lambda: RandomForestClassifier(labelCol="y", featuresCol="v", weightCol="w", numTrees=20, maxDepth=5, seed=42),
    "logistic": lambda: LogisticRegression(labelCol="y", featuresCol="v", weightCol="w", regParam=1.0, maxIter=50),
}


def balanced(rows: DataFrame) -> DataFrame:
    """Rows with weight w, equal in sum for each class; the classes' counts are one small table."""
    n = rows.groupBy("y").agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    weights = n.crossJoin(F.broadcast(total)).select("y", (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("w"))
    return rows.join(F.broadcast(weights), "y")


def fit_and_score(train: DataFrame, rows: DataFrame, agent: str, keep: list[str]) -> DataFrame:
    """(keep, agent, c, p) of rows (y, x array) by a model fitted on balanced training rows."""
    model = MAKERS[agent]().fit(balanced(train.withColumn("v", array_to_vector("x")).withColumn("y", F.col("y").cast("double"))))
    scored = model.transform(rows.withColumn("v", array_to_vector("x")))
    return scored.select(*keep, F.lit(agent).alias("agent"), F.posexplode(vector_to_array("probability")).alias("c", "p"))


def stack(probs: DataFrame, train_ids: DataFrame, agents: list[str]) -> DataFrame:
    """A balanced logistic regression over the agents' abnormal probabilities of each subject: (subject, y, c, p)."""
    wide = probs.where("c > 0").groupBy("subject", "y", "id").pivot("agent", agents).agg(F.sum("p"))
    mean = wide.groupBy("subject").agg(F.max("y").cast("int").alias("y"), F.array(*(F.coalesce(F.avg(a), F.lit(0.0)) for a in agents)).alias("x"))
    rows = mean.withColumn("y", F.when(F.col("y") >= 1, 1).otherwise(0))
    return fit_and_score(rows.join(train_ids, "subject", "left_semi"), rows, "logistic", ["subject", "y"]).drop("agent")
