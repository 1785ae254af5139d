"""A case report in Markdown from a decision table; a report is made for one subject, so its rows are few."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features that a report names.
TOP = 5


def first_case(decisions: DataFrame, label: int) -> DataFrame:
    """(subject,) of the first subject whose label it is."""
    return decisions.where(F.col("label") == label).groupBy("subject").agg(F.min("id").alias("id")).orderBy("id").limit(1).select("subject")


def counters(rows: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """(keys, value, n): the ``k`` commonest values of each key, the lowest of those that tie."""
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    top = n.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))), 1, k).alias("t"))
    return top.select(*keys, F.inline("t")).select(*keys, F.col("v").alias(value), (-F.col("n")).alias("n"))


def markdown(decisions: DataFrame, features: DataFrame, subject: int, names: list[str]) -> str:
    """The report of a subject, from (id, subject, label, confidence, arbitrated) and (id, subject, pos)."""
    own = decisions.where(F.col("subject") == subject)
    votes = counters(own, [], "label", len(names)).collect()
    mean = own.agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.sum(F.col("arbitrated").cast("int")).alias("a")).first()
    top = counters(features.where(F.col("subject") == subject), [], "pos", TOP).collect()
    lines = [f"# Subject {subject}", "", f"Epochs: {mean.n}, arbitrated: {mean.a or 0}, mean confidence: {mean.c or 0.0:.3f}", "", "| class | epochs |", "|-|-|"]
    lines += [f"| {names[r.label]} | {r.n} |" for r in votes]
    lines += ["", "Features that weighed most often: " + ", ".join(f"{r.pos} ({r.n})" for r in top) + "."]
    return "\n".join(lines) + "\n"
