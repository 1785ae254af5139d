"""Which features weigh most in a vector, as rows and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def importances(vector: Column, top: int = 10) -> Column:
    """The ``top`` positions by share of the absolute sum, greatest first, ties by position; a null vector gives one zero."""
    held = F.coalesce(vector, F.array(F.lit(0.0)))
    total = F.aggregate(held, F.lit(0.0), lambda a, x: a + F.abs(x))
    shares = F.transform(held, lambda x, i: F.struct(F.when(total > 0, -F.abs(x) / total).otherwise(0.0).alias("s"), i.cast("int").alias("pos")))
    return F.transform(F.slice(F.array_sort(shares), 1, top), lambda r: F.struct(r["pos"].alias("pos"), (-r["s"]).alias("share")))


def explained(df: DataFrame, vector: str, label: str, names: list[str], top: int = 10, said: int = 3) -> DataFrame:
    """Adds ``importances`` and a sentence with the first ``said`` of them."""
    found = df.withColumn("importances", importances(F.col(vector), top))
    shown = F.transform(F.slice("importances", 1, said), lambda r: F.format_string("feature %d (%.1f%%)", r["pos"], r["share"] * 100))
    name = F.coalesce(F.try_element_at(F.array(*map(F.lit, names)), F.col(label) + 1), F.lit("unknown"))
    return found.withColumn("text", F.concat(F.lit("Judged "), name, F.lit(", mostly by "), F.array_join(shown, ", "), F.lit(".")))
