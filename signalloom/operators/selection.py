"""Feature selection by least redundancy and greatest relevance; the tables of mutual information come from Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.operators.evaluation import equal_bins, mutual_information

#: The greedy search runs on the driver over at most this many features (a matrix of features, not of rows).
MOST_FEATURES = 4096


def pair_information(binned: DataFrame, row: str, feature: str, code: str, chosen: list[int]) -> DataFrame:
    """Mutual information of every feature with each chosen one: a join on the row with the few chosen features."""
    own = binned.where(F.col(feature).isin(chosen)).select(row, F.col(feature).alias("_other"), F.col(code).alias("_code"))
    return mutual_information(binned.join(own, row), [feature, "_other"], code, "_code").withColumnRenamed("_other", "other")


def mrmr(binned: DataFrame, row: str, feature: str, code: str, label: str, k: int, quotient: bool = False) -> list[int]:
    """``k`` features, in order of choice: greatest information on the label less the mean with those chosen, or over it; ties lowest first.

    Each step counts only pairs with the feature chosen last, so k passes over the binned table are made. Tables of
    more than MOST_FEATURES features are refused.
    """
    found = mutual_information(binned, [feature], code, label).limit(MOST_FEATURES + 1).collect()
    if len(found) > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features")
    relevance = {r[feature]: round(r.mi, 9) for r in found}
    shared = dict.fromkeys(relevance, 0.0)
    chosen: list[int] = []

    def score(f: int) -> float:
        mean = shared[f] / len(chosen) if chosen else 0.0
        return round(relevance[f] / (mean + 1e-6) if quotient and chosen else relevance[f] - mean, 9)

    while len(chosen) < min(k, len(relevance)):
        chosen.append(min((f for f in relevance if f not in chosen), key=lambda f: (-score(f), f)))
        if len(chosen) < k:
            for r in pair_information(binned, row, feature, code, chosen[-1:]).collect():
                shared[r[feature]] += round(r.mi, 9)
    return chosen


class Fusion:
    """Standardised features cut to the chosen ones: fitted on long rows (row, feature, value, label), kept as a small table."""

    def __init__(self, table: DataFrame, n_input: int):
        #: (feature, mean, std, place): place is null for features that aren't chosen.
        self.table, self.n_input = table, n_input

    @classmethod
    def fit(cls, values: DataFrame, row: str, feature: str, value: str, label: str, k: int, bins: int = 10, quotient: bool = False) -> Fusion:
        spark = values.sparkSession
        std = F.stddev_pop(value)
        stats = values.groupBy(feature).agg(F.avg(value).alias("mean"), F.when(std < 1e-8, 1.0).otherwise(std).alias("std"))
        chosen = mrmr(equal_bins(values, [feature], value, row, bins), row, feature, "bin", label, k, quotient)
        places = spark.createDataFrame([(f, i) for i, f in enumerate(chosen)], f"`{feature}` {dict(values.dtypes)[feature]}, place int")
        table = stats.join(F.broadcast(places), feature, "left")
        return cls(table, table.count())

    def transform(self, values: DataFrame, row: str, feature: str, value: str) -> DataFrame:
        """(row, feature, place, z) of the chosen features; a table with other features than fitted is refused."""
        known = values.select(feature).distinct().join(self.table.select(feature), feature, "full")
        if known.count() != self.n_input or values.select(feature).distinct().count() != self.n_input:
            raise ValueError(f"{self.n_input} features were fitted")
        chosen = self.table.where("place is not null")
        return values.join(F.broadcast(chosen), feature).select(row, feature, "place", ((F.col(value) - F.col("mean")) / F.col("std")).alias("z"))

    def save(self, path: str) -> None:
        self.table.write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Fusion:
        table = spark.read.parquet(path)
        return cls(table, table.count())


def without_block(vector: Column, start: int, size: int) -> Column:
    """An array without ``size`` entries from ``start`` (0 is the first)."""
    return F.filter(vector, lambda _, i: (i < start) | (i >= start + size))


def fixed_size(vector: Column, size: int) -> Column:
    """An array cut to ``size`` entries or filled up with zeros."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0), size)), 1, size)
