"""Ranks of any number of rows within keys of any size, without a task that holds a key.

Rows are dealt to ranges of (keys, order) whose bounds Spark samples from the data, and are sorted there. A row's rank is its place in
its range plus the rows of its key in the ranges before, which a small table of (key, range) tells. A key of any size spreads over
as many ranges as it needs; ties are split too, so ``order`` should end with what tells rows apart.

Edge cases: null keys are a key of their own, nulls in the order come first. Rows that tie in all of the order have different ranks, in
an order of no meaning. The rows are written once to the shared folder, as both the ranks and the table of ranges are read from them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalloom.session import cut


def ranked(rows: DataFrame, keys: list[str], order: list[Column | str], rank: str = "rank", size: str = "size") -> DataFrame:
    """rows with ``rank``, from 0, of each among those of its keys in rising order, and ``size``, how many those are."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k) for k in keys] + [F.col(c) if isinstance(c, str) else c for c in order]
    named = [c.alias(f"_o{i}") for i, c in enumerate(by)]
    sort = [f"_o{i}" for i in range(len(by))]
    dealt = rows.select("*", *named).repartitionByRange(n, *sort).sortWithinPartitions(*sort).drop(*sort)
    # The upper bits of the number are the range, the lower ones the place in it.
    placed = cut(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)))
    ranges = placed.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # As many rows of a key as it has ranges, not as it has rows.
    own = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("_n").over(own.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    small = ranges.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), "_first", before.alias("_before"), F.sum("_n").over(own).alias("_size"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_range") == F.col("_r"))
    found = placed.join(small, same)
    return found.select(*(f"`{c}`" for c in rows.columns), (F.col("_at") - F.col("_first") + F.col("_before")).alias(rank), F.col("_size").alias(size))


def evenly(rows: DataFrame, keys: list[str], order: list[Column | str], most: int) -> DataFrame:
    """At most ``most`` rows of each key, evenly spaced in their order, with their place ``k`` among those."""
    placed = ranked(rows, keys, order, "_i", "_m")
    k = F.when(F.col("_m") <= most, F.col("_i")).otherwise(F.ceil(F.col("_i") * (most - 1) / F.greatest(F.col("_m") - 1, F.lit(1)))).cast("long")
    # The place k whose evenly spaced rank is this row's, where there is one.
    fits = (F.col("_m") <= most) | (F.floor(F.col("k") * (F.col("_m") - 1) / max(most - 1, 1)) == F.col("_i"))
    return placed.withColumn("k", k).where(fits & (F.col("k") < most)).drop("_i", "_m")
