"""Connected components of an edge table by label propagation with pointer jumping; nothing goes to the driver but a count per round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.session import cut

#: A side with at most so many rows (two longs each, under 64 MB) may be broadcast; larger ones are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """The table with a broadcast hint if a count proves it small; pass a table that is cheap to count."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of an edge (a, b): root is the least id of its component.

    Self-loops, repeated edges and either direction are fine; an edge with a null end is ignored; no edges give
    no rows. Each round takes the least label around each vertex, then the label of that label, so chains
    shorten geometrically. A vertex with very many edges is aggregated before the shuffle.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(F.inline(ways)).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")))
    while True:
        seen = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(seen, labels["id"] == seen["a"]).select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("id").alias("via"), F.col("root").alias("far"))
        new = cut(step.join(jump, step["root"] == jump["via"], "left").select("id", "old", F.least("root", "far").alias("root")))
        labels = new.select("id", "root")
        if new.where(F.col("old") != F.col("root")).isEmpty():
            return labels


def at_least(part: Column, whole: Column, percent: int) -> Column:
    """Whether part / whole reaches a percentage, in whole numbers."""
    return part * 100 >= whole * percent
