"""Ranks by ranges against window functions, on a key that holds most rows."""

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalloom.operators import epochs, ranking


def table(spark, n=20_000):
    # Nine of ten rows are of one key, half of its values tie, some keys and values are null.
    k = F.when(F.col("id") % 10 < 9, "hot").when(F.col("id") % 100 < 50, F.concat(F.lit("k"), (F.col("id") % 7).cast("string")))
    return spark.range(n).select("id", k.alias("k"), F.when(F.col("id") % 11 > 0, F.when(F.col("id") % 2 == 0, 0.5).otherwise(F.rand(3))).alias("v"), F.lit("x").alias("a.b")).repartition(5)


def test_ranks_equal_windows(spark):
    rows = table(spark).cache()
    w = W.partitionBy("k")
    want = {r.id: (r.r, r.n) for r in rows.select("id", (F.row_number().over(w.orderBy("v", "id")) - 1).alias("r"), F.count("*").over(w).alias("n")).collect()}
    got = ranking.ranked(rows, ["k"], ["v", "id"])
    assert got.columns == [*rows.columns, "rank", "size"]
    assert {r.id: (r["rank"], r["size"]) for r in got.collect()} == want
    plain = ranking.ranked(rows, [], [-F.col("id")], "i", "m")
    assert plain.where("i <> 19999 - id or m <> 20000").count() == 0
    assert ranking.ranked(rows.limit(0), ["k"], ["id"]).count() == 0


def test_a_hot_key_spreads_over_tasks(spark):
    kept = {}

    def seen(df):
        kept["rows"] = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
        return df.checkpoint()

    was, ranking.cut = ranking.cut, seen
    try:
        ranking.ranked(table(spark), ["k"], ["v", "id"]).count()
    finally:
        ranking.cut = was
    sizes = [r["count"] for r in kept["rows"]]
    assert len(sizes) >= 4 and max(sizes) <= 2 * np.median(sizes)


def test_even_samples_equal_those_by_record(spark):
    rows = spark.range(400).select((F.col("id") % 3).alias("rec"), F.col("id").alias("ep"))
    few = rows.unionByName(spark.createDataFrame([(9, 1), (9, 2)], "rec long, ep long"))
    for most in (1, 2, 7, 500):
        got = ranking.evenly(few, ["rec"], ["ep"], most)
        assert sorted(map(tuple, got.select("rec", "ep").collect())) == sorted({(r, e[j]) for r in (0, 1, 2, 9) for e in [[x.ep for x in few.where(f"rec = {r}").orderBy("ep").collect()]] for j in (range(len(e)) if len(e) <= most else np.linspace(0, len(e) - 1, most).astype(int))})
        if most > 1:
            assert sorted(map(tuple, got.select("rec", "ep", "k").collect())) == sorted(map(tuple, epochs.uniform_sample(few, most).select("rec", "ep", "k").collect()))
