"""Experiments whose fits never see the fold that they score: every fit is a difference of sums, keyed by the fold left out.

Sums of each fold are made once, in one aggregate; what a fit may see is the sum of all folds less its own. All folds and all variants of an
experiment are scored in the same job. Fits are small tables (folds x classes x features), whatever the rows.

Edge cases: a class without rows outside of a fold can't be chosen there; a feature that is constant there counts with deviation
one. Rows with a null label are scored and not fitted; rows with a null fold are seen by all fits and scored by none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.operators.evaluation import metrics


def outside(rows: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """(out, keys, sums): sums over all rows but those of fold ``out``, for every fold."""
    each = rows.groupBy("fold", *keys).agg(*(c.alias(n) for n, c in sums.items()))
    folds = each.where("fold is not null").select(F.col("fold").alias("out")).distinct()
    # One row a fold, key and fold left out: small tables both.
    seen = each.join(F.broadcast(folds), ~F.col("fold").eqNullSafe(F.col("out")))
    return seen.groupBy("out", *keys).agg(*(F.sum(n).alias(n) for n in sums))


def residuals(rows: DataFrame, covariate: str) -> DataFrame:
    """Rows (fold, pos, x, covariate) with x less its straight line on the covariate, fitted for each feature outside of the row's fold."""
    a, x = F.col(covariate).cast("double"), F.col("x")
    both = rows.where(a.isNotNull() & x.isNotNull())
    s = outside(both, ["pos"], {"n": F.count("*").cast("double"), "sa": F.sum(a), "sx": F.sum(x), "saa": F.sum(a * a), "sax": F.sum(a * x)})
    slope = F.coalesce(F.try_divide(F.col("n") * F.col("sax") - F.col("sa") * F.col("sx"), F.col("n") * F.col("saa") - F.col("sa") * F.col("sa")), F.lit(0.0))
    line = s.select(F.col("out").alias("fold"), "pos", slope.alias("_b"), (F.col("sx") / F.col("n")).alias("_mx"), (F.col("sa") / F.col("n")).alias("_ma"))
    fitted = rows.join(F.broadcast(line), ["fold", "pos"])
    return fitted.withColumn("x", x - F.coalesce(F.col("_mx") + F.col("_b") * (a - F.col("_ma")), F.lit(0.0))).drop("_b", "_mx", "_ma")


def distances(rows: DataFrame, block: Column) -> DataFrame:
    """(id, fold, y, c, block, d): squared standardised distance of rows (id, fold, y, pos, x) to each class's mean, summed over blocks of features."""
    x = F.col("x")
    known = rows.where("y is not null and x is not null")
    spread = outside(known, ["pos"], {"n": F.count("*").cast("double"), "s": F.sum(x), "q": F.sum(x * x)})
    var = F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)
    norms = spread.select("out", "pos", F.when(var > 1e-16, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(1.0).alias("_std"))
    means = outside(known, ["y", "pos"], {"n": F.count("*").cast("double"), "s": F.sum(x)}).select("out", "pos", F.col("y").alias("c"), (F.col("s") / F.col("n")).alias("_mean"))
    fits = F.broadcast(means.join(norms, ["out", "pos"]).withColumnRenamed("out", "fold"))
    far = rows.where("x is not null").join(fits, ["fold", "pos"])
    return far.groupBy("id", "fold", "y", "c", block.alias("block")).agg(F.sum(F.pow((x - F.col("_mean")) / F.col("_std"), 2)).alias("d"))


def block_drops(rows: DataFrame, block: Column, names: list[str]) -> DataFrame:
    """(variant, id, y, c, d): distances over all features, and without each block in turn."""
    by_block = distances(rows, block)
    all_ = by_block.groupBy("id", "fold", "y", "c").agg(F.sum("d").alias("all"), F.map_from_entries(F.collect_list(F.struct("block", "d"))).alias("own"))
    without = [F.struct(F.lit(f"no_{n}").alias("variant"), (F.col("all") - F.coalesce(F.try_element_at("own", F.lit(i)), F.lit(0.0))).alias("d")) for i, n in enumerate(names)]
    variants = F.inline(F.array(F.struct(F.lit("all").alias("variant"), F.col("all").alias("d")), *without))
    return all_.select("id", "y", "c", variants)


def nearest(scored: DataFrame, keys: list[str], places: int = 9) -> DataFrame:
    """(keys, id, y, label): the class of least distance, of like ones the lowest."""
    best = F.min(F.struct(F.round("d", places).alias("d"), "c"))
    return scored.groupBy(*keys, "id", "y").agg(best.alias("b")).select(*keys, "id", "y", F.col("b.c").alias("label"))


def drops_by_metric(pred: DataFrame, base: str = "all") -> DataFrame:
    """(variant, accuracy, macro_f1, drop): metrics of each variant and how much less accurate than the base it is."""
    found = metrics(pred.where("y is not null"), ["variant"])
    top = found.where(F.col("variant") == base).select(F.col("accuracy").alias("_base"))
    return found.join(F.broadcast(top)).select("variant", "accuracy", "macro_f1", (F.col("_base") - F.col("accuracy")).alias("drop"))


def agent_drops(probs: DataFrame, agents: list[int]) -> DataFrame:
    """(variant, id, y, label): votes of (id, fold, y, agent, c, p) by weights that the other folds' accuracies give, with all agents and without each in turn."""
    best = probs.groupBy("id", "fold", "y", "agent").agg(F.min(F.struct((-F.col("p")).alias("v"), "c")).alias("b"))
    right = outside(best.where("y is not null"), ["agent"], {"n": F.count("*").cast("double"), "ok": F.sum((F.col("b.c") == F.col("y")).cast("double"))})
    weight = right.select(F.col("out").alias("fold"), "agent", (F.col("ok") / F.col("n")).alias("w"))
    votes = probs.join(F.broadcast(weight), ["fold", "agent"])
    without = lambda a: F.sum(F.when(F.col("agent") != a, F.col("w") * F.col("p")).otherwise(0.0))
    sums = votes.groupBy("id", "y", "c").agg(F.sum(F.col("w") * F.col("p")).alias("all"), *(without(a).alias(f"no_{a}") for a in agents))
    names = ["all", *(f"no_{a}" for a in agents)]
    rows = sums.select("id", "y", "c", F.inline(F.array(*(F.struct(F.lit(n).alias("variant"), (-F.col(n)).alias("d")) for n in names))))
    return nearest(rows, ["variant"])
