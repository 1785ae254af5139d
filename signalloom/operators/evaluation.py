"""Subject aggregation, metrics, significance, thresholds and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalloom.operators.ranking import ranked


def by_subject(probs: DataFrame) -> DataFrame:
    """Mean, greatest and 90th percentile of each subject's class probabilities."""
    return probs.groupBy("subject", "c").agg(F.avg("p").alias("mean"), F.max("p").alias("max"), F.percentile("p", F.lit(0.9)).alias("p90"))


def borderline(p: Column, low: float = 0.35, high: float = 0.65) -> Column:
    """0 under ``low``, 2 over ``high``, 1 within."""
    return F.when(p < low, 0).when(p > high, 2).otherwise(1)


def confusion(pred: DataFrame) -> DataFrame:
    return pred.groupBy("y", "label").agg(F.count("*").alias("n"))


def f1_by_class(pred: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each true class; zero where undefined."""
    n = confusion(pred)
    true = n.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("y") == F.col("label"), F.col("n")).otherwise(0)).alias("tp"))
    said = n.groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("s"))
    both = true.join(said, "c", "left").withColumn("s", F.coalesce("s", F.lit(0)))
    return both.select("c", (F.coalesce(F.try_divide("tp", "s"), F.lit(0.0))).alias("precision"), (F.col("tp") / F.col("t")).alias("recall"), (2 * F.col("tp") / (F.col("s") + F.col("t"))).alias("f1"))


def auc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Rank-sum AUC of (keys, pos, s) with mid-ranks for ties; 0.5 where a class is empty. Ties are summed before ranking."""
    ties = scored.groupBy(*keys, "s").agg(F.count("*").alias("_n"), F.sum(F.col("pos").cast("long")).alias("_p"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = ties.withColumn("_mid", before + (F.col("_n") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("_p") * F.col("_mid")).alias("_r"), F.sum("_p").alias("_np"), (F.sum("_n") - F.sum("_p")).alias("_nn"))
    area = F.try_divide(F.col("_r") - F.col("_np") * (F.col("_np") + 1) / 2, F.col("_np") * F.col("_nn"))
    return sums.select(*keys, F.coalesce(area, F.lit(0.5)).alias("auc"))


def mcnemar(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts b (only the first right) and c (only the second) of (keys, first, second) and the exact two-sided p; 1 for b + c = 0."""
    count = lambda c: F.coalesce(F.sum(F.expr(f"int({c})")), F.lit(0)).cast("long")
    n = pairs.groupBy(*(keys or [])).agg(count("first and not second").alias("b"), count("second and not first").alias("c"))
    terms = F.transform(F.sequence(F.lit(0).cast("long"), F.least("b", "c")), lambda k: _log_choose(F.col("b") + F.col("c"), k) - (F.col("b") + F.col("c")) * F.log(F.lit(2.0)))
    tail = F.aggregate(F.transform(terms, F.exp), F.lit(0.0), lambda a, x: a + x)
    return n.withColumn("p", F.when(F.col("b") + F.col("c") == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)))


def _log_choose(n: Column, k: Column) -> Column:
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)))
    return F.when(k == 0, 0.0).otherwise(F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.log((n - k + i).cast("double")) - F.log(i.cast("double"))))


def class_weights(labels: DataFrame) -> DataFrame:
    """Inverse frequency weights of classes, brought to mean one."""
    n = labels.groupBy("y").agg(F.count("*").alias("n"))
    inv = 1 / F.col("n")
    return n.withColumn("weight", inv / F.sum(inv).over(W.partitionBy(F.lit(1))) * F.count("*").over(W.partitionBy(F.lit(1))))


def hashed(key: Column) -> Column:
    """A multiplicative hash that any SQL engine computes alike."""
    # Halves of 16 bits keep the product within a long, whatever the key.
    low = F.pmod(key, F.lit(1 << 32)).cast("long")
    high = F.shiftright(low, 16) * F.lit(2654435761) % F.lit(1 << 16) * F.lit(1 << 16)
    return (high + low.bitwiseAND(F.lit(0xFFFF)) * F.lit(2654435761)) % F.lit(1 << 32)


def stratified_split(units: DataFrame, key: str, stratum: str) -> DataFrame:
    """70/15/15 by hash order within each stratum, bounds rounded half to even."""
    placed = ranked(units, [stratum], [hashed(F.col(key)), key], "_k", "_n")
    a, b = F.bround(F.col("_n") * 0.7, 0), F.bround(F.col("_n") * 0.15, 0)
    return placed.withColumn("split", F.when(F.col("_k") < a, "train").when(F.col("_k") < a + b, "val").otherwise("test")).drop("_k", "_n")


def kfold(units: DataFrame, key: str, stratum: str, folds: int = 5) -> DataFrame:
    """Folds in turn, by hash order within each stratum."""
    placed = ranked(units, [stratum], [hashed(F.col(key)), key], "_k", "_n")
    return placed.withColumn("fold", (F.col("_k") % folds).cast("int")).drop("_k", "_n")


def equal_bins(values: DataFrame, keys: list[str], value: str, order: str, bins: int = 10) -> DataFrame:
    """Equal-frequency bin of each value among its keys, ties by ``order``."""
    placed = ranked(values, keys, [value, order], "_k", "_n")
    return placed.withColumn("bin", F.floor((bins * (F.col("_k") + 1) - 1) / F.col("_n")).cast("int")).drop("_k", "_n")


def mutual_information(binned: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Mutual information of two codes in nats, from one count table of the pairs."""
    n = binned.groupBy(*keys, a, b).agg(F.count("*").cast("double").alias("n"))
    w = lambda *more: F.sum("n").over(W.partitionBy(*keys, *more))
    part = n.withColumn("all", w()).withColumn("na", w(a)).withColumn("nb", w(b))
    return part.groupBy(*keys).agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))).alias("mi"))


def majority_label(pred: DataFrame, keys: list[str]) -> DataFrame:
    """The commonest label of each key, the lowest of those that tie."""
    n = pred.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select(*keys, F.col("b.label").alias("label"))


def majority_baseline(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the commonest true class."""
    return pred.groupBy(*keys, "y").agg(F.count("*").alias("n")).groupBy(*keys).agg((F.max("n") / F.sum("n")).alias("baseline"))


def metrics(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, precision, recall and F1 weighted by support and F1 averaged over the classes in use, from (keys, y, label)."""
    n = pred.groupBy(*keys, "y", "label").agg(F.count("*").alias("n"))
    ends = F.inline(F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("s")), F.struct(F.col("label").alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("s"))))
    hit = F.when(F.col("y") == F.col("label"), F.col("n")).otherwise(0)
    right = n.groupBy(*keys, F.col("y").alias("c")).agg(F.sum(hit).alias("tp"))
    sums = n.select(*keys, ends).groupBy(*keys, "c").agg(F.sum("t").alias("t"), F.sum("s").alias("s")).join(right, [*keys, "c"], "left")
    tp = F.coalesce("tp", F.lit(0))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    by_class = sums.select(*keys, "t", "tp", zero(tp, F.col("s")).alias("p"), zero(tp, F.col("t")).alias("r"), zero(2 * tp, F.col("s") + F.col("t")).alias("f"))
    mean = lambda c: F.sum(F.col("t") * F.col(c)) / F.sum("t")
    return by_class.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("t")).alias("accuracy"), mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1"), F.avg("f").alias("macro_f1")
    )


def ovr_auc(probs: DataFrame, keys: list[str]) -> DataFrame:
    """One-against-rest AUC of (keys, id, y, c, p), weighted by the classes' rows; null unless each class has rows."""
    marked = probs.select(*keys, "c", (F.col("y") == F.col("c")).alias("pos"), F.col("p").alias("s"))
    n = marked.where("pos").groupBy(*keys, "c").agg(F.count("*").alias("n"))
    each = auc(marked, [*keys, "c"]).join(n, [*keys, "c"], "left")
    return each.groupBy(*keys).agg(F.when(F.count("n") == F.count("*"), F.sum(F.col("auc") * F.col("n")) / F.sum("n")).alias("auc"))


def by_subject_label(votes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, subject, y, label): each subject's mean probabilities' best class, and the true class of its first epoch."""
    mean = votes.groupBy(*keys, "subject", "c").agg(F.round(F.avg("p") + 1e-9, 6).alias("p"), F.min(F.struct("id", "y")).alias("f"))
    best = mean.groupBy(*keys, "subject").agg(F.min(F.struct((-F.col("p")).alias("v"), "c")).alias("b"), F.min("f").alias("f"))
    return best.select(*keys, "subject", F.col("f.y").alias("y"), F.col("b.c").alias("label"))


def grid_cells(shape: DataFrame, first: DataFrame, second: DataFrame, spreads: list[float], majorities: list[float], entropies: list[float]) -> DataFrame:
    """Epochs summed to how many limits of each kind they pass: (subject, i, m, j, c, n, first, second, ok1, ok2, y).

    An epoch passes a limit on the spread or the entropy if it is over it, one on the majority if under it. The sums
    are as many as there are subjects and combinations in use, so the settings meet these, not the epochs.
    """
    over = lambda c, limits: sum((F.col(c) > x).cast("int") for x in limits)
    under = sum((F.col("majority") < x).cast("int") for x in majorities)
    place = shape.select("id", over("max_diff", spreads).alias("i"), under.alias("m"), over("entropy", entropies).alias("j"))
    right = lambda df: df.groupBy("id").agg(F.min(F.struct((-F.col("p")).alias("v"), "c")).alias("b")).select("id", F.col("b.c").alias("l"))
    both = first.join(second.select("id", "c", F.col("p").alias("p2")), ["id", "c"]).join(place, "id")
    both = both.join(right(first).withColumnRenamed("l", "l1"), "id").join(right(second).withColumnRenamed("l", "l2"), "id")
    ok = lambda c: F.sum((F.col(c) == F.col("y")).cast("long"))
    return both.groupBy("subject", "i", "m", "j", "c").agg(F.count("*").alias("n"), F.sum("p").alias("first"), F.sum("p2").alias("second"), ok("l1").alias("ok1"), ok("l2").alias("ok2"), F.min(F.struct("id", "y")).alias("f"))


def threshold_grid(cells: DataFrame, spreads: list[float], majorities: list[float], entropies: list[float], most_rate: float = 0.5) -> DataFrame:
    """(t1, t2, t3, rate, epoch_acc, subject_acc) of every setting that triggers at most ``most_rate`` of the epochs.

    The settings are a table of fixed size; limits rise within each list.
    """
    spark = cells.sparkSession
    settings = [(a, b, c, i, j, k) for i, a in enumerate(spreads) for j, b in enumerate(majorities) for k, c in enumerate(entropies)]
    grid = spark.createDataFrame(settings, "t1 double, t2 double, t3 double, _i int, _m int, _j int")
    # Passing limit number k of rising ones means passing more than k of them; of majorities, all from k on.
    hit = (F.col("i") > F.col("_i")) | (F.lit(len(majorities)) - F.col("_m") <= F.col("m")) | (F.col("j") > F.col("_j"))
    keys = ["t1", "t2", "t3"]
    pick = lambda a, b: F.sum(F.when(hit, F.col(a)).otherwise(F.col(b)))
    by_class = cells.crossJoin(F.broadcast(grid)).groupBy(*keys, "subject", "c").agg(
        pick("second", "first").alias("p"), pick("ok2", "ok1").alias("ok"), F.sum("n").alias("n"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("h"), F.min("f").alias("f")
    )
    mean = F.round(F.col("p") / F.col("n") + 1e-9, 6)
    by_subject = by_class.groupBy(*keys, "subject").agg(F.min(F.struct((-mean).alias("v"), "c")).alias("b"), F.max("ok").alias("ok"), F.max("n").alias("n"), F.max("h").alias("h"), F.min("f").alias("f"))
    found = by_subject.groupBy(*keys).agg((F.sum("h") / F.sum("n")).alias("rate"), (F.sum("ok") / F.sum("n")).alias("epoch_acc"), F.avg((F.col("b.c") == F.col("f.y")).cast("int")).alias("subject_acc"))
    return found.where(F.col("rate") <= most_rate).select(*keys, *(F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("rate", "epoch_acc", "subject_acc")))


def recommended(grid: DataFrame, slack: float = 0.005) -> DataFrame:
    """The settings of the least rate among those within ``slack`` of the best accuracy; the grid has a fixed number of rows."""
    near = grid.crossJoin(F.broadcast(grid.agg(F.max("subject_acc").alias("_best")))).where(F.round(F.col("_best") - F.col("subject_acc"), 6) <= slack)
    return near.drop("_best").orderBy("rate", F.desc("subject_acc"), "t2", "t1", "t3").limit(1)


def frontier(grid: DataFrame) -> DataFrame:
    """Settings more accurate than all of smaller rates; of one rate the most accurate, then the lowest limits."""
    order = W.orderBy("rate", F.desc("subject_acc"), "t2", "t1", "t3")
    before = F.max("subject_acc").over(order.rowsBetween(W.unboundedPreceding, -1))
    return grid.withColumn("_best", F.coalesce(before, F.lit(-1.0))).where("subject_acc > _best").drop("_best")


def feature_aucs(values: DataFrame, feature: str) -> DataFrame:
    """(feature, auc, dev): AUC of each feature for (pos, s), and how far it lies from a half."""
    return auc(values, [feature]).withColumn("dev", F.abs(F.col("auc") - 0.5))


def quantiles(rows: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """(metric, q, value): exact quantiles of a column."""
    found = rows.agg(F.percentile(column, F.array(*map(F.lit, shares))).alias("v"))
    return found.select(F.lit(column).alias("metric"), F.inline(F.arrays_zip(F.array(*map(F.lit, shares)).alias("q"), F.col("v").alias("value"))))


def margins(pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, accuracy, macro_f1, baseline, margin) of groups of subjects."""
    found = metrics(pred, keys).join(majority_baseline(pred, keys), keys).join(pred.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    return found.select(*keys, "n", "accuracy", "macro_f1", "baseline", (F.col("accuracy") - F.col("baseline")).alias("margin"))


def verdict(margins_by_source: DataFrame) -> DataFrame:
    """(diff, verdict): the mean margin of the project's labels less that of the others; over 0.05 these are unreliable, over 0.02 weaker."""
    mean = lambda s: F.avg(F.when(F.col("source") == s, F.col("margin")))
    found = margins_by_source.agg((mean("project") - mean("raw_index")).alias("diff"))
    return found.withColumn("verdict", F.when(F.col("diff") > 0.05, "unreliable").when(F.col("diff") > 0.02, "weaker").otherwise("alike"))


def sampled(units: DataFrame, key: str, strata: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each stratum, by the hash of their keys."""
    return ranked(units, strata, [hashed(F.col(key)), key], "_k", "_n").where(F.col("_k") < most).drop("_k", "_n")


def binary(probs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p0, p1, y): the first class against all others."""
    share = lambda c: F.coalesce(F.sum(F.when(c, F.col("p"))), F.lit(0.0))
    return probs.groupBy(*keys).agg(share(F.col("c") == 0).alias("p0"), share(F.col("c") > 0).alias("p1"), (F.max("y") >= 1).cast("int").alias("y"))
