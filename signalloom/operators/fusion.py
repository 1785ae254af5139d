"""Voting, weights, disagreement and arbitration on long probabilities (id, subject, y, agent, c, p)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Base weights by agent number (fixed values).
BASE = {0: 0.20, 1: 0.30, 2: 0.25, 3: 0.25}
#: How well each agent suits a level of quality (fixed values); agents not named here 0.9, levels not named as medium.
FITS = {"high": {0: 0.80, 1: 1.00, 2: 0.90, 3: 1.00}, "medium": {0: 1.00, 1: 1.00, 2: 1.00, 3: 1.00}, "low": {0: 1.00, 1: 0.80, 2: 0.80, 3: 0.70}}
#: Shares of consensus, gain and fit in a credibility, and the gain that counts fully (fixed values).
CONSENSUS, GAIN, FIT, GAIN_RANGE = 0.40, 0.35, 0.25, 0.05
LOW, HIGH = 0.05, 0.60


def lookup(table: dict[int, float], key: Column, default: float) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for x in chain(*table.items())))[key], F.lit(default))


def best(of: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The class with the greatest value; the lowest class of those that tie."""
    # One pass: the least of (-value, class) carries the class along.
    return of.groupBy(*keys).agg(F.min(F.struct((-F.col(value)).alias("v"), F.col("c").alias("c"))).alias("b")).select(*keys, F.col("b.c").alias("label"), (-F.col("b.v")).alias("confidence"))


def soft_vote(probs: DataFrame, weight: Column) -> DataFrame:
    """Weighted mean probability of each class."""
    return probs.withColumn("w", weight).groupBy("id", "subject", "y", "c").agg((F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("p"))


def hard_vote(probs: DataFrame) -> DataFrame:
    """1 where strictly more than half of the agents give the abnormal classes half or more."""
    votes = probs.where("c > 0").groupBy("id", "y", "agent").agg(F.sum("p").alias("q"))
    return votes.groupBy("id", "y").agg((2 * F.sum((F.col("q") >= 0.5).cast("int")) > F.count("*")).cast("int").alias("label"))


def normalise(w: Column, part: W) -> Column:
    """Shares of the sum; equal shares where the sum isn't positive."""
    total = F.sum(w).over(part)
    return F.when(total > 0, w / total).otherwise(1 / F.count("*").over(part))


def clamped(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Normalised, held within the bounds, and normalised once more (which may leave the bounds)."""
    part = W.partitionBy(*keys)
    held = df.withColumn(column, F.least(F.greatest(normalise(F.col(column), part), F.lit(LOW)), F.lit(HIGH)))
    return held.withColumn(column, normalise(F.col(column), part))


def accuracy_weights(accuracy: DataFrame, floor: float) -> DataFrame:
    """Accuracies (agent, acc) with weights w: margins over a floor, equal where none is above it; one row an agent."""
    margin = F.greatest(F.col("acc") - floor, F.lit(0.0))
    return clamped(accuracy.withColumn("w", margin).withColumn("_all", F.lit(1)), "w", ["_all"]).drop("_all")


def disagreement(probs: DataFrame, spread: float = 0.30, majority: float = 0.6, entropy: float = 1.099) -> DataFrame:
    """Greatest spread of a class, share of the commonest label, entropy of the mean, and whether any crosses its limit."""
    by_class = probs.groupBy("id", "c").agg((F.max("p") - F.min("p")).alias("s"), F.avg("p").alias("m"))
    shape = by_class.groupBy("id").agg(F.max("s").alias("max_diff"), F.sum(-F.col("m") * F.log(F.col("m") + 1e-10)).alias("entropy"))
    labels = best(probs, ["id", "agent"], "p").groupBy("id", "label").count()
    share = labels.groupBy("id").agg((F.max("count") / F.sum("count")).alias("majority"))
    flag = (F.round("max_diff", 6) > spread) | (F.col("majority") < majority) | (F.col("entropy") > entropy)
    return shape.join(share, "id").withColumn("disagree", flag)


def consistency(probs: DataFrame) -> DataFrame:
    """Agreement, mean deviation of the classes, normalised entropy and their score and level."""
    by_class = probs.groupBy("id", "c").agg(F.stddev_pop("p").alias("s"), F.avg("p").alias("m"))
    shape = by_class.groupBy("id").agg(F.avg("s").alias("std"), (F.sum(-F.col("m") * F.log(F.col("m") + 1e-10)) / F.log(F.count("*").cast("double"))).alias("entropy"))
    labels = best(probs, ["id", "agent"], "p").groupBy("id", "label").count()
    agree = labels.groupBy("id").agg((F.max("count") / F.sum("count")).alias("agreement"))
    score = 0.5 * F.col("agreement") + 0.3 * F.greatest(F.lit(0.0), 1 - 5 * F.col("std")) + 0.2 * (1 - F.col("entropy"))
    level = F.when(F.col("score") >= 0.8, "high").when(F.col("score") >= 0.6, "medium").otherwise("low")
    return shape.join(agree, "id").withColumn("score", F.round(score + 1e-9, 4)).withColumn("level", level).withColumn("review", F.col("score") < 0.6)


def fit(level: Column, agent: Column) -> Column:
    """How well an agent suits a level of quality."""
    of = {name: lookup(table, agent, 0.9) for name, table in FITS.items()}
    return F.when(level == "high", of["high"]).when(level == "low", of["low"]).otherwise(of["medium"])


def second_opinion(first: DataFrame, reversed_: DataFrame, base_agent: int = 0) -> DataFrame:
    """Probabilities of a second round: means of those of a sample and of its reversal, at least 1e-8, brought to sum one.

    The feature model (``base_agent``) has no use for a reversal and keeps its first answer.
    """
    other = reversed_.select("id", "agent", "c", F.col("p").alias("_p"))
    mean = F.greatest((F.col("p") + F.col("_p")) / 2, F.lit(1e-8))
    both = first.join(other, ["id", "agent", "c"]).withColumn("_q", mean)
    shared = F.col("_q") / F.sum("_q").over(W.partitionBy("id", "agent"))
    return both.withColumn("p", F.round(F.when(F.col("agent") == base_agent, F.col("p")).otherwise(shared) + 1e-9, 6)).drop("_p", "_q")


def credibility(second: DataFrame, first: DataFrame, levels: DataFrame) -> DataFrame:
    """(id, agent, cos, gain, fit, cred) from the probabilities of two rounds and (id, level).

    ``cos``: of an agent's second probabilities with their mean over agents; ``gain``: by how much its confidence grew.
    """
    m = second.withColumn("m", F.avg("p").over(W.partitionBy("id", "c")))
    norms = F.sqrt(F.sum(F.col("p") * F.col("p"))) * (F.sqrt(F.sum(F.col("m") * F.col("m"))) + 1e-12) + 1e-12
    cos = m.groupBy("id", "agent").agg(F.least(F.greatest(F.sum(F.col("p") * F.col("m")) / norms, F.lit(0.0)), F.lit(1.0)).alias("cos"), F.max("p").alias("c2"))
    before = first.groupBy("id", "agent").agg(F.max("p").alias("c1"))
    gain = F.least(F.greatest((F.col("gain") + GAIN_RANGE) / (2 * GAIN_RANGE), F.lit(0.0)), F.lit(1.0))
    found = cos.join(before, ["id", "agent"]).join(levels, "id", "left").withColumn("gain", F.col("c2") - F.col("c1")).withColumn("fit", fit(F.col("level"), F.col("agent")))
    return found.select("id", "agent", "cos", "gain", "fit", (CONSENSUS * F.col("cos") + GAIN * gain + FIT * F.col("fit")).alias("cred"))


def quality_boost(level: Column, agent: Column) -> Column:
    """Factor of a base weight by quality: networks gain 10 % on high, the feature model 15 % on low (fixed values)."""
    return F.when((level == "high") & agent.isin(1, 3), 1.10).when((level == "low") & (agent == 0), 1.15).otherwise(1.0)


def quality_shift(quality: Column, agent: Column) -> Column:
    """Factor of a base weight by a quality from 0 to 1: networks gain from 0.8 on, the feature model up to 0.5 (fixed values)."""
    shift = (quality - 0.5) * 0.4
    high = F.when(agent == 0, 1 - shift * 0.3).otherwise(1 + shift * 0.5)
    low = F.when(agent == 0, 1 - shift * 0.5).when(agent == 3, 1 + shift * 0.3).otherwise(1.0)
    return F.when(quality >= 0.8, high).when(quality <= 0.5, low).otherwise(1.0)


#: Ways of weighing: by quality with arbitration, without it, with fixed weights, with equal ones.
MODES = ("full", "no_arbitration", "fixed_weights", "equal_weights")


def weigh(first: DataFrame, second: DataFrame, levels: DataFrame, flags: DataFrame, modes: tuple[str, ...] = ("full",)) -> DataFrame:
    """(id, subject, y, mode, c, p, arbitrated): votes of each mode over the probabilities of two rounds.

    ``flags`` (id, disagree) says which epochs are arbitrated: they are voted on anew, with base weights times
    credibilities, from the second round; only they need to be in ``second``. The others keep their first round.
    """
    hot = flags.where("disagree").select("id")
    cred = credibility(second, first.join(hot, "id", "left_semi"), levels).select("id", "agent", "cred")
    agents = first.groupBy("id", "agent").agg(F.count("*").alias("_n")).join(levels, "id", "left").join(flags, "id").join(cred, ["id", "agent"], "left")
    mode, base = F.col("mode"), lookup(BASE, F.col("agent"), 0.25)
    weighed = agents.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    part = W.partitionBy("id", "mode")
    own = F.when(mode == "fixed_weights", base).when(mode == "equal_weights", 1.0).otherwise(base * quality_boost(F.coalesce("level", F.lit("medium")), F.col("agent")))
    weighed = weighed.withColumn("w", own)
    adapted = clamped(weighed, "w", ["id", "mode"]).withColumn("w", F.when(mode == "fixed_weights", base).otherwise(F.col("w")))
    again = F.col("disagree") & (mode != "no_arbitration")
    adapted = adapted.withColumn("arbitrated", again).withColumn("_a", F.when(again, F.col("w") * F.col("cred")).otherwise(F.col("w")))
    settled = adapted.withColumn("_b", F.least(F.greatest(normalise(F.col("_a"), part), F.lit(LOW)), F.lit(HIGH))).withColumn("w", F.when(again, normalise(F.col("_b"), part)).otherwise(F.col("w")))
    few = settled.select("id", "agent", "mode", "arbitrated", "w")
    calm, tried = few.where(~F.col("arbitrated")), few.where("arbitrated")
    rows = first.join(calm, ["id", "agent"]).unionByName(second.select(first.columns).join(tried, ["id", "agent"]))
    return rows.groupBy("id", "subject", "y", "mode", "c", "arbitrated").agg(F.round(F.sum(F.col("w") * F.col("p")) / F.sum("w") + 1e-9, 6).alias("p"))


def diagnose(first: DataFrame, reversed_: DataFrame, levels: DataFrame, **limits: float) -> DataFrame:
    """(id, label, confidence, arbitrated): the whole decision; only epochs whose agents disagree get a second round."""
    flags = disagreement(first, **limits).select("id", "disagree")
    hot = flags.where("disagree").select("id")
    second = second_opinion(first.join(hot, "id", "left_semi"), reversed_)
    return best(weigh(first, second, levels, flags), ["id", "arbitrated"], "p")
