"""Cleaning and linking of record tables."""

from __future__ import annotations

import difflib
from collections import Counter
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalloom.operators.ranking import ranked

#: Keys and names of one day that meet in one group, on average at most.
KEYS, NAMES = 512, 8192
#: Longer names are compared one by one; states of so many first characters of a key are kept for the next one.
LONGEST, KEPT = 256, 64


def normal_name(name: Column) -> Column:
    """Names to match by: eight kinds of marks removed, trimmed, lower case (fixed values)."""
    return F.lower(F.trim(F.translate(name, " \u3000\u00b7~-_.,", "")))


def first_date(text: Column, formats: list[str]) -> Column:
    """The first format that reads the text as a date; null where none does."""
    return F.coalesce(*(F.try_to_date(text, f) for f in formats))


def code_class(code: Column) -> Column:
    """Raw codes 0, 1, 2 to the classes normal 0, abnormal 2, borderline 1; others are null (fixed values)."""
    n = code.try_cast("int")
    return F.when(n == 0, 0).when(n == 1, 2).when(n == 2, 1)


def keyword_class(text: Column, rules: list[tuple[str, int]]) -> Column:
    """The class of the first rule, in order, whose word the text holds."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(word)), F.lit(c)) for word, c in rules))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_date: str, right_date: str, right_id: str) -> DataFrame:
    """Left join on keys to the right row with the nearest date; missing dates come last, then the least right id.

    Both sides are put in one order by keys and date, where the nearest earlier and the nearest later right row are
    carried along: no pair of rows is made, however many rows a key has. Of the right rows of one key and date, only
    that with the least id is kept.
    """
    dated = right.where(F.col(right_date).isNotNull()).groupBy(*keys, F.col(right_date).alias("_d")).agg(F.min(right_id).alias("_r"))
    any_row = right.groupBy(*keys).agg(F.min(F.when(F.col(right_date).isNull(), F.col(right_id))).alias("_undated"), F.min(right_id).alias("_any"))
    units = left.select(*keys, left_id, F.col(left_date).alias("_d")).withColumn("_r", F.lit(None).cast(right.schema[right_id].dataType)).withColumn("_u", F.lit(1))
    points = dated.withColumn(left_id, F.lit(None).cast(left.schema[left_id].dataType)).withColumn("_u", F.lit(0)).select(*keys, left_id, "_d", "_r", "_u")
    line = units.select(*keys, left_id, "_d", "_r", "_u").unionByName(points)
    there = F.when(F.col("_u") == 0, F.struct(F.col("_d").alias("d"), F.col("_r").alias("r")))
    part = W.partitionBy(*keys)
    earlier = F.last(there, True).over(part.orderBy("_d", "_u").rowsBetween(W.unboundedPreceding, 0))
    later = F.last(there, True).over(part.orderBy(F.desc("_d"), "_u").rowsBetween(W.unboundedPreceding, 0))
    both = line.withColumn("_e", earlier).withColumn("_l", later).where("_u = 1").join(any_row, keys, "left")
    gap = lambda c: F.abs(F.datediff(F.col("_d"), F.col(f"{c}.d")))
    option = lambda c: F.when(gap(c).isNotNull(), F.struct(gap(c).alias("g"), F.col(f"{c}.r").alias("r")))
    found = both.withColumn("_m", F.least(option("_e"), option("_l")))
    rest = F.when(F.col("_d").isNull(), F.col("_any")).otherwise(F.col("_undated"))
    return found.select(*keys, left_id, F.col("_d").alias(left_date), F.col("_m.g").alias("gap"), F.coalesce("_m.r", rest).alias(right_id))


def similarity(a: str, b: str, least: float) -> float:
    """The ratio of matching blocks of two texts, or 0 where it is under ``least``; bounds by length and letters come first."""
    total = len(a) + len(b)
    if total == 0:
        return 1.0
    if 2 * min(len(a), len(b)) < least * total or 2 * sum((Counter(a) & Counter(b)).values()) < least * total:
        return 0.0
    ratio = difflib.SequenceMatcher(None, a, b).ratio()
    return ratio if ratio >= least else 0.0


def letters(names: DataFrame, keys: list[str], name: str, least: float) -> DataFrame:
    """(keys, name, _all, _few): a name's letters, each with its number among its like, the rarest first, and the first of these.

    Two texts of a ratio of ``least`` share least / (2 - least) of either's letters at least; so they share one of those that are left when all
    but that many, less one, are taken off the end of an order that holds for all.
    """
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    numbered = F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c)).cast("string")))
    each = names.select(*keys, name).distinct().withColumn("_l", F.explode(numbered))
    # As many rows as there are letters in use, whatever the names are.
    often = each.groupBy("_l").agg(F.count("*").alias("_often"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_often", "_l"))), lambda s: s["_l"])
    found = each.join(often, "_l").groupBy(*keys, name).agg(ordered.alias("_all"))
    n = F.size("_all")
    return found.withColumn("_few", F.slice("_all", 1, (n - F.ceil(n * least / (2 - least) - 1e-9) + 1).cast("int")))


def candidates(left: DataFrame, right: DataFrame, day: str, key: str, name: str, least: float = 0.6) -> DataFrame:
    """(day, key, name): pairs of one day that share enough letters for a ratio of ``least``, each once.

    A pair meets at the rarest letter that both prefixes hold; a letter that very many names of a day hold is a skewed key of a join,
    which Spark splits.
    """
    own = letters(left, [day], key, least).select(day, key, F.col("_all").alias("_a"), F.col("_few").alias("_p"), F.explode("_few").alias("_l"))
    other = letters(right, [day], name, least).select(day, name, F.col("_all").alias("_b"), F.col("_few").alias("_q"), F.explode("_few").alias("_l"))
    a, b = F.size("_a"), F.size("_b")
    both = own.join(other, [day, "_l"]).where(2 * F.least(a, b) >= least * (a + b) - 1e-9)
    return both.where((F.get(F.array_intersect("_p", "_q"), F.lit(0)) == F.col("_l")) & (2 * F.size(F.array_intersect("_a", "_b")) >= least * (a + b) - 1e-9)).select(day, key, name)


class Subsequences:
    """Lengths of the longest common subsequences of a text with each of many names, by bits of the names' characters.

    Matching blocks stand in one order in both texts, so twice that length over both lengths bounds their ratio. Texts given in order go on
    from the state after what they begin with in common.
    """

    def __init__(self, names: list[str], letters: set[str]):
        words = -(-max(map(len, names), default=1) // 64) or 1
        codes = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
        size = np.array([len(n) for n in names], np.int64)
        row = np.repeat(np.arange(len(names)), size)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
        order = np.argsort(codes, kind="stable")
        used = np.array(sorted(map(ord, letters)), np.uint32)
        #: For each character the names' bits where it stands, and all others.
        self.at = {}
        for c, a, b in zip(used.tolist(), np.searchsorted(codes, used, sorter=order), np.searchsorted(codes, used, "right", sorter=order), strict=True):
            if a < b:
                own, bits = order[a:b], np.zeros((words, len(names)), np.uint64)
                np.bitwise_or.at(bits, (place[own] >> 6, row[own]), np.uint64(1) << (place[own] & 63).astype(np.uint64))
                self.at[chr(c)] = bits, ~bits
        self.states, self.text = [np.full((words, len(names)), ~np.uint64(0))], ""

    def lengths(self, text: str) -> np.ndarray:
        del self.states[len(commonprefix([self.text, text])) + 1 :]
        self.text, state = text, self.states[-1]
        for k in range(len(self.states) - 1, len(text)):
            if text[k] in self.at:
                on, off = self.at[text[k]]
                up = state + (state & on)
                over = up < state
                for w in range(1, len(up)):
                    up[w] += over[w - 1]
                    over[w] |= over[w - 1] & (up[w] == 0)
                state = up | (state & off)
            if k < KEPT:
                self.states.append(state)
        return np.bitwise_count(~state).sum(0, dtype=np.int64)


def closest(keys: list[str], names: list[str], least: float) -> list[tuple[int, int, float]]:
    """(key, name, ratio) by place: for each key the first of the names that are most similar, where that is ``least`` or more.

    Names are compared from the highest bound down, until none that is left could be better, or as good and earlier.
    """
    size = np.array([len(n) for n in names], np.int64)
    fit, out = np.flatnonzero(size <= LONGEST), []
    bounds = Subsequences([names[i] for i in fit], {c for k in keys for c in k})
    for place in sorted(range(len(keys)), key=keys.__getitem__):
        key = keys[place]
        most = np.minimum(size, len(key))
        most[fit] = bounds.lengths(key)
        bound = 2.0 * most / np.maximum(size + len(key), 1)
        best, first = 0.0, len(names)
        while len(names) and (top := bound.max()) >= max(best, least):
            same = np.flatnonzero(bound == top)
            for i in same.tolist():
                if best == top and i > first:
                    break
                ratio = similarity(key, names[i], least) if size[i] > LONGEST else difflib.SequenceMatcher(None, key, names[i]).ratio()
                if ratio >= least and (ratio, -i) > (best, -first):
                    best, first = ratio, i
            bound[same] = -1
        if first < len(names):
            out.append((place, first, best))
    return out


def fuzzy(left: DataFrame, right: DataFrame, left_id: str, day: str, key: str, name: str, right_id: str, least: float = 0.6) -> DataFrame:
    """(left_id, name, right_id, ratio): the right row of the same day with the most similar name, at ``least`` or more.

    Names of under two characters match nothing; ties go to the least right id. The keys and the names of a day are dealt to blocks; each block
    of keys meets each block of names in a group of its own and keeps the best name of each key.
    """
    keys = left.where(F.col(key).isNotNull() & F.col(day).isNotNull()).select(day, key).distinct()
    names = right.where((F.length(name) >= 2) & F.col(day).isNotNull()).groupBy(day, name).agg(F.min(right_id).alias("_r"))
    blocks = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    days = keys.groupBy(day).agg(F.count("*").alias("_k")).join(names.groupBy(day).agg(F.count("*").alias("_n")), day).select(day, blocks("_k", KEYS).alias("_kb"), blocks("_n", NAMES).alias("_nb"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    own = keys.join(days, day).select(day, dealt(key, "_kb").alias("_kb"), every("_nb").alias("_nb"), key)
    other = names.join(days, day).select(day, every("_kb").alias("_kb"), dealt(name, "_nb").alias("_nb"), name, "_r")

    def score(some: pa.Table, others: pa.Table) -> pa.Table:
        others = others.take(pc.sort_indices(others, sort_keys=[("_r", "ascending"), (name, "ascending")], null_placement="at_start"))
        found = closest(some[key].to_pylist(), others[name].to_pylist(), least) if len(some) and len(others) else []
        one, two, ratio = ([x[i] for x in found] for i in range(3))
        columns = [some[day].take(pa.array(one, pa.int64())), some[key].take(pa.array(one, pa.int64())), others[name].take(pa.array(two, pa.int64())), others["_r"].take(pa.array(two, pa.int64())), pa.array(ratio, pa.float64())]
        return pa.Table.from_arrays(columns, names=[day, key, name, "_r", "ratio"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"`{day}` {kind(keys, day)}, `{key}` string, `{name}` string, _r {kind(names, '_r')}, ratio double"
    pairs = own.groupBy(day, "_kb", "_nb").cogroup(other.groupBy(day, "_kb", "_nb")).applyInArrow(score, schema)
    best = pairs.groupBy(day, key).agg(F.min(F.struct((-F.col("ratio")).alias("ratio"), F.col("_r").alias("r"), F.col(name).alias("n"))).alias("_b"))
    return left.join(best, [day, key]).select(left_id, F.col("_b.n").alias(name), F.col("_b.r").alias(right_id), (-F.col("_b.ratio")).alias("ratio"))


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order; give one that leaves no ties."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def count_value(text: Column) -> Column:
    """A count or flag as a whole number, halves to even; null where it is no finite number."""
    n = text.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < 2**31), F.bround(n, 0)).cast("int")


def positive(text: Column) -> Column:
    """1 for numbers over 0, 0 for others and for what is no number."""
    return (F.coalesce(text.try_cast("double"), F.lit(0.0)) > 0).cast("int")


def with_default(rows: DataFrame, table: DataFrame, key: str, value: str, default: object) -> DataFrame:
    """rows with ``value`` of a table that has one row a key, or the default, and whether it was missing."""
    kept = rows.join(table.select(key, F.col(value).alias("_v")), key, "left")
    return kept.withColumn(value, F.coalesce("_v", F.lit(default))).withColumn("missing", F.col("_v").isNull().cast("int")).drop("_v")


def merge_labels(project: Column, raw: Column, gap: Column, limit: int = 7) -> tuple[Column, Column, Column]:
    """(label, source, conflict): the project's label unless its date is too far off and a raw one stands, else the raw one."""
    far = F.coalesce(gap > limit, F.lit(False)) & raw.isNotNull()
    label = F.when(project.isNotNull() & ~far, project).otherwise(F.coalesce(raw, project))
    source = F.when(project.isNotNull() & ~far, "project").when(raw.isNotNull(), "raw_index").when(project.isNotNull(), "project").otherwise("none")
    return label, source, F.coalesce((project != raw).cast("int"), F.lit(0))


def sequence(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Place of each row among those of its key, how many those are, and whether it is the first."""
    w = W.partitionBy(key)
    placed = rows.withColumn("seq", F.row_number().over(w.orderBy(*order))).withColumn("n_records", F.count("*").over(w))
    return placed.withColumn("first_record", (F.col("seq") == 1).cast("int"))


def dense_ids(rows: DataFrame, name: str, form: str) -> DataFrame:
    """Ids by the order of distinct names, from 1."""
    names = rows.select(name).where(F.col(name).isNotNull()).distinct()
    placed = ranked(names, [], [name], "_rank", "_n")
    return rows.join(placed.select(name, F.format_string(form, F.col("_rank") + 1).alias("anon_id")), name, "left")


def distribution(rows: DataFrame, label: str, subject: str | None = None) -> DataFrame:
    """Count and share of each label, the number of subjects, and the largest class over the smallest (of labels that aren't null)."""
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    few = W.partitionBy(F.lit(1))  # one row a label
    known = F.when(F.col(label).isNotNull(), F.col("n"))
    found = n.withColumn("ratio", F.col("n") / F.sum("n").over(few)).withColumn("imbalance", F.max(known).over(few) / F.min(known).over(few))
    if subject is None:
        return found
    return found.crossJoin(F.broadcast(rows.agg(F.countDistinct(subject).alias("n_subjects"))))


def crosstab(rows: DataFrame, label: str, indicator: Column) -> DataFrame:
    """Negatives, positives and the positives' percentage for each label."""
    marked = rows.withColumn("_p", indicator)
    return marked.groupBy(label).agg(F.sum(1 - F.col("_p")).alias("negative"), F.sum("_p").alias("positive"), (F.avg("_p") * 100).alias("rate"))


def describe(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact summary of the finite values: mean, median, 10th and 90th percentile, least and greatest."""
    v = F.when(~F.isnan(value), F.col(value).cast("double"))
    return rows.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.1)).alias("p10"), F.percentile(v, F.lit(0.9)).alias("p90"), F.min(v).alias("min"), F.max(v).alias("max")
    )


def residuals(rows: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """Least-squares slope and intercept of y on x by keys, and each row's residual."""
    fit = rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return rows.join(fit, keys).withColumn("residual", F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept")))
