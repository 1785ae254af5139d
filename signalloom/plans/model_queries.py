"""Queries whose work is filters, greedy selection, windows in time or fuzzy names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.functions import filters
from signalloom.operators import evaluation as ev
from signalloom.operators import filtering, linkage, selection, spatial, spectral
from signalloom.plans.registry import QUERIES, query, rounded
from signalloom.session import read, ship
from signalloom.sources.tables import SIGNALS, VECTORS, signals, vectors
from signalloom.streaming import windows

R = lambda sql, k=4: f"(round({sql} + 1e-9, {k}) + 0)"


def rows_only(f):
    """Registers a query that SQL cannot express."""
    QUERIES[f.__name__] = f
    return f


@rows_only
def iir_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notch, band-pass and decimation of every record's channels; energy before and after."""
    blocks = filtering.as_blocks(signals(ship(spark), sf_dir)).withColumn("raw", F.col("x"))
    energy = lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v)) / F.sum(F.size(c))
    return filtering.clean(blocks, 500.0).groupBy("rec", "ch").agg(F.sum(F.size("x")).alias("n"), energy("raw").alias("power_raw"), energy("x").alias("power_clean"))


WELCH = f"""WITH {SIGNALS}, q AS (SELECT *, least(256, n) AS m, greatest(least(256, n) - least(256, n) // 2, 1) AS hop FROM r),
g AS (SELECT rec, ch, t, v, m, hop, unnest(range(greatest(0, (t - m + 1 + hop - 1) // hop), least(t // hop, (n - m) // hop) + 1)) AS seg FROM q),
z AS (SELECT rec, ch, seg, m, t - seg * hop AS i, (v - avg(v) OVER (PARTITION BY rec, ch, seg)) * (0.5 - 0.5 * cos(2 * pi() * (t - seg * hop) / m)) AS x, 0.5 - 0.5 * cos(2 * pi() * (t - seg * hop) / m) AS w FROM g),
s AS (SELECT rec, ch, seg, m, k, (pow(sum(x * cos(2 * pi() * i * k / m)), 2) + pow(sum(x * sin(2 * pi() * i * k / m)), 2)) / (250 * CASE WHEN sum(w * w) = 0 THEN 1 ELSE sum(w * w) END) * CASE WHEN k = 0 OR 2 * k = m THEN 1 ELSE 2 END AS p FROM z, (SELECT unnest(range(0, 129)) AS k) WHERE k <= m // 2 GROUP BY rec, ch, seg, m, k),
de AS (SELECT rec, ch, k, k * 250 / m AS f, avg(p) AS density FROM s GROUP BY rec, ch, k, m)"""


TAPS = ", ".join(f"{x!r}" for x in filters.resample_taps(3, 2).tolist())
RESAMPLED = f"""WITH {SIGNALS}, o AS (SELECT rec, ch, n, unnest(range(0, (n * 3 + 1) // 2)) AS m FROM (SELECT DISTINCT rec, ch, n FROM r)), h AS (SELECT unnest(range(-30, 31)) AS i, unnest([{TAPS}]) AS w),
y AS (SELECT o.rec, o.ch, m, sum(w * v) AS v FROM o JOIN h ON (m * 2 - i) % 3 = 0 JOIN r ON r.rec = o.rec AND r.ch = o.ch AND r.t = (m * 2 - i) // 3 AND m * 2 >= i GROUP BY ALL)"""


@query(RESAMPLED + f" SELECT rec, ch, m, {R('v', 2)} AS v FROM y")
def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's channels at three halves of their rate, by blocks."""
    found = filtering.resample(signals(ship(spark), sf_dir), 3, 2, 128).select("rec", "ch", "first", F.posexplode("x").alias("i", "v"))
    return found.select("rec", "ch", (F.col("first") + F.col("i")).alias("m"), rounded("v", 2).alias("v"))


@query(WELCH + f" SELECT rec, ch, k::INT AS k, {R('f')} AS f, {R('density / 1000')} AS density FROM de")
def welch_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Welch densities of every record's channels."""
    d = filtering.welch(signals(ship(spark), sf_dir), 250.0)
    return d.select("rec", "ch", F.col("k").cast("int").alias("k"), rounded("f").alias("f"), rounded(F.col("density") / 1000).alias("density"))


@query(WELCH + f""", t AS (SELECT *, density / sum(density) OVER w AS q, sum(density) OVER (PARTITION BY rec, ch ORDER BY f) >= 0.95 * sum(density) OVER w * (1 - 1e-12) AS e FROM de WINDOW w AS (PARTITION BY rec, ch))
SELECT rec, ch, """ + ", ".join(f"{R(f'sum(CASE WHEN f BETWEEN {a} AND {b} THEN q ELSE 0 END)')} AS {n}" for n, (a, b) in spectral.BANDS.items()) + f""",
{R("arg_min(f, (-round(q, 12), f))")} AS peak, {R("min(f) FILTER (e)")} AS edge, {R("sum(CASE WHEN q > 0 THEN -q * ln(q) ELSE 0 END)")} AS entropy FROM t GROUP BY ALL""")
def frequency_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight features of every record's channels, from Welch densities."""
    v = spectral.band_vector(filtering.welch(signals(ship(spark), sf_dir), 250.0), ["rec", "ch"])
    return v.select("rec", "ch", *(rounded(c).alias(c) for c in v.columns[2:]))


@rows_only
def mrmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight components of least redundancy and greatest relevance, in order of choice, by difference and by quotient."""
    binned = ev.equal_bins(vectors(spark, sf_dir), ["pos"], "x", "id").select("id", "y", "pos", "bin").cache()
    found = [(c, i, f) for c, q in (("MID", False), ("MIQ", True)) for i, f in enumerate(selection.mrmr(binned, "id", "pos", "bin", "y", 8, q))]
    binned.unpersist()
    return spark.createDataFrame(found, "criterion string, place int, pos int")


MI = f"""WITH {VECTORS}, b AS (SELECT id, y, pos, ((10 * row_number() OVER (PARTITION BY pos ORDER BY x, id) - 1) // count(*) OVER (PARTITION BY pos))::INT AS bin FROM e),
rn AS (SELECT pos, bin, y, count(*)::DOUBLE AS n FROM b GROUP BY ALL), rm AS (SELECT *, sum(n) OVER (PARTITION BY pos) AS a, sum(n) OVER (PARTITION BY pos, bin) AS na, sum(n) OVER (PARTITION BY pos, y) AS nb FROM rn),
rel AS (SELECT pos, round(sum(n / a * ln(n * a / (na * nb))), 9) AS mi FROM rm GROUP BY pos),
pn AS (SELECT u.pos, o.pos AS other, u.bin, o.bin AS obin, count(*)::DOUBLE AS n FROM b u JOIN b o USING (id) GROUP BY ALL),
pm AS (SELECT *, sum(n) OVER (PARTITION BY pos, other) AS a, sum(n) OVER (PARTITION BY pos, other, bin) AS na, sum(n) OVER (PARTITION BY pos, other, obin) AS nb FROM pn),
red AS (SELECT pos, other, sum(n / a * ln(n * a / (na * nb))) AS raw, round(raw, 9) AS mi FROM pm GROUP BY pos, other),
s0 AS (SELECT pos FROM rel ORDER BY -mi, pos LIMIT 1)"""


def _steps(k: int, quotient: bool = False) -> str:
    sql, union = MI, "SELECT 0 AS place, pos FROM s0"
    for i in range(1, k):
        score = f"rel.mi / (sum(red.mi) / {i} + 1e-6)" if quotient else f"rel.mi - sum(red.mi) / {i}"
        sql += f", g{i} AS ({' UNION ALL '.join(f'SELECT pos FROM s{j}' for j in range(i))}), s{i} AS (SELECT rel.pos FROM rel JOIN red ON red.pos = rel.pos AND other IN (SELECT pos FROM g{i}) WHERE rel.pos NOT IN (SELECT pos FROM g{i}) GROUP BY rel.pos, rel.mi ORDER BY -round({score}, 9), rel.pos LIMIT 1)"
        union += f" UNION ALL SELECT {i}, pos FROM s{i}"
    return f"{sql} {union}"


@query(_steps(4))
def mrmr_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four choices by difference."""
    binned = ev.equal_bins(vectors(spark, sf_dir), ["pos"], "x", "id").select("id", "y", "pos", "bin")
    return spark.createDataFrame(list(enumerate(selection.mrmr(binned, "id", "pos", "bin", "y", 4))), "place int, pos int")


@query(_steps(4, True))
def mrmr_quotients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four choices by quotient."""
    binned = ev.equal_bins(vectors(spark, sf_dir), ["pos"], "x", "id").select("id", "y", "pos", "bin")
    return spark.createDataFrame(list(enumerate(selection.mrmr(binned, "id", "pos", "bin", "y", 4, True))), "place int, pos int")


@query(MI + " SELECT pos, other, round(raw + 3e-10, 5) + 0 AS mi FROM red WHERE pos < other")
def feature_pair_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutual information of every two features, rounded once."""
    binned = ev.equal_bins(vectors(spark, sf_dir), ["pos"], "x", "id").select("id", "pos", "bin")
    found = selection.pair_information(binned, "id", "pos", "bin", list(range(64))).where("pos < other")
    return found.select("pos", "other", (F.round(F.col("mi") + 3e-10, 5) + F.lit(0.0)).alias("mi"))


@query(f"WITH c AS ({_steps(4)}), st AS (SELECT pos, avg(x) AS m, CASE WHEN stddev_pop(x) < 1e-8 THEN 1 ELSE stddev_pop(x) END AS s FROM (WITH {VECTORS} SELECT * FROM e) GROUP BY pos) SELECT id, pos, place, {R('(x - m) / s')} AS z FROM (WITH {VECTORS} SELECT * FROM e) JOIN st USING (pos) JOIN c USING (pos)")
def fused_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised values of the four features chosen first."""
    v = vectors(spark, sf_dir)
    fusion = selection.Fusion.fit(v, "id", "pos", "x", "y", 4)
    return fusion.transform(v, "id", "pos", "x").withColumn("z", rounded("z"))


@query(f"""SELECT vec_id AS id, len(list_concat(embedding[1:8], embedding[17:64])) = 0 AS dropped, round(list_sum(list_concat(embedding[1:8], embedding[17:64])::DOUBLE[]) + 1e-9, 4) AS kept_sum,
len(list_concat(embedding, [0.0])) AS n_augmented, round(list_reverse(embedding)[1]::DOUBLE + 1e-9, 4) AS last, round(list_sum(embedding[1:10]::DOUBLE[]) + 1e-9, 4) AS cut_sum,
greatest(80, len(embedding[1:80])) AS n_filled, round(list_sum(embedding[1:80]::DOUBLE[]) + 1e-9, 4) AS filled_sum FROM embeddings""")
def vector_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays without a block, augmented, reversed, cut to ten and filled to eighty entries."""
    x = F.col("embedding").cast("array<double>")
    total = lambda c: rounded(F.aggregate(c, F.lit(0.0), lambda a, v: a + v))
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), x.alias("x"))
    kept = selection.without_block(F.col("x"), 8, 8)
    return e.select(
        "id", (F.size(kept) == 0).alias("dropped"), total(kept).alias("kept_sum"), F.size(F.concat("x", F.array(F.lit(0.0)))).cast("long").alias("n_augmented"),
        rounded(F.reverse("x")[0]).alias("last"), total(selection.fixed_size(F.col("x"), 10)).alias("cut_sum"),
        F.size(selection.fixed_size(F.col("x"), 80)).cast("long").alias("n_filled"), total(selection.fixed_size(F.col("x"), 80)).alias("filled_sum"),
    )


@rows_only
def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered morphology, power ratio and globals of every vector read as eight channels of eight samples."""
    v = vectors(ship(spark), sf_dir).select("id", F.floor(F.col("pos") / 8).cast("int").alias("ch"), (F.col("pos") % 8).alias("t"), "x")
    arrays = v.groupBy("id", "ch").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda s: s["x"]).alias("x"))
    shapes, globals_ = spatial.event_features(arrays, 100.0)
    return shapes.join(globals_, "id")


@rows_only
def fuzzy_same_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every order without an event of its own customer, the most similar customer name among the events of its date."""
    orders = read(ship(spark), sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    names = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), linkage.normal_name(F.col("c_name")).alias("name"))
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.to_date("ts").alias("day"), "event_id")
    left = orders.join(events, F.col("o_custkey") == F.col("k"), "left_anti").join(names.withColumnRenamed("name", "key"), F.col("o_custkey") == F.col("k"))
    shift = F.expr("make_date(year(d) + 27, month(d), least(day(d), 28))")  # the tables' dates don't overlap
    return linkage.fuzzy(left.select("o_orderkey", shift.alias("day"), "key"), events.join(names, "k").select("event_id", "day", "name"), "o_orderkey", "day", "key", "name", "event_id")


@query(f"""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(value) AS n, {R('avg(value)')} AS mean, {R('stddev_pop(value)')} AS std, max(value) AS max, min(value) AS min FROM events GROUP BY ALL""")
def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.windowed(read(spark, sf_dir, "events"), ["event_type"], "ts", "value", "1 hour")
    return w.select("event_type", "start", "n", rounded("mean").alias("mean"), rounded("std").alias("std"), "max", "min")


@query(f"""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n, {R('avg(value)')} AS mean FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(read(spark, sf_dir, "events"), ["user_id"], "ts", "value", "6 hours").withColumn("mean", rounded("mean"))
