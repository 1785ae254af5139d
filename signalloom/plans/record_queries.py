"""Queries on records, labels and spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalloom.operators import linkage as li
from signalloom.operators import spectral as sp
from signalloom.operators.explain import importances
from signalloom.plans.registry import query, rounded
from signalloom.session import read
from signalloom.sources.tables import VECTORS, vectors

R = lambda sql, k=4: f"(round({sql} + 1e-9, {k}) + 0)"
RULES = [("tion", 1), ("ing", 2), ("en", 0)]


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").withColumn("code", li.code_class(F.col("quality"))).withColumn("text_class", li.keyword_class(F.col("text"), RULES))


LABELLED = """WITH d AS (SELECT *, CASE quality WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS code,
CASE WHEN contains(text, 'tion') THEN 1 WHEN contains(text, 'ing') THEN 2 WHEN contains(text, 'en') THEN 0 END AS text_class FROM documents LEFT JOIN labels USING (doc_id))"""


@query(LABELLED + " SELECT doc_id, coalesce(code, text_class) AS label, CASE WHEN code IS NOT NULL THEN 'raw_code' WHEN text_class IS NOT NULL THEN 'text' ELSE 'none' END AS label_source FROM d")
def label_text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("code").isNotNull(), "raw_code").when(F.col("text_class").isNotNull(), "text").otherwise("none")
    return _labelled(spark, sf_dir).select("doc_id", F.coalesce("code", "text_class").alias("label"), source.alias("label_source"))


@query(LABELLED + """, g AS (SELECT *, n_chars % 10 AS gap FROM d), f AS (SELECT *, coalesce(gap > 7, false) AND text_class IS NOT NULL AS far FROM g)
SELECT doc_id, CASE WHEN code IS NOT NULL AND NOT far THEN code ELSE coalesce(text_class, code) END AS label,
CASE WHEN code IS NOT NULL AND NOT far THEN 'project' WHEN text_class IS NOT NULL THEN 'raw_index' WHEN code IS NOT NULL THEN 'project' ELSE 'none' END AS label_source,
coalesce((code <> text_class)::INT, 0) AS label_conflict FROM f""")
def label_merge_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, source, conflict = li.merge_labels(F.col("code"), F.col("text_class"), F.col("n_chars") % 10)
    return _labelled(spark, sf_dir).select("doc_id", label.alias("label"), source.alias("label_source"), conflict.alias("label_conflict"))


@query(LABELLED + f""", k AS (SELECT code, count(*) AS n FROM d GROUP BY code)
SELECT code, n, {R('n / sum(n) OVER ()')} AS ratio, {R('max(n) FILTER (code IS NOT NULL) OVER () / min(n) FILTER (code IS NOT NULL) OVER ()', 2)} AS imbalance, (SELECT count(DISTINCT source) FROM d) AS n_subjects FROM k""")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = li.distribution(_labelled(spark, sf_dir), "code", "source")
    return d.withColumn("ratio", rounded("ratio")).withColumn("imbalance", rounded("imbalance", 2))


@query(LABELLED + " SELECT lang, source, count(*) AS n, count(DISTINCT code) AS n_codes FROM d GROUP BY CUBE (lang, source)")
def coverage_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).cube("lang", "source").agg(F.count("*").alias("n"), F.countDistinct("code").alias("n_codes"))


@query(LABELLED + f""" SELECT code, {R('avg(n_chars)')} AS mean, {R('quantile_cont(n_chars::DOUBLE, 0.5)')} AS median, {R('quantile_cont(n_chars::DOUBLE, 0.1)')} AS p10, {R('quantile_cont(n_chars::DOUBLE, 0.9)')} AS p90,
min(n_chars)::DOUBLE AS min, max(n_chars)::DOUBLE AS max FROM d GROUP BY code""")
def describe_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = li.describe(_labelled(spark, sf_dir), ["code"], "n_chars")
    return d.select("code", *(rounded(c).alias(c) for c in ("mean", "median", "p10", "p90")), "min", "max")


@query("""WITH o AS (SELECT o_custkey AS user, o_orderkey, o_orderdate::DATE AS d FROM orders), e AS (SELECT user_id AS user, event_id, ts::DATE AS t FROM events),
m AS (SELECT *, abs(date_diff('day', t, d)) AS gap, row_number() OVER (PARTITION BY user, o_orderkey ORDER BY abs(date_diff('day', t, d)) NULLS LAST, event_id) AS k FROM o LEFT JOIN e USING (user))
SELECT user, o_orderkey, gap::INT AS gap, event_id FROM m WHERE k = 1""")
def nearest_date_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user"), "o_orderkey", F.to_date("o_orderdate").alias("d"))
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("user"), "event_id", F.to_date("ts").alias("t"))
    return li.nearest(orders, events, ["user"], "o_orderkey", "d", "t", "event_id").select("user", "o_orderkey", "gap", "event_id")


@query("""SELECT o_custkey, o_orderkey, (row_number() OVER w)::INT AS seq, count(*) OVER (PARTITION BY o_custkey) AS n_records, (row_number() OVER w = 1)::INT AS first_record
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate NULLS LAST, o_orderkey)""")
def exam_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return li.sequence(rows, "o_custkey", [F.col("o_orderdate").asc_nulls_last(), F.col("o_orderkey")]).drop("o_orderdate")


@query("WITH n AS (SELECT c_custkey, lower(trim(translate(c_name, ' ' || chr(12288) || chr(183) || '~-_.,', ''))) AS name FROM customer) SELECT c_custkey, name, printf('ANON_%04d', dense_rank() OVER (ORDER BY name)) AS anon_id FROM n")
def dense_anon_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select("c_custkey", li.normal_name(F.col("c_name")).alias("name"))
    return li.dense_ids(rows, "name", "ANON_%04d").select("c_custkey", "name", "anon_id")


@query(f"""WITH f AS (SELECT p_brand, regr_slope(p_retailprice, p_size) AS s, regr_intercept(p_retailprice, p_size) AS i FROM part GROUP BY p_brand)
SELECT p_partkey, {R('s')} AS slope, {R('p_retailprice - (s * p_size + i)')} AS residual FROM part JOIN f USING (p_brand)""")
def age_regression_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = li.residuals(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), ["p_brand"], "p_retailprice", "p_size")
    return rows.select("p_partkey", rounded("slope").alias("slope"), rounded("residual").alias("residual"))


SPECTRUM = f"""WITH {VECTORS}, z AS (SELECT id, k::INT AS k, sum(x * cos(2 * pi() * pos * k / 64)) AS re, sum(x * sin(2 * pi() * pos * k / 64)) AS im FROM e, (SELECT unnest(range(0, 33)) AS k) GROUP BY ALL),
s AS (SELECT id, k, (re * re + im * im) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / 64 AS pw FROM z)"""
_hz = 1.5


def _spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.power(vectors(spark, sf_dir), 64)


@query(SPECTRUM + " SELECT id, " + ", ".join(f"{R(f'sum(CASE WHEN k * 1.5 BETWEEN {a} AND {b} THEN pw ELSE 0 END) / sum(pw)')} AS {n}" for n, (a, b) in sp.BANDS.items()) + " FROM s GROUP BY id")
def dft_band_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.band_powers(_spectrum(spark, sf_dir), _hz).select("id", *(rounded(n).alias(n) for n in sp.BANDS))


@query(SPECTRUM + """, c AS (SELECT *, sum(pw) OVER (PARTITION BY id ORDER BY k) / sum(pw) OVER (PARTITION BY id) AS cum FROM s)
SELECT id, min(k) FILTER (cum >= 0.95 - 1e-12) * 1.5::DOUBLE AS edge, arg_min(k, (-pw, k)) * 1.5::DOUBLE AS peak FROM c GROUP BY id""")
def spectral_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.edge(_spectrum(spark, sf_dir), _hz)


@query(SPECTRUM + f", q AS (SELECT id, pw / sum(pw) OVER (PARTITION BY id) AS q FROM s) SELECT id, {R('sum(-q * ln(q))')} AS entropy FROM q WHERE q > 0 GROUP BY id")
def spectral_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.entropy(_spectrum(spark, sf_dir)).select("id", rounded("entropy").alias("entropy"))


@query(f"""WITH {VECTORS}, c AS (SELECT id, pos // 16 AS ch, pos % 16 AS t, x FROM e), p AS (SELECT a.id, a.ch AS ch_a, b.ch AS ch_b, corr(a.x, b.x) AS r FROM c a JOIN c b ON a.id = b.id AND a.t = b.t AND a.ch < b.ch GROUP BY ALL)
SELECT id, {R('max(abs(r))')} AS max_corr, {R('avg(abs(r))')} AS mean_corr FROM p GROUP BY id""")
def channel_corr_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vectors(spark, sf_dir).select("id", F.floor(F.col("pos") / 16).alias("ch"), (F.col("pos") % 16).alias("t"), "x")
    a, b = c.alias("a"), c.alias("b")
    pairs = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.ch") < F.col("b.ch")))
    r = F.when((F.stddev_pop("a.x") > 0) & (F.stddev_pop("b.x") > 0), F.abs(F.corr("a.x", "b.x")))
    own = pairs.groupBy(F.col("a.id").alias("id"), "a.ch", "b.ch").agg(r.alias("r"))
    return own.groupBy("id").agg(rounded(F.max("r")).alias("max_corr"), rounded(F.avg("r")).alias("mean_corr"))


@query(f"""WITH {VECTORS}, s AS (SELECT id, pos::INT AS pos, round(abs(x) / sum(abs(x)) OVER (PARTITION BY id), 6) AS share, row_number() OVER (PARTITION BY id ORDER BY abs(x) DESC, pos) AS place FROM e)
SELECT id, pos, share FROM s WHERE place <= 10""")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    return e.select("id", F.inline(importances(F.col("x")))).withColumn("share", F.round("share", 6))


@query(LABELLED + " SELECT doc_id, coalesce(code, text_class) AS label FROM d WHERE coalesce(code, text_class) IS NOT NULL")
def labelled_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("doc_id", F.coalesce("code", "text_class").alias("label")).where("label is not null")


@query("""SELECT o_orderkey, CASE WHEN try_cast(regexp_extract(o_orderpriority, '^[0-9]') AS INT) IS NOT NULL THEN try_cast(regexp_extract(o_orderpriority, '^[0-9]') AS INT) END AS n,
round_even(o_totalprice / 1000, 0)::INT AS thousands, (coalesce(try_cast(o_orderpriority AS DOUBLE), 0) > 0)::INT AS positive FROM orders""")
def coerced_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and numbers as nullable whole numbers and flags."""
    orders = read(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey", li.count_value(F.substring("o_orderpriority", 1, 1)).alias("n"), li.count_value((F.col("o_totalprice") / 1000).cast("string")).alias("thousands"), li.positive(F.col("o_orderpriority")).alias("positive")
    )


@query("""WITH k AS (SELECT o_custkey || '|' || o_orderdate::DATE AS key, o_orderpriority, o_orderkey FROM orders), m AS (SELECT key, arg_max(o_orderpriority, o_orderkey) AS priority FROM k GROUP BY key)
SELECT o_orderkey, key, priority FROM k JOIN m USING (key)""")
def keyed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with the label of its name and date; of several labels for one key the last counts."""
    key = F.concat(F.col("o_custkey").cast("string"), F.lit("|"), F.to_date("o_orderdate").cast("string"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"), "o_orderpriority")
    last = orders.groupBy("key").agg(F.max_by("o_orderpriority", "o_orderkey").alias("priority"))
    return orders.select("o_orderkey", "key").join(last, "key")


@query("""WITH f AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT c_custkey, event_type, value, user_id IS NOT NULL AS matched FROM customer LEFT JOIN (SELECT * FROM f WHERE k = 1) ON user_id = c_custkey""")
def case_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with the fields of its first case, if there is one."""
    first = li.first_of(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")])
    joined = read(spark, sf_dir, "customer").select("c_custkey").join(first, F.col("c_custkey") == F.col("user_id"), "left")
    return joined.select("c_custkey", "event_type", "value", F.col("user_id").isNotNull().alias("matched"))


@query("""WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS source FROM events GROUP BY user_id) SELECT c_custkey, coalesce(source, 'unknown') AS source, (source IS NULL)::INT AS missing FROM customer LEFT JOIN l ON user_id = c_custkey""")
def subject_label_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject's source, that of its last row; unknown where it has none."""
    last = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("source"))
    return li.with_default(read(spark, sf_dir, "customer").select("c_custkey"), last, "c_custkey", "source", "unknown")


AGES = "g AS (SELECT vec_id, vec_id % 50 AS subject FROM embeddings), a AS (SELECT p_partkey AS subject, p_size::DOUBLE AS age FROM part WHERE p_size < 30)"


@query(f"WITH {AGES} SELECT vec_id, subject, coalesce(age, 6.0) AS age, (age IS NULL)::INT AS missing FROM g LEFT JOIN a USING (subject)")
def subject_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each epoch's age by its subject, 6 where none is known; parts of size 30 and more have none, so that some are missing."""
    units = read(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 50).alias("subject"))
    return li.with_default(units, _ages(spark, sf_dir), "subject", "age", 6.0).select("vec_id", "subject", "age", "missing")


def _ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").where("p_size < 30").select(F.col("p_partkey").alias("subject"), F.col("p_size").cast("double").alias("age"))


@query(f"WITH {AGES} SELECT vec_id, subject FROM g SEMI JOIN a USING (subject)")
def aged_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs whose subject has an age; parts of size 30 and more have none."""
    units = read(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 50).alias("subject"))
    return units.join(_ages(spark, sf_dir), "subject", "left_semi").select("vec_id", "subject")


@query(LABELLED + f""" SELECT code, sum((NOT contains(text, '|'))::INT)::BIGINT AS negative, sum(contains(text, '|')::INT)::BIGINT AS positive, {R("avg(contains(text, '|')::INT) * 100", 1)} AS rate FROM d GROUP BY code""")
def wave_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _labelled(spark, sf_dir)
    return li.crosstab(d, "code", li.positive(F.contains("text", F.lit("|")).cast("int").cast("string"))).withColumn("rate", rounded("rate", 1))


@query(LABELLED + f""" SELECT lang, count(*) AS n, count(code) AS matched, {R("avg((code IS NOT NULL)::INT) * 100", 1)} AS coverage FROM d GROUP BY lang""")
def coverage_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.count("code").alias("matched"), rounded(F.avg(F.col("code").isNotNull().cast("int")) * 100, 1).alias("coverage"))


@query(LABELLED + """ SELECT doc_id FROM d WHERE code IS NOT NULL AND text <> '' AND doc_id = (SELECT min(doc_id) FROM documents x WHERE x.source = d.source AND x.lang = d.lang)""")
def usable_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled records with data that are the first of their subject."""
    first = F.row_number().over(W.partitionBy("source", "lang").orderBy("doc_id"))
    return _labelled(spark, sf_dir).withColumn("k", first).where("k = 1 and code is not null and text <> ''").select("doc_id")
