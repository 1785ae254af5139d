"""Simulated epochs, fitted scorers, connectivity properties."""

from pyspark.sql import functions as F

from signalloom.operators import fusion, scorers, spatial
from signalloom.sources import simulated


def test_simulation_ignores_partitions(spark):
    a = simulated.simulate(spark, 6, 2, 4, 100)
    b = simulated.simulate(spark, 6, 2, 4, 100).repartition(5)
    assert a.exceptAll(b).count() == 0 and a.count() == 12
    assert {r.label for r in a.select("label").distinct().collect()} == {0, 1, 2}


def test_coherence_is_a_share(spark):
    rows = simulated.long_rows(simulated.simulate(spark, 3, 1, 4, 64)).select(F.col("subject").alias("id"), "ch", "t", F.col("v").alias("x"))
    same = rows.where("ch = 0").withColumn("ch", F.lit(9))
    coh = spatial.coherence(spatial.spectra(rows.unionByName(same), 64), 1, 20)
    assert coh.where("coh < 0 or coh > 1").count() == 0
    twin = coh.where("ch_a = 0 and ch_b = 9").collect()
    assert len(twin) == 3 and all(abs(r.coh - 1) < 1e-9 for r in twin)
    silent = rows.where("ch < 2").withColumn("x", F.when(F.col("ch") == 0, 0.0).otherwise(F.col("x")))
    assert {r.coh for r in spatial.coherence(spatial.spectra(silent, 64), 1, 20).collect()} == {0.0}


def test_scorers_learn(spark):
    rows = spark.range(120).select("id", (F.col("id") % 3).cast("int").alias("y"), F.array((F.col("id") % 3).cast("double"), F.lit(1.0)).alias("x"))
    p = scorers.fit_and_score(rows, rows, "forest", ["id", "y"])
    best = fusion.best(p, ["id", "y"], "p")
    assert best.where("label = y").count() == 120
    assert abs(p.groupBy("id").agg(F.sum("p").alias("s")).agg(F.max(F.abs(F.col("s") - 1))).first()[0]) < 1e-9


def test_diagnosis_keeps_calm_votes(spark):
    probs = [(1, 0, 0, a, c, p) for a in range(4) for c, p in enumerate((0.8, 0.1, 0.1))] + [(2, 0, 1, a, c, p) for a in range(4) for c, p in enumerate((0.9, 0.05, 0.05) if a == 0 else (0.1, 0.8, 0.1))]
    first = spark.createDataFrame(probs, "id int, subject int, y int, agent int, c int, p double")
    levels = spark.createDataFrame([(1, "medium"), (2, "high")], "id int, level string")
    got = {r.id: r for r in fusion.diagnose(first, first, levels).collect()}
    assert (got[1].label, got[1].arbitrated, got[1].confidence) == (0, False, 0.8)
    assert (got[2].label, got[2].arbitrated) == (1, True)


def test_report(spark):
    from signalloom.plans import report

    decisions = spark.createDataFrame([(1, 7, 0, 0.9, False), (2, 7, 2, 0.6, True), (3, 7, 2, 0.7, False), (4, 8, 2, 0.5, False)], "id int, subject int, label int, confidence double, arbitrated boolean")
    features = spark.createDataFrame([(1, 7, 3), (2, 7, 3), (3, 7, 1)], "id int, subject int, pos int")
    text = report.markdown(decisions, features, 7, ["normal", "borderline", "abnormal"])
    assert "| abnormal | 2 |" in text and "arbitrated: 1" in text and "3 (2), 1 (1)" in text
    assert report.first_case(decisions, 2).first().subject == 7
