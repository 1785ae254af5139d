"""Sheets, ages and explanations on hand-made rows."""

import datetime

from pyspark.sql import functions as F

from signalloom.operators import explain
from signalloom.sources import sheets


def test_headers_and_projection(spark, tmp_path):
    (tmp_path / "s.csv").write_text('﻿name,"code\n(0 normal, 1 not)",drug,drug,Unnamed: 4,age (years)\nann,1,x,y,z,7\nbob,,,,,old\n', encoding="utf-8")
    df = sheets.read_sheet(spark, [str(tmp_path / "none.csv"), str(tmp_path / "s.csv")])
    assert df.columns == ["name", "code", "drug", "drug_2", "age"]
    out = sheets.project(df, {"who": ("name", "string"), "label": ("code", "int"), "age": ("age", "double"), "sex": ("sex", "string")})
    assert sorted(map(tuple, out.collect())) == [("ann", 1, 7.0, None), ("bob", None, None, None)]


def test_tidy():
    assert [sheets.tidy(h) for h in ("a（b）c", "x(y", " n \nmore", "p[q]", "", "c\rd", "k(1)（2）")] == ["a", "x(y", "n", "p[q]", "", "c", "k"]


def test_ages(spark):
    d = datetime.date
    rows = [(d(2010, 1, 1), d(2020, 1, 1), 10.0), (d(1970, 1, 1), d(1990, 1, 1), None), (d(2021, 1, 1), d(2020, 1, 1), 3.0), (d(1985, 1, 1), d(2020, 1, 1), None), (d(2010, 1, 1), d(2020, 1, 1), 12.0)]
    df = spark.createDataFrame(rows, "b date, e date, r double").withColumn("c", sheets.age(F.col("b"), F.col("e")))
    got = df.select(*(c.alias(n) for n, c in sheets.age_columns(F.col("r"), F.col("c")).items())).collect()
    assert [(r.age and round(r.age, 1), r.age_source, r.age_check_flag) for r in got] == [(10.0, "recorded", 0), (None, "missing", 0), (3.0, "recorded", 0), (None, "missing", 0), (12.0, "recorded", 1)]


def test_explanations(spark):
    df = spark.createDataFrame([([1.0, -2.0, 1.0, 0.0], 2), (None, 0), ([0.0, 0.0], 9)], "x array<double>, y int")
    got = explain.explained(df, "x", "y", ["normal", "borderline", "abnormal"], 3, 2).collect()
    assert [(r.pos, r.share) for r in got[0].importances] == [(1, 0.5), (0, 0.25), (2, 0.25)]
    assert got[0].text == "Judged abnormal, mostly by feature 1 (50.0%), feature 0 (25.0%)."
    assert [(r.pos, r.share) for r in got[1].importances] == [(0, 0.0)]
    assert got[2].text.startswith("Judged unknown")
