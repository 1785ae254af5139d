"""Filters by their frequency response, selection, and windows over a stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.functions import filters
from signalloom.operators import filtering, selection
from signalloom.streaming import windows


def response(sections, f, fs):
    z = np.exp(-2j * np.pi * f / fs)
    return abs(np.prod([(b0 + b1 * z + b2 * z**2) / (1 + a1 * z + a2 * z**2) for b0, b1, b2, a1, a2 in sections]))


def test_bandpass_response():
    s = filters.bandpass(2.0, 30.0, 250.0)
    assert len(s) == 4
    for f in (2.0, 30.0):
        assert abs(20 * np.log10(response(s, f, 250.0)) + 3.01) < 0.01
    assert response(s, 0.0, 250.0) < 1e-9 and response(s, 124.9, 250.0) < 1e-6
    assert 0.99 < response(s, 8.0, 250.0) < 1.01
    assert filters.bandpass(0.1, 30.0, 250.0) == filters.bandpass(1.25, 30.0, 250.0)


def test_notch_response():
    s = filters.notch(50.0, 30.0, 500.0)
    assert response(s, 50.0, 500.0) < 1e-9 and abs(response(s, 0.0, 500.0) - 1) < 1e-12
    assert abs(20 * np.log10(response(s, 50 + 50 / 60, 500.0)) + 3) < 0.2


def test_zero_phase_and_constants():
    t = np.arange(2000) / 500
    x = np.sin(2 * np.pi * 10 * t)[None, :]
    y = filters.both_ways(x, filters.bandpass(0.5, 45.0, 500.0))
    assert np.abs(y - x)[0, 400:-400].max() < 0.01
    flat = np.full((1, 300), 7.0)
    assert np.allclose(filters.both_ways(flat, filters.notch(50.0, 30.0, 500.0)), 7.0)


def test_resampling_and_welch():
    t = np.arange(1000) / 500
    x = np.sin(2 * np.pi * 10 * t)[None, :]
    assert np.abs(filters.decimate(x, 2)[0, 50:-50] - x[0, ::2][50:-50]).max() < 0.02
    assert np.abs(filters.fft_resample(x, 500)[0] - x[0, ::2]).max() < 1e-9
    f, p = filters.welch(np.random.default_rng(0).normal(size=(4, 50000)), 250.0)
    assert len(f) == 129 and np.allclose((p * (f[1] - f[0])).sum(1), 1, atol=0.05)


def test_blocks_of_any_length(spark):
    df = spark.createDataFrame([(1, "a", 0, [1.0, 2.0, 3.0]), (2, "a", 0, []), (3, "a", 0, None), (4, "b", 0, [4.0] * 40)], "rec int, ch string, blk long, x array<double>")
    got = {r.rec: r.x for r in filtering.clean(df, 500.0).collect()}
    assert set(got) == {1, 4} and len(got[1]) == 2 and len(got[4]) == 20


def test_blocks_join_up(spark):
    x = np.random.default_rng(1).normal(size=4000).cumsum()
    signal = spark.createDataFrame([(1, "a", t, float(v)) for t, v in enumerate(x)], "rec int, ch string, t long, v double")
    whole = filtering.clean(filtering.as_blocks(signal), 500.0, 5.0, 45.0).collect()
    parts = filtering.clean(filtering.as_blocks(signal, 1000, 800), 500.0, 5.0, 45.0, block=1000, margin=800).orderBy("blk").collect()
    joined = np.concatenate([r.x for r in parts])
    assert len(whole) == 1 and len(parts) == 4 and len(joined) == 2000 and np.abs(joined - whole[0].x).max() < 1e-3


def test_welch_by_segments(spark):
    x = np.random.default_rng(2).normal(size=(2, 700))
    signal = spark.createDataFrame([(1, str(c), t, float(v), len(row)) for c, row in enumerate([x[0], x[1, :100], x[1, :1]]) for t, v in enumerate(row)], "rec int, ch string, t long, v double, n long")
    got = {(r.ch, r.k): (r.f, r.density) for r in filtering.welch(signal, 250.0).collect()}
    for c, row in enumerate([x[0], x[1, :100], x[1, :1]]):
        f, p = filters.welch(row[None, :], 250.0)
        assert all(np.allclose(got[str(c), k], (f[k], p[0, k])) for k in range(len(f)))


def test_fusion_round_trip(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, f, float(rng.normal() + (i % 2 if f == 1 else 0)), i % 2) for i in range(200) for f in range(4)]
    values = spark.createDataFrame(rows, "id int, f int, v double, y int")
    fusion = selection.Fusion.fit(values, "id", "f", "v", "y", 2)
    fusion.save(str(tmp_path / "fusion"))
    again = selection.Fusion.load(spark, str(tmp_path / "fusion")).transform(values, "id", "f", "v")
    assert again.count() == 400 and again.where("place = 0").select("f").distinct().first()[0] == 1
    assert abs(again.where("place = 0").agg(F.stddev_pop("z")).first()[0] - 1) < 1e-9
    try:
        fusion.transform(values.where("f < 3"), "id", "f", "v")
        raise AssertionError("features are missing")
    except ValueError as e:
        assert "4 features" in str(e)


def test_mrmr_skips_copies(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 600)
    noise = rng.integers(0, 2, 600)
    columns = [np.where(rng.random(600) < 0.9, y, 1 - y), None, np.where(rng.random(600) < 0.8, y, 1 - y), noise]
    columns[1] = columns[0]
    rows = [(i, f, int(c[i]), int(y[i])) for f, c in enumerate(columns) for i in range(600)]
    binned = spark.createDataFrame(rows, "id int, f int, code int, y int")
    assert selection.mrmr(binned, "id", "f", "code", "y", 2) == [0, 2]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").cast("double").alias("v"))
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windows.windowed(stream, ["k"], "ts", "v", "20 seconds", "10 seconds").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = windows.windowed(rows, ["k"], "ts", "v", "20 seconds", "10 seconds")
    assert spark.table("w").exceptAll(want).count() == 0 and spark.table("w").count() == want.count()


def direct_resample(x, up, down):
    taps, half = filters.resample_taps(up, down), 10 * max(up, down)
    wide = np.zeros((len(x), x.shape[1] * up))
    wide[:, ::up] = x
    return np.stack([np.convolve(row, taps)[half : half + wide.shape[1]] for row in wide])[:, ::down]


@pytest.mark.parametrize(("up", "down"), [(3, 2), (2, 3), (1, 4), (5, 1), (125, 128), (7, 7), (4, 6)])
def test_resampling_by_phases(up, down):
    rng = np.random.default_rng(3)
    g = np.gcd(up, down)
    for n in (1, 2, 50, 1000):
        x = rng.normal(size=(2, n))
        got = filters.resample(x, up, down)
        assert got.shape[1] == -(-n * up // down)
        assert np.allclose(got, direct_resample(x, up // g, down // g) if up != down else x, atol=1e-9)
    assert np.allclose(filters.resample(x, 1, 4), filters.decimate(x, 4))


def test_overlap_save_equals_convolution():
    rng = np.random.default_rng(4)
    for n, m in ((10, 3), (5000, 101), (1, 5), (0, 5)):
        x, taps = rng.normal(size=(3, n)), rng.normal(size=m)
        want = np.stack([np.convolve(row, taps)[m // 2 : m // 2 + n] for row in x]) if n else x
        assert np.allclose(filters.overlap_save(x, taps, 256), want, atol=1e-9)


@pytest.mark.parametrize(("up", "down"), [(3, 2), (2, 5), (1, 2), (4, 1)])
def test_resampled_blocks_join_up(spark, up, down):
    x = np.random.default_rng(5).normal(size=(2, 333))
    rows = spark.createDataFrame([(1, c, t, float(v)) for c, n in ((0, 333), (1, 64), (2, 1)) for t, v in enumerate(x[c % 2, :n])], "rec int, ch int, t long, v double")
    got = filtering.resample(rows, up, down, 64).orderBy("ch", "blk").collect()
    for c, n in ((0, 333), (1, 64), (2, 1)):
        own = [r for r in got if r.ch == c]
        assert [r.first for r in own] == np.cumsum([0, *(len(r.x) for r in own[:-1])]).tolist()
        assert np.allclose(np.concatenate([r.x for r in own]), filters.resample(x[c % 2 : c % 2 + 1, :n], up, down)[0], atol=1e-9)
