"""A planted fault is found where it lies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.sources import decoder_check as dc
from signalloom.sources import ranges as rg
from signalloom.sources import recordings as rec


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(1)
    v = np.cumsum(rng.integers(-90, 90, (400, 9)), 0)
    v[50, 2] += 90_000
    return v


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory, values):
    at = tmp_path_factory.mktemp("check")
    (at / "a.erd").write_bytes(rec.encode(values, 250.0))
    grouped = bytearray(rec.header(2, 10.0))
    where = rec.HEAD + 16 + 4096 + 92 + 4 + 2048
    np.frombuffer(memoryview(grouped)[where : where + 4], "<i2")[:] = [2, 50]
    (at / "g.erd").write_bytes(bytes(grouped) + bytes([0, 1, 0, 5]) + bytes([0, 32, 0, 7]) + bytes([0, 128, 0, 1, 1]))
    return rg.index(spark, str(at), 64).cache()


def test_both_decoders_agree(index, values):
    one, two = dc.packet_table(index), dc.packet_table(index, "plain")
    got = {r.path.rsplit("/", 1)[-1]: r for r in dc.compare(one, two).collect()}
    assert {k: (r.n_packets, r.first_kind) for k, r in got.items()} == {"a.erd": (400, None), "g.erd": (3, None)}
    rows = two.where("path like '%a.erd'").orderBy("packet").collect()
    assert np.array_equal([r["values"] for r in rows], values) and rows[-1].channels == list(range(9))


def test_planted_faults_are_located(index):
    one = dc.packet_table(index).where("path like '%a.erd'")
    for kind, change in (
        ("values", F.col("values")), ("end", F.col("values")), ("channels", F.col("values")),
    ):
        bad = F.col("packet").isin(123, 300)
        two = one.withColumn("values", F.when(bad & (F.lit(kind) == "values"), F.transform(change, lambda v: v + 1)).otherwise(change))
        two = two.withColumn("end", F.when(bad & (F.lit(kind) == "end"), F.col("end") + 1).otherwise(F.col("end")))
        two = two.withColumn("channels", F.when(bad & (F.lit(kind) == "channels"), F.slice("channels", 1, 3)).otherwise(F.col("channels")))
        r = dc.compare(one, two).first()
        assert (r.first_packet, r.first_kind) == (123, kind) and {"values": r.n_values, "end": r.n_ends, "channels": r.n_channels}[kind] == 2
    r = dc.compare(one, one.where("packet <> 7")).first()
    assert (r.n_missing, r.first_packet, r.first_kind, r.n_packets) == (1, 7, "missing", 400)


def test_figures_of_channels(spark, tmp_path):
    t = np.arange(1000) / 250
    v = np.rint(np.stack([1000 * np.sin(2 * np.pi * 10 * t), np.r_[np.zeros(500), np.full(500, 300)]], 1)).astype(int)
    (tmp_path / "s.erd").write_bytes(rec.encode(v, 250.0))
    got = {r.ch: r for r in dc.figures(rg.window(rg.index(spark, str(tmp_path), 300), 0.0)).collect()}
    x = ((v << 6) * rec.MICROVOLTS).T
    for c in (0, 1):
        assert got[c].n == 1000 and np.isclose(got[c].std, x[c].std(), rtol=1e-4) and np.isclose(got[c].ptp, np.ptp(x[c]), rtol=1e-5)
        assert np.isclose(got[c].mean_second, x[c, 500:].mean(), atol=1e-2) and np.isclose(got[c].std_first, x[c, :500].std(), atol=1e-2)
    assert got[0].alpha > 0.99
