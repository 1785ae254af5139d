"""Files of the European format, the way in by ending, and epochs kept with a manifest."""

import numpy as np
import pytest

from signalloom.sources import cache, edf, readers


def edf_bytes(samples, seconds=1.0):
    """Two channels: gain 0.5 and 2; ``samples`` is a list of (first, second) arrays, one pair a record."""
    n = [len(samples[0][0]), len(samples[0][1])]
    put = lambda x, w: str(x).encode().ljust(w)
    head = put(0, 8) + put("p", 80) + put("r", 80) + put("01.01.20", 8) + put("00.00.00", 8) + put(256 * 3, 8) + put("", 44) + put(len(samples), 8) + put(seconds, 8) + put(2, 4)
    fields = [(("A1", "B2"), 16), (("", ""), 80), (("uV", "uV"), 8), ((-50, -200), 8), ((50, 200), 8), ((-100, -100), 8), ((100, 100), 8), (("", ""), 80), (n, 8), (("", ""), 32)]
    head += b"".join(put(x, w) for pair, w in fields for x in pair)
    return head + b"".join(np.asarray(c, "<i2").tobytes() for record in samples for c in record)


def test_edf_files(spark, tmp_path):
    good = edf_bytes([([1, 2, 3, 4], [10, 20]), ([5, 6, 7, 8], [30, 40])])
    (tmp_path / "a.edf").write_bytes(good)
    (tmp_path / "cut.edf").write_bytes(good[:-4])
    (tmp_path / "bad.edf").write_bytes(b"no header")
    rows = {(r.record_id, r.ch): r for r in edf.scan(spark, str(tmp_path)).collect()}
    assert rows["a", 0].x == [0.5 * k for k in range(1, 9)] and rows["a", 1].x == [20.0, 40.0, 60.0, 80.0]
    assert rows["a", 0].sfreq == 4.0 and rows["a", 1].sfreq == 2.0 and len(rows["cut", 0].x) == 4
    assert "header" in rows["bad", None].error
    assert {(r.record_id, r.n_channels, r.n_samples, r.seconds) for r in readers.lengths(readers.scan(spark, str(tmp_path), "edf")).collect()} == {("a", 2, 8, 2.0), ("cut", 2, 4, 1.0)}
    assert readers.scan(spark, str(tmp_path), "EDF", "1").where("error is null").select("ch").distinct().collect()[0].ch == 1


def test_channel_lists_and_kinds(spark):
    assert readers.channel_list("0-3, 7,2") == [0, 1, 2, 3, 7] and readers.channel_list(None) == list(range(19)) and readers.channel_list(" ", 2) == [0, 1]
    with pytest.raises(ValueError, match="xyz"):
        readers.scan(spark, "/nowhere", "xyz")


def test_epoch_cache(spark, tmp_path):
    folder = str(tmp_path / "cache")
    epochs = spark.createDataFrame([(r, e, "a", t, 1.0, "train" if r < 3 else "test") for r in range(4) for e in range(2) for t in range(3)], "rec int, ep int, ch string, t int, v double, split string")
    manifest = spark.createDataFrame([(0, "ok", 2, "train"), (1, "error", 2, "train"), (2, "skipped_exists", 0, "train"), (3, "ok", 2, "test")], "rec int, status string, n_epochs long, split string")
    cache.write_epochs(epochs, manifest, folder)
    got = cache.read_epochs(spark, folder, "train")
    assert {r.rec for r in got.collect()} == {0} and got.count() == 6
    assert cache.missing_records(spark.createDataFrame([(3,), (9,)], "rec int"), spark, folder).collect()[0].rec == 9
    assert {(r.split, r.status, r.n_epochs) for r in cache.cache_summary(spark, folder).collect()} == {("train", "ok", 2), ("train", "error", 2), ("train", "skipped_exists", 0), ("test", "ok", 2)}
    with pytest.raises(ValueError, match="3 rows beside 4"):
        cache.same_count(manifest.limit(3), manifest, "records")
    cache.write_csv(manifest, str(tmp_path / "csv"), ["status", "more", "rec"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["status", "more", "rec"]
