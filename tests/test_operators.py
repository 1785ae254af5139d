"""Hand-made rows with known results."""

import pytest
from pyspark.sql import functions as F

from signalloom.operators import epochs, evaluation, fusion, linkage


def test_epoch_counts(spark):
    signal = lambda n: spark.range(n).select(F.lit(1).alias("rec"), F.lit("a").alias("ch"), F.col("id").alias("t"), F.lit(0.5).alias("v"), F.lit(n).alias("n"))
    assert epochs.epoch_rows(signal(1000), 500, 250).select("ep").distinct().count() == 3
    assert epochs.epoch_rows(signal(499), 500, 250).count() == 0


def test_constant_channel(spark):
    signal = spark.range(200).select(F.lit(1).alias("rec"), F.lit("a").alias("ch"), F.col("id").alias("t"), F.lit(3.0).alias("v"), F.lit(200).alias("n"))
    assert epochs.snr(signal).first().snr_db == -10
    row = epochs.time_features(epochs.epoch_rows(signal)).first()
    assert row.skew is None and row.std == 0


@pytest.mark.parametrize(("snr", "art", "level"), [(10.0, 0.0, "medium"), (10.01, 0.0, "high"), (5.0, 0.0, "medium"), (4.99, 0.0, "low"), (20.0, 0.31, "low"), (None, 0.0, "medium")])
def test_quality_level(spark, snr, art, level):
    df = spark.createDataFrame([(snr, art)], "s double, a double")
    assert df.select(epochs.quality_level(F.col("s"), F.col("a"))).first()[0] == level


@pytest.mark.parametrize(("b", "c", "p"), [(2, 0, 0.5), (0, 1, 1.0), (10, 8, 0.8145), (0, 0, 1.0)])
def test_mcnemar(spark, b, c, p):
    pairs = spark.createDataFrame([(True, False)] * b + [(False, True)] * c + [(True, True)] * 3, "first boolean, second boolean")
    assert round(evaluation.mcnemar(pairs).first().p, 4) == p


def test_auc_of_ties_and_empty_class(spark):
    ties = spark.createDataFrame([(1, True, 0.5), (1, False, 0.5), (2, True, 0.5)], "k int, pos boolean, s double")
    assert {r.k: r.auc for r in evaluation.auc(ties, ["k"]).collect()} == {1: 0.5, 2: 0.5}


def test_equal_bins(spark):
    values = spark.range(11).select(F.lit(1).alias("k"), F.col("id").alias("x"), F.col("id").alias("o"))
    assert [r.bin for r in evaluation.equal_bins(values, ["k"], "x", "o").orderBy("x").collect()] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9]


def test_accuracy_weights(spark):
    acc = spark.createDataFrame([(0, 0.6083), (1, 0.6), (2, 0.5417), (3, 0.5542)], "agent int, acc double")
    got = {r.agent: round(r.w, 4) for r in fusion.accuracy_weights(acc, 133 / 240).collect()}
    assert got == {0: 0.4923, 1: 0.4168, 2: 0.0455, 3: 0.0455}


def test_codes_names_dates(spark):
    codes = spark.createDataFrame([("0",), ("1",), ("2",), ("9",), (None,)], "c string")
    assert [r[0] for r in codes.select(linkage.code_class(F.col("c"))).collect()] == [0, 2, 1, None, None]
    one = spark.createDataFrame([("A b~C-_.,\u3000\u00b7", "2020/03/04")], "n string, d string")
    assert one.select(linkage.normal_name(F.col("n"))).first()[0] == "abc"
    assert str(one.select(linkage.first_date(F.col("d"), ["yyyy-MM-dd", "yyyy/MM/dd"])).first()[0]) == "2020-03-04"


@pytest.mark.parametrize(("project", "raw", "gap", "want"), [(0, 2, 3, (0, "project", 1)), (0, 2, 8, (2, "raw_index", 1)), (0, None, 8, (0, "project", 0)), (None, None, None, (None, "none", 0))])
def test_merge_labels(spark, project, raw, gap, want):
    df = spark.createDataFrame([(project, raw, gap)], "p int, r int, g int")
    assert tuple(df.select(*linkage.merge_labels(F.col("p"), F.col("r"), F.col("g"))).first()) == want


def test_nearest_prefers_close_then_first(spark):
    left = spark.createDataFrame([(1, 10, "2020-01-05"), (2, 20, "2020-01-05")], "k int, id int, d string").withColumn("d", F.to_date("d"))
    right = spark.createDataFrame([(1, 7, "2020-01-03"), (1, 8, "2020-01-10"), (1, 9, None), (2, 5, "2020-01-03"), (2, 4, "2020-01-07")], "k int, e int, t string").withColumn("t", F.to_date("t"))
    got = {r.id: (r.gap, r.e) for r in linkage.nearest(left, right, ["k"], "id", "d", "t", "e").collect()}
    assert got == {10: (2, 7), 20: (2, 4)}


def test_nearest_equals_all_pairs(spark):
    import datetime
    import random

    rnd = random.Random(3)
    day = lambda: None if rnd.random() < 0.15 else datetime.date(2020, 1, 1) + datetime.timedelta(days=rnd.randrange(40))
    left = [(rnd.randrange(6), i, day()) for i in range(120)]
    right = [(rnd.randrange(5), i, day()) for i in range(60)]
    df = linkage.nearest(spark.createDataFrame(left, "k int, id int, d date"), spark.createDataFrame(right, "k int, e int, t date"), ["k"], "id", "d", "t", "e")
    got = {r.id: (r.gap, r.e) for r in df.collect()}
    for k, i, d in left:
        rank = sorted((gap is None, gap or 0, e, gap) for q, e, t in right if q == k for gap in [abs((d - t).days) if d and t else None])
        assert got[i] == ((rank[0][3], rank[0][2]) if rank else (None, None)), (k, i, d)


def test_fuzzy_equals_all_pairs(spark):
    import datetime
    import difflib
    import random

    rnd = random.Random(4)
    name = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9)))
    days = [datetime.date(2020, 1, 1 + d) for d in range(3)]
    left = [(i, rnd.choice(days), name()) for i in range(40)]
    right = [(i, rnd.choice(days), name()) for i in range(60)]
    df = linkage.fuzzy(spark.createDataFrame(left, "id int, day date, key string"), spark.createDataFrame(right, "e int, day date, name string"), "id", "day", "key", "name", "e")
    got = {r.id: (r.ratio, r.e) for r in df.collect()}
    for i, day, key in left:
        found = [(-difflib.SequenceMatcher(None, key, n).ratio(), e) for e, d, n in right if d == day and len(n) >= 2]
        found = sorted(x for x in found if -x[0] >= 0.6)
        assert got.get(i) == ((-found[0][0], found[0][1]) if found else None)


def test_fuzzy_candidates_lose_no_pair(spark):
    import difflib
    import random

    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(0, 12))) for _ in range(150)]
    words += [w[:k] + "ü" + w[k:] for w in words[:60] for k in (0, len(w) // 2)]
    rows = spark.createDataFrame([(1, w, w) for w in words], "day int, key string, name string")
    for least in (0.6, 0.8, 1.0):
        met = linkage.candidates(rows, rows, "day", "key", "name", least).collect()
        pairs = {(r.key, r.name) for r in met}
        assert len(met) == len(pairs) < len(set(words)) ** 2 / 4
        assert all((a, b) in pairs for a in set(words) for b in set(words) if a and b and difflib.SequenceMatcher(None, a, b).ratio() >= least)


def test_closest_names_equal_all_pairs():
    import difflib
    import random

    rnd = random.Random(6)
    for trial in range(120):
        letters, longest = rnd.choice(["ab", "abc0", "0123456789", "aäöß漢\0"]), (6, 20, 150, 400)[trial % 4]
        word = lambda lo: rnd.choice(["", "customer#000"]) + "".join(rnd.choice(letters) for _ in range(rnd.randrange(lo, longest)))  # noqa: B023, E731
        keys, names, least = list({word(0) for _ in range(9)}), list(dict.fromkeys(word(2) for _ in range(25))), rnd.choice([0.3, 0.6, 0.9])
        got = {k: (n, r) for k, n, r in linkage.closest(keys, names, least)}
        for i, key in enumerate(keys):
            ratios = [(-difflib.SequenceMatcher(None, key, n).ratio(), j) for j, n in enumerate(names)]
            found = min((x for x in ratios if -x[0] >= least), default=None)
            assert got.get(i) == ((found[1], -found[0]) if found else None)
    assert linkage.closest(["a"], [], 0.6) == []
    assert linkage.closest(["a" * 300], ["b" * 300, "a" * 299 + "b"], 0.6)[0][:2] == (0, 1)


def test_few_names_of_like_letters_are_compared(monkeypatch):
    import difflib

    calls, ratio = [], difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: (calls.append(1), ratio(self))[1])
    keys, names = [f"customer#{7 * i:09d}" for i in range(1, 300)], [f"customer#{11 * i:09d}" for i in range(3000)]
    assert len(linkage.closest(keys, names, 0.6)) == 299
    assert len(calls) < 20 * len(keys)  # of 3000 each


def test_fuzzy_in_blocks_equals_all_pairs(spark, monkeypatch):
    import datetime
    import difflib
    import random

    monkeypatch.setattr(linkage, "KEYS", 5)
    monkeypatch.setattr(linkage, "NAMES", 7)
    rnd = random.Random(8)
    name = lambda: "".join(rnd.choice("01") for _ in range(rnd.randrange(1, 9)))
    days = [datetime.date(2020, 1, 1 + d) for d in range(2)]
    left = [(i, rnd.choice([*days, None]), rnd.choice([name(), None])) for i in range(60)]
    right = [(str(i), rnd.choice([*days, None]), rnd.choice([name(), name(), None])) for i in range(90)]
    df = linkage.fuzzy(spark.createDataFrame(left, "id int, day date, key string"), spark.createDataFrame(right, "e string, day date, name string"), "id", "day", "key", "name", "e")
    got = {r.id: (r.ratio, r.e, r.name) for r in df.collect()}
    for i, day, key in left:
        found = [(-difflib.SequenceMatcher(None, key, n).ratio(), e, n) for e, d, n in right if day and key is not None and d == day and n and len(n) >= 2]
        found = sorted(x for x in found if -x[0] >= 0.6)
        assert got.get(i) == ((-found[0][0], *found[0][1:]) if found else None)


def test_hashes_of_large_keys(spark):
    keys = [0, 1, 5, 2**31, 2**32 + 7, 10**10, 9 * 10**18, -3]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", evaluation.hashed(F.col("k")).alias("h")).collect()
    assert all(r.h == (r.k % 2**32) * 2654435761 % 2**32 for r in got)


def test_flat_and_short_records(spark):
    rows = [(1, "a", t, 3.0) for t in range(20)] + [(1, "b", t, float(t % 7)) for t in range(20)] + [(2, "a", t, 1.0) for t in range(3)]
    signal = spark.createDataFrame(rows, "rec int, ch string, t long, v double")
    got = {r.rec: r.artifact_ratio for r in epochs.artifact_ratio(signal, 100.0).collect()}
    assert abs(got[1] - 0.2 * 0.5) < 1e-9 and got[2] == 1.0


def test_second_round_keeps_the_feature_model(spark):
    first = [(1, 0, 0, a, c, p) for a in range(2) for c, p in enumerate((0.6, 0.3, 0.1))]
    other = [(1, 0, 0, a, c, p) for a in range(2) for c, p in enumerate((0.0, 0.0, 1.0))]
    kind = "id int, subject int, y int, agent int, c int, p double"
    a, b = spark.createDataFrame(first, kind), spark.createDataFrame(other, kind)
    got = {(r.agent, r.c): r.p for r in fusion.second_opinion(a, b).collect()}
    assert got[0, 0] == 0.6 and abs(got[1, 2] - 0.55) < 1e-6
    levels = spark.createDataFrame([(1, "low")], "id int, level string")
    cred = {r.agent: r for r in fusion.credibility(fusion.second_opinion(a, b), a, levels).collect()}
    assert cred[0].gain == 0 and cred[0].fit == 1.0 and cred[1].fit == 0.8 and cred[1].cred < cred[0].cred
