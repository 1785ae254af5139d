"""Plain re-computations of what the numbered operators vectorise, their SQL, and the pipeline's stages on odd tables."""

import math
import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.llm import context_tree, fingerprints, media, queries, quality
from signalloom.llm import text_arrays as ta

SF = "/root/testdata/sf0.001"
TEXTS = ["The river runs past the mill and the town the the 42!", "Click HERE now!! buy buy $$$ 10", "", "a", "It's a b c d e f g Ünï 文字 x"]


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)


def test_quality_features_are_n_grams():
    raw, offsets = flat(TEXTS)
    for i, t in enumerate(TEXTS):
        n = len(t.split())
        want = [n, max(0, n - 1), n, max(0, n - 1), max(0, n - 2), n]
        assert [int((row == i).sum()) for _, row in quality.features(raw, offsets)] == want
    alone = [quality.features(*flat([t])) for t in TEXTS]
    for k, (idx, row) in enumerate(quality.features(raw, offsets)):
        for i in range(len(TEXTS)):
            assert Counter(idx[row == i].tolist()) == Counter(alone[i][k][0].tolist())
    low, up = (quality.features(*flat([t]))[0][0].tolist() for t in ("some words", "SOME Words"))
    assert low == up


def test_quality_updates_equal_plain_ones():
    rng = np.random.default_rng(0)
    rows = [(np.sort(rng.choice(30, 6, replace=False)), rng.uniform(0.1, 2, 6)) for _ in range(40)]
    labels = rng.integers(0, 2, 40).astype(float)
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(3):
        for (idx, value), y in zip(rows, labels, strict=True):
            w = {i: weight(i) for i in idx.tolist()}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(idx.tolist(), value.tolist(), strict=True))))
            for i, v in zip(idx.tolist(), value.tolist(), strict=True):
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    got = quality.ftrl(rows, labels, 3)
    assert np.allclose(got[:30], [weight(i) for i in range(30)], rtol=1e-9, atol=1e-12) and not got[30:].any()


def test_quality_scores_equal_plain_ones():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=1 << quality.BITS)
    for i, got in enumerate(quality.margins(weights, 0.25, *flat(TEXTS))):
        own = [idx for idx, _ in quality.features(*flat([TEXTS[i]]))]
        assert math.isclose(got, 0.25 + sum(quality.SCALE * weights[x].mean() for x in own if len(x)), rel_tol=1e-9, abs_tol=1e-12)


def test_syncmers_equal_plain_ones():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcd "), 300)), "ab" * 60, "x" * 30, "short", "", "y" * 24]
    up, _ = ta.powers(400)
    raw, offsets = flat(texts)
    code, at, row = fingerprints.anchors(raw, offsets)
    for i, t in enumerate(texts):
        b = ta.BYTE_CODE[np.frombuffer(t.encode(), np.uint8)]
        inner = [int(ta.mix(np.array([(b[p : p + fingerprints.S] * up[: fingerprints.S]).sum()], np.uint64))[0]) for p in range(len(t) - fingerprints.S + 1)]
        width = fingerprints.INNER
        want = [p for p in range(len(t) - fingerprints.K + 1) if min(inner[p : p + width]) in (inner[p], inner[p + width - 1])]
        assert at[row == i].tolist() == want
        by_text = {}
        for p, h in zip(want, code[row == i].tolist(), strict=True):
            assert by_text.setdefault(t[p : p + fingerprints.K], h) == h
        assert len(set(by_text.values())) == len(by_text)


def test_likeness_equals_a_plain_chain():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    parts = ["".join(rng.choice(list("abcdefgh "), 90)) for _ in range(5)]
    texts = [parts[0] + parts[1] + parts[2], parts[2] + parts[0] + parts[3] + parts[0], parts[4], parts[0] + parts[1] + parts[2], ""]
    prints = fingerprints.fingerprints(pa.array(texts))
    for x in prints:
        for y in prints:
            a, b = ([(int(h), int(p)) for p, h in zip(f[0], f[2], strict=True)] for f in (x, y))
            meet = [(p, dict(b)[h]) for h, p in a if h in dict(b)]
            meet.sort()
            chain = []
            for k, (_, q) in enumerate(meet):
                chain.append(1 + max((chain[j] for j in range(k) if meet[j][1] < q), default=0))
            union = len(a) + len(b) - len(meet)
            want = max(chain, default=0) / union if union else 1.0
            assert math.isclose(fingerprints.likeness(x, y), want)


def test_ranges_by_halving(spark):
    keys = spark.range(-5, 60).select("id")
    for bounds in ([], [0], [0, 7], list(range(-3, 40, 3))):
        got = keys.select("id", fingerprints._range_of(F.col("id"), bounds).alias("r")).collect()
        assert all(r.r == sum(b <= r.id for b in bounds) for r in got)


def test_spectra_and_pairs_equal_plain_ones():
    rng = np.random.default_rng(4)
    sounds = [media.payload(bytes(rng.integers(32, 127, n).astype(np.uint8))) for n in (0, 100, 500, 3000)] + [b" " * 1920]
    for sound in sounds:
        wave = np.frombuffer(sound, np.uint8).astype(float)
        frames = [wave[a : a + media.FRAME] for a in range(0, len(wave) - media.FRAME + 1, media.HOP)]
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(media.FRAME) / media.FRAME)
        plain = np.array([np.abs(np.fft.rfft((f - f[0]) * hann)[1:48]) ** 2 for f in frames])
        got = media.power(np.frombuffer(sound, np.uint8), media.HOP * np.arange(len(frames)))
        assert np.allclose(got / 2.0**40, plain, rtol=1e-4, atol=1e-2)
        peaks = []
        for zone in range(0, len(frames), media.ZONE):
            for lo, hi in media.BANDS:
                best = max((got[t, k - 1], -t, -k) for t in range(zone, min(zone + media.ZONE, len(frames))) for k in range(lo, hi))
                if best[0] > 0:
                    peaks.append((-best[1], -best[2]))
        peaks.sort()
        want = [(t << 18) | (f << 12) | (g << 6) | (u - t) for i, (t, f) in enumerate(peaks) for u, g in peaks[i + 1 : i + 1 + media.FAN] if u - t <= media.REACH]
        assert media.pairs([sound])[0] == want
    assert media.pairs(sounds) == [media.pairs([s])[0] for s in sounds]


def test_bits_per_byte(spark):
    docs = spark.createDataFrame([(i, "abcab " * (1 + i % 7)) for i in range(30)] + [(99, None)], "doc_id long, text string")
    for r in context_tree.score(docs).join(docs, "doc_id").collect():
        assert math.isclose(r.bits_per_byte, -r.score * math.log2(10) / (len(r.text or "") + 1), rel_tol=1e-5)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.sql(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{SF}/{table}'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted([tuple(str(r[c]) for c in columns) for r in got.collect()]) == sorted([tuple(str(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()])


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, _topic string, predicted int, kept boolean, label double"


def test_stages_on_odd_tables(spark):
    import corpus_pipeline as cp

    text = "The river runs past the mill and the town while seven wizards hum a tune. "
    rows = [(1, text, "en", "s", 9, 0.5, "t", 3, True, 1.0)] * 2 + [(None, text * 2, None, None, None, None, None, None, None, None), (3, None, None, None, None, None, None, None, None, None), (4, "", "en", "s", 0, 0.0, "", 0, False, 0.0), (5, "call +1 (305) 555-0188 " + "x" * 300_000, "fr", "s", 9, 1.0, "t", 1, True, 2.0)]
    docs, none = spark.createDataFrame(rows, ODD), spark.createDataFrame([], ODD)
    for name, stage in cp.STAGES[:-1]:
        for table in (docs, none):
            got = stage(spark, table, SF)
            assert got.columns == docs.columns, name
            assert got.count() <= table.count(), name
    assert cp.drop_near_duplicates(spark, docs, SF).where("doc_id is null").count() == 1
    assert cp.redact_personal_data(spark, docs, SF).where("text like '%<PHONE>%'").count() == 1
    tokens = cp.encode_tokens(spark, docs, SF)
    assert tokens.count() == 6 and tokens.where("doc_id in (3, 4) and n_tokens = 0").count() == 2 and cp.encode_tokens(spark, none, SF).count() == 0
