"""Texts of several megabytes, longer than any slice that the operators work by, against plain re-computations."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from signalloom.llm import context_tree, fingerprints, long_matches, media, near_dedup, secret_scan, word_runs
from tests.llm.test_llm import brute_long_matches
from tests.llm.test_word_runs import facts


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(11)
    words = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(5000)])
    long = [str(w) for w in words[rng.integers(0, 5000, 380_000)]]  # about 2.5 MB
    near = long.copy()
    near[1000::9000] = ["changed"] * len(near[1000::9000])
    repeated = (long[:700] * 300)[:200_000]  # about 1.3 MB with a period of 700 words
    return {1: " ".join(long), 2: " ".join(near), 3: " ".join(repeated), 4: " ".join(long[5000:5300]), 5: 'x = "s3cr3tVal8xQ1" ' + " ".join(long[:200_000]) + "\npassword = x", 6: None}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(2)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_near_duplicates(docs, texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    got = by_id(near_dedup.near_duplicates(docs))
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert 100 * len(sets[1] & sets[2]) >= 85 * len(sets[1] | sets[2]) and got[2].component_id == 1
    assert [got[i].component_id for i in (1, 3, 4, 5, 6)] == [1, 3, 4, 5, 6]


def test_fingerprints(docs, texts):
    got = by_id(fingerprints.with_next(docs))
    plain = {i: t or "" for i, t in texts.items()}
    for i, k in ((1, 2), (3, 4), (6, 1)):
        half = len(plain[i]) // 2
        edited = plain[i][: len(plain[i]) - half] + plain[k][:half]
        assert got[i].n_chars == len(plain[i]) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[1].near_next > 0.9 and 0.3 < got[1].near_edited <= 1


def test_long_matches(spark, docs, texts):
    # Sets of all 50-byte strings of whole texts: a third of the longest ones is what memory allows the plain way.
    few = {i: (t or "")[: 800_000] for i, t in texts.items()}
    rows = spark.createDataFrame(list(few.items()), "doc_id long, text string").repartition(2)
    assert {i: tuple(r)[1:] for i, r in by_id(long_matches.remove_repeats(rows)).items()} == brute_long_matches(few)
    whole = by_id(long_matches.remove_repeats(docs))
    assert whole[4].n_removed == len(texts[4]) and whole[1].n_removed == 0 and whole[2].n_removed > 0.95 * len(texts[2])


def test_context_tree_baseline(docs, texts):
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None] for i, t in texts.items()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, ws in words.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, r in by_id(context_tree.score(docs)).items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words[i]), sum(c[w] > 0 for w in words[i]), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words[i]), rel_tol=1e-9)
        assert r.score < 0 and (i in (3, 6) or r.score > r.base_score)


def test_context_tree_counts_grams_in_little_memory():
    rng = np.random.default_rng(11)
    words = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(20_000)])
    rows = [" ".join(words[rng.integers(0, len(words), 2_000)]).encode() + b"\xff" for _ in range(500)]
    body, end = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([len(r) for r in rows])
    start, out = np.r_[0, end[:-1]], np.arange(500) % 7 == 2
    tracemalloc.start()
    keys, n = context_tree.chunk_grams(body, start, end, out)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * len(body)
    every = context_tree.grams(body, start, end)
    want, inverse = np.unique(every, return_inverse=True)
    assert np.array_equal(keys, want) and np.array_equal(n, np.bincount(inverse, ~np.repeat(out, end - start)).astype(np.int64))


def test_runs_secrets_and_media(docs, texts):
    runs = by_id(word_runs.summary(docs))
    for i in (4, 6):
        assert tuple(runs[i]) == facts(i, texts[i])
    found = by_id(word_runs.collapse(docs))
    assert [tuple(r) for r in found[3].runs] == [(0, 200_000, 700)] and found[3].text == " ".join(texts[3].split()[:700])
    assert secret_scan.summary(docs).where("doc_id = 5").first().spans == "literal:5:18"
    assert by_id(media.features(docs))[1].n_bytes == len(texts[1])
