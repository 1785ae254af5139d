"""Runs of words against brute force over all periods."""

import hashlib
import re
import zlib
from collections import defaultdict
from fractions import Fraction
from itertools import count

import numpy as np
import pytest

from signalloom.llm import word_runs

SF = "/root/testdata/sf0.001"


def brute(words, least=24, times=3):
    """All runs, by comparing the words with themselves one period on."""
    code = {}
    w, out = np.array([code.setdefault(x, len(code)) for x in words], int), []
    for q in range(1, len(w) // times + 1):
        edge = np.diff(np.r_[0, (w[q:] == w[:-q]).astype(int), 0])
        out += [(int(a), int(b - a + q), q) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True) if b - a + q >= max(least, times * q)]
    smallest = lambda r: not any(o[2] < r[2] and o[0] <= r[0] and sum(r[:2]) <= sum(o[:2]) for o in out)
    return sorted((r for r in out if smallest(r)), key=lambda r: (r[0], r[2]))


def facts(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("least,times", [(24, 3), (6, 2), (5, 4), (2, 2)])
def test_runs_equal_brute_force(monkeypatch, least, times):
    monkeypatch.setattr(word_runs, "BLOCK", 8)
    rng = np.random.default_rng(least)
    texts = []
    for _ in range(400):
        words = []
        for _ in range(rng.integers(1, 5)):
            unit = rng.integers(0, rng.integers(1, 6), rng.integers(1, 16)).tolist()
            words += (unit * int(rng.integers(1, 9)))[: rng.integers(1, 90)] + rng.integers(0, 3, rng.integers(0, 4)).tolist()
        texts.append([str(w).encode() for w in words])
    want = [brute(t, least, times) for t in texts]
    assert [word_runs.find_runs([int(w) for w in t], least, times) for t in texts] == want
    # Only stretches go through an automaton, and lose nothing.
    numbers = defaultdict(count().__next__)
    assert [sorted(r, key=lambda r: (r[0], r[2])) for r in word_runs.text_runs(texts, numbers, least, times)] == want
    assert least < 24 or any(r for r in want)


def test_automaton_counts_substrings():
    rng = np.random.default_rng(2)
    for size in (0, 1, 7, 60):
        words = rng.integers(0, 3, size).tolist()
        length, link, state = word_runs.automaton(words)
        assert sum(length[v] - length[link[v]] for v in range(1, len(length))) == len({tuple(words[a:b]) for a in range(size) for b in range(a + 1, size + 1)})
        assert [length[s] for s in state] == list(range(1, size + 1))


def test_grams_come_again_in_every_run():
    for least, times in ((24, 3), (6, 2), (5, 4), (2, 2), (50, 3)):
        assert word_runs.gram_of(least, times) == min(max(least, times * q) - q for q in range(1, 200))


def test_no_automaton_where_nothing_repeats_near():
    words = np.arange(5000)
    row = np.zeros(5000, np.int64)
    assert word_runs.stretches(words, row) == []
    words[4000:4100] = words[100:200]  # a passage said twice, far apart
    assert word_runs.stretches(words, row) == []
    words[2000:2050] = 7
    assert word_runs.stretches(words, row) == [(2000, 2050)]


def test_long_texts_stay_cheap():
    rng = np.random.default_rng(3)
    assert word_runs.find_runs([1] * 300_000) == [(0, 300_000, 1)]
    unit = rng.integers(0, 900, 20_000).tolist()
    assert word_runs.find_runs(unit * 10) == [(0, 200_000, 20_000)]
    lines = [x for _ in range(4000) for x in [*range(18), int(rng.integers(0, 50))]]
    assert word_runs.find_runs(lines) == brute(lines)


def test_summary_of_the_smallest_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in word_runs.summary(docs).collect()}
    assert got == {r.doc_id: facts(r.doc_id, r.text) for r in docs.collect()}
    assert sum(r[1] > 0 for r in got.values()) > 5


def test_summary_of_odd_rows(spark):
    texts = [None, "", " \t\r\n", "one", "ab " * 23, "ab " * 24, "Ünï 文字\x0b" * 40, "a b " * 30, "x y " * 9 + "z " + "x y " * 40, ("l" * 5000 + " ") * 30, " ".join(map(str, range(3000))) + " p q r" * 20_000]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "k " * 30, None, None), (8, texts[8], "", 2)] + [(i, "m n o p " * 50, "", 0) for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int").repartition(3)
    got = sorted(tuple(-1 if x is None else x for x in r) for r in word_runs.summary(docs).collect())
    assert got == sorted(tuple(-1 if x is None else x for x in facts(i, t)) for i, t, *_ in rows)
    assert word_runs.summary(docs.limit(0)).count() == 0
    plain = {r.doc_id: r for r in word_runs.collapse(docs.where("doc_id = 5")).collect()}
    assert plain[5].text == "ab" and [tuple(r) for r in plain[5].runs] == [(0, 24, 1)]
