"""Operator 12: periodic runs of words by a suffix automaton, and texts with each run written once.

A run is a stretch of consecutive words with smallest period q, at least ``least`` words and ``times`` periods long, that
no neighbouring word extends. A text's words go through a suffix automaton. The sets of end positions of its states
are ordered and merged from the longest states to the shortest, the smaller set into the larger. Two ends that become
neighbours in the set of a state agree in exactly as many words before them as the state is long. Where their
distance d is no more than that length they close a square; at ``(times - 1) * d`` words or more, d is also the smallest
period. Such a seed reaches to the left as far as the state's length says, and it is the end of a run where the next
words differ, so each run comes from one seed: that at its last word.

Every window of ``gram`` words inside a run comes again one period away, for ``gram`` as ``gram_of`` gives it. So only stretches
that windows with an equal one near enough cover can hold a run, and only they go through an automaton; states shorter than
``gram`` can't seed one, and their sets are never merged. Windows are compared by 64-bit hashes of exact word
numbers: equal windows are never missed, and a false match only sends a stretch through the automaton in vain.

A text is one task's work, linear in time but for the ordered sets; memory is some 300 bytes for each word in a stretch.

Edge cases: null, empty and blank texts have no words, no runs, and the empty text. Repeated rows give repeated rows, and a null
``doc_id`` stays null. Words are split at blanks and the bytes 9 to 13, and are joined by one blank. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.llm import text_arrays as ta

LEAST, TIMES = 24, 3
#: Entries of a block of an ordered set.
BLOCK = 2048
#: A task forgets word numbers beyond so many; they need to hold within one slice of texts only.
MOST_NUMBERS = 1 << 20
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
Edit = Callable[[int | None, list[bytes]], list[bytes]]


def gram_of(least: int, times: int) -> int:
    """Words that every run of any period has again one period away: the least of (length - period)."""
    q = least // times
    return min(least - q, (times - 1) * (q + 1)) if q else times - 1


class Ends:
    """An ordered set of end positions in blocks, kept from the last to the first."""

    __slots__ = ("blocks", "heads", "size")

    def __init__(self, end: int):
        self.blocks, self.heads, self.size = [[-end]], [-end], 1

    def _block(self, x: int) -> int:
        k = bisect_left(self.heads, x)
        return k if k < len(self.heads) and self.heads[k] == x else max(0, k - 1)

    def add(self, end: int) -> None:
        k = self._block(-end)
        block = self.blocks[k]
        insort(block, -end)
        self.heads[k] = block[0]
        self.size += 1
        if len(block) > BLOCK:
            self.blocks[k : k + 1] = [block[: BLOCK // 2], block[BLOCK // 2 :]]
            self.heads[k : k + 1] = [block[0], block[BLOCK // 2]]

    def around(self, end: int) -> tuple[int | None, int | None]:
        """The ends next before and after one of the set."""
        k = self._block(-end)
        block = self.blocks[k]
        i = bisect_left(block, -end)
        after = block[i - 1] if i else self.blocks[k - 1][-1] if k else None
        before = block[i + 1] if i + 1 < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else None
        return None if before is None else -before, None if after is None else -after

    def __iter__(self) -> Iterator[int]:
        return (-x for block in self.blocks for x in block)


def automaton(words: list[int]) -> tuple[array, array, array]:
    """Length and link of each state, and the state of each prefix.

    Most states go on with one word only, which is held in flat arrays; dictionaries hold the others'.
    """
    length, link, one, to, state = array("i", [0]), array("i", [-1]), array("q", [-1]), array("i", [0]), array("i")
    more: dict[int, dict[int, int]] = {}
    last = 0
    for c in words:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        one.append(-1)
        to.append(0)
        p = last
        q = -1
        while p >= 0:
            if one[p] == c:
                q = to[p]
                break
            rest = more.get(p)
            if rest is not None and c in rest:
                q = rest[c]
                break
            if one[p] < 0:
                one[p], to[p] = c, new
            elif rest is None:
                more[p] = {c: new}
            else:
                rest[c] = new
            p = link[p]
        if q >= 0:
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                one.append(one[q])
                to.append(to[q])
                if q in more:
                    more[twin] = dict(more[q])
                while p >= 0:
                    if one[p] == c:
                        if to[p] != q:
                            break
                        to[p] = twin
                    else:
                        rest = more.get(p)
                        if rest is None or rest.get(c) != q:
                            break
                        rest[c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
        state.append(new)
    return length, link, state


def find_runs(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start, then period."""
    need, n = gram_of(least, times), len(words)
    if n < least:
        return []
    length, link, state = automaton(words)
    size, up = np.frombuffer(length, np.int32), np.frombuffer(link, np.int32)
    # States whose sets matter, the longest first: those with states of ``need`` words or more below or above them.
    long = np.flatnonzero(size >= need)
    merged = long[size[up[long]] >= need]
    own = {s: e for e, s in enumerate(state) if size[s] >= need}
    order = np.union1d(merged, up[merged])
    sets: dict[int, Ends] = {}
    fresh: dict[int, list[int]] = {}
    found = []
    for v in order[np.argsort(-size[order], kind="stable")].tolist():
        ends, new = sets.pop(v, None), fresh.pop(v, [])
        if v in own:
            if ends is None:
                ends = Ends(own[v])
            else:
                ends.add(own[v])
                new.append(own[v])
        for e in new:
            before, after = ends.around(e)
            for a, b in ((before, e), (e, after)):
                if a is None or b is None:
                    continue
                d, has = b - a, length[v]
                if has < (times - 1) * d or has + d < least or (b + 1 < n and words[b + 1] == words[a + 1]):
                    continue
                # Two ends of the smaller set were neighbours before, in a longer state.
                if a < has or words[a - has] != words[b - has]:
                    found.append((a - has + 1, has + d, d))
        u = link[v]
        if length[u] < need:
            continue
        if (other := sets.get(u)) is None:
            sets[u] = ends
            continue
        if other.size < ends.size:
            ends, other = other, ends
        for e in ends:
            other.add(e)
        sets[u] = other
        fresh.setdefault(u, []).extend(ends)
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray, row: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Begin and end of the stretches that can hold runs, among the numbered words of many texts."""
    m = gram_of(least, times)
    if len(codes) < least:
        return []
    at = np.flatnonzero(row[: len(row) - m + 1] == row[m - 1 :])
    key = ta.span_hash(ta.prefix_code(ta.mix(codes.astype(np.uint64) + ta.U(1))), at, at + m) ^ ta.mix(row[at].astype(np.uint64))
    ranked = np.sort(key)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(twice):
        return []
    there = twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key
    at, key = at[there], key[there]
    order = np.argsort(key, kind="stable")
    gap = np.where(key[order][1:] == key[order][:-1], np.diff(at[order]), np.iinfo(np.int64).max)
    near = np.empty(len(at), np.int64)
    near[order] = np.minimum(np.r_[np.iinfo(np.int64).max, gap], np.r_[gap, np.iinfo(np.int64).max])
    while len(at):
        first = np.r_[True, (at[1:] > at[:-1] + m) | (row[at[1:]] != row[at[:-1]])]
        begin = at[first]
        end = at[np.r_[first[1:], True]] + m
        long = (end - begin)[np.cumsum(first) - 1]
        stay = (near <= long // times) & (long >= least)
        if stay.all():
            return list(zip(begin.tolist(), end.tolist(), strict=True))
        at, near = at[stay], near[stay]
    return []


def text_runs(texts: list[list[bytes]], numbers: dict[bytes, int], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, given as words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    size = np.array([len(t) for t in texts])
    codes = np.fromiter((numbers[w] for t in texts for w in t), np.int64, size.sum())
    begin = np.cumsum(size) - size
    row = np.repeat(np.arange(len(texts)), size)
    for a, b in stretches(codes, row, least, times):
        off = a - int(begin[row[a]])
        out[row[a]] += [(s + off, n, q) for s, n, q in find_runs(codes[a:b].tolist(), least, times)]
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        edge[s + q] += 1
        edge[s + n] -= 1
    return list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))


def collapse(docs: DataFrame, least: int = LEAST, times: int = TIMES, edit: Edit | None = None) -> DataFrame:
    """doc_id, ``runs`` by start and period, and ``text``: the kept words, joined by blanks.

    ``edit`` changes a text's words, given with their doc_id, before the search; it keeps their bound in size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, raw, offsets in ta.slices(batch.column(1)):
                whole = raw.tobytes()
                texts = [whole[offsets[i] : offsets[i + 1]].split() for i in range(b - a)]
                if edit:
                    texts = [edit(ids[a + i], t) for i, t in enumerate(texts)]
                if len(numbers) > MOST_NUMBERS:
                    numbers = defaultdict(count().__next__)
                found = text_runs(texts, numbers, least, times)
                short = [b" ".join(kept_words(t, r)) for t, r in zip(texts, found, strict=True)]
                said = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(said, kind), pa.array(short, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "text"])
        ta.release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs {RUN}, text string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten, by the crc32 of its id, with a tail that repeats its own beginning; the others as they are."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def best(runs: str = "runs") -> Column:
    """The run with the most periods; the first of those."""

    def order(x: Column, y: Column) -> Column:
        periods = y["length"] * x["period"] - x["length"] * y["period"]
        return F.signum(F.coalesce(F.nullif(periods, F.lit(0)), F.nullif(x["start"] - y["start"], F.lit(0)), x["period"] - y["period"])).cast("int")

    return F.try_element_at(F.array_sort(runs, order), F.lit(1))


def summary(docs: DataFrame, edit: Edit | None = planted) -> DataFrame:
    """Number, best one and digests of each text's runs, and the digest of its collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    found = collapse(docs, edit=edit).select("doc_id", F.size("runs").cast("long").alias("n_runs"), best().alias("r"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "r.start", "r.length", "r.period", F.expr("r.length * 1000 div r.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
