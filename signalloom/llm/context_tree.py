"""Operator 9: context-tree weighting over bytes, next to a word-count baseline.

A text, lower-cased, is read as bytes with an end mark after the last. Bytes are split into eight binary
decisions. The contexts of a byte are the last 0, 1, ... ``DEPTH`` bytes of its text, over word borders; end marks
stand before its first byte. Each context and decision has a Krichevsky-Trofimov estimate of its
training counts; context-tree weighting mixes the estimates of all depths, weighted by how well each depth coded
the training text. A context never seen leaves the choice to the shorter ones.

Nothing is hashed together: a byte with its six earlier ones is one number of 56 bits (a gram), and the grams of a
chunk of text with their training counts go, by the last two bytes of context, to pieces, as many as the bytes of
text ask for. A piece holds all nodes under its contexts and weighs them bottom-up, one decision at a time; what
depths 0 and 1 need of it (a row for each context of two bytes and next byte) is summed on the driver and sent back.
A second pass over the pieces gives each chunk the log probabilities of its grams. All of the training documents
are counted.

``repeats`` lets a text's own past help: a token (a word and the byte that ends it, the end mark too) may also be
repeated from the tokens before it in the text, or from what followed its predecessor there. Each of ``RATES`` has
fixed shares for both, a share without a past goes to the tree, and the texts' probabilities under all rates are
averaged. That stays a probability, and costs at most log10 of the number of rates where nothing is repeated. ``OWN``
of the weight is for bytes learnt from the text itself, where the tree takes over ``POOR`` bits a byte (bytes or
words unlike all training texts); elsewhere it is left unused.

The baseline needs the count of every word. A vocabulary of at most ``MOST_WORDS`` entries (16 bytes each, by a
count) is broadcast; a larger one is joined by shuffle, with the same result.

Edge cases: null and empty texts are one end token. Rows with a null doc_id train and aren't held out. With no
training rows every bit has probability one half and the baseline is 0. The baseline has one symbol for all unseen words,
while the score spells them, so on a few texts whose words are mostly unseen the score is the lower one. Repeated rows count again and give repeated rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.llm import text_arrays as ta
from signalloom.session import cut

DEPTH = 6
#: Bytes at a time; with an end mark a row they stay under what text_arrays keeps powers for.
SLICE = 3 << 18
#: Bytes of text that share one table of grams, and that there is a piece for.
CHUNK, PIECE = 16 << 20, 4 << 20
#: Bytes of context that send a gram to its piece.
ROUTE = 2
MOST_WORDS = 8_000_000
HELD_OUT_MOD, HELD_OUT = 7, 2
#: Weight of bytes learnt from the text itself, in texts that take more than so many bits a byte otherwise.
OWN, POOR = 1 / 6, 2.5
#: Shares of any earlier token of the text, and of those that followed the token before.
RATES = ((0.0, 0.0), (0.05, 0.02), (0.15, 0.05), (0.3, 0.3), (0.05, 0.9))
END = 255


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_OUT_MOD == HELD_OUT, F.lit(False))


def _small(numbers: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes, after how many they are."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _wide(blob: bytes, kind: str) -> np.ndarray:
    m, item = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob[8:], m * item, "zstd", asbytes=True), np.uint8).reshape(item, m)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _keys_of(blob: bytes) -> np.ndarray:
    return np.cumsum(_wide(blob, "<u8"), dtype=np.uint64)


def grams(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Each byte of adjoining rows with its context in one number: the DEPTH bytes before it, the nearest first, then the byte."""
    body, size = body[start[0] : end[-1]] if len(start) else body[:0], end - start
    into = np.minimum(np.arange(len(body)) - np.repeat(np.cumsum(size) - size, size), DEPTH).astype(np.uint8)
    gram = np.zeros((len(body), 8), np.uint8)
    gram[:, 0] = body
    for k in range(1, DEPTH + 1):
        before = np.full(len(body), END, np.uint8)
        before[k:] = np.where(into[k:] >= k, body[:-k], END)
        gram[:, DEPTH + 1 - k] = before
    return gram.view("<u8").ravel()


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of n."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _row_runs(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of rows of about SLICE bytes."""
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + SLICE, "right")))
        yield a, b
        a = b


def chunk_grams(body: np.ndarray, start: np.ndarray, end: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a chunk in order, and how often each stands in rows that aren't held out."""
    # One array for the whole chunk, sorted in place: a gram with the mark of held-out rows as its lowest bit.
    every = np.empty(int(end[-1] - start[0]), np.uint64)
    for a, b in _row_runs(start, end):
        part = every[start[a] - start[0] : end[b - 1] - start[0]]
        np.left_shift(grams(body, start[a:b], end[a:b]), ta.U(1), out=part)
        part |= np.repeat(out[a:b], end[a:b] - start[a:b])
    every.sort()
    new = np.ones(len(every), bool)
    for a in range(0, len(every) - 1, SLICE):
        b = min(a + SLICE, len(every) - 1)
        new[a + 1 : b + 1] = (every[a + 1 : b + 1] ^ every[a:b]) > ta.U(1)
    first = np.flatnonzero(new)
    del new
    learnt = np.bitwise_and(every.view(np.uint8)[::8], 1) ^ 1
    counts, step = np.empty(len(first), np.int64), 1 << 16
    for a in range(0, len(first), step):
        own = first[a : a + step + 1]
        last = own[step] if len(own) > step else len(every)
        counts[a : a + step] = np.add.reduceat(learnt[own[0] : last], own[:step] - own[0], dtype=np.int64)
    del learnt
    keys = every[first]
    keys >>= ta.U(1)
    return keys, counts


def piece_of(keys: np.ndarray, pieces: int) -> np.ndarray:
    return (ta.mix((keys >> ta.U(8 * (DEPTH + 1 - ROUTE))) + ta.U(1)) % ta.U(pieces)).astype(np.int64)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting small arguments up by eight."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift -= np.where(low, np.log(np.where(low, y, 1.0)), 0.0)
        y = np.where(low, y + 1, y)
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)


_HALVES, _WHOLES = (log_gamma(np.arange(1 << 12) + x) for x in (0.5, 1.0))


def _log_gamma_of(count: np.ndarray, table: np.ndarray, plus: float) -> np.ndarray:
    value = table[np.minimum(count, len(table) - 1)]
    large = np.flatnonzero(count >= len(table))
    value[large] = log_gamma(count[large] + plus)
    return value


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of counts."""
    return _log_gamma_of(zeros, _HALVES, 0.5) + _log_gamma_of(ones, _HALVES, 0.5) - _log_gamma_of(zeros + ones, _WHOLES, 1.0) - math.log(math.pi)


class Tree:
    """All nodes of sorted distinct grams with counts, from depth ``deep`` of the keys' contexts up to ``top``.

    A depth's table has one entry for each context and byte in use; the nodes of decision i are the runs of entries
    with one context and the same first i bits. Entries without counts are looked up only.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, deep: int, top: int):
        self.deep, self.top = deep, top
        self.keys, self.n, self.up = {deep: keys}, {deep: n}, {}
        for d in range(deep - 1, top - 1, -1):
            below = self.keys[d + 1]
            self.keys[d], self.up[d + 1] = np.unique((below >> ta.U(16)) << ta.U(8) | (below & ta.U(255)), return_inverse=True)
            self.n[d] = np.bincount(self.up[d + 1], self.n[d + 1], len(self.keys[d])).astype(np.int64)

    def decide(self, i: int, leaf: np.ndarray | None = None) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """By depth and entry the estimate of a one and its share (-1: never seen); first entry and log probability of the top's nodes.

        ``leaf`` holds the log probabilities of the deepest nodes where these have deeper ones of their own.
        """
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        first = whole = np.zeros(0)
        for d in range(self.deep, self.top - 1, -1):
            node = self.keys[d] >> ta.U(8 - i)
            new = np.r_[True, node[1:] != node[:-1]]
            run = np.cumsum(new) - 1
            m = int(run[-1]) + 1
            seen = np.bincount(run, self.n[d], m).astype(np.int64)
            ones = np.bincount(run, self.n[d] * ((self.keys[d] >> ta.U(7 - i)) & ta.U(1)).astype(np.int64), m).astype(np.int64)
            own = estimate(seen - ones, ones)
            if d == self.deep:
                total, share = own if leaf is None else leaf, np.ones(m)
            else:
                below = np.bincount(run[self.up[d + 1][first]], whole, m)
                total = np.logaddexp(own, below) - math.log(2)
                share = np.exp(own - math.log(2) - total)
            share = np.where(seen > 0, share, -1.0)
            found[d] = ((ones + 0.5) / (seen + 1))[run], share[run]
            first, whole = np.flatnonzero(new), total
        return found, first, whole

    def logs(self, shallow: tuple | None = None) -> np.ndarray:
        """log10 probability of each gram; ``shallow`` has the entries and values of the depths above the top."""
        at = {self.deep: np.arange(len(self.keys[self.deep]))}
        for d in range(self.deep - 1, self.top - 1, -1):
            at[d] = self.up[d + 1][at[d + 1]]
        byte = self.keys[self.deep] & ta.U(255)
        if shallow is not None:
            keys, values = shallow
            above = (self.keys[self.deep] >> ta.U(8 * (self.deep + 2 - self.top))) << ta.U(8) | byte
            spot = np.searchsorted(keys, above)
        total = np.zeros(len(byte))
        for i in range(8):
            found, _, _ = self.decide(i)
            steps = [(q[at[d]], w[at[d]]) for d, (q, w) in sorted(found.items(), reverse=True)]
            if shallow is not None:
                steps += [(q[spot], w[spot]) for q, w in values[i]]
            p, have = np.full(len(byte), 0.5), np.zeros(len(byte), bool)
            for q, w in steps:
                ok = w >= 0
                p = np.where(ok, np.where(have, w * q + (1 - w) * p, q), p)
                have |= ok
            total += np.log10(np.where((byte >> ta.U(7 - i)) & ta.U(1) == 1, p, 1 - p))
        return total


def train(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Grams and counts of a small table of texts (unit, n), which are collected."""
    table = counted.select("unit", "n").toArrow().combine_chunks()
    raw, offsets = ta.flat(table.column(0).chunk(0))
    weight = np.repeat(table.column(1).to_numpy(), np.diff(offsets))
    return _summed(grams(raw, offsets[:-1], offsets[1:]), weight)


def gram_logs(gram: np.ndarray, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 probability of each byte in its context, after counted grams; all in one piece."""
    keys, n = _summed(np.r_[keys, gram], np.r_[n, np.zeros(len(gram), np.int64)])
    return Tree(keys, n, DEPTH, 0).logs()[np.searchsorted(keys, gram)]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, held_out) as chunks of lower-cased bytes with an end mark after each row."""
    part, k = TaskContext.get().partitionId() << 32, 0
    ids, outs, bodies, ends, size = [], [], [], [], 0

    def done() -> pa.RecordBatch:
        columns = [pa.array([part + k]), pa.array([ids], pa.list_(pa.int64())), pa.array([outs], pa.list_(pa.bool_())), pa.array([np.concatenate(ends)], pa.list_(pa.int64())), pa.array([pa.compress(b"".join(bodies), "zstd", asbytes=True)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "outs", "ends", "body"])

    for batch in batches:
        for a, b, raw, offsets in ta.slices(batch.column(1), SLICE):
            if size and size + len(raw) > CHUNK:
                yield done()
                k += 1
                ids, outs, bodies, ends, size = [], [], [], [], 0
                ta.release()
            ids += batch.column(0).slice(a, b - a).to_pylist()
            outs += batch.column(2).slice(a, b - a).to_pylist()
            bodies.append(np.insert(ta.LOWER[raw], offsets[1:], END).tobytes())
            ends.append(offsets[1:] + np.arange(1, b - a + 1) + size)
            size += len(bodies[-1])
    if size:
        yield done()
    ta.release()


_PACKED = "chunk long, ids array<long>, outs array<boolean>, ends array<long>, body binary"


def _chunk(ends: pa.Scalar, body: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and start and end of each row."""
    end = ends.values.to_numpy()
    return np.frombuffer(pa.decompress(body.as_buffer(), int(end[-1]), "zstd"), np.uint8), np.r_[0, end[:-1]], end


def _requests(pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                body, start, end = _chunk(batch.column(3)[r], batch.column(4)[r])
                keys, n = chunk_grams(body, start, end, batch.column(2)[r].values.to_numpy(zero_copy_only=False))
                piece = piece_of(keys, pieces)
                order = np.argsort(piece, kind="stable")
                keys, n = keys[order], n[order].astype("<u4")
                own, first = np.unique(piece[order], return_index=True)
                cut_at = list(zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True))
                steps = [np.diff(keys[a:b], prepend=ta.U(0)) for a, b in cut_at]
                blobs = [pa.array([_small(x) for x in steps], pa.binary()), pa.array([_small(n[a:b]) for a, b in cut_at], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), batch.column(0)[r].as_py())), *blobs], names=["piece", "chunk", "grams", "n"])
                del keys, n, steps, blobs
                ta.release()

    return run


def _tree_of(table: pa.Table) -> tuple[Tree, list[np.ndarray]]:
    """The nodes of one piece, and the grams of each of its rows."""
    each = [_keys_of(x) for x in table["grams"].to_pylist()]
    n = np.concatenate([_wide(x, "<u4") for x in table["n"].to_pylist()]).astype(np.int64)
    return Tree(*_summed(np.concatenate(each), n), DEPTH, ROUTE), each


def _tops(table: pa.Table) -> pa.Table:
    """A piece's entries at depth ROUTE with their counts, and by decision the log probabilities of their nodes."""
    ta.release()  # what the group before has left
    tree, _ = _tree_of(table)
    wholes = [tree.decide(i)[2] for i in range(8)]
    firsts = [np.flatnonzero(np.r_[True, np.diff(tree.keys[ROUTE] >> ta.U(8 - i)) != 0]) for i in range(8)]
    filled = np.zeros((8, len(tree.keys[ROUTE])))
    for i in range(8):
        filled[i, firsts[i]] = wholes[i]
    return pa.table({"keys": [tree.keys[ROUTE].tobytes()], "n": [tree.n[ROUTE].tobytes()], "wholes": [np.ascontiguousarray(filled.T).tobytes()]})


def _shallow(tops: DataFrame) -> tuple[np.ndarray, list[list[tuple[np.ndarray, np.ndarray]]]]:
    """Entries of the greatest depth above ROUTE, and for each decision their values there and above."""
    found = tops.collect()
    keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["keys"], np.uint64) for r in found)])
    if len(keys) == 0:
        return keys, []
    order = np.argsort(keys)
    n = np.concatenate([np.frombuffer(r["n"], np.int64) for r in found])[order]
    filled = np.concatenate([np.frombuffer(r["wholes"]).reshape(-1, 8) for r in found])[order]
    tree, values = Tree(keys[order], n, ROUTE, 0), []
    for i in range(8):
        node = tree.keys[ROUTE] >> ta.U(8 - i)
        by_depth, _, _ = tree.decide(i, filled[np.r_[True, node[1:] != node[:-1]], i])
        at, own = np.arange(len(tree.keys[ROUTE - 1])), []
        for d in range(ROUTE - 1, -1, -1):
            own.append(tuple(x[at] for x in by_depth[d]))
            at = tree.up[d][at] if d else at
        values.append(own)
    return tree.keys[ROUTE - 1], values


def _tokens(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word with the byte that ends it; words may be empty."""
    end = np.flatnonzero(ta.SEPARATOR[own] | (own == END)) + 1
    return np.r_[0, end[:-1]], end


def _row_words(body: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word of adjoining rows."""
    own, row_end = body[begin[0] : stop[-1]], stop - begin[0]
    start, end = _tokens(own)
    is_word = end - start > 1
    start, end = start[is_word], end[is_word]
    return ta.span_hash(ta.prefix_code(ta.BYTE_CODE[own]), start, end - 1).view(np.int64), np.searchsorted(row_end, end, "left")


def _earlier(code: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How often each code stands before itself in its row."""
    key = ta.mix(code + ta.mix(row.astype(np.uint64)))
    order = np.argsort(key)
    new = np.r_[True, key[order[1:]] != key[order[:-1]]]
    order = np.sort(np.cumsum(new) << 32 | order) & 0xFFFFFFFF  # by place among equals
    at, rank = np.arange(len(code)), np.empty(len(code), np.int64)
    rank[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return rank


def with_repeats(value: np.ndarray, body: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """log10 probability of adjoining rows, whose bytes have the log10 probabilities ``value``, if tokens may be repeated."""
    own, m = body[begin[0] : stop[-1]], len(begin)
    start, end = _tokens(own)
    row = np.searchsorted(stop - begin[0], end, "left")
    code, tree = ta.span_hash(ta.prefix_code(ta.BYTE_CODE[own]), start, end), np.add.reduceat(value, start)
    past = np.arange(len(code)) - np.searchsorted(row, np.arange(m))[row]
    again = _earlier(code, row)
    before = np.where(past > 0, np.r_[0, again[:-1]], 0)
    pair = _earlier(ta.mix(code) + np.where(past > 0, np.r_[code[:1], code[:-1]], ta.U(0)), row)
    any_p, next_p, totals = again / np.maximum(past, 1), np.where(before > 0, pair / np.maximum(before, 1), 0.0), []
    chance = 10**tree
    for any_share, next_share in RATES:
        by_any, by_next = any_share * (past > 0), next_share * (before > 0)
        p = by_any * any_p + by_next * next_p
        rest = 1 - by_any - by_next
        logs = np.log10(p + rest * chance, where=p > 0, out=np.log10(rest) + tree)
        totals.append(np.bincount(row, logs, m))
    return np.logaddexp.reduce(np.array(totals) * math.log(10), axis=0) / math.log(10) - math.log10(len(RATES))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, c): training count of each word of each chunk (outs, ends, body)."""
    for batch in batches:
        for r in range(batch.num_rows):
            body, begin, stop = _chunk(batch.column(1)[r], batch.column(2)[r])
            learnt, codes = ~batch.column(0)[r].values.to_numpy(zero_copy_only=False), [np.zeros(0, np.int64)]
            for a, b in _row_runs(begin, stop):
                code, row = _row_words(body, begin[a:b], stop[a:b])
                codes.append(code[learnt[a + row]])
            code, c = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(c.astype(np.int64))], names=["code", "c"])


def learnt_bytes(value: np.ndarray, body: np.ndarray) -> np.ndarray:
    """log10 probability of each byte of one row after its own earlier bytes: contexts of 0 to 5 bytes, each smoothed by the next shorter one, the shortest by the tree."""
    gram, row = grams(body, np.array([0]), np.array([len(body)])), np.zeros(len(body), np.int64)
    p = (_earlier(gram & ta.U(255), row) + 16 * (0.9 * 10**value + 0.1 / 256)) / (np.arange(len(body)) + 16)
    for k in (1, 2, 3, 5):
        context = gram >> ta.U(8 * (DEPTH + 1 - k))
        p = (_earlier(context << ta.U(8) | gram & ta.U(255), row) + p) / (_earlier(context, row) + 1)
    return np.log10(p)


def adapted(value: np.ndarray, body: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """log10 probability of adjoining rows, with repeats and, where the tree knows them badly, with their own bytes learnt."""
    found = with_repeats(value, body, begin, stop)
    poor = np.flatnonzero(found < -POOR * math.log10(2) * (stop - begin))
    found += math.log10(1 - OWN)
    for r in poor:
        a, b = begin[r] - begin[0], stop[r] - begin[0]
        own = with_repeats(learnt_bytes(value[a:b], body[begin[r] : stop[r]]), body, begin[r : r + 1], stop[r : r + 1])[0] + math.log10(OWN)
        found[r] = np.logaddexp(found[r] * math.log(10), own * math.log(10)) / math.log(10)
    return found


def score(docs: DataFrame, most_words: int = MOST_WORDS, repeats: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row of docs (doc_id, text).

    ``bits_per_byte`` is the code length of the text and its end mark over their bytes. ``score`` is that of the tree
    alone, or with repeats of the text's own tokens and bytes.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    packed = cut(rows.withColumn("held_out", held_out()).mapInArrow(_pack, _PACKED))
    words = cut(packed.select("outs", "ends", "body").mapInArrow(_count_words, "code long, c long").groupBy("code").agg(F.sum("c").alias("c")))
    seen = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    learnt = F.size(F.filter("outs", lambda x: ~x))
    sizes = packed.agg(F.coalesce(F.sum(F.element_at("ends", -1)), F.lit(0)).alias("bytes"), F.coalesce(F.sum(learnt), F.lit(0)).alias("ends")).first()
    size, ends = int(sizes["bytes"]), int(sizes["ends"])
    n_all, v_all = int(seen["n"]) + ends, int(seen["v"]) + (ends > 0)
    least = math.log10(n_all + v_all + 1)
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PIECE))
    asked = packed.mapInArrow(_requests(pieces), "piece long, chunk long, grams binary, n binary")
    shallow = spark.sparkContext.broadcast(_shallow(asked.groupBy("piece").applyInArrow(_tops, "keys binary, n binary, wholes binary")))

    def answer(table: pa.Table) -> pa.Table:
        ta.release()
        tree, each = _tree_of(table)
        logs = tree.logs(shallow.value).astype(np.float32)
        own = [_small(logs[np.searchsorted(tree.keys[DEPTH], g)]) for g in each]
        return pa.table({"chunk": table["chunk"], "piece": table["piece"], "logs": pa.array(own, pa.binary())})

    answers = asked.groupBy("piece").applyInArrow(answer, "chunk long, piece long, logs binary")
    table = None
    if seen["v"] <= most_words:
        found = words.toArrow()
        order = np.argsort(found["code"].to_numpy())
        table = spark.sparkContext.broadcast((found["code"].to_numpy()[order], found["c"].to_numpy()[order]))
    end_log = math.log10(ends + 1) - least

    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        ta.release()
        codes, counts = table.value if table is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        body, begin, stop = _chunk(chunk["ends"][0], chunk["body"][0])
        keys, _ = chunk_grams(body, begin, stop, np.zeros(len(stop), bool))
        logs = np.empty(len(keys))
        order = np.argsort(replies["piece"].to_numpy())
        logs[np.argsort(piece_of(keys, pieces), kind="stable")] = np.concatenate([_wide(x, "<f4") for x in replies["logs"].take(pa.array(order)).to_pylist()])
        lookup, parts = pd.Index(keys.view(np.int64)), []
        for a, b in _row_runs(begin, stop):
            m = b - a
            value = logs[lookup.get_indexer(grams(body, begin[a:b], stop[a:b]).view(np.int64))]
            model_score = adapted(value, body, begin[a:b], stop[a:b]) if repeats else np.add.reduceat(value, begin[a:b] - begin[a])
            word, word_row = _row_words(body, begin[a:b], stop[a:b])
            spot = np.minimum(np.searchsorted(codes, word), max(len(codes) - 1, 0))
            hit = codes[spot] == word if len(codes) else np.zeros(len(word), bool)
            base = np.bincount(word_row, np.where(hit, np.log10(counts[spot] + 1.0) if len(counts) else 0.0, 0.0), m)
            n_words = np.bincount(word_row, minlength=m)
            n_known = np.bincount(word_row[hit], minlength=m) + (ends > 0)
            parts.append((n_words + 1, n_known, base - n_words * least + end_log, model_score, model_score / (begin[a:b] - stop[a:b]) * math.log2(10)))
        n_tokens, n_known, base, model_score, bits = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids = chunk["ids"][0].values
        place = chunk["chunk"][0].as_py()
        return pa.table({"chunk": np.full(len(ids), place), "place": np.arange(len(ids)), "doc_id": ids, "n_tokens": n_tokens, "n_known": n_known, "base_score": base, "score": model_score, "bits_per_byte": bits})

    out = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, "chunk long, place long, doc_id long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    if table is None:
        out = _joined(packed, out, words, int(ends > 0))
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, place, code, n) of the distinct words of each row of chunks."""
    for batch in batches:
        for r in range(batch.num_rows):
            body, begin, stop = _chunk(batch.column(1)[r], batch.column(2)[r])
            for a, b in _row_runs(begin, stop):
                code, row = _row_words(body, begin[a:b], stop[a:b])
                order = np.lexsort((code, row))
                code, row = code[order], row[order]
                head = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])]) if len(code) else np.zeros(0, np.int64)
                n = np.diff(np.r_[head, len(code)])
                columns = [np.full(len(head), batch.column(0)[r].as_py()), a + row[head], code[head], n]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["chunk", "place", "code", "n"])


def _joined(packed: DataFrame, out: DataFrame, words: DataFrame, end_known: int) -> DataFrame:
    """The baseline by a shuffle join, for vocabularies too large to broadcast; rows are told apart by chunk and place."""
    pairs = packed.select("chunk", "ends", "body").mapInArrow(_words_of, "chunk long, place long, code long, n long")
    sums = pairs.join(words, "code").groupBy("chunk", "place").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("logs"), F.sum("n").alias("hits"))
    return out.join(sums, ["chunk", "place"], "left").select(
        "doc_id", "n_tokens", (F.coalesce("hits", F.lit(0)) + end_known).alias("n_known"), (F.col("base_score") + F.coalesce("logs", F.lit(0.0))).alias("base_score"), "score", "bits_per_byte"
    )
