"""Operator 5: bytes covered by long strings of earlier documents, by run-length indexes.

1. Anchors. The least-hash ``K``-byte string of every window of ``LENGTH`` bytes is its anchor, so equal windows
   have equal anchors. Anchor hashes travel packed by hash range; those that occur twice or more set a bit in a
   filter of at most ``FILTER_BITS`` bits, or several bits each as long as the filter has many for each of them. The filter's size is
   fixed; a full filter only lets more through. Those of
   ``HOT`` documents or more set a bit in a second, smaller filter.
2. Segments. The bytes around each anchor that passes the filter go to the bucket of its hash, packed. A hot anchor is
   split: windows with ``MORE`` bytes or more after it go by it and those bytes, the others have as many before it
   and go by it and these. Equal segments of one task's share of text are summed first: only those of the least
   document travel, with one copy of the text; the later documents' are covered whole, and their marks are spread.
3. Index. Windows whose middle bytes no other document has around the same anchor are left out. What is left of the distinct
   segments is taken some ``INDEXED`` bytes at a time in order of their anchors. The documents
   of an anchor are halved again and again: the earlier half is the reference, the later one streams through it. A reference is
   a run-length index: the runs of its Burrows-Wheeler transform, where LF sends them, and the suffixes at both ends of each run.
   The later segments walk backwards through it, all at once; their matching statistics, the length that each suffix
   shares with a reference, grow along LF or are found anew at the nearer run ends, and those of ``LENGTH`` and more are marked.
4. Marks return to their documents, packed by document range, and the covered bytes are cut out.

A text that equals a text with a smaller id is settled at once: all of it is covered if it has ``LENGTH`` bytes.
Segments count as equal when their 64-bit hashes are, among those of one task's chunk or of one index; windows are
compared by their bytes.

Edge cases: a null text counts as empty; texts under ``LENGTH`` bytes lose nothing. A null doc_id comes after all
others. Equal ids aren't smaller than one another; ids should be unique, and of different texts under one id the
marks are united and clipped. Repeated rows give repeated rows, an empty table none, other columns are ignored.
A long run of one byte has an anchor at each byte, but one segment; its places travel as numbers.
A bucket holds the segments of its anchors at once; the number of buckets grows with spark.sql.shuffle.partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm import text_arrays as ta
from signalloom.llm.components import small
from signalloom.session import cut

LENGTH = 50
K = 20
WINDOW = LENGTH - K + 1
SLICE = 1 << 18
#: 32 MB: the most that the driver and each task hold of the filter.
FILTER_BITS = 28
LAST = (1 << 63) - 1
_packs = "bucket int, keys binary, ids binary, sizes binary, anchors binary, counts binary, starts binary, texts binary, marks binary"
#: Bits of the filter that an anchor sets at most.
PROBES = 4
#: Bytes of text whose anchors or segments a task packs at a time.
CHUNK = 8 << 20
#: Documents from which on an anchor is split, bits of the filter of such anchors, and the bytes that it is split by.
HOT, HOT_BITS, MORE = 2048, 22, 15
#: Bytes of segments that a task takes up at a time, of whole buckets, and bytes of those cut to open windows that are halved together;
#: the segments of one anchor stay together.
HELD, INDEXED = 1 << 23, 1 << 21
#: Windows that begin at so many neighbouring places of a segment are looked at together, by the bytes that all of them hold.
TOGETHER = 8
#: Bytes and the terminator: symbols under one tag.
SYMBOLS = 257
_marks = [("id", "<i8"), ("a", "<i4"), ("b", "<i4")]


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, byte position, row) of the anchors of all windows, each anchor once."""
    n = len(raw)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < LENGTH:
        return none
    total = ta.prefix_code(ta.BYTE_CODE[raw])
    code = ta.mix((total[K:] - total[:-K]) * ta.powers(len(total))[1][: n - K + 1])
    least, width = code, 1
    while 2 * width <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < WINDOW:
        least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
    # A position is an anchor if it holds the least hash of some window around it that lies in one row.
    inside = np.zeros(len(least), bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        inside[a : max(a, b - LENGTH + 1)] = True
    lows = np.where(inside, least, 0)
    # Greatest window minimum among the windows that hold the position: equal to its hash only for anchors.
    reach, width = np.r_[np.zeros(WINDOW - 1, np.uint64), lows, np.zeros(WINDOW - 1, np.uint64)], 1
    while 2 * width <= WINDOW:
        reach = np.maximum(reach[:-width], reach[width:])
        width *= 2
    if width < WINDOW:
        reach = np.maximum(reach[: len(reach) - (WINDOW - width)], reach[WINDOW - width :])
    at = np.flatnonzero((reach[: len(code)] == code) & (code > 0))
    # Least hashes are small numbers: mixed again, they fill all buckets and the filters alike.
    return ta.mix(code[at]), at, np.searchsorted(offsets, at, "right") - 1


def _grouped(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, positions) for each distinct value."""
    if len(key) == 0:
        return
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
        yield int(key[order[a]]), order[a:b]


def _chunks(column: pa.Array) -> Iterator[list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """Slices of a column, some CHUNK bytes at a time."""
    held, size = [], 0
    for part in ta.slices(column, SLICE):
        held.append(part)
        size += len(part[2])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _post(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _chunks(batch.column(0)):
                found = []
                for _, _, raw, offsets in chunk:
                    code, _, row = anchors(raw, offsets)
                    order = np.lexsort((code, row))
                    code, row = code[order], row[order]
                    if len(code):
                        found.append(code[np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])]])
                if not found:
                    continue
                # 40 bits beyond the bucket's own: enough to tell apart what a filter of 28 bits can.
                code = np.concatenate(found)
                parts = [(b, ((code[own] << ta.U(bits)) >> ta.U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()) for b, own in _grouped((code >> ta.U(64 - bits)).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["bucket", "hashes"])
        ta.release()

    return run


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """(bucket, its rows' other columns) from batches sorted by bucket."""
    key, rows = None, []
    for batch in batches:
        for i, b in enumerate(batch.column(0).to_pylist()):
            if b != key and rows:
                yield key, rows
                rows = []
            key = b
            rows.append([c[i].as_py() for c in batch.columns[1:]])
    if rows:
        yield key, rows


def _repeated(bits: int):
    """For each bucket its parts of the two filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _runs_of(batches):
            flat = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(-1, 5)
            code = np.zeros((len(flat), 8), np.uint8)
            code[:, :5] = flat
            code = np.sort(code.view("<u8").ravel())
            parts, probes = [], 1
            for times, size in ((2, FILTER_BITS), (HOT, HOT_BITS)):
                often = code[times - 1 :][code[times - 1 :] == code[: max(0, len(code) - times + 1)]]
                part = np.zeros(1 << (size - bits), bool)
                if times == 2:
                    # As many bits for each as let the fewest others through.
                    probes = int(np.clip(0.69 * len(part) / max(1, np.count_nonzero(np.diff(often)) + 1), 1, PROBES))
                for k in range(probes if times == 2 else 1):
                    part[_slot(often, size - bits, k)] = True
                parts.append(pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *parts, pa.array([probes], pa.int32())], names=["bucket", "part", "hot", "probes"])

    return run


def _slot(code: np.ndarray, width: int, k: int) -> np.ndarray:
    """The k-th place, of 2**width, of hashes of 40 bits."""
    first = code >> ta.U(40 - width)
    return ((first + ta.U(k) * (ta.mix(code) | ta.U(1)) if k else first) & ta.U((1 << width) - 1)).astype(np.int64)


def _bit(table: np.ndarray, bits: int, code: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Whether all bits of each hash are set; ``probes`` has their number for each bucket."""
    own = len(probes).bit_length() - 1
    bucket, rest, out = (code >> ta.U(64 - own)).astype(np.int64), (code << ta.U(own)) >> ta.U(24), np.ones(len(code), bool)
    for k in range(int(probes.max())):
        on = np.flatnonzero(out & (probes[bucket] > k))
        slot = (bucket[on] << (bits - own)) + _slot(rest[on], bits - own, k)
        out[on] = (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
    return out


def _spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, hot: np.ndarray, probes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, row, start, size, anchor's place, hash of key, bytes and place) of the segments around the anchors that pass the filter."""
    code, at, row = anchors(raw, offsets)
    hit = _bit(table, FILTER_BITS, code, probes)
    code, at, row = code[hit], at[hit], row[hit]
    low, high = np.maximum(at - (LENGTH - K), offsets[row]), np.minimum(at + LENGTH, offsets[row + 1])
    total = ta.prefix_code(ta.BYTE_CODE[raw])
    often = np.flatnonzero(_bit(hot, HOT_BITS, code, np.ones_like(probes)))
    if len(often):
        after = often[at[often] + K + MORE <= high[often]]
        before = often[at[often] - MORE >= low[often]]
        x, y = at[after] + K, at[before] - MORE
        keys = ta.mix(code[after] ^ ta.span_hash(total, x, x + MORE)), ta.mix(~code[before] ^ ta.span_hash(total, y, y + MORE))
        rest = np.setdiff1d(np.arange(len(code)), often)
        code = np.concatenate([code[rest], *keys])
        row = np.concatenate([row[rest], row[after], row[before]])
        low, high = np.concatenate([low[rest], np.maximum(low[after], at[after] - MORE), low[before]]), np.concatenate([high[rest], high[after], np.minimum(high[before], y + MORE + K + MORE)])
        at = np.concatenate([at[rest], at[after], at[before]])
        ok = high - low >= LENGTH
        code, row, at, low, high = code[ok], row[ok], at[ok], low[ok], high[ok]
    # One stretch of text can be the segment of several anchors: it is a segment for each.
    return code, row, low, high - low, at - low, ta.mix(ta.span_hash(total, low, high) ^ code) + (at - low).astype(np.uint64)


def _segments(shared, bits: int, parts: int):
    """Packed distinct segments around the anchors that pass the filter, by bucket; and marks that are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hot, probes = (np.frombuffer(x, np.uint8) for x in shared.value)
        names = ["bucket", "keys", "ids", "sizes", "anchors", "counts", "starts", "texts", "marks"]
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in _chunks(batch.column(1)):
                found, texts, whole = [], [], 0
                for first, _, raw, offsets in chunk:
                    key, row, start, size, place, code = _spans(raw, offsets, table, hot, probes)
                    found.append((key, code, ids[first + row], (start - offsets[row]).astype(np.int32), size, place, start + whole))
                    texts.append(raw)
                    whole += len(raw)
                key, code, own, start, size, place, at = (np.concatenate(x) for x in zip(*found, strict=True))
                raw = np.concatenate(texts)
                order = np.lexsort((start, own, code))
                head = np.flatnonzero(np.r_[True, code[order[1:]] != code[order[:-1]]]) if len(order) else np.zeros(0, np.int64)
                one = order[head]  # the least document's first segment of each text
                group = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(order)]))
                same = own[order] == own[one][group]
                counts = np.bincount(group[same], minlength=len(one)).astype("<i4")
                starts, ends = start[order[same]].astype("<i4"), np.cumsum(counts)
                out = []
                for b, g in _grouped((key[one] >> ta.U(64 - bits)).astype(np.int32)):
                    o = one[g]
                    places = cut_out(starts, (ends - counts)[g].astype(np.int64), counts[g].astype(np.int64))
                    sub = ((key[o] << ta.U(bits)) >> ta.U(32)).astype("<u4")
                    blobs = (sub, own[o].astype("<i8"), size[o].astype(np.uint8), place[o].astype(np.uint8), counts[g], places, cut_out(raw, at[o], size[o]))
                    out.append((b, *(x.tobytes() for x in blobs), None))
                later = order[~same]
                marks = np.zeros(len(later), _marks)
                marks["id"], marks["a"], marks["b"] = own[later], start[later], start[later] + size[later]
                out += [(p % (1 << bits), *[None] * 7, united(marks[m]).tobytes()) for p, m in _grouped(part_of(marks["id"], parts))]
                columns = list(zip(*out, strict=True)) or [()] * 9
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=names)
        ta.release()

    return run


def united(marks: np.ndarray) -> np.ndarray:
    """The spans of each document that overlap or touch, as one."""
    marks = marks[np.lexsort((marks["a"], marks["id"]))]
    if len(marks) == 0:
        return marks
    # Ends grow within a document once they carry the greatest before them; documents are kept apart by their place.
    place = np.cumsum(np.r_[0, marks["id"][1:] != marks["id"][:-1]]).astype(np.int64) << 32
    reach = np.maximum.accumulate(place + marks["b"])
    head = np.flatnonzero(np.r_[True, place[1:] + marks["a"][1:] > reach[:-1]])
    out = marks[head]
    out["b"] = (reach[np.r_[head[1:], len(marks)] - 1] & 0xFFFFFFFF).astype(np.int32)
    return out


def cut_out(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The items of the spans, one after another."""
    out = [text[:0]]
    for k in range(0, len(size), 1 << 14):
        a, n = start[k : k + (1 << 14)], size[k : k + (1 << 14)]
        out.append(text[np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())])
    return np.concatenate(out)


def stable_order(key: np.ndarray) -> np.ndarray:
    """The stable order of whole numbers from 0; by one sort of numbers with their places, which is much faster, where both fit 64 bits."""
    bits = len(key).bit_length()
    if int(key.max(initial=0)).bit_length() + bits > 64:
        return np.argsort(key, kind="stable")
    both = np.sort(key.astype(np.uint64) << ta.U(bits) | np.arange(len(key), dtype=np.uint64))
    return (both & ta.U((1 << bits) - 1)).astype(np.int64)


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of reference strings, with the text position of both ends of each run.

    Strings stand under tags, and a pattern meets those of its own tag only. Kept are, for each run, its first rank, its symbol,
    where LF sends it, and the suffixes at its first and last rank; and the text, whose words compare suffixes. The suffix
    order serves the building and is gone after it.
    """

    def __init__(self, text: np.ndarray, size: np.ndarray, tag: np.ndarray):
        """``text``: the strings one after another; a terminator below every byte is put after each, ordered by string."""
        n = len(text) + len(size)
        end = np.cumsum(size + 1) - 1
        body = np.zeros(n, np.uint16)
        is_end = np.zeros(n, bool)
        is_end[end] = True
        body[~is_end] = text.astype(np.uint16) + 1
        #: Bytes before the terminator at each position.
        self.left = (np.repeat(end, size + 1) - np.arange(n)).astype(np.int16 if size.max(initial=0) < 1 << 15 else np.int64)
        mark = np.repeat(tag.astype(np.int64), size + 1)
        order = self._suffix_order(body, self.left, mark)
        symbol = np.where(order > 0, body[order - 1], 0) + mark[order] * SYMBOLS
        lf = np.empty(n, np.int32)
        lf[stable_order(symbol)] = np.arange(n, dtype=np.int32)
        order = order.astype(np.int32)
        self.start = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]]).astype(np.int32)
        last = np.r_[self.start[1:], n].astype(np.int32) - 1
        self.symbol, self.lf, self.first_at, self.last, self.last_at = symbol[self.start], lf[self.start], order[self.start], last, order[last]
        #: Runs in order of symbol, then rank: symbol * number of runs + run.
        self.by_symbol = np.sort(self.symbol * len(self.start) + np.arange(len(self.start)))
        self.word = np.zeros(n, np.uint64)
        padded = np.r_[np.where(body > 0, body - 1, 0).astype(np.uint64), np.zeros(8, np.uint64)]
        for k in range(8):
            self.word = self.word << ta.U(8) | padded[k : k + n]

    @staticmethod
    def _suffix_order(body: np.ndarray, left: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Full order of all suffixes by tag: a few bytes at first, then by doubling; strings differ or end differently."""
        n = len(body)
        used = np.bincount(body, minlength=SYMBOLS) > 0
        bits = int(used.sum()).bit_length()
        # As many symbols as fit beside the tag and the place.
        width = max(1, (64 - int(mark.max(initial=0)).bit_length() - n.bit_length()) // bits)
        key = mark.astype(np.uint64)
        padded = np.r_[(np.cumsum(used) - 1)[body].astype(np.uint64), np.zeros(width, np.uint64)]
        for k in range(width):
            key = (key << ta.U(bits)) | np.where(left >= k, padded[k : k + n], ta.U(0))
        order = stable_order(key)
        seen = key[order]
        new = np.r_[True, (seen[1:] != seen[:-1]) | (left[order[1:]] < width)]
        # A suffix ranks as the first of its group; only groups of two and more are ordered further, and keep their place.
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        many = np.flatnonzero(~new | np.r_[~new[1:], False])
        while len(many):
            own = order[many]
            wide = (rank[own] << n.bit_length()) | rank[np.minimum(own + width, n - 1)]
            turn = stable_order(wide)
            order[many] = own = own[turn]
            wide = wide[turn]
            width *= 2
            new = np.r_[True, (wide[1:] != wide[:-1]) | (left[own[1:]] < width)]
            rank[own] = many[np.maximum.accumulate(np.where(new, np.arange(len(many)), 0))]
            many = many[~new | np.r_[~new[1:], False]]
        return order

    def shared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at two positions share, up to ``most`` and the end of the second's string; 0 may stand for fewer than ``least``."""
        n = len(self.word)
        most = np.minimum(most, self.left[b])
        same, k = np.zeros(len(a), np.int32), 0
        # Where many are needed, the last of these are compared first: most pairs differ there.
        end = np.maximum(least, 8) - 8
        go = np.flatnonzero((most >= least) & ((least < 8) | (self.word[np.minimum(a + end, n - 1)] == self.word[np.minimum(b + end, n - 1)])))
        while len(go):
            differ = self.word[np.minimum(a[go] + k, n - 1)] ^ self.word[np.minimum(b[go] + k, n - 1)]
            # Whole bytes before the first that differs, from the place of the highest bit; 32 bits are exact in a double.
            top = differ >> ta.U(32)
            high = top > 0
            lead = (64 - 32 * high - np.frexp(np.where(high, top, differ).astype(np.float64))[1]) >> 3
            same[go] += lead
            k += 8
            more = np.flatnonzero((lead == 8) & (k < most[go]))
            if not len(more):
                break
            go = go[more]
        return np.minimum(same, most)

    def stream(self, text: np.ndarray, size: np.ndarray, tag: np.ndarray, length: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Walks patterns backwards, all at once: (bytes to the end, patterns, matching statistic of each).

        With a ``length``, a walk ends where no match of that many bytes can begin further on, and statistics of ended walks may be too small.

        A walk holds a rank, the suffix there and how much of it matches. Where the run at the rank has the symbol that comes next, LF leads
        on; else the nearer ends of that symbol's runs before and after are compared with the match, and the one that shares more is taken.
        """
        end = np.cumsum(size)
        live = np.arange(len(size))
        rank, at, match = np.zeros(len(size), np.int32), np.full(len(size), self.first_at[0]), np.zeros(len(size), np.int32)
        runs = len(self.start)
        for step in range(1, int(size.max(initial=0)) + 1):
            go = (size[live] >= step) & ((match >= length - 1 - size[live] + step) | (step == 1))
            if not go.all():
                live, rank, at, match = live[go], rank[go], at[go], match[go]
            c = text[end[live] - step].astype(np.int64) + 1 + tag[live] * SYMBOLS
            run = np.searchsorted(self.start, rank, "right") - 1
            match = match + 1
            miss = np.flatnonzero(self.symbol[run] != c)
            if len(miss):
                least = length - 1 - size[live[miss]] + step
                place = np.searchsorted(self.by_symbol, c[miss] * runs + run[miss])
                best, to, suffix = np.full(len(miss), -1, np.int32), rank[miss], at[miss]
                for other, rank_of, at_of in ((place - 1, self.last, self.last_at), (place, self.start, self.first_at)):
                    there = np.flatnonzero((other >= 0) & (other < runs) & (best < match[miss] - 1))
                    there = there[self.by_symbol[other[there]] // runs == c[miss[there]]]
                    r = self.by_symbol[other[there]] % runs
                    got = self.shared(at[miss[there]], at_of[r], match[miss[there]] - 1, least[there])
                    better = got > best[there]
                    there, r = there[better], r[better]
                    best[there], to[there], suffix[there], run[miss[there]] = got[better], rank_of[r], at_of[r], r
                rank[miss], at[miss], match[miss] = to, suffix, best + 1
            on = match > 0
            rank = np.where(on, self.lf[run] + rank - self.start[run], rank)
            at = np.where(on, at - 1, at)
            yield step, live, match


def distinct(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least document's segment of each key, text and anchor's place, and for each segment the place of its own among those."""
    offsets = np.r_[0, np.cumsum(sizes)]
    code = np.empty(len(ids), np.uint64)
    for a in range(0, len(ids), 4096):
        own = offsets[a : a + 4097]
        code[a : a + 4096] = ta.span_hash(ta.prefix_code(ta.BYTE_CODE[text[own[0] : own[-1]]]), own[:-1] - own[0], own[1:] - own[0])
    code += at.astype(np.uint64)
    order = np.lexsort((ids, code, keys))
    head = np.r_[True, (code[order][1:] != code[order][:-1]) | (keys[order][1:] != keys[order][:-1])]
    group = np.empty(len(ids), np.int64)
    group[order] = np.cumsum(head) - 1
    return order[head], group


def open_windows(keys: np.ndarray, ids: np.ndarray, begin: np.ndarray, sizes: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each segment and place in it, whether a window begins there whose middle bytes another document has around the same anchor.

    Equal windows hold their anchor at the same place. Those that begin at TOGETHER neighbouring places, counted from the anchor, have all
    bytes but TOGETHER - 1 at the ends in common; where no other document of the key has these, none of the windows can come again.
    """
    places = int(sizes.max(initial=LENGTH)) - LENGTH + 1
    # From the anchor's place: the first and the last window that holds the anchor.
    first, last = np.maximum(-at, K - LENGTH), np.minimum(sizes - LENGTH - at, 0)
    found, code = [], []
    for low in range(K - LENGTH, 1, TOGETHER):
        high = min(low + TOGETHER - 1, 0)
        found.append(np.flatnonzero((first <= high) & (last >= low)))
        code.append(np.empty(len(found[-1]), np.uint64))
        for a in range(0, len(found[-1]), 4096):
            own = found[-1][a : a + 4096]
            size = np.full(len(own), LENGTH - (high - low))
            core = cut_out(text, (begin + at)[own] + high, size)
            end = np.cumsum(size)
            code[-1][a : a + 4096] = ta.mix(ta.span_hash(ta.prefix_code(ta.BYTE_CODE[core]), end - size, end) ^ keys[own].astype(np.uint64))
    out = np.zeros((len(ids), places), bool)
    for low, own, c in zip(range(K - LENGTH, 1, TOGETHER), found, code, strict=True):
        if len(own):
            order = np.argsort(c)
            head = np.flatnonzero(np.r_[True, c[order][1:] != c[order][:-1]])
            several = np.minimum.reduceat(ids[own[order]], head) != np.maximum.reduceat(ids[own[order]], head)
            own = own[order[np.repeat(several, np.diff(np.r_[head, len(own)]))]]
            for k in range(low, min(low + TOGETHER, 1)):
                ok = own[(first[own] <= k) & (last[own] >= k)]
                out[ok, at[ok] + k] = True
    return out


def matches(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, text: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the bytes of each segment that windows of earlier documents cover; to is 0 where none do.

    The documents of a key are halved again and again: those of each even block are indexed, those of the odd block after it
    stream through, so any two documents meet once, the earlier one as reference. A window that is found is left out from then on: the first
    document that has it is never without it. Segments are cut to the windows that are left. ``at`` has the places of the anchors in their segments;
    without it any windows of a key may be equal.
    """
    one, group = distinct(keys, ids, sizes, text, np.zeros(len(ids), np.int64) if at is None else at)
    begin, size, own = (np.cumsum(sizes) - sizes)[one], sizes[one], ids[one]
    if at is None:
        left = np.arange(int(size.max(initial=LENGTH)) - LENGTH + 1) <= (size - LENGTH)[:, None]
    else:
        left = open_windows(keys[one], own, begin, size, text, at[one])
    found = np.zeros(left.shape, bool)
    some = np.flatnonzero(left.any(1))
    for part in _batches(keys[one[some]], _span(left[some])[1]) if len(some) else ():
        part = some[part]
        found[part] = _halved(keys[one[part]], own[part], begin[part], text, left[part])
    low, length = _span(found)
    high = np.where(found.any(1), low + length, 0)
    later = ids > own[group]
    return np.where(later, 0, low[group]), np.where(later, sizes, high[group])


def _span(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each segment's first window begins, and the bytes from there to the last one's end."""
    low = windows.argmax(1)
    return low, windows.shape[1] - 1 - windows[:, ::-1].argmax(1) + LENGTH - low


def _halved(keys: np.ndarray, ids: np.ndarray, begin: np.ndarray, text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Which of the open windows of each segment an earlier document of its key has."""
    order = np.lexsort((ids, keys))
    new_key = np.r_[True, keys[order][1:] != keys[order][:-1]]
    new = np.cumsum(new_key | np.r_[True, ids[order][1:] != ids[order][:-1]])
    key, place = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
    key[order] = np.cumsum(new_key) - 1
    place[order] = new - new[np.maximum.accumulate(np.where(new_key, np.arange(len(ids)), 0))]
    found, left, some = np.zeros(left.shape, bool), left.copy(), np.arange(len(ids))
    for level in range(int(place.max(initial=0)).bit_length()):
        some = some[left[some].any(1)]
        block = place[some] >> level
        tag = key[some] << 32 | block >> 1
        both = np.intersect1d(tag[block & 1 == 0], tag[block & 1 == 1])
        if not len(both):
            continue
        met = np.isin(tag, both)
        ref, pat = np.flatnonzero(met & (block & 1 == 0)), np.flatnonzero(met & (block & 1 == 1))
        low, length = _span(left[some])
        start = begin[some] + low
        index = RunIndex(cut_out(text, start[ref], length[ref]), length[ref], np.searchsorted(both, tag[ref]))
        for step, live, match in index.stream(cut_out(text, start[pat], length[pat]), length[pat], np.searchsorted(both, tag[pat]), LENGTH):
            if step >= LENGTH:
                hit = pat[live[match >= LENGTH]]
                found[some[hit], low[hit] + length[hit] - step] = True
        left &= ~found
    return found


def _batches(keys: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Segments in order of their keys, some INDEXED bytes at a time; those of one key stay together."""
    order = np.argsort(keys, kind="stable")
    begin = np.cumsum(sizes[order]) - sizes[order]
    head = np.flatnonzero(np.r_[True, keys[order[1:]] != keys[order[:-1]]])
    share = begin[head] // INDEXED
    for a, b in zip(first := head[np.r_[True, share[1:] != share[:-1]]], [*first[1:], len(order)], strict=True):
        yield order[a:b]


def _resolve(parts: int):
    """Marks of all buckets of a task, packed by document: rows (part, marks)."""

    def done(held: list[np.ndarray]) -> pa.RecordBatch:
        marks = np.concatenate([np.zeros(0, _marks), *held])
        out = [(p, united(marks[own]).tobytes()) for p, own in _grouped(part_of(marks["id"], parts))]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([m for _, m in out], pa.binary())], names=["part", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for buckets in _some_buckets(batches):
            held += [np.frombuffer(r[7], _marks) for _, rows in buckets for r in rows if r[7] is not None]
            buckets = [(b, [r for r in rows if r[7] is None]) for b, rows in buckets]
            get = lambda k, kind: np.frombuffer(b"".join(r[k] for _, rows in buckets for r in rows), kind)  # noqa: E731, B023
            bucket = np.repeat([b for b, _ in buckets], [sum(len(r[2]) for r in rows) for _, rows in buckets]).astype(np.uint64)
            keys, ids, sizes, at, counts, starts, text = get(0, "<u4"), get(1, "<i8"), get(2, np.uint8).astype(np.int64), get(3, np.uint8).astype(np.int64), get(4, "<i4").astype(np.int64), get(5, "<i4"), get(6, np.uint8)
            if len(keys):
                a, b = matches(bucket << ta.U(32) | keys, ids, sizes, text, at)
                own, place = np.flatnonzero(b), np.cumsum(counts) - counts
                start, n = cut_out(starts, place[own], counts[own]), counts[own]
                marks = np.zeros(len(start), _marks)
                marks["id"], marks["a"], marks["b"] = np.repeat(ids[own], n), start + np.repeat(a[own], n), start + np.repeat(b[own], n)
                held.append(marks)
            if sum(map(len, held)) >= 1 << 20:
                yield done(held)
                held = []
        yield done(held)
        ta.release()

    return run


def _some_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, list[list]]]]:
    """Whole buckets, some HELD bytes of segments at a time."""
    held, size = [], 0
    for bucket, rows in _runs_of(batches):
        held.append((bucket, rows))
        size += sum(len(r[6]) for r in rows if r[6] is not None)
        if size >= HELD:
            yield held
            held, size = [], 0
    if held:
        yield held


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return (ta.mix(ids.astype(np.int64).view(np.uint64)) % ta.U(parts)).astype(np.int32)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, marks, doc_id, id, text, copy): the marks of a part come first."""
    part, held, marks = None, [], None
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        out = []
        for p, m, doc_id, key, text, copy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part:
                part, held, marks = p, [], None
            if m is not None:
                held.append(m)
                continue
            if marks is None:
                marks = np.frombuffer(b"".join(held), _marks)
                marks = marks[np.lexsort((marks["a"], marks["id"]))]
            raw = text.encode()
            spans: list[list[int]] = []
            if copy and len(raw) >= LENGTH:
                spans = [[0, len(raw)]]
            elif not copy:
                lo, hi = np.searchsorted(marks["id"], [key, key + 1]) if key < LAST else (np.searchsorted(marks["id"], key), len(marks))
                for a, b in zip(marks["a"][lo:hi].tolist(), marks["b"][lo:hi].tolist(), strict=True):
                    b = min(b, len(raw))
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    elif a < b:
                        spans.append([a, b])
            kept, at = [], 0
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            out.append((doc_id, len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest()))
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], names=names)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(HOT_BITS - 3, max(6, (4 * partitions - 1).bit_length()))
    parts = 2 * partitions
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("key"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    twins = rows.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    rows = rows.join(small(cut(twins)), "digest", "left").withColumn("copy", F.coalesce(F.col("first") < F.col("key"), F.lit(False)))
    heads = rows.where(~F.col("copy")).select("key", "text")
    posted = heads.select("text").mapInArrow(_post(bits), "bucket int, hashes binary").repartition("bucket").sortWithinPartitions("bucket")
    tables = [bytearray(n) for n in (1 << (FILTER_BITS - 3), 1 << (HOT_BITS - 3), 1 << bits)]
    for r in posted.mapInArrow(_repeated(bits), "bucket int, part binary, hot binary, probes int").toLocalIterator():
        for table, part in zip(tables, (r.part, r.hot, bytes([r.probes])), strict=True):
            table[r.bucket * len(part) : (r.bucket + 1) * len(part)] = part
    shared = spark.sparkContext.broadcast([bytes(table) for table in tables])
    packed = heads.mapInArrow(_segments(shared, bits, parts), _packs).repartition("bucket").sortWithinPartitions("bucket")
    marks = packed.mapInArrow(_resolve(parts), "part int, marks binary")
    dealt = rows.mapInArrow(_deal(parts), "part int, marks binary, doc_id long, id long, text string, copy boolean")
    both = dealt.unionByName(marks, allowMissingColumns=True)
    ordered = both.repartition("part").sortWithinPartitions("part", F.col("marks").isNull())
    return ordered.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _deal(parts: int):
    """Rows of documents with the part that their marks go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = dict(zip(batch.schema.names, batch.columns, strict=True))
            part = part_of(get["key"].to_numpy(zero_copy_only=False), parts)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(batch.num_rows, pa.binary()), get["doc_id"], get["key"], get["text"], get["copy"]], names=["part", "marks", "doc_id", "id", "text", "copy"])

    return run
