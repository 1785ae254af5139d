"""Operator 2: near-duplicates by an inverted index over MinHash signature coordinates.

The figures are those of the default threshold; another one needs its own agreements, ``near_duplicates(docs, 80, 36)``.

1. Every text gives its set of word shingles, a digest of that set, and a signature of ``COORDINATES`` minima.
   Texts with equal sets are one class, grouped by the digest before anything else happens.
2. Two sets with Jaccard 0.85 agree in fewer than ``MATCHES`` of the 64 coordinates with probability about
   2e-5. A pair that agrees in ``MATCHES`` of them must agree in one of any 64 - 42 + 1, so each
   class is posted under that prefix of coordinate-value pairs only. Each posting list counts agreements over
   the whole signature, skips pairs that are already connected, and keeps a spanning forest of those above the
   threshold: a list of n classes gives less than n rows.
3. Candidate components come together with their texts, large ones in blocks of ``BLOCK`` classes by pairs of
   blocks, where a product of incidence matrices gives the exact intersections of all sets at once. Links that
   hold on the full sets are reduced to a spanning forest of each block pair; their components are the result.

Cost: a candidate component of m classes is read m / BLOCK times; no pair is ever a row.

Edge cases: null, empty and blank texts have no shingles and are linked with nothing; fewer than five words
count as one shingle. Rows that share a doc_id count as one document; a row with a null doc_id can support no
component id: its component_id is null and kept is false. Repeated rows give repeated rows. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm import text_arrays as ta
from signalloom.llm.components import components, small
from signalloom.session import cut

WORDS = 5
PERCENT = 85
COORDINATES, MATCHES = 64, 42
BLOCK = 256
#: Columns of an incidence matrix at a time.
WIDTH = 4096

_MULTIPLY = (ta.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) >> ta.U(32)).astype(np.uint32) | np.uint32(1)
_FLIP = (ta.mix(np.arange(1001, COORDINATES + 1001, dtype=np.uint64)) >> ta.U(32)).astype(np.uint32)


def shingles(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, by row and hash: (hash, row)."""
    start, end, row = ta.words(raw, offsets)
    word = ta.word_hashes(raw, start, end)
    code, at = ta.ngrams(word, row, words)
    count = np.bincount(row, minlength=len(offsets) - 1)
    for n in range(1, words):
        c, r = ta.ngrams(word, row, n)
        few = count[r] == n
        code, at = np.concatenate((code, c[few])), np.concatenate((at, r[few]))
    order = np.lexsort((code, at))
    code, at = code[order], at[order]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != code[:-1]) | (at[1:] != at[:-1])
    return code[keep], at[keep]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offsets in ta.slices(batch.column(1)):
            code, row = shingles(raw, offsets)
            n = b - a
            count = np.bincount(row, minlength=n)
            has = np.flatnonzero(count)
            digest, sign = np.zeros((n, 2), np.uint64), np.zeros((n, COORDINATES), np.uint32)
            if len(has):
                first = np.searchsorted(row, has)
                digest[has, 0] = np.add.reduceat(ta.mix(code ^ ta.U(7)), first)
                digest[has, 1] = np.add.reduceat(ta.mix(code ^ ta.U(13)), first)
                short = (ta.mix(code) >> ta.U(32)).astype(np.uint32)
                for k in range(COORDINATES):
                    sign[has, k] = np.minimum.reduceat((short ^ _FLIP[k]) * _MULTIPLY[k], first)
            fixed = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(count.astype(np.int64)), fixed(digest), fixed(sign)], names=["doc_id", "n_shingles", "digest", "sign"])


def _post(prefix: int):
    """A row for each class and prefix coordinate: the pair's hash, the class, a byte of every coordinate."""
    salt = ta.mix(np.arange(1, prefix + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            sign = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, COORDINATES)
            key = ta.mix(sign[:, :prefix].astype(np.uint64) ^ salt).view(np.int64)
            # Minima of large sets are small numbers: the byte comes from a product that spreads all of their bits.
            short = [r.tobytes() for r in ((sign * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)]
            order = np.arange(n).repeat(prefix)
            own = pa.array(order)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), batch.column(0).take(own), batch.column(2).take(own), pa.array(short, pa.binary()).take(own)], names=["key", "cid", "size", "short"])

    return run


def _forest(ids: np.ndarray, size: np.ndarray, short: np.ndarray, percent: int = PERCENT, matches: int = MATCHES) -> tuple[list[int], list[int]]:
    """Edges that connect all pairs of one list with enough agreements; pairs in one tree already are skipped.

    By size: a set meets only those up to size * 100 / percent, as no larger one can reach the similarity.
    """
    order = np.argsort(size, kind="stable")
    ids, size, short = ids[order], size[order], short[order]
    ends = np.searchsorted(size, size * 100 // percent, "right")
    tree = np.arange(len(ids))
    left, right = [], []
    for i in range(len(ids) - 1):
        others = i + 1 + np.flatnonzero(tree[i + 1 : ends[i]] != tree[i])
        if len(others) == 0:
            continue
        hits = others[(short[others] == short[i]).sum(1) >= matches]
        for t in np.unique(tree[hits]):
            j = hits[np.argmax(tree[hits] == t)]
            left.append(int(ids[i]))
            right.append(int(ids[j]))
            tree[tree == t] = tree[i]
    return left, right


def _lists(percent: int, matches: int):
    """Candidate edges of each posting list; rows come sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def done(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            key, cid, size, short = (np.concatenate(x) for x in zip(*parts, strict=True))
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            length = np.diff(np.r_[first, len(key)])
            two = first[length == 2]
            two = two[(short[two] == short[two + 1]).sum(1) >= matches]
            left, right = cid[two].tolist(), cid[two + 1].tolist()
            for f, n in zip(first[length > 2], length[length > 2], strict=True):
                a, b = _forest(cid[f : f + n], size[f : f + n], short[f : f + n], percent, matches)
                left += a
                right += b
            return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            key, cid, size = (batch.column(i).to_numpy() for i in range(3))
            short = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(key), COORDINATES)
            last = int(np.searchsorted(key, key[-1]))  # where the last key begins: it may go on in the next batch
            if last == 0 and (not held or held[0][0][-1] == key[-1]):
                held.append((key, cid, size, short))
                continue
            yield done([*held, (key[:last], cid[:last], size[:last], short[:last])])
            held = [(key[last:], cid[last:], size[last:], short[last:])]
        if held:
            yield done(held)

    return run


def links(codes: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Root of each set among the sets, where sets link at 100 * intersection >= percent * union.

    Intersections come from products of 0/1 matrices over the hashes that occur more than once.
    """
    m = len(codes)
    size = np.array([len(c) for c in codes])
    flat, owner = np.concatenate(codes), np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros((m, m))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
        lo, hi = np.searchsorted(column, [a, a + WIDTH])
        grid = np.zeros((m, WIDTH), np.float32)
        grid[owner[lo:hi], column[lo:hi] - a] = 1
        both += grid @ grid.T
    near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(near, True)
    root = np.arange(m)
    while True:
        new_root = np.where(near, root[None, :], m).min(1)
        new_root = new_root[new_root]
        if (new_root == root).all():
            return root
        root = new_root


def _confirm(percent: int):
    """Confirmed edges of each group (comp, i, j); rows come sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, codes = None, [], []

        def done() -> tuple[list[int], list[int]]:
            if len(ids) < 2:
                return [], []
            root = links(codes, percent)
            return [ids[k] for k in np.flatnonzero(root != np.arange(len(ids)))], [ids[r] for k, r in enumerate(root) if r != k]

        for batch in batches:
            left, right = [], []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for a, b, raw, offsets in ta.slices(batch.column(4)):
                code, row = shingles(raw, offsets)
                at = np.searchsorted(row, np.arange(b - a + 1))
                for r in range(a, b):
                    if keys[r] != key:
                        x, y = done()
                        left += x
                        right += y
                        key, ids, codes = keys[r], [], []
                    ids.append(batch.column(3)[r].as_py())
                    codes.append(code[at[r - a] : at[r - a + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
        left, right = done()
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = PERCENT, matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Pairs at ``percent`` of Jaccard link, candidates where they agree in ``matches`` coordinates.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = cut(rows.mapInArrow(_sketches, "doc_id long, n_shingles long, digest binary, sign binary"))
    classes = cut(
        sketch.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        .groupBy("digest").agg(F.min("doc_id").alias("cid"), F.count("*").alias("copies"), F.first("sign").alias("sign"), F.first("n_shingles").alias("size"))
    )
    posted = classes.select("cid", "sign", "size").mapInArrow(_post(COORDINATES - matches + 1), "key long, cid long, size long, short binary")
    lists = posted.repartition("key").sortWithinPartitions("key", "cid")
    found = components(lists.mapInArrow(_lists(percent, matches), "a long, b long"))
    sized = found.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = cut(found.join(sized, "root").select(F.col("id").alias("doc_id"), F.col("root").alias("comp"), "blocks"))
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    grouped = (
        rows.join(small(members), "doc_id").withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "text")
        .repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "doc_id")
    )
    final = components(grouped.mapInArrow(_confirm(percent), "a long, b long"))
    moved = cut(
        classes.join(final, classes["cid"] == final["id"], "left").where((F.col("copies") > 1) | F.col("root").isNotNull())
        .select("digest", F.coalesce("root", "cid").alias("component_id"))
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return (
        sketch.drop("sign").join(moved, "digest", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[k:k+4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS k FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), r(id, root) AS (SELECT x, x FROM (SELECT DISTINCT x FROM e) UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id
), m AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id, coalesce(m.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id
"""
