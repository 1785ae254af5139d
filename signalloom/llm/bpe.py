"""Operator 10: exact BPE ids by dynamic programming over prefixes, and decoding.

A vocabulary automaton with suffix links (Aho-Corasick over all tokens' bytes) reports every token that ends at
each position of a piece. The encoding of a prefix ends in one unique token: the one whose predecessor (the
last token of the prefix before it) is compatible with it, that is, no merge would have crossed the border
before both tokens were complete. Those last tokens are stored and followed back from the end.

Pieces come from the tokenizer's own pre-split. Ids of a piece do not depend on its surroundings, so a task
keeps the rendered ids of pieces in a bounded table and drops it when full; results do not depend on it.

Edge cases: null and empty texts have no tokens, and the digests of the empty string. The special token's text
is found first, as the library does. Repeated rows and ties give equal rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from signalloom.llm import text_arrays as ta

#: Entries of the tables of rendered runs and pieces; beyond that a table starts anew.
MOST_RUNS, MOST_PIECES = 200_000, 300_000
#: Only shorter pieces are kept in it.
LONGEST_KEPT = 64

#: The pre-split of byte-level vocabularies (fixed value).
PIECE = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixEncoder:
    """Encodes by the last token of every prefix; made from the text of a tokenizer file."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = {as_bytes(t): i for t, i in model["model"]["vocab"].items()}
        self.bytes_of: dict[int, bytes] = {i: t for t, i in vocab.items()}
        self.special = {a["content"]: a["id"] for a in model.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        for k, pair in enumerate(model["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = vocab[as_bytes(left)], vocab[as_bytes(right)]
            whole = vocab[self.bytes_of[a] + self.bytes_of[b]]
            self.merged[a, b] = k
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (a, b), k
        self._fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if self._sound(i):
                self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()

    def _compatible(self, a: int, b: int, before: int) -> bool:
        """Whether no merge with a rank under ``before`` joins the two sides while each is being built.

        Walks back through the two build histories, always undoing the later of the two last merges, and asks
        for each pair of border tokens whether it would have merged before the later one of them was used up.
        """
        while True:
            if self.merged.get((a, b), before) < before:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # Equal ranks: the leftmost merge comes first, so the right side's is the later one.
            if ra > rb:
                before, a = ra, self.parts[a][1]
            else:
                before, b = rb + 1, self.parts[b][0]

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a in an encoding."""
        key = a << 32 | b
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            known = self._fits[key] = self._compatible(a, b, 1 << 60)
        return known

    def _sound(self, token: int) -> bool:
        """Whether a token is the encoding of its own bytes."""
        if token not in self.parts:
            return len(self.bytes_of[token]) == 1
        a, b = self.parts[token]
        return self._compatible(a, b, self.rank[token])

    def piece(self, text: bytes) -> list[int]:
        """Ids of one piece."""
        n = len(text)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        known, fits, done = self._fits.get, self.fits, 0
        for end, (length, token) in self.automaton.iter(text.decode("latin-1")):
            if end < done:
                continue
            begin = end + 1 - length
            if begin:
                before = last[begin]
                if before < 0 or not (known(before << 32 | token) or fits(before, token)):
                    continue
            done = end + 1
            last[done], size[done] = token, length
        ids = []
        while n > 0:
            ids.append(last[n])
            n -= size[n]
        return ids[::-1]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")

    def encode(self, text: str) -> list[int]:
        """Ids of a text, special tokens found first."""
        ids: list[int] = []
        for part in self._around_special(text):
            if part in self.special:
                ids.append(self.special[part])
            else:
                for piece in PIECE.findall(part):
                    ids += self.piece(piece.encode())
        return ids

    def _around_special(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return [text]
        return [p for p in regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text) if p]


class Renderer:
    """Ids and decoded bytes of texts, by way of a bounded table of runs that the pre-split keeps apart."""

    def __init__(self, encoder: PrefixEncoder):
        self.encoder = encoder
        self.whole: dict[str, tuple[str, bytes, int]] = {}
        self.pieces: dict[str, tuple[str, bytes, int]] = {}

    def render(self, run: str) -> tuple[str, bytes, int]:
        """',id,id', decoded bytes and count of a run of whole pieces."""
        parts = [self.pieces.get(p) or self.piece(p) for p in PIECE.findall(run)]
        if len(parts) == 1:
            return parts[0]
        found = "".join([p[0] for p in parts]), b"".join([p[1] for p in parts]), sum([p[2] for p in parts])
        if len(run) <= LONGEST_KEPT:
            if len(self.whole) >= MOST_RUNS:
                self.whole.clear()
            self.whole[run] = found
        return found

    def piece(self, piece: str) -> tuple[str, bytes, int]:
        e = self.encoder
        ids = e.piece(piece.encode())
        found = "," + ",".join(map(str, ids)), b"".join([e.bytes_of[i] for i in ids]), len(ids)
        if len(piece) <= LONGEST_KEPT:
            if len(self.pieces) >= MOST_PIECES:
                self.pieces.clear()
            self.pieces[piece] = found
        return found

    @staticmethod
    def runs(text: str) -> list[str]:
        """Cuts before single blanks that stand between non-blank characters: no piece reaches across such a cut."""
        parts = text.split(" ")
        if len(parts) == 1:
            return parts if text else []
        if "" not in parts and len(text.split()) == len(parts):  # single blanks only
            return [parts[0], *[" " + p for p in parts[1:]]]
        out, grow = [parts[0]], not parts[0] or parts[0][-1].isspace()
        for p in parts[1:]:
            if grow or not p or p[0].isspace():
                out[-1] = f"{out[-1]} {p}"
            else:
                out.append(f" {p}")
            grow = not p or p[-1].isspace()
        return out

    def text(self, text: str) -> tuple[int, str, bytes]:
        """Count, ids joined by commas, decoded bytes."""
        ids: list[str] = []
        raw: list[bytes] = []
        n = 0
        e, pieces, whole = self.encoder, self.pieces.get, self.whole.get
        for part in e._around_special(text):
            if part in e.special:
                i = e.special[part]
                ids.append(f",{i}")
                raw.append(e.bytes_of[i])
                n += 1
                continue
            for run in self.runs(part):
                got = pieces(run) or whole(run) or self.render(run)
                ids.append(got[0])
                raw.append(got[1])
                n += got[2]
        return n, "".join(ids)[1:], b"".join(raw)


def digests(docs: DataFrame, spec: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text; ``spec`` is the text of a tokenizer file."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = Renderer(PrefixEncoder(shared.value)).text
        for batch in batches:
            count, ids_sha, text_sha = [], [], []
            for value in batch.column(1):
                n, ids, raw = render(value.as_py() or "")
                count.append(n)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(raw.decode("utf-8", errors="replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        del render
        ta.release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, spec: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with the token ids of each text as an array."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ta.release()
        render = Renderer(PrefixEncoder(shared.value)).text
        for batch in batches:
            ids = [np.fromstring(render(v.as_py() or "")[1], np.int32, sep=",") for v in batch.column(len(keep))]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), lists], names=[*keep, "ids"])
        del render
        ta.release()

    return docs.select(*keep, docs["text"].alias("_text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, spec: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with the text of each array of ids; a null array reads as empty."""
    shared = tokens.sparkSession.sparkContext.broadcast(spec)
    schema = tokens.select(*keep).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = PrefixEncoder(shared.value).decode
        for batch in batches:
            texts = [read(v.as_py() or []) for v in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, "text"])

    return tokens.select(*keep, tokens["ids"].alias("_ids")).mapInArrow(run, schema)
