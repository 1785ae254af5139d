"""Operator 13: secrets by fixed patterns plus assignment-aware lexing of source and configuration syntax.

The patterns give the base spans, leftmost and non-overlapping per kind; matches that fail their length are dropped.

The lexer reads the lines that hold an assignment sign or a call with a quoted argument, and goes on to the next line where an
expression does. Its tokens are names, quoted strings, numbers and signs; an apostrophe within a word opens no
string. From them come pairs of a name and a literal: ``name = "x"``, ``name: "x"``, ``"name": "x"``, ``name => "x"``,
``table["name"] = "x"``, ``String name = "x"``, ``name: str = "x"``, keyword arguments, ``export NAME=x`` and ``name: x`` lines,
``set_name("x")``, ``put("name", "x")`` and ``name=x`` within connection strings. Constants are propagated in the order of the
text: a name stands for the literals last assigned to it, through sums, alternatives, lists and further names, so that a
literal is scored under every name it reaches. A literal's score is that of its name (words of the name by
weight, less for names of paths, types or sizes) times that of its own text (length, kinds of characters, entropy; none
for placeholders). From ``THRESHOLD`` on its span is added where it overlaps no base span.

Everything is linear in the text. A name's literals are a graph whose shared parts are scored once a name score, so long chains of
sums cost no more than their length.

Edge cases: null and empty texts have no spans and the digest of the empty string. Offsets are code points, ends exclusive.
Unclosed quotes and brackets end with their line. Repeated rows give repeated rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.llm import text_arrays as ta

BASE = ("assign", "access", "hex")
#: Kinds in the order of spans with one start.
KINDS = (*BASE, "literal")
THRESHOLD = 0.5
SPAN = "array<struct<kind:string,start:bigint,end:bigint,name:string,score:double>>"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")

#: Where a line is worth reading.
_SIGN = re.compile(r"""[=:]|\(\s?["']""")
_TOKEN = re.compile(
    r"""(?P<blank>[^\S\n]++|\\\r?\n)|(?P<line>\n)"""
    r"""|(?P<string>(?<!\w)[bfru]{0,2}(?:\"{3}(?:[^"\\]|\\.|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3}|"(?:[^"\\\n]|\\[^\n])*+"(?!\w)|'(?:[^'\\\n]|\\[^\n])*+'(?!\w)|`[^`\n]*+`))"""
    r"""|(?P<name>[^\W\d][\w$]*+(?:-[^\W_][\w$]*+)*+|\$[\w{}]++)|(?P<number>\d[\w.]*+)|(?P<sign>:=|=>|->|::|==|!=|<=|>=|\+=|\|\||\?\?|.)""",
    re.DOTALL,
)
_QUOTED = re.compile(r"""[bfru]{0,2}("{3}|'{3}|["'`])(.*)\1""", re.DOTALL)
_WITHIN = re.compile(r"([A-Za-z_][\w.-]*+)=([^\s;&,\"'=]++)")
_BARE = re.compile(r"""[^\S\n]*([^\s#;,"'`(){}\[\]]+)[^\S\n]*(?=$|\n|[#;])""")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

_ASSIGNS = frozenset(("=", ":=", "=>", ":", "+="))
_JOINS = frozenset(("+", ".", "||", "??", "?"))
_BEFORE = frozenset(("export", "set", "let", "var", "const", "final", "static", "public", "private", "env", "arg", "-", "def", "val"))
_TYPES = frozenset(("str", "string", "bytes", "char", "text", "any", "auto", "object", "charsequence"))
#: Calls that look a value up by its name, and calls that take a name and its value.
_LOOKUPS = frozenset(("get", "getenv", "env", "environ", "lookup", "read", "open", "load", "fetch", "input", "prompt", "getpass", "getproperty", "require", "print", "len"))
_PUTS = frozenset(("put", "set", "setproperty", "setenv", "putenv", "define", "add", "setdefault", "append", "setitem", "header", "setheader", "addheader"))

#: Weights of a name's words, alone and in pairs.
_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.95, "pass": 0.8, "secret": 1.0, "secrets": 1.0, "token": 0.95, "tokens": 0.95, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.7, "authorization": 0.85, "bearer": 0.85, "jwt": 0.85, "key": 0.55, "pin": 0.5, "salt": 0.5, "signature": 0.5,
    "api key": 1.0, "access key": 1.0, "private key": 1.0, "secret key": 1.0, "signing key": 1.0, "encryption key": 1.0, "account key": 0.95, "auth key": 0.95, "master key": 0.95, "client secret": 1.0,
}
#: Words that say something about a secret rather than hold one.
_ABOUT = frozenset("path file dir name url uri type length size count field label hint placeholder min max expiry expires ttl policy regex pattern prefix version id index public column table format error message test".split())
_EMPTY = re.compile(r"(?i)example|change.?me|your|placeholder|dummy|xxxx|\*{3}|todo|redacted|[<>]|\$\{|\{\{|%s|null|none|undefined")

Node = list  # [start, end, best name score yet] of a literal, or [list of nodes, None, best name score yet]


def name_score(name: str) -> float:
    """How likely a name is to hold a secret."""
    parts = [p.lower() for p in _PART.findall(name)]
    found = max((_WEIGHTS.get(p, 0.0) for p in (*parts, *map(" ".join, zip(parts, parts[1:], strict=False)))), default=0.0)
    return found * 0.4 if _ABOUT.intersection(parts) else found


def literal_score(value: str) -> float:
    """How likely a literal is to be one."""
    n = len(value)
    if n < 6 or _EMPTY.search(value):
        return 0.0
    counts = Counter(value)
    if len(counts) < 4:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = any(c.islower() for c in counts) + any(c.isupper() for c in counts) + any(c.isdigit() for c in counts) + any(not c.isalnum() for c in counts)
    score = 0.3 * min(1, n / 16) + 0.3 * min(1, entropy / 3.5) + (0, 0.05, 0.3, 0.35, 0.4)[kinds]
    return min(1.0, score) * (0.3 if " " in value or "\n" in value else 0.5 if value.startswith(("http:", "https:", "/", "./")) else 1.0)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) that the patterns accept."""
    out = []
    if "=" in text or ":" in text:
        out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def tokens(text: str) -> Iterator[list[tuple[str, int, int, str]]]:
    """(kind, start, end, text) of the tokens of each stretch of lines that is worth reading."""
    at = 0
    while m := _SIGN.search(text, at):
        at = text.rfind("\n", at, m.start()) + 1 or at
        out, depth = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            at, kind, said = m.end(), m.lastgroup, m.group()
            if kind == "blank":
                continue
            if kind == "line":
                # An open bracket, a sum or an assignment goes on in the next line.
                if not out or not (depth > 0 or out[-1][3] in ("+", "||", "??", "=", ":=", "=>", ":")) or out[-1][0] == "line":
                    break
                out.append(("line", m.start(), at, said))
                continue
            if kind == "sign":
                depth += (said in "([") - (said in ")]")
            out.append((kind, m.start(), at, said))
        yield out


def quoted(said: str) -> tuple[int, int]:
    """Begin and end of a string token's content within it."""
    m = _QUOTED.fullmatch(said)
    return m.span(2)


class Scan:
    """Literals of one text, with the names that they reach."""

    def __init__(self, text: str):
        self.text = text
        self.known: dict[str, Node] = {}
        self.found: dict[tuple[int, int], tuple[float, str]] = {}
        #: Colons between two alternatives.
        self.passed: set[int] = set()
        for own in tokens(text):
            self.read(own)

    def read(self, own: list) -> None:
        for k, (kind, a, b, said) in enumerate(own):
            if kind == "sign":
                if said in _ASSIGNS and a not in self.passed:
                    self.assign(own, k)
                elif said == "(":
                    self.call(own, k)
            elif kind == "string" and "=" in said:
                for m in _WITHIN.finditer(self.text, a, b):
                    self.reach([m.start(2), m.end(2), 0.0], m.group(1))

    def leaf(self, token: tuple) -> Node:
        lo, hi = quoted(token[3]) if token[0] == "string" else (0, len(token[3]))
        return [token[1] + lo, token[1] + hi, 0.0]

    def target(self, own: list, k: int) -> tuple[str, int]:
        """Name that the sign at k assigns to and the index where it begins; an empty name where there is none."""
        i = k - 1
        while i >= 0 and own[i][0] == "line":
            i -= 1
        if i < 0:
            return "", 0
        if own[i][0] == "string":
            lo, hi = quoted(own[i][3])
            return own[i][3][lo:hi] if hi - lo <= 64 else "", i
        if own[i][3] == "]" and i >= 2 and own[i - 1][0] in ("string", "name"):
            return own[i - 1][3], i - 2
        if own[i][0] != "name":
            return "", 0
        if own[k][3] == "=" and i >= 2 and own[i - 1][3] == ":" and own[i - 2][0] == "name":
            return own[i - 2][3], i - 2  # name: type = value
        if own[i][3].lower() in _TYPES and i >= 1 and own[i - 1][0] == "name":
            i -= 1  # name type = value
        end = i
        while i >= 2 and own[i - 1][3] in (".", "->", "::") and own[i - 2][0] == "name" and own[i - 1][1] == own[i - 2][2]:
            i -= 2
        return ".".join(t[3] for t in own[i : end + 1 : 2]), i

    def assign(self, own: list, k: int) -> None:
        name, first = self.target(own, k)
        if not name:
            return
        node = self.value(own, k + 1)
        if node is None and all(t[3].lower() in _BEFORE for t in self.line_before(own, first)):
            node = self.bare(own[k][2])
        last = re.split(r"[.]", name.strip("\"'"))[-1].lstrip("$")
        if own[k][3] == "+=" and node is not None and last in self.known:
            node = [[self.known[last], node], None, 0.0]
        if node is not None:
            self.reach(node, name)
            self.known[last] = node
        elif own[k][3] != ":":
            self.known.pop(last, None)

    def line_before(self, own: list, i: int) -> list:
        """Tokens of the line before index i, the nearest first; four tell enough."""
        out = []
        while i > 0 and own[i - 1][0] != "line" and len(out) < 4:
            i -= 1
            out.append(own[i])
        return out

    def bare(self, at: int) -> Node | None:
        """An unquoted value that ends its line; a plain word is a name, not a literal."""
        m = _BARE.match(self.text, at)
        if not m:
            return None
        said = m.group(1)
        if said.lstrip("$") in self.known:
            return self.known[said.lstrip("$")]
        return None if said.isalpha() or said[0] in "$&*" else [*m.span(1), 0.0]

    def value(self, own: list, k: int) -> Node | None:
        """The literals of the expression at k, as one node."""
        kids: list[Node] = []
        depth, asked, expects = 0, 0, True
        while k < len(own):
            kind, _, b, said = own[k]
            if kind == "line":
                if not (expects or depth):
                    break
            elif kind == "string":
                if not expects and own[k - 1][0] != "string":
                    break
                kids.append(self.leaf(own[k]))
                expects = False
            elif kind == "name":
                last = said
                while k + 2 < len(own) and own[k + 1][3] in (".", "->", "::") and own[k + 2][0] == "name" and own[k + 1][1] == own[k][2]:
                    k += 2
                    last = own[k][3]
                called = k + 1 < len(own) and own[k + 1][3] == "("
                if called:
                    if last.lower().replace("_", "") in _LOOKUPS:
                        k, expects = self.closed(own, k + 1), False
                        continue
                    if last.lower().replace("_", "") in _PUTS or k + 2 >= len(own) or own[k + 2][0] != "string":
                        break
                    depth, k = depth + 1, k + 1
                elif last.lower() in ("or", "await", "new"):
                    expects = True
                elif last.lstrip("$") in self.known:
                    kids.append(self.known[last.lstrip("$")])
                    expects = False
                elif not expects:
                    break
                else:
                    expects = False
            elif kind == "number" and depth == 0 and expects and not kids and (k + 1 == len(own) or own[k + 1][0] == "line" or own[k + 1][3] in ";,)}"):
                kids.append(self.leaf(own[k]))
                break
            elif said in ("(", "["):
                depth += 1
            elif said in (")", "]") and depth:
                depth -= 1
                expects = False
            elif said == ":" and asked:
                asked, expects = asked - 1, True
                self.passed.add(own[k][1])
            elif said in _JOINS or (said == "," and depth):
                asked += said == "?"
                expects = True
            else:
                break
            k += 1
        return kids[0] if len(kids) == 1 else [kids, None, 0.0] if kids else None

    def closed(self, own: list, k: int) -> int:
        """Index after the bracket that closes the one at k, or of an assignment before that."""
        depth = 0
        while k < len(own) and own[k][3] not in _ASSIGNS:
            depth += (own[k][3] in ("(", "[")) - (own[k][3] in (")", "]"))
            k += 1
            if not depth:
                break
        return k

    def call(self, own: list, k: int) -> None:
        """set_name("x") and put("name", "x")."""
        if k < 1 or own[k - 1][0] != "name" or k + 1 >= len(own) or own[k + 1][0] != "string":
            return
        name = own[k - 1][3]
        if k + 3 < len(own) and own[k + 2][3] == "," and name.lower().replace("_", "") in _PUTS:
            lo, hi = quoted(own[k + 1][3])
            node = self.value(own, k + 3)
            if node is not None and hi - lo <= 64:
                self.reach(node, own[k + 1][3][lo:hi])
        elif name.lower().startswith(("set", "with", "use")):
            self.reach(self.leaf(own[k + 1]), name)

    def reach(self, node: Node, name: str) -> None:
        """Scores the literals below a node under a name; parts that a name as telling has reached stay as they are."""
        weight = name_score(name)
        if weight < THRESHOLD:
            return
        todo = [node]
        while todo:
            node = todo.pop()
            if node[2] >= weight:
                continue
            node[2] = weight
            if node[1] is None:
                todo += node[0]
                continue
            span = (node[0], node[1])
            score = weight * literal_score(self.text[node[0] : node[1]])
            if score >= THRESHOLD and score > self.found.get(span, (0.0, ""))[0]:
                self.found[span] = (score, name.strip("\"'`"))


def found_spans(text: str) -> list[tuple[str, int, int, str | None, float]]:
    """(kind, start, end, name, score) of base spans, score 1, and added literals, by start, then kind."""
    base = base_spans(text)
    out = [(k, a, b, None, 1.0) for k, a, b in base]
    if more := Scan(text).found:
        starts, ends = [], []
        for a, b in sorted((a, b) for _, a, b in base):
            if ends and a <= ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        for (a, b), (score, name) in more.items():
            i = bisect_right(ends, a)
            if i == len(ends) or starts[i] >= b:
                out.append(("literal", a, b, name, score))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` of every text, with the names and scores of added literals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))
        keys = ("kind", "start", "end", "name", "score")
        for batch in batches:
            said = [[dict(zip(keys, s, strict=True)) for s in found_spans(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, kind)], names=["doc_id", "spans"])
        ta.release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPAN}")


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, base_sha256 and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(k) for k in BASE]
    return scan(docs).select("doc_id", *counts, F.sha2(_said(base), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """doc_id and ``text`` with every span, those that overlap as one, replaced by a mark; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for t in batch.column(1):
                text, out, at = t.as_py(), [], 0
                for _, a, b, _, _ in found_spans(text or ""):
                    if a >= at:
                        out += [text[at:a], mark]
                    at = max(at, b)
                new.append(None if text is None else "".join([*out, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")
