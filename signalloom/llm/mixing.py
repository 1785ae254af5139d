"""Operator 3: mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are summed to cells (source, language, topic) of tokens. The targets are marginal shares: a dimension's
own shares raised to an exponent under one and brought back to sum one, which lifts small sources and languages.
No cell can give more tokens than it has, so a cell's share of the sample is at most ``cap``, its tokens over the
token budget. Targets that ask a value for more than it has are brought down to that, and what they leave goes to the
other values in proportion (``targets`` gives both figures). Raking then takes each dimension in turn: the cells of
each value are scaled by one factor to the value's target, those that reach their cap stay at it, and the factor grows
for the others until the sum is met. It ends when no weight moves any more, or after ``ROUNDS`` rounds; ``marginals`` says after how
many, and how far a weight moved in the last. A cell's rate
is its weight times the budget over its tokens; it never exceeds one, so nothing is clipped afterwards and the expected
tokens of the sample are the budget. A document is kept when a number between 0 and 1 taken from the digest of its id
lies under its cell's rate. ``marginals`` reports what the rates give for each value beside its targets; caps of
several dimensions together can keep all but the last one from being met.

The topic of a text is the one of ``TOPICS`` with the most marks (signs, and words between others' ends), among those whose marks
reach their least number in ``PER`` characters, else ``prose``. Words are looked for only in texts that hold a part of one, which
every text with such a word does.

The cells are as many as there are combinations in use, however many documents there are; documents are summed to
them before the shuffle, and a dimension's values (three numbers each) are sorted together. Cells are broadcast to the
documents only where a count shows at most ``MOST_CELLS``.

Edge cases: null source or language counts as the empty string, null and empty texts have no tokens and topic
prose; cells without tokens keep rate 1 (nothing is spent on them). Equal ids share one draw; a null id draws as
the empty string. Repeated rows give repeated rows. An empty table gives no rows. Extra columns are left out of
``mix`` and kept by ``sample``, whatever their names: the operator's own columns take a prefix that none of them has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalloom.session import cut

#: Exponents of the marginals' own shares.
EXPONENTS = {"source": 0.5, "lang": 0.3, "topic": 0.5}
DIMS = tuple(EXPONENTS)
#: At most so many rounds, fewer where one moves no weight by more than STILL; their lineage is cut after every STRIDE.
ROUNDS, STILL, STRIDE = 12, 1e-12, 3
#: Of all tokens.
BUDGET = 0.5
MOST_CELLS = 100_000
#: Topics: signs and words that mark them, and how many of these in PER characters make a text one of theirs.
PER = 1000
TOPICS = {
    "legal": ("", "[Ll]icen[sc]e[ds]?|LICENSE|[Cc]opyright|[Ww]arrant(?:y|ies)|[Pp]ermission|[Ll]iability", 2),
    "contact": ("@", "[Ee]mail|[Pp]hone|[Tt]el|[Cc]all", 5),
    "table": ("|", "", 20),
    "code": ("{};=<>", "", 20),
    "talk": ('?"', "", 20),
    "list": ("\n", "", 20),
}
#: Parts that every word of a topic has one of.
PARTS = {"legal": ("icen", "LICENSE", "opyright", "arrant", "ermission", "iability"), "contact": ("mail", "hone", "tel", "Tel", "call", "Call")}
#: A plus sign before a digit is a mark of contacts, too.
DIAL = "\\+[0-9]"


def held(text: Column, signs: str) -> Column:
    """How often the signs stand in a text."""
    n = F.length(text)
    return sum((n - F.length(F.replace(text, F.lit(m), F.lit(""))) for m in signs), F.lit(0))


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def marks(text: Column, name: str) -> Column:
    """How often a topic's signs and words stand in a text."""
    signs, words, _ = TOPICS[name]
    n = held(text, signs)
    if words:
        # Ends of words are those of ASCII, in any Java and in SQL alike.
        n = n + F.when(any_of(text, PARTS[name]), F.regexp_count(text, F.lit(f"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"))).otherwise(0)
    if name == "contact":
        n = n + F.when(F.contains(text, F.lit("+")), F.regexp_count(text, F.lit(DIAL))).otherwise(0)
    return n


def tokens(text: Column) -> Column:
    """Blank-separated pieces of a text; none of an empty one."""
    return F.when(F.length(text) > 0, held(text, " ") + 1).otherwise(0).cast("long")


def topic(size: Column, counts: dict[str, Column]) -> Column:
    """The topic with the most marks among those that reach their least number; the first of those that tie."""
    ok = {name: (c > 0) & (c * PER >= size * TOPICS[name][2]) for name, c in counts.items()}
    most = F.greatest(*(F.when(ok[name], c).otherwise(0) for name, c in counts.items()))
    return F.coalesce(*(F.when(ok[name] & (c == most), F.lit(name)) for name, c in counts.items()), F.lit("prose"))


def prefix(docs: DataFrame) -> str:
    """Begins no column of docs."""
    p = "_"
    while any(c.lower().startswith(p) for c in docs.columns):
        p += "_"
    return p


def keyed(docs: DataFrame) -> DataFrame:
    """docs with own columns prefix + source, lang, topic, tokens."""
    p, text = prefix(docs), F.coalesce(F.col("text"), F.lit(""))
    own = [F.coalesce(F.col(c), F.lit("")).alias(p + c) for c in ("source", "lang")]
    # The counts are columns of their own, so that each text is read once; none of them is null, which no join filters.
    counted = docs.select("*", *own, F.length(text).alias(p + "size"), tokens(text).alias(p + "tokens"), *(marks(text, n).alias(p + n) for n in TOPICS))
    found = topic(F.col(p + "size"), {n: F.col(p + n) for n in TOPICS})
    return counted.withColumn(p + "topic", found).drop(p + "size", *(p + n for n in TOPICS))


def fill(table: DataFrame, base: str, cap: str, total: Column, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: shares of ``total`` among the rows of ``keys`` in proportion to ``base``, none beyond its cap."""
    ask = F.coalesce(F.try_divide(F.col(cap), F.col(base)), F.lit(float("inf")))
    ranked, part = W.partitionBy(*keys).orderBy("_ask", *order), W.partitionBy(*keys)
    before = lambda c: F.coalesce(F.sum(c).over(ranked.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(base).over(part) - before(base)
    # In order of cap over base: a row is full if the factor that the rows from it on need takes it to its cap.
    full = table.withColumn("_ask", ask).withColumn("_full", F.coalesce(F.col("_ask") <= F.try_divide(total - before(cap), rest), F.lit(False)))
    spent = F.sum(F.when(F.col("_full"), F.col(cap)).otherwise(0.0)).over(part)
    free = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col(base))).over(part)
    share = F.coalesce(F.col(base) * F.try_divide(F.greatest(total - spent, F.lit(0.0)), free), F.lit(0.0))
    return full.withColumn(name, F.when(F.col("_full"), F.col(cap)).otherwise(F.least(share, F.col(cap)))).drop("_ask", "_full")


def sums(rows: DataFrame, p: str) -> DataFrame:
    """(source, lang, topic, a): tokens of each cell."""
    found = cut(rows.groupBy(*(F.col(p + d).alias(d) for d in DIMS)).agg(F.sum(p + "tokens").cast("double").alias("a")))
    # In one partition, where a count shows them to be few: no round needs an exchange then.
    return found.coalesce(1) if found.limit(MOST_CELLS + 1).count() <= MOST_CELLS else found


def targets(table: DataFrame, dim: str, budget: float) -> DataFrame:
    """(dim, asked, t): each value's target share, and that share brought down to what the value has."""
    own = table.groupBy(dim).agg(F.sum("a").alias("s")).withColumn("asked", F.when(F.col("s") > 0, F.pow("s", F.lit(EXPONENTS[dim]))).otherwise(0.0))
    # One row a value of the dimension: both totals are a small table of their own.
    total = own.agg(F.sum("asked").alias("all"), (F.sum("s") * budget).alias("b"))
    scaled = own.crossJoin(F.broadcast(total)).select(dim, F.lit(1).alias("_one"), F.coalesce(F.try_divide("asked", "all"), F.lit(0.0)).alias("asked"), F.coalesce(F.try_divide("s", "b"), F.lit(0.0)).alias("most"))
    return fill(scaled, "asked", "most", F.lit(1.0), ["_one"], [dim], "t").select(dim, "asked", "t")


def cells(table: DataFrame, budget: float = BUDGET) -> DataFrame:
    """(source, lang, topic, a, cap, w, rounds, moved): raked weights, which sum to one where there are tokens, none beyond its cap.

    ``moved``: by how much the weight that moved most did so in the last of the ``rounds``.
    """
    total = table.agg(F.sum("a").alias("_all"))
    raked = table.crossJoin(F.broadcast(total)).select(*DIMS, "a", F.coalesce(F.try_divide(F.col("a"), F.col("_all") * budget), F.lit(0.0)).alias("cap"), F.coalesce(F.try_divide("a", "_all"), F.lit(0.0)).alias("w"))
    for dim in DIMS:
        raked = raked.join(targets(table, dim, budget).select(dim, F.col("t").alias(f"t_{dim}")), dim)
    raked, n, moved = cut(raked), 0, 0.0
    while n < ROUNDS:
        for _ in range(min(STRIDE, ROUNDS - n)):
            n += 1
            raked = raked.withColumn("_was", F.col("w"))
            for dim in DIMS:
                raked = fill(raked, "w", "cap", F.col(f"t_{dim}"), [dim], list(DIMS), "w")
        raked = cut(raked)
        moved = raked.agg(F.max(F.abs(F.col("w") - F.col("_was"))).alias("moved")).first()["moved"] or 0.0
        if moved <= STILL:
            break
    return raked.select(*DIMS, "a", "cap", "w", F.lit(n).alias("rounds"), F.lit(moved).alias("moved"))


def rates(table: DataFrame, budget: float = BUDGET) -> DataFrame:
    """(source, lang, topic, a, w, rounds, moved, rate) of cells."""
    return cells(table, budget).withColumn("rate", F.least(F.lit(1.0), F.coalesce(F.try_divide("w", "cap"), F.lit(1.0)))).drop("cap")


def marginals(docs: DataFrame, budget: float = BUDGET) -> DataFrame:
    """(dimension, value, asked, target, share, rounds, moved): target shares as asked for and as the tokens allow, the expected ones, and how raking ended."""
    table = sums(keyed(docs), prefix(docs))
    found = cut(rates(table, budget).withColumn("e", F.col("a") * F.col("rate")))
    out = []
    for dim in DIMS:
        share = found.groupBy(dim).agg(F.sum("e").alias("e"), F.max("rounds").alias("rounds"), F.max("moved").alias("moved")).crossJoin(F.broadcast(found.agg(F.sum("e").alias("all"))))
        out.append(share.join(targets(table, dim, budget), dim).select(F.lit(dim).alias("dimension"), F.col(dim).alias("value"), "asked", F.col("t").alias("target"), F.try_divide("e", "all").alias("share"), "rounds", "moved"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def draw() -> Column:
    """A number from 0 to under 1 that depends on the id only."""
    part = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 12), 16, 10)
    return part.cast("double") / float(1 << 48)


def _rated(docs: DataFrame, budget: float) -> tuple[DataFrame, str]:
    p, rows = prefix(docs), keyed(docs)
    found = cut(rates(sums(rows, p), budget).select(*(F.col(d).alias(p + d) for d in DIMS), F.col("w").alias(p + "weight"), F.round(F.col("rate") + 1e-9, 6).alias(p + "rate")))
    few = found.limit(MOST_CELLS + 1).count() <= MOST_CELLS
    return rows.join(F.broadcast(found) if few else found, [p + d for d in DIMS]), p


def mix(docs: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Every document with its cell, tokens, weight, probability and whether it is sampled."""
    rows, p = _rated(docs, budget)
    return rows.select(
        "doc_id", *(F.col(p + d).alias(d) for d in DIMS), F.col(p + "tokens").alias("n_tokens"),
        F.round(F.col(p + "weight") + 1e-9, 6).alias("weight"), F.col(p + "rate").alias("probability"), (draw() < F.col(p + "rate")).alias("sampled"),
    )


def sample(docs: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The sampled rows of docs, with the columns of docs."""
    rows, p = _rated(docs, budget)
    return rows.where(draw() < F.col(p + "rate")).select(*(f"`{c}`" for c in docs.columns))


def _fill_sql(source: str, base: str, cap: str, total: str, part: str, order: str, keep: str, name: str) -> str:
    """A select that does as ``fill``; the rounds are written out one after another."""
    ranked = f"{part} ORDER BY ask, {order}"
    return f"""(SELECT {keep}, CASE WHEN full_ THEN {cap} ELSE least({cap}, coalesce({base} * greatest({total} - spent, 0) / nullif(free, 0), 0)) END AS {name}
      FROM (SELECT *, sum(CASE WHEN full_ THEN {cap} ELSE 0 END) OVER ({part}) AS spent, sum(CASE WHEN full_ THEN 0 ELSE {base} END) OVER ({part}) AS free
      FROM (SELECT *, coalesce(ask <= ({total} - coalesce(sum({cap}) OVER ({ranked} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / nullif(sum({base}) OVER ({part}) - coalesce(sum({base}) OVER ({ranked} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), false) AS full_
      FROM (SELECT *, coalesce({cap} / nullif({base}, 0), 'inf'::DOUBLE) AS ask FROM {source}))))"""


def oracle() -> str:
    """The same rows in DuckDB."""
    text = lambda m: "chr(10)" if m == "\n" else f"'{m}'"
    found = lambda pattern: [f"len(regexp_extract_all(t, '{pattern}'))"]
    counts = {
        n: " + ".join([f"length(t) - length(replace(t, {text(m)}, ''))" for m in signs] + (found(f"\\b(?:{words})\\b") if words else []) + (found(DIAL) if n == "contact" else []))
        for n, (signs, words, _) in TOPICS.items()
    }
    ok = {n: f"n_{n} > 0 AND n_{n} * {PER} >= length(t) * {least}" for n, (_, _, least) in TOPICS.items()}
    most = f"greatest({', '.join(f'CASE WHEN {c} THEN n_{n} ELSE 0 END' for n, c in ok.items())})"
    named = " ".join(f"WHEN {c} AND n_{n} = {most} THEN '{n}'" for n, c in ok.items())
    keys = ", ".join(DIMS)
    sql = f"""WITH k AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
    m AS (SELECT *, {', '.join(f'{c} AS n_{n}' for n, c in counts.items())} FROM k),
    r AS MATERIALIZED (SELECT doc_id, source, lang, CASE {named} ELSE 'prose' END AS topic,
      CASE WHEN length(t) > 0 THEN length(t) - length(replace(t, ' ', '')) + 1 ELSE 0 END AS n FROM m),
    c0 AS MATERIALIZED (SELECT source, lang, topic, sum(n)::DOUBLE AS a FROM r GROUP BY ALL), b AS MATERIALIZED (SELECT sum(a) AS al FROM c0)"""
    for d, p in EXPONENTS.items():
        sql += f""",
    s_{d} AS MATERIALIZED (SELECT {d}, sum(a) AS s, CASE WHEN sum(a) > 0 THEN pow(sum(a), {p}) ELSE 0 END AS g FROM c0 GROUP BY {d}),
    u_{d} AS MATERIALIZED (SELECT {d}, coalesce(g / nullif((SELECT sum(g) FROM s_{d}), 0), 0) AS asked, coalesce(s / nullif((SELECT al FROM b) * {BUDGET}, 0), 0) AS most FROM s_{d}),
    t_{d} AS MATERIALIZED (SELECT * FROM {_fill_sql(f"u_{d}", "asked", "most", "1.0::DOUBLE", "PARTITION BY 1", d, d, f"t_{d}")})"""
    carry = f"{keys}, a, cap, {', '.join(f't_{d}' for d in DIMS)}"
    sql += f""",
    f0 AS MATERIALIZED (SELECT {carry.replace("a, cap", "a, coalesce(a / nullif((SELECT al FROM b) * " + str(BUDGET) + ", 0), 0) AS cap")}, coalesce(a / nullif((SELECT al FROM b), 0), 0) AS w FROM c0 {' '.join(f'JOIN t_{d} USING ({d})' for d in DIMS)})"""
    n = 0
    for _ in range(ROUNDS):
        for d in DIMS:
            n += 1
            sql += f",\n    f{n} AS MATERIALIZED (SELECT * FROM {_fill_sql(f'f{n - 1}', 'w', 'cap', f't_{d}', f'PARTITION BY {d}', keys, carry, 'w')})"
    return (
        sql
        + f""",
    z AS (SELECT {keys}, w, round(least(1.0, coalesce(w / nullif(cap, 0), 1.0)) + 1e-9, 6) AS rate FROM f{n})
    SELECT doc_id, source, lang, topic, n::BIGINT AS n_tokens, round(w + 1e-9, 6) AS weight, rate AS probability,
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / {float(1 << 48)} < rate AS sampled
    FROM r JOIN z USING ({keys})"""
    )
