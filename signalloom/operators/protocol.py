"""Scorers of one's own: what each takes and gives is declared, and one pass over the rows runs them all.

A scorer is a function of many rows at once. One that takes features declares their number: in a second round it gets the augmented
features where these have that number, else the base ones. One that takes signals gets (rows, channels, samples), and in
a second round the mean of its answers to the signal and to the signal reversed in time. What a scorer gives is checked: a row of
non-negative numbers for each row asked, one for each class, brought to sum one.

A scorer that fails takes no other down: rows are tried one by one, those that fail become rows with an ``error`` and no
probability, and the other scorers' rows are as they would be.

Edge cases: a null signal or feature array is an error row of the scorers that take it, and so are features of a wrong number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that a scorer is given at a time.
STEP = 512


@dataclass(frozen=True)
class Scorer:
    """``takes``: "features" (``width`` of them, None: any number) or "signal"; ``score`` maps arrays of rows to (rows, classes)."""

    name: str
    agent: int
    takes: str
    score: Callable[[np.ndarray], np.ndarray]
    width: int | None = None
    classes: int = 3


def checked(scorer: Scorer, given: np.ndarray) -> np.ndarray:
    """The scorer's probabilities, refused where they aren't what was declared."""
    p = np.asarray(scorer.score(given), dtype=float)
    if p.shape != (len(given), scorer.classes):
        raise ValueError(f"gave {p.shape} for {len(given)} rows of {scorer.classes} classes")
    if not np.isfinite(p).all() or (p < 0).any() or (p.sum(1) <= 0).any():
        raise ValueError("gave numbers that are no probabilities")
    return p / p.sum(1, keepdims=True)


def answer(scorer: Scorer, given: np.ndarray, second: bool) -> np.ndarray:
    """Probabilities of one round."""
    p = checked(scorer, given)
    if second and scorer.takes == "signal":
        p = np.maximum((p + checked(scorer, given[:, :, ::-1])) / 2, 1e-8)
        p /= p.sum(1, keepdims=True)
    return p


def inputs(scorer: Scorer, x: list, base: list, more: list, second: bool) -> tuple[list, list[bool], list[str | None]]:
    """What each row gives the scorer, whether that is the augmented features, and what is wrong with it."""
    found, used, wrong = [], [], []
    for row, own, extra in zip(x, base, more, strict=True):
        if scorer.takes == "signal":
            found.append(row)
            used.append(False)
            wrong.append("no signal" if row is None else None)
            continue
        wide = second and extra is not None and scorer.width in (None, len(extra))
        pick = extra if wide else own
        found.append(pick)
        used.append(wide)
        wrong.append("no features" if pick is None else None if scorer.width in (None, len(pick)) else f"takes {scorer.width} features, got {len(pick)}")
    return found, used, wrong


def scored(scorer: Scorer, given: list, wrong: list[str | None], second: bool) -> tuple[np.ndarray, list[str | None]]:
    """(probabilities, errors) of rows; those of like shape go together, and one by one where the scorer fails on them."""
    p, error = np.full((len(given), scorer.classes), np.nan), list(wrong)
    shapes: dict[tuple, list[int]] = {}
    for i, row in enumerate(given):
        if error[i] is None:
            try:
                shapes.setdefault(np.shape(row), []).append(i)
            except ValueError:
                error[i] = "channels of unequal length"
    for own in shapes.values():
        for a in range(0, len(own), STEP):
            part = own[a : a + STEP]
            try:
                p[part] = answer(scorer, np.array([given[i] for i in part], float), second)
            except Exception:  # noqa: BLE001 what a scorer raises is its own
                for i in part:
                    try:
                        p[i] = answer(scorer, np.array([given[i]], float), second)[0]
                    except Exception as e:  # noqa: BLE001
                        error[i] = f"{type(e).__name__}: {e}"
    return p, error


def score_rows(rows: DataFrame, scorers: Sequence[Scorer], keys: Sequence[str], second: bool = False) -> DataFrame:
    """(keys, agent, scorer, c, p, augmented, error) of rows (keys, x array<array>, base array, more array) by all scorers.

    A row that a scorer can't answer has one row with null c and p.
    """
    own, kinds = tuple(scorers), ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    at = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, base, more = (batch.column(at + i).to_pylist() for i in range(3))
            for s in own:
                given, used, wrong = inputs(s, x, base, more, second)
                p, error = scored(s, given, wrong, second)
                fine = np.flatnonzero([e is None for e in error])
                bad = np.flatnonzero([e is not None for e in error])
                row = np.r_[np.repeat(fine, s.classes), bad]
                c = pa.array(np.r_[np.tile(np.arange(s.classes), len(fine)), np.zeros(len(bad), int)], pa.int32(), mask=np.r_[np.zeros(len(fine) * s.classes, bool), np.ones(len(bad), bool)])
                values = pa.array(np.r_[p[fine].ravel(), np.zeros(len(bad))], mask=np.r_[np.zeros(len(fine) * s.classes, bool), np.ones(len(bad), bool)])
                kept = [batch.column(i).take(pa.array(row)) for i in range(at)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array([s.agent] * len(row), pa.int32()), pa.array([s.name] * len(row), pa.string()), c, values, pa.array([used[i] for i in row], pa.bool_()), pa.array([error[i] for i in row], pa.string())],
                    names=[*keys, "agent", "scorer", "c", "p", "augmented", "error"],
                )

    return rows.select(*keys, "x", "base", "more").mapInArrow(run, f"{kinds}, agent int, scorer string, c int, p double, augmented boolean, error string")
