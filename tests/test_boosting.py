"""Trees grown by Spark's sums against a plain booster that splits one leaf after another."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.operators import boosting as bo

S = bo.Settings(rounds=4, rate=0.2, leaves=6, bins=8, least_rows=5)


def table(n=400, width=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    y = np.digitize(x[:, 0] + np.sin(2 * x[:, 1]) + 0.3 * rng.normal(size=n), [-0.7, 0.7])
    x[rng.random((n, width)) < 0.05] = np.nan
    x[:, 3] = np.round(x[:, 3])
    return x, y, rng.integers(0, 3, n)


def plain(x, y, inside, classes, features, s):
    """Probabilities of all rows by trees grown leaf by leaf from the rows inside the training folds."""
    seen = inside & np.isin(y, classes)
    edges = []
    for f in range(x.shape[1]):
        v = np.sort(x[inside, f][~np.isnan(x[inside, f])])
        edges.append(np.unique([v[int(np.ceil(k / s.bins * len(v))) - 1] for k in range(1, s.bins)]))
    b = np.where(np.isnan(x), 0, np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1))
    count = np.array([(y[seen] == c).sum() for c in classes], float)
    w = count.sum() / (len(classes) * count)
    k = len(classes)
    label = np.array([classes.index(v) if v in classes else -1 for v in y])
    score = np.repeat(np.log(count * w / (count * w).sum())[None], len(x), 0)
    for _ in range(s.rounds):
        p = np.exp(score) / np.exp(score).sum(1, keepdims=True)
        step = np.zeros_like(score)
        for c in range(k):
            g = np.rint((p[:, c] - (label == c)) * w[label] * bo.UNIT)
            h = np.rint(p[:, c] * (1 - p[:, c]) * k / (k - 1) * w[label] * bo.UNIT)
            leaves = [np.arange(len(x))]
            best = lambda rows: split(rows[seen[rows]], b, g, h, features, s)  # noqa: B023, E731
            found = [best(leaves[0])]
            while len(leaves) < s.leaves:
                i = max(range(len(leaves)), key=lambda i: found[i][0])  # noqa: B023
                if found[i][0] <= 1e-9:
                    break
                rows, (_, f, t) = leaves.pop(i), found.pop(i)
                for part in (rows[b[rows, f] <= t], rows[b[rows, f] > t]):
                    leaves.append(part)
                    found.append(best(part))
            for rows in leaves:
                own = rows[seen[rows]]
                step[rows, c] = -s.rate * g[own].sum() / h[own].sum()
        score = score + step
    e = np.exp(score)
    return e / e.sum(1, keepdims=True)


def split(rows, b, g, h, features, s):
    top = (0.0, -1, -1)
    for f in features:
        for t in range(s.bins):
            left, right = rows[b[rows, f] <= t], rows[b[rows, f] > t]
            if min(len(left), len(right)) < s.least_rows or min(h[left].sum(), h[right].sum()) < s.least_curve * bo.UNIT:
                continue
            gain = sum((g[r].sum() / bo.UNIT) ** 2 / (h[r].sum() / bo.UNIT) * sign for r, sign in ((left, 1), (right, 1), (rows, -1)))
            if gain > top[0]:
                top = (gain, f, t)
    return top


@pytest.fixture(scope="module")
def fitted(spark):
    x, y, fold = table()
    rows = spark.createDataFrame([(i, int(y[i]), int(fold[i]), [None if np.isnan(v) else float(v) for v in x[i]]) for i in range(len(x))], "id int, y int, fold int, x array<double>").repartition(3)
    specs = [bo.Spec("all", 0), bo.Spec("all", 1), bo.Spec("few", 1, (1, 2, 4)), bo.Spec("ends", 2, None, (0, 2)), bo.Spec("final")]
    return rows, specs, bo.fit(rows, specs, S)


def test_models_equal_plain_ones(fitted):
    rows, specs, booster = fitted
    x, y, fold = table()
    got = {(r.id, r.model, r.c): r.p for r in booster.predict(rows).collect()}
    for spec in specs:
        want = plain(x, y, fold != spec.fold, list(spec.classes), range(5) if spec.features is None else spec.features, S)
        held = np.flatnonzero(fold == spec.fold) if spec.fold >= 0 else np.arange(len(x))
        for k, c in enumerate(spec.classes):
            assert np.allclose([got[int(i), spec.name, c] for i in held], want[held, k], rtol=1e-9), spec
    assert len(got) == 3 * 400 + 3 * (fold == 0).sum() + 6 * (fold == 1).sum() + 2 * (fold == 2).sum()


def test_scores_kept_every_few_rounds_change_nothing(fitted, monkeypatch):
    rows, specs, booster = fitted
    monkeypatch.setattr(bo, "KEEP", 2)
    again = bo.fit(rows.repartition(5), specs, S)
    assert [[vars(t) for m in r for t in m] for r in again.trees] == [[vars(t) for m in r for t in m] for r in booster.trees]


def test_written_models_predict_alike(spark, fitted, tmp_path):
    rows, _, booster = fitted
    booster.write(spark, str(tmp_path / "m"))
    back = bo.Booster.read(spark, str(tmp_path / "m"))
    plain_rows = lambda b: sorted(map(tuple, b.predict(rows, held_out=False).collect()))
    assert plain_rows(back) == plain_rows(booster) and back.specs == booster.specs
    assert booster.nodes(spark).where("feature >= 0 and threshold is null").count() == 0


def test_held_out_labels_do_not_matter(spark, fitted):
    rows, _, booster = fitted
    other = rows.withColumn("y", F.when(F.col("fold") == 1, (F.col("y") + 1) % 3).otherwise(F.col("y"))).withColumn("x", F.when(F.col("fold") == 1, F.transform("x", lambda v: v * 100)).otherwise(F.col("x")))
    again = bo.fit(other, [bo.Spec("all", 1)], S)
    assert [vars(t) for r in again.trees for t in r[0]] == [vars(t) for r in booster.trees for t in r[1]]


def test_odd_tables(spark):
    kind = "id int, y int, fold int, x array<double>"
    few = bo.Settings(rounds=2, leaves=3, least_rows=1)
    for rows in ([], [(1, 0, 0, [1.0])], [(1, None, 0, [1.0]), (2, 5, None, None), (3, 0, 1, []), (3, 0, 1, [2.0, 3.0]), (4, 1, 1, [float("nan"), 1.0])]):
        df = spark.createDataFrame(rows, kind)
        p = bo.fit(df, [bo.Spec("m")], few).predict(df).collect()
        assert len(p) == 3 * len(rows) and all(0 <= r.p <= 1 for r in p)
