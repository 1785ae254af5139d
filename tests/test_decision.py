"""Scorers that fail, fall back or give nonsense, and the fitted decision written and read again."""

import numpy as np
from pyspark.ml import Pipeline

from signalloom.operators.decision import DecisionEstimator, DecisionModel, NearestMeans, spatial_features
from signalloom.operators.protocol import Scorer, score_rows

KIND = "id int, x array<array<double>>, base array<double>, more array<double>"


def test_a_failing_scorer_takes_nothing_down(spark):
    def flat(k):  # within the test, as tasks can't import it
        return lambda rows: np.ones((len(rows), k))

    def picky(rows):
        if (rows[:, 0] < 0).any():
            raise RuntimeError("negative")
        return flat(3)(rows)

    rows = spark.createDataFrame([(i, [[1.0, 2.0]], [float(-1 if i == 3 else i), 0.0], None) for i in range(8)] + [(8, None, None, None), (9, [[1.0], [1.0, 2.0]], [1.0], [1.0])], KIND).repartition(2)
    scorers = [
        Scorer("picky", 0, "features", picky, 2), Scorer("shape", 1, "features", flat(2)), Scorer("nan", 2, "features", lambda r: np.full((len(r), 3), np.nan)),
        Scorer("signal", 3, "signal", flat(3)), Scorer("broken", 4, "signal", lambda r: 1 / 0),
    ]
    got = score_rows(rows, scorers, ["id"]).collect()
    assert all((r.error is None) == (r.p is not None) == (r.c is not None) for r in got)
    errors = {(r.scorer, r.id): r.error for r in got if r.error}
    assert errors["picky", 3] == "RuntimeError: negative" and errors["picky", 9] == "takes 2 features, got 1" and errors["picky", 8] == "no features"
    assert sorted(r.id for r in got if r.scorer == "picky" and r.c == 0) == [0, 1, 2, 4, 5, 6, 7]
    assert {i for s, i in errors if s == "shape"} == set(range(10)) and {i for s, i in errors if s == "nan"} == set(range(10)) and {i for s, i in errors if s == "broken"} == set(range(10))
    assert {i for s, i in errors if s == "signal"} == {8, 9} and errors["signal", 8] == "no signal"
    assert all(abs(r.p - 1 / 3) < 1e-12 for r in got if r.p is not None)


def test_second_rounds(spark):
    first = lambda rows: np.stack([rows[:, 0, 0], 1 - rows[:, 0, 0]], 1)
    size = lambda rows: np.eye(3)[np.full(len(rows), rows.shape[1] - 1)]
    rows = spark.createDataFrame([(1, [[0.2, 0.6]], [1.0], [1.0, 2.0]), (2, [[0.0, 0.0]], [1.0, 2.0], [1.0, 2.0, 3.0])], KIND)
    scorers = [Scorer("signal", 0, "signal", first, classes=2), Scorer("any", 1, "features", size), Scorer("two", 2, "features", size, 2)]
    got = {(r.id, r.scorer, r.c): (r.p, r.augmented) for r in score_rows(rows, scorers, ["id"], second=True).collect()}
    assert np.isclose(got[1, "signal", 0][0], 0.4) and 0 < got[2, "signal", 0][0] < 1e-7
    assert got[1, "any", 1] == (1.0, True) and got[2, "any", 2] == (1.0, True)
    assert got[1, "two", 1] == (1.0, True) and got[2, "two", 1] == (1.0, False)  # three augmented features don't fit, the base does
    assert score_rows(rows.limit(0), scorers, ["id"]).count() == 0


def test_spatial_features_are_correlations():
    z = np.random.default_rng(0).normal(size=(5, 4, 30))
    z[2, 1] = 3
    got = spatial_features(z)
    for i in range(5):
        with np.errstate(all="ignore"):
            want = np.nan_to_num(np.corrcoef(z[i]))[np.triu_indices(4, 1)]
        assert np.allclose(got[i], want)
    assert np.allclose(NearestMeans(np.array([[0.0], [np.nan], [2.0]]))(np.array([[0.0]])), [[1 / (1 + np.exp(-2)), 0, np.exp(-2) / (1 + np.exp(-2))]])


def test_decisions_of_a_saved_model(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, i % 9, i % 3, (rng.normal(size=(4, 16)) * 30 + (i % 3) * 25 * np.sin(np.arange(16) / 2)).tolist()) for i in range(90)]
    epochs = spark.createDataFrame(rows, "id int, subject int, y int, x array<array<double>>")
    model = Pipeline(stages=[DecisionEstimator()]).fit(epochs).stages[0]
    model.save(spark, str(tmp_path / "m"))
    back = DecisionModel.load(spark, str(tmp_path / "m"))
    odd = epochs.unionByName(spark.createDataFrame([(100, 1, 0, None), (101, 1, 0, [[1.0] * 16] * 3), (102, 1, 0, [[0.0] * 16] * 4)], epochs.schema))
    one, two = (sorted(map(tuple, m.transform(odd).collect())) for m in (model, back))
    assert one == two and {r[0] for r in one} == {*range(90), 102}
    assert {r.id for r in back.errors(odd).collect()} == {100, 101}
    assert 0 < sum(r[3] for r in one) < len(one) and {r[4] for r in one} <= {"low", "medium", "high"}
    right = epochs.join(back.transform(epochs), "id").where("label = y").count()
    assert right > 60
    none = DecisionEstimator().fit(epochs.limit(0)).transform(epochs.limit(0))
    assert none.count() == 0
