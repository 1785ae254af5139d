"""The whole decision from raw epochs as one fitted object: norms, features, scorers, quality, votes, second round, arbitration.

``DecisionEstimator`` learns from training epochs, in Spark aggregates: each channel's norm, the features' norms, and the class
means of four scorers, one over features of all channels and one for each of three channels' signals. ``DecisionModel``
transforms epochs into decisions. Spatial features and second answers are made for epochs only whose scorers disagree. Both
are a Spark ML estimator and transformer; the model writes itself as small tables and reads itself again.

Edge cases: epochs whose channels or samples are not those fitted get error rows from the scorers and no decision; they are listed by
``errors``. A class without training rows has no mean and probability zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.functions import quality
from signalloom.operators import epochs as ep
from signalloom.operators import fusion as fu
from signalloom.operators.protocol import Scorer, score_rows

CLASSES = 3
#: Features of a channel.
FEATURES = ("mean", "std", "ptp")


class NearestMeans:
    """Probabilities from distances to class means: the softmax of minus half the squared distance."""

    def __init__(self, means: np.ndarray, channel: int | None = None):
        #: (classes, width), NaN for a class without rows.
        self.means, self.channel = means, channel

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        rows = rows if self.channel is None else rows[:, self.channel]
        d = -0.5 * ((rows[:, None] - self.means[None]) ** 2).sum(2)
        d = np.where(np.isnan(d), -np.inf, d)
        e = np.exp(d - d.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def base_features(z: np.ndarray) -> np.ndarray:
    """(epochs, channels * 3) of normed epochs (epochs, channels, samples), channel after channel."""
    return np.stack([z.mean(2), z.std(2), np.ptp(z, axis=2)], 2).reshape(len(z), -1)


def spatial_features(z: np.ndarray) -> np.ndarray:
    """Correlations of all pairs of channels; 0 where one is flat."""
    d = z - z.mean(2, keepdims=True)
    norm = np.sqrt((d * d).sum(2))
    r = np.einsum("nct,nkt->nck", d, d) / np.maximum(norm[:, :, None] * norm[:, None, :], 1e-12)
    a, b = np.triu_indices(z.shape[1], 1)
    return r[:, a, b]


def features(epochs: DataFrame, mean: np.ndarray, std: np.ndarray, centre: np.ndarray | None, spread: np.ndarray | None, fs: float, keys: list[str], spatial: bool) -> DataFrame:
    """(keys, x, base, more, snr_db, artifact_ratio): normed signals and features; ``more`` adds spatial features where they are asked for."""
    kinds = ", ".join(f"`{k}` {epochs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(len(keys)).to_pylist()
            out: list[tuple] = [(None, None, None, None, None)] * len(rows)
            shape = lambda r: None if r is None or any(c is None for c in r) else (len(r), *{len(c) for c in r})
            groups: dict[tuple, list[int]] = {}
            for i, r in enumerate(rows):
                s = shape(r)
                if s is not None and len(s) == 2 and s[0] == len(mean) and s[1] > 0:
                    groups.setdefault(s, []).append(i)
            for own in groups.values():
                x = np.array([rows[i] for i in own], float)
                z = (x - mean[None, :, None]) / std[None, :, None]
                base = base_features(z)
                if centre is not None:
                    base = (base - centre) / spread
                more = np.concatenate([base, spatial_features(z)], 1) if spatial else None
                snr, art = quality.snr_db(x, fs), quality.artifact_ratio(x)
                for k, i in enumerate(own):
                    out[i] = (z[k].tolist(), base[k].tolist(), None if more is None else more[k].tolist(), float(snr[k]), float(art[k]))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kind = (pa.list_(pa.list_(pa.float64())), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(c, t) for c, t in zip(columns, kind, strict=True))], names=[*keys, "x", "base", "more", "snr_db", "artifact_ratio"])

    return epochs.select(*keys, "x").mapInArrow(run, f"{kinds}, x array<array<double>>, base array<double>, more array<double>, snr_db double, artifact_ratio double")


def class_means(rows: DataFrame, width: int) -> np.ndarray:
    """(classes, width) of rows (y, v array): one row a class and place is collected."""
    found = rows.select("y", F.posexplode("v").alias("k", "v")).groupBy("y", "k").agg(F.avg("v").alias("m")).collect()
    out = np.full((CLASSES, width), np.nan)
    for r in found:
        if r.y is not None and 0 <= r.y < CLASSES:
            out[r.y, r.k] = r.m
    return out


class DecisionModel(Transformer):
    """Decisions of epochs (id, subject, y, x array<array<double>>), channels in their order."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, centre: np.ndarray, spread: np.ndarray, means: list[np.ndarray], fs: float):
        super().__init__()
        self.mean, self.std, self.centre, self.spread, self.means, self.fs = mean, std, centre, spread, means, fs

    def scorers(self) -> list[Scorer]:
        """The feature scorer, which declares its number of features, and one for each further channel's signal."""
        own = [Scorer("features", 0, "features", NearestMeans(self.means[0]), len(self.centre))]
        return own + [Scorer(f"channel_{k}", k, "signal", NearestMeans(m, k)) for k, m in enumerate(self.means[1:], 1)]

    def prepared(self, epochs: DataFrame, spatial: bool) -> DataFrame:
        return features(epochs, self.mean, self.std, self.centre, self.spread, self.fs, ["id", "subject", "y"], spatial)

    def first_round(self, epochs: DataFrame) -> DataFrame:
        return score_rows(self.prepared(epochs, False), self.scorers(), ["id", "subject", "y"])

    def errors(self, epochs: DataFrame) -> DataFrame:
        """(id, scorer, error) of what could not be scored."""
        return self.first_round(epochs).where("error is not null").select("id", "scorer", "error")

    def levels(self, epochs: DataFrame) -> DataFrame:
        """(id, level, score) of each epoch's signal quality."""
        found = self.prepared(epochs, False).where("x is not null")
        return found.select("id", ep.quality_level(F.col("snr_db"), F.col("artifact_ratio")).alias("level"), ep.quality_score(F.col("snr_db"), F.col("artifact_ratio")).alias("score"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """(id, label, confidence, arbitrated, level)."""
        columns = ["id", "subject", "y", "agent", "c", F.round(F.col("p") + 1e-9, 6).alias("p")]
        first = self.first_round(dataset).where("error is null").select(*columns)
        flags = fu.disagreement(first).select("id", "disagree")
        hot = dataset.join(flags.where("disagree"), "id", "left_semi")
        second = score_rows(self.prepared(hot, True), self.scorers(), ["id", "subject", "y"], second=True).where("error is null").select(*columns)
        levels = self.levels(dataset)
        votes = fu.weigh(first, second, levels.select("id", "level"), flags)
        return fu.best(votes, ["id", "arbitrated"], "p").join(levels.select("id", "level"), "id").select("id", "label", "confidence", "arbitrated", "level")

    def save(self, spark: SparkSession, folder: str) -> None:
        """Writes the numbers as a table (part, class, place, value) and the rate."""
        rows = [(part, -1, k, float(v)) for part in ("mean", "std", "centre", "spread") for k, v in enumerate(getattr(self, part))]
        rows += [(f"means_{a}", c, k, float(v)) for a, m in enumerate(self.means) for c in range(CLASSES) for k, v in enumerate(m[c])]
        spark.createDataFrame([*rows, ("fs", -1, 0, self.fs)], "part string, class int, place int, value double").coalesce(1).write.parquet(folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> DecisionModel:
        held: dict[str, dict[tuple[int, int], float]] = {}
        for r in spark.read.parquet(folder).collect():
            held.setdefault(r.part, {})[r["class"], r.place] = r.value
        flat = lambda part: np.array([held[part][-1, k] for k in range(len(held[part]))])
        means = [np.array([[held[part][c, k] for k in range(len(held[part]) // CLASSES)] for c in range(CLASSES)]) for part in sorted(p for p in held if p.startswith("means_"))]
        return cls(flat("mean"), flat("std"), flat("centre"), flat("spread"), means, held["fs"][-1, 0])


class DecisionEstimator(Estimator):
    """Fits a ``DecisionModel`` on epochs (id, subject, y, x) of ``channels`` by ``samples``."""

    def __init__(self, channels: int = 4, samples: int = 16, fs: float = 250.0):
        super().__init__()
        self.channels, self.samples, self.fs = channels, samples, fs

    def _fit(self, dataset: DataFrame) -> DecisionModel:
        rows = dataset.select("y", F.posexplode("x").alias("ch", "row")).select("y", "ch", F.explode("row").alias("v")).where(F.col("ch") < self.channels)
        # One row a channel; then one a feature, and one a class and place.
        own = {r.ch: r for r in rows.groupBy("ch").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()}
        mean = np.array([own[c].m if c in own else 0.0 for c in range(self.channels)])
        std = np.array([own[c].s if c in own and own[c].s >= 1e-8 else 1.0 for c in range(self.channels)])
        plain = features(dataset, mean, std, None, None, self.fs, ["id", "subject", "y"], False)
        width = self.channels * len(FEATURES)
        norms = {r.k: r for r in plain.select(F.posexplode("base").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()}
        centre = np.array([norms[k].m if k in norms else 0.0 for k in range(width)])
        spread = np.array([norms[k].s if k in norms and norms[k].s >= 1e-8 else 1.0 for k in range(width)])
        made = features(dataset, mean, std, centre, spread, self.fs, ["id", "subject", "y"], False)
        means = [class_means(made.select("y", F.col("base").alias("v")), width)]
        means += [class_means(made.select("y", F.get("x", F.lit(k)).alias("v")), self.samples) for k in range(1, self.channels)]
        return DecisionModel(mean, std, centre, spread, means, self.fs)
