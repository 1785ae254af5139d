"""Gradient boosting over histograms: trees grown leaf by leaf from (leaf, feature, bin) sums of gradients that Spark adds up.

Several models are fitted in the same jobs. A model is a ``Spec``: a name, the fold that it doesn't see, its features and its classes;
a row counts for each model that sees it. Bin edges, class weights and everything else of a model come from the rows it
sees, so nothing of its held-out fold leaks in.

A job of a wave takes each row down the trees as far as they are grown and sums gradients, curvatures and counts of the nodes at
hand, per task first, then by a plain aggregate. Of two siblings the smaller one is summed, the other is what its parent has
more. Best splits are found on the driver, from sums whose number depends on features, bins and leaves, not on rows. Gradients are
summed as whole numbers (in units of 2**-24), so no tree depends on how rows lie. Leaves are split in order of gain: each
wave opens those that the order reaches next, and the ones that it may reach later, so a tree takes about as many
waves as it is deep. Scores of the rows are written every ``KEEP`` rounds to the shared folder and are brought up to date within tasks.

Edge cases: a missing or NaN value counts as less than all others. Rows with a null label, or one that is no class of a model, are
not seen by it but are scored. A model without rows, with one class, or where no split gains gives its classes' shares. Features
are an array of one length for all rows; shorter or null arrays count as missing at the end. Repeated rows count as often as they come.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.session import checkpoint_dir

UNIT = float(1 << 24)
#: Rounds after which the rows' scores are written anew.
KEEP = 10
#: Sums that the driver takes of one wave: nodes x features x bins.
MOST_SUMS = 1 << 24


@dataclass(frozen=True)
class Spec:
    """A model: its name, the fold it doesn't see (-1: none), its features (None: all) and its classes."""

    name: str
    fold: int = -1
    features: tuple[int, ...] | None = None
    classes: tuple[int, ...] = (0, 1, 2)


@dataclass(frozen=True)
class Settings:
    rounds: int = 200
    rate: float = 0.05
    leaves: int = 31
    bins: int = 64
    least_rows: int = 10
    least_curve: float = 1e-3
    ridge: float = 0.0
    balanced: bool = True


@dataclass
class Tree:
    """Nodes in the order in which they were made: split feature and bin (-1: none), children, and sums of each."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [-1])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The last node that each row of bins (rows, features) comes to."""
        at = np.zeros(len(bins), np.int64)
        feature, bin_, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        while True:
            go = np.flatnonzero(left[at] >= 0)
            if not len(go):
                return at
            own = at[go]
            at[go] = np.where(bins[go, feature[own]] <= bin_[own], left[own], right[own])

    def split(self, node: int, feature: int, bin_: int) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, bin_, a, a + 1
        for x, v in ((self.feature, -1), (self.bin, -1), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            x += [v, v]
        return a, a + 1


def gradients(scores: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number gradients and curvatures (rows, classes) of the weighted log loss."""
    e = np.exp(scores - scores.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    k = scores.shape[1]
    g = (p - (labels[:, None] == np.arange(k))) * weight[:, None]
    h = p * (1 - p) * (k / max(k - 1, 1)) * weight[:, None]
    return np.rint(g * UNIT), np.rint(h * UNIT)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Number of edges under each value; a missing value has none."""
    out = np.zeros(x.shape, np.int64)
    for f, e in enumerate(edges):
        out[:, f] = np.searchsorted(e, x[:, f])
    return np.where(np.isnan(x), 0, out)


def best_split(sums: np.ndarray, features: Sequence[int], s: Settings) -> tuple[float, int, int]:
    """(gain, feature, bin) of sums (features, bins, 3); gain 0 where nothing gains. Ties go to the lowest feature, then bin."""
    left = np.cumsum(sums, axis=1)
    all_ = left[:, -1:, :]
    right = all_ - left
    score = lambda x: (x[..., 0] / UNIT) ** 2 / np.maximum(x[..., 1] / UNIT + s.ridge, 1e-12)
    gain = score(left) + score(right) - score(all_)
    fit = (np.minimum(left[..., 2], right[..., 2]) >= s.least_rows) & (np.minimum(left[..., 1], right[..., 1]) >= s.least_curve * UNIT)
    own = np.zeros(len(sums), bool)
    own[list(features)] = True
    gain = np.where(fit & own[:, None], gain, 0.0)
    at = int(gain.argmax())
    f, b = divmod(at, sums.shape[1])
    return (float(gain[f, b]), f, b) if gain[f, b] > 1e-9 else (0.0, -1, -1)


class Grower:
    """One tree of a model's class: which nodes' sums it needs next, and the tree once its order of leaves is known."""

    def __init__(self, features: Sequence[int], s: Settings):
        self.tree, self.features, self.s = Tree(), features, s
        self.sums: dict[int, np.ndarray] = {}
        self.found: dict[int, tuple[float, int, int]] = {}
        self.parent: dict[int, int] = {}

    def wanted(self) -> list[int]:
        """Nodes to be summed: the root, or the smaller child of each new split."""
        return [0] if not self.sums else [self.smaller(p) for p in self.open]

    def smaller(self, parent: int) -> int:
        _, f, b = self.found[parent]
        n = np.cumsum(self.sums[parent][f, :, 2])
        return self.tree.left[parent] if 2 * n[b] <= n[-1] else self.tree.right[parent]

    def take(self, sums: dict[int, np.ndarray]) -> bool:
        """Takes the sums asked for; whether more are wanted."""
        if not self.sums:
            self.sums = {0: sums[0]}
        else:
            for p in self.open:
                a, b = self.tree.left[p], self.tree.right[p]
                one = self.smaller(p)
                other = b if one == a else a
                self.sums[one] = sums[one]
                self.sums[other] = self.sums[p] - sums[one]
        for n in self.sums:
            if n not in self.found:
                self.found[n] = best_split(self.sums[n], self.features, self.s)
        order, leaves = self.order()
        left = self.s.leaves - 1 - len(order)
        # Splits that the order has come to, and those of most gain among the rest: they may come next.
        ahead = sorted((n for n in leaves if self.found[n][0] > 0), key=lambda n: (-self.found[n][0], n))[:left]
        self.open = [n for n in [*order, *ahead] if self.tree.left[n] < 0]
        for n in self.open:
            a, b = self.tree.split(n, *self.found[n][1:])
            self.parent[a] = self.parent[b] = n
        return bool(self.open) and left > 0

    def order(self) -> tuple[list[int], list[int]]:
        """Nodes in the order in which they are split, as far as their sums tell, and the leaves that are left."""
        done: list[int] = []
        leaves = [0]
        while len(done) < self.s.leaves - 1:
            n = max(leaves, key=lambda n: (self.found[n][0], -n))
            if self.found[n][0] <= 0:
                break
            kids = (self.tree.left[n], self.tree.right[n])
            if kids[0] not in self.sums:
                break
            done.append(n)
            leaves.remove(n)
            leaves += kids
        return done, leaves

    def finished(self) -> Tree:
        """The tree of the splits in order, with its leaves' values."""
        out, s = Tree(), self.s
        done = set(self.order()[0])
        if len(done) < s.leaves - 1:  # the last split that the order came to has children without sums
            last = max(self.order()[1], key=lambda n: (self.found[n][0], -n))
            if self.found[last][0] > 0:
                done.add(last)
        todo = [(0, 0)]
        while todo:
            old, new = todo.pop()
            total = self.total(old)
            out.value[new] = -s.rate * float(total[0] / max(total[1] + s.ridge * UNIT, 1e-12 * UNIT))
            if old in done:
                a, b = out.split(new, *self.found[old][1:])
                todo += [(self.tree.right[old], b), (self.tree.left[old], a)]
        return out

    def total(self, node: int) -> np.ndarray:
        """Sums of a node over any feature; those of a child without sums of its own from its parent's."""
        if node in self.sums:
            return self.sums[node][0].sum(0)
        p = self.parent[node]
        _, f, b = self.found[p]
        left = self.sums[p][f, : b + 1].sum(0)
        return left if node == self.tree.left[p] else self.sums[p][f].sum(0) - left


class Booster:
    """Fitted models: specs, the edges of each fold that is left out, first scores, and trees by round, model and class."""

    def __init__(self, specs: list[Spec], width: int, edges: dict[int, list[np.ndarray]], start: list[np.ndarray], trees: list[list[list[Tree]]]):
        self.specs, self.width, self.edges, self.start, self.trees = specs, width, edges, start, trees

    def scores(self, x: np.ndarray, model: int, first: int = 0, before: np.ndarray | None = None) -> np.ndarray:
        """Scores (rows, classes) of a model, from round ``first`` on."""
        spec = self.specs[model]
        out = np.repeat(self.start[model][None], len(x), 0) if before is None else before.copy()
        if first < len(self.trees):
            bins = binned(x, self.edges[spec.fold])
            for round_ in self.trees[first:]:
                for k, tree in enumerate(round_[model]):
                    out[:, k] += np.array(tree.value)[tree.nodes(bins)]
        return out

    def predict(self, rows: DataFrame, keys: Sequence[str] = ("id",), held_out: bool = True) -> DataFrame:
        """(keys, model, c, p) of rows (keys, fold, x): each row by the models that haven't seen its fold, or by all of them."""
        spark = rows.sparkSession
        shared = spark.sparkContext.broadcast(self)
        kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
        at = len(keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                fold, x = _numbers(batch.column(at), -1), _features(batch.column(at + 1), own.width)
                for m, spec in enumerate(own.specs):
                    pick = np.flatnonzero((fold == spec.fold) | (spec.fold < 0) | (not held_out))
                    if not len(pick):
                        continue
                    s = own.scores(x[pick], m)
                    e = np.exp(s - s.max(1, keepdims=True))
                    p = e / e.sum(1, keepdims=True)
                    kept = [batch.column(i).take(pa.array(np.repeat(pick, p.shape[1]))) for i in range(at)]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array([spec.name] * p.size), pa.array(np.tile(np.array(spec.classes, np.int32), len(pick))), pa.array(p.ravel())], names=[*keys, "model", "c", "p"])

        return rows.select(*keys, "fold", "x").mapInArrow(run, f"{kinds}, model string, c int, p double")

    def nodes(self, spark: SparkSession) -> DataFrame:
        """All trees as rows (model, name, fold, round, c, node, feature, threshold, left, right, value); thresholds in the features' own units."""
        out = []
        for r, round_ in enumerate(self.trees):
            for m, own in enumerate(round_):
                for k, t in enumerate(own):
                    edges = self.edges[self.specs[m].fold]
                    out += [(m, self.specs[m].name, self.specs[m].fold, r, self.specs[m].classes[k], i, f, float(edges[f][b]) if f >= 0 else None, lo, hi, v) for i, (f, b, lo, hi, v) in enumerate(zip(t.feature, t.bin, t.left, t.right, t.value, strict=True))]
        return spark.createDataFrame(out, "model int, name string, fold int, round int, c int, node int, feature int, threshold double, left int, right int, value double")

    def write(self, spark: SparkSession, folder: str) -> None:
        """Models and trees as two small tables."""
        specs = [(m, s.name, s.fold, list(s.features) if s.features is not None else None, list(s.classes), self.width, self.start[m].tolist(), [e.tolist() for e in self.edges[s.fold]]) for m, s in enumerate(self.specs)]
        kind = "model int, name string, fold int, features array<int>, classes array<int>, width int, start array<double>, edges array<array<double>>"
        spark.createDataFrame(specs, kind).coalesce(1).write.parquet(f"{folder}/models")
        self.nodes(spark).coalesce(1).write.parquet(f"{folder}/trees")

    @staticmethod
    def read(spark: SparkSession, folder: str) -> Booster:
        models = spark.read.parquet(f"{folder}/models").orderBy("model").collect()
        specs = [Spec(r.name, r.fold, tuple(r.features) if r.features is not None else None, tuple(r.classes)) for r in models]
        edges = {r.fold: [np.array(e) for e in r.edges] for r in models}
        trees: list[list[list[Tree]]] = []
        for r in spark.read.parquet(f"{folder}/trees").orderBy("round", "model", "c", "node").collect():
            if r["round"] == len(trees):
                trees.append([[Tree([], [], [], [], []) for _ in s.classes] for s in specs])
            t = trees[r["round"]][r.model][specs[r.model].classes.index(r.c)]
            t.feature.append(r.feature)
            t.bin.append(int(np.searchsorted(edges[specs[r.model].fold][r.feature], r.threshold)) if r.feature >= 0 else -1)
            t.left.append(r.left)
            t.right.append(r.right)
            t.value.append(r.value)
        return Booster(specs, models[0].width, edges, [np.array(r.start) for r in models], trees)


def _numbers(column: pa.Array, missing: int) -> np.ndarray:
    return column.fill_null(missing).to_numpy(zero_copy_only=False).astype(np.int64)


def _features(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) of an array column; what isn't there is NaN."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = np.full((len(column), width), np.nan)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    where = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    row = np.repeat(np.arange(len(size)), size)
    out[row[where < width], where[where < width]] = flat[where < width]
    return out


def edges_of(rows: DataFrame, folds: Sequence[int], width: int, bins: int) -> dict[int, list[np.ndarray]]:
    """For each fold and feature at most ``bins`` - 1 distinct values that split the rows outside of the fold evenly."""
    shares = [k / bins for k in range(1, bins)]
    values = rows.select("fold", F.posexplode("x").alias("pos", "v")).where((F.col("pos") < width) & F.col("v").isNotNull() & ~F.isnan("v"))
    each = values.withColumn("out", F.explode(F.array(*map(F.lit, folds)))).where(~F.col("out").eqNullSafe(F.col("fold")))
    found = each.groupBy("out", "pos").agg(F.percentile_approx("v", shares, F.lit(10_000)).alias("e")).collect()
    edges = {f: [np.zeros(0) for _ in range(width)] for f in folds}
    for r in found:
        edges[r.out][r.pos] = np.unique(np.array(r.e, float))
    return edges


def fit(rows: DataFrame, specs: Sequence[Spec], settings: Settings | None = None) -> Booster:
    """Models of rows (y int, fold int, x array<double>), all fitted in the same jobs."""
    s, specs, spark = settings or Settings(), list(specs), rows.sparkSession
    root = f"{checkpoint_dir(spark)}/boosting-{uuid.uuid4().hex}"
    plain = rows.select(F.col("y").cast("int").alias("y"), F.col("fold").cast("int").alias("fold"), F.col("x").cast("array<double>").alias("x"))
    plain.write.parquet(f"{root}/rows-0")
    table = spark.read.parquet(f"{root}/rows-0")
    width = table.agg(F.max(F.size("x"))).first()[0] or 0
    edges = edges_of(table, sorted({m.fold for m in specs}), width, s.bins)
    n = {(r.fold, r.y): r["count"] for r in table.where("y is not null").groupBy("fold", "y").count().collect()}
    seen = [[sum(v for (f, y), v in n.items() if y == c and (f != m.fold or m.fold < 0)) for c in m.classes] for m in specs]
    weight, start = [], []
    for own in seen:
        count = np.array(own, float)
        w = np.where(count > 0, count.sum() / (max(np.count_nonzero(count), 1) * np.maximum(count, 1)), 0.0) if s.balanced else np.ones(len(own))
        share = count * w
        weight.append(w)
        start.append(np.log(np.maximum(share / share.sum(), 1e-12)) if share.sum() else np.full(len(own), -np.log(len(own))))
    booster = Booster(specs, width, edges, start, [])
    columns = [tuple(range(width)) if m.features is None else m.features for m in specs]
    kept = 0
    for r in range(s.rounds):
        growers = {(m, k): Grower(columns[m], s) for m, spec in enumerate(specs) for k in range(len(spec.classes)) if sum(v > 0 for v in seen[m]) > 1}
        live = dict(growers)
        while live:
            asked = {key: g.wanted() for key, g in live.items()}
            sums = _wave(table, booster, kept, {key: g.tree for key, g in live.items()}, asked, weight, s.bins)
            live = {key: g for key, g in live.items() if g.take(sums[key])}
        booster.trees.append([[growers[m, k].finished() if (m, k) in growers else Tree() for k in range(len(spec.classes))] for m, spec in enumerate(specs)])
        if (r + 1) % KEEP == 0 and r + 1 < s.rounds:
            _scored(table, booster, kept).write.parquet(f"{root}/rows-{r + 1}")
            table, kept = spark.read.parquet(f"{root}/rows-{r + 1}"), r + 1
    return booster


def _state(batch: pa.RecordBatch, booster: Booster, model: int, kept: int, x: np.ndarray) -> np.ndarray:
    """A model's scores of a batch's rows, from those written after round ``kept``."""
    before = None
    if kept:
        a = sum(len(m.classes) for m in booster.specs[:model])
        k = len(booster.specs[model].classes)
        whole = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        before = whole[:, a : a + k]
    return booster.scores(x, model, kept, before)


def _scored(table: DataFrame, booster: Booster, kept: int) -> DataFrame:
    """The rows with all models' scores as one array."""
    shared = table.sparkSession.sparkContext.broadcast(booster)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            x = _features(batch.column(2), own.width)
            f = np.concatenate([_state(batch, own, m, kept, x) for m in range(len(own.specs))], 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, f.shape[1], dtype=np.int32)), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names=["y", "fold", "x", "f"])

    return table.mapInArrow(run, "y int, fold int, x array<double>, f array<double>")


def _wave(table: DataFrame, booster: Booster, kept: int, trees: dict, asked: dict, weight: list[np.ndarray], bins: int) -> dict:
    """Sums (features, bins, 3) of the nodes asked for, by (model, class) and node."""
    spark = table.sparkSession
    places = [(key, node) for key, nodes in asked.items() for node in nodes]
    if len(places) * booster.width * bins > MOST_SUMS:
        raise ValueError(f"{len(places)} nodes of {booster.width} features and {bins} bins are more than the driver takes")
    shared = spark.sparkContext.broadcast((booster, trees, asked, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, grown, nodes, weights = shared.value
        width = own.width
        total = {key: np.zeros((len(v), width, bins, 3)) for key, v in nodes.items()}
        for batch in batches:
            y, fold, x = _numbers(batch.column(0), -1), _numbers(batch.column(1), -1), _features(batch.column(2), width)
            held = {f: binned(x, e) for f, e in own.edges.items()}
            for m, spec in enumerate(own.specs):
                keys = [key for key in nodes if key[0] == m]
                label = np.full(len(y), -1)
                for k, c in enumerate(spec.classes):
                    label[y == c] = k
                pick = np.flatnonzero((label >= 0) & ((fold != spec.fold) | (spec.fold < 0)))
                if not keys or not len(pick):
                    continue
                g, h = gradients(_state(batch, own, m, kept, x)[pick], label[pick], weights[m][label[pick]])
                b = held[spec.fold][pick]
                for key in keys:
                    at = grown[key].nodes(b)
                    slot = np.full(len(grown[key].feature), -1)
                    slot[nodes[key]] = np.arange(len(nodes[key]))
                    inside = np.flatnonzero(slot[at] >= 0)
                    place = slot[at[inside]] * bins
                    for f in range(width):
                        cell = place + b[inside, f]
                        size = len(nodes[key]) * bins
                        for i, w in enumerate((g[inside, key[1]], h[inside, key[1]], None)):
                            total[key][:, f, :, i] += np.bincount(cell, w, size).reshape(-1, bins)
        for key, sums in total.items():
            slot, f, bin_ = np.nonzero(sums[..., 2])
            found = sums[slot, f, bin_].astype(np.int64)
            first = next(i for i, p in enumerate(places) if p[0] == key)
            yield pa.RecordBatch.from_arrays([pa.array((first + slot).astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(bin_.astype(np.int32)), *(pa.array(found[:, i]) for i in range(3))], names=["place", "feature", "bin", "g", "h", "n"])

    parts = table.mapInArrow(run, "place int, feature int, bin int, g long, h long, n long")
    rows = parts.groupBy("place", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
    out = {key: {node: np.zeros((booster.width, bins, 3)) for node in nodes} for key, nodes in asked.items()}
    place, f, bin_, *sums = (rows.column(i).to_numpy() for i in range(6))
    for p, (key, node) in enumerate(places):
        own = place == p
        for i in range(3):
            out[key][node][f[own], bin_[own], i] = sums[i][own]
    return out
