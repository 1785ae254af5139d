"""Operator 11: k-means over quantised vectors with Yinyang bounds, exact in whole numbers.

Vectors become whole numbers, so distances, sums and centroids are exact and no result depends on the layout. The
centroids are clustered once into groups. Each vector carries an upper bound of the distance to its own centroid and
one lower bound for each group: the distance to the group's nearest other centroid when last seen, less what the
group's centroids have moved since. A vector whose upper bound is under all its lower bounds keeps its centroid
without any distance (the filter over all groups); else its own distance is taken, and where that doesn't settle it,
each group whose bound it doesn't clear is scanned, but for centroids that their own movement still rules out.
Bounds are compared with a slack that covers rounding, and a tie is scanned, so every assignment is that of a full scan.

A round reads the vectors with their bounds from a table in the shared folder, assigns in Arrow batches and writes the
next table; tasks then sum their clusters and Spark adds the sums up. The driver holds the centroids (``k`` of them)
and their sums only. A table goes when the one after the next is written, so two of them lie on disk.

Edge cases: vectors that are null, of another length, or hold a null or non-finite component are left out, as are
those with a component beyond 2**27 in size once quantised, whose distances a long couldn't hold. A null ``vec_id``
counts as no digits in the starting order. Vectors of one id are clustered each on its own; in the starting order ties
go by components. With fewer vectors than ``k`` there are fewer centroids; without any the result is empty. Other columns
are ignored, whatever their names. An inertia that a long can't hold is null.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.sharding import delete
from signalloom.session import checkpoint_dir

DIMS, K, ROUNDS, SCALE = 64, 16, 3, 64
#: Groups of centroids: one to so many of them.
PER_GROUP = 4
#: The driver holds the centroids and their sums; it takes no more of them.
MOST_CENTROIDS = 4096
LARGEST = 1 << 27
SLACK = 1e-9
#: Vectors that one step of a task works on.
STEP = 4096
#: What a round keeps of each vector.
STATE = "cluster int, upper double, lower array<double>, distance long, taken int"


def quantised(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and ``q``, the whole numbers floor(scale * x), of the vectors that are kept."""
    x = lambda c: c.cast("double") * scale
    fits = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(x(c)) <= LARGEST))
    return vectors.where((F.size("embedding") == dims) & fits).select("vec_id", F.transform("embedding", lambda c: F.floor(x(c)).cast("int")).alias("q"))


def first_centroids(kept: DataFrame, k: int = K, salt: str = "1:") -> np.ndarray:
    """The k vectors with the least hash of salt and id."""
    if not 0 < k <= MOST_CENTROIDS:
        raise ValueError(f"k must be in 1..{MOST_CENTROIDS}")
    order = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select("q", order.alias("h")).orderBy("h", "q").limit(k).collect()
    return np.array([r.q for r in rows], np.int64)


def grouped(centroids: np.ndarray, per_group: int = PER_GROUP, rounds: int = 5) -> np.ndarray:
    """Group number of each centroid, by a few rounds of k-means over the centroids themselves."""
    n = max(1, len(centroids) // per_group)
    at = centroids.astype(np.float64)
    middle = at[np.linspace(0, len(at) - 1, n).astype(int)]
    for _ in range(rounds):
        group = np.argmin(((at[:, None] - middle[None]) ** 2).sum(2), axis=1)
        middle = np.array([at[group == g].mean(0) if (group == g).any() else middle[g] for g in range(n)])
    return np.unique(group, return_inverse=True)[1]


def distances(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids."""
    kind = np.float64 if max(np.abs(q).max(initial=0), np.abs(centroids).max(initial=0)) < 1 << 22 else np.int64
    q, c = q.astype(kind), centroids.astype(kind)
    return ((q * q).sum(1)[:, None] - 2 * (q @ c.T) + (c * c).sum(1)[None]).astype(np.int64)


def between(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors to one centroid each."""
    return ((q.astype(np.int64) - centroids) ** 2).sum(1)


def scan(q: np.ndarray, centroids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper bound, lower bounds, distances taken) from all distances."""
    d = distances(q, centroids)
    own = d.argmin(1)
    upper = np.sqrt(d[np.arange(len(q)), own])
    d = np.sqrt(d)
    d[np.arange(len(q)), own] = np.inf
    lower = np.stack([d[:, group == g].min(1) for g in range(group.max() + 1)], 1)
    return own, upper, lower, np.full(len(q), len(centroids))


def update(q: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, group: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same as ``scan`` gives, from the bounds of the round before and how far each centroid moved since."""
    most = np.array([moved[group == g].max() for g in range(group.max() + 1)])
    own, upper, before, lower = own.copy(), upper + moved[own], lower, lower - most
    clear = lambda bound, r: bound * (1 - SLACK) - SLACK > upper[r] * (1 + SLACK)
    taken = np.zeros(len(q), np.int64)
    r = np.flatnonzero(~clear(lower.min(1), slice(None)))
    upper[r] = np.sqrt(between(q[r], centroids[own[r]]))
    taken[r] += 1
    r = r[~clear(lower[r].min(1), r)]
    if not len(r):
        return own, upper, lower, taken
    u = upper[r][:, None] * (1 + SLACK)
    near = lower[r] * (1 - SLACK) - SLACK <= u
    single = before[r][:, group] - moved
    look = near[:, group] & (single * (1 - SLACK) - SLACK <= u)
    look[np.arange(len(r)), own[r]] = False
    i, c = np.nonzero(look)
    d = between(q[r[i]], centroids[c])
    taken[r] += look.sum(1)
    whole = np.full(look.shape, np.iinfo(np.int64).max)
    whole[i, c] = d
    here = np.arange(len(r))
    whole[here, own[r]] = between(q[r], centroids[own[r]])
    best = whole.argmin(1)
    # New bounds: distances where they were taken, else what a centroid's own movement leaves of the old bound.
    bound = np.where(whole < np.iinfo(np.int64).max, np.sqrt(np.maximum(whole, 0)), single)
    upper[r] = np.sqrt(whole[here, best])
    bound[here, best] = np.inf
    scanned = np.stack([bound[:, group == g].min(1) for g in range(lower.shape[1])], 1)
    left = np.where((best != own[r])[:, None] & (np.arange(lower.shape[1]) == group[own[r]][:, None]), np.sqrt(whole[here, own[r]])[:, None], np.inf)
    lower[r] = np.where(near, scanned, np.minimum(lower[r], left))
    own[r] = best
    return own, upper, lower, taken


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind, copy=False)


def _listed(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel(), kind))


def assigned(vectors: DataFrame, centroids: np.ndarray, group: np.ndarray, moved: np.ndarray | None = None) -> DataFrame:
    """Vectors with cluster, bounds, exact distance and the distances taken to find them; ``moved`` where they have bounds."""
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, group, moved))
    names = ["vec_id", "q", "cluster", "upper", "lower", "distance", "taken"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, g, m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                q = _matrix(batch.column("q"), c.shape[1], np.int64)
                if m is None:
                    own, upper, lower, taken = scan(q, c, g)
                else:
                    held = batch.column("cluster").to_numpy(), batch.column("upper").to_numpy(), _matrix(batch.column("lower"), g.max() + 1, np.float64)
                    own, upper, lower, taken = update(q, *held, c, g, m)
                columns = [pa.array(own, pa.int32()), pa.array(upper), _listed(lower, pa.float64()), pa.array(between(q, c[own])), pa.array(taken, pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), *columns], names=names)

    kind = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, q array<int>, {STATE}"
    return vectors.select(*(c for c in names if c in vectors.columns)).mapInArrow(run, kind)


def moved_centroids(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the means of the clusters' vectors; an empty cluster keeps its centroid."""
    k, dims = centroids.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            own = batch.column(0).to_numpy()
            order = np.argsort(own, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(own[order]) != 0]) if len(own) else np.zeros(0, int)
            if len(first):
                total[own[order][first]] += np.add.reduceat(_matrix(batch.column(1), dims, np.int64)[order], first, axis=0)
                size += np.bincount(own, minlength=k)
        seen = np.flatnonzero(size)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(size[seen]), _listed(total[seen], pa.int64())], names=["cluster", "n", "total"])

    parts = table.select("cluster", "q").mapInArrow(summed, "cluster int, n long, total array<long>")
    each = parts.select("cluster", F.col("n").cast("decimal(38,0)").alias("n"), F.posexplode("total").alias("pos", "part"))
    sums = each.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("s"))
    new = centroids.copy()
    for r in sums.collect():  # k x dims rows, whatever the table holds
        new[r.cluster, r.pos] = int(r.s) // int(r.n)
    return new


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, q, cluster, upper, lower, distance, taken) of every kept vector, and the final centroids."""
    spark = vectors.sparkSession
    root = f"{checkpoint_dir(spark)}/yinyang-{uuid.uuid4().hex}"
    kept = quantised(vectors, dims, scale)
    centroids = first_centroids(kept, k)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, q array<int>, {STATE}"), centroids
    group, moved, table = grouped(centroids), None, kept
    for r in range(rounds + 1):
        assigned(table, centroids, group, moved).write.parquet(f"{root}/{r}")
        table = spark.read.parquet(f"{root}/{r}")
        if r > 1:
            delete(spark, f"{root}/{r - 2}")
        if r < rounds:
            new = moved_centroids(table, centroids)
            moved, centroids = np.sqrt(((new - centroids) ** 2).sum(1)), new
    return table, centroids


def summary(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, the inertia of the cluster and of all, and the digest of the cluster's centroid."""
    table, centroids = clusters(vectors, k, rounds, dims, scale)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # One row a centroid: MOST_CENTROIDS bounds what is collected and broadcast.
    found = {r.cluster: int(r.s) for r in table.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    long = lambda n: n if n < 1 << 63 else None
    rows = [(i, long(found[i]), long(sum(found.values())), sha[i]) for i in sorted(found)]
    facts = table.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return table.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> str:
    """The same by full scans, in DuckDB's SQL."""
    parts = [
        f"kept AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings "
        f"WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"x AS (SELECT rid, unnest(range({dims})) AS pos, unnest(q) AS v FROM kept)",
        f"s AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS c, q FROM kept QUALIFY c < {k})",
        f"c0 AS (SELECT c, unnest(range({dims})) AS pos, unnest(q) AS m FROM s)",
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS (SELECT rid, c, sum((v - m) * (v - m))::BIGINT AS d FROM x JOIN c{r} USING (pos) GROUP BY rid, c)")
        parts.append(f"a{r} AS (SELECT rid, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)")
        if r < rounds:
            parts.append(f"n{r} AS (SELECT c, pos, sum(v)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (rid) GROUP BY c, pos)")
            parts.append(f"c{r + 1} AS (SELECT c, pos, CASE WHEN n IS NULL THEN m ELSE (s - ((s % n) + n) % n) // n END AS m FROM c{r} LEFT JOIN n{r} USING (c, pos))")
    return f"""WITH {", ".join(parts)},
    h AS (SELECT c, sha256(string_agg(m::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
    SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
    FROM a{rounds} JOIN kept USING (rid) JOIN h USING (c)"""
