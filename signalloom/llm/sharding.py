"""Operator 7: size-tiered compaction of append-only shards under a versioned manifest, in DataFrame functions only.

``append`` writes each arrival as small immutable Parquet shards (one file a task and ``most_rows`` rows) and adds
them to a new version of the manifest. ``compact`` sorts the live shards under the target size into tiers by the
power of ``fanout`` that their bytes reach. A tier with ``fanout`` shards or more is merged: its scan partitions are
coalesced into as many tasks as the target goes into its bytes, and each task writes one file. That is one map stage,
without a shuffle: as the shards of a tier are of like size, a task reads and writes a few times the target at most,
whatever the table holds, and the disk holds the old and the new shards only. Each merge leaves fewer shards than it
read, in higher tiers, so the merges come to an end. Shards that reach the target, and tiers too short to merge, stay
as they are. A tier of very many shards is merged ``WAVE`` of them at a time, each wave with its
own commit, so the driver holds that many file names.

A version is a table of (path, level, n_rows, n_bytes) in a folder of its own, named by a small file ``v<number>``
with the schema of the rows. That file is created without overwriting, which only one of several writers can do
where the file system makes that atomic (HDFS; stores with conditional writes; a local disk looks first); the others
get ``Conflict`` and have changed nothing. Readers see whole versions only; old ones stay readable until ``forget``
deletes the files that no kept version names. A lost executor's unfinished files lie in folders that no manifest names.

Edge cases: an empty arrival adds no shard but its columns; a version without shards reads as no rows of its schema.
Nulls, very long texts and repeated rows are stored as they are. Extra columns of any name are too, and no name is
reserved; a column that an arrival lacks reads as null there. A column that changes its type is refused with ValueError.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalloom.session import checkpoint_dir

MOST_ROWS = 2048
TARGET = 64 << 20
FANOUT = 4
#: Shards that one merge reads, the most file names that the driver holds for it.
WAVE = 50_000
_manifest = "path string, level int, n_rows long, n_bytes long"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> bool:
    """Whether there was such a file or folder, which is gone now."""
    fs, at = _fs(spark, path)
    return fs.delete(at, True)


class Conflict(RuntimeError):
    """Another writer committed this version first."""


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, at = _fs(spark, f"{root}/manifests")
    named = (f for f in fs.listStatus(at) if f.isFile() and f.getLen() > 0) if fs.exists(at) else ()
    return sorted(int(n[1:]) for n in (f.getPath().getName() for f in named) if n[0] == "v" and n[1:].isdigit())


def _version(spark: SparkSession, root: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{root}/manifests/v{version}", wholetext=True).first()[0])


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The shards of a version, by default the newest."""
    found = versions(spark, root)
    if not found:
        return spark.createDataFrame([], _manifest)
    return spark.read.schema(_manifest).parquet(f"{root}/manifests/{_version(spark, root, version or found[-1])['shards']}")


def schema(spark: SparkSession, root: str, version: int | None = None) -> T.StructType:
    """Columns of a version's rows; none before the first."""
    found = versions(spark, root)
    return T.StructType.fromJson(_version(spark, root, version or found[-1])["schema"]) if found else T.StructType()


def commit(table: DataFrame, root: str, version: int, columns: T.StructType) -> int:
    """Writes a version's shards aside and then its name, which must not be there yet."""
    spark = table.sparkSession
    folder = f"shards-{uuid.uuid4().hex}"
    table.coalesce(1).write.parquet(f"{root}/manifests/{folder}")
    fs, at = _fs(spark, f"{root}/manifests/v{version}")
    try:
        out = fs.create(at, False)
    except Exception as e:
        fs.delete(_fs(spark, f"{root}/manifests/{folder}")[1], True)
        if "AlreadyExists" in str(e):
            raise Conflict(f"version {version} exists") from e
        raise
    out.write(bytearray(json.dumps({"shards": folder, "schema": columns.jsonValue()}).encode()))
    out.close()
    return version


def _sized(spark: SparkSession, folder: str, level: int) -> DataFrame:
    """(path, level, n_rows, n_bytes) of the shards that a write left in a folder; bytes are those of the file.

    No column of the rows is read, so one of theirs may be called ``_metadata`` too.
    """
    rows = spark.read.schema("_none int").parquet(folder).select("_metadata.file_path", "_metadata.file_size")
    return rows.groupBy(F.col("file_path").alias("path"), F.lit(level).alias("level"), F.col("file_size").alias("n_bytes")).agg(F.count("*").alias("n_rows")).select("path", "level", "n_rows", "n_bytes")


def _with(old: T.StructType, new: T.StructType) -> T.StructType:
    """The columns of both, as nullable ones."""
    kinds = {f.name: f.dataType for f in old}
    for f in new:
        if kinds.setdefault(f.name, f.dataType) != f.dataType:
            raise ValueError(f"column {f.name}: {kinds[f.name].simpleString()} here, {f.dataType.simpleString()} in the arrival")
    return T.StructType([T.StructField(n, t) for n, t in kinds.items()])


def append(arrival: DataFrame, root: str, most_rows: int = MOST_ROWS) -> int:
    """Adds an arrival as small shards; gives the new version."""
    spark = arrival.sparkSession
    now = versions(spark, root)
    columns = _with(schema(spark, root), arrival.schema)
    folder = f"{root}/shards/{uuid.uuid4().hex}"
    arrival.write.option("maxRecordsPerFile", most_rows).parquet(folder)
    live = manifest(spark, root).unionByName(_sized(spark, folder, 0))
    return commit(live, root, (now[-1] if now else 0) + 1, columns)


def tiers(shards: DataFrame, target: int = TARGET, fanout: int = FANOUT) -> DataFrame:
    """(path, level, n_bytes, tier) of the shards under the target; a tier holds sizes within a factor of ``fanout``."""
    tier = F.floor(F.log(F.greatest(F.col("n_bytes"), F.lit(1)).cast("double")) / F.log(F.lit(float(fanout))) + 1e-9)
    return shards.where(F.col("n_bytes") < target).select("path", "level", "n_bytes", tier.cast("int").alias("tier"))


def compact(spark: SparkSession, root: str, target: int = TARGET, fanout: int = FANOUT, wave: int = WAVE) -> int:
    """Merges tiers of similarly sized shards until none has ``fanout`` of them; gives the newest version.

    A merge is committed on its own; where another writer was faster, its files are left unnamed and Conflict is raised.
    """
    while now := versions(spark, root):
        shards, columns = manifest(spark, root, now[-1]), schema(spark, root, now[-1])
        sized = tiers(shards, target, fanout)
        full = sized.groupBy("tier").agg(F.count("*").alias("n")).where(F.col("n") >= fanout).orderBy("tier").first()
        if full is None:
            return now[-1]
        run = sized.where(F.col("tier") == full["tier"]).orderBy("path").limit(wave).collect()
        folder = f"{root}/shards/{uuid.uuid4().hex}"
        size = sum(r["n_bytes"] for r in run)
        spark.read.schema(columns).parquet(*(r["path"] for r in run)).coalesce(max(1, size // target)).write.parquet(folder)
        merged = _sized(spark, folder, 1 + max(r["level"] for r in run))
        gone = spark.createDataFrame([(r["path"],) for r in run], "path string")
        commit(shards.join(gone, "path", "left_anti").unionByName(merged), root, now[-1] + 1, columns)
    return 0


def read_version(spark: SparkSession, root: str, columns: list[str] | None = None, version: int | None = None) -> DataFrame:
    """Rows of a version."""
    kinds = schema(spark, root, version)
    paths = [r["path"] for r in manifest(spark, root, version).select("path").toLocalIterator()]
    rows = spark.read.schema(kinds).parquet(*paths) if paths else spark.createDataFrame([], kinds)
    return rows if columns is None else rows.select(*(f"`{c}`" for c in columns))


def forget(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Deletes files that none of the newest ``keep`` versions name, and the older versions; gives how many files went."""
    found = versions(spark, root)
    named = lambda vs: [manifest(spark, root, v).select("path") for v in vs]
    gone = 0
    for table in named(found[:-keep]):
        for live in named(found[-keep:]):
            table = table.join(live, "path", "left_anti")
        for r in table.toLocalIterator():
            fs, at = _fs(spark, r["path"])
            gone += fs.delete(at, False)
    for v in found[:-keep]:
        fs, at = _fs(spark, f"{root}/manifests/{_version(spark, root, v)['shards']}")
        fs.delete(_fs(spark, f"{root}/manifests/v{v}")[1], False)
        fs.delete(at, True)
    return gone


def new_root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"


ORACLE = """SELECT doc_id, lang, source, n_chars, octet_length(encode(text))::BIGINT AS n_bytes, md5(text) AS text_md5 FROM documents"""
