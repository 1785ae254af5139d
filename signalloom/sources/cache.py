"""Epochs kept as Parquet by split and status, with a manifest of what became of every record; small tables as JSON and CSV."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a scan of the cache takes.
USABLE = ("ok", "skipped_exists")


def write_epochs(epochs: DataFrame, manifest: DataFrame, folder: str) -> None:
    """epochs (rec, ep, ch, t, v, split) and manifest (rec, status, n_epochs, split) under one folder."""
    epochs.write.partitionBy("split").parquet(f"{folder}/epochs")
    manifest.write.parquet(f"{folder}/manifest")


def missing_records(records: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """The records (rec) that a cache does not hold yet, so that a stopped job goes on where it ended."""
    return records.join(spark.read.parquet(f"{folder}/manifest").select("rec"), "rec", "left_anti")


def read_epochs(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Epochs of a split, of records that are usable and have any; split and status are pruned and pushed to the scans."""
    usable = spark.read.parquet(f"{folder}/manifest").where(F.col("status").isin(*USABLE) & (F.col("n_epochs") > 0) & (F.col("split") == split))
    return spark.read.parquet(f"{folder}/epochs").where(F.col("split") == split).join(usable.select("rec"), "rec", "left_semi")


def cache_summary(spark: SparkSession, folder: str) -> DataFrame:
    """(split, status, n_records, n_epochs)."""
    m = spark.read.parquet(f"{folder}/manifest")
    return m.groupBy("split", "status").agg(F.count("*").alias("n_records"), F.sum("n_epochs").cast("long").alias("n_epochs"))


def same_count(left: DataFrame, right: DataFrame, what: str) -> None:
    """Refuses tables of unequal length, such as probabilities beside other epochs than their own."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{what}: {a} rows beside {b}")


def write_csv(df: DataFrame, folder: str, fields: list[str]) -> None:
    """Fields in order as CSV with a header; a field that is missing is empty."""
    df.select(*(F.col(f"`{f}`") if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields)).write.option("header", True).csv(folder)


def write_json(df: DataFrame, folder: str) -> None:
    df.write.json(folder)


class Taken(RuntimeError):
    """Another job committed this version of a cache first."""


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def parts(spark: SparkSession, folder: str) -> list[str]:
    """The parts of a cache's newest version, in the order in which they came; none before the first."""
    fs, at = _at(spark, f"{folder}/versions")
    found = sorted(int(f.getPath().getName()[1:]) for f in fs.listStatus(at) if f.getLen() > 0) if fs.exists(at) else []
    return json.loads(spark.read.text(f"{folder}/versions/v{found[-1]}", wholetext=True).first()[0]) if found else []


def commit_part(spark: SparkSession, folder: str, part: str) -> int:
    """Adds a part in a new version, whose small file is created once or not at all; gives the version's number."""
    now = parts(spark, folder)
    fs, at = _at(spark, f"{folder}/versions/v{len(now) + 1}")
    try:
        out = fs.create(at, False)
    except Exception as e:
        if "AlreadyExists" in str(e):
            raise Taken(at.toString()) from e
        raise
    out.write(bytearray(json.dumps([*now, part]).encode()))
    out.close()
    return len(now) + 1


def read_manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest row of every record of a cache; None where there is no version yet."""
    rows = None
    for k, part in enumerate(parts(spark, folder)):
        own = spark.read.parquet(f"{folder}/parts/{part}/manifest").withColumn("_part", F.lit(k))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    if rows is None:
        return None
    newest = rows.groupBy("record_id").agg(F.max_by(F.struct(*rows.columns), "_part").alias("r"))
    return newest.select("r.*").drop("_part")


def read_cached(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, ep, x) of all parts of the newest version; a record's epochs lie in the one part in which it succeeded."""
    return spark.read.parquet(*(f"{folder}/parts/{p}/epochs" for p in parts(spark, folder)))


def add_missing(records: DataFrame, folder: str, process: Callable[[DataFrame, str], None]) -> int:
    """Runs ``process(records, part folder)`` for the records without a usable row yet and commits the part; gives how many these were.

    A job that dies leaves a part that no version names; the next run begins that part anew.
    """
    spark = records.sparkSession
    done = read_manifest(spark, folder)
    todo = records if done is None else records.join(done.where(F.col("status").isin(*USABLE)).select("record_id"), "record_id", "left_anti")
    n = todo.count()
    if n:
        part = uuid.uuid4().hex
        process(todo, f"{folder}/parts/{part}")
        commit_part(spark, folder, part)
    return n
