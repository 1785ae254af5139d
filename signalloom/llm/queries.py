"""The numbered queries: each applies its operator to the whole of its table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import bpe, context_tree, fingerprints, long_matches, media, mixing, near_dedup, pii, quality, secret_scan, sharding, word_runs, yinyang
from signalloom.session import read, ship

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(ship(spark), sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % quality.HELD_OUT_MOD == quality.HELD_OUT, F.lit(False))
    return quality.classify(docs, labels).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(ship(spark), sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(ship(spark), sf_dir, "documents"))


def op4_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(read(ship(spark), sf_dir, "documents"))


def op5_long_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_matches.remove_repeats(read(ship(spark), sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(read(ship(spark), sf_dir, "documents")).withColumn("feature", media.as_text()).drop("pairs")


def op7_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended as small shards, compacted, and read back from the committed version."""
    docs = read(ship(spark), sf_dir, "documents")
    root = sharding.new_root(spark)
    sharding.append(docs, root)
    sharding.compact(spark, root)
    sharding.forget(spark, root)
    back = sharding.read_version(spark, root, docs.columns)
    return back.select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(ship(spark), sf_dir, "documents"), pii.train(pii.labelled_table(spark)))


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(read(ship(spark), sf_dir, "documents"), repeats=True)


def tokenizer_spec(path: str | None = None) -> str:
    """Text of a tokenizer file; the driver reads it, tasks get it broadcast (about 3 MB)."""
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(ship(spark), sf_dir, "documents"), tokenizer_spec())


def op11_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.summary(read(ship(spark), sf_dir, "embeddings"))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.summary(read(ship(spark), sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.summary(read(ship(spark), sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_near_dedup": op2_near_dedup,
    "op3_mixing": op3_mixing,
    "op4_syncmer_fingerprints": op4_syncmer_fingerprints,
    "op5_long_matches": op5_long_matches,
    "op6_media_columns": op6_media_columns,
    "op7_compaction": op7_compaction,
    "op8_personal_data": op8_personal_data,
    "op9_context_tree": op9_context_tree,
    "op10_bpe_round_trip": op10_bpe_round_trip,
    "op11_yinyang_clusters": op11_yinyang_clusters,
    "op12_word_runs": op12_word_runs,
    "op13_secret_scan": op13_secret_scan,
}
ORACLES: dict[str, str] = {"op2_near_dedup": near_dedup.ORACLE, "op3_mixing": mixing.oracle(), "op7_compaction": sharding.ORACLE, "op11_yinyang_clusters": yinyang.oracle()}
