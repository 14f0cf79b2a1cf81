"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, forest, hmm, jpeg, langid, lines, mtree, packing, repeats, toxicity
from .common import fold

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = hmm.model_and_score(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    return scored.select(F.col("id").cast("long").alias("doc_id"), (fold("id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.removals(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")
    return found.withColumn("removed", F.array_join("removed", ","))


def op6_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0).select("doc_id", "toxic")
    model = toxicity.fit(docs, learn, fold("doc_id", 5) == 4)
    scored = toxicity.score(docs, model)
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "windows", "marked")


def op9_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = jpeg.decode(jpeg.encode(table(spark, sf_dir, "documents")))
    tail = F.substring("thumbnail", -32, 32)
    return seen.select("doc_id", "n_bytes", F.length("thumbnail").cast("long").alias("payload_bytes"), F.sha2("thumbnail", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, fold("doc_id", 4) != 2)
    return langid.identify(docs, model).select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "langs", "shares")


def op10_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "documents")).withColumnsRenamed({"key": "doc_id", "component": "component_id"})


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_repeats": op2_repeats,
    "op3_langid": op3_langid,
    "op4_hmm": op4_hmm,
    "op5_lines": op5_lines,
    "op6_mtree": op6_mtree,
    "op7_bpe": op7_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_jpeg": op9_jpeg,
    "op10_forest": op10_forest,
}

ORACLES: dict[str, str] = {
    "op1_packing": packing.sql(),
    "op2_repeats": repeats.sql(),
    "op5_lines": lines.SQL,
    "op6_mtree": mtree.SQL,
}
