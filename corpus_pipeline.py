"""The corpus pipeline: stages over `documents`, each on what the one before it kept.

language ID, line dedup, MinHash near-dedup, substring dedup, packing.  Each stage
is a function of (spark, docs, sf_dir); all but the last return the columns of
`documents`, with `n_chars` brought up to date where the text changed.  Stages
that rewrite texts keep `doc_id`; `source` and `lang` stay as they came.
"""

from __future__ import annotations

import posixpath
import uuid

from grainsight.llm import forest, langid, lines, packing, repeats
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of a text's words that its main language must reach.
LEAST_SHARE = 0.3
#: Similarity of five-word shingle sets from which documents are near-duplicates, in percent.
NEAR_PERCENT = 80


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Texts may have changed: `n_chars` follows."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language: null, without a letter, or no language has a fair share of the words.

    Learns from all labelled rows; ties and repeated rows get equal decisions, and
    columns of any names pass through.
    """
    model = langid.train(docs, F.lit(True))
    columns = docs.columns
    keys = docs.select(F.struct(*columns).alias("row"), F.col("text"))
    found = langid.identify(keys, model, key="row")
    return found.where(F.col("lang_pred") != langid.UNDETERMINED).where(F.col("score") >= LEAST_SHARE).select("row.*").select(*columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that have an earlier match, and texts that had words and keep none.

    Null and wordless texts stay; rows with a null key come after all others, and rows
    that share a key are told apart by their texts.
    """
    return _counted(lines.dedup(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one of smallest `doc_id`.

    Of equal keys the text of smaller digest stays; rows equal in key and text stay
    together; null keys come last; wordless texts are like nothing and stay.
    """
    return forest.dedup(docs, percent=NEAR_PERCENT)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 13 words or more that start in a document of smaller `doc_id`, and texts that lose all their words.

    Rows that share a key never remove each other's words; null keys come last.
    """
    return _counted(repeats.dedup(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept texts in length buckets and token-budget batches; null and wordless texts are one piece in no bucket."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: SQL can't express the mixture model of the first stage; `tests/llm/test_pipeline.py` holds each stage against a plain version of it.
ORACLE_SQL = None


def _shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return posixpath.join(base, f"corpus-{uuid.uuid4().hex}")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = _shared_folder(spark), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # what the next stage has read whole isn't needed any more
            _remove(spark, before)
        before = f"{folder}/{name}"
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
