"""Packing into optimal length buckets (operator 1).

Texts are cut into pieces of at most `max_len` words.  The histogram of piece
lengths, which has at most `max_len` entries whatever the input's size, is the
only thing that reaches the driver; dynamic programming over it places at most
`k` bucket bounds so that padding each piece to its bucket's bound wastes least.
Inside a bucket pieces are numbered in order of key and cut into batches of
`budget` tokens.  The numbering is exact and global, yet no task sees a whole
bucket: pieces are sorted into ranges of keys, whatever the keys are like, and the
driver adds up how many of each bucket every range has, a number for each range and
bucket.  Texts are read once: pieces, which are a few numbers, are kept.

Defined results: a null or empty text is one piece of no words with null bucket
and batch; ties between bounds go to the smaller one; rows that repeat a key are
numbered by their lengths; an empty table gives an empty table.  Only key and
text are read, so other columns clash with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean
from .textcols import Words, slices

MAX_LEN = 2048
BUCKETS = 16
BUDGET = 65_536
#: Pieces of one range, about.
RANGE = 1 << 18


def pieces(docs: DataFrame, max_len: int = MAX_LEN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, n_tokens): consecutive runs of at most `max_len` words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n = Words(part.column(1)).counts
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64))], [key, "n_words"])

    words = docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(lean(run), f"`{key}` {dict(docs.dtypes)[key]}, n_words long")
    last = F.greatest(F.ceil(F.col("n_words") / max_len) - 1, F.lit(0)).cast("int")
    parts = words.select(key, "n_words", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * max_len
    return parts.select(key, "piece", start.alias("start"), F.least(F.col("n_words") - start, F.lit(max_len)).cast("int").alias("n_tokens"))


def histogram(found: DataFrame, max_len: int = MAX_LEN) -> np.ndarray:
    """Pieces of each length from 0 to `max_len`."""
    counts = np.zeros(max_len + 1, np.int64)
    for n, c in found.groupBy("n_tokens").count().collect():
        counts[n] = c
    return counts


def bounds(counts: np.ndarray, k: int = BUCKETS) -> list[int]:
    """At most k bounds of least total padding; pieces of no words need none."""
    lengths = np.flatnonzero(counts[1:]) + 1
    if not len(lengths):
        return []
    n = np.concatenate([[0], np.cumsum(counts[lengths])])
    total = np.concatenate([[0], np.cumsum(counts[lengths] * lengths)])
    top = np.concatenate([[0], lengths])
    # waste[i, j]: padding of the lengths after the i-th up to the j-th
    waste = (top[None, :] * (n[None, :] - n[:, None]) - (total[None, :] - total[:, None])).astype(np.float64)
    waste[np.tril_indices(len(top))] = np.inf
    cost, back = waste[0], []
    for _ in range(min(k, len(lengths)) - 1):
        trial = cost[:, None] + waste
        back.append(np.argmin(trial, axis=0))
        cost = trial[back[-1], np.arange(len(top))]
    at, chosen = len(top) - 1, [int(top[-1])]
    for previous in reversed(back):
        at = int(previous[at])
        chosen.append(int(top[at]))
    return chosen[::-1]


def batches(found: DataFrame, bound: list[int], budget: int = BUDGET, key: str = "doc_id") -> DataFrame:
    """`found` with bucket (its bound), batch and slot inside the bucket, and padding."""
    if bound:
        bucket = F.element_at(F.filter(F.array(*map(F.lit, bound)), lambda b: b >= F.col("n_tokens")), 1)
        bucket = F.when(F.col("n_tokens") > 0, bucket)
    else:
        bucket = F.lit(None).cast("int")
    spark = found.sparkSession
    ranges = max(spark.sparkContext.defaultParallelism, -(-found.count() // RANGE))
    # pieces alike in all else, as of a key that many rows share, are told apart by chance
    order = [key, "piece", "n_tokens", "_chance"]
    rows = found.withColumn("bucket", bucket).withColumn("_chance", F.rand(17))
    rows = cut(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted(rows.groupBy("_part", "bucket").agg(F.count("*").alias("n")).collect(), key=lambda r: r["_part"])
    start: dict[int | None, int] = {}
    starts = []
    for r in sizes:  # at most one row for each range and bucket
        starts.append((r["_part"], r["bucket"], start.get(r["bucket"], 0)))
        start[r["bucket"]] = start.get(r["bucket"], 0) + r["n"]
    table = F.broadcast(spark.createDataFrame(starts, "_p int, _b int, _start long"))
    inside = Window.partitionBy("_part", "bucket").orderBy(*order)
    numbered = rows.withColumn("_row", F.row_number().over(inside) - 1).join(table, (F.col("_part") == F.col("_p")) & F.col("bucket").eqNullSafe(F.col("_b")))
    number = F.col("_start") + F.col("_row")
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket")))
    return numbered.select(
        key,
        "piece",
        "start",
        "n_tokens",
        "bucket",
        F.when(F.col("bucket").isNotNull(), F.floor(number / size)).cast("long").alias("batch"),
        F.when(F.col("bucket").isNotNull(), number % size).cast("int").alias("slot"),
        (F.col("bucket") - F.col("n_tokens")).cast("int").alias("padding"),
    )


def pack(docs: DataFrame, max_len: int = MAX_LEN, k: int = BUCKETS, budget: int = BUDGET, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All of it: pieces, optimal bounds, batches."""
    found = cut(pieces(docs, max_len, key, text))
    return batches(found, bounds(histogram(found, max_len), k), budget, key)


def sql(max_len: int = MAX_LEN, k: int = BUCKETS, budget: int = BUDGET) -> str:
    """The same in DuckDB's SQL, dynamic programme included."""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n FROM documents
), p AS (
  SELECT doc_id, i::INTEGER AS piece, (i * {max_len})::BIGINT AS start, least(n - i * {max_len}, {max_len})::INTEGER AS n_tokens
  FROM (SELECT doc_id, n, unnest(range(greatest((n + {max_len} - 1) // {max_len}, 1))) AS i FROM w)
), h AS (
  SELECT n_tokens AS l, count(*)::BIGINT AS c FROM p WHERE n_tokens > 0 GROUP BY n_tokens
), t AS (
  SELECT l, (sum(c) OVER (ORDER BY l))::BIGINT AS n, (sum(c * l) OVER (ORDER BY l))::BIGINT AS s FROM h
  UNION ALL SELECT 0, 0, 0
), f AS (
  SELECT 1 AS k, l, l * n - s AS cost, 0 AS prev FROM t WHERE l > 0
  UNION ALL
  SELECT k, l, b.c AS cost, b.p AS prev FROM (
    SELECT f.k + 1 AS k, t.l AS l, min({{'c': f.cost + t.l * (t.n - q.n) - (t.s - q.s), 'p': f.l}}) AS b
    FROM f JOIN t q ON q.l = f.l JOIN t ON t.l > f.l WHERE f.k < {k} GROUP BY f.k, t.l)
), e AS (
  SELECT k, l, prev FROM f WHERE l = (SELECT max(l) FROM h) AND k = (SELECT least({k}, count(*)) FROM h)
  UNION ALL
  SELECT f.k, f.l, f.prev FROM e JOIN f ON f.k = e.k - 1 AND f.l = e.prev
), g AS (
  SELECT p.*, (SELECT min(e.l) FROM e WHERE e.l >= p.n_tokens AND p.n_tokens > 0)::INTEGER AS bucket FROM p
), r AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id, piece, n_tokens) - 1 AS number, greatest(1, {budget} // bucket) AS size FROM g
)
SELECT doc_id, piece, start, n_tokens, bucket,
  CASE WHEN bucket IS NOT NULL THEN (number // size)::BIGINT END AS batch,
  CASE WHEN bucket IS NOT NULL THEN (number % size)::INTEGER END AS slot,
  (bucket - n_tokens)::INTEGER AS padding
FROM r
"""
