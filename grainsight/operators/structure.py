"""Structure filters: detections that repeat what the wafer's pattern does."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spatial import both_ways, neighbour_counts, self_pairs

SIZE_RATIO = 1.30
SNR_RATIO = 2.5


def reject_clustered(rows: DataFrame, radius: float, least: int = 2, size_ratio: float = SIZE_RATIO, snr_ratio: float = SNR_RATIO, on: Sequence[str] = (), key: str = "id", x: str = "x", y: str = "y", size: str = "size", snr: str | None = "snr") -> DataFrame:
    """Rows with fewer than `least` neighbours, or clearly larger or clearer than the median of them; a radius or number of 0 or less keeps all."""
    if radius <= 0 or least <= 0:
        return rows
    slim = rows.select(key, *on, x, y, size, *([snr] if snr else []))
    pairs = both_ways(self_pairs(slim, radius, on, key, x, y))
    of = [F.count("*").alias("_n"), F.median(f"r.{size}").alias("_size")]
    if snr:
        of.append(F.median(f"r.{snr}").alias("_snr"))
    around = pairs.groupBy(F.col(f"l.{key}").alias(key)).agg(*of)
    larger = (F.col("_size") > 0) & (F.col(size) >= size_ratio * F.col("_size"))
    outlier = larger | ((F.col("_snr") > 0) & (F.col(snr) >= snr_ratio * F.col("_snr"))) if snr else larger
    kept = rows.join(around, key, "left").where((F.coalesce("_n", F.lit(0)) < least) | F.coalesce(outlier, F.lit(False)))
    return kept.select(*rows.columns)


def reject_aligned(rows: DataFrame, bin_px: float = 10.0, least: int = 3, span: float = 48.0, gap: float = 48.0, size_ratio: float = SIZE_RATIO, on: Sequence[str] = (), key: str = "id", x: str = "x", y: str = "y", size: str = "size") -> DataFrame:
    """Rows that no dense run along x or y takes up; both axes are judged on the input.  A gap of 0 sets no limit; a bin or run length of 0 or less keeps all."""
    if bin_px <= 0 or least <= 0:
        return rows
    flagged = rows
    for i, (along, across) in enumerate(((x, y), (y, x))):
        run = f"_run{i}"
        group = [*on, run]
        binned = flagged.withColumn(run, F.rint(F.col(across) / F.lit(bin_px)).cast("long"))
        step = F.col(along) - F.lag(along).over(Window.partitionBy(*group).orderBy(along, key))
        runs = binned.withColumn("_step", step).groupBy(*group).agg(F.count("*").alias("_n"), (F.max(along) - F.min(along)).alias("_span"), F.max("_step").alias("_gap"), F.median(size).alias("_size"))
        runs = runs.where((F.col("_n") >= least) & (F.col("_span") >= span) & (F.lit(gap <= 0) | (F.coalesce("_gap", F.lit(0.0)) <= gap))).select(*group, F.col("_size").alias(f"_size{i}"))
        flagged = binned.join(runs, group, "left")
    outlier = lambda i: (F.col(f"_size{i}") > 0) & (F.col(size) >= size_ratio * F.col(f"_size{i}"))
    drop = lambda i: F.col(f"_size{i}").isNotNull() & ~outlier(i)
    return flagged.where(~(drop(0) | drop(1))).select(*rows.columns)


def structure_filters(rows: DataFrame, radius: float = 48.0, least: int = 3, on: Sequence[str] = (), key: str = "id", x: str = "x", y: str = "y", size: str = "size", snr: str | None = "snr") -> DataFrame:
    """Neighbour counts of all rows, then the cluster filter, then the run filter."""
    counted = neighbour_counts(rows, radius, on, key, x, y, "n_neighbors_48")
    return reject_aligned(reject_clustered(counted, radius, least, on=on, key=key, x=x, y=y, size=size, snr=snr), on=on, key=key, x=x, y=y, size=size)
