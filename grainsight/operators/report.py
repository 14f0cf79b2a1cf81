"""Report aggregates over particle sizes in nanometres."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLDS_UM = (10.0, 20.0, 25.0, 50.0, 75.0)
BIN_UM = 5.0


def summary(rows: DataFrame, size: str = "size") -> DataFrame:
    """One row: count, mean, population deviation, least and largest size; zeros without rows."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.agg(F.count("*").alias("n"), zero(F.avg(size)).alias("mean"), zero(F.stddev_pop(size)).alias("std"), zero(F.min(size)).alias("min"), zero(F.max(size)).alias("max"))


def at_least(rows: DataFrame, thresholds_um: tuple[float, ...] = THRESHOLDS_UM, size: str = "size") -> DataFrame:
    """(threshold_um, n): rows of at least each size, a row for every threshold.  One pass, no join."""
    sums = [F.coalesce(F.sum(F.when(F.col(size) >= t * 1000.0, 1)), F.lit(0)).cast("long") for t in thresholds_um]
    pairs = F.array(*(F.struct(F.lit(float(t)).alias("threshold_um"), F.col(f"_{i}").alias("n")) for i, t in enumerate(thresholds_um)))
    return rows.agg(*(s.alias(f"_{i}") for i, s in enumerate(sums))).select(F.explode(pairs).alias("p")).select("p.*")


def bin_label(left: float, right: float) -> str:
    text = lambda v: f"{round(v)}" if abs(v - round(v)) < 1e-6 else f"{v:.2f}"
    return f"{text(left)}–{text(right)}"


def histogram(rows: DataFrame, min_um: float, step_um: float = BIN_UM, size: str = "size") -> DataFrame:
    """(bin, left_um, right_um, n): half-open bins from the smallest size on, the last one closed; empty bins included.

    The driver sees one scalar, the largest size, which fixes the number of bins.
    """
    um = F.col(size) / 1000.0
    largest = rows.agg(F.max(um)).head()[0]
    bins = max(1, math.ceil(((largest if largest is not None else min_um) - min_um) / step_um - 1e-9))
    top = min_um + bins * step_um
    inside = rows.where((um >= min_um) & (um <= top))
    counts = inside.groupBy(F.least(F.floor((um - min_um) / step_um).cast("int"), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    all_ = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    left = F.lit(min_um) + F.col("bin") * step_um
    return all_.join(F.broadcast(counts), "bin", "left").select("bin", left.alias("left_um"), (left + step_um).alias("right_um"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def export_table(rows: DataFrame) -> DataFrame:
    """The six exported columns, micrometres to one decimal, half to even."""
    need = ["id", "x_global", "y_global", "size", "source_tile", "confidence"]
    if "id" not in rows.columns and rows.isEmpty():
        return rows.sparkSession.createDataFrame([], "id long, x_global_um double, y_global_um double, size_um double, source_tile string, confidence double")
    if missing := [c for c in need if c not in rows.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    um = lambda c: (F.rint(F.col(c) / 1000.0 * 10) / 10).alias(f"{c}_um")
    return rows.select("id", um("x_global"), um("y_global"), um("size"), "source_tile", "confidence")


def preview(rows: DataFrame, n: int = 100) -> DataFrame:
    """The first rows of a table by their ids, as a page shows them."""
    return rows.orderBy("id").limit(n)
