"""Acceptance gates: the first gate that a blob fails is its reason."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gates:
    min_prominence: float = 0.30
    min_confidence: float = 0.50
    edge_exclude_px: float = 8.0
    min_circularity: float = 0.0
    min_peak_snr: float = 2.5
    support_factor: float = 6.0
    max_support_px: float = 0.0
    min_size_px: float = 5.54
    max_size_px: float = 27.7
    min_area_px: float = 4.0


def reason(g: Gates = Gates()) -> Column:
    """Over prominence, edge_distance, on_island, circularity, peak_snr, support, sigma and size; `kept` if no gate rejects."""
    c = F.col
    area = F.lit(2 * math.pi) * c("sigma") * c("sigma")
    cap = F.lit(g.max_support_px) if g.max_support_px > 0 else g.support_factor * area
    own = F.lit(math.pi / 4) * c("size") * c("size")
    return (
        F.when(F.lit(g.min_prominence > 0) & (c("prominence") < g.min_prominence), "prominence")
        .when(F.lit(g.min_confidence > 0) & (c("prominence") < g.min_confidence), "confidence")
        .when(F.lit(g.edge_exclude_px > 0) & (c("edge_distance") <= g.edge_exclude_px) & ~c("on_island"), "edge_exclude")
        .when(F.lit(g.min_circularity > 0) & (c("circularity") < g.min_circularity), "circularity")
        .when((c("peak_snr") < g.min_peak_snr) & ~c("on_island"), "local_peak_snr")
        .when(c("support") > cap, "support")
        .when((c("size") <= 0) | (c("size") < g.min_size_px) | (c("size") > g.max_size_px) | (own < g.min_area_px), "measured_size")
        .otherwise("kept")
    )


def gated(blobs: DataFrame, gates: Gates = Gates()) -> DataFrame:
    return blobs.withColumn("reason", reason(gates))


def accepted(blobs: DataFrame, gates: Gates = Gates()) -> DataFrame:
    return gated(blobs, gates).where("reason = 'kept'")
