"""Pixels, nanometres and millimetres: placement, sizes and stage arithmetic as Column expressions.

Rounding is half to even throughout, which is what `rint` does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def origin(at: Column, width: Column, height: Column, overlap: float, row0: Column | int = 0, col0: Column | int = 0) -> Column:
    """struct(x, y): a tile's upper left corner in pixels; x and y in the name win over row and col."""
    x = F.coalesce(at["x"], (at["col"] - col0) * width * (1 - F.lit(overlap)))
    y = F.coalesce(at["y"], (at["row"] - row0) * height * (1 - F.lit(overlap)))
    grid = at["x"].isNotNull() & at["y"].isNotNull()
    return F.struct(F.when(grid, at["x"]).otherwise(x).alias("x"), F.when(grid, at["y"]).otherwise(y).alias("y"))


def placement(at: Column, width: Column, height: Column, overlap: float, row0: Column | int = 0, col0: Column | int = 0, fallback: bool = False) -> Column:
    """struct(y0, x0, height, width) with whole corners; null if the name gives no place, or 0, 0 as a fallback."""
    o = origin(at, width, height, overlap, row0, col0)
    whole = lambda c: F.rint(c).cast("int")
    made = F.struct(whole(o["y"]).alias("y0"), whole(o["x"]).alias("x0"), height.cast("int").alias("height"), width.cast("int").alias("width"))
    zero = F.lit(0)
    else_ = F.struct(zero.alias("y0"), zero.alias("x0"), height.cast("int").alias("height"), width.cast("int").alias("width"))
    known = o["x"].isNotNull() & o["y"].isNotNull()
    return F.when(known, made).otherwise(else_) if fallback else F.when(known, made)


def pixel(nm: float) -> float:
    """A pixel's size; 1 where it isn't positive."""
    return nm if nm > 0 else 1.0


def to_global(local: Column, corner: Column, pixel_nm: float) -> Column:
    return (corner + local) * F.lit(pixel(pixel_nm))


def size_bounds(min_nm: float, max_nm: float, pixel_nm: float) -> tuple[float, float]:
    return min_nm / pixel(pixel_nm), max_nm / pixel(pixel_nm)


def blob_sigmas(min_nm: float, max_nm: float, pixel_nm: float) -> tuple[float, float]:
    """Scales that answer to a range of diameters; at least 0.5 and in order."""
    low, high = (max(0.5, s / pixel(pixel_nm) / (2 * math.sqrt(2))) for s in (min_nm, max_nm))
    return low, max(low, high)


def marker_radius(size: Column, pixel_nm: float, scale: float = 1.0) -> Column:
    return F.greatest(F.rint(size / pixel(pixel_nm) / 2 * scale).cast("int") + 10, F.lit(14))


def downsample(height: Column, width: Column, target_mb: float = 20.0, channels: int = 3, channel_bytes: int = 1) -> Column:
    """Whole factor by which an image must shrink to fit a budget in MB."""
    size = height.cast("double") * width * channels * channel_bytes
    budget = F.lit(target_mb * 1024 * 1024)
    return F.when(size <= budget, 1).otherwise(F.ceil(F.sqrt(size / budget))).cast("int")


def feature_vector(size_px: Column, pixel_nm: float, *features: Column) -> Column:
    """Ordered doubles for a model: size in micrometres, then the others."""
    return F.array(size_px * F.lit(pixel(pixel_nm) / 1000.0), *(f.cast("double") for f in features))


def stage_step(fov_mm: Column, overlap: float = 0.10) -> Column:
    """Step between stops, rounded to 0.01 mm; null for impossible input."""
    ok = (fov_mm > 0) & F.lit(0 <= overlap < 1)
    return F.when(ok, F.rint(fov_mm * (1 - overlap) * 100) / 100)


def stop_count(span_mm: Column, fov_mm: Column, step_mm: Column) -> Column:
    more = F.ceil((span_mm - fov_mm) / step_mm - 1e-9).cast("int") + 1
    return F.when(span_mm <= fov_mm, F.lit(1)).otherwise(F.greatest(more, F.lit(1)))


def combined_uint8(value: Column, gain: Column) -> Column:
    """A combined value as a byte: broken values are 0, a broken gain is 1."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    v = F.when(bad(value), 0.0).otherwise(value)
    g = F.when(bad(gain) | (gain <= 0), 1.0).otherwise(gain)
    return F.least(F.greatest(F.rint(v * g), F.lit(0.0)), F.lit(255.0)).cast("int")
