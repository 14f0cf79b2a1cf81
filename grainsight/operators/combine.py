"""Four photos of one place, lit from N, S, E and W, combined pixel by pixel.

Small tiles are arrays and stay in the JVM; whole photos go through numpy kernels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names

EPS = 1e-3


def ranked(values: Column, rank: int) -> Column:
    """The rank-th largest of an array of numbers."""
    return F.element_at(F.sort_array(values, asc=False), rank)


def symmetry(values: Column, rank: int, eps: float = EPS) -> Column:
    """struct(symmetry, signal): how much of a pixel's light at least `rank` sides agree on."""
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    share = F.lit(4.0) * ranked(values, rank) / (total + eps)
    return F.struct(share.alias("symmetry"), (share * total / 4.0).alias("signal"))


def orthogonal(n: Column, s: Column, e: Column, w: Column) -> Column:
    """The best agreement of two neighbouring sides."""
    return F.greatest(F.least(n, e), F.least(n, w), F.least(s, e), F.least(s, w))


def cells(photos: DataFrame, cell: str = "cell", side: str = "side", pixels: str = "pixels", complete: bool = True) -> DataFrame:
    """(cell, N, S, E, W): complete cells, or all with null for missing sides; a side that comes twice is an error."""
    sides = [F.collect_list(F.when(F.col(side) == d, F.col(pixels))).alias(d) for d in names.DIRECTIONS]
    found = photos.groupBy(cell).agg(*sides)
    once = [F.when(F.size(d) > 1, F.raise_error(F.lit("a side comes twice"))).when(F.size(d) == 1, F.element_at(d, 1)).alias(d) for d in names.DIRECTIONS]
    found = found.select(cell, *once)
    return found.where(" AND ".join(f"{d} IS NOT NULL" for d in names.DIRECTIONS)) if complete else found


def combine(photos: DataFrame, rank: int = 3, cell: str = "cell", side: str = "side", pixels: str = "pixels", complete: bool = True) -> DataFrame:
    """(cell, signal, orthogonal): arrays over the pixels of each complete cell, or of all from the sides that they have."""
    found = cells(photos, cell, side, pixels, complete)
    sides = [F.col(d) for d in names.DIRECTIONS]
    if not complete:
        missing = F.transform(F.coalesce(*sides), lambda p: F.nullif(p, p))
        sides = [F.coalesce(d, missing).alias(n) for d, n in zip(sides, names.DIRECTIONS, strict=True)]
    stacked = found.select(cell, F.arrays_zip(*sides).alias("_z"))
    four = lambda p: F.array(*(p[d].cast("double") for d in names.DIRECTIONS))
    there = lambda p: F.filter(four(p), lambda v: v.isNotNull())
    seen = lambda p: symmetry(four(p), rank) if complete else F.when(F.size(there(p)) >= rank, symmetry(there(p), rank))
    signal = F.transform("_z", lambda p: seen(p)["signal"])
    ortho = F.transform("_z", lambda p: orthogonal(*(p[d].cast("double") for d in names.DIRECTIONS)))
    return stacked.select(cell, signal.alias("signal"), ortho.alias("orthogonal"))


def symmetry_maps(stack: np.ndarray, rank: int, eps: float = EPS) -> tuple[np.ndarray, np.ndarray]:
    """(symmetry, signal) of a 4 x height x width stack, for photos of any size."""
    stack = np.asarray(stack, np.float32)
    total = stack.sum(0)
    kth = np.partition(stack, 4 - rank, axis=0)[4 - rank]
    share = 4.0 * kth / (total + np.float32(eps))
    return share, share * total / 4.0


def orthogonal_map(stack: np.ndarray) -> np.ndarray:
    n, s, e, w = (np.asarray(x, np.float32) for x in stack)
    return np.maximum.reduce([np.minimum(n, e), np.minimum(n, w), np.minimum(s, e), np.minimum(s, w)])


def to_bytes(values: np.ndarray, gain: float = 1.0) -> np.ndarray:
    """Bytes of a combined map; broken values are 0, a broken gain is 1."""
    gain = gain if np.isfinite(gain) and gain > 0 else 1.0
    return np.clip(np.rint(np.nan_to_num(np.asarray(values, np.float64), nan=0.0, posinf=0.0, neginf=0.0) * gain), 0, 255).astype(np.uint8)


def consumed(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path): photos that a combined one replaces: all four sides of a complete cell or letter folder, and uniform shots beside complete letters."""
    at = names.positional(F.col(path))
    folder = F.regexp_extract(names.path(path), r"^(.*?)/?[^/]*$", 1)
    tagged = paths.select(path, folder.alias("_folder"), at.alias("_at"), names.direction(path).alias("_letter"), names.is_uniform(path).alias("_uniform"))
    cell = F.concat_ws("/", "_folder", F.when(F.col("_at").isNotNull(), F.format_string("(%d,%d)", F.col("_at.row"), F.col("_at.col"))).otherwise("letters"))
    side = F.coalesce("_at.direction", "_letter")
    sided = tagged.where(side.isNotNull()).select(path, "_folder", cell.alias("_cell"), side.alias("_side"), F.col("_letter").isNotNull().alias("_letters"))
    full = sided.groupBy("_cell").agg(F.countDistinct("_side").alias("_n"), F.max("_letters").alias("_letters"), F.max("_folder").alias("_f")).where("_n = 4")
    four = sided.join(full.select("_cell"), "_cell", "left_semi").select(path)
    beside = tagged.where("_uniform").join(full.where("_letters").select(F.col("_f").alias("_folder")), "_folder", "left_semi").select(path)
    return four.unionByName(beside).distinct()


def prepared(paths: DataFrame, combined: DataFrame, path: str = "path") -> DataFrame:
    """All paths and the combined ones, without what was consumed, each once."""
    return paths.select(path).unionByName(combined.select(path)).join(consumed(paths, path), path, "left_anti").distinct()
