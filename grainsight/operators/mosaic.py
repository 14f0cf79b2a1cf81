"""Mosaics: where photos lie, thumbnails made in tasks, one small canvas on the driver, circles around particles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, names
from ..kernels import filters
from ..sources.tiles import PHOTO_SCHEMA, photo_batch, photo_row, pixels
from .detect import each_photo

# Colour and line width of the circles around particles.
CIRCLE, LINE = (255, 140, 40), 3


def extent(placements: DataFrame) -> DataFrame:
    """One row (height, width) that holds all placements; 0, 0 without any."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    return placements.agg(zero(F.max(F.col("y0") + F.col("height"))).alias("height"), zero(F.max(F.col("x0") + F.col("width"))).alias("width"))


def factor_of(height: int, width: int, target_mb: float = 20.0, channels: int = 3) -> int:
    """Whole factor by which a canvas shrinks to fit a budget."""
    size, budget = max(height, 1) * max(width, 1) * channels, max(target_mb, 1e-6) * 1024 * 1024
    return 1 if size <= budget else int(np.ceil(np.sqrt(size / budget)))


def crops(placements: DataFrame, crop: tuple[int, int, int, int]) -> DataFrame:
    """Placements that a crop (y, x, height, width) meets, with the common part in the photo (cy, cx, ch, cw) and in the crop (ty, tx)."""
    y, x, h, w = crop
    top, left = F.greatest(F.col("y0"), F.lit(y)), F.greatest(F.col("x0"), F.lit(x))
    bottom, right = F.least(F.col("y0") + F.col("height"), F.lit(y + h)), F.least(F.col("x0") + F.col("width"), F.lit(x + w))
    inside = placements.withColumns({"cy": top - F.col("y0"), "cx": left - F.col("x0"), "ch": bottom - top, "cw": right - left, "ty": top - F.lit(y), "tx": left - F.lit(x)})
    return inside.where((F.col("ch") > 0) & (F.col("cw") > 0))


def thumbnails(photos: DataFrame, factor: int) -> DataFrame:
    """Photos `factor` times smaller, as float32."""

    def run(path: str, image: np.ndarray) -> list[tuple]:
        small = np.asarray(filters.shrunk(np.asarray(image, np.float32), factor), np.float32)
        return [(path, *small.shape, small.tobytes())]

    return each_photo(photos, run, "path string, h int, w int, small binary")


def paste(canvas: np.ndarray, small: np.ndarray, y: int, x: int) -> None:
    """Puts a picture on the canvas; what lies outside is cut off."""
    height, width = canvas.shape[:2]
    top, left = max(y, 0), max(x, 0)
    part = small[top - y : max(height - y, 0), left - x : max(width - x, 0)]
    canvas[top : top + part.shape[0], left : left + part.shape[1]] = part


def preview(photos: DataFrame, placements: DataFrame, factor: int, crop: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """The canvas: photos shrunk in tasks and pasted in order of their paths, later ones on top.

    The driver holds the canvas and one thumbnail at a time; `factor` bounds both.
    """
    size = extent(placements).head()
    if crop is not None:
        y, x = max(crop[0], 0), max(crop[1], 0)
        crop = (y, x, min(crop[2], max(size["height"] - y, 0)), min(crop[3], max(size["width"] - x, 0)))
    height, width = (size["height"], size["width"]) if crop is None else crop[2:]
    factor = max(int(factor), 1)
    canvas = np.zeros((-(-height // factor), -(-width // factor)), np.float32)
    if crop is None:
        placed = placements.select("path", F.floor(F.col("y0") / factor).alias("ty"), F.floor(F.col("x0") / factor).alias("tx"))
        parts = photos
    else:
        cut = crops(placements, crop)
        placed = cut.select("path", F.floor(F.col("ty") / factor).alias("ty"), F.floor(F.col("tx") / factor).alias("tx"))
        parts = cropped(photos, cut)
    for row in thumbnails(parts, factor).join(placed, "path").orderBy("path").toLocalIterator():
        paste(canvas, np.frombuffer(row["small"], np.float32).reshape(row["h"], row["w"]), int(row["ty"]), int(row["tx"]))
    return canvas


def cropped(photos: DataFrame, cut: DataFrame) -> DataFrame:
    """The parts of photos that a crop meets."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, h, w, dtype, raw, y, x, ch, cw in zip(*(c.to_pylist() for c in part.columns), strict=True):
                yield photo_batch([photo_row(path, pixels(h, w, dtype, raw)[y : y + ch, x : x + cw])])

    both = photos.where("pixels IS NOT NULL").join(cut.select("path", "cy", "cx", "ch", "cw"), "path")
    return both.select("path", "height", "width", "dtype", "pixels", "cy", "cx", "ch", "cw").mapInArrow(run, PHOTO_SCHEMA)


def display(image: np.ndarray) -> np.ndarray:
    """RGB bytes of a gray picture: shares up to 1, bytes up to 255, anything else by its peak."""
    image = np.asarray(image, np.float64)
    finite = image[np.isfinite(image)]
    peak = float(finite.max()) if finite.size else 0.0
    scale = 255.0 if peak <= 1 else 1.0 if peak <= 255 else 255.0 / peak
    gray = np.nan_to_num(np.clip(image * scale, 0, 255), nan=0.0).astype(np.uint8)
    return np.repeat(gray[..., None], 3, -1) if image.size else np.zeros((0, 0, 3), np.uint8)


def circle(rgb: np.ndarray, x: int, y: int, radius: int, colour: tuple[int, int, int] = CIRCLE, line: int = LINE) -> None:
    """A smooth circle, if its middle lies inside the picture."""
    height, width = rgb.shape[:2]
    if not (0 <= x < width and 0 <= y < height):
        return
    reach = radius + line
    top, left = max(y - reach, 0), max(x - reach, 0)
    part = rgb[top : y + reach + 1, left : x + reach + 1]
    rows, cols = np.arange(part.shape[0]) + top - y, np.arange(part.shape[1]) + left - x
    cover = np.clip(line / 2 + 0.5 - np.abs(np.hypot(rows[:, None], cols) - radius), 0, 1)[..., None]
    part[...] = np.rint(part * (1 - cover) + np.array(colour) * cover).astype(np.uint8)


def markers(particles: DataFrame, pixel_nm: float, scale: float, offset: tuple[int, int] = (0, 0), placements: DataFrame | None = None) -> DataFrame:
    """(x, y, radius, key) in the picture's pixels; only of placed photos, if placements are given."""
    rows = particles if placements is None else particles.withColumn("_name", names.base("source_tile")).join(placements.select(names.base("path").alias("_name")).distinct(), "_name", "left_semi")
    pixel = geometry.pixel(pixel_nm)
    at = lambda c, off: F.rint((F.col(c) / pixel - off) * scale).cast("int")
    key = F.col("key") if "key" in particles.columns else F.lit(None).cast("string")
    return rows.select(at("x_global", offset[1]).alias("x"), at("y_global", offset[0]).alias("y"), geometry.marker_radius(F.col("size"), pixel_nm, scale).alias("radius"), key.alias("key"))


def overlay(rgb: np.ndarray, marks: DataFrame, colours: Mapping[str, tuple[int, int, int]] | None = None) -> np.ndarray:
    """The picture with a circle for each mark inside it; marks come one by one."""
    out = rgb.copy()
    height, width = rgb.shape[:2]
    inside = marks.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    for m in inside.orderBy("y", "x", "radius", "key").toLocalIterator():
        circle(out, m["x"], m["y"], m["radius"], (colours or {}).get(m["key"], CIRCLE))
    return out


def frame(image: np.ndarray, longest: int = 960, turn: bool = False) -> np.ndarray:
    """A camera's frame for display: blue and red swapped, at most `longest` pixels wide or high, turned by a quarter if asked."""
    image = np.asarray(image)
    image = image[..., ::-1] if image.ndim == 3 else image
    side = max(image.shape[:2])
    if side > longest:
        h, w = (max(round(n * longest / side), 1) for n in image.shape[:2])
        planes = image[..., None] if image.ndim == 2 else image
        small = np.stack([filters.area_resize(planes[..., c], h, w) for c in range(planes.shape[2])], -1)
        image = np.rint(small).astype(image.dtype).reshape((h, w, *image.shape[2:]))
    return np.ascontiguousarray(np.rot90(image) if turn else image)
