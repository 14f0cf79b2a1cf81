"""A whole inspection run: photos of a folder to a table of particles, a mosaic and files.

Photos are listed, matched by name, decoded, combined where four sides show one
place, searched for particles, placed and de-duplicated.  All of it is one plan of
DataFrames; the driver sees settings, one-row aggregates and the small canvas.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as settings
from ..functions import geometry, names
from ..operators import combine, dedup, detect, mosaic, score
from ..operators.checkpoint import cut
from ..sinks import files
from ..sources import tiles as sources
from ..sources.tiles import PHOTO_SCHEMA, TILE_PATTERN, photo_batch, photo_row, pixels

#: Fixed value: the largest picture of one photo in a report, in MB.
PHOTO_MB = 8.0


def _folder(path: str) -> Column:
    return F.regexp_replace(names.path(path), "/?[^/]*$", "")


def _sides(photos: DataFrame) -> DataFrame:
    """Photos that are one side of a place, with the place's combined file as `output`."""
    at, letter = names.positional("path"), names.direction("path")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    cell = F.concat(_folder("path"), F.lit("/"), F.format_string("(%d,%d)", at["row"], at["col"]))
    letters = F.concat(_folder("path"), F.lit("/combi_2of4"))
    side = F.coalesce(at["direction"], letter)
    sided = photos.withColumns({"side": side, "place": F.when(at.isNotNull(), cell).when(letter.isNotNull(), letters), "suffix": suffix})
    return sided.where("side IS NOT NULL")


def combined(photos: DataFrame, rank: int = 3) -> DataFrame:
    """One photo (`PHOTO_SCHEMA`) for each place with all four sides: what at least `rank` of them agree on, in eight bits.

    Its path is the place's, with the north side's suffix.  Sides of different
    sizes, and a side that comes twice, are errors.
    """
    one = F.struct("height", "width", "dtype", "pixels")
    sided = _sides(photos.where("pixels IS NOT NULL"))
    each = sided.groupBy("place").agg(*(F.collect_list(F.when(F.col("side") == s, one)).alias(s) for s in names.DIRECTIONS), F.min(F.when(F.col("side") == "N", F.col("suffix"))).alias("suffix"))
    once = [F.when(F.size(s) > 1, F.raise_error(F.concat(F.lit(f"several photos of side {s} of "), F.col("place"))).cast(sided.select(one.alias("x")).schema["x"].dataType)).otherwise(F.get(s, F.lit(0))).alias(s) for s in names.DIRECTIONS]
    full = each.select(F.concat("place", "suffix").alias("path"), *once).dropna(subset=list(names.DIRECTIONS))

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, *sides in zip(*part.columns, strict=True):
                stack = [np.asarray(pixels(s["height"], s["width"], s["dtype"], s["pixels"]), np.float32) for s in (x.as_py() for x in sides)]
                if len({s.shape for s in stack}) > 1:
                    raise ValueError(f"the sides of {path.as_py()} differ in size")
                yield photo_batch([photo_row(path.as_py(), combine.to_bytes(combine.symmetry_maps(np.stack(stack), rank)[1]))])

    return full.mapInArrow(run, PHOTO_SCHEMA)


def prepared(photos: DataFrame) -> DataFrame:
    """Photos with the combined ones in place of what they are made of."""
    made = combined(photos)
    kept = photos.select("path", "height", "width", "dtype", "pixels").join(combine.consumed(photos.select("path")), "path", "left_anti").join(made.select("path"), "path", "left_anti")
    return kept.unionByName(made)


def placements(photos: DataFrame, pattern: str, overlap: float) -> DataFrame:
    """(path, place) of every photo; place: struct(y0, x0, height, width), null without one.

    The least row and column of all names are the mosaic's corner: one row, broadcast.
    """
    at = photos.select("path", "height", "width", names.parsed("path", pattern).alias("at"))
    origin = F.broadcast(sources.grid_origin(at))
    return at.join(origin).select("path", geometry.placement(F.col("at"), F.col("width"), F.col("height"), overlap, F.col("row0"), F.col("col0")).alias("place"))


def tile_id(root: str) -> Column:
    """What particles call their photo: combined ones by their path below the input, others by `names.source_id`."""
    return F.when(names.is_combined("path"), names.combined_id("path", root)).otherwise(names.source_id("path", root))


def particles(detections: DataFrame, placed: DataFrame, config: Mapping[str, Any], root: str) -> DataFrame:
    """Detections in nanometres on the mosaic: id, x, y, size, confidence, source_tile, placed and the features."""
    pixel = geometry.pixel(float(settings.get(config, "pixel_size_nm", 1.0)))
    corner = lambda c: F.coalesce(F.col(f"place.{c}"), F.lit(0))
    both = detections.join(placed, "path", "left")
    features = [c for c in score.FEATURES if c in detections.columns and c not in ("size_um", "confidence")]
    return both.select("id", geometry.to_global(F.col("x"), corner("x0"), pixel).alias("x"), geometry.to_global(F.col("y"), corner("y0"), pixel).alias("y"), (F.col("size") * pixel).alias("size"), "confidence", tile_id(root).alias("source_tile"), F.col("place").isNotNull().alias("placed"), *features)


@dataclass
class Run:
    """A run's table (`particles`), its photos and where they lie."""

    config: dict[str, Any]
    particles: DataFrame
    photos: DataFrame
    placed: DataFrame

    def placements(self) -> DataFrame:
        return self.placed.where("place IS NOT NULL").select("path", "place.*")

    def unplaced(self) -> DataFrame:
        return self.photos.join(self.placed.where("place IS NULL").select("path"), "path", "left_semi")


def run(spark: SparkSession, config: Mapping[str, Any], artifact: dict[str, Any] | None = None, should_stop=lambda: False, progress=lambda current, total, name: None) -> Run:
    """All of a run but its files.  Photos are decoded once and kept in the shared checkpoint folder."""
    config = settings.with_preset(config)
    folder = str(settings.get(config, "input_dir", "") or "")
    if not folder:
        raise ValueError("input_dir is needed")
    pattern = str(settings.get(config, "filename_pattern", TILE_PATTERN))
    found = sources.match(sources.list_tiles(spark, folder, content=True), pattern, settings.get(config, "run") or None, settings.get(config, "magnification") or None, unmatched=True)
    total = found.count()
    if not total:
        raise FileNotFoundError(f"no photos in {folder}")
    progress(0, total, "decoding")
    photos = cut(prepared(sources.photos(spark, folder, found)))
    if should_stop():
        raise InterruptedError("the run was stopped")
    progress(total // 2, total, "searching")
    placed = placements(photos, pattern, float(settings.get(config, "overlap_fraction", 0.0)))
    if score.enabled(config) and artifact is None:
        artifact = score.load(str(settings.get(config, "ml.model_path")))
    s = detect.Settings.of(config)
    rows = cut(particles(detect.detect(photos, config, artifact, detect.shared_mask(photos, s)), placed, config, folder))
    if should_stop():
        raise InterruptedError("the run was stopped")
    progress(total, total, "merging")
    measure = lambda key, default: settings.get(config, f"measurement.{key}", default)
    table = dedup.route_and_deduplicate(rows, s.pixel, float(measure("merge_radius_px", 8.0)), float(measure("nsew_merge_radius_px", 24.0)), float(measure("nsew_size_match_fraction", 0.4)), str(measure("size_aggregation", "max")))
    return Run(dict(config), table.withColumnsRenamed({"x": "x_global", "y": "y_global"}), photos, placed)


def pictures(done: Run) -> tuple[np.ndarray, np.ndarray] | None:
    """(with circles, without): the mosaic, small enough for `report.target_mb`; None if no photo has a place."""
    where = done.placements()
    size = mosaic.extent(where).head()
    if not size["height"]:
        return None
    factor = mosaic.factor_of(size["height"], size["width"], float(settings.get(done.config, "report.target_mb", 20.0)))
    plain = mosaic.display(mosaic.preview(done.photos, where, factor))
    pixel = float(settings.get(done.config, "pixel_size_nm", 1.0))
    return mosaic.overlay(plain, mosaic.markers(done.particles, pixel, 1 / factor, placements=where)), plain


def photo_pictures(done: Run) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(name, with circles, without) of each photo without a place, one after the other."""
    budget = min(float(settings.get(done.config, "report.target_mb", PHOTO_MB)), PHOTO_MB)
    pixel = float(settings.get(done.config, "pixel_size_nm", 1.0))

    def small(path: str, image: np.ndarray) -> list[tuple]:
        factor = mosaic.factor_of(*image.shape, budget)
        shown = mosaic.display(mosaic.filters.shrunk(np.asarray(image, np.float32), factor))[..., 0]
        return [(path, factor, *shown.shape, shown.tobytes())]

    for r in detect.each_photo(done.unplaced(), small, "path string, factor int, h int, w int, shown binary").orderBy("path").toLocalIterator():
        plain = np.repeat(np.frombuffer(r["shown"], np.uint8).reshape(r["h"], r["w"], 1), 3, -1)
        marks = mosaic.markers(sources.of_path(done.particles, r["path"]), pixel, 1 / r["factor"])
        yield os.path.basename(r["path"]), mosaic.overlay(plain, marks), plain


def write(done: Run, out: str) -> str:
    """The run's files in a new folder: table, workbook, settings, pictures and report; its path.

    A folder that exists isn't written to: the next free version of the input's name is taken.
    """
    parent, chosen = os.path.split(out.rstrip("/"))
    os.makedirs(parent or ".", exist_ok=True)
    taken = [d for d in os.listdir(parent or ".") if os.path.isdir(os.path.join(parent, d))]
    source = str(settings.get(done.config, "input_dir", "")).rstrip("/")
    out = os.path.join(parent, settings.reserved(chosen, os.path.basename(source), taken))
    csv = os.path.join(out, "particles.csv")
    files.write_csv_file(done.particles, csv)
    files.write_bytes(files.workbook(done.particles, done.config), os.path.join(out, "particles.xlsx"))
    files.write_settings(done.config, os.path.join(out, "last_pipeline.json"), csv)
    shown = pictures(done)
    if shown:
        for name, picture in zip(("mosaic_overlay.png", "mosaic_plain.png"), shown, strict=True):
            files.write_bytes(files.png(picture), os.path.join(out, name))
    files.write_bytes(files.report_pdf(done.particles, done.config, shown, photo_pictures(done)), os.path.join(out, settings.summary_name(source)))
    return out


def write_variants(photos: DataFrame, out: str) -> list[str]:
    """Combined photos and symmetry maps of letter folders and cells, of two, three and four sides and of neighbouring ones, as PNG files below `out`.

    Written by the tasks; the folder must be one that they share.  Symmetry beyond 1 is clipped.
    """
    full = _sides(photos.where("pixels IS NOT NULL")).groupBy("place").agg(F.collect_list(F.struct("side", "height", "width", "dtype", "pixels")).alias("sides")).where(F.size("sides") == 4)

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for place, sides in zip(*part.columns, strict=True):
                found = {s["side"]: pixels(s["height"], s["width"], s["dtype"], s["pixels"]) for s in sides.as_py()}
                if len(found) < 4 or len({x.shape for x in found.values()}) > 1:
                    raise ValueError(f"{place.as_py()} needs four sides of one size")
                stack = np.stack([np.asarray(found[d], np.float32) for d in names.DIRECTIONS])
                made = {f"{n}of4": combine.symmetry_maps(stack, n) for n in (2, 3, 4)}
                pair = combine.orthogonal_map(stack)
                made["2of4_ortho"] = (4 * pair / (stack.sum(0) + np.float32(combine.EPS)), pair * stack.sum(0) / (stack.sum(0) + np.float32(combine.EPS)))
                made[""] = made["2of4"]
                paths = []
                for name, (share, signal) in made.items():
                    for kind, values in (("combi", combine.to_bytes(signal)), ("symmetry_map", combine.to_bytes(np.clip(share, 0, 1), 255.0))):
                        path = os.path.join(out, kind, os.path.basename(place.as_py().rstrip("/").replace("/combi_2of4", "")), f"{kind}{'_' if name else ''}{name}.png")
                        files.write_bytes(files.png(values), path)
                        paths.append(path)
                yield pa.RecordBatch.from_arrays([pa.array(paths)], ["path"])

    return sorted(r["path"] for r in full.select("place", "sides").mapInArrow(run, "path string").collect())
