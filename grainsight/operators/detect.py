"""Photos to detections: kernels in Arrow batches, one photo at a time; gates and structure filters as DataFrame plans."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import blobs as kernel
from ..kernels import filters
from ..kernels.residual import Residual, Settings, corrected, notch_mask
from ..sources.tiles import photo_batch, photo_row, pixels
from . import score, structure
from .gates import Gates, gated

BLOB_SCHEMA = "path string, number int, " + ", ".join(f"{c} {'boolean' if c == 'on_island' else 'double'}" for c in kernel.MEASURES) + ", photo_height int, photo_width int"


def each_photo(photos: DataFrame, run, schema: str) -> DataFrame:
    """`run(path, image)` gives rows, columns in the schema's order, for each photo that could be read."""
    spark_schema = photos.sparkSession.createDataFrame([], schema).schema
    names = spark_schema.names

    def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(spark_schema)
        for part in parts:
            for path, h, w, dtype, raw in zip(*part.columns, strict=True):
                if raw.is_valid:
                    rows = run(path.as_py(), pixels(h.as_py(), w.as_py(), dtype.as_py(), raw.as_py()))
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], arrow.field(i).type) for i in range(len(names))], names)

    return photos.select("path", "height", "width", "dtype", "pixels").mapInArrow(batches, schema)


def mapped(photos: DataFrame, kernel_) -> DataFrame:
    """Photos with `kernel_(image)` in place of the image."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, h, w, dtype, raw in zip(*part.columns, strict=True):
                image = kernel_(pixels(h.as_py(), w.as_py(), dtype.as_py(), raw.as_py())) if raw.is_valid else None
                yield photo_batch([(path.as_py(), None, None, None, None) if image is None else photo_row(path.as_py(), image)])

    return photos.select("path", "height", "width", "dtype", "pixels").mapInArrow(run, "path string, height int, width int, dtype string, pixels binary")


def corrections(photos: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return mapped(photos, lambda image: corrected(image, settings))


def sharpness(photos: DataFrame) -> DataFrame:
    """(path, sharpness) of each photo."""
    return each_photo(photos, lambda path, image: [(path, filters.sharpness(image))], "path string, sharpness double")


def shared_mask(photos: DataFrame, settings: Settings) -> np.ndarray | None:
    """The notches of the first photo, for all, where the settings ask for a shared mask; one photo comes to the driver."""
    if settings.method.lower() != "fft" or settings.fft_mask.lower() != "shared":
        return None
    first = photos.where("pixels IS NOT NULL").orderBy("path").limit(1).collect()
    if not first:
        return None
    image = pixels(first[0]["height"], first[0]["width"], first[0]["dtype"], first[0]["pixels"])
    return notch_mask(corrected(image, settings), settings.fft_peak_threshold, settings.fft_notch_radius)


def blobs(photos: DataFrame, settings: Settings = Settings(), mask: np.ndarray | None = None, already_corrected: bool = False) -> DataFrame:
    """(path, number, measures, photo size): every blob of every photo with what the gates judge; sizes are of the raw photo."""
    shared = photos.sparkSession.sparkContext.broadcast((settings, mask))

    def run(path: str, photo: np.ndarray) -> list[tuple]:
        s, mask = shared.value
        maps = Residual.of(photo if already_corrected else corrected(photo, s), s, mask)
        rows = kernel.measured(kernel.find(maps, s), maps, s, photo)
        island = kernel.MEASURES.index("on_island")
        return [(path, i, *(bool(v) if k == island else float(v) for k, v in enumerate(row)), *photo.shape) for i, row in enumerate(rows.tolist())]

    return each_photo(photos, run, BLOB_SCHEMA)


def gates_of(s: Settings) -> Gates:
    return Gates(
        min_prominence=s.min_prominence,
        min_confidence=s.min_confidence,
        edge_exclude_px=s.edge_exclude_px if s.edge_soften_sigma > 0 else 0.0,
        min_circularity=s.min_circularity,
        max_support_px=s.max_support_area_px,
        min_size_px=s.min_size_nm / s.pixel,
        max_size_px=s.max_size_nm / s.pixel,
        min_area_px=s.min_area_px,
    )


def judged(found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Blobs with the first gate that they fail as `reason`, and the names that features and reports use."""
    area = 2 * np.pi * F.col("sigma") * F.col("sigma")
    named = gated(found, gates_of(settings)).withColumns({"id": F.concat_ws("#", "path", "number"), "confidence": F.col("prominence"), "local_peak_snr": F.col("peak_snr"), "support_over_area": F.col("support") / F.greatest(area, F.lit(1e-6)), "edge_distance_px": F.col("edge_distance"), "tile_border_dist_px": F.col("border_distance")})
    return named


def filtered(candidates: DataFrame, settings: Settings = Settings(), stages: bool = False) -> DataFrame:
    """Candidates after the structure filters, photo by photo; with `stages` all of them, `stage` telling which filter took each."""
    s, on = settings, ["path"]
    counted = structure.neighbour_counts(candidates, 48.0, on, name="n_neighbors_48")
    loose = structure.reject_clustered(counted, s.structure_neighbor_px, s.structure_min_neighbors, s.structure_size_ratio, on=on, snr="local_peak_snr")
    kept = structure.reject_aligned(loose, s.structure_line_bin_px, s.structure_line_min_run, s.structure_line_min_span_px, s.structure_line_max_gap_px, s.structure_size_ratio, on=on)
    if not stages:
        return kept
    marks = loose.select("id", F.lit(True).alias("_loose")).join(kept.select("id", F.lit(True).alias("_kept")), "id", "left")
    stage = F.when(F.col("_kept"), "kept").when(F.col("_loose"), "axis_chain").otherwise("cluster")
    return counted.join(marks, "id", "left").withColumn("stage", stage).drop("_loose", "_kept")


def detect(photos: DataFrame, config: Mapping[str, Any], artifact: dict[str, Any] | None = None, mask: np.ndarray | None = None) -> DataFrame:
    """Accepted detections of all photos: gates, model score if one is given and structure filters, in the order that the settings ask for."""
    s = Settings.of(config)
    found = judged(blobs(photos, s, mask), s).where("reason = 'kept'")
    if artifact is None or not score.enabled(config):
        return filtered(found, s)
    features = lambda rows: rows.withColumn("size_um", F.col("size") * F.lit(s.pixel / 1000.0))
    if score.before_structure(config):
        counted = structure.neighbour_counts(found, 48.0, ["path"], name="n_neighbors_48")
        return filtered(score.keep_scored(features(counted), artifact, score.threshold(config)).drop("size_um", "score", "n_neighbors_48"), s)
    return score.keep_scored(features(filtered(found, s)), artifact, score.threshold(config)).drop("size_um", "score")


POINT_SCHEMA = "path string, point long, residual double, edge_distance_px double"


def trace(photos: DataFrame, points: DataFrame, config: Mapping[str, Any], near_px: float = 20.0, mask: np.ndarray | None = None) -> DataFrame:
    """Why places have no detection: `points` (path, point, y, x) with reason, residual, edge distance and distances to the nearest blob and kept detection.

    Distances are infinite where a photo has none.
    """
    s = Settings.of(config)
    shared = photos.sparkSession.sparkContext.broadcast((s, mask))
    asked = points.groupBy("path").agg(F.collect_list(F.struct(F.col("point").cast("long").alias("point"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))).alias("asked"))

    def here(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, mask = shared.value
        for part in parts:
            for path, h, w, dtype, raw, asked in zip(*part.columns, strict=True):
                maps = Residual.of(corrected(pixels(h.as_py(), w.as_py(), dtype.as_py(), raw.as_py()), s), s, mask)
                rows = []
                for p in asked.as_py():
                    y, x = min(max(round(p["y"]), 0), h.as_py() - 1), min(max(round(p["x"]), 0), w.as_py() - 1)
                    rows.append((path.as_py(), p["point"], float(maps.value[y, x]), float(maps.distance[y, x]) if maps.distance is not None else float("nan")))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.float64(), pa.float64()))], ["path", "point", "residual", "edge_distance_px"])

    values = photos.where("pixels IS NOT NULL").join(asked, "path").select("path", "height", "width", "dtype", "pixels", "asked").mapInArrow(here, POINT_SCHEMA)
    all_ = judged(blobs(photos, s, mask), s).select("id", "path", "y", "x", "size", "local_peak_snr", "reason")
    staged = filtered(all_.where("reason = 'kept'"), s, stages=True).select("id", "stage")
    places = all_.join(staged, "id", "left").select("path", F.col("y").alias("by"), F.col("x").alias("bx"), F.coalesce("stage", "reason").alias("_why"))
    away = F.hypot(F.col("bx") - F.col("x"), F.col("by") - F.col("y"))
    near = points.join(places, "path").groupBy("path", "point").agg(F.min(away).alias("_blob"), F.min_by("_why", away).alias("_why"), F.min(F.when(F.col("_why") == "kept", away)).alias("_kept"))
    far = F.lit(float("inf"))
    out = points.join(values, ["path", "point"]).join(near, ["path", "point"], "left").withColumns({"nearest_blob_px": F.coalesce("_blob", far), "nearest_kept_px": F.coalesce("_kept", far)})
    in_edge = F.lit(s.edge_exclude_px > 0) & ~F.isnan("edge_distance_px") & (F.col("edge_distance_px") <= s.edge_exclude_px)
    none = F.when(F.col("residual") < s.min_prominence, "no_dog_peak_low_residual").when(in_edge, "no_dog_peak_in_edge_zone").otherwise("no_dog_peak")
    reason = F.when(F.col("nearest_kept_px") <= near_px, "already_kept").when(F.col("nearest_blob_px") > near_px, none).otherwise(F.col("_why"))
    return out.withColumn("reason", reason).drop("_blob", "_why", "_kept")
