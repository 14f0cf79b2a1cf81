"""Results of earlier runs: tables, settings and the marker that says a queue was cleared."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import get, overlaid
from ..functions import names
from .tiles import _files

# A run's settings file, the marker's file, settings that a run hands on, columns that a table must have.
POINTER, CLEARED = "last_pipeline.json", "label_queue_cleared.json"
KEPT = ("input_dir", "output_dir", "pixel_size_nm", "overlap_fraction", "filename_pattern")
REQUIRED = ("id", "x_global", "y_global", "size", "confidence", "source_tile")


def read_particles(spark: SparkSession, path: str, siblings: DataFrame | None = None) -> DataFrame:
    """A results table with nanometre columns, the file that each row is from and its key.

    Columns of micrometres stand in for missing ones of nanometres.  `siblings`
    (source_tile, siblings) tells combined photos' families, see `tiles.combined_family`.
    """
    rows = spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    for um, nm in (("x_global_um", "x_global"), ("y_global_um", "y_global"), ("size_um", "size")):
        if nm not in rows.columns and um in rows.columns:
            rows = rows.withColumn(nm, F.col(um).cast("double") * 1000.0)
    if missing := [c for c in REQUIRED if c not in rows.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return tagged(rows.withColumn("source_csv", F.input_file_name()), siblings)


def tagged(rows: DataFrame, siblings: DataFrame | None = None) -> DataFrame:
    """`rows` with their keys: an existing one, unless it is blank or the photo's family has keys of its own."""
    kin, out = None, rows
    if siblings is not None:
        out = rows.join(siblings.select("source_tile", F.col("siblings").alias("_kin")).dropDuplicates(["source_tile"]), "source_tile", "left")
        kin = F.col("_kin")
    old = F.col("key").cast("string") if "key" in rows.columns else F.lit(None).cast("string")
    return out.withColumn("key", names.row_key("source_tile", old, F.col("x_global"), F.col("y_global"), kin)).drop("_kin")


def newest_settings(spark: SparkSession, folder: str) -> str | None:
    """The settings file of the run that wrote last; of equal times the last by name."""
    found = _files(spark, folder).where(F.col("rel").rlike(rf"^[^/]+/{POINTER}$".replace(".json", r"\.json")))
    return found.agg(F.max_by("path", F.struct("modified", "rel")).alias("path")).head()["path"]


def last_run(spark: SparkSession, folder: str, config: Mapping[str, Any] | None = None, exists=os.path.isfile) -> tuple[str | None, dict[str, Any]]:
    """(path of the last run's table, settings): the settings under those that the run hands on.

    Without a table of its own, or a readable settings file, the configured output's table is taken if it is there.
    """
    out = dict(config or {})
    pointer = newest_settings(spark, folder) if exists is not os.path.isfile or os.path.isdir(folder) else None
    if pointer is not None:
        try:
            saved = json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", "true").text(pointer).collect()))
        except ValueError:
            saved = {}
        if isinstance(saved, dict):
            out |= {k: saved[k] for k in KEPT if saved.get(k) not in (None, "")}
            least = get(saved, "detection.min_size_nm")
            if least not in (None, ""):
                out = overlaid(out, {"detection": {"min_size_nm": float(least)}})
            if saved.get("csv") and exists(saved["csv"]):
                return saved["csv"], out
    fallback = os.path.join(str(get(out, "output_dir", "") or ""), "particles.csv")
    return (fallback if exists(fallback) else None), out


def _stamp(path: str) -> dict[str, Any]:
    found = os.stat(path)
    return {"csv": os.path.realpath(path), "mtime_ns": found.st_mtime_ns, "size": found.st_size}


def clear_queue(path: str, folder: str) -> str:
    """Marks a table's queue as cleared, as long as the file stays as it is; the marker's path."""
    os.makedirs(folder, exist_ok=True)
    marker = os.path.join(folder, CLEARED)
    with open(marker, "w", encoding="utf-8") as f:
        json.dump(_stamp(path), f, indent=2)
    return marker


def is_cleared(path: str | None, folder: str) -> bool:
    """Whether the marker names this very file, unchanged; a broken marker marks nothing."""
    marker = os.path.join(folder, CLEARED)
    if path is None or not os.path.isfile(path) or not os.path.isfile(marker):
        return False
    try:
        with open(marker, encoding="utf-8") as f:
            return json.load(f) == _stamp(path)
    except ValueError:
        return False


def restore_queue(folder: str) -> None:
    marker = os.path.join(folder, CLEARED)
    if os.path.exists(marker):
        os.remove(marker)
