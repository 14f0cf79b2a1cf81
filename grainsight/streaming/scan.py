"""A scan as a stream of files: photos that arrive are scored, and manifest and sharpness log follow stop by stop."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import names
from ..operators import capture
from ..operators.detect import sharpness
from ..sinks.files import write_json
from ..sources.tiles import decoded

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
#: A capture's photos: (row,col).png or (row,col)_D.png.
NAME = r"^\((\d+),(\d+)\)(?:_([NSEW]))?\.[A-Za-z]+$"


def frames(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """The stream of a capture folder's files; a batch holds a bounded number of them."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "(*.*").load(folder)


def scored(files: DataFrame) -> DataFrame:
    """(row, col, name, modified, sharpness) of a batch's photos; files of other names are left out."""
    name = names.base("path")
    part = lambda i: F.regexp_extract(name, NAME, i)
    at = files.where(name.rlike(NAME)).select("path", "content", part(1).cast("int").alias("row"), part(2).cast("int").alias("col"), name.alias("name"), F.col("modificationTime").alias("modified"))
    return at.drop("content").join(sharpness(decoded(at)), "path").drop("path")


def merged_log(before: dict[str, Any], rows: list[dict[str, Any]]) -> dict[str, Any]:
    """A sharpness log with more photos: a stop's known names are scored anew, others follow in order; its sharpness is the mean."""
    stops = {(s["row"], s["col"]): s | {"files": list(s["files"])} for s in before.get("stops", [])}
    for r in rows:
        stop = stops.setdefault((r["row"], r["col"]), {"row": r["row"], "col": r["col"], "sharpness": 0.0, "files": []})
        stop["files"] = [f for f in stop["files"] if f["name"] != r["name"]] + [{"name": r["name"], "sharpness": r["sharpness"]}]
        stop["sharpness"] = sum(f["sharpness"] for f in stop["files"]) / len(stop["files"])
    return {"stops": list(stops.values())}


def merged_manifest(before: dict[str, Any], settings: Mapping[str, Any], rows: list[dict[str, Any]]) -> dict[str, Any]:
    """A manifest with more photos: settings are the last ones, a stop's new names follow the known ones."""
    stops = {(s["row"], s["col"]): {"row": s["row"], "col": s["col"], "files": list(s["files"])} for s in before.get("stops", [])}
    for r in rows:
        names_ = stops.setdefault((r["row"], r["col"]), {"row": r["row"], "col": r["col"], "files": []})["files"]
        if r["name"] not in names_:
            names_.append(r["name"])
    return {**before, **settings, "stops": list(stops.values())}


def _read(path: str) -> dict[str, Any]:
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_sharpness_log(stops: DataFrame, folder: str) -> str:
    """`sharpness.json` of a capture's stops (row, col, sharpness, files); one scan's stops are few."""
    path = os.path.join(folder, "sharpness.json")
    write_json({"stops": [r.asDict(recursive=True) for r in stops.orderBy("row", "col").collect()]}, path)
    return path


def capture_stream(spark: SparkSession, folder: str, checkpoint: str, settings: Mapping[str, Any] | None = None, available_now: bool = True) -> StreamingQuery:
    """Starts the stream that keeps a capture folder's `manifest.json` and `sharpness.json`.

    A batch's scores, at most `files_per_batch` rows, come to the driver, which owns
    both files; a batch that is repeated after a failure changes nothing.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        rows = [r.asDict() for r in scored(batch).orderBy("modified", "row", "col", "name").collect()]
        for name, merge in (("sharpness.json", lambda old: merged_log(old, rows)), ("manifest.json", lambda old: merged_manifest(old, settings or {}, rows))):
            path = os.path.join(folder, name)
            write_json(merge(_read(path)), path)

    writer = frames(spark, folder).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def refocus(stops: DataFrame, every: int = capture.FOCUS_EVERY) -> DataFrame:
    """A scan's stops with those where focus is due."""
    return capture.with_refocus(stops, every)
