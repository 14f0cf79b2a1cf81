"""Photos in folders as DataFrames: listing, matching by name, decoding.

Listings read no pixels: `binaryFile` prunes the content.  Paths stay what Spark
gives, so any store that Spark reads will do.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from . import decode

# Suffixes of photos, in the order that they are listed; names of photos by default.
SUFFIXES = (".tif", ".tiff", ".bmp", ".png", ".jpg", ".jpeg")
TILE_PATTERN = r"R(?P<run>\d+)_(?P<row>\d+)_(?P<col>\d+)_(?P<mag>[\d.]+)X\.(?:tiff?|bmp|png|jpe?g)"
PHOTO_SCHEMA = "path string, height int, width int, dtype string, pixels binary"


def _escaped(folder: str) -> str:
    """A folder whose name isn't taken for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", folder)


def _files(spark: SparkSession, folder: str, deep: bool = True) -> DataFrame:
    """(path, modified, length, rel) of all files; rel: the path below the folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower())
    plain = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "")
    top = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "", folder).rstrip("/") + "/"
    found = reader.load(_escaped(folder))
    return found.withColumn("rel", F.when(plain.startswith(top), F.substring(plain, len(top) + 1, 1 << 30)).otherwise(names.base("path"))).withColumnRenamed("modificationTime", "modified")


def is_photo(name: Column | str) -> Column:
    return F.lower(names.base(name)).rlike(r"\.(tiff?|bmp|png|jpe?g)$")


def suffix_rank(name: Column | str) -> Column:
    """Place of a name's suffix in the listing order; 0 for other names."""
    found = F.regexp_extract(F.lower(names.base(name)), r"(\.[a-z]+)$", 1)
    return F.array_position(F.array(*map(F.lit, SUFFIXES)), found)


def is_lighting(name: Column | str) -> Column:
    """A shot or a combined photo, as submaps hold them."""
    return names.lighting_role(name).isNotNull() | names.is_combined(name)


def _chosen(rel: Column) -> Column:
    """Photos of the folder itself, and shots and combined photos of its folders v<number>; other nesting isn't looked at."""
    depth = F.size(F.split(rel, "/"))
    submap = F.split(rel, "/")[0].rlike(r"(?i)^v\d+$")
    return is_photo(rel) & ((depth == 1) | ((depth == 2) & submap & is_lighting(rel)))


def list_tiles(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """(path, rel, modified, length, place[, content]) of a folder's photos; `place` orders them: by suffix, then name, submaps last.

    `place` is a struct and not a running number, so that no task sees all files.
    """
    rel = F.col("rel")
    inner = F.size(F.split(rel, "/")) > 1
    place = F.struct(inner.alias("submap"), F.when(inner, F.split(rel, "/")[0]).otherwise("").alias("folder"), suffix_rank(rel).alias("suffix"), rel.alias("rel"))
    found = _files(spark, folder).where(_chosen(rel)).withColumn("place", place)
    return found.select("path", "rel", "modified", "length", "place", *(["content"] if content else []))


def submap_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Only the photos of folders v<number>."""
    return list_tiles(spark, folder).where("place.submap")


def match(tiles: DataFrame, pattern: str, run: int | None = None, magnification: float | None = None, unmatched: bool = False) -> DataFrame:
    """Tiles whose names match, with the parsed name as `at`; of the asked run and magnification and not in column 0.

    A name without a run or magnification isn't of the asked one.  With `unmatched`,
    names that don't match stay, whatever is asked.
    """
    at = F.col("at")
    fits = F.coalesce(at["col"] != 0, F.lit(True))
    if run is not None:
        fits &= F.coalesce(at["run"], F.lit(-1)) == int(run)
    if magnification is not None:
        fits &= F.abs(F.coalesce(at["mag"], F.lit(-1.0)) - float(magnification)) <= 1e-6
    return tiles.withColumn("at", names.parsed("path", pattern)).where(F.when(at.isNull(), F.lit(unmatched)).otherwise(fits))


def tile_ids(tiles: DataFrame) -> DataFrame:
    """(tile): the distinct ids of the tiles; shots and combined photos by submap, others by name."""
    return tiles.select(F.when(is_lighting("path"), names.lighting_id("path")).otherwise(names.lighting_id("path")).alias("tile")).distinct()


def unplaced(tiles: DataFrame, pattern: str) -> DataFrame:
    """Tiles whose names give no place."""
    return tiles.where(~names.placeable(names.parsed("path", pattern)))


def of_path(particles: DataFrame, path: str) -> DataFrame:
    """The particles of one photo: the same name, and the same folder where a particle names one."""
    name, folder = posixpath.basename(path.replace("\\", "/")), posixpath.basename(posixpath.dirname(path.replace("\\", "/")))
    return particles.where((names.base("source_tile") == name) & names.parent("source_tile").isin("", ".", folder))


def kind(head: Column) -> Column:
    """jpeg, bmp, png, tiff or unknown by the first bytes."""
    found = F.lit(None).cast("string")
    for name, starts in decode.MAGIC.items():
        for start in starts:
            found = F.when(F.hex(F.substring(head, 1, len(start))) == start.hex().upper(), name).otherwise(found)
    return F.coalesce(found, F.lit("unknown"))


def sizes(files: DataFrame) -> DataFrame:
    """(path, kind, height, width) from the headers of files (path, content); null sizes where a header has none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [c.as_py() or b"" for c in batch.column(1)]
            found = [_quiet(decode.size, h) for h in heads]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode.kind(h[:8]) for h in heads], pa.string()), *(pa.array([f[i] if f else None for f in found], pa.int32()) for i in (0, 1))], ["path", "kind", "height", "width"])

    return files.select("path", "content").mapInArrow(run, "path string, kind string, height int, width int")


def _quiet(read, data: bytes):
    try:
        return read(data)
    except (ValueError, IndexError, KeyError, OSError, ArithmeticError, __import__("struct").error):
        return None


def photo_row(path: str, image: np.ndarray) -> tuple:
    return path, image.shape[0], image.shape[1], image.dtype.str, np.ascontiguousarray(image).tobytes()


def photo_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["path", "height", "width", "dtype", "pixels"])


def pixels(height: int, width: int, dtype: str, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.dtype(dtype)).reshape(height, width)


def decoded(files: DataFrame) -> DataFrame:
    """Gray photos (`PHOTO_SCHEMA`) of PNG, BMP and TIFF files (path, content); one photo at a time.

    A file that can't be read has no pixels (null size); JPEG files are left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_py() or b""
                if decode.kind(data[:8]) == "jpeg":
                    continue
                image = _quiet(lambda d: decode.gray(decode.read(d)), data)
                yield photo_batch([(path.as_py(), None, None, None, None) if image is None else photo_row(path.as_py(), image)])

    return files.select("path", "content").mapInArrow(run, PHOTO_SCHEMA)


def _from_image_source(frames: DataFrame) -> DataFrame:
    """Gray photos from Spark's image source (path, image), which has eight bits a channel in the order blue, green, red."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, h, w, n, raw in zip(*batch.columns, strict=True):
                image = np.frombuffer(raw.as_py(), np.uint8).reshape(h.as_py(), w.as_py(), n.as_py())
                image = image[..., 0] if image.shape[2] == 1 else image[..., 2::-1]
                yield photo_batch([photo_row(path.as_py(), decode.gray(image))])

    return frames.select("path", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(run, PHOTO_SCHEMA)


def photos(spark: SparkSession, folder: str, files: DataFrame | None = None) -> DataFrame:
    """Gray photos (`PHOTO_SCHEMA`) of files (path, content), as `list_tiles` and `match` give them with their content; all of the folder if none are given.

    Bytes are decoded where they are read.  Files that are JPEG by their bytes,
    whatever their names, are decoded by the JVM, and only those meet in a join.
    """
    files = (list_tiles(spark, folder, content=True) if files is None else files).select("path", "content")
    found = decoded(files)
    jpeg = files.where(kind(F.col("content")) == "jpeg").select("path")
    suffixes = [r["s"] for r in jpeg.select(F.regexp_extract(names.base("path"), r"\.([A-Za-z]+)$", 1).alias("s")).distinct().collect()]
    if suffixes:  # at most the suffixes that a photo may have
        frames = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(suffixes)}}}").load(_escaped(folder))
        # the image source gives its paths as URIs
        decoded_ = F.url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B")))
        plain = F.regexp_replace(decoded_, "^([A-Za-z][A-Za-z0-9+.-]*):///", "$1:/")
        frames = frames.select(plain.alias("origin"), "image")
        made = _from_image_source(frames.join(jpeg.withColumn("origin", F.regexp_replace("path", "^([A-Za-z][A-Za-z0-9+.-]*):///", "$1:/")), "origin"))
        found = found.unionByName(jpeg.join(made, "path", "left"))
    return found


def resolve(folder: str, roots: dict[str, str], exists) -> str:
    """The first existing place that a folder's name may stand for.

    `roots`: cwd, package, inputs and workspace; `exists` tells whether a path is a
    folder, so that any store can be asked.
    """
    text = str(folder).strip().strip("\"'")
    if not text:
        raise FileNotFoundError("no input folder is given")
    first, join = text.split("/")[0], posixpath.join
    if text.startswith("/") or re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:/", text):
        tried = [text]
    elif first in (".", ".."):
        tried = [join(roots["package"], text), join(roots["inputs"], posixpath.basename(text.rstrip("/")))]
    else:
        tried = [join(roots["cwd"], text), join(roots["package"], text), join(roots["inputs"], text)]
        if first in (posixpath.basename(roots["inputs"]), "Input"):
            tried.append(join(roots["workspace"], text))
        tried.append(join(roots["workspace"], "Input", text))
    tried = list(dict.fromkeys(posixpath.normpath(t) if "://" not in t else t for t in tried))
    for path in tried:
        if exists(path):
            return path
    raise FileNotFoundError(f"input folder {folder!r} isn't there; tried: {', '.join(tried)}")


def input_folders(spark: SparkSession, root: str) -> DataFrame:
    """(folder): folders below the root that can be run, those with photos of their own or shots in a folder v<number>; hidden ones aside."""
    rel = F.col("rel")
    files = _files(spark, root).where(~rel.rlike(r"(^|/)\.[^/]*/") & is_photo(rel)).select("rel")
    folder = F.regexp_replace(rel, "/?[^/]*$", "")
    own = files.select(folder.alias("folder"))
    shots = files.where(names.submap(rel) != "").where(names.lighting_role(rel).isNotNull()).select(F.regexp_replace(folder, "/?[^/]*$", "").alias("folder"))
    return own.unionByName(shots).where("folder <> ''").distinct()


def combined_family(tiles: DataFrame) -> DataFrame:
    """`tiles` with `siblings`: the family of the photos beside each in its folder, light before nsew; empty without any."""
    folder = F.regexp_replace(names.path("path"), "/?[^/]*$", "")
    light = F.max(names.lighting_role("path").isNotNull())
    letters = F.max(names.is_direction_family("path"))
    found = tiles.groupBy(folder.alias("_folder")).agg(F.when(light, "light").when(letters, "nsew").otherwise("").alias("siblings"))
    return tiles.withColumn("_folder", folder).join(found, "_folder").drop("_folder")


def grid_origin(tiles: DataFrame) -> DataFrame:
    """One row (row0, col0): the least row and column of parsed names `at`; 0 without any."""
    return tiles.agg(F.coalesce(F.min("at.row"), F.lit(0)).alias("row0"), F.coalesce(F.min("at.col"), F.lit(0)).alias("col0"))


def directions(tiles: DataFrame) -> DataFrame:
    """(folder, N, S, E, W): the photo of each side of a folder, by letter or quadrant; null sides are missing.

    Two photos of one side raise an error when the row is read.
    """
    side = F.coalesce(names.direction("path"), names.quadrant("path"))
    folder = F.regexp_replace(names.path("path"), "/?[^/]*$", "")
    found = tiles.select(folder.alias("folder"), side.alias("side"), "path").where("side IS NOT NULL").groupBy("folder")
    one = [F.collect_list(F.when(F.col("side") == s, F.col("path"))).alias(s) for s in names.DIRECTIONS]
    twice = lambda s: F.when(F.size(s) > 1, F.raise_error(F.concat(F.lit(f"several photos of side {s} in "), F.col("folder"))).cast("string"))
    return found.agg(*one).select("folder", *(F.coalesce(twice(s), F.get(s, F.lit(0))).alias(s) for s in names.DIRECTIONS))


def cell_sides(tiles: DataFrame) -> DataFrame:
    """(folder, row, col, N, S, E, W): the photos (row,col)_D of each cell with all four sides.

    Of several photos of a side, one with the suffix that the cell's first photo has
    is preferred, then the one listed first.
    """
    folder = F.regexp_replace(names.path("path"), "/?[^/]*$", "")
    each = tiles.select(folder.alias("folder"), names.positional("path").alias("p"), suffix_rank("path").alias("suffix"), "path").where("p IS NOT NULL").select("folder", "p.*", "suffix", "path")
    cell = Window.partitionBy("folder", "row", "col")
    first = each.withColumn("own", F.min_by("suffix", F.struct("suffix", "path")).over(cell))
    best = first.groupBy("folder", "row", "col").agg(*(F.min_by("path", F.when(F.col("direction") == s, F.struct(F.col("suffix") != F.col("own"), F.col("suffix"), F.col("path")))).alias(s) for s in names.DIRECTIONS))
    return best.dropna(subset=list(names.DIRECTIONS))


def current_outputs(outputs: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, current): whether an output (path, modified, readable) is at least as new as all its sources (output, modified) and can be read."""
    newest = sources.groupBy(F.col("output").alias("path")).agg(F.max("modified").alias("_newest"))
    fresh = F.coalesce(F.col("modified") >= F.col("_newest"), F.lit(True))
    return newest.join(outputs, "path", "full").select("path", (F.col("modified").isNotNull() & fresh & F.coalesce("readable", F.lit(False))).alias("current"))
