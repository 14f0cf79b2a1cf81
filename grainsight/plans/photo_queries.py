"""Registered queries of kernels, placement, review and stage arithmetic, and their SQL.

Kernels run over the photos of 8 x 8 pixels, which SQL can follow pixel by pixel.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, names
from ..kernels import blobs, filters, residual
from ..operators import capture, dedup, detect, mosaic, review
from . import run as runs
from .queries import query
from .relations import DET_SQL, PHOTOS_SQL, detections, photo_table, placements

_IMG = PHOTOS_SQL + """, img AS (SELECT cell || '_' || CASE d WHEN 0 THEN 'N' WHEN 1 THEN 'S' WHEN 2 THEN 'E' ELSE 'W' END || '.png' AS path, (i - 1) // 8 AS y, (i - 1) % 8 AS x, p FROM px)"""


def each(spark: SparkSession, sf_dir: str, run, columns: str) -> DataFrame:
    return detect.each_photo(photo_table(spark, sf_dir), lambda path, image: [(path, *run(image))], f"path string, {columns}")


def added(values: np.ndarray) -> float:
    """The sum of doubles in the order of the pixels, as the SQL adds: on a rounding edge the last bit decides."""
    return float(np.cumsum(np.append(0.0, values))[-1])


def rounded(column: str, digits: int) -> Column:
    """Rounded as DuckDB does it, after a multiplication in doubles; Spark's own rounds the shortest decimal."""
    scale = F.lit(10.0**digits)
    return F.round(F.col(column) * scale) / scale


@query(" SELECT path, sum(p)::BIGINT AS total FROM img GROUP BY 1", _IMG)
def photo_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of full scale, brought back to bytes."""
    return each(spark, sf_dir, lambda x: (round(float(filters.to_float(x).astype(float).sum()) * 255),), "total long")


@query(" SELECT path, round(quantile_cont(p, 0.01), 3) AS low, round(quantile_cont(p, 0.995), 3) AS high, round(greatest(1.4826 * mad(p), 1e-6)::DOUBLE, 4) AS noise FROM img GROUP BY 1", _IMG)
def photo_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = each(spark, sf_dir, lambda x: (*filters.percentiles(x, 1, 99.5), filters.noise(x)), "low double, high double, noise double")
    return found.select("path", F.round("low", 3).alias("low"), F.round("high", 3).alias("high"), F.round("noise", 4).alias("noise"))


@query(", q AS (SELECT path, quantile_cont(p, 0.01) AS a, quantile_cont(p, 0.99) AS b FROM img GROUP BY 1) SELECT path, round(sum(CASE WHEN b > a THEN least(greatest((p - a) / (b - a), 0), 1) ELSE p END), 1) AS total FROM img JOIN q USING (path) GROUP BY 1", _IMG)
def photo_stretched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(spark, sf_dir, lambda x: (added(filters.stretched(x, 1, 99, np.float64)),), "total double").withColumn("total", rounded("total", 1))


@query(", q AS (SELECT path, min(p) AS a, quantile_cont(p, 0.995) - min(p) AS b FROM img GROUP BY 1) SELECT path, round(sum(CASE WHEN b > 0 THEN least((p - a) / b, 1) ELSE 0 END), 1) AS total FROM img JOIN q USING (path) GROUP BY 1", _IMG)
def photo_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(spark, sf_dir, lambda x: (added(filters.unit(x, np.float64)),), "total double").withColumn("total", rounded("total", 1))


@query(
    """, c AS (SELECT path, y - 2 AS y, x - 2 AS x, p FROM img WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5),
  n AS (SELECT a.path, a.y, a.x, sum(b.p * CASE WHEN b.y = a.y AND b.x = a.x THEN -4 ELSE w.k END) AS l FROM c a JOIN c b ON a.path = b.path,
    LATERAL (SELECT CASE WHEN b.x = a.x THEN (b.y = (CASE a.y WHEN 0 THEN 1 ELSE a.y - 1 END))::INT + (b.y = (CASE a.y WHEN 3 THEN 2 ELSE a.y + 1 END))::INT ELSE 0 END
      + CASE WHEN b.y = a.y THEN (b.x = (CASE a.x WHEN 0 THEN 1 ELSE a.x - 1 END))::INT + (b.x = (CASE a.x WHEN 3 THEN 2 ELSE a.x + 1 END))::INT ELSE 0 END AS k) w GROUP BY 1, 2, 3)
  SELECT path, round(var_pop(l), 8) AS sharpness FROM n GROUP BY 1""",
    _IMG,
)
def photo_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.sharpness(photo_table(spark, sf_dir)).withColumn("sharpness", F.round("sharpness", 8))


@query(" SELECT path, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, round(avg(p), 3) AS value FROM img GROUP BY 1, 2, 3", _IMG)
def photo_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(path: str, image: np.ndarray) -> list[tuple]:
        small = filters.shrunk(image, 2)
        return [(path, y, x, float(small[y, x])) for y in range(small.shape[0]) for x in range(small.shape[1])]

    return detect.each_photo(photo_table(spark, sf_dir), run, "path string, y int, x int, value double").withColumn("value", F.round("value", 3))


_DISC = "abs(a.y - b.y) + abs(a.x - b.x) <= 1"


@query(f", e AS (SELECT a.path, a.y, a.x, min(b.p) AS p FROM img a JOIN img b ON a.path = b.path AND {_DISC} GROUP BY 1, 2, 3), o AS (SELECT a.path, a.y, a.x, max(b.p) AS p FROM e a JOIN e b ON a.path = b.path AND {_DISC} GROUP BY 1, 2, 3) SELECT path, sum(img.p - o.p) AS total, count(*) FILTER (img.p > o.p) AS pixels FROM img JOIN o USING (path, y, x) GROUP BY 1", _IMG)
def photo_top_hat(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(image: np.ndarray) -> tuple:
        hat = filters.top_hat(image, 1)
        return float(hat.sum()), int((hat > 0).sum())

    return each(spark, sf_dir, run, "total double, pixels long")


@query(
    """, c AS (SELECT path, max(p) FILTER (y = 4 AND x = 4) AS c, median(p) AS m FROM img GROUP BY 1),
  r AS (SELECT img.*, c, m, sqrt((y - 4) ** 2 + (x - 4) ** 2) AS r FROM img JOIN c USING (path))
  SELECT path, round(coalesce(avg(p) FILTER (r <= 1), 0), 6) AS inner_, round(coalesce(avg(p) FILTER (r > 1 AND r <= 2), 0), 6) AS mid, round(coalesce(avg(p) FILTER (r > 2 AND r <= 3), 0), 6) AS outer_,
    CASE WHEN max(c) > 0 THEN count(*) FILTER (p >= 0.4::DOUBLE * c) ELSE 0 END::DOUBLE AS support, round((max(c) - max(m)) / greatest(1.4826::DOUBLE * median(abs(p - m)), 1e-6::DOUBLE), 3) AS snr FROM r GROUP BY 1""",
    _IMG,
)
def blob_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(image: np.ndarray) -> tuple:
        w = blobs.Window(image, 4.0, 4.0, 4)
        return *blobs.radial_means(w, 2.0), blobs.support(w), float(blobs.peak_snr(w))

    found = each(spark, sf_dir, run, "inner_ double, mid double, outer_ double, support double, snr double")
    return found.select("path", *(F.round(c, 6).alias(c) for c in ("inner_", "mid", "outer_")), "support", F.round("snr", 3).alias("snr"))


@query(
    """, c AS (SELECT path, max(p) FILTER (y = 4 AND x = 4) AS c FROM img GROUP BY 1),
  w AS (SELECT path, c, y, x, greatest(p - 0.4::DOUBLE * c, 0) AS w FROM img JOIN c USING (path)),
  m AS (SELECT path, max(c) AS c, sum(w) AS m, sum(w * y) / nullif(sum(w), 0) AS cy, sum(w * x) / nullif(sum(w), 0) AS cx FROM w GROUP BY 1),
  s AS (SELECT path, max(m.c) AS c, max(m) AS m, sum(w * (x - cx) ** 2) / nullif(max(m), 0) AS xx, sum(w * (y - cy) ** 2) / nullif(max(m), 0) AS yy, sum(w * (x - cx) * (y - cy)) / nullif(max(m), 0) AS xy FROM w JOIN m USING (path) GROUP BY 1),
  e AS (SELECT path, c, m, (xx + yy + sqrt(greatest((xx - yy) ** 2 + 4 * xy ** 2, 0))) / 2 AS big, (xx + yy - sqrt(greatest((xx - yy) ** 2 + 4 * xy ** 2, 0))) / 2 AS small FROM s)
  SELECT path, round(CASE WHEN c <= 0 OR m <= 1e-8 OR big <= 1e-12 THEN 1.0 ELSE greatest(small, 0) / big END, 5) AS circularity FROM e""",
    _IMG,
)
def blob_circularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(spark, sf_dir, lambda x: (blobs.circularity(blobs.Window(x, 4.0, 4.0, 4)),), "circularity double").withColumn("circularity", F.round("circularity", 5))


@query(" SELECT path, max(p) AS peak, floor(sum(floor(CASE WHEN m <= 1 THEN p * 255 ELSE p END)))::BIGINT AS shown FROM img JOIN (SELECT path, max(p) AS m FROM img GROUP BY 1) USING (path) GROUP BY 1", _IMG)
def photo_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(spark, sf_dir, lambda x: (float(x.max()), int(mosaic.display(x)[..., 0].astype(int).sum())), "peak double, shown long")


@query()
def photo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to edges and border."""
    return each(spark, sf_dir, lambda x: (float(residual.edge_distance(filters.to_float(x), 1.0, 3.0).mean()),), "distance double")


@query()
def photo_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sides of a cell as one photo, through the numpy path."""
    at = F.concat(F.lit("c/("), F.regexp_extract("path", r"^(\d+)_", 1), F.lit(",1)_"), F.regexp_extract("path", r"_([NSEW])", 1), F.lit(".png"))
    made = runs.combined(photo_table(spark, sf_dir).withColumn("path", at))
    return detect.each_photo(made, lambda path, x: [(path, int(x.astype(int).sum()))], "path string, total long")


@query()
def photo_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain from photo to gated blobs."""
    s = residual.Settings(method="tophat", tophat_radius=3, denoise=False, flatten_illumination=False, min_size_nm=1.0, max_size_nm=8.0, blob_max_sigma=2.0, edge_soften_sigma=0.0, min_area_px=1.0)
    return detect.judged(detect.blobs(photo_table(spark, sf_dir), s), s).select("path", "number", "y", "x", "sigma", "prominence", "size", "reason")


_PLACED = DET_SQL + """, g AS (SELECT min(tile_row) AS r0, min(tile_col) AS c0 FROM det),
  place AS (SELECT DISTINCT '(' || tile_row || ',' || tile_col || ')_' || role || '.png' AS path, CAST(round_even((tile_row - r0) * 400 * 0.9::DOUBLE, 0) AS INTEGER) AS y0, CAST(round_even((tile_col - c0) * 512 * 0.9::DOUBLE, 0) AS INTEGER) AS x0, 400 AS height, 512 AS width FROM det, g)"""


@query(" SELECT * FROM place", _PLACED)
def tile_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placements(spark, sf_dir)


@query(" SELECT max(y0 + height)::INTEGER AS height, max(x0 + width)::INTEGER AS width FROM place", _PLACED)
def mosaic_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mosaic.extent(placements(spark, sf_dir))


@query(
    """ SELECT path, (greatest(y0, 300) - y0)::INTEGER AS cy, (greatest(x0, 400) - x0)::INTEGER AS cx, (least(y0 + height, 1000) - greatest(y0, 300))::INTEGER AS ch, (least(x0 + width, 1300) - greatest(x0, 400))::INTEGER AS cw
  FROM place WHERE least(y0 + height, 1000) > greatest(y0, 300) AND least(x0 + width, 1300) > greatest(x0, 400)""",
    _PLACED,
)
def mosaic_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mosaic.crops(placements(spark, sf_dir), (300, 400, 700, 900)).select("path", "cy", "cx", "ch", "cw")


@query(" SELECT CAST(round_even(x / 960 * 4 * 0.25::DOUBLE, 0) AS INTEGER) AS x, CAST(round_even(y / 960 * 4 * 0.25::DOUBLE, 0) AS INTEGER) AS y, greatest(round_even(size / 960 / 2 * 0.25::DOUBLE, 0)::INTEGER + 10, 14)::INTEGER AS radius, count(*) AS n FROM det WHERE role <> 'all' GROUP BY ALL")
def overlay_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circles of the particles whose photos are placed."""
    det = detections(spark, sf_dir).withColumns({"x_global": F.col("x") * 4, "y_global": F.col("y") * 4})
    placed = placements(spark, sf_dir).where(~F.col("path").contains("_all"))
    marks = mosaic.markers(det, 960.0, 0.25, placements=placed)
    return marks.groupBy("x", "y", "radius").agg(F.count("*").alias("n"))


_SLOTS = "CASE role WHEN 'N' THEN 1 WHEN 'S' THEN 2 WHEN 'E' THEN 3 ELSE 4 END"


@query(f", s AS (SELECT tile_row, tile_col, role, {_SLOTS} AS r FROM det WHERE role <> 'all' GROUP BY ALL) SELECT d.tile_row, d.tile_col, coalesce(max(n), 0)::INTEGER AS n, coalesce(max(dirs), '') AS dirs FROM det d LEFT JOIN (SELECT tile_row, tile_col, count(*) AS n, string_agg(role, ',' ORDER BY r) AS dirs FROM s GROUP BY 1, 2) USING (tile_row, tile_col) GROUP BY 1, 2")
def slot_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    tile = F.when(F.col("role") == "all", "loose.png").otherwise(F.concat("role", F.lit(".png")))
    found = detections(spark, sf_dir).withColumn("t", tile).groupBy("tile_row", "tile_col").agg(dedup.slot_list(F.col("t")).alias("s"))
    return found.select("tile_row", "tile_col", F.col("s.count").alias("n"), F.col("s.dirs").alias("dirs"))


@query(" SELECT CASE WHEN tile_col = 0 THEN 'placed' WHEN tile_col < 3 AND role = 'all' THEN 'light:v' || tile_row WHEN role = 'all' THEN 'light:wafer_shot_0_quad0_exp9.png' ELSE 'letters' END AS g, count(*) AS n FROM det GROUP BY 1")
def dedup_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is de-duplicated together; shots outside of submaps by themselves."""
    shot = F.lit("wafer_shot_0_quad0_exp9.png")
    tile = F.when(F.col("role") != "all", F.concat("role", F.lit(".png"))).when(F.col("tile_col") < 3, F.concat(F.lit("V"), "tile_row", F.lit("/"), shot)).otherwise(shot)
    return detections(spark, sf_dir).select(dedup.dedup_group(tile, F.col("tile_col") == 0).alias("g")).groupBy("g").agg(F.count("*").alias("n"))


@query(
    """, l AS (SELECT role || '_' || x::BIGINT || '_' || y::BIGINT AS k, event_type AS label, id, x::BIGINT AS x, y::BIGINT AS y FROM det WHERE id % 5 = 0 AND role <> 'all'),
  a AS (SELECT unnest(['NSEW', 'N', 'S', 'E', 'W', 'particles_only', 'particles_only_2of4', 'particles_only_3of4', 'particles_only_4of4']) || '_' || x || '_' || y AS key, label, id FROM l)
  SELECT key, arg_max(label, id) AS label FROM a GROUP BY 1"""
)
def label_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = detections(spark, sf_dir).where("id % 5 = 0 AND role <> 'all'").select(F.concat_ws("_", "role", F.col("x").cast("long"), F.col("y").cast("long")).alias("key"), F.col("event_type").alias("label"), F.col("id").alias("seq"))
    return review.label_map(labels)


@query(
    """, d AS (SELECT * FROM det WHERE id % 5 <> 0), l AS (SELECT * FROM det WHERE id % 5 = 0),
  n AS (SELECT d.id, l.id AS label, (d.x - l.x) ** 2 + (d.y - l.y) ** 2 AS d2, greatest(24.0::DOUBLE, 0.0001::DOUBLE * greatest(d.size, l.size)) AS r FROM d JOIN l ON d.role = l.role AND l.x BETWEEN d.x - 60 AND d.x + 60 AND l.y BETWEEN d.y - 60 AND d.y + 60),
  b AS (SELECT * FROM n WHERE d2 <= (SELECT greatest(24.0::DOUBLE, 0.0001::DOUBLE * max(size)) FROM det) ** 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, label) = 1)
  SELECT d.id, CASE WHEN b.d2 <= r * r THEN 'label' || b.label ELSE 'own' || d.id END AS key FROM d LEFT JOIN b ON d.id = b.id"""
)
def snapped_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detection takes the key of its nearest label, if that one is within the limit."""
    det = detections(spark, sf_dir)
    rows = det.where("id % 5 <> 0").select("id", "x", "y", "size", "role", F.concat(F.lit("own"), "id").alias("key"))
    labels = det.where("id % 5 = 0").select("id", "x", "y", "size", "role", F.concat(F.lit("label"), "id").alias("key"))
    return review.snap_to_labels(rows, labels, 24.0, 0.0001, ["role"]).select("id", "key")


@query(" SELECT id FROM det WHERE tile_col <> 1 AND tile_col <> 2")
def exposure_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without those that are marked as another exposure, in several spellings; null keeps."""
    flag = F.when(F.col("tile_col") == 1, "False").when(F.col("tile_col") == 2, "0").when(F.col("tile_col") == 3, "true")
    return review.drop_partners(detections(spark, sf_dir).withColumn("exposure_keep", flag)).select("id")


_STEPS = "s AS (SELECT n, (n % 20 + 1) / 2.0::DOUBLE AS fov, n % 7 + 1 AS c, n // 7 % 5 + 1 AS r FROM range(140) t(n))"


@query(
    """ SELECT n AS id, round_even(fov * 0.9::DOUBLE * 100, 0) / 100 AS step, CASE WHEN 60 <= fov THEN 1 ELSE greatest(ceil((60 - fov) / 3.5 - 1e-9)::INTEGER + 1, 1) END::INTEGER AS stops,
  (c * r)::INTEGER AS scan_stops, ceil(500 + 4 * (50 + fov * 100 + 500) + 3 * 50)::INTEGER AS dwell_ms, greatest(5000, fov * 1000 + 2000)::INTEGER AS timeout_ms,
  CASE WHEN c > 1 THEN -(c - 1) * 1.5 ELSE 0 END::DOUBLE AS back_x, CASE WHEN r > 1 THEN (r - 1) * 1.5 ELSE 0 END::DOUBLE AS back_y FROM s""",
    _STEPS,
)
def stage_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps, stops, dwell times, time limits and ways back for many fields of view."""
    n = F.col("id")
    rows = spark.range(140).select("id", ((n % 20 + 1) / 2.0).alias("fov"), (n % 7 + 1).cast("int").alias("c"), (F.floor(n / 7) % 5 + 1).cast("int").alias("r"))
    back = F.map_from_entries(capture.return_moves(F.col("r"), F.col("c"), 1.5))
    plan = capture.pause_plan(capture.shutter_ms(F.col("fov") * 100, F.lit("NSEW")), F.lit("NSEW"))
    return rows.select(
        "id",
        geometry.stage_step(F.col("fov")).alias("step"),
        geometry.stop_count(F.lit(60.0), F.col("fov"), F.lit(3.5)).cast("int").alias("stops"),
        capture.scan_summary(F.lit(1.5), F.col("c"), F.col("r"))["stops"].cast("int").alias("scan_stops"),
        plan["dwell_ms"].cast("int").alias("dwell_ms"),
        capture.grab_timeout_ms(F.col("fov") * 1e6).alias("timeout_ms"),
        F.coalesce(back["X"], F.lit(0.0)).alias("back_x"),
        F.coalesce(back["Y"], F.lit(0.0)).alias("back_y"),
    )


@query(
    """, t AS (SELECT id, CASE id % 6 WHEN 0 THEN 'v3/wafer_shot_0_quad' || id % 4 || '_exp7.png' WHEN 1 THEN 'a/N.TIF' WHEN 2 THEN 'combi_2of4.png' WHEN 3 THEN '(' || tile_row || ',' || tile_col || ').png' WHEN 4 THEN 'particles_only_3of4.bmp' ELSE 'b/uniform.jpg' END AS t, id % 4 AS q, tile_row, tile_col FROM det)
  SELECT id, CASE id % 6 WHEN 0 THEN 'QUAD' || q WHEN 1 THEN 'N' WHEN 2 THEN 'COMBI' WHEN 4 THEN 'PARTICLES_ONLY_3OF4' ELSE '' END AS slot, CASE id % 6 WHEN 0 THEN substr('NESW', (q + 1)::INTEGER, 1) ELSE '' END AS quadrant,
  CASE id % 6 WHEN 0 THEN 'v3' ELSE '' END AS submap, id % 6 = 3 AS grid, id % 6 = 2 AS combined, id % 6 IN (1, 4) AS letters, id % 6 = 5 AS uniform,
  CASE id % 6 WHEN 0 THEN t WHEN 1 THEN 'N.TIF' WHEN 5 THEN 'uniform.jpg' ELSE t END AS tile FROM t"""
)
def name_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names of all kinds say."""
    n = F.col("id") % 6
    shot = F.concat(F.lit("v3/wafer_shot_0_quad"), F.col("id") % 4, F.lit("_exp7.png"))
    grid = F.format_string("(%d,%d).png", "tile_row", "tile_col")
    tile = F.when(n == 0, shot).when(n == 1, "a/N.TIF").when(n == 2, "combi_2of4.png").when(n == 3, grid).when(n == 4, "particles_only_3of4.bmp").otherwise("b/uniform.jpg")
    t = detections(spark, sf_dir).select("id", tile.alias("t"))
    text = lambda c: F.coalesce(c, F.lit(""))
    return t.select("id", text(names.slot("t")).alias("slot"), text(names.quadrant("t")).alias("quadrant"), names.submap("t").alias("submap"), names.is_grid("t").alias("grid"), names.is_combined("t").alias("combined"), names.is_direction_family("t").alias("letters"), names.is_uniform("t").alias("uniform"), names.lighting_id("t").alias("tile"))
