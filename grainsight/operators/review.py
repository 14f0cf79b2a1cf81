"""The review queue: tables of detections meet what reviewers have labelled already."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from .dedup import assign_slot_seeds, slot_list
from .spatial import limited_pairs, nearest_join, pair_limit, range_join, search_radius

MIN_SIZE_NM = 10_000.0
#: Fixed value: the queue's own merge radius, 24 pixels of 960 nm whatever the configured pixel is; callers may give another.
QUEUE_RADIUS_NM = 24.0 * 960.0


def minimum_size(rows: DataFrame, min_nm: float = MIN_SIZE_NM, size: str = "size") -> DataFrame:
    return rows.where(F.col(size) >= min_nm)


def drop_partners(rows: DataFrame) -> DataFrame:
    """Without rows marked as another exposure of a kept one; null keeps."""
    if "exposure_keep" not in rows.columns:
        return rows
    flag = F.lower(F.col("exposure_keep").cast("string"))
    return rows.where(F.coalesce(~flag.isin("false", "0"), F.lit(True)))


def last_wins(rows: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """One row a key: the last one, in the place of the first (`seq` becomes that place)."""
    w = Window.partitionBy(key)
    ranked = rows.withColumns({"_r": F.row_number().over(w.orderBy(F.desc(seq))), "_first": F.min(seq).over(w)})
    return ranked.where("_r = 1").withColumn(seq, F.col("_first")).drop("_r", "_first")


def merge_tables(tables: Sequence[DataFrame], key: str = "key") -> DataFrame:
    """Union of tables, columns by name; later tables win. Rows need a column seq that orders them inside a table."""
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn("_seq", F.struct(F.lit(i).alias("table"), F.col("seq").alias("row"))).drop("seq")
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return last_wins(out, key, "_seq").withColumnRenamed("_seq", "seq")


def expand_keys(keys: DataFrame, key: str = "key") -> DataFrame:
    """(key): all aliases of labelled keys."""
    return keys.select(F.explode(names.key_aliases(F.col(key))).alias("key")).distinct()


def unlabelled(rows: DataFrame, labelled: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose key none of the labelled keys stands for: an anti-join, which Spark broadcasts only if it is small."""
    return rows.join(expand_keys(labelled, key), key, "left_anti")


def label_map(labels: DataFrame, key: str = "key", label: str = "label", seq: str = "seq") -> DataFrame:
    """(key, label): every alias of a labelled key; the last label wins."""
    named = labels.where(F.col(label).isNotNull() & (F.col(label) != ""))
    keys = F.array(F.col(key))
    if {"source_tile", "x_global", "y_global"} <= set(labels.columns):
        family = names.key_family(F.col("source_tile")) != ""
        keys = F.when(family, F.array(F.col(key), names.detection_key(F.col("source_tile"), F.col("x_global"), F.col("y_global")))).otherwise(keys)
    each = named.select(F.explode(keys).alias("k"), F.col(label).alias("label"), F.col(seq).alias("seq"))
    return each.select(F.explode(names.key_aliases(F.col("k"))).alias("key"), "label", "seq").groupBy("key").agg(F.max_by("label", F.struct("seq", "label")).alias("label"))


def snap_to_labels(rows: DataFrame, labels: DataFrame, radius: float = QUEUE_RADIUS_NM, fraction: float = 0.4, on: Sequence[str] = (), key: str = "key") -> DataFrame:
    """`rows` with the key of the nearest label, where that one label is within the pair limit.

    Both have id, x, y, size and `on` (family and submap); labels have `key`.
    """
    found = nearest_join(rows.select("id", "x", "y", "size", *on), labels.select("id", "x", "y", "size", F.col(key).alias("label_key"), *on), search_radius(radius, fraction, rows, labels), on)
    taken = rows.join(found, "id", "left")
    limit = pair_limit(radius, fraction, F.col("size"), F.col("r.size"))
    near = F.col("d2") <= limit * limit
    return taken.withColumn(key, F.when(near, F.col("r.label_key")).otherwise(F.col(key))).drop("r", "d2").select(*rows.columns)


def exposure_set(tile: Column) -> Column:
    """v<number> of a stem v<number>_2of4, in lower case; empty elsewhere."""
    return F.lower(F.regexp_extract(names.stem(tile), r"(?i)^(v[0-9]+)_2of4$", 1))


def mutual_nearest(left: DataFrame, right: DataFrame, radius: float, fraction: float = 0.4) -> DataFrame:
    """(left_id, right_id): rows that are each other's nearest and within the pair limit."""
    reach = search_radius(radius, fraction, left, right)
    slim = lambda t: t.select("id", "x", "y", "size")
    there = nearest_join(slim(left), slim(right), reach).select(F.col("id").alias("left_id"), F.col("r").alias("r"), "d2")
    back = nearest_join(slim(right), slim(left), reach).select(F.col("id").alias("right_id"), F.col("r.id").alias("left_id"))
    both = there.withColumn("right_id", F.col("r.id")).join(back, ["left_id", "right_id"])
    sizes = slim(left).select(F.col("id").alias("left_id"), F.col("size").alias("left_size"))
    limit = pair_limit(radius, fraction, F.col("left_size"), F.col("r.size"))
    return both.join(sizes, "left_id").where(F.col("d2") <= limit * limit).select("left_id", "right_id")


def share_exposure_keys(rows: DataFrame, pairs: Sequence[tuple[str, str]], radius: float, fraction: float = 0.4) -> DataFrame:
    """The second exposure's rows take the key of their partner in the first and are marked as not to keep.

    `pairs`: submaps that show the same place at two exposures, as a folder's settings name them.
    """
    if not pairs:
        return rows
    out = rows
    for name, default in (("exposure_keep", F.lit(True)), ("exposure_with", F.lit(""))):
        out = out if name in out.columns else out.withColumn(name, default)
    columns = out.columns
    tile = exposure_set(F.col("source_tile"))
    for a, b in pairs:
        left, right = out.where(tile == a.lower()), out.where(tile == b.lower())
        found = mutual_nearest(left, right, radius, fraction)
        keys = found.join(left.select(F.col("id").alias("left_id"), F.col("key").alias("_key")), "left_id")
        out = out.join(keys.select(F.col("right_id").alias("id"), "_key"), "id", "left").join(found.select(F.col("left_id").alias("id"), F.lit(b).alias("_with")), "id", "left")
        second = F.col("_key").isNotNull()
        changed = {"key": F.coalesce("_key", "key"), "exposure_keep": F.when(second, F.lit(False)).otherwise(F.col("exposure_keep")), "exposure_with": F.when(second, F.lit(a)).otherwise(F.coalesce("_with", "exposure_with"))}
        out = out.withColumns(changed).select(*columns)
    return out


def _split_dirs(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.upper(F.trim(p)))
    return F.filter(parts, lambda p: ~p.isin("", "NAN"))


def collapse_family(rows: DataFrame, labelled: DataFrame, radius: float = QUEUE_RADIUS_NM, fraction: float = 0.4, on: Sequence[str] = ("group",)) -> DataFrame:
    """One row a cluster of a family: the seed's, with the largest size, the directions kept on the cluster and a key that is labelled already if there is one.

    Rows have id, x, y, size, confidence, source_tile, key, nsew_dirs and `on`.
    """
    seeds = assign_slot_seeds(rows, radius, fraction, on)
    members = rows.join(seeds, "id")
    of = members.groupBy("seed").agg(F.max("size").alias("_size"), slot_list(F.col("source_tile")).alias("_slots"))
    clusters = rows.join(of.withColumnRenamed("seed", "id"), "id").withColumns({"size": F.col("_size"), "_stems": _split_dirs(F.col("_slots.dirs"))}).drop("_size", "_slots")
    scan = rows.select("id", "x", "y", "size", "key", "nsew_dirs", names.slot("source_tile").alias("slot"), *on).where("slot IS NOT NULL")
    near = range_join(clusters.select("id", "x", "y", "size", "_stems", names.slot("source_tile").alias("own"), *on), scan, search_radius(radius, fraction, clusters, scan), on)
    limit = pair_limit(radius, fraction, F.col("l.size"), F.col("r.size"))
    near = near.where((F.col("d2") <= limit * limit) & F.array_contains("l._stems", F.col("r.slot")))
    # the nearest row of each slot adds the directions that it has
    closest = near.groupBy(F.col("l.id").alias("id"), F.col("r.slot").alias("slot")).agg(F.min_by("r.nsew_dirs", F.struct("d2", F.col("r.id"))).alias("dirs"))
    more = closest.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(_split_dirs(F.col("dirs"))))).alias("_more"))
    known = near.join(expand_keys(labelled).select(F.col("key").alias("_k"), F.lit(True).alias("_labelled")), F.col("r.key") == F.col("_k"), "left").where(~F.coalesce(F.col("r.key"), F.lit("")).isin("", "nan"))
    first = F.min_by("r.key", F.when(F.col("_labelled"), F.col("r.id")))
    same = F.min_by("r.key", F.when(F.col("r.slot") == F.col("l.own"), F.struct("d2", F.col("r.id"))))
    keys = known.groupBy(F.col("l.id").alias("id")).agg(first.alias("_first"), same.alias("_same"))
    out = clusters.join(more, "id", "left").join(keys, "id", "left")
    stems = F.array_union("_stems", F.coalesce("_more", F.array().cast("array<string>")))
    ranked = F.transform(F.array_sort(F.transform(stems, lambda s: F.struct(names.slot_rank(s).alias("r"), s.alias("s")))), lambda x: x["s"])
    key = F.coalesce("_first", "_same", names.detection_key(F.col("source_tile"), F.col("x"), F.col("y")))
    return out.withColumns({"nsew_dirs": F.array_join(ranked, ","), "nsew_count": F.size(ranked), "key": key}).select(*[c for c in rows.columns if c != "nsew_count"], "nsew_count")


def collapse(rows: DataFrame, labelled: DataFrame, radius: float = QUEUE_RADIUS_NM, fraction: float = 0.4) -> DataFrame:
    """Families collapsed, each submap's shots by themselves and all letter photos together; other rows as they are."""
    tile = F.col("source_tile")
    shots = names.lighting_role(tile).isNotNull() | (names.is_combined(tile) & (names.submap(tile) != ""))
    group = F.when(shots, F.concat(F.lit("light:"), names.submap(tile))).when(names.is_direction_family(tile), "letters")
    tagged = rows.withColumn("group", group)
    family = collapse_family(tagged.where("group IS NOT NULL"), labelled, radius, fraction)
    return tagged.where("group IS NULL").unionByName(family, allowMissingColumns=True).drop("group")


def review_queue(tables: Sequence[DataFrame], labelled: DataFrame, labels: DataFrame | None = None, min_nm: float = MIN_SIZE_NM, radius: float = QUEUE_RADIUS_NM, fraction: float = 0.4) -> DataFrame:
    """What is left to review: partners dropped, last record wins, families collapsed, keys snapped to labels, small and labelled rows gone."""
    rows = collapse(merge_tables([drop_partners(t) for t in tables]), labelled, radius, fraction)
    if labels is not None:
        on = ["family", "set"]
        tag = lambda t: t.withColumns({"family": names.key_family(F.col("source_tile")), "set": F.when(names.lighting_role("source_tile").isNotNull(), names.submap("source_tile")).otherwise("")})
        tagged = tag(rows)
        rows = snap_to_labels(tagged, tag(labels).where("family <> ''"), radius, fraction, on).drop(*on)
    return unlabelled(minimum_size(rows, min_nm), labelled)


def pairs_of(rows: DataFrame, radius: float, fraction: float) -> DataFrame:
    """(a, b, d2), a < b: the pairs that may merge."""
    return limited_pairs(rows, radius, fraction).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), "d2").where("a < b")
