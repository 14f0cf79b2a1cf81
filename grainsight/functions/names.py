"""What a tile's name says, as Column expressions.

Names may carry folders with either slash; the *stem* is the last part without
its suffix.  All expressions stay in the JVM and take a column of names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letter order of stacks and of sorting; of the ring light's quadrants; lighting roles.
DIRECTIONS = ("N", "S", "E", "W")
QUADRANTS = ("N", "E", "S", "W")
LIGHTING_ROLES = ("quad0", "quad1", "quad2", "quad3", "all")
PARTICLES_ONLY = ("particles_only", "particles_only_2of4", "particles_only_3of4", "particles_only_4of4")

#: (row,col) names by default; groups run, row, col, mag, x and y are understood.
GRID_PATTERN = r"\((?P<row>\d+),(?P<col>\d+)\)"


def path(name: Column | str) -> Column:
    return F.replace(F.col(name) if isinstance(name, str) else name, F.lit("\\"), F.lit("/"))


def base(name: Column | str) -> Column:
    """Last part of a path."""
    return F.substring_index(path(name), "/", -1)


def stem(name: Column | str) -> Column:
    """Last part without its suffix; a leading dot is no suffix."""
    return F.regexp_replace(base(name), r"(?<=.)\.[^.]*$", "")


def parent(name: Column | str) -> Column:
    """Name of the folder that the last part stands in; empty at the top."""
    return F.regexp_extract(path(name), r"([^/]+)/+[^/]*$", 1)


def _found(column: Column, pattern: str, group: int = 1) -> Column:
    """A regular expression's group, null instead of empty."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def direction(name: Column | str) -> Column:
    """N, S, E or W where the stem is that letter in either case."""
    return F.when(F.upper(stem(name)).isin(*DIRECTIONS), F.upper(stem(name)))


def is_particles_only(name: Column | str) -> Column:
    return F.lower(stem(name)).rlike(r"^particles_only(_.*)?$")


def is_direction_family(name: Column | str) -> Column:
    return direction(name).isNotNull() | is_particles_only(name)


def is_grid(name: Column | str) -> Column:
    return stem(name).rlike(r"^\([0-9]+,[0-9]+\)$")


def is_combined(name: Column | str) -> Column:
    return F.lower(stem(name)).rlike(r"^combi(_.*)?$")


def lighting_role(name: Column | str) -> Column:
    """quad0 to quad3 or all, of one shot of a submap."""
    return F.lower(_found(stem(name), r"(?i)^wafer_shot_[0-9]+_(quad[0-3]|all)_exp[0-9]+$"))


def quadrant(name: Column | str) -> Column:
    """The letter that a quadrant's number stands for."""
    n = _found(lighting_role(name), r"^quad([0-3])$")
    return F.get(F.array(*map(F.lit, QUADRANTS)), n.cast("int"))


def submap_as_written(name: Column | str) -> Column:
    """The folder v<number>, in the case it has; empty elsewhere."""
    return F.when(parent(name).rlike(r"(?i)^v[0-9]+$"), parent(name)).otherwise(F.lit(""))


def submap(name: Column | str) -> Column:
    return F.lower(submap_as_written(name))


def lighting_id(name: Column | str) -> Column:
    """Tile id: shots and combined images of a submap keep its folder."""
    kept = lighting_role(name).isNotNull() | is_combined(name)
    return F.when(kept & (submap(name) != ""), F.concat_ws("/", submap(name), base(name))).otherwise(base(name))


def relative_id(name: Column | str, root: str) -> Column:
    """Path below the input folder, or the last part outside of it."""
    top = root.rstrip("/") + "/"
    return F.when(path(name).startswith(top), F.substring(path(name), len(top) + 1, 1 << 30)).otherwise(base(name))


def combined_id(name: Column | str, root: str) -> Column:
    """Path below the input folder, or the whole path outside of it."""
    top = root.rstrip("/") + "/"
    return F.when(path(name).startswith(top), F.substring(path(name), len(top) + 1, 1 << 30)).otherwise(path(name))


def source_id(name: Column | str, root: str) -> Column:
    """Id of a photo: submap folder for its shots, relative path for grid names, else the last part."""
    shot = lighting_role(name).isNotNull() & (submap(name) != "")
    return F.when(shot, F.concat_ws("/", parent(name), base(name))).when(is_grid(name), relative_id(name, root)).otherwise(base(name))


def slot(name: Column | str) -> Column:
    """The slot of a cluster that a tile may fill once: COMBI, a letter, a role or a particles-only stem; null for others."""
    return F.coalesce(
        F.when(is_combined(name), F.lit("COMBI")),
        direction(name),
        F.upper(lighting_role(name)),
        F.when(is_particles_only(name), F.upper(stem(name))),
    )


def slot_rank(column: Column) -> Column:
    """N, S, E, W before all others."""
    at = F.array_position(F.array(*map(F.lit, DIRECTIONS)), column)
    return F.when(at > 0, at).otherwise(len(DIRECTIONS) + 1)


def positional(name: Column | str) -> Column:
    """struct(row, col, direction) of (row,col)_D.ext with an image's suffix; null elsewhere."""
    pattern = r"(?i)^\(([0-9]+),([0-9]+)\)_([NSEW])\.(?:png|tif|tiff|bmp|jpg|jpeg)$"
    part = lambda i: F.regexp_extract(base(name), pattern, i)
    return F.when(base(name).rlike(pattern), F.struct(part(1).cast("int").alias("row"), part(2).cast("int").alias("col"), F.upper(part(3)).alias("direction")))


def java_pattern(pattern: str) -> tuple[str, dict[str, int]]:
    """A pattern with Python's named groups, for Spark, and the number of each named group."""
    groups, number, i = {}, 0, 0
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 2
            continue
        if pattern[i] == "[":
            j = i + 1
            while j < len(pattern) and (pattern[j] != "]" or j == i + 1):
                j += 2 if pattern[j] == "\\" else 1
            i = j + 1
            continue
        if pattern[i] == "(" and (not pattern.startswith("(?", i) or pattern.startswith("(?P<", i)):
            number += 1
            if pattern.startswith("(?P<", i):
                groups[pattern[i + 4 : pattern.index(">", i)]] = number
        i += 1
    return "(?i)" + pattern.replace("(?P<", "(?<"), groups


def parsed(name: Column | str, pattern: str) -> Column:
    """struct(run, row, col, mag, x, y) read from a name; null where a blank pattern or no match, or none of row, col and x."""
    kinds = {"run": "int", "row": "int", "col": "int", "mag": "double", "x": "double", "y": "double"}
    if not pattern.strip():
        return F.lit(None).cast("struct<" + ",".join(f"{k}:{t}" for k, t in kinds.items()) + ">")
    java, groups = java_pattern(pattern)
    text = base(name)
    fields = [(_found(text, java, groups[k]).cast(t) if k in groups else F.lit(None).cast(t)).alias(k) for k, t in kinds.items()]
    found = F.struct(*fields)
    known = [_found(text, java, groups[k]).isNotNull() for k in ("row", "col", "x") if k in groups]
    some = known[0] if known else F.lit(False)
    for k in known[1:]:
        some = some | k
    return F.when(text.rlike(java) & some, found)


def placeable(at: Column) -> Column:
    """Whether a parsed name gives a place: x and y, or row and col."""
    return F.coalesce((at["x"].isNotNull() & at["y"].isNotNull()) | (at["row"].isNotNull() & at["col"].isNotNull()), F.lit(False))


def is_uniform(name: Column | str) -> Column:
    """The shot with all lights on; never a combined image."""
    return ~is_combined(name) & ((F.coalesce(lighting_role(name), F.lit("")) == "all") | F.lower(stem(name)).isin("all", "uniform"))


def key_family(name: Column | str, siblings: Column | None = None) -> Column:
    """light or nsew, whose keys a tile's detections take; siblings: the family of the folder, for combined images."""
    family = F.when(is_combined(name), siblings) if siblings is not None else F.lit(None).cast("string")
    return F.when(lighting_role(name).isNotNull() | (family == "light"), "light").when(is_direction_family(name) | (family == "nsew"), "nsew").otherwise("")


def detection_key(name: Column | str, x: Column, y: Column, siblings: Column | None = None) -> Column:
    """Key of a detection: family or stem and the rounded place in nm."""
    at = [F.rint(c).cast("long").cast("string") for c in (x, y)]
    family = key_family(name, siblings)
    light = F.concat_ws("_", F.nullif(submap(name), F.lit("")), F.lit("LIGHT"), *at)
    letters = F.concat_ws("_", F.nullif(submap_as_written(name), F.lit("")), F.lit("NSEW"), *at)
    return F.when(family == "light", light).when(family == "nsew", letters).otherwise(F.concat_ws("_", stem(name), *at))


def row_key(name: Column | str, key: Column, x: Column, y: Column, siblings: Column | None = None) -> Column:
    """An existing key, unless it is blank or the tile's family has keys of its own."""
    own = lighting_role(name).isNotNull() | is_direction_family(name)
    keep = ~own & key.isNotNull() & ~key.isin("", "nan")
    return F.when(keep, key).otherwise(detection_key(name, x, y, siblings))


def key_aliases(key: Column) -> Column:
    """All keys that stand for the same detection, the key's own family spelled out."""
    roles = ("LIGHT", *LIGHTING_ROLES)
    set_light = r"(?i)^(v[0-9]+)_(?:LIGHT|quad[0-3]|all)_(-?[0-9]+)_(-?[0-9]+)$"
    light = r"(?i)^(?:LIGHT|quad[0-3]|all)_(-?[0-9]+)_(-?[0-9]+)$"
    set_letters = r"(?i)^(v[0-9]+)_(?:NSEW|2of4)_(-?[0-9]+)_(-?[0-9]+)$"
    letters = r"(?i)^(?:NSEW|N|S|E|W|particles_only(?:_[0-9]+of4)?)_(-?[0-9]+)_(-?[0-9]+)$"

    def spelled(pattern: str, names: tuple[str, ...], in_set: bool) -> Column:
        part = [F.regexp_extract(key, pattern, i) for i in (1, 2, 3)[: 2 + in_set]]
        prefix, rest = (part[:1], part[1:]) if in_set else ([], part)
        return F.array(*(F.concat_ws("_", *prefix, F.lit(n), *rest) for n in names))

    return (
        F.when(key.rlike(set_light), spelled(set_light, roles, True))
        .when(key.rlike(light), spelled(light, roles, False))
        .when(key.rlike(set_letters), spelled(set_letters, ("NSEW", "2of4", *DIRECTIONS), True))
        .when(key.rlike(letters), spelled(letters, ("NSEW", *DIRECTIONS, *PARTICLES_ONLY), False))
        .otherwise(F.array(key))
    )
