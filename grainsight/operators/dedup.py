"""Greedy spatial de-duplication.

The greedy rule: in order of priority, a detection that no better one has taken
becomes a seed and takes all free detections within their pair limit.  Which pairs
may merge doesn't depend on the order, so the seeds are the lexicographically first
maximal independent set.  With one limit for all they are found block by block of
the plane, in passes.  Where limits grow with size they are found in rounds of
joins: whoever has no better undecided neighbour is a seed, and its neighbours are
lost; after `ROUNDS` of them what is still open, chains of ever better detections,
is decided component by component.  Priority is a total order: confidence descending, then tile, y, x and id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, StructField, StructType

from ..functions import names
from ..kernels import greedy, slots
from .checkpoint import cut
from .graph import connected_components
from .spatial import limited_pairs, range_join

PRIORITY = ("confidence", "source_tile", "y", "x", "id")
#: Rounds of joins before components are decided one by one, and passes before blocks grow.
ROUNDS = 8
#: Blocks are so many limits wide, less where the fullest has more rows than this, and lie at these shifts in turn.
BLOCK, MOST = 32, 1_000_000
#: Blocks are dealt to twice as many parts as there are of them, but not to parts of fewer rows than this; to Spark's own number at least.
PART = 10_000
SHIFTS = ((0.0, 0.0), (0.5, 0.5), (0.5, 0.0), (0.0, 0.5))


def priority(prefix: str = "") -> F.Column:
    """A struct that sorts better detections first."""
    p = lambda c: F.col(prefix + c)
    return F.struct((-p("confidence")).alias("c"), p("source_tile").alias("t"), p("y").alias("y"), p("x").alias("x"), p("id").alias("i"))


def slot_list(tiles: F.Column) -> F.Column:
    """struct(count, dirs) over a group: its distinct slots, N, S, E, W first, joined by commas."""
    slot = names.slot(tiles)
    ranked = F.array_sort(F.collect_set(F.when(slot.isNotNull(), F.struct(names.slot_rank(slot).alias("r"), slot.alias("s")))))
    found = F.transform(ranked, lambda x: x["s"])
    return F.struct(F.size(found).alias("count"), F.array_join(found, ",").alias("dirs"))


def _lost(edges: pd.DataFrame) -> pd.DataFrame:
    """Those of a component that a seed takes; edges go from the better to the worse and `p` is the better one's place in the order."""
    lost, keys = set(), [tuple(p.values()) if isinstance(p, dict) else tuple(p) for p in edges["p"]]
    for i in sorted(range(len(keys)), key=keys.__getitem__):
        if edges["hi"].iat[i] not in lost:
            lost.add(edges["lo"].iat[i])
    return pd.DataFrame({"id": pd.Series(sorted(lost), dtype=edges["lo"].dtype)})


def assign_seeds(rows: DataFrame, radius: float, fraction: float = 0.0, on: Sequence[str] = (), rounds: int = ROUNDS) -> DataFrame:
    """(id, seed): the seed that takes each detection, itself for seeds; columns id, x, y, size, confidence, source_tile and `on`."""
    return _seeds_by_pairs(rows, radius, fraction, on, rounds) if fraction > 0 else _seeds_in_blocks(rows, radius, on, rounds)


def _seeds_in_blocks(rows: DataFrame, radius: float, on: Sequence[str], rounds: int) -> DataFrame:
    """`assign_seeds` with one limit for all, see `kernels.greedy`; no list of pairs."""
    slim, there, keys = _slim(rows, radius, on)
    rest = ["x", "y", "confidence", "source_tile", *keys]
    found = _in_blocks(slim.where(there), radius, keys, rest, [priority()[c] for c in "ctyxi"], rounds, 4, _decided)
    of = lambda *states: found.where(F.col("state").isin(*states))
    unsure = of(greedy.UNSURE).select("id", "rest.x", "rest.y", *(f"rest.{k}" for k in keys))
    seeds = of(greedy.SEED).select("id", "rest.*").withColumn("p", priority()).select("id", "x", "y", "p", *keys)
    owners = range_join(unsure, seeds, radius, keys).groupBy(F.col("l.id").alias("id")).agg(F.min_by("r.id", "r.p").alias("seed"))
    sure = of(greedy.SEED, greedy.LOST).select("id", F.when(F.col("state") == greedy.SEED, F.col("id")).otherwise(F.col("seed")).cast(dict(rows.dtypes)["id"]).alias("seed"))
    return sure.unionByName(owners).unionByName(slim.where(~there).select("id", F.col("id").alias("seed")))


def _slim(rows: DataFrame, radius: float, on: Sequence[str]) -> tuple[DataFrame, F.Column, list[str]]:
    """What blocks need of the rows, which rows meet others at all, and the names of the columns `on`."""
    if radius < 0:
        raise ValueError("a radius can't be negative")
    keys = [f"_k{i}" for i in range(len(on))]
    slim = rows.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "confidence", "source_tile", *(F.col(k).alias(n) for k, n in zip(on, keys, strict=True)))
    # rows without a place or a group meet nothing
    there = reduce(lambda a, b: a & b, [F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) for c in ("x", "y")] + [F.col(k).isNotNull() for k in keys])
    return slim, there, keys


def _in_blocks(open_: DataFrame, radius: float, keys: list[str], rest: list[str | F.Column], order: list[F.Column], rounds: int, least: int, decided: Callable) -> DataFrame:
    """(id, seed, state, rest) of all passes: each decides what blocks of the plane show, and open rows are asked again.

    Blocks of the next pass lie elsewhere.  After `rounds` passes they grow, so that
    long chains of ever better detections end.  `least`: the width of blocks, in limits,
    below which they aren't halved.  `decided(wide, radius, ends)` makes what runs over
    the batches; no row lies outside of `ends`.
    """
    unit = float(radius) if radius > 0 else 1.0
    at = lambda c, wide, shift: F.floor(F.col(c) / F.lit(wide) - F.lit(shift)).cast("long")
    wide = BLOCK * unit
    counts = open_.groupBy(*keys, at("x", wide, 0.0), at("y", wide, 0.0)).agg(F.count("*").alias("n"), *(f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))))
    blocks, fullest, left, *ends = counts.agg(F.count("*"), F.max("n"), F.sum("n"), F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).head()
    fullest, left = fullest or 0, left or 0
    while fullest > MOST and wide > least * unit:
        wide, fullest, blocks = wide / 2, fullest / 4, blocks * 4
    least_parts = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    where = [*keys, "_bx", "_by"]
    slim = open_.select("id", F.struct(*rest).alias("rest")).schema
    schema = StructType([StructField("id", slim["id"].dataType), StructField("seed", slim["id"].dataType), StructField("state", ByteType()), StructField("rest", slim["rest"].dataType)])
    passes, done = [], 0
    while True:
        wide *= 2 if done >= rounds else 1
        sx, sy = SHIFTS[done % len(SHIFTS)]
        # so many that few full blocks don't meet in one part while others have none
        parts = max(least_parts, min(2 * blocks, left // PART))
        dealt = open_.withColumns({"_bx": at("x", wide, sx), "_by": at("y", wide, sy)}).repartition(parts, F.xxhash64(*where, F.lit(0)))
        dealt = dealt.sortWithinPartitions(*where, *order)
        corner = [((F.col(b) + F.lit(s)) * F.lit(wide)).alias(o) for b, s, o in (("_bx", sx, "ox"), ("_by", sy, "oy"))]
        asked = dealt.select("x", "y", *corner, "id", F.struct(*rest).alias("rest"), *where)
        passes.append(cut(asked.mapInArrow(decided(wide, float(radius), tuple(ends)), schema)))
        open_, rest = passes[-1].where(F.col("state") == greedy.OPEN).select("id", "rest.*"), slim["rest"].dataType.names
        done += 1
        left = open_.count()
        if not left:
            return reduce(DataFrame.unionByName, passes)


def _decided(wide: float, radius: float, ends: tuple[float, ...]):
    rule = lambda block, x, y, ox, oy, rest: greedy.decide(block, x, y, ox, oy, wide, radius)
    return lambda batches: greedy.decided(batches, rule, ["id", "seed", "state", "rest"])


def _seeds_by_pairs(rows: DataFrame, radius: float, fraction: float, on: Sequence[str], rounds: int) -> DataFrame:
    """`assign_seeds` from a list of all pairs, where limits grow with size."""
    slim = rows.select("id", "x", "y", "size", "confidence", "source_tile", *on)
    pairs = limited_pairs(slim.select("id", "x", "y", "size", *on), radius, fraction, on)
    ranks = slim.select("id", priority().alias("p"))
    edges = pairs.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).where("a < b")
    edges = edges.join(ranks.select(F.col("id").alias("a"), F.col("p").alias("pa")), "a").join(ranks.select(F.col("id").alias("b"), F.col("p").alias("pb")), "b")
    first = F.col("pa") < F.col("pb")
    edges = cut(edges.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hi"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("lo"), F.least("pa", "pb").alias("p")))
    open_, decided = edges.select("hi", "lo"), []
    for _ in range(rounds):
        if open_.isEmpty():
            break
        free = open_.select(F.col("hi").alias("id")).distinct().join(open_.select(F.col("lo").alias("id")).distinct(), "id", "left_anti")
        lost = open_.join(free.withColumnRenamed("id", "hi"), "hi", "left_semi").select(F.col("lo").alias("id")).distinct()
        lost = cut(lost)
        decided.append(lost)
        # seeds leave with all their edges, and so do the lost
        gone = lost.select(F.col("id").alias("lo"))
        left = open_.join(gone, "lo", "left_anti").join(gone.withColumnRenamed("lo", "hi"), "hi", "left_anti")
        open_ = cut(left.join(free.withColumnRenamed("id", "hi"), "hi", "left_anti"))
    if not open_.isEmpty():
        roots = connected_components(open_, "hi", "lo").withColumnsRenamed({"node": "hi"})
        left = open_.join(roots, "hi").join(edges.select("hi", "lo", "p"), ["hi", "lo"])
        decided.append(cut(left.select("root", "hi", "lo", "p").groupBy("root").applyInPandas(_lost, f"id {dict(rows.dtypes)['id']}")))
    if not decided:
        return slim.select("id", F.col("id").alias("seed"))
    lost = decided[0]
    for more in decided[1:]:
        lost = lost.unionByName(more)
    owners = edges.join(lost.select(F.col("id").alias("lo")), "lo", "left_semi").join(lost.select(F.col("id").alias("hi")), "hi", "left_anti")
    owners = owners.groupBy(F.col("lo").alias("id")).agg(F.min_by("hi", "p").alias("seed"))
    return slim.select("id").join(owners, "id", "left").select("id", F.coalesce("seed", "id").alias("seed"))


def merged(rows: DataFrame, seeds: DataFrame, aggregation: str = "max") -> DataFrame:
    """A row for each seed: its own columns, with size, nsew_count and nsew_dirs of its members; renumbered in order of priority."""
    size = F.max("size") if aggregation == "max" else F.avg("size")
    of = rows.select("id", "size", "source_tile").join(seeds, "id").groupBy("seed").agg(size.alias("_size"), slot_list(F.col("source_tile")).alias("_slots"))
    kept = rows.join(of.withColumnRenamed("seed", "id"), "id")
    kept = kept.withColumns({"size": F.col("_size"), "nsew_count": F.col("_slots.count"), "nsew_dirs": F.col("_slots.dirs")}).drop("_size", "_slots")
    return renumber(kept)


def renumber(rows: DataFrame) -> DataFrame:
    """Ids 1 to n in order of priority: ranges of the order are counted first, so no task holds all rows."""
    spark = rows.sparkSession
    ordered = rows.withColumn("_p", priority()).repartitionByRange("_p").sortWithinPartitions("_p").withColumn("_part", F.spark_partition_id())
    ordered = cut(ordered)
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n")).collect()
    start, starts = 0, []
    for r in sorted(sizes, key=lambda r: r["_part"]):
        starts.append((r["_part"], start))
        start += r["_n"]
    offsets = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "_part int, _start long"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy("_p"))
    return ordered.join(offsets, "_part").withColumn("id", (F.col("_start") + number).cast("long")).drop("_p", "_part", "_start")


def deduplicate(rows: DataFrame, radius: float, aggregation: str = "max", fraction: float = 0.0, on: Sequence[str] = ()) -> DataFrame:
    """Greedy star clusters; a radius of 0 or less without a size fraction keeps every row."""
    if radius <= 0 and fraction <= 0:
        return merged(rows, rows.select("id", F.col("id").alias("seed")), aggregation)
    return merged(rows, assign_seeds(rows, radius, fraction, on), aggregation)


def _slot_clusters(radius: float, fraction: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Greedy within one component: nearest first, at most one member a slot, rows without a slot are never taken.

        A grid of cells as wide as the largest limit leaves each seed a few rows to look at.
        """
        g = group.sort_values(["confidence", "source_tile", "y", "x", "id"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        x, y, size = (g[c].to_numpy(float) for c in ("x", "y", "size"))
        slot = g["slot"].tolist()
        seed_of = np.full(len(g), -1)
        width = max(radius, fraction * float(size.max()) if fraction > 0 else 0.0, 1e-9)
        cells: dict[tuple[int, int], list[int]] = {}
        at = list(zip(np.floor(x / width).astype(int).tolist(), np.floor(y / width).astype(int).tolist(), strict=True))
        for i, c in enumerate(at):
            cells.setdefault(c, []).append(i)
        for i, (cx, cy) in enumerate(at):
            if seed_of[i] >= 0:
                continue
            seed_of[i] = i
            near = np.array([j for a in (-1, 0, 1) for b in (-1, 0, 1) for j in cells.get((cx + a, cy + b), ()) if seed_of[j] < 0 and slot[j] is not None], int)
            d = np.hypot(x[near] - x[i], y[near] - y[i])
            limit = np.maximum(radius, fraction * np.maximum(size[near], size[i])) if fraction > 0 else np.full(len(near), radius)
            taken = {slot[i]} if slot[i] is not None else set()
            for k in np.lexsort((near, d)):
                j = near[k]
                if d[k] <= limit[k] and slot[j] not in taken:
                    taken.add(slot[j])
                    seed_of[j] = i
        return pd.DataFrame({"id": g["id"], "seed": g["id"].to_numpy()[seed_of]})

    return run


def assign_slot_seeds(rows: DataFrame, radius: float, fraction: float = 0.4, on: Sequence[str] = (), rounds: int = ROUNDS) -> DataFrame:
    """(id, seed) of slot-aware clusters; columns id, x, y, size, confidence, source_tile and `on`."""
    return _slots_by_component(rows, radius, fraction, on) if fraction > 0 else _slots_in_blocks(rows, radius, on, rounds)


def _slots_in_blocks(rows: DataFrame, radius: float, on: Sequence[str], rounds: int) -> DataFrame:
    """`assign_slot_seeds` with one limit for all, see `kernels.slots`; no list of pairs."""
    slim, there, keys = _slim(rows, radius, on)
    # slots are read from names once those are columns, after the shuffle: the expression repeats them many times
    rest = ["x", "y", "confidence", "source_tile", names.slot("source_tile").alias("slot"), *keys]
    best = F.when(~F.isnan("confidence"), -F.col("confidence"))
    order = [c.asc_nulls_last() for c in (best, F.col("source_tile"), F.col("y"), F.col("x"), F.col("id"))]
    found = _in_blocks(slim.where(there), radius, keys, rest, order, rounds, 16, _slots_decided)
    return found.where(F.col("state") != greedy.OPEN).select("id", "seed").unionByName(slim.where(~there).select("id", F.col("id").alias("seed")))


def _slots_decided(wide: float, radius: float, ends: tuple[float, ...]):
    def rule(block: np.ndarray, x: np.ndarray, y: np.ndarray, ox: np.ndarray, oy: np.ndarray, rest: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        slot = rest.field("slot").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        return slots.decide(block, x, y, ox, oy, slot, wide, radius, ends)

    return lambda batches: greedy.decided(batches, rule, ["id", "seed", "state", "rest"], (greedy.SEED, greedy.LOST))


def _slots_by_component(rows: DataFrame, radius: float, fraction: float, on: Sequence[str]) -> DataFrame:
    """`assign_slot_seeds` where limits grow with size.

    Members compete, so this is sequential inside a component of the pair graph;
    components are independent and run as groups.  A component is as large as the
    chain of detections that touch each other, not as large as a tile.
    """
    slim = rows.select("id", "x", "y", "size", "confidence", "source_tile", *on)
    pairs = limited_pairs(slim.select("id", "x", "y", "size", *on), radius, fraction, on)
    roots = connected_components(pairs.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")))
    grouped = slim.withColumn("slot", names.slot("source_tile")).join(roots.withColumnRenamed("node", "id"), "id")
    found = grouped.groupBy("root").applyInPandas(_slot_clusters(radius, fraction), f"id {dict(rows.dtypes)['id']}, seed {dict(rows.dtypes)['id']}")
    return slim.select("id").join(found, "id", "left").select("id", F.coalesce("seed", "id").alias("seed"))


def deduplicate_slots(rows: DataFrame, radius: float, aggregation: str = "max", fraction: float = 0.4, on: Sequence[str] = ()) -> DataFrame:
    if radius <= 0 and fraction <= 0:
        return merged(rows, rows.select("id", F.col("id").alias("seed")), aggregation)
    return merged(rows, assign_slot_seeds(rows, radius, fraction, on), aggregation)


def dedup_group(tile: F.Column, placed: F.Column) -> F.Column:
    """Which rows are de-duplicated together: all placed ones, a submap's shots, all letter photos, or one photo; a shot outside of submaps is a photo by itself."""
    shots = names.lighting_role(tile).isNotNull() | (names.is_combined(tile) & (names.submap(tile) != ""))
    return F.when(placed, "placed").when(shots, F.concat(F.lit("light:"), F.coalesce(F.nullif(names.submap(tile), F.lit("")), tile))).when(names.is_direction_family(tile), "letters").otherwise(F.concat(F.lit("tile:"), tile))


def route_and_deduplicate(rows: DataFrame, pixel_nm: float, radius_px: float = 8.0, slot_radius_px: float = 24.0, fraction: float = 0.4, aggregation: str = "max") -> DataFrame:
    """`rows` with a boolean column placed, de-duplicated group by group and numbered throughout."""
    tagged = rows.withColumn("_group", dedup_group(F.col("source_tile"), F.col("placed")))
    by_slot = F.col("_group").startswith("light:") | (F.col("_group") == "letters")
    plain, slotted = tagged.where(~by_slot), tagged.where(by_slot)
    seeds = assign_seeds(plain, radius_px * pixel_nm, 0.0, ["_group"]).unionByName(assign_slot_seeds(slotted, max(radius_px, slot_radius_px) * pixel_nm, fraction, ["_group"]))
    return merged(tagged, seeds, aggregation).drop("_group")
