"""Joins by distance: a grid of cells turns them into equi-joins that shuffle by cell.

A plain distance predicate would compare all pairs.  Cells are as wide as the
radius, so partners are at most one cell apart: one side is copied to its nine
neighbouring cells and both meet by (group, cell).  Dense cells are split by Spark
like any skewed key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..kernels import nearest


def distance2(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def range_join(left: DataFrame, right: DataFrame, radius: float, on: Sequence[str] = (), x: str = "x", y: str = "y") -> DataFrame:
    """Pairs within `radius` of each other, inclusive: columns l (left row), r (right row) and d2."""
    if radius < 0:
        raise ValueError("a radius can't be negative")
    width = radius if radius > 0 else 1.0
    cell = lambda c: F.floor(F.col(c) / F.lit(float(width))).cast("long")
    a = left.select(F.struct("*").alias("l"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(on)), cell(x).alias("_cx"), cell(y).alias("_cy"))
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    b = right.select(F.struct("*").alias("r"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(on)), cell(x).alias("_cx"), cell(y).alias("_cy"), near.alias("_o"))
    b = b.select("r", *(f"_k{i}" for i in range(len(on))), (F.col("_cx") + F.col("_o.i")).alias("_cx"), (F.col("_cy") + F.col("_o.j")).alias("_cy"))
    pairs = a.join(b, [*(f"_k{i}" for i in range(len(on))), "_cx", "_cy"])
    d2 = distance2(F.col(f"l.{x}"), F.col(f"l.{y}"), F.col(f"r.{x}"), F.col(f"r.{y}"))
    return pairs.select("l", "r", d2.alias("d2")).where(F.col("d2") <= F.lit(float(radius) * float(radius)))


def self_pairs(rows: DataFrame, radius: float, on: Sequence[str] = (), key: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """Each pair of different rows within `radius` once: columns l, r and d2; l has the smaller key.

    A row goes to its own cell and four of its neighbours: the other four find it.
    """
    if radius < 0:
        raise ValueError("a radius can't be negative")
    width = float(radius) if radius > 0 else 1.0
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    keys = [f"_k{i}" for i in range(len(on))]
    a = rows.select(F.struct("*").alias("a"), *(F.col(k).alias(n) for k, n in zip(on, keys, strict=True)), cell(x).alias("_cx"), cell(y).alias("_cy"))
    half = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)))))
    b = a.withColumnRenamed("a", "b").withColumn("_o", half)
    own = (F.col("_o.i") == 0) & (F.col("_o.j") == 0)
    b = b.select("b", *keys, (F.col("_cx") + F.col("_o.i")).alias("_cx"), (F.col("_cy") + F.col("_o.j")).alias("_cy"), own.alias("_own"))
    pairs = a.join(b, [*keys, "_cx", "_cy"])
    first = F.col(f"a.{key}") < F.col(f"b.{key}")
    d2 = distance2(F.col(f"a.{x}"), F.col(f"a.{y}"), F.col(f"b.{x}"), F.col(f"b.{y}"))
    near = pairs.withColumn("d2", d2).where((F.col("d2") <= F.lit(float(radius) ** 2)) & F.when(F.col("_own"), first).otherwise(F.col(f"a.{key}") != F.col(f"b.{key}")))
    return near.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("l"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("r"), "d2")


def both_ways(pairs: DataFrame) -> DataFrame:
    """Pairs l, r, d2 and the same turned round."""
    ways = F.explode(F.array(F.struct("l", "r"), F.struct(F.col("r").alias("l"), F.col("l").alias("r"))))
    return pairs.select(ways.alias("_w"), "d2").select("_w.l", "_w.r", "d2")


def neighbour_counts(rows: DataFrame, radius: float, on: Sequence[str] = (), key: str = "id", x: str = "x", y: str = "y", name: str = "neighbours") -> DataFrame:
    """`rows` with the number of other rows within `radius`."""
    pairs = self_pairs(rows.select(key, *on, x, y), radius, on, key, x, y)
    counts = pairs.select(F.explode(F.array(f"l.{key}", f"r.{key}")).alias(key)).groupBy(key).agg(F.count("*").alias(name))
    return rows.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def pair_limit(radius: float, fraction: float, a: Column, b: Column) -> Column:
    """How far apart two detections of these sizes may be and still be one."""
    return F.greatest(F.lit(float(radius)), F.lit(float(fraction)) * F.greatest(a, b)) if fraction > 0 else F.lit(float(radius))


def search_radius(radius: float, fraction: float, *tables: DataFrame, size: str = "size") -> float:
    """The largest pair limit that can occur: one scalar from an aggregate over each table."""
    if fraction <= 0:
        return float(radius)
    largest = [t.agg(F.max(size)).head()[0] or 0.0 for t in tables]
    return max(float(radius), fraction * max(largest))


def limited_pairs(rows: DataFrame, radius: float, fraction: float, on: Sequence[str] = (), key: str = "id", x: str = "x", y: str = "y", size: str = "size") -> DataFrame:
    """Pairs of different rows within their pair limit, both ways: l, r, d2.

    Rows are classed by their own limit, by powers of two, with a grid as wide as the
    limit for each class.  The row of larger limit looks among those of its class and
    the ones below, so one huge row widens no other's search.  The driver sees the
    classes that occur, a few dozen at most.
    """
    slim = rows.select(key, *on, x, y, size)
    if fraction <= 0:
        return both_ways(self_pairs(slim, radius, on, key, x, y))
    base = float(radius) if radius > 0 else 1.0
    own = F.greatest(F.lit(float(radius)), F.lit(float(fraction)) * F.col(size))
    level = F.greatest(F.lit(0), F.ceil(F.log2(own / base) - 1e-12)).cast("int")
    classed = slim.select(F.struct("*").alias("s"), level.alias("c"))
    classes = sorted(r["c"] for r in classed.where("c IS NOT NULL").select("c").distinct().collect())
    at = lambda c: F.floor(F.col(f"s.{c}") / (F.lit(base) * F.pow(F.lit(2.0), F.col("g")))).cast("long")
    keys = [f"_k{i}" for i in range(len(on))]
    groups = [F.col(f"s.{k}").alias(n) for k, n in zip(on, keys, strict=True)]
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    big = classed.withColumn("g", F.col("c")).select(F.col("s").alias("l"), F.col("c").alias("lc"), *groups, "g", at(x).alias("_x"), at(y).alias("_y"), near.alias("o"))
    big = big.select("l", "lc", *keys, "g", (F.col("_x") + F.col("o.i")).alias("cx"), (F.col("_y") + F.col("o.j")).alias("cy"))
    levels = F.array(*map(F.lit, classes)).cast("array<int>")
    small = classed.withColumn("g", F.explode(F.filter(levels, lambda g: g >= F.col("c")))).select(F.col("s").alias("r"), F.col("c").alias("rc"), *groups, "g", at(x).alias("cx"), at(y).alias("cy"))
    d2 = distance2(F.col(f"l.{x}"), F.col(f"l.{y}"), F.col(f"r.{x}"), F.col(f"r.{y}"))
    limit = pair_limit(radius, fraction, F.col(f"l.{size}"), F.col(f"r.{size}"))
    found = big.join(small, [*keys, "g", "cx", "cy"]).withColumn("d2", d2).where((F.col("d2") <= limit * limit) & (F.col(f"l.{key}") != F.col(f"r.{key}")))
    # pairs of one class are found from both ends
    ways = F.when(F.col("lc") == F.col("rc"), F.array(F.struct("l", "r"))).otherwise(F.array(F.struct("l", "r"), F.struct(F.col("r").alias("l"), F.col("l").alias("r"))))
    return found.select(F.explode(ways).alias("_w"), "d2").select("_w.l", "_w.r", "d2")


def nearest_join(left: DataFrame, right: DataFrame, radius: float, on: Sequence[str] = (), key: str = "id", right_key: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """(key, r, d2): for each left row the nearest right row within `radius`, ties to the smaller right key; none if there is none.

    Both sides meet in blocks some radii wide, right rows also in those within reach,
    and are searched there without a row for each pair; see `kernels.nearest`.
    """
    if radius < 0:
        raise ValueError("a radius can't be negative")
    width = F.lit(nearest.BLOCK * (float(radius) if radius > 0 else 1.0))
    reach = F.lit(float(radius) * (1 + 1e-9))
    keys = [f"_k{i}" for i in range(len(on))]
    block = lambda c: F.floor(c / width).cast("long")

    def side(rows: DataFrame, own: Column, point: Column, rank: Column, reach: Column) -> DataFrame:
        """Rows without a place or a group meet nothing."""
        there = reduce(lambda a, b: a & b, [F.abs(F.col(c).cast("double")) < float("inf") for c in (x, y)] + [F.col(k).isNotNull() for k in on])
        at = rows.where(there).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), own.alias("key"), point.alias("point"), rank.alias("_rank"), *(F.col(k).alias(n) for k, n in zip(on, keys, strict=True)))
        for c in ("x", "y"):
            at = at.withColumn(f"_b{c}", F.explode(F.sequence(block(F.col(c) - reach), block(F.col(c) + reach))))
        return at

    shape, own, rank = right.select(F.struct("*").alias("r")).schema["r"].dataType, left.schema[key].dataType, right.schema[right_key].dataType
    points = side(right, F.lit(None).cast(own), F.struct(*(F.col(c) for c in right.columns)), F.col(right_key), reach)
    asking = side(left, F.col(key), F.lit(None).cast(shape), F.lit(None).cast(rank), F.lit(0.0))
    where = [*keys, "_bx", "_by"]
    # no other step deals rows by this hash, so nothing turns it into local reads
    both = points.unionByName(asking).repartition(F.xxhash64(*where, F.lit(0))).sortWithinPartitions(*where, F.col("point").isNull(), "_rank")
    corner = [(F.col(f"_b{c}") * width).alias(f"o{c}") for c in ("x", "y")]
    names = [key, "r", "d2"]
    schema = StructType([StructField(key, own), StructField("r", shape), StructField("d2", DoubleType())])
    pairs = both.select("x", "y", *corner, "key", "point", *where).mapInArrow(lambda batches: nearest.nearest_points(batches, float(radius), names), schema)
    best = F.min_by(F.struct("r", "d2"), F.struct("d2", F.col(f"r.{right_key}")))
    return pairs.groupBy(key).agg(best.alias("_b")).select(key, "_b.r", "_b.d2")
