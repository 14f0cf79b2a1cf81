"""Exact top-k search by M-tree (operator 6).

The upper level of the tree has `PIVOTS` routing objects, drawn by hash: a fixed
number, which every task knows with their covering radii.  Each vector goes to its
nearest one's subtree, which is dealt to blocks of bounded size, each a tree of its
own in one task.  A query first searches the subtree nearest to it; its k-th score
there bounds the distance beyond which the other subtrees' radii rule them out, and
only those that remain see it.

A tree's nodes are pages: arrays of entries with their covering radii and their
distances to the page's parent object.  Search is best-first; an entry whose stored
parent distance already puts it out of reach by the triangle inequality is skipped
without computing its distance.

The largest inner product becomes the smallest Euclidean distance when each
vector gets one more coordinate that brings all to the same norm and is 0 for
queries.  Bounds leave room for rounding; scores are exact integers.

Defined results: vectors that are null or hold null or non-finite components, and
rows with a null id, take no part; equal scores rank by id; rows that repeat id and
vector count once; shorter vectors count as filled up with zeros; vectors with
components of 2**24 or more after scaling stand beside the trees and are compared one
by one in whole numbers of any size, and only a score that doesn't fit 64 bits and
would be returned raises an error; an empty table gives an empty table.  Only id and vector are read, so other
columns clash with nothing.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean

#: Entries of a page, at most.
PAGE = 256
#: Entries of an inner page; a power of two.
FANOUT = 16
BLOCK = 4096
#: Routing objects of the upper level.
PIVOTS = 64
#: Fixed value: components are scaled by this and rounded down.
SCALE = 256.0
#: Scaled components from here on don't go into trees.
LARGE = 1 << 24


def integers(batch: pa.RecordBatch, column: int) -> list[np.ndarray | None]:
    """floor(256 * x) of each vector, as 32-bit numbers or, if some are large, as floats; None where a vector takes no part."""
    lists = batch.column(column)
    flat, offsets = lists.values, lists.offsets.to_numpy()
    raw = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    found = []
    for i, valid in enumerate(lists.is_valid().to_pylist()):
        v = raw[offsets[i] : offsets[i + 1]]
        if not valid or not np.isfinite(v).all():
            found.append(None)
        elif len(v) and np.abs(v).max() >= LARGE / SCALE:
            found.append(v)  # scaled exactly where it is used
        else:
            found.append(np.floor(SCALE * v).astype(np.int32))
    return found


def whole_numbers(v: bytes, large: bool) -> list[int]:
    """The components as Python's integers."""
    return [math.floor(int(SCALE) * Fraction(x)) for x in np.frombuffer(v, np.float64).tolist()] if large else np.frombuffer(v, np.int32).tolist()


def one_by_one(query: list[int], rows: list[tuple[int, list[int]]], k: int, own: int) -> list[tuple[int, int]]:
    """(score, id) of the k best rows by plain products."""
    scored = ((sum(a * b for a, b in zip(query, v, strict=False)), -i) for i, v in rows if i != own)
    best = [(s, -i) for s, i in heapq.nlargest(k, scored)]
    if any(not -(1 << 63) <= s < 1 << 63 for s, _ in best):
        raise OverflowError("a score doesn't fit 64 bits")
    return best


class MTree:
    """An M-tree over one block: pages of (entries, parent distances, radii, children)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        self.whole = vectors
        self.x = vectors.astype(np.float64)
        self.norm = (self.x * self.x).sum(1)
        self.most = float(self.norm.max()) if len(ids) else 0.0
        self.lift = np.sqrt(self.most - self.norm)
        self.slack = 1e-7 * (1.0 + self.most**0.5)
        self.computed = 0
        self.pages: list[tuple[np.ndarray, np.ndarray, np.ndarray | None, list[int] | None]] = []
        self.root = self._page(np.arange(len(ids)), None) if len(ids) else -1

    def _between(self, a: int, rows: np.ndarray) -> np.ndarray:
        d = self.norm[rows] + self.norm[a] - 2 * (self.x[rows] @ self.x[a]) + (self.lift[rows] - self.lift[a]) ** 2
        return np.sqrt(np.maximum(d, 0))

    def _page(self, rows: np.ndarray, parent: int | None) -> int:
        """Stores a page over these rows and all below it; its number."""
        if len(rows) <= PAGE:
            return self._store(rows, parent, None, None)
        groups = self._groups(rows, FANOUT)
        objects = np.array([self._middle(g) for g in groups])
        radii = np.array([self._between(int(o), g).max() for o, g in zip(objects, groups, strict=True)])
        children = [self._page(g, int(o)) for g, o in zip(groups, objects, strict=True)]
        return self._store(objects, parent, radii, children)

    def _groups(self, rows: np.ndarray, parts: int) -> list[np.ndarray]:
        """Halves along the line between two far objects, again and again, until the parts fit pages: all pages are well filled."""
        if parts == 1 or len(rows) <= PAGE:
            return [rows]
        a = int(rows[np.argmax(self._between(int(rows[0]), rows))])
        from_a = self._between(a, rows)
        b = int(rows[np.argmax(from_a)])
        order = rows[np.argsort(from_a - self._between(b, rows), kind="stable")]
        return [g for half in (order[: len(order) // 2], order[len(order) // 2 :]) for g in self._groups(half, parts // 2)]

    def _middle(self, rows: np.ndarray) -> int:
        """The row nearest to the mean of a group: its routing object."""
        d = ((self.x[rows] - self.x[rows].mean(0)) ** 2).sum(1) + (self.lift[rows] - self.lift[rows].mean()) ** 2
        return int(rows[np.argmin(d)])

    def _store(self, rows: np.ndarray, parent: int | None, radii: np.ndarray | None, children: list[int] | None) -> int:
        to_parent = self._between(parent, rows) if parent is not None else np.zeros(len(rows))
        self.pages.append((rows, to_parent, radii, children))
        return len(self.pages) - 1

    def search(self, query: np.ndarray, k: int, own: int | None) -> list[tuple[int, int]]:
        """(score, id) of the k best rows, best first; rows whose id is `own` are left out."""
        if self.root < 0 or k < 1:
            return []
        q = query.astype(np.float64)
        exact = query.astype(np.int64) if float(q @ q) * self.most >= 2.0**104 else None
        side = float(q @ q) + self.most
        best: list[tuple[int, int]] = []  # (score, -id), the worst first
        reach = np.inf
        queue: list[tuple[float, int, float | None]] = [(0.0, self.root, None)]
        while queue:
            least, page, parent = heapq.heappop(queue)
            if least > reach:
                break
            rows, to_parent, radii, children = self.pages[page]
            far = radii + self.slack if radii is not None else self.slack
            if parent is None:
                open_ = np.arange(len(rows))
            else:
                open_ = np.flatnonzero(np.abs(parent - to_parent) - far <= reach)
            if not len(open_):
                continue
            self.computed += len(open_)
            if children is None:
                got = rows[open_]
                # float64 holds every partial sum exactly as long as the norms allow it
                scores = (self.x[got] @ q).astype(np.int64) if exact is None else self.whole[got].astype(np.int64) @ exact
                if len(best) == k:
                    near = scores >= best[0][0]
                    scores, got = scores[near], got[near]
                elif len(scores) > 4 * k + 4:
                    near = np.argpartition(-scores, k)
                    near = scores >= scores[near[k]]
                    scores, got = scores[near], got[near]
                for score, i in zip(scores.tolist(), self.ids[got].tolist(), strict=True):
                    if i == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -i))
                    elif (score, -i) > best[0]:
                        heapq.heapreplace(best, (score, -i))
                if len(best) == k:
                    reach = max(side - 2.0 * best[0][0], 0.0) ** 0.5 + self.slack
                continue
            d = np.sqrt(np.maximum(side - 2.0 * (self.x[rows[open_]] @ q), 0))
            low = np.maximum(d - far[open_], 0)
            for e, dist, bound in zip(open_.tolist(), d.tolist(), low.tolist(), strict=True):
                if bound <= reach:
                    heapq.heappush(queue, (bound, children[e], dist))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _matrix(vectors: list[bytes]) -> np.ndarray:
    each = [np.frombuffer(v, np.int32) for v in vectors]
    out = np.zeros((len(each), max(map(len, each), default=0)), np.int32)
    for row, v in zip(out, each, strict=True):
        row[: len(v)] = v
    return out


def _answers(k: int):
    names = ["query_id", "vec_id", "score"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, data, large, tree = None, [], [], None
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for b, asks, i, v, is_large in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if b != block:
                    block, data, large, tree = b, [], [], None
                if not asks:
                    if is_large:
                        large.append((i, whole_numbers(v, True)))
                    else:
                        data.append((i, v))
                    continue
                if is_large:
                    rows = large + [(j, whole_numbers(w, False)) for j, w in data]
                    out += [(i, j, s) for s, j in one_by_one(whole_numbers(v, True), rows, k, i)]
                    continue
                if tree is None:
                    tree = MTree(np.array([x[0] for x in data], np.int64), _matrix([x[1] for x in data]))
                q = np.frombuffer(v, np.int32)
                width = tree.x.shape[1] if len(data) else len(q)
                q = np.resize(np.concatenate([q, np.zeros(max(0, width - len(q)), np.int32)]), width) if len(q) < width else q[:width]
                out += [(i, j, s) for s, j in tree.search(q, k, i)]
                if large:
                    out += [(i, j, s) for s, j in one_by_one(whole_numbers(v, False), large, k, i)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names)

    return run


@dataclass
class Upper:
    """The upper level: pivots with their lifts, the common norm, and each subtree's radius and blocks."""

    pivots: np.ndarray
    most: float
    radius: np.ndarray = field(default_factory=lambda: np.zeros(0))
    blocks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __post_init__(self):
        self.norm = (self.pivots * self.pivots).sum(1)
        self.lift = np.sqrt(np.maximum(self.most - self.norm, 0))
        self.slack = 1e-7 * (1.0 + self.most**0.5)

    def matrix(self, vectors: list[bytes]) -> np.ndarray:
        x = _matrix(vectors).astype(np.float64)
        width = self.pivots.shape[1]
        return np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))[:, :width] if x.shape[1] != width else x

    def distances(self, vectors: list[bytes], asking: bool) -> np.ndarray:
        """Vectors x pivots; vectors that ask have no lift."""
        x = self.matrix(vectors)
        norm = np.array([float((np.frombuffer(v, np.int32).astype(np.float64) ** 2).sum()) for v in vectors])
        lift = np.zeros(len(x)) if asking else np.sqrt(np.maximum(self.most - norm, 0))
        d = norm[:, None] + self.norm[None, :] - 2 * (x @ self.pivots.T) + (lift[:, None] - self.lift[None, :]) ** 2
        return np.sqrt(np.maximum(d, 0))


def _dealt(shared):
    """(id, asks, v, large, subtree, distance): each vector's subtree; large ones have their own, which is -1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            subtree, distance = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            at = np.flatnonzero(~batch.column(3).to_numpy(zero_copy_only=False))
            if len(at):
                d = shared.value.distances([batch.column(2)[i].as_py() for i in at.tolist()], False)
                subtree[at] = d.argmin(1)
                distance[at] = d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(subtree), pa.array(distance)], ["id", "asks", "v", "large", "subtree", "distance"])

    return run


def _visits(shared, k: int):
    """(block, id, v, large): the blocks that a query must still see; rows (id, v, large, subtree, least), least: its k-th score or null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up = shared.value
        first = np.concatenate([[0], np.cumsum(up.blocks)])
        for batch in batches:
            for i, v, large, subtree, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                open_ = np.ones(len(up.blocks), bool)
                open_[subtree] = False  # also -1, the last: large vectors
                if subtree >= 0 and least is not None:
                    q = np.frombuffer(v, np.int32).astype(np.float64)
                    reach = max(float(q @ q) + up.most - 2.0 * least, 0.0) ** 0.5
                    open_[:-1] &= up.distances([v], True)[0] - up.radius <= reach + 2 * up.slack
                if subtree < 0:
                    open_[-1] = False
                blocks = np.concatenate([np.arange(first[g], first[g + 1]) for g in np.flatnonzero(open_)]) if open_.any() else np.zeros(0, np.int64)
                n = len(blocks)
                yield pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), pa.array([i] * n, pa.int64()), pa.array([v] * n, pa.binary()), pa.array([large] * n, pa.bool_())], ["block", "id", "v", "large"])

    return run


def _searched(data: DataFrame, queries: DataFrame, k: int, blocks: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each block for each query that visits it; data and queries: (block, id, v, large)."""
    names = ["block", "asks", "id", "v", "large"]
    both = data.withColumn("asks", F.lit(False)).select(names).unionByName(queries.withColumn("asks", F.lit(True)).select(names))
    parts = both.repartition(max(1, blocks), "block").sortWithinPartitions("block", "asks", "id")
    return parts.mapInArrow(lean(_answers(k)), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, asks: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `asks` holds, the k rows of largest inner product.

    The driver sees `pivots` vectors and a row for each of their subtrees.
    """

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = integers(batch, 2)
            keep = pa.array([v is not None for v in found])
            kept = [v for v in found if v is not None]
            large = [v.dtype == np.float64 for v in kept]
            norm = [0.0 if x else float((v.astype(np.float64) ** 2).sum()) for v, x in zip(kept, large, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array([v.tobytes() for v in kept], pa.binary()), pa.array(large, pa.bool_()), pa.array(norm, pa.float64())], ["id", "asks", "v", "large", "norm"])

    sc = vectors.sparkSession.sparkContext
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(vector).cast("array<double>").alias("v"))
    data = cut(rows.mapInArrow(lean(whole), "id long, asks boolean, v binary, large boolean, norm double").distinct())
    drawn = [r["v"] for r in data.where("NOT large").orderBy(F.xxhash64("id", "v"), "id").limit(pivots).select("v").collect()]
    most, longest = data.agg(F.max("norm"), F.max(F.when(~F.col("large"), F.octet_length("v")))).head()
    up = Upper(np.pad(_matrix([bytes(v) for v in drawn]).astype(np.float64), ((0, 0), (0, max(0, (longest or 0) // 4 - max((len(v) // 4 for v in drawn), default=0))))), float(most or 0.0))
    tree = cut(data.drop("norm").mapInArrow(lean(_dealt(sc.broadcast(up))), "id long, asks boolean, v binary, large boolean, subtree int, distance double")) if drawn else data.select("id", "asks", "v", "large", F.lit(-1).alias("subtree"), F.lit(0.0).alias("distance"))
    n = len(up.pivots)
    radius, blocks = np.zeros(n), np.zeros(n + 1, np.int64)
    for r in tree.groupBy("subtree").agg(F.max("distance").alias("radius"), F.count("*").alias("n")).collect():
        blocks[r["subtree"]] = -(-r["n"] // block)  # the last is that of large vectors
        if r["subtree"] >= 0:
            radius[r["subtree"]] = r["radius"] + up.slack
    up.radius, up.blocks = radius, blocks
    total, first = int(blocks.sum()), np.concatenate([[0], np.cumsum(blocks)])
    # the driver's numbers as expressions over the few subtrees
    of = F.when(F.col("subtree") < 0, n).otherwise(F.col("subtree"))
    start, parts = (F.get(F.array(*(F.lit(int(x)) for x in v)), of).cast("int") for v in (first[:-1], np.maximum(blocks, 1)))
    placed = tree.withColumn("block", (start + F.pmod(F.xxhash64("id"), parts)).cast("int"))
    data_rows = placed.select("block", "id", "v", "large")
    queries = tree.where("asks")
    own = queries.select("id", "v", "large", F.explode(F.sequence(start, start + parts - 1)).alias("block"))
    near = cut(_searched(data_rows, own, k, total))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = F.row_number().over(order)
    bar = near.withColumn("rank", ranked).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    # rows that share an id are one query for the bar of neither
    alone = queries.groupBy("id").agg(F.count("*").alias("n")).where("n = 1").select("id")
    asked = queries.join(bar.join(alone, "id", "left_semi"), "id", "left").select("id", "v", "large", "subtree", "least")
    visits = asked.mapInArrow(lean(_visits(sc.broadcast(up), k)), "block int, id long, v binary, large boolean")
    found = near.unionByName(_searched(data_rows, visits, k, total))
    return found.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
