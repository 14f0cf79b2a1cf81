"""The nearest of many points, over batches of rows that come block by block.

Points of a block are held, those that ask stream past them, so a block may have
any number of the latter.  Inside a block points lie on a grid of their own, as
fine as they are dense, and each asking row looks at rings of its cells until no
nearer point can follow: pairs aren't listed, however many are within reach.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Blocks are so many search radii wide.
BLOCK = 8
#: Rows that are looked up together, and pairs that are in memory at once.
ROWS, PAIRS = 1 << 15, 1 << 20
#: A radius is halved so often at most for the cells of a grid.
FINEST = 4


class Grid:
    """Points (x, y) of numbered blocks with low corners (ox, oy); of points in one place the first counts."""

    def __init__(self, block: np.ndarray, x: np.ndarray, y: np.ndarray, ox: np.ndarray, oy: np.ndarray, radius: float):
        self.radius, width = radius, radius if radius > 0 else 1.0
        order = np.lexsort((np.arange(len(x)), y, x, block))
        new = np.ones(len(order), bool)
        b, px, py = block[order], x[order], y[order]
        new[1:] = (b[1:] != b[:-1]) | (px[1:] != px[:-1]) | (py[1:] != py[:-1])
        at = order[new]
        coarse = (np.floor((x[at] - ox[at]) / width) * 4096 + np.floor((y[at] - oy[at]) / width)) + block[at] * 4096.0**2
        each = len(at) / max(1, len(np.unique(coarse)))
        self.rings = 2 ** int(np.clip(np.ceil(np.log2(max(each, 1.0)) / 2), 0, FINEST))
        self.fine = width / self.rings
        self.side = (BLOCK + 3) * self.rings + 8
        code = self._code(block[at], x[at], y[at], ox[at], oy[at])
        order = np.lexsort((at, code))
        self.at, self.code = at[order], code[order]
        self.x, self.y = x[self.at], y[self.at]

    def _code(self, block, x, y, ox, oy):
        cx = np.floor((x - ox) / self.fine).astype(np.int64) + self.rings + 2
        cy = np.floor((y - oy) / self.fine).astype(np.int64) + self.rings + 2
        return (block * self.side + cx) * self.side + cy

    def nearest(self, block: np.ndarray, x: np.ndarray, y: np.ndarray, ox: np.ndarray, oy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest point within the radius, squared distance), ties to the smaller number; -1 for none."""
        best, d2 = np.full(len(x), -1), np.full(len(x), np.inf)
        code = self._code(block, x, y, ox, oy)
        open_ = np.arange(len(x))
        for ring in range(self.rings + 2):
            for i in range(-ring, ring + 1):
                for j in range(-ring, ring + 1) if abs(i) == ring else (-ring, ring) if ring else (0,):
                    self._look(code[open_] + i * self.side + j, open_, x, y, best, d2)
            # what lies in further rings is further away than this
            open_ = open_[~(d2[open_] <= (ring * self.fine * (1 - 1e-9)) ** 2)]
            if not len(open_):
                break
        far = ~(d2 <= float(self.radius) ** 2)
        best[far] = -1
        return best, d2

    def _look(self, code, rows, x, y, best, d2) -> None:
        low = np.searchsorted(self.code, code)
        n = np.searchsorted(self.code, code, "right") - low
        there = np.flatnonzero(n)
        low, n, rows = low[there], n[there], rows[there]
        ends = np.cumsum(n)
        start = 0
        while start < len(rows):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
            part, of = n[start:stop], rows[start:stop]
            first = np.cumsum(part) - part
            point = np.arange(int(part.sum())) + np.repeat(low[start:stop] - first, part)
            dx, dy = np.repeat(x[of], part) - self.x[point], np.repeat(y[of], part) - self.y[point]
            d = dx * dx + dy * dy
            least = np.minimum.reduceat(d, first)
            who = np.minimum.reduceat(np.where(d == np.repeat(least, part), self.at[point], np.iinfo(np.int64).max), first)
            better = (least < d2[of]) | ((least == d2[of]) & (who < best[of]))
            best[of[better]], d2[of[better]] = who[better], least[better]
            start = stop


def changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows differ from the ones before; the first doesn't."""
    out = np.zeros(len(columns[0]), bool)
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def nearest_points(batches: Iterable[pa.RecordBatch], radius: float, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (x, y, ox, oy, key, point, the block's columns), block by block, a block's points first: (key, point, d2).

    `point` is null in rows that ask.  Those of a block come in order of their rank, in which ties are decided.
    """
    held: list[pa.RecordBatch] = []

    def found(rows: pa.Table) -> tuple[pa.RecordBatch, pa.Table]:
        """What its askers find, and the points of its last block, which may go on."""
        number = lambda c: rows.column(c).to_numpy()
        block = np.cumsum(changes([rows.column(i).to_numpy() for i in range(6, rows.num_columns)]))
        asks = rows.column("point").is_null().to_numpy()
        x, y, ox, oy = (number(c) for c in ("x", "y", "ox", "oy"))
        p, q = np.flatnonzero(~asks), np.flatnonzero(asks)
        last = rows.take(pa.array(p[block[p] == block[-1]]))
        if not len(p) or not len(q):
            return _batch([], [], [], names, rows), last
        best, d2 = Grid(block[p], x[p], y[p], ox[p], oy[p], radius).nearest(block[q], x[q], y[q], ox[q], oy[q])
        hit = best >= 0
        return _batch(q[hit], p[best[hit]], d2[hit], names, rows), last

    waiting = kept = 0
    for batch in batches:
        held.append(batch)
        waiting += batch.num_rows
        # a block's points are kept until all of its askers have come
        if waiting >= max(ROWS, kept):
            out, last = found(pa.Table.from_batches(held))
            yield out
            held, waiting, kept = last.to_batches(), 0, last.num_rows
    if waiting:
        yield found(pa.Table.from_batches(held))[0]


def _batch(q, p, d2, names: list[str], rows: pa.Table) -> pa.RecordBatch:
    take = lambda name, at: rows.column(name).take(pa.array(np.asarray(at, np.int64))).combine_chunks()
    columns = [take("key", q), take("point", p), pa.array(np.asarray(d2, np.float64))]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names)
