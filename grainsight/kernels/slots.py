"""Slot-aware greedy clusters inside blocks of the plane, from what a block shows.

In order of priority, a row that nobody has taken becomes a seed and takes, of each
slot but its own, the nearest free row within reach; rows without a slot are never
taken.  What lies outside of a block can't be seen, so rows within reach of its border
are unsure: somebody outside may take them.  An unsure row may be a seed or not, so
the nearest free row of each slot that it could take is unsure too, and so is what a
seed takes where an unsure row is nearer.  All else is decided as it is in the whole
plane: a seed is settled with all its members or stays open, to be asked again in
blocks that lie elsewhere.  Settled rows can leave: what the others take is the
nearest of the rest as well.

Rows are worked on in stretches; for each stretch, the nearest rows of every slot are
listed in cells as fine as the rows still free are dense.
"""

from __future__ import annotations

import numpy as np

from .greedy import LOST, OPEN, SEED

#: Rows of a stretch at most; searches that are listed together; a cell is halved where its surroundings have more than MANY rows and would keep FEW.
STRETCH, TOGETHER, MANY, FEW, LEVELS = 1 << 15, 1 << 14, 40, 12, 9
#: So many rows of one slot at one place are listed.
COPIES = 32


class Near:
    """Finds rows of a slot near others, in grids of halved cells; `rows` ascend."""

    def __init__(self, plane: Plane, rows: np.ndarray, ahead: bool = True):
        """Of copies of a place the first or, not `ahead`, the last are listed; the last one listed of the first ones is `cut`."""
        self.plane, self.all, self.rows, self.levels, self.cut = plane, rows, rows, {}, np.zeros(len(plane.x), bool)
        if len(rows) > COPIES:
            values = [v[rows] for v in (plane.x, plane.y, plane.slot, plane.block)]
            place = np.lexsort((rows if ahead else -rows, *values))
            new = np.append(True, np.any([v[place[1:]] != v[place[:-1]] for v in values], 0))
            first = np.flatnonzero(new)
            rank = np.arange(len(place)) - np.repeat(first, np.diff(np.append(first, len(place))))
            if rank.max() >= COPIES:
                if ahead:
                    self.cut[rows[place[np.flatnonzero(rank == COPIES) - 1]]] = True
                self.rows = np.sort(rows[place[rank < COPIES]])

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(codes of cells, rows) in order of cells."""
        if k not in self.levels:
            code = self.plane.code(self.rows, self.plane.slot[self.rows], k)
            by = np.argsort(code, kind="stable")
            self.levels[k] = code[by], self.rows[by]
        return self.levels[k]

    def spans(self, q: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(low, high), three of each: where the rows of the nine cells around each are."""
        code, _ = self.level(k)
        own, side = self.plane.code(q, s, k), self.plane.side(k)
        return np.stack([np.searchsorted(code, own + d * side - 1) for d in (-1, 0, 1)], 1), np.stack([np.searchsorted(code, own + d * side + 1, "right") for d in (-1, 0, 1)], 1)

    def lists(self, q: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, row, distance, reach): for each search worse rows, and cut ones, in order of (distance, row), all those up to its reach."""
        n, p = len(q), self.plane
        level, spans = np.zeros(n, np.int64), {}
        low, high = self.spans(q, s, 0)
        many = np.flatnonzero((high - low).sum(1) > MANY)
        for k in range(1, LEVELS):
            if not len(many):
                break
            low, high = self.spans(q[many], s[many], k)
            count = (high - low).sum(1)
            level[many[count >= FEW]] = k
            many = many[count > MANY]
        start, end, reach = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, p.radius)
        rows, far, total = [], [], 0
        for k in range(int(level.max(initial=0)), -1, -1):
            of = np.flatnonzero(level == k)
            if not len(of):
                continue
            low, high = self.spans(q[of], s[of], k)
            count = high - low
            flat = count.ravel()
            begin = np.cumsum(flat) - flat
            c = self.level(k)[1][np.repeat(low.ravel() - begin, flat) + np.arange(flat.sum())]
            who = np.repeat(np.arange(len(of)), count.sum(1))
            d = np.hypot(p.x[c] - p.x[q[of]][who], p.y[c] - p.y[q[of]][who])
            limit = p.radius if k == 0 else p.width / 2**k * (1 - 1e-9)
            keep = (d <= limit) & ((c > q[of][who]) | self.cut[c])
            c, who, d = c[keep], who[keep], d[keep]
            kept = np.bincount(who, minlength=len(of))
            if k:  # too few: cells twice as wide
                poor = kept < 3
                level[of[poor]] = k - 1
                keep = ~poor[who]
                c, who, d = c[keep], who[keep], d[keep]
                kept[poor] = 0
                reach[of[~poor]] = limit
            by = np.lexsort((c, d, who))
            rows.append(c[by])
            far.append(d[by])
            end[of] = total + np.cumsum(kept)
            start[of] = end[of] - kept
            total += len(c)
        return start, end, np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(far or [np.zeros(0)]), reach

    def around(self, p: int, s: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of all worse rows of a slot within reach, in order of (distance, row)."""
        if "all" not in self.levels:
            code = self.plane.code(self.all, self.plane.slot[self.all], 0)
            by = np.argsort(code, kind="stable")
            self.levels["all"] = code[by], self.all[by]
        code, rows = self.levels["all"]
        own, side = int(self.plane.code(np.array([p]), np.array([s]), 0)[0]), self.plane.side(0)
        c = np.concatenate([rows[np.searchsorted(code, own + d * side - 1) : np.searchsorted(code, own + d * side + 1, "right")] for d in (-1, 0, 1)])
        d = np.hypot(self.plane.x[c] - self.plane.x[p], self.plane.y[c] - self.plane.y[p])
        keep = (d <= self.plane.radius) & (c > p)
        c, d = c[keep], d[keep]
        by = np.lexsort((c, d))
        return c[by], d[by]


class Plane:
    """Rows in an order in which each block's come by priority; `slot` is -1 for none."""

    def __init__(self, block, x, y, ox, oy, slot, wide, radius):
        self.block, self.x, self.y, self.ox, self.oy, self.slot, self.wide, self.radius = block, x, y, ox, oy, slot, wide, radius
        self.slots = int(slot.max(initial=-1)) + 1
        self.width = (radius if radius > 0 else 1.0) * (1 + 1e-9)

    def side(self, k: int) -> int:
        return int(self.wide / self.width * 2**k) + 5

    def code(self, rows: np.ndarray, slot: np.ndarray, k: int) -> np.ndarray:
        w, side = self.width / 2**k, self.side(k)
        cell = lambda at, low: np.floor((at[rows] - low[rows]) / w).astype(np.int64) + 1
        return ((self.block[rows] * self.slots + slot) * side + cell(self.y, self.oy)) * side + cell(self.x, self.ox)


def decide(block: np.ndarray, x: np.ndarray, y: np.ndarray, ox: np.ndarray, oy: np.ndarray, slot: np.ndarray, wide: float, radius: float, ends: tuple[float, float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(state, seed's number or -1) of rows in order of priority; blocks have low corners (ox, oy) and are `wide`; no row lies outside of `ends`, the least and largest x and y."""
    n = len(x)
    state, seed = np.full(n, OPEN, np.int8), np.full(n, -1)
    # all blocks side by side: the first rows of each, then the second ones
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if n else np.zeros(0, np.int64)
    rank = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    order = np.lexsort((block, rank))
    p = Plane(*(c[order] for c in (block, x, y, ox, oy, slot)), wide, radius)
    inner = np.ones(n, bool)
    for at, low, least, most in ((p.x, p.ox, *ends[:2]), (p.y, p.oy, *ends[2:])):
        reach = radius * (1 + 1e-9) + 1e-15 * np.abs(at)
        inner &= ((at - low >= reach) | (low < least)) & ((low + wide - at >= reach) | (low + wide > most))
    taken, unsure = bytearray(n), bytearray((~inner).tobytes())
    is_taken, is_unsure = np.frombuffer(taken, np.bool_), np.frombuffer(unsure, np.bool_)
    by, settled, begin = np.full(n, -1), np.zeros(n, bool), 0
    while begin < n:
        free = begin + np.flatnonzero(~is_taken[begin:])
        if not len(free):
            break
        now = free[: min(max(len(free) // 8, 256), STRETCH)]
        begin = int(now[-1]) + 1
        settled[now] = True
        some = free[p.slot[free] >= 0]
        near, doubt = Near(p, some[~is_unsure[some]]), Near(p, some[is_unsure[some]], False)
        cut = near.cut.tobytes()
        for low in range(0, len(now), max(TOGETHER // max(p.slots, 1), 1)):
            asked = now[low : low + max(TOGETHER // max(p.slots, 1), 1)]
            q, s = np.repeat(asked, p.slots), np.tile(np.arange(p.slots), len(asked))
            other = p.slot[q] != s
            q, s = q[other], s[other]
            start, end, rows, far, reach = near.lists(q, s)
            fear = np.full(len(q), np.inf)
            sure = np.flatnonzero(~is_unsure[q])
            if len(doubt.rows) and len(sure):
                a, b, _, d, r = doubt.lists(q[sure], s[sure])
                fear[sure] = np.where(r < radius, r, np.inf)
                fear[sure[a < b]] = d[a[a < b]]
            work = np.flatnonzero((start < end) | (reach < radius) | (fear <= radius))
            rows, far = rows.tolist(), far.tolist()
            for one, slot_, a, b, whole, dread in zip(q[work].tolist(), s[work].tolist(), start[work].tolist(), end[work].tolist(), (reach[work] >= radius).tolist(), fear[work].tolist(), strict=True):
                if taken[one]:
                    continue
                found, d, before = -1, 0.0, False
                for e in range(a, b):
                    c = rows[e]
                    if c > one and not taken[c]:
                        if not unsure[c]:
                            found, d = c, far[e]
                            break
                        before = True
                    if cut[c]:
                        whole = False
                        break
                if found < 0 and not whole:
                    before = False
                    for c, d in zip(*(v.tolist() for v in near.around(one, slot_)), strict=True):
                        if not taken[c]:
                            if not unsure[c]:
                                found = c
                                break
                            before = True
                if unsure[one]:
                    if found >= 0:
                        unsure[found] = 1
                elif found >= 0 and not before and d < dread:
                    taken[found] = 1
                    by[found] = one
                elif found >= 0 or before or dread <= radius:
                    settled[one] = False
                    if found >= 0:
                        unsure[found] = 1
    settled &= ~is_taken & ~is_unsure
    member = np.flatnonzero(by >= 0)
    member = member[settled[by[member]]]
    state[order[settled]] = SEED
    seed[order[settled]] = order[settled]
    state[order[member]] = LOST
    seed[order[member]] = order[by[member]]
    return state, seed
