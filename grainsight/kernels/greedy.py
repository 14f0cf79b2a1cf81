"""Greedy seeds inside blocks of the plane, from what a block shows.

Rows of a block come in order of priority.  What lies outside can't be seen, so a
row is a seed only if the block shows all that is within reach and no better row
there is a seed or open; rows that such seeds reach are lost; all others stay open,
to be asked again in blocks that lie elsewhere.  Nothing that is decided can change.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

from .nearest import changes

#: What becomes of a row; UNSURE ones are lost, but a better seed than the one found may turn up.
OPEN, SEED, LOST, UNSURE = range(4)
#: Rows that are decided together, whole blocks of them.
ROWS = 1 << 15
#: So many open rows of a cell mark their neighbours one by one, then the cell marks all of them at once.
MARKS = 16


def decide(block: np.ndarray, x: np.ndarray, y: np.ndarray, ox: np.ndarray, oy: np.ndarray, wide: float, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(state, seed's number or -1) of rows in order of priority; blocks have low corners (ox, oy) and are `wide`."""
    n, width = len(x), (radius if radius > 0 else 1.0) * (1 + 1e-9)
    inner = np.ones(n, bool)
    for at, low in ((x, ox), (y, oy)):
        reach = radius * (1 + 1e-9) + 1e-15 * np.abs(at)
        inner &= (at - low >= reach) & (low + wide - at >= reach)
    side = int(wide / width) + 4
    code = (block * side + np.floor((x - ox) / width).astype(np.int64) + 1) * side + np.floor((y - oy) / width).astype(np.int64) + 1
    by = np.argsort(code, kind="stable")
    place = np.empty(n, np.int64)
    place[by] = np.arange(n)
    code, cells = code[by], np.unique(code, return_inverse=True)
    spans = [(np.searchsorted(code, cells[0] + d * side - 1).tolist(), np.searchsorted(code, cells[0] + d * side + 1, "right").tolist()) for d in (-1, 0, 1)]
    cell, px, py, whole = cells[1].tolist(), x[by], y[by], inner[by]
    lost, blocked = bytearray(n), bytearray(n)
    is_lost, is_blocked = (np.frombuffer(b, np.bool_) for b in (lost, blocked))
    state, seed = np.zeros(n, np.int8), np.full(n, -1)
    sees, r2 = whole.tolist(), radius * radius
    marks, seen = {}, set()
    for p in place.tolist():
        if lost[p]:
            continue
        c, ax, ay = cell[by[p]], px[p], py[p]
        if sees[p] and not blocked[p]:
            for low, high in spans:
                a, b = low[c], high[c]
                if a < b:
                    dx, dy = px[a:b] - ax, py[a:b] - ay
                    new = np.flatnonzero((dx * dx + dy * dy <= r2) & ~is_lost[a:b]) + a
                    is_lost[new], seed[new] = True, by[p]
                    state[new] = np.where(whole[new] & ~is_blocked[new], LOST, UNSURE)
            state[p] = SEED
            continue
        # copies of a place and cells that have marked everything add nothing
        if marks.get(c, 0) > MARKS or (c, ax, ay) in seen:
            continue
        seen.add((c, ax, ay))
        marks[c] = marks.get(c, 0) + 1
        for low, high in spans:
            a, b = low[c], high[c]
            if a < b and marks[c] > MARKS:
                is_blocked[a:b] = True
            elif a < b:
                dx, dy = px[a:b] - ax, py[a:b] - ay
                is_blocked[a:b] |= dx * dx + dy * dy <= r2
    return state[place], seed[place]


def decided(batches: Iterable[pa.RecordBatch], rule: Callable[..., tuple[np.ndarray, np.ndarray]], names: list[str], settled: Sequence[int] = (LOST,)) -> Iterator[pa.RecordBatch]:
    """Rows (x, y, ox, oy, id, rest, the block's columns), block by block, in order of priority: (id, seed, state, rest).

    `rule(block, x, y, ox, oy, rest)` decides; `rest` is dropped from rows in a `settled` state.
    """
    held: list[pa.RecordBatch] = []

    def found(rows: pa.Table, whole: bool) -> tuple[pa.RecordBatch, pa.Table]:
        """What becomes of whole blocks, and the rows of the last one, which may go on."""
        block = np.cumsum(changes([rows.column(i).to_numpy() for i in range(6, rows.num_columns)]))
        n = len(block) if whole else int(np.searchsorted(block, block[-1]))
        now = rows.slice(0, n)
        rest = now.column("rest").combine_chunks()
        state, seed = rule(block[:n], *(now.column(c).to_numpy() for c in ("x", "y", "ox", "oy")), rest)
        own = now.column("id").combine_chunks()
        of = own.take(pa.array(seed, mask=seed < 0))
        rest = rest.take(pa.array(np.arange(n), mask=np.isin(state, settled)))
        return pa.RecordBatch.from_arrays([own, of, pa.array(state), rest], names), rows.slice(n)

    waiting = kept = 0
    for batch in batches:
        held.append(batch)
        waiting += batch.num_rows
        if waiting >= max(ROWS, kept):
            out, left = found(pa.Table.from_batches(held), False)
            yield out
            held, waiting, kept = left.to_batches(), 0, left.num_rows
    if held:
        yield found(pa.Table.from_batches(held), True)[0]
