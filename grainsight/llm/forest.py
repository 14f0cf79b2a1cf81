"""MinHash near-dedup by LSH forest (operator 10).

Documents are linked if their sets of five-word shingles have a Jaccard
similarity of at least `percent` / 100, `PERCENT` if not told; a component is what links reach.

The forest has `TREES` orders of the signatures, each starting at another value and
sorted by it and those that follow.  Documents that stand together in an order and
share its first `DEPTH` values form a region; its first document is the leader, with
which members that resemble it are candidates.  Where a member doesn't resemble its
leader, the whole region goes on, alike members too, to a depth of its own: its
members are sorted by the whole order, neighbours with the longest common prefix are
candidates, up to `PAIRS` members are compared each with each, and a larger region
is cut where the common prefix of neighbours is shortest, until its parts are small
enough or alike, at most to the end of the signature.  A pair at the threshold shares
a prefix of `DEPTH` with a chance of 52 % in each of 32 orders, and so misses all of
them once in 2e10; among so many half-alike documents that regions end at 8 values
it does once in 24,000, and at 12 values once in 120, unless it stands side by side.

Candidates form groups, in which links are confirmed on the full sets: small
groups all at once, in one task each.  In a large group, each member is first
compared with the group's hub, the member that resembles most of those it was dealt
to a part with, wherever the member lies; members that the hub doesn't link are compared
with a block of linked ones, then with more, and only those without a link there
with all the rest of the group, block by block, leaving out members that the
triangle inequality of the Jaccard distance puts out of reach.  No group is
gathered in one task and none is cut.

Equal sets are one class from the start, represented by the row of smallest key and
text digest, so copies add no pairs and rows that share a key stay apart.  All joins are by key, which Spark splits if one is hot.

Defined results: a null or empty text, or one without words, has an empty set and
is its own component; with fewer than five words the whole sequence is the one
shingle; rows that repeat a key share a component if their texts do; rows with a
null key come after all others and have a null component if all of it does; an
empty table gives an empty table.  Only key and text are read, so other columns
clash with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, together
from .textcols import Words, mix, slices

SHINGLE = 5
#: Of a similarity; callers may ask for another one.
PERCENT = 85
TREES = 32
DEPTH = 4
VALUES = TREES * DEPTH
#: A region of no more members is compared each with each.
PAIRS = 512
#: A region of more members is split by joins, a smaller one in one task.
REGION = 4096
#: A group of more members or bytes is compared by hub and blocks.
GROUP = 256
GROUP_BYTES = 16 << 20
#: Blocks of linked members that the others of a group are compared with before all of it, first and then.
SHARES = (1, 4)
#: Parts that a group's rows are dealt to before its size is known.
SALTS = 64
LAST_KEY = (1 << 63) - 1
#: Documents for which it is worth to begin a task in Python: the tasks of small tables are put together, down to one for each core.
TASK = 8192
#: More tasks than tables have partitions.
MANY = 1 << 20
#: Components of no more edges are found in one task.
EDGES = 1 << 18

_rng = np.random.default_rng(20240501)
_A = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's distinct shingles in ascending order, where each text's begin)."""
    w = Words(column, lower=True)
    h, n = w.hashes(), w.counts
    g = w.grams(h, size)
    text = w.text_of()
    whole = np.flatnonzero(text[: len(g)] == text[size - 1 :]) if len(g) else np.zeros(0, np.int64)
    value, of = g[whole], text[whole]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        total = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            more = n[short] > k
            total[more] = mix(total[more] * np.uint64(31) + h[w.first[short[more]] + k] + np.uint64(k + 1))
        value, of = np.concatenate([value, total]), np.concatenate([of, short])
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.append(True, (value[1:] != value[:-1]) | (of[1:] != of[:-1])) if len(value) else np.zeros(0, bool)
    value, of = value[new], of[new]
    return value, np.searchsorted(of, np.arange(len(n) + 1))


def signatures(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """texts x VALUES: the least of each hash function over each set, cut to 16 bits; 0 for empty sets."""
    out = np.zeros((len(first) - 1, VALUES), np.uint16)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        at = first[full]
        for k in range(VALUES):
            out[full, k] = np.minimum.reduceat((value * _A[k] + _B[k]) >> np.uint64(32), at) & np.uint64(0xFFFF)
    return out


def alike_from(percent: int) -> float:
    """Estimated similarity below which two documents aren't candidates: 5 standard errors below what it must be."""
    p = percent / 100
    return p - 5 * math.sqrt(p * (1 - p) / VALUES)


def _of_order(key: np.ndarray, order: np.ndarray | int) -> np.ndarray:
    return key & ~np.uint64(TREES - 1) | np.uint64(order)


def labels(signature: np.ndarray) -> np.ndarray:
    """texts x TREES: the first `DEPTH` values of each order, 14 bits each, so that labels sort as the orders do; the low bits tell the order."""
    out = np.zeros((len(signature), TREES), np.uint64)
    for t in range(TREES):
        for k in range(DEPTH):
            out[:, t] = out[:, t] << np.uint64(14) | signature[:, (t * DEPTH + k) % VALUES].astype(np.uint64) >> np.uint64(2)
    return out << np.uint64(5) | np.arange(TREES, dtype=np.uint64)


def _base(docs: DataFrame) -> DataFrame:
    """(key, tid, n, d1, d2, signature): set sizes, digests of the sets and signatures; docs: (key, text, tid)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value, first = shingle_sets(part.column(1))
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(v, dtype=np.uint64)]) for v in (value, mix(value))]
                d1, d2 = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
                raw = signatures(value, first).view(np.uint8).tobytes()
                width = VALUES * 2
                signature = pa.Array.from_buffers(pa.binary(width), part.num_rows, [None, pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(first).astype(np.int64)), pa.array(d1), pa.array(d2), signature], ["key", "tid", "n", "d1", "d2", "signature"])

    return docs.select("key", "text", "tid").mapInArrow(lean(run), "key long, tid long, n long, d1 long, d2 long, signature binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, VALUES)


def _regions(rows: DataFrame) -> DataFrame:
    """(label, key): a row for each order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = labels(_matrix(batch.column(1))).view(np.int64)
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(np.repeat(keys, TREES))], ["label", "key"])

    return rows.select("key", "signature").mapInArrow(lean(run), "label long, key long")


def _longer(members: DataFrame, rows: DataFrame, depth: int) -> DataFrame:
    """(label, key): members (label, key) of regions of `depth` values by their regions of one value more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                label = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                order = label % np.uint64(TREES)
                value = _matrix(batch.column(2))[np.arange(len(label)), (order.astype(np.int64) * DEPTH + depth) % VALUES]
                found = _of_order(mix(label * np.uint64(31) + value.astype(np.uint64)), order)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), batch.column(1)], ["label", "key"])

    return members.join(rows.select("key", "signature"), "key").select("label", "key", "signature").mapInArrow(lean(run), "label long, key long")


def _alike(pairs: DataFrame, rows: DataFrame, least: float, tasks: int) -> DataFrame:
    """(leader, key, regions, alike): whether the signatures of a pair resemble each other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_matrix(batch.column(3)) == _matrix(batch.column(4))).mean(1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(same >= least)], ["leader", "key", "regions", "alike"])

    of_leader = rows.select(F.col("key").alias("leader"), F.col("signature").alias("s1"))
    both = pairs.join(of_leader, "leader").join(rows.select("key", F.col("signature").alias("s2")), "key")
    return both.select("leader", "key", "regions", "s1", "s2").coalesce(tasks).mapInArrow(lean(run), "leader long, key long, regions array<struct<label:long,members:long>>, alike boolean")


def common_prefix(ordered: np.ndarray) -> np.ndarray:
    """How many values each row of a sorted order shares with the one before; 0 for the first."""
    if not len(ordered):
        return np.zeros(0, np.int64)
    same = ordered[1:] == ordered[:-1]
    return np.append(0, np.where(same.all(1), ordered.shape[1], np.argmin(same, 1)))


def resembling(signature: np.ndarray, order: int, depth: int, least: float) -> Iterator[tuple[int, int]]:
    """(a, b) that connect members of a region of `depth` values that resemble each other.

    Members are sorted by the order; neighbours there, which have the longest common
    prefixes, are compared at once, and parts of the order that share ever longer
    prefixes until they are small or alike.
    """
    turned = np.roll(signature, -order * DEPTH, 1)
    by = np.lexsort(turned.T[::-1])
    ordered = turned[by]
    prefix = common_prefix(ordered)
    near = np.flatnonzero((ordered[1:] == ordered[:-1]).mean(1) >= least)
    yield from zip(by[near].tolist(), by[near + 1].tolist(), strict=True)
    todo = [(0, len(by), depth)]
    while todo:
        low, high, depth = todo.pop()
        part, of = ordered[low:high], by[low:high]
        first = int(np.argmin(of))
        alike = (part == part[first]).mean(1) >= least
        if alike.all():
            yield from ((int(of[first]), int(b)) for b in np.delete(of, first))
        elif high - low <= PAIRS:
            links = np.stack([(part == row).mean(1) >= least for row in part])
            yield from ((int(of[a]), int(of[b])) for b, a in enumerate(_roots(links)) if a != b)
        else:
            yield from ((int(of[first]), int(b)) for b in of[alike] if b != of[first])
            # the next depth at which the part isn't one any more
            inner = prefix[low + 1 : high]
            depth = max(depth + 1, int(inner.min()) + 1)
            cuts = low + 1 + np.flatnonzero(inner < depth)
            edges = [low, *cuts.tolist(), high]
            todo += [(a, b, depth) for a, b in zip(edges, edges[1:], strict=False) if b - a > 1]


def _descend(depth: int, least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (label, key, signature), one region of `depth` values after the other."""
        region, keys, held = None, [], []

        def flush() -> list[tuple[int, int]]:
            if len(keys) < 2:
                return []
            pairs = resembling(np.frombuffer(b"".join(held), np.uint16).reshape(-1, VALUES), region % TREES, depth, least)
            return [(min(keys[a], keys[b]), max(keys[a], keys[b])) for a, b in pairs]

        for batch in batches:
            out: list[tuple[int, int]] = []
            for label, key, signature in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if label != region:
                    out += flush()
                    region, keys, held = label, [], []
                keys.append(key)
                held.append(signature)
            yield _edge_batch(out)
        yield _edge_batch(flush())

    return run


def _tasks(rows: DataFrame) -> int:
    """So many tasks at most for Python functions over a table of a row a document; at large tables more than there are partitions, so that they stay as they are."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK))


def _grouped(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """`together` in at most so many tasks: whole partitions are put together and sorted after that."""
    return together(df, *keys) if tasks >= MANY else df.repartition(F.xxhash64(*keys, F.lit(0))).coalesce(tasks).sortWithinPartitions(*keys)


def candidates(rows: DataFrame, percent: int = PERCENT, tasks: int = MANY) -> DataFrame:
    """(leader, key): pairs of documents of one region that resemble each other."""
    rows = rows.coalesce(tasks)
    regions, depth, found = _regions(rows), DEPTH, []
    least = alike_from(percent)
    while True:
        leaders = regions.groupBy("label").agg(F.min("key").alias("leader"), F.count("*").alias("members")).where("members > 1")
        pairs = regions.join(leaders, "label").where("key > leader").groupBy("leader", "key").agg(F.collect_list(F.struct("label", "members")).alias("regions"))
        near = cut(_alike(pairs, rows, least, tasks).withColumn("regions", F.when(~F.col("alike"), F.col("regions"))))
        found.append(near.where("alike").select("leader", "key"))
        # a region may hold documents of several kinds: all its members go on
        mixed = near.select(F.explode("regions").alias("r")).select("r.*").where("members > 2").distinct()
        members = regions.join(mixed, "label")
        few = members.where(F.col("members") <= REGION).select("label", "key").join(rows.select("key", "signature"), "key").select("label", "key", "signature")
        found.append(_grouped(few, tasks, "label").mapInArrow(lean(_descend(depth, least)), "leader long, key long"))
        if mixed.where(F.col("members") > REGION).isEmpty():
            break
        regions = cut(_longer(members.where(F.col("members") > REGION).select("label", "key"), rows, depth))
        depth += 1
    return reduce(DataFrame.unionByName, found).distinct()


def _slim(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a table of a few numbers a row, in as many partitions as there are cores: rounds over it don't write a file for every shuffle partition."""
    return cut(df.coalesce(df.sparkSession.sparkContext.defaultParallelism))


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b): (smallest node, other node) of each component."""
    above: dict[int, int] = {}

    def root(node: int) -> int:
        while (up := above.setdefault(node, node)) != node:
            above[node] = node = above[up]
        return node

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            low, high = sorted((root(a), root(b)))
            above[high] = low
    yield _edge_batch([(root(node), node) for node in list(above) if root(node) != node])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, by alternating large and small stars; edges: (a, b), a < b.

    Up to `EDGES` edges, one task finds what the stars would.
    """
    now = _slim(edges.select("a", "b").distinct())
    small_enough = now.count() <= EDGES
    if small_enough:
        now = _slim(now.coalesce(1).mapInArrow(lean(_stars), "a long, b long"))
    mark = None
    while not small_enough:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # each node and its smaller neighbours come to the smallest of those
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(small, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        now = _slim(joined.unionByName(small.select(F.col("m").alias("a"), "b")).distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


class _Group:
    """Full sets of some documents, and which pairs of them are linked."""

    def __init__(self, texts: list[str]):
        value, first = shingle_sets(pa.array(texts, pa.string()))
        self.size = np.diff(first)
        self.of = np.repeat(np.arange(len(texts)), self.size)
        _, self.shingle = np.unique(value, return_inverse=True)

    def shared(self, a: slice, b: slice, step: int = 4096) -> np.ndarray:
        """Sizes of the intersections of the sets numbered a with those numbered b."""
        n = len(self.size)
        out = np.zeros((len(range(n)[a]), len(range(n)[b])))
        order = np.argsort(self.shingle, kind="stable")
        shingle, of = self.shingle[order], self.of[order]
        for low in range(0, int(shingle[-1]) + 1 if len(shingle) else 0, step):
            i, j = np.searchsorted(shingle, [low, low + step])
            there = np.zeros((n, step), np.float32)
            there[of[i:j], shingle[i:j] - low] = 1
            out += there[a] @ there[b].T
        return out

    def linked(self, a: slice, b: slice, percent: int) -> np.ndarray:
        both = self.shared(a, b)
        union = self.size[a][:, None] + self.size[b][None, :] - both
        return 100 * both >= percent * union


def _roots(links: np.ndarray) -> np.ndarray:
    """The first member of each member's component, from a matrix of links."""
    root = np.arange(len(links))
    while True:
        least = np.where(links, root[None, :], len(links)).min(1)
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _small_groups(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (group, key, text), one group after the other: (a, b) edges from the first to each other member of a component."""
    group, keys, texts = None, [], []

    def flush() -> list[tuple[int, int]]:
        if len(keys) < 2:
            return []
        order = np.argsort(keys, kind="stable")
        g = _Group([texts[i] for i in order])
        root = _roots(g.linked(slice(None), slice(None), percent))
        return [(keys[order[r]], keys[order[i]]) for i, r in enumerate(root) if r != i]

    out: list[tuple[int, int]] = []
    for batch in batches:
        for c, k, t in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != group:
                out += flush()
                group, keys, texts = c, [], []
            keys.append(k)
            texts.append(t)
        yield _edge_batch(out)
        out = []
    out += flush()
    yield _edge_batch(out)


def _edge_batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], ["a", "b"])


def _against_hub(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (group, key, text, hub, hub_text): the distance to the hub, and whether it links."""
    known: tuple = (None, None)
    for batch in (part for whole in batches for part in slices(whole, "text")):
        distance, links = [], []
        value, first = shingle_sets(batch.column(2))
        for i, (hub, text) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
            if known[0] != hub:
                known = (hub, shingle_sets(pa.array([text], pa.string()))[0])
            mine = value[first[i] : first[i + 1]]
            at = np.minimum(np.searchsorted(known[1], mine), len(known[1]) - 1)
            both = int((known[1][at] == mine).sum())
            union = len(mine) + len(known[1]) - both
            distance.append(1 - both / union)
            links.append(100 * both >= percent * union)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array(distance, pa.float64()), pa.array(links, pa.bool_())], ["group", "key", "hub", "distance", "links"])


def _blocks(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, asks, key, joined, text), one block after the other: links of those that ask with the others.

    `joined` members are linked with their hub already, so one link with any of
    them is enough.
    """
    block, rows = None, []

    def flush() -> list[tuple[int, int]]:
        asks, rest = [r for r in rows if r[0]], [r for r in rows if not r[0]]
        if not asks or not rest:
            return []
        g = _Group([r[3] for r in (*asks, *rest)])
        links = g.linked(slice(0, len(asks)), slice(len(asks), None), percent)
        keys, joined = np.array([r[1] for r in rest], np.int64), np.array([r[2] for r in rest])
        found = []
        for i, row in enumerate(links):
            mine = np.flatnonzero(row & (keys != asks[i][1]))
            once = mine[joined[mine]][:1]
            found += [(min(asks[i][1], int(k)), max(asks[i][1], int(k))) for k in keys[np.concatenate([once, mine[~joined[mine]]])]]
        return found

    for batch in batches:
        out: list[tuple[int, int]] = []
        for b, asks, key, joined, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if b != block:
                out += flush()
                block, rows = b, []
            rows.append((asks, key, joined, text))
        yield _edge_batch(out)
    yield _edge_batch(flush())


def _dense(least: float):
    """Rows (group, part, key, signature), one part after the other: (group, key, n), how many of its part each member resembles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, held = None, [], []

        def flush() -> pa.RecordBatch:
            s = np.frombuffer(b"".join(held), np.uint16).reshape(-1, VALUES)
            n = [int(((s == row).mean(1) >= least).sum()) for row in s]
            return pa.RecordBatch.from_arrays([pa.array([part[0] if part else 0] * len(n), pa.int64()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["group", "key", "n"])

        for batch in batches:
            for g, p, key, signature in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, p) != part:
                    yield flush()
                    part, keys, held = (g, p), [], []
                keys.append(key)
                held.append(signature)
        yield flush()

    return run


def _spread(group: DataFrame, parts: Column) -> DataFrame:
    """Rows of groups, one for each part that their members are dealt to."""
    return group.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))


def _large_groups(members: DataFrame, rows: DataFrame, percent: int, tasks: int = MANY) -> DataFrame:
    """Links (a, b) that connect the components of large groups; members: (group, key, text).

    Members are dealt to parts of about `GROUP`, with which what belongs to the whole
    group is joined, so a group's size shows in the number of its parts only.
    """
    counts = members.groupBy("group").agg(F.count("*").alias("members"))
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    at = members.select("group", "key", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["group", "salt"])
    dealt = _slim(at.select("group", "key", F.pmod(F.xxhash64("key"), F.ceil(F.col("members") / GROUP)).cast("int").alias("part")))
    # the hub: who resembles most of the part that it was dealt to
    signed = dealt.join(rows.select("key", "signature"), "key").select("group", "part", "key", "signature")
    dense = _grouped(signed, tasks, "group", "part").mapInArrow(lean(_dense(alike_from(percent))), "group long, key long, n long")
    hubs = dense.groupBy("group").agg(F.max(F.struct("n", (-F.col("key")).alias("k"))).alias("best")).select("group", (-F.col("best.k")).alias("hub")).join(counts, "group")
    hub_texts = hubs.join(members.select(F.col("key").alias("hub"), F.col("text").alias("hub_text")), "hub")
    parts = F.ceil(F.col("members") / GROUP).cast("int")
    seen = members.select("key", "text").join(dealt, "key").join(_spread(hub_texts, parts).drop("members"), ["group", "part"]).select("group", "key", "text", "hub", "hub_text")
    judged = _slim(seen.coalesce(tasks).mapInArrow(lean(lambda batches: _against_hub(batches, percent)), "group long, key long, hub long, distance double, links boolean"))
    star = judged.where("links AND key <> hub").select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b"))
    own, texts, found = F.xxhash64("key"), members.select("key", "text"), [star]
    state = _slim(judged.join(dealt, ["group", "key"]).select("group", "key", "part", "distance", "links"))
    # those that the hub doesn't link, against a few blocks of those that are linked: one link is enough
    for share in SHARES:
        split = state.groupBy("group").agg(F.sum(F.col("links").cast("int")).alias("joined"), F.sum((~F.col("links")).cast("int")).alias("asking")).where("joined > 0 AND asking > 0")
        here = state.join(_spread(split.join(counts, "group"), parts).drop("members"), ["group", "part"])
        many, few = F.ceil(F.col("asking") / GROUP).cast("int"), F.ceil(F.col("joined") / (GROUP * share)).cast("int")
        asking = here.where("NOT links").select("group", "key", F.pmod(own, many).cast("int").alias("i"), F.lit(True).alias("asks"), F.lit(False).alias("joined"))
        asked = here.where("links").withColumn("j", F.pmod(F.xxhash64("key", F.lit(share)), few).cast("int")).where(F.col("j") < many)
        asked = asked.select("group", "key", F.explode(F.sequence(F.col("j"), many - 1, few)).alias("i"), F.lit(False).alias("asks"), F.lit(True).alias("joined"))
        both = asking.unionByName(asked).join(texts, "key").select(F.xxhash64("group", "i").alias("block"), "asks", "key", "joined", "text")
        edges = _slim(_grouped(both, tasks, "block").mapInArrow(lean(lambda batches: _blocks(batches, percent)), "a long, b long"))
        found.append(edges)
        linked = edges.select(F.explode(F.array("a", "b")).alias("key")).distinct().withColumn("now", F.lit(True))
        state = _slim(state.join(linked, "key", "left").withColumn("links", F.col("links") | F.coalesce("now", F.lit(False))).select("group", "key", "part", "distance", "links"))
    # the few that are left against all of the group that may be near them
    reach = 1 - percent / 100 + 1e-9
    nearest = state.where("NOT links").groupBy("group").agg(F.min("distance").alias("least"), F.count("*").alias("asking"))
    rest = state.join(_spread(nearest.join(counts, "group"), parts).drop("members"), ["group", "part"]).where(F.col("distance") >= F.col("least") - reach)
    sizes = nearest.join(rest.groupBy("group").agg(F.count("*").alias("rest")), "group").join(counts, "group")
    many = F.ceil(F.col("asking") / GROUP).cast("int")
    blocks = F.ceil(F.col("rest") / GROUP).cast("int")
    block = [F.col("group"), F.col("i"), F.col("j")]
    known = _slim(rest.select("group", "part", "key", "links").join(_spread(sizes, parts).select("group", "part", "asking", "rest"), ["group", "part"]))
    asking = known.where("NOT links").select("group", "key", F.pmod(own, many).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("joined"))
    asked = known.select("group", "key", F.explode(F.sequence(F.lit(0), many - 1)).alias("i"), F.pmod(own, blocks).cast("int").alias("j"), F.lit(False).alias("asks"), F.col("links").alias("joined"))
    both = asking.unionByName(asked).join(texts, "key").select(F.xxhash64(*block).alias("block"), "asks", "key", "joined", "text")
    found.append(_grouped(both, tasks, "block").mapInArrow(lean(lambda batches: _blocks(batches, percent)), "a long, b long"))
    return reduce(DataFrame.unionByName, found)


def row_key(key: str, text: str) -> tuple[Column, Column]:
    """(key, digest of the text): what rows are told apart by, as keys may repeat or be null."""
    return F.coalesce(F.col(key).cast("long"), F.lit(LAST_KEY)), F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _found(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """(key, tid, n, least) of each row; least: the (key, tid) that comes first in its component."""
    row, digest = row_key(key, text)
    rows = docs.select(row.alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), digest.alias("tid"))
    base = cut(_base(rows).withColumn("class", F.xxhash64("n", "d1", "d2")).drop("d1", "d2"))
    full = base.where("n > 0")
    classes = full.groupBy("class").agg(F.min(F.struct("key", "tid")).alias("first"))
    own = cut(full.dropDuplicates(["class"]).select(F.col("class").alias("key"), "signature"))
    tasks = _tasks(own)
    groups = components(candidates(own, percent, tasks).select(F.col("leader").alias("a"), F.col("key").alias("b")))
    firsts = groups.join(classes.withColumnRenamed("class", "node"), "node").select("node", "root", "first.key", "first.tid")
    members = cut(firsts.join(rows, ["key", "tid"]).select(F.col("root").alias("group"), F.col("node").alias("key"), "text").dropDuplicates(["key"]))
    sizes = members.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    large = sizes.where((F.col("n") > GROUP) | (F.col("bytes") > GROUP_BYTES)).select("group")
    small = members.join(large, "group", "left_anti").select("group", "key", "text")
    few = _grouped(small, tasks, "group").mapInArrow(lean(lambda batches: _small_groups(batches, percent)), "a long, b long")
    many = _large_groups(members.join(large, "group", "left_semi").select("group", "key", "text"), own, percent, tasks)
    roots = components(few.unionByName(many)).withColumnsRenamed({"node": "class"})
    by_class = classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = by_class.groupBy("root").agg(F.min("first").alias("least"))
    by_class = by_class.join(least, "root").select("class", "least")
    # empty sets have no class
    found = base.select("key", "tid", "n", F.when(F.col("n") > 0, F.col("class")).alias("class")).join(by_class, "class", "left")
    return found.select("key", "tid", "n", F.coalesce("least", F.struct("key", "tid")).alias("least"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component, kept) of each row of `docs`."""
    found = _found(docs, key, text, percent).select("key", "n", F.col("least.key").alias("component"))
    return found.select(F.nullif("key", F.lit(LAST_KEY)).alias("key"), F.col("n").alias("n_shingles"), F.nullif("component", F.lit(LAST_KEY)).alias("component"), (F.col("key") == F.col("component")).alias("kept"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """`docs` without those that aren't the first of their component; rows equal in key and text count as one."""
    kept = _found(docs, key, text, percent).where(F.struct("key", "tid") == F.col("least")).select(F.col("key").alias("_k"), F.col("tid").alias("_t")).distinct()
    row, digest = row_key(key, text)
    return docs.join(kept, (row == F.col("_k")) & (digest == F.col("_t")), "left_semi").select(*docs.columns)
