"""The line join against brute force: families of similar lines, frequent tokens, split groups, null and repeated keys."""

import random
from collections import defaultdict

import numpy as np
import pytest
from grainsight.llm import lines

SCHEMA = "doc_id long, text string"


def brute(rows):
    """{(doc_id, text): removed line numbers} by comparing each line with all earlier ones."""
    found = defaultdict(list)
    order = sorted((i if i is not None else lines.LAST_KEY, n, line, i, t) for i, t in set(rows) for n, line in enumerate((t or "").split("\n")))
    sets = [(k, n, frozenset(line.lower().split()), i, t) for k, n, line, i, t in order]
    for k, n, s, i, t in sets:
        if s and any((k2, n2) < (k, n) and 5 * len(s & o) >= 4 * len(s | o) for k2, n2, o, _, _ in sets):
            found[i, t].append(n)
    return found


def family(rng, n):
    """Lines around a few parents, from equal to unlike."""
    parents = [[f"p{p}w{i}" for i in range(rng.randint(3, 30))] for p in range(6)]
    out = []
    for k in range(n):
        words = list(rng.choice(parents))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 400)}"
        rng.shuffle(words)
        out.append(" ".join(words))
    return out


def corpus(seed):
    rng = random.Random(seed)
    pool = family(rng, 300) + ["", " ", "a b", "A  b", "the one"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 6)))) for i in range(150)]
    return [*rows, rows[3], (7, rows[9][1]), (None, rows[11][1]), (None, rows[12][1]), (None, None), (200, None), (201, "")]


@pytest.mark.parametrize(("few", "hot", "part"), [(lines.FEW, lines.HOT, lines.PART), (1, 4, 8), (1, 1 << 14, 1 << 20)])
def test_brute_force(spark, few, hot, part):
    """With the production limits, and with small ones so that pairs of tokens, parts and the second round are used."""
    rows = corpus(few * hot)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    got = {(r.key, r.tid): list(r.removed) for r in lines.repeated(lines.keyed(docs, "doc_id", "text"), few, (hot, part)).collect()}
    tids = {(r.key, r.tid): r.text for r in lines.keyed(docs, "doc_id", "text").collect()}
    named = {(None if k == lines.LAST_KEY else k, tids[k, t]): v for (k, t), v in got.items()}
    assert named == {k: v for k, v in want.items()}


def test_large_family(spark):
    """Pairs of a family grow with its size, not with its square."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(1500):
        words = list(base)
        words[rng.randrange(40)] = f"y{i}"
        rows.append((i, " ".join(words)))
    docs = lines.keyed(spark.createDataFrame(rows, SCHEMA), "doc_id", "text")
    shared = spark.sparkContext.broadcast(lines.rarity(docs)[0])
    met = docs.mapInArrow(lines._entries(60, shared), lines.ENTRY_SCHEMA).repartition("place").sortWithinPartitions("place").mapInArrow(lines._pairs(lines.FEW), lines.ENTRY_SCHEMA)
    pairs = met.where("kind < 0").mapInArrow(lines._unpacked({-1: 0, -2: 1}, lines.PAIR), lines.PAIR_SCHEMA).distinct().count()
    assert pairs <= 1500 * 10 * lines.FEW
    gone = lines.removals(spark.createDataFrame(rows, SCHEMA)).where("n_removed = 1").count()
    assert gone == 1499


def test_dedup(spark):
    """Other columns stay, whatever their names; texts that keep no words go."""
    rows = [(1, "one two three four\nx", 5), (2, "ONE two three four", 6), (3, "one two three four\nnew line here now", 7), (4, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed int").withColumnRenamed("removed", "tid")
    got = {tuple(r) for r in lines.dedup(docs).collect()}
    assert got == {(1, "one two three four\nx", 5), (3, "new line here now", 7), (4, None, 8)}


def test_left_out_asks_again():
    """A set of which any pair was left out, by the limit or as less likely than others, may have further partners."""
    rng = np.random.default_rng(4)
    n, zero = 400, np.zeros(400, np.uint64)
    parity = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (n, 6), dtype=np.uint64)) * (rng.random((n, 6)) < 0.6)
    parity = parity[rng.integers(0, 3, n)] ^ np.bitwise_xor.reduce(flips, 1)
    columns = (np.arange(n, dtype=np.uint64) + np.uint64(9), parity, zero, np.full(n, 30 << 32).view(np.uint64), np.arange(n, dtype=np.uint64), zero)

    def pairs(asks, most):
        rows = [np.concatenate([c] * len(asks)) for c in (zero, *columns)]
        group = lines.Group(np.repeat(asks, n), *rows)
        found = [np.concatenate(x) for x in zip(*group.partners(most), strict=True)]
        return list(zip(group.s[found[0]].tolist(), group.s[found[1]].tolist(), found[2].tolist(), strict=True))

    every = {(a, b) for a, b, _ in pairs([False, True], None)}
    few = pairs([False], lines.FEW)
    more = {a for a, _, m in few if m}
    assert len(every) > 2000 and {a for a, _ in every - {(a, b) for a, b, _ in few}} <= more
