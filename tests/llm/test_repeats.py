"""Substring dedup on planted rows: frequent phrases, repeated and null keys."""

import hashlib
import random

import pytest
from grainsight.llm import repeats

PASSAGE = " ".join(f"p{k}" for k in range(30))


def own(i, n):
    return " ".join(f"d{i}x{k}" for k in range(n))


def test_frequent(spark, monkeypatch):
    """A phrase above the bound takes one route, also from tasks that hold none of its slices' first documents."""
    monkeypatch.setattr(repeats, "FREQUENT", 1)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k, "true") for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = [(i, f"{own(i, 20)} {PASSAGE} {own(i + 1000, 5)}") for i in range(60)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(3, "doc_id")
        got = {r.key: r.n_removed for r in repeats.digests(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: 30 if i else 0 for i in range(60)}


def test_copies_of_repeated_keys(spark):
    """A row that equals an earlier document marks no other row of its key."""
    one, two, three = own(1, 40), own(2, 40), own(3, 40)
    rows = [(1, one), (None, one), (None, two), (7, one), (7, three)]
    got = sorted(r.text for r in repeats.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([one, two, three])


def test_frequent_once(spark, monkeypatch):
    """All hits of an anchor agree on whether it is frequent."""
    monkeypatch.setattr(repeats, "FREQUENT", 1)
    rows = [(i, f"{own(i, 20)} {PASSAGE}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(3, "doc_id")
    hits = repeats._anchor_hits(repeats._keyed(docs, "doc_id", "text"), 8, 13).collect()
    assert hits and all(r.frequent for r in hits)


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_brute_force(spark, monkeypatch, hot):
    """Shared passages that overlap, copies, repeated and null keys, texts of all lengths; also with every copied text dealt to parts."""
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(12)
    passages = [[f"s{p}x{k}" for k in range(rng.randint(10, 60))] for p in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.6:
                p = rng.choice(passages)
                a = rng.randrange(len(p))
                words += p[a : a + rng.randint(1, 40)]
            else:
                words += [f"o{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 20))]
        rows.append((rng.choice([None, i, i, i, i // 3]), rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(500 + i, rows[7][1] + " end") for i in range(9)] + [(600 + i, rows[8][1]) for i in range(9)] + [(700, None), (701, ""), rows[3]]
    last = repeats.LAST_KEY
    first = {}
    for k, t in sorted(rows, key=lambda r: last if r[0] is None else r[0]):
        w = (t or "").split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), last if k is None else k)
    want = []
    for k, t in rows:
        w = (t or "").split()
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < (last if k is None else k) for j in range(i, i + 13)}
        want.append((str(k), len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    got = repeats.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sorted((str(r.key), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)


def test_text_once(spark, monkeypatch):
    """Python gets each text in one column and works on small slices of it and small shards; the other columns pass as they are, in their order."""
    seen, shards, ranges = [], [], []
    texts, passages, send = repeats._texts, repeats._passages, repeats._send_anchors
    monkeypatch.setattr(repeats, "_texts", lambda window, names: seen.append(names) or texts(window, names))
    monkeypatch.setattr(repeats, "_passages", lambda n, window: shards.append(n) or passages(n, window))
    monkeypatch.setattr(repeats, "_send_anchors", lambda n, window: ranges.append(n) or send(n, window))
    rows = [(f"s{i}", f"{own(i, 5)} {PASSAGE}", i, [i, None]) for i in range(9)] + [("none", None, 9, None), (None, PASSAGE, 10, [])]
    docs = spark.createDataFrame(rows, "source string, text string, doc_id long, `a b` array<int>")
    out = repeats.dedup(docs)
    assert out.columns == docs.columns and seen == [["c0", "c2", "c3"]]
    assert shards[0] > ranges[0]
    got = sorted((r[2], r[0], r[1].strip(), r[3]) for r in out.collect())
    assert got == [(i, f"s{i}", f"{own(i, 5)} {PASSAGE}" if i == 0 else own(i, 5), [i, None]) for i in range(9)] + [(9, "none", "", None)]
