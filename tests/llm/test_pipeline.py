"""The pipeline's stages against plain versions, each on what the one before it kept."""

import random
import re
from collections import defaultdict

import corpus_pipeline
import pytest
from grainsight.llm import packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def words(text):
    return WORDS.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus():
    rng = random.Random(8)
    langs = {"en": ["the", "of", "and", "river", "house", "under", "morning", "which", "paper", "stone"], "de": ["der", "und", "nicht", "schnell", "zwischen", "über", "straße", "morgen", "werden", "gewiß"]}

    def sentence(lang, n):
        return " ".join(rng.choice(langs[lang]) + (rng.choice(["", "en", "ing", "er", "s"]) if rng.random() < 0.6 else str(rng.randint(0, 300))) for _ in range(n))

    passage = sentence("en", 40)
    rows, parents = [], []
    for i in range(140):
        lang = rng.choice(["en", "de"])
        lines = [sentence(lang, rng.randint(5, 40)) for _ in range(rng.randint(1, 5))]
        if i % 9 == 0:
            lines.append(passage)
        if i % 7 == 0 and parents:
            lines.append(rng.choice(parents).split("\n")[0])
        text = "\n".join(lines)
        if i % 5 == 0 and parents:
            w = rng.choice(parents).replace("\n", " ").split(" ")
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        parents.append(text)
        rows.append((i * 3, text, lang))
    rows += [(rows[4][0], rows[20][1], "en"), rows[6], (None, rows[8][1], "en"), (None, rows[9][1] + " more of it", "de"), (None, None, None), (900, None, "en"), (901, "", "en"), (902, "12 + 34 = 46", "en"), (903, "x" * 5000, None), (904, " \n ", "de"), (905, sentence("en", 6000), "en")]
    return [(i, t, lang, f"s{n % 3}", len(t or "")) for n, (i, t, lang) in enumerate(rows)]


def key(row):
    return LAST if row[0] is None else row[0]


def plain_lines(rows):
    sets = sorted({(key(r), n, frozenset(words(lower(line)))) for r in rows for n, line in enumerate((r[1] or "").split("\n"))}, key=lambda x: x[:2])
    late = {}
    for k, n, s in sets:
        if s:
            late[k, n, s] = any((k2, n2) < (k, n) and 5 * len(s & o) >= 4 * len(s | o) for k2, n2, o in sets)
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for n, x in enumerate(lines) if not late.get((key(r), n, frozenset(words(lower(x)))), False)]
        if len(kept) == len(lines):
            out.append(r)
        elif words("\n".join(kept)):
            out.append((r[0], "\n".join(kept), *r[2:4], len("\n".join(kept))))
    return out


def plain_near(rows):
    """Those whose text's component has no smaller key elsewhere; several rows of the smallest key may stay."""
    sets = []
    for r in rows:
        w = words(lower(r[1]))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(lambda: LAST + 1)
    for i, r in enumerate(rows):
        least[find(i)] = min(least[find(i)], key(r))
    return [(r, find(i)) for i, r in enumerate(rows) if not sets[i] or key(r) == least[find(i)]]


def plain_repeats(rows):
    first = {}
    for r in sorted(rows, key=key):
        w = words(r[1])
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), key(r))
    out = []
    for r in rows:
        w = words(r[1])
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < key(r) for j in range(i, i + 13)}
        if len(gone) < len(w) or not w:
            out.append((r[0], tuple(x for j, x in enumerate(w) if j not in gone), *r[2:4]))
    return out


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage is given and what it returns."""
    docs, out = spark.createDataFrame(corpus(), SCHEMA).repartition(4), []
    for name, stage in corpus_pipeline.STAGES:
        given = sorted((tuple(r) for r in docs.collect()), key=str)
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema if name != "packing" else None)
        out.append((given, sorted((tuple(r) for r in docs.collect()), key=str)))
    return out


def test_language_id(stages):
    given, got = stages[0]
    assert got == [r for r in given if any(map(str.isalpha, r[1] or ""))]


def test_line_dedup(stages):
    given, got = stages[1]
    assert got == sorted(plain_lines(given), key=str) and len(got) < len(given) + 1 and sum(len(r[1] or "") for r in got) < sum(len(r[1] or "") for r in given)


def test_near_dedup(stages):
    given, got = stages[2]
    want = plain_near(given)
    # of rows of one key and unlike texts in one group only one text stays
    assert set(got) <= {r for r, _ in want}
    assert {g for r, g in want if r in set(got)} == {g for _, g in want}
    assert len(got) < len(given)


def test_substring_dedup(stages):
    given, got = stages[3]
    assert sorted(((r[0], tuple(words(r[1])), *r[2:4]) for r in got), key=str) == sorted(plain_repeats(given), key=str)
    assert sum(len(words(r[1])) for r in got) < sum(len(words(r[1])) for r in given) and all(r[4] == len(r[1]) for r in got)


def test_packing(stages):
    given, got = stages[4]
    want = defaultdict(int)
    for r in given:
        n = len(words(r[1]))
        for p in range(max(1, -(-n // packing.MAX_LEN))):
            want[r[0], p, p * packing.MAX_LEN, min(n - p * packing.MAX_LEN, packing.MAX_LEN)] += 1
    seen = defaultdict(int)
    for r in got:
        seen[r[:4]] += 1
    assert seen == want
    by = defaultdict(list)
    for doc, piece, _, n, bucket, batch, slot, padding in got:
        assert bucket is None or (n <= bucket and padding == bucket - n)
        if bucket is not None:
            by[bucket].append((batch, slot, (doc is not None, doc or 0, piece, n)))
    for bucket, members in by.items():
        size = max(1, packing.BUDGET // bucket)
        members.sort()
        assert [(b, s) for b, s, _ in members] == [(i // size, i % size) for i in range(len(members))]
        assert [k for *_, k in members] == sorted(k for *_, k in members)


def test_run(spark, tmp_path):
    """The stages one after the other; of what they write only the last is left."""
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 50 and got.columns[:2] == ["doc_id", "piece"]


def test_empty_and_clashing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([(1, "one two three four five six", "en", "s", 1, 5, "k", 3)], f"{SCHEMA}, key int, tid string, spans int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "tid", "spans"] and docs.count() == 1
