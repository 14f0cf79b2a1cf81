"""The registered text queries against plain versions of their contracts, on the smallest tables and on planted rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pandas as pd
import public_tokenizers
import pytest
from grainsight.llm import forest, hmm, jpeg, langid, lines, mtree, packing, queries, repeats, toxicity
from grainsight.llm.common import fold
from tokenizers import Tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
DOCS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORDS.findall(text or "")


def planted():
    long = " ".join(f"w{i % 977}x{i % 1013}" for i in range(60_000))
    texts = [None, "", " \n\t ", BASE, BASE, BASE + " phi", "one two", "One TWO", "x " * 40, long, long + " tail", "a b   c", BASE + "\n" + BASE, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich " * 3, "😀 emoji 😀 text \x00 nul", "line one is here today\nline one is here today\nother"]
    return [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module", params=["small", "planted", "empty"])
def docs(request, spark, small, tmp_path_factory):
    """(folder of tables, {doc_id: text})"""
    if request.param == "small":
        folder = small
    else:
        folder = str(tmp_path_factory.mktemp(request.param))
        spark.createDataFrame(planted() if request.param == "planted" else [], DOCS_SCHEMA).write.parquet(f"{folder}/documents.parquet")
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    return folder, {r.doc_id: r.text for r in rows}


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_repeats(spark, docs):
    folder, texts = docs
    first, want = {}, {}
    for i in sorted(texts):
        w = words(texts[i])
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, t in texts.items():
        w = words(t)
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op2_repeats(spark, folder).collect()}
    assert got == want


def test_repeats_texts(spark):
    rows = repeats.dedup(spark.createDataFrame(planted(), DOCS_SCHEMA)).collect()
    assert all(len(words(r.text)) for r in rows if r.doc_id in (3, 9))


def test_near_duplicates(spark, docs):
    folder, texts = docs
    sets = {}
    for i, t in texts.items():
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    common = Counter((a, b) for ids in by.values() for n, a in enumerate(ids) for b in ids[n + 1 :])
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {i: (len(sets[i]), find(i), find(i) == i) for i in texts}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op10_forest(spark, folder).collect()}
    assert got == want


def test_lines(spark, docs):
    folder, texts = docs
    earlier, gone, by = [], defaultdict(list), defaultdict(list)
    for i in sorted(texts):
        for n, line in enumerate((texts[i] or "").split("\n")):
            s = frozenset(words(line.translate(LOWER)))
            if not s:
                continue
            near = {j for t in s for j in by[t]}
            if any(10 * len(s & earlier[j]) >= 8 * len(s | earlier[j]) for j in near):
                gone[i].append(n)
            if s not in earlier:
                earlier.append(s)
                for t in s:
                    by[t].append(len(earlier) - 1)
    got = {r.doc_id: (r.n_lines, r.n_removed, [int(x) for x in r.removed.split(",") if x]) for r in queries.op5_lines(spark, folder).collect()}
    assert {i: x[2] for i, x in got.items()} == {i: gone[i] for i in texts}
    assert {i: x[:2] for i, x in got.items()} == {i: ((t or "").count("\n") + 1, len(gone[i])) for i, t in texts.items()}


def test_bpe(spark, docs):
    folder, texts = docs
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation(), t.no_padding()
    want = {}
    for i, text in texts.items():
        ids = t.encode(text or "", add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want[i] = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op7_bpe(spark, folder).collect()} == want


def test_media(spark, docs):
    folder, texts = docs
    want = {}
    for i, text in texts.items():
        raw = (text or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want[i] = (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    rows = queries.op9_jpeg(spark, folder).collect()
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows} == want
    media = {r.doc_id: bytes(r.media) for r in jpeg.encode(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    assert all(r.media_bytes == len(media[r.doc_id]) and r.media_sha256 == hashlib.sha256(media[r.doc_id]).hexdigest() for r in rows)


def test_hmm(spark, docs):
    folder, texts = docs
    toks = {i: words((t or "").translate(LOWER)) + [None] for i, t in texts.items()}
    counts = Counter(x for i, w in toks.items() if crc(i, 7) != 2 for x in w)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in queries.op4_hmm(spark, folder).collect()}
    assert set(got) == set(texts)
    for i, w in toks.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i, 7) == 2, len(w), sum(x in counts for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_hmm_beats_base(spark, small):
    held = [r for r in queries.op4_hmm(spark, small).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_id(spark, docs):
    folder, texts = docs
    rows = queries.op3_langid(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))


def test_language_id_held_out(spark, small):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    held = [r for r in queries.op3_langid(spark, small).collect() if r.held_out and r.lang_pred != "und" and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def test_toxicity(spark, small):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = queries.op8_toxicity(spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (crc(r.doc_id, 5) == 0) for r in rows)
    held = [r for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.85 * len(held)


def test_search(spark, small, tmp_path):
    import duckdb

    got = queries.op6_mtree(spark, small).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet/*.parquet'" if (__import__("os").path.isdir(f"{small}/embeddings.parquet")) else f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    want = con.execute(queries.ORACLES["op6_mtree"]).df().sort_values(["query_id", "rank"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[sorted(got)], want[sorted(want)], check_dtype=False)


def test_search_edges(spark):
    rows = [(0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [float("nan"), 1.0]), (50, [1.0, -1.0]), (4, [0.5, 0.5])]
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), fold("vec_id", 1) == 0).collect()
    assert {r.query_id for r in got} == {0, 1, 50, 4}
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r.rank)] == [1, 4, 50]


def test_packing(spark, docs):
    folder, texts = docs
    rows = queries.op1_packing(spark, folder).collect()
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.n_tokens
        assert (r.padding is None) == (r.n_tokens == 0) and (r.padding or 0) >= 0
    full = defaultdict(int)  # no words: no batch
    for r in rows:
        full[r.bucket, r.batch] += r.n_tokens + (r.padding or 0)
    assert all(v <= packing.BUDGET for v in full.values())
    assert {i: total[i] for i in texts if total[i]} == {i: len(words(t)) for i, t in texts.items() if words(t)}


def test_clashing_columns(spark):
    """Other columns pass, whatever their names."""
    rows = [(1, BASE, "k", "line"), (2, BASE, None, "x"), (None, None, "key", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, line string")
    assert repeats.dedup(df).columns == df.columns
    assert lines.dedup(df).columns == df.columns
    assert forest.near_duplicates(df).count() == 3
    assert langid.identify(df, langid.train(df.withColumn("lang", df["key"]), fold("doc_id", 1) == 0)).count() == 3
    assert hmm.model_and_score(df, fold("doc_id", 1) == 0).count() == 3
    assert jpeg.decode(jpeg.encode(df)).count() == 3
    assert packing.pack(df).count() >= 2
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.score(df, toxicity.fit(df, labels, fold("doc_id", 5) == 4)).count() == 3


@pytest.mark.parametrize("name", ["op2_repeats", "op5_lines"])
def test_sql(spark, docs, name):
    """The queries' SQL gives their rows."""
    import duckdb

    folder, texts = docs
    if not texts:
        pytest.skip("an empty folder of parts isn't a table for the other engine")
    path = f"{folder}/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path + '/*.parquet' if __import__('os').path.isdir(path) else path}'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, folder).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.astype(str).to_numpy().tolist())) == sorted(map(tuple, want.astype(str).to_numpy().tolist()))
