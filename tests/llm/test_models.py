"""Language mixtures against a plain version, toxicity and media on awkward tables."""

import math

import numpy as np
import pyarrow as pa
import pytest
from grainsight.llm import bpe, jpeg, langid, toxicity
from grainsight.sinks import files
from pyspark.sql import functions as F

RNG = np.random.default_rng(6)


def plain_mixture(model, text):
    """Shares of one text: expectation-maximisation and selection, word by word."""
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = ["".join(w) for w in "".join(c if c.isalpha() else " " for c in fold).split()]
    if not words:
        return None
    logs = []
    for w in words:
        raw = b" " + w.encode() + b" "
        grams = [((raw[i - 1] << 16 | raw[i] << 8 | raw[i + 1]) * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for i in range(1, len(raw) - 1)]
        logs.append(sum(model.log_p[g % len(model.log_p)].astype(float) for g in grams))
    p = np.exp(np.maximum(np.array(logs) - np.max(logs, 1, keepdims=True), -200))
    k = p.shape[1]

    def em(share, live, steps):
        share = share * live
        share = share / share.sum()
        for _ in range(steps):
            r = p * share
            r /= r.sum(1, keepdims=True) + 1e-300
            share = (r.sum(0) + 1e-9 * live) / len(words)
            share = share / share.sum()
        return share, np.log((p * share).sum(1) + 1e-300).sum()

    live = np.ones(k)
    share, fit = em(np.full(k, 1 / k), live, langid.EM_STEPS)
    cost = -2 * fit + k * math.log(len(words) + 1)
    for size in range(k - 1, 0, -1):
        out = max((j for j in range(k) if live[j]), key=lambda j: (-share[j], j))
        trial = live.copy()
        trial[out] = 0
        new, fit = em(share + 1e-6, trial, langid.RE_STEPS)
        if -2 * fit + size * math.log(len(words) + 1) > cost:
            break
        live, share, cost = trial, new, -2 * fit + size * math.log(len(words) + 1)
    return share


def test_mixtures(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(docs, F.col("doc_id") % 2 == 0)
    texts = [r.text for r in docs.where("text IS NOT NULL").select(F.substring("text", 1, 600).alias("text")).limit(60).collect()]
    texts += [texts[0] + " " + texts[1], "", "12 34", "a"]
    got = langid.mixtures(model, pa.array(texts))
    for t, row in zip(texts, got, strict=True):
        want = plain_mixture(model, t)
        assert np.allclose(row, 0 if want is None else want, atol=1e-5)


def test_many_languages(spark, monkeypatch):
    """Languages share the table: more of them have fewer buckets each, and none is an error."""
    monkeypatch.setattr(langid, "TABLE", 1 << 14)
    rows = [(i, " ".join([f"{chr(97 + i % 26)}{chr(97 + i // 26)}x"] * 30), f"l{i:02}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, F.lit(True))
    assert len(model.languages) == 40 and len(model.log_p) == langid.LEAST_BUCKETS
    right = langid.identify(df, model).join(df, "doc_id").where("lang_pred = lang").count()
    assert right >= 36


SCHEMA = "doc_id long, text string, toxic int"


def labelled(n=160):
    clean = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        words = list(RNG.choice(clean, 40))
        if i % 3 == 0:
            for k in RNG.integers(0, 40, 6):
                words[k] = str(RNG.choice(["grumblesnort", "vilebrat", "stinkwort"]))
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows


def scored(spark, rows, extra=()):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + list(extra), "doc_id long, text string").withColumns({"score": F.lit("x"), "label": F.lit(1)})
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 4 == 1)
    return [(r.doc_id, r.score, r.windows) for r in toxicity.score(docs, model).collect()]


def test_toxicity(spark):
    rows = labelled()
    long = " ".join(f"w{i % 200}" for i in range(30_000))
    extra = [(None, None), (900, None), (901, ""), (902, long), (903, long + " vilebrat grumblesnort " * 20), (904, rows[3][1]), (3, "another text of a drawn key")]
    got = scored(spark, rows, extra)
    by = {}
    for i, s, _ in got:
        by.setdefault(i, []).append(s)
    assert len(got) == len(rows) + len(extra) and all(0 <= s <= 1 for _, s, _ in got)
    assert np.mean([(by[i][0] >= 0.5) == bool(y) for i, _, y in rows if i != 3]) > 0.95
    assert by[904][0] in by[3] and by[900] == by[901] == by[None]
    assert {i: w for i, _, w in got}[902] == math.ceil(30_000 / toxicity.WINDOW) and by[903][0] > by[902][0]


def test_toxicity_of_one_class(spark):
    """The share of toxic rows; 0 without labels; nothing from an empty table."""
    rows = [(i, f"some text {i}", 1) for i in range(10)]
    assert {s for _, s, _ in scored(spark, rows)} == {1.0}
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, none, F.lit(False))).collect()] == [0.0]
    assert toxicity.score(docs.where("false"), toxicity.fit(docs, none, F.lit(False))).count() == 0


@pytest.mark.parametrize("size", [(48, 64), (37, 51)])
def test_foreign_jpeg(spark, size):
    """Three components, subsampled, with all coefficients: thumbnails are the block means of the luminance."""
    h, w = size
    y, x = np.indices(size)
    rgb = np.stack([128 + 90 * np.sin(y / 9 + x / 13), 128 + 80 * np.cos(x / 11), 100 + y], -1).clip(0, 255).astype(np.uint8)
    media = [files.jpeg(spark, rgb, q) for q in (95, 60)] + [None, jpeg.encode(spark.createDataFrame([(1, "text")], "doc_id long, text string")).head().media]
    df = spark.createDataFrame([(i, 0, bytearray(m) if m else None) for i, m in enumerate(media)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in jpeg.decode(df).collect()}
    luma = rgb.astype(float) @ [0.299, 0.587, 0.114]
    down, across = h // 8, w // 8
    want = luma[: down * 8, : across * 8].reshape(down, 8, across, 8).mean((1, 3))
    for i, slack in ((0, 3), (1, 8)):
        assert (got[i].width, got[i].height) == (w, h)
        pixels = np.frombuffer(bytes(got[i].thumbnail), np.uint8).reshape(-(-h // 8), -(-w // 8))
        assert abs(pixels[:down, :across] - want).max() <= slack
    assert got[2].thumbnail is None and got[2].feature is None and got[3].media_bytes == len(media[3])


def test_bpe_clashing(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "a text", [5], 7), (2, None, None, 8)], "doc_id long, text string, ids array<int>, n_tokens int")
    back = bpe.decode(bpe.encode(docs, path), path).orderBy("doc_id").collect()
    assert [(r.decoded, r.n_tokens) for r in back] == [("a text", 7), ("", 8)]
