"""Compression-distance toxicity (operator 8).

Two zstandard dictionaries are trained by zstandard itself, one on ordinary text and
one on toxic text, on the words of it that mark it: all whose share of toxic texts
exceeds that of ordinary ones by a log-likelihood ratio (on all words of toxic texts
a dictionary learns the language that they share with ordinary text).  The toxic compressor
has both dictionaries, the ordinary one only the ordinary, so what tells them apart
is toxic wording.  Every window of a whole text is compressed with both, and the
bytes that the toxic dictionary saves are summarised per text.  A logistic curve,
calibrated on labelled rows that the dictionaries haven't seen, turns the summary
into a score; it also chooses among a few shapes of the toxic dictionary.

The sample's bounds are parameters of `fit` (texts of each class and of calibration,
and bytes of each); a text of any length may be drawn, and scoring reads every text
whole, where it is read.

Defined results: null and empty texts get the score of an empty summary; if the
labelled rows lack one of the classes all scores are the share of toxic rows (0
without any); of several texts with one drawn key the one of least hash is learned
from; repeated rows get equal scores; an empty table gives an empty table.  Only key,
text and label are read, so other columns clash with nothing.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean
from .textcols import slices

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Words of a window; the last of a text takes what is left.
WINDOW = 8
#: Both dictionaries end with it and each window starts with it, so that every window has a match to begin with.
ANCHOR = b"\x01\x02shared-end-of-both-dictionaries\x03\x04"
BASE_BYTES = 8192
#: Shapes of the toxic dictionary that are tried: its bytes, the length of its segments, the log-likelihood ratio that a word must reach.
SHAPES = tuple((size, segment, gain) for size in (512, 1024) for segment in (16, 32) for gain in (12.0, 16.0, 24.0))
#: Orders of the samples that each shape is trained in: what zstandard chooses depends on it.
ORDERS = 3
#: A window counts as marked from this many bytes saved.
MARKED = 3


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    constant: float | None = None


class Meter:
    """Compressed lengths of windows with the two dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.each = [self._compressor(ordinary), self._compressor(toxic)]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        params = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=16, search_log=5, min_match=4, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)

    def saved(self, window: bytes) -> int:
        a, b = self.each
        return len(a.compress(window)) - len(b.compress(window))

    def summary(self, text: str) -> tuple[float, ...]:
        saved = [self.saved(w) for w in windows(text)]
        if not saved:
            return (0.0,) * 6
        n = len(saved)
        top = sorted(saved)[-3:]
        marked = sum(s >= MARKED for s in saved)
        return (top[-1], sum(top) / len(top), sum(saved) / n, marked / n, math.log1p(marked), math.log1p(n))


def windows(text: str) -> list[bytes]:
    words = WORD.findall(text.encode().lower())
    return [b"".join([ANCHOR, b" ", b" ".join(words[i : i + WINDOW]), b" "]) for i in range(0, len(words), WINDOW)]


def _log_chance(k: int, n: int, p: float) -> float:
    """Logarithm of the chance of k hits out of n; 0 at the ends."""
    return (k * math.log(p) if k else 0.0) + ((n - k) * math.log1p(-p) if k < n else 0.0) if 0 < p < 1 else 0.0


def wording(toxic: list[str], ordinary: list[str], least: float) -> list[bytes]:
    """Of each toxic text the words that mark it, in order: those whose log-likelihood ratio of being toxic texts' is `least` or more."""
    words = [WORD.findall(t.encode().lower()) for t in toxic]
    here, there = (Counter(w for t in texts for w in set(t)) for texts in (words, (WORD.findall(t.encode().lower()) for t in ordinary)))
    na, nb = len(toxic), len(ordinary)
    marks = set()
    for w, a in here.items():
        b = there[w]
        if a * nb > b * na:
            both = (a + b) / (na + nb)
            gain = 2 * (_log_chance(a, na, a / na) + _log_chance(b, nb, b / nb) - _log_chance(a, na, both) - _log_chance(b, nb, both))
            if gain >= least:
                marks.add(w)
    kept = ([w for w in t if w in marks] for t in words)
    return [b" " + b" ".join(t) + b" " for t in kept if t]


def _marking(samples: list[bytes], size: int, segment: int, order: int) -> bytes | None:
    """A dictionary trained on toxic wording in one of several orders; None from too few samples."""
    samples = sorted(samples, key=lambda s: hashlib.blake2b(s, digest_size=8, salt=bytes([order])).digest())
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:] or None


def _base(texts: list[str]) -> bytes:
    samples = [w[len(ANCHOR) :] for t in texts for w in windows(t)]
    try:
        return zstandard.train_dictionary(BASE_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        return b"".join(samples)[-BASE_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-6)
        step = np.linalg.solve(h, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _drawn(docs: DataFrame, labels: DataFrame, part: Column, key: str, text: str, label: str, per_class: int, calibration: int, most_bytes: int) -> tuple[float, list[tuple]]:
    """(share of toxic rows, drawn rows (held, label, text)): by hash of their keys, one text a key, bounded in number and bytes of each kind."""
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), part.alias("held")).distinct()
    share = rows.agg(F.avg("label")).head()[0]
    at = F.xxhash64("key")
    drawn = rows.where("held").orderBy(at, "key", "label").limit(calibration)
    for k in (1, 0):
        drawn = drawn.unionByName(rows.where(~F.col("held") & (F.col("label") == k)).orderBy(at, "key").limit(per_class))
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # at most 2 * per_class + calibration rows from here on
    found = texts.join(F.broadcast(drawn), "key").groupBy("held", "label", "key").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    kind = Window.partitionBy("held", F.when(~F.col("held"), F.col("label"))).orderBy(F.xxhash64("key"), "key", "label")
    fits = found.withColumn("_sum", F.sum(F.octet_length("text")).over(kind)).where(F.col("_sum") <= most_bytes)
    return float(share or 0.0), sorted((r["held"], r["key"], r["label"], r["text"]) for r in fits.select("held", "key", "label", "text").collect())


def fit(docs: DataFrame, labels: DataFrame, part: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 1000, calibration: int = 2000, most_bytes: int = 16 << 20) -> Model:
    """Learns from the labelled rows; where `part` (of the labels) holds, they are for calibration only.

    At most `per_class` texts of each class make the dictionaries and at most
    `calibration` texts the curve, and at most `most_bytes` bytes each.  Their keys are
    drawn from the labels by hash, so that only a broadcast of at most 2 * `per_class`
    + `calibration` keys meets the texts, and one text a key comes back.
    """
    share, found = _drawn(docs, labels, part, key, text, label, per_class, calibration, most_bytes)
    toxic, ordinary = (list(dict.fromkeys(t for held, _, y, t in found if not held and y == k)) for k in (1, 0))
    if not toxic or not ordinary:
        return Model(b"", b"", np.zeros(0), np.zeros(0), np.zeros(0), share)
    kept = [(t, y) for held, _, y, t in found if held]
    if len({y for _, y in kept}) < 2:
        kept = [(t, y) for y, texts in ((1, toxic), (0, ordinary)) for t in texts[:calibration]]
    y = np.array([k for _, k in kept], float)
    base = _base(ordinary)
    best = None
    samples = {least: wording(toxic, ordinary, least) for least in {s[2] for s in SHAPES}}
    for (size, segment, least), order in itertools.product(SHAPES, range(ORDERS)):
        marking = _marking(samples[least], size, segment, order) if samples[least] else None
        meter = Meter(base + ANCHOR, (marking or b"") + base + ANCHOR)
        x = np.array([meter.summary(t) for t, _ in kept])
        mean, scale = x.mean(0), x.std(0) + 1e-9
        x = np.column_stack([np.ones(len(x)), (x - mean) / scale])
        w = _logistic(x, y)
        p = np.clip(1 / (1 + np.exp(-x @ w)), 1e-9, 1 - 1e-9)
        loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
        if best is None or loss < best[0]:
            best = (loss, Model(base + ANCHOR, (marking or b"") + base + ANCHOR, w, mean, scale))
    return best[1]


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, windows, marked): the score, how many windows the text has and how many of them are marked."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"`{key}` {dict(docs.dtypes)[key]}, score double, windows long, marked long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        meter = Meter(m.ordinary, m.toxic) if m.constant is None else None
        for batch in (part for whole in batches for part in slices(whole, "text")):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            if meter is None:
                p, n, marked = np.full(len(texts), m.constant), np.zeros(len(texts)), np.zeros(len(texts))
            else:
                x = np.array([meter.summary(t) for t in texts]).reshape(len(texts), 6)
                n, marked = np.expm1(x[:, 5]), np.expm1(x[:, 4])
                z = np.column_stack([np.ones(len(x)), (x - m.mean) / m.scale]) @ m.weights
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array(np.rint(n).astype(np.int64)), pa.array(np.rint(marked).astype(np.int64))], [key, "score", "windows", "marked"])

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(lean(run), schema)
