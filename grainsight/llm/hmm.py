"""Hidden Markov language model (operator 4).

A text is its words (A-Z in lower case) and an end token.  States emit word
classes: the most frequent words are classes of their own, all others share
classes by their endings, and a word's share of its class comes from its exact
count, with one part left for unknown words.  So a state's emissions have a fixed
size whatever the vocabulary, and sum to one.

Training: word counts cover all training texts.  Their class sequences are written
once, two bytes a token, and all steps read those.  Baum-Welch runs over all of them
in every partition, which sends its expected counts, of fixed size, to be added up:
first `PASSES` passes in `FOLDS` steps each, every step over the texts of one fold
with the parameters that the one before left, then `ROUNDS` rounds over all texts.
No text is left out and the number of steps doesn't depend on the corpus.

Texts of any length count whole.  They are worked on in stretches of `STRETCH`
tokens, all in lockstep: a scaled product of each stretch's matrices, from the state
before it to the state at its end, carries the forward and backward messages across
the stretches of a text, so counts and likelihoods are those of the whole sequence.
Words beyond the broadcast table of frequent ones (`FREQUENT`, a fixed bound) meet
their counts in a join.

Defined results: a null or empty text is one end token; a text of any length is
scored whole; repeated rows, also of one key, get a row each; without training
texts every count is 0; an empty table gives an empty table.  Only key and text
are read, so other columns clash with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import VECTOR_SCHEMA, cut, lean, sum_vectors, vector_rows
from .textcols import Words, mix, slices

STATES = 8
FOLDS = 4
PASSES = 3
ROUNDS = 2
#: Bytes of text that a task works on at once.
SLICE = 2 << 20
STRETCH = 512
#: Tokens of one fold's texts in a row of class sequences, about; a longer text is a row of its own length.
BLOCK = 400_000
#: Words whose counts every task holds, at most.
FREQUENT = 1 << 18
#: Words that are classes of their own, at most.
OWN = 2048
#: Classes by ending.
ENDINGS = 2048
CLASSES = 1 + OWN + ENDINGS
#: Words that a counting task gathers before it adds them up.
GATHER = 2_000_000
#: Strength of a state's prior on emissions, in tokens.
PRIOR = 50.0


def ending_class(w: Words) -> np.ndarray:
    """Class number of each word by its last bytes."""
    size = w.end - w.start
    key = np.minimum(size, 4).astype(np.uint64) << np.uint64(24)
    for k in (1, 2, 3):
        byte = w.data[np.maximum(w.end - k, 0)].astype(np.uint64)
        key |= np.where(size >= k, byte, 0).astype(np.uint64) << np.uint64(8 * (k - 1))
    return (1 + OWN + (mix(key) % np.uint64(ENDINGS)).astype(np.int64)).astype(np.int32)


class HashTable:
    """64-bit hash -> small integer, by open addressing in numpy."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4 - 1).bit_length()) if len(keys) else 4
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, step = np.arange(len(keys)), np.uint64(0)
        self.probes = 0
        while len(left):
            at = (keys[left] + step & self.mask).astype(np.int64)
            free = self.values[at] < 0
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[at[won]], self.values[at[won]] = keys[left[won]], values[left[won]]
            left = np.delete(left, won)
            step += np.uint64(1)
            self.probes += 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """The values; -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        left, step = None, np.uint64(0)
        for _ in range(self.probes):
            ask = h if left is None else h[left]
            at = (ask + step & self.mask).astype(np.int64)
            value = self.values[at]
            hit = (self.keys[at] == ask) & (value >= 0)
            if left is None:
                out[hit] = value[hit]
                left = np.flatnonzero(~hit & (value >= 0))
            else:
                out[left[hit]] = value[hit]
                left = left[~hit & (value >= 0)]
            if not len(left):
                break
            step += np.uint64(1)
        return out


@dataclass
class Vocabulary:
    """Corpus counts of bounded size: totals, the frequent words and the classes."""

    tokens: int
    distinct: int
    texts: int
    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    mass: np.ndarray  # training tokens by class
    room: np.ndarray  # log10 of the denominator of a word's share of its class
    table: HashTable = field(init=False)

    def __post_init__(self):
        self.table = HashTable(self.hashes, np.arange(len(self.hashes), dtype=np.int32))
        self.log_count = np.log10(self.counts + 1.0)


@dataclass
class Parameters:
    """start: state distribution of a text's first token; move: states x states; emit: states x classes."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def count_words(docs: DataFrame) -> DataFrame:
    """(h, ending, n): each word's count, over all texts."""

    def add(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.concatenate([p[0] for p in parts])
        found, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(inverse, np.concatenate([p[2] for p in parts]), len(found)).astype(np.int64)
        return found, np.concatenate([p[1] for p in parts])[first], n

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                w = Words(part.column(1), lower=True)
                if not len(w):
                    continue
                h, first, n = np.unique(w.hashes(), return_index=True, return_counts=True)
                parts.append((h, ending_class(w)[first], n))
                held += len(h)
                if held > GATHER:
                    parts = [add(parts)]
                    held = len(parts[0][0])
                    if held > GATHER // 2:
                        yield _count_batch(parts.pop())
                        held = 0
        if parts:
            yield _count_batch(add(parts))

    rows = docs.mapInArrow(lean(run), "h long, ending int, n long")
    return rows.groupBy("h").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


def _count_batch(p: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(p[0].view(np.int64)), pa.array(p[1].astype(np.int32)), pa.array(p[2].astype(np.int64))], ["h", "ending", "n"])


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """What every task needs to know of the counts; the driver gets at most `FREQUENT` words."""
    level = F.floor(F.log2("n") * 64).cast("int")
    by_level = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    tokens = sum(r["n"] for r in by_level) + texts
    distinct = sum(r["words"] for r in by_level) + (texts > 0)
    least, seen = 1 << 30, 0
    for r in sorted(by_level, key=lambda r: -r["level"]):
        seen += r["words"]
        if seen > FREQUENT:
            break
        least = r["level"]
    top = counts.where(level >= least).select("h", "ending", "n").toPandas()
    top = top.sort_values(["n", "h"], ascending=[False, True])
    h, ending, n = top["h"].to_numpy(np.int64).view(np.uint64), top["ending"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    mass, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        mass[r["ending"]], words[r["ending"]] = r["n"], r["words"]
    own = min(OWN, len(h))
    np.subtract.at(mass, ending[:own], n[:own])
    np.subtract.at(words, ending[:own], 1)
    classes = ending.copy()
    classes[:own] = np.arange(1, own + 1)
    room = np.log10(mass + words + 1.0)
    mass[1 : own + 1], mass[0] = n[:own], texts
    return Vocabulary(tokens, distinct, texts, h, n, classes.astype(np.int32), mass, room)


class Sequences:
    """Class sequences of texts, one after the other; sizes count the end tokens."""

    def __init__(self, size: np.ndarray, classes: np.ndarray):
        self.size, self.classes = size, classes
        self.first = np.concatenate([[0], np.cumsum(size)])

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, number of the text) of stretches of at most `STRETCH` tokens, in order."""
        per = -(-self.size // STRETCH)
        text = np.repeat(np.arange(len(per)), per)
        k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        start = self.first[text] + k * STRETCH
        return start, np.minimum(STRETCH, self.first[text + 1] - start), text


class Tokens(Sequences):
    """A slice's texts as class sequences, with an end token after each text."""

    def __init__(self, column: pa.Array, v: Vocabulary):
        w = Words(column, lower=True)
        self.hash = w.hashes()
        at = v.table.find(self.hash)
        self.frequent = at >= 0
        self.place = np.maximum(at, 0)
        classes = ending_class(w)
        if len(v.hashes):
            classes = np.where(self.frequent, v.classes[self.place], classes)
        self.words = w
        size = w.counts + 1
        super().__init__(size, np.zeros(int(size.sum()), np.int32))
        self.classes[np.arange(len(w)) + w.text_of()] = classes
        self.word_class = classes


class Lanes:
    """A slice's stretches, longest first, for recursions in lockstep."""

    def __init__(self, tokens: Sequences):
        start, length, text = tokens.stretches()
        order = np.argsort(-length, kind="stable")
        self.start, self.length, self.text = start[order], length[order], text[order]
        self.first = self.start == tokens.first[self.text]
        self.last = self.start + self.length == tokens.first[self.text + 1]
        self.steps = int(self.length[0]) if len(order) else 0
        self.live = np.searchsorted(-self.length, -np.arange(1, self.steps + 1), side="right")
        self.number = (self.start - tokens.first[self.text]) // STRETCH
        # lane of each text's k-th stretch, text by text
        self.lane = np.argsort(order, kind="stable")
        self.of_text = np.searchsorted(text, np.arange(len(tokens.size) + 1))
        self.tokens = tokens

    def classes(self, t: int) -> np.ndarray:
        """Classes of the t-th tokens of all stretches that are so long."""
        return self.tokens.classes[self.start[: self.live[t]] + t]

    def products(self, p: Parameters, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(matrix, logarithm of its scale) of the stretches `which`: from the state before to the state at the end; a text's first starts in no move."""
        s, emit = len(p.start), np.ascontiguousarray(p.emit.T)
        lanes = np.flatnonzero(which)
        whole, log = np.zeros((len(self.start), s, s)), np.zeros(len(self.start))
        start, length, first = self.start[lanes], self.length[lanes], self.first[lanes]
        m = np.broadcast_to(np.eye(s), (len(lanes), s, s)).copy()
        for t in range(int(length[0]) if len(lanes) else 0):
            n = int(np.searchsorted(-length, -t, side="left"))  # longer than t
            if n < len(m):
                whole[lanes[n : len(m)]] = m[n:]
                m = m[:n]
            m = (m.reshape(-1, s) @ p.move).reshape(n, s, s) if t else np.where(first[:n, None, None], m, p.move)
            m *= emit[self.tokens.classes[start[:n] + t]][:, None, :]
            if t % 8 == 7 or t == length[0] - 1:
                top = m.max((1, 2))
                m /= top[:, None, None]
                log[lanes[:n]] += np.log(top)
        whole[lanes[: len(m)]] = m
        return whole, log

    def rounds(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(lanes, texts) of all texts' k-th stretches, for k from 0 on."""
        for k in range(int(self.number.max()) + 1 if len(self.number) else 0):
            text = np.flatnonzero(np.diff(self.of_text) > k)
            yield self.lane[self.of_text[text] + k], text


def expected_counts(tokens: Sequences, p: Parameters) -> dict[str, np.ndarray]:
    """Baum-Welch counts of one slice: forward and backward over whole texts, all stretches in lockstep."""
    lanes, s = Lanes(tokens), len(p.start)
    emit, one = np.ascontiguousarray(p.emit.T), np.ones(s)
    # messages across stretches, for texts that have several
    before, after = np.zeros((len(lanes.start), s)), np.ones((len(lanes.start), s))
    if not lanes.last.all():
        whole, _ = lanes.products(p, ~(lanes.first & lanes.last))
        rounds = list(lanes.rounds())
        state = np.broadcast_to(p.start, (len(tokens.size), s)).copy()
        for at, text in rounds:
            before[at] = state[text]
            some = ~lanes.last[at] | ~lanes.first[at]
            a = (state[text[some]][:, None, :] @ whole[at[some]])[:, 0, :]
            state[text[some]] = a / a.sum(1, keepdims=True)
        state = np.ones((len(tokens.size), s))
        for at, text in rounds[:0:-1]:
            after[at] = state[text]
            b = (whole[at] @ state[text][:, :, None])[:, :, 0]
            state[text] = b / b.sum(1, keepdims=True)
        at, text = rounds[0]
        after[at] = state[text]
    alpha, seen, a = [], [], None
    for t in range(lanes.steps):
        n, c = lanes.live[t], lanes.classes(t)
        e = emit[c]
        a = np.where(lanes.first[:, None], p.start, before @ p.move) * e if t == 0 else (a[:n] @ p.move) * e
        a /= (a @ one)[:, None]
        alpha.append(a)
        seen.append((c, e))
    move, chances = np.zeros((s, s)), []
    beta = after
    for t in range(lanes.steps - 1, -1, -1):
        n = lanes.live[t]
        if t + 1 < lanes.steps and lanes.live[t + 1]:
            m = lanes.live[t + 1]
            be = beta[:m] * seen[t + 1][1]
            move += _moves(alpha[t][:m], be, p)
            back = be @ p.move.T
            beta[:m] = back / (back @ one)[:, None]
        g = alpha[t] * beta[:n]
        g /= (g @ one)[:, None]
        chances.append(g)
    classes = np.concatenate([c for c, _ in reversed(seen)]) if seen else np.zeros(0, np.int32)
    every = np.concatenate(chances) if chances else np.zeros((0, s))
    counts = np.stack([np.bincount(classes, every[:, k], CLASSES) for k in range(s)])
    if lanes.steps and not lanes.first.all():  # the moves between stretches
        later = ~lanes.first
        move += _moves(before[later], (beta * seen[0][1])[later], p)
    return {"start": g[lanes.first].sum(0) if lanes.steps else np.zeros(s), "move": (move * p.move).ravel(), "emit": counts.ravel()}


def _moves(alpha: np.ndarray, be: np.ndarray, p: Parameters) -> np.ndarray:
    """Expected moves from states `alpha` to states weighed by `be`, but for the factor of the move itself."""
    norm = ((alpha @ p.move) * be) @ np.ones(len(p.start))
    return (alpha / norm[:, None]).T @ be


def _added(total: dict[str, np.ndarray], more: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: total[k] + v for k, v in more.items()} if total else more


def maximise(counts: dict[str, np.ndarray], mass: np.ndarray) -> Parameters:
    """New parameters from expected counts; every class keeps some chance in every state."""
    s = len(counts["start"])
    common = (mass + 1) / (mass.sum() + len(mass))
    emit = counts["emit"].reshape(s, -1) + PRIOR * common
    move = counts["move"].reshape(s, s) + 1.0
    start = counts["start"] + 0.1
    return Parameters(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def first_guess(mass: np.ndarray, states: int) -> Parameters:
    noise = np.random.default_rng(7).gamma(2.0, 0.5, (states, len(mass)))
    emit = noise * (mass + 1)
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    return Parameters(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """(fold, size, classes) of all texts of (id, text): the class sequences of one fold's texts in a partition, in rows of about `BLOCK` tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(FOLDS)]

        def flush(k: int) -> pa.RecordBatch:
            size, classes = (np.concatenate([x[i] for x in held[k]]).tobytes() for i in range(2))
            held[k].clear()
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([size], pa.binary()), pa.array([classes], pa.binary())], ["fold", "size", "classes"])

        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                tokens, fold = Tokens(piece.column(0), shared.value), piece.column(1).to_numpy()
                classes, of = tokens.classes.astype(np.uint16), np.repeat(fold, tokens.size)
                for k in np.unique(fold).tolist():
                    held[k].append((tokens.size[fold == k].astype(np.int64), classes[of == k]))
                    if sum(len(x[1]) for x in held[k]) >= BLOCK:
                        yield flush(k)
        yield from (flush(k) for k in range(FOLDS) if held[k])

    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")
    return docs.select("text", fold.alias("fold")).mapInArrow(lean(run), "fold int, size binary, classes binary")


def train(docs: DataFrame, v: Vocabulary, states: int = STATES, passes: int = PASSES, rounds: int = ROUNDS) -> Parameters:
    """Baum-Welch over all texts: passes fold by fold, then rounds over all at once; docs: (id, text)."""
    p = first_guess(v.mass, states)
    steps = [*(k for _ in range(passes) for k in range(FOLDS)), *[None] * rounds]
    if not v.texts or not steps:
        return p
    sc = docs.sparkSession.sparkContext
    encoded = cut(encode(docs, v))
    for step in steps:
        now = sc.broadcast(p)

        def run(batches: Iterable[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                for size, classes in zip(*batch.columns, strict=True):
                    texts = Sequences(np.frombuffer(size.as_buffer(), np.int64), np.frombuffer(classes.as_buffer(), np.uint16).astype(np.int32))
                    total = _added(total, expected_counts(texts, now.value))
            yield from vector_rows(total)

        chosen = encoded if step is None else encoded.where(F.col("fold") == step)
        counts = sum_vectors(chosen.select("size", "classes").mapInArrow(lean(run), VECTOR_SCHEMA))
        p = maximise(counts, v.mass) if counts else p
        now.unpersist()
    return p


def log10_likelihood(tokens: Sequences, p: Parameters) -> np.ndarray:
    """log10 of the chance of each text's class sequence, by scaled forward recursion."""
    lanes = Lanes(tokens)
    whole, log = lanes.products(p, np.ones(len(lanes.start), bool))
    out = np.zeros(len(tokens.size))
    state = np.broadcast_to(p.start, (len(out), len(p.start))).copy()
    for at, text in lanes.rounds():
        a = (state[text][:, None, :] @ whole[at])[:, 0, :]
        total = a.sum(1)
        state[text] = a / total[:, None]
        out[text] += np.log(total) + log[at]
    return out / math.log(10)


def score(docs: DataFrame, counts: DataFrame, v: Vocabulary, p: Parameters) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of each row of (id, text)."""
    sc = docs.sparkSession.sparkContext
    shared, model = sc.broadcast(v), sc.broadcast(p)
    kind = dict(docs.dtypes)["id"]
    schema = f"id {kind}, n_tokens long, known long, base double, score double, rare array<long>, times array<int>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = shared.value, model.value
        end = math.log10(v.texts + 1.0)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                tokens = Tokens(part.column(1), v)
                n = len(tokens.size)
                of = tokens.words.text_of()
                log_count = np.where(tokens.frequent, v.log_count[tokens.place], 0.0) if len(v.hashes) else np.zeros(len(of))
                base = np.bincount(of, log_count, n) + end
                known = np.bincount(of, tokens.frequent, n).astype(np.int64) + (v.texts > 0)
                shares = tokens.word_class > OWN  # words that share a class
                score = log10_likelihood(tokens, p) + np.bincount(of, np.where(shares, log_count - v.room[tokens.word_class], 0.0), n)
                rare = np.flatnonzero(~tokens.frequent)
                r_of, r_hash = of[rare], tokens.hash[rare]
                order = np.lexsort((r_hash, r_of))
                r_of, r_hash = r_of[order], r_hash[order]
                new = np.append(True, (r_of[1:] != r_of[:-1]) | (r_hash[1:] != r_hash[:-1])) if len(rare) else np.zeros(0, bool)
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(rare))).astype(np.int32)
                offsets = pa.array(np.searchsorted(r_of[at], np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(tokens.size.astype(np.int64)), pa.array(known), pa.array(base), pa.array(score), pa.ListArray.from_arrays(offsets, pa.array(r_hash[at].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(times))],
                    ["id", "n_tokens", "known", "base", "score", "rare", "times"],
                )

    rows = cut(docs.mapInArrow(lean(run), schema).withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("h"), F.col("r.times").alias("times"))
    found = rare.join(counts.select("h", "n"), "h").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"))
    more = F.coalesce("more", F.lit(0.0))
    return rows.join(found, "row", "left").select(
        "id",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * math.log10(v.tokens + v.distinct + 1.0)).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def model_and_score(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learns from the rows where `learn` holds and scores all; columns as of `score`."""
    rows = _texts(docs, key, text)
    learned = _texts(docs.where(learn), key, text)
    counts = cut(count_words(learned))
    v = vocabulary(counts, learned.count())
    return score(rows, counts, v, train(learned, v))
