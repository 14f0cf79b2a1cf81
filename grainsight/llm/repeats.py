"""Substring dedup by repeated-phrase automata (operator 2).

A window is `window` consecutive words.  A word is repeated if a window covers it
whose words also start in a document with a smaller key.  Three steps find them:

1. Anchors.  Each window has one anchor, the `ANCHOR`-word phrase in it of least
   hash, so equal windows have equal anchors.  Tasks send the anchors of the texts
   they read, one entry for each phrase and slice of texts, packed by hash range;
   phrases that more than one document has come back to those documents.
2. Confirmation.  Only windows whose anchor recurs are looked at further.  A
   document sends the few words around each such anchor to the anchor's shard,
   where windows that truly recur, and the first document of each, are found.
   Windows of very frequent anchors go to shards of their own, one by one.
3. Automata.  Each shard compiles its confirmed windows into an Aho-Corasick
   automaton over words and streams its passages through it to locate every
   occurrence; what is covered goes back to the documents.

Equal texts are found first, by digest: all but the first of them are repeated as
a whole.  A slice sends equal passages once and a task adds up what it has read
before the shuffle, so a passage in a third of all documents costs an entry for
each slice, not for each document.  Entries, shards and slices have bounded
sizes, and their number grows with the input.

Defined results: a null or empty text has no words and loses none; rows with a
null key come after all others; rows that share a key never remove each other's
words; texts of any length are handled whole; an empty table gives an empty
table.  Other columns pass through `dedup` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .textcols import Words, slices

WINDOW = 13
#: Words of an anchor.
ANCHOR = 6
#: Bytes of text that one hash range or one shard answers for, about.
SHARE = 8 << 20
#: Shards of passages for each hash range: a shard's windows are Python objects, some forty times their text.
SHARDS = 4
#: Bytes of text that a task marks and cuts at once.
SLICE = 512 << 10
#: An anchor that more slices than that have is frequent.
FREQUENT = 2000
#: Copies of a text from which on they are dealt to parts, and the parts.
HOT = 1000
SALTS = 64
LAST_KEY = (1 << 63) - 1


def anchors(w: Words, window: int = WINDOW, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows' first words, their anchors' first words, hash of the phrase at each word)."""
    g = w.grams(w.hashes(), size)
    reach = window - size + 1
    n = len(w) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g
    least, have = g, 1
    while have < reach:
        step = min(have, reach - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    at = np.zeros(n, np.int64)
    for j in range(reach - 1, -1, -1):
        np.copyto(at, j, where=g[j : j + n] == least[:n])
    of = w.text_of()
    inside = np.flatnonzero(of[:n] == of[window - 1 :])
    return inside, inside + at[inside], g


def _runs(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where runs of consecutive windows with one anchor begin."""
    if not len(at):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (first[1:] != first[:-1] + 1)))


def _planes(x: np.ndarray) -> bytes:
    """Bytes of 64-bit numbers, all first bytes, then all second ones: similar numbers compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _send_anchors(ranges: int, window: int):
    shift = np.uint64(64 - max(1, ranges.bit_length() - 1)) if ranges > 1 else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(1))
                first, at, g = anchors(w, window)
                begin = _runs(first, at)
                if not len(begin):
                    continue
                key = part.column(0).to_numpy(zero_copy_only=False)[w.text_of()[first[begin]]]
                h = g[at[begin]]
                order = np.lexsort((key, h))
                h, key = h[order], key[order]
                new = np.append(True, h[1:] != h[:-1])
                again = ~new & np.append(False, key[1:] != key[:-1])  # also in a document with a smaller key in this slice
                group = np.cumsum(new) - 1
                multi = np.bincount(group[again], minlength=group[-1] + 1) > 0
                direct_h, direct_key = h[again], key[again]
                h, key = h[new], key[new]
                place = (h >> shift).astype(np.int64) if shift is not None else np.zeros(len(h), np.int64)
                cuts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                ends = np.append(cuts[1:], len(h))
                rows = [(int(place[a]), _planes(h[a:b]), _planes(key[a:b]), np.packbits(multi[a:b]).tobytes()) for a, b in zip(cuts, ends, strict=True)]
                if len(direct_h):
                    rows.append((-1 - int(direct_h[0] % np.uint64(max(ranges, 1))), _planes(direct_h), _planes(direct_key), b""))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], ["place", "h", "key", "multi"])

    return run


def _hits(h: np.ndarray, key: np.ndarray, frequent: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(h.view(np.int64)), pa.array(frequent)], ["key", "h", "frequent"])


def _recurring(often: int):
    return lambda batches: _recurring_hits(batches, often)


def _recurring_hits(batches: Iterable[pa.RecordBatch], often: int) -> Iterator[pa.RecordBatch]:
    """Rows of one hash range follow each other: the documents of each phrase that recurs, frequent if more than `often` slices sent it."""
    place, held = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        h, key, multi = (np.concatenate([x[i] for x in held]) for i in range(3))
        held.clear()
        order = np.argsort(h, kind="stable")
        h, key, multi = h[order], key[order], multi[order]
        new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(new, len(h)))
        # entries of one document, sent by two tasks, don't make a phrase recur
        several = np.maximum.reduceat(key, new) != np.minimum.reduceat(key, new)
        keep = np.repeat(several | np.maximum.reduceat(multi, new), size)
        frequent = np.repeat(size > often, size)
        yield _hits(h[keep], key[keep], frequent[keep])

    for batch in batches:
        for p, h, key, multi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p < 0:
                h = _numbers(h, np.uint64)
                yield _hits(h, _numbers(key, np.int64), np.zeros(len(h), bool))
                continue
            if p != place:
                yield from flush()
                place = p
            h = _numbers(h, np.uint64)
            held.append((h, _numbers(key, np.int64), np.unpackbits(np.frombuffer(multi, np.uint8), count=len(h)).astype(bool)))
    yield from flush()


def _passages(shards: int, window: int):
    """Documents with their recurring anchors: the words around each to its shard, and what equal passages settle at once."""
    names = ["shard", "key", "tid", "start", "size", "words"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(1))
                first, at, g = anchors(w, window)
                if not len(first):
                    continue
                found = part.column(3)
                found_h = found.values.field("h").to_numpy(zero_copy_only=False).view(np.uint64)
                found_f = found.values.field("frequent").to_numpy(zero_copy_only=False)
                offsets = found.offsets.to_numpy()
                found_h, found_f = found_h[offsets[0] : offsets[-1]], found_f[offsets[0] : offsets[-1]]
                # a phrase counts for the documents that it came back to
                asked = np.unique(found_h)
                frequent = np.unique(found_h[found_f])
                text = w.text_of()[first]
                code = text * len(asked) + np.minimum(np.searchsorted(asked, g[at]), len(asked) - 1)
                own = np.repeat(np.arange(part.num_rows), np.diff(offsets)) * len(asked) + np.searchsorted(asked, found_h)
                keep = np.isin(code, own) & (asked[np.minimum(np.searchsorted(asked, g[at]), len(asked) - 1)] == g[at])
                first, at, text = first[keep], at[keep], text[keep]
                single = np.isin(g[at], frequent)
                begin = _runs(first, np.where(single, -1 - np.arange(len(at)), at))
                if not len(begin):
                    continue
                last = np.append(begin[1:], len(first)) - 1
                a, b = first[begin], first[last] + window  # words a to b
                text, h = text[begin], g[at[begin]]
                whole = Words.grams(w, w.hashes(), window)
                route = np.where(single[begin], whole[a], h)
                # all words joined by one space, once; a passage is a stretch of it
                size = w.end - w.start
                to = np.cumsum(size + 1) - (size + 1)
                line = np.full(int(to[-1] + size[-1] + 1), 32, np.uint8)
                line[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(to, size)] = w.data[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(w.start, size)]
                raw = line.tobytes()
                keys = part.column(0).to_numpy(zero_copy_only=False)
                tids = part.column(1 + 1).to_numpy(zero_copy_only=False)
                key, tid = keys[text], tids[text]
                start = a - w.first[text]
                seen: dict[bytes, int] = {}
                out: list[tuple[int, int, int, int, int, bytes | None]] = []
                lo, hi = to[a].tolist(), (to[b - 1] + size[b - 1]).tolist()
                shard = (route % np.uint64(shards)).astype(np.int64).tolist()
                words_in = (b - a).tolist()
                order = np.argsort(key, kind="stable").tolist()
                key, tid, start = key.tolist(), tid.tolist(), start.tolist()
                for i in order:
                    words = raw[lo[i] : hi[i]]
                    before = seen.setdefault(words, key[i])
                    if before < key[i]:  # a document with a smaller key in this slice has all of it
                        out.append((-1 - key[i] % shards, key[i], tid[i], start[i], words_in[i], None))
                    else:
                        out.append((shard[i], key[i], tid[i], start[i], words_in[i], words))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names)

    return run


class Passage:
    """A passage's words, and the documents and places that have it."""

    def __init__(self, words: bytes):
        self.words = words
        self.members: list[tuple[int, int, int]] = []  # key, text, first word

    def stretches(self, found: list[tuple[int, int]], window: int) -> Iterator[tuple[int, int, int, int]]:
        """(key, text, first word, words) of what windows of documents with smaller keys cover; found: (last word, first key)."""
        latest = max(first for _, first in found)
        common = None
        for key, tid, start in self.members:
            if key > latest:
                common = common or _merged([at for at, _ in found], window)
                mine = common
            else:
                mine = _merged([at for at, first in found if first < key], window)
            for a, size in mine:
                yield key, tid, start + a, size


def _merged(ends: list[int], window: int) -> list[tuple[int, int]]:
    """(first word, words) of the union of windows with these last words, in ascending order."""
    out: list[tuple[int, int]] = []
    for at in ends:
        a = at - window + 1
        if out and a <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], at + 1 - out[-1][0])
        else:
            out.append((a, window))
    return out


def shard_occurrences(passages: list[Passage], window: int) -> Iterator[tuple[int, int, int, int]]:
    """(key, text, first word, words) of every stretch of a passage that windows of documents with smaller keys cover.

    Confirms which windows recur, compiles those into an automaton over words and
    streams every passage through it.
    """
    number: dict[bytes, int] = defaultdict(count(1).__next__)
    lines = [tuple([number[x] for x in p.words.split(b" ")]) for p in passages]
    first_key: dict[tuple[int, ...], int] = {}
    recurs: set[tuple[int, ...]] = set()
    for p, line in zip(passages, lines, strict=True):
        least, most = min(m[0] for m in p.members), max(m[0] for m in p.members)
        for i in range(len(line) - window + 1):
            phrase = line[i : i + window]
            before = first_key.setdefault(phrase, least)
            if before != most or before != least:
                recurs.add(phrase)
                if least < before:
                    first_key[phrase] = least
    if not recurs:
        return
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for phrase in recurs:
        automaton.add_word(phrase, first_key[phrase])
    automaton.make_automaton()
    for p, line in zip(passages, lines, strict=True):
        found = list(automaton.iter(line))
        if found:
            yield from p.stretches(found, window)


def _locate(window: int):
    names = ["key", "tid", "start", "size"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, {}

        def flush() -> pa.RecordBatch:
            out = list(shard_occurrences(list(held.values()), window))
            held.clear()
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names)

        for batch in batches:
            settled = pc.less(batch.column(0), 0)
            done = batch.filter(settled)
            if done.num_rows:
                yield pa.RecordBatch.from_arrays(done.columns[1:5], names)
                batch = batch.filter(pc.invert(settled))
            for s, key, tid, start, words in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 5)), strict=True):
                if s != shard:
                    if held:
                        yield flush()
                    shard = s
                passage = held.get(words)
                if passage is None:
                    passage = held[words] = Passage(words)
                passage.members.append((key, tid, start))
        if held:
            yield flush()

    return run


def _repeated(w: Words, text: int, copy: bool, spans: list, window: int) -> np.ndarray:
    """Which words of a text are repeated."""
    n = int(w.first[text + 1] - w.first[text])
    if copy and n >= window:
        return np.ones(n, bool)
    change = np.zeros(n + 1, np.int32)
    for s, size in spans:
        change[s] += 1
        change[s + size] -= 1
    return np.cumsum(change[:-1]) > 0


def _masked(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray]]:
    """Slices of (key, text, tid, copy, spans, ...), their words and which of those are repeated."""
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            w = Words(part.column(1))
            gone = np.zeros(len(w), bool)
            tids, copies = part.column(2).to_pylist(), part.column(3).to_pylist()
            spans = part.column(4)
            for i in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False) | np.array(copies, bool)).tolist():
                mine = [(x["start"], x["size"]) for x in spans[i].as_py() or [] if x["tid"] == tids[i]]
                gone[w.first[i] : w.first[i + 1]] = _repeated(w, i, copies[i], mine, window)
            yield part, w, gone


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray, gap: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of `data` one after the other with a gap byte after each, and where each begins."""
    step = len(gap)
    to = np.cumsum(size + step) - (size + step)
    out = np.full(int((size + step).sum()), gap[0] if gap else 0, np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[inner + np.repeat(to, size)] = data[inner + np.repeat(start, size)]
    return out, np.append(to, len(out))


def _digests(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w, gone in _masked(batches, window):
            keep = np.flatnonzero(~gone)
            line, to = _gather(w.data, w.start[keep], w.end[keep] - w.start[keep], b" ")
            raw = memoryview(line)
            edge = to[np.searchsorted(keep, w.first)].tolist()
            digests = [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            removed = np.concatenate([[0], np.cumsum(gone)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w.counts.astype(np.int64)), pa.array(np.diff(removed[w.first]).astype(np.int64)), pa.array(digests, pa.string())], ["key", "n_words", "n_removed", "kept_sha256"])

    return run


def _texts(window: int, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w, gone in _masked(batches, window):
            # a repeated word goes with the white space after it
            keep = np.ones(len(w.data) + 1, bool)
            following = np.append(w.start[1:], len(w.data))
            of = w.text_of()
            following = np.minimum(following, w.offsets[1:][of])
            at = np.flatnonzero(gone)
            change = np.zeros(len(w.data) + 1, np.int32)
            np.add.at(change, w.start[at], 1)
            np.add.at(change, following[at], -1)
            keep = np.cumsum(change)[:-1] == 0
            data = w.data[keep].tobytes()
            offsets = np.concatenate([[0], np.cumsum(keep)])[w.offsets].astype(np.int32)
            cut = pa.Array.from_buffers(pa.string(), part.num_rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
            removed = np.concatenate([[0], np.cumsum(gone)])
            yield pa.RecordBatch.from_arrays([*part.columns[5:], cut, pa.array(w.counts.astype(np.int64)), pa.array(np.diff(removed[w.first]).astype(np.int64))], [*names, "_kept", "_n_words", "_n_removed"])

    return run


def _anchor_hits(single: DataFrame, shares: int, window: int) -> DataFrame:
    """(key, h, frequent): the documents of each anchor that recurs."""
    entries = single.mapInArrow(lean(_send_anchors(shares, window)), "place int, h binary, key binary, multi binary")
    hits = entries.repartition("place").sortWithinPartitions("place").mapInArrow(lean(_recurring(FREQUENT)), "key long, h long, frequent boolean")
    # a phrase is frequent for all its documents, also for those that came back without its count; each has over FREQUENT entries, so they are few
    frequent = hits.where("frequent").select("h").distinct().withColumn("often", F.lit(True))
    return hits.select("key", "h").join(F.broadcast(frequent), "h", "left").select("key", "h", F.coalesce("often", F.lit(False)).alias("frequent"))


def _copies(docs: DataFrame) -> DataFrame:
    """(key, tid, copy) of the texts that a document with a smaller key has too.

    Rows of digests that more than `HOT` texts have are dealt to `SALTS` parts, so no
    task meets all copies of one text.
    """
    salt = F.pmod(F.xxhash64("key", "tid"), F.lit(SALTS)).cast("int")
    digest = docs.where(F.octet_length("text") > 0).select("key", "tid", F.unhex(F.md5("text")).alias("digest"))
    first = digest.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    hot = first.where(F.col("n") > HOT).select("digest", F.col("first").alias("hot"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = digest.withColumn("salt", salt).join(hot, ["digest", "salt"], "left")
    few = dealt.where("hot IS NULL").join(first.where(F.col("n") <= HOT).select("digest", "first"), "digest").where("key > first")
    return dealt.where("key > hot").select("key", "tid").unionByName(few.select("key", "tid")).distinct().withColumn("copy", F.lit(True))


def _spans(docs: DataFrame, window: int) -> DataFrame:
    """docs (key, text, tid) with copy (an equal text has a smaller key) and spans (repeated words)."""
    size = docs.select(F.sum(F.octet_length("text"))).head()[0] or 0
    shares = 1 << max(3, (size // SHARE).bit_length())
    copies = _copies(docs)
    marked = docs.join(copies, ["key", "tid"], "left").select("key", "text", "tid", F.coalesce("copy", F.lit(False)).alias("copy"))
    # the same columns as below, so that the plan shuffles the texts once and reads that exchange three times
    single = marked.where("NOT copy").select("key", "text", "tid")
    # every join of texts is by key and text digest: one shuffle of the texts serves all, and a key that many rows share is spread
    rows = ["key", "tid"]
    hits = _anchor_hits(single, shares, window).join(docs.select(rows).distinct(), "key")
    asked = hits.groupBy(rows).agg(F.collect_list(F.struct("h", "frequent")).alias("hits"))
    sent = marked.where("NOT copy").join(asked, rows).select("key", "text", "tid", "hits").mapInArrow(lean(_passages(shares * SHARDS, window)), "shard int, key long, tid long, start int, size int, words binary")
    found = sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(lean(_locate(window)), "key long, tid long, start int, size int")
    spans = found.groupBy(rows).agg(F.collect_list(F.struct("tid", "start", "size")).alias("spans"))
    return marked.join(spans, rows, "left")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST_KEY)).alias("key"), whole.alias("text"), F.xxhash64(whole).alias("tid"))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of each row; the kept words are joined by one space."""
    rows = _spans(_keyed(docs, key, text), window).select("key", "text", "tid", "copy", "spans")
    out = rows.mapInArrow(lean(_digests(window)), "key long, n_words long, n_removed long, kept_sha256 string")
    return out.withColumn("key", F.nullif("key", F.lit(LAST_KEY)))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """`docs` without repeated words, each with the white space after it; texts that lose all their words go."""
    spans = _spans(_keyed(docs, key, text), window)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    others = [n for n in names if n != at[text]]  # the text goes to Python once, and comes back once
    whole = F.coalesce(F.col(at[text]), F.lit(""))
    rest = docs.toDF(*names).select(F.coalesce(F.col(at[key]).cast("long"), F.lit(LAST_KEY)).alias("_key"), F.xxhash64(whole).alias("_tid"), *names)
    spans = spans.select(F.col("key").alias("_k"), F.col("tid").alias("_t"), "copy", "spans").dropDuplicates(["_k", "_t"])
    rows = rest.join(spans, (F.col("_key") == F.col("_k")) & (F.col("_tid") == F.col("_t")))
    rows = rows.select(F.col("_key").alias("key"), whole.alias("text"), F.col("_tid").alias("tid"), "copy", "spans", *others)
    kinds = dict(zip(names, (k for _, k in docs.dtypes), strict=True))
    schema = ", ".join([*(f"{n} {kinds[n]}" for n in others), "_kept string", "_n_words long", "_n_removed long"])
    out = rows.mapInArrow(lean(_texts(window, others)), schema).where("_n_removed = 0 OR _n_removed < _n_words")
    return out.select(*(F.col("_kept" if c == text else n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def sql(window: int = WINDOW) -> str:
    """The digests in DuckDB's SQL, over all windows of all texts."""
    return f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), x AS (
  SELECT doc_id, i, array_to_string(words[i:i + {window - 1}], ' ') AS passage FROM (SELECT doc_id, words, unnest(range(1, len(words) - {window - 2})) AS i FROM w)
), f AS (
  SELECT passage, min(doc_id) AS first FROM x GROUP BY passage
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS i FROM x JOIN f USING (passage) WHERE first < doc_id
), kept AS (
  SELECT v.doc_id, string_agg(word, ' ' ORDER BY v.i) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w) v ANTI JOIN gone ON v.doc_id = gone.doc_id AND v.i = gone.i GROUP BY v.doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
