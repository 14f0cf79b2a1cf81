"""Line dedup by exact set-similarity join (operator 5).

A line is what stands between line feeds; its tokens are its distinct words, A-Z
in lower case.  A line is removed if an earlier one, by document key and line
number, has token sets of Jaccard similarity 0.8 or more with it; all lines are
judged on the input.  Lines without words stay.

Only the first place of each distinct set has to be judged, and one verified
earlier partner settles it; all other places of a set are late at once.

1. Entries.  The join orders each line's tokens by rarity, from a fixed-size sketch
   of counts over the whole corpus, and sends the prefix that two similar lines must
   share a token of, each entry with the first place of its set in the slice.  A
   prefix token that more than `HOT` lines may have goes as pairs with the later
   tokens of a prefix longer by one, of which two similar lines share two; frequent
   tokens come last in the order, so both are frequent.  Groups that are still large
   are split by set.
2. Partners.  Where tokens meet, sets are in bands of sizes and there in order of
   their first places.  Each looks for earlier partners in the bands that the length
   filter leaves, from the earliest on, past a positional filter and a bound from
   parity maps of the sets, and stops after `FEW` that are most likely similar by
   those maps.  So a family of n similar lines costs n times a few, not all its pairs.
3. Verification.  The token sets of these pairs are fetched and Jaccard is verified.
4. Sets that stopped early, or whose group was split, and that no partner verified,
   ask once more: in all parts of their groups and without a limit, among the sets
   that share an entry key with one of them and have a size near its own.

All filters are bounds and step 4 finds what the limits left, so no line at the
threshold is missed.  Sets are told apart by 128-bit digests, entries by 64 bits of
them inside a token group, and words by 44 bits of hash in the filters and by 64
where Jaccard is verified: two lines of a thousand words each are misjudged with a
chance under 1e-7 in the filters and under 1e-13 in the verification.

Entries travel packed by token range; ranges have bounded sizes and their number
grows with the input.  A slice of texts sends a set once, however often it has it.
The broadcasts (count sketch, bit maps of asked lines, tokens and entry keys) have fixed sizes.

Defined results: null and empty texts have one line and lose none; rows with a null
key come after all others; the same line of rows that share a key counts as one
place, and rows of one key and different texts are told apart; of equal lines the
first stays; texts of any length are handled whole; an empty table gives an empty
table.  `dedup` passes other columns through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import VECTOR_SCHEMA, cut, lean, sum_vectors, vector_rows
from .textcols import Words, buffer, mix, slices

#: Buckets of the count sketch, a power of two.
SKETCH = 1 << 18
#: Bytes of text that one token range answers for, about.
SHARE = 8 << 20
#: Pairs that a task looks at in one go.
STEP = 200_000
#: Bytes of text that a task works on at once.
SLICE = 2 << 20
#: Earlier partners, most likely similar, after which a set stops looking in a token group.
FEW = 6
#: A token that more lines may have is sent in pairs.
HOT = 1 << 11
#: Sets of more tokens have parity maps of 128 bits, others of 64.
LONG = 40
#: Entries of a token group in one part, about.
PART = 1 << 20
#: Bits of the maps of asked lines and tokens, a power of two.
MAP = 1 << 25
LAST_KEY = (1 << 63) - 1

_T = np.uint64(20)
_LOW36 = np.uint64((1 << 36) - 1)
_LOW44 = np.uint64((1 << 44) - 1)


class Lines:
    """The lines with words of a column of texts, and their token sets.

    ``line``/``token``: (number of a line with words, 44-bit token) of each distinct
    token, in order.  ``text``/``number``: each such line's text and its line
    number there.
    """

    def __init__(self, column: pa.Array):
        w = Words(column, lower=True)
        feed = np.flatnonzero(w.data == 10)
        text = w.text_of()
        whole = np.searchsorted(feed, w.start) + text  # every text starts a line
        new = np.append(True, whole[1:] != whole[:-1]) if len(whole) else np.zeros(0, bool)
        of = np.cumsum(new) - 1
        self.text = text[new]
        self.number = whole[new] - self.text - np.searchsorted(feed, w.offsets[:-1])[self.text]
        self.words = w
        self.first_word = np.flatnonzero(new)
        self.lines_of_text = np.diff(np.searchsorted(feed, w.offsets)) + 1
        token = w.hashes() >> _T
        n = len(self.text)
        if n < 1 << 20:
            both = np.sort(of.astype(np.uint64) << np.uint64(44) | token)
            both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
            self.line, self.token = (both >> np.uint64(44)).astype(np.int64), both & _LOW44
        else:
            order = np.lexsort((token, of))
            of, token = of[order], token[order]
            keep = np.append(True, (of[1:] != of[:-1]) | (token[1:] != token[:-1]))
            self.line, self.token = of[keep], token[keep]
        self.count(n)

    def count(self, n: int) -> None:
        self.size = np.bincount(self.line, minlength=n)
        self.first = np.cumsum(self.size) - self.size

    @classmethod
    def of_sets(cls, column: pa.ListArray) -> Lines:
        """From rows of ascending 64-bit word hashes; without texts."""
        self = cls.__new__(cls)
        offsets = column.offsets.to_numpy()
        token = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64) >> _T
        line = np.repeat(np.arange(len(column)), np.diff(offsets))
        new = np.append(True, (line[1:] != line[:-1]) | (token[1:] != token[:-1])) if len(line) else np.zeros(0, bool)
        self.line, self.token = line[new], token[new]
        self.count(len(column))
        return self

    def digests(self, salt: int = 1) -> np.ndarray:
        """A 64-bit name of each line's token set; another salt gives 64 more bits."""
        if not len(self.size):
            return np.zeros(0, np.uint64)
        return mix(np.add.reduceat(mix(self.token + np.uint64(salt)), self.first) + self.size.astype(np.uint64))

    def parities(self) -> np.ndarray:
        """lines x 2: 128 parity bits of each set, those of short sets folded into the first 64.

        Two sets' maps differ in no more bits than the sets do in tokens.
        """
        out = np.zeros((len(self.size), 2), np.uint64)
        if len(self.size):
            h = mix(self.token)
            bit, second = np.uint64(1) << (h >> np.uint64(58)), h & np.uint64(1 << 20) != 0
            out[:, 1] = np.bitwise_xor.reduceat(np.where(second, bit, np.uint64(0)), self.first)
            out[:, 0] = np.bitwise_xor.reduceat(bit, self.first)
            out[:, 0] ^= np.where(self.size > LONG, out[:, 1], 0).astype(np.uint64)
            out[self.size <= LONG, 1] = 0
        return out

    def prefixes(self, rarity: np.ndarray, hot_from: int = HOT, part: int = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(line, position, key, parts) of what two similar lines must share one of: rare tokens of the prefix, and pairs of frequent ones.

        Sets of fewer than four tokens are similar to equal sets only and have no
        entries.  `parts` is the number of parts that the key's group is split into.
        """
        kind = rarity[(self.token & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64)
        tagged = kind << np.uint64(36) | (self.token & _LOW36)
        if len(self.size) < 1 << 20:
            line, tagged = self.line, np.sort(self.line.astype(np.uint64) << np.uint64(44) | tagged) & _LOW44
        else:
            line, tagged = self.line, tagged[np.lexsort((tagged, self.line))]
        place = np.arange(len(line)) - self.first[line]
        reach = (self.size - (4 * self.size + 4) // 5 + 1)[line]
        able = self.size[line] >= 4
        hot = tagged >> np.uint64(36) > _class(hot_from)
        one = np.flatnonzero(able & (place < reach) & ~hot)
        two = np.flatnonzero(able & (place < reach) & hot)
        later = np.minimum(reach[two], self.size[line[two]] - 1) - place[two]  # tokens after it, up to one past the prefix
        i = np.repeat(two, later)
        j = i + 1 + _ramp(later)
        key = np.concatenate([mix(tagged[one]), mix(mix(tagged[i]) * np.uint64(31) + tagged[j])])
        parts = np.concatenate([np.ones(len(one), np.int64), np.exp2((tagged[i] >> np.uint64(36)).astype(np.int64) / 6).astype(np.int64) // part + 1])
        first = np.concatenate([one, i])
        return line[first], place[first], key, parts


def _class(count: int) -> np.uint64:
    """Logarithmic class of a count."""
    return np.uint64(min(255, int(6 * np.log2(1 + count))))


def _ramp(count: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after the other."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def planes(x: np.ndarray) -> bytes:
    """Bytes of 64-bit numbers, all first bytes, then all second ones: similar numbers compress well."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T).tobytes()


def numbers(raw: bytes, kind: type = np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(kind).ravel()


def rarity(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(logarithmic class of each sketch bucket's count over all lines, bytes of all texts)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros(SKETCH), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words = Words(part.column(0), lower=True)
                size += len(words.data)
                total += np.bincount((words.hashes() >> _T & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        yield from vector_rows({"n": total, "bytes": np.array([size])})

    found = sum_vectors(docs.select("text").mapInArrow(lean(run), VECTOR_SCHEMA))
    return np.minimum(255, 6 * np.log2(1 + found.get("n", np.zeros(SKETCH)))).astype(np.uint8), int(found.get("bytes", [0])[0])


def place_hash(key: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64))


def bit_map(hashes: DataFrame) -> np.ndarray:
    """A map of `MAP` bits in which the bits of all 64-bit numbers `h` are set; its size doesn't grow with them."""
    rows = hashes.selectExpr(f"cast(pmod(h, {MAP}) div 64 as int) AS word", "shiftleft(1L, cast(pmod(h, 64) as int)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(MAP // 64, np.int64)
    found = rows.toArrow()  # at most MAP / 64 rows
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def _in_map(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(MAP - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


#: What an entry row holds beside the token range: packed keys, sets, parity maps (two columns), sizes with positions, keys and line numbers of first places.
ENTRY = ["place", "kind", "a", "b", "c", "d", "e", "f", "g"]
ENTRY_SCHEMA = "place int, kind int, a binary, b binary, c binary, d binary, e binary, f binary, g binary"
#: Kinds of rows: a prefix entry, one that only asks, the first places of a slice's sets, places that are late already.
SET, ASK, FIRST, LATE = range(4)


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ENTRY)


def _packed(shift: int, kind: int, lines: Lines, s: np.ndarray, key: np.ndarray, number: np.ndarray, line: np.ndarray, place: np.ndarray, token: np.ndarray, split: np.ndarray) -> list[tuple]:
    """Entries as rows, one for each token range; `split` tells which are of split groups."""
    order = np.argsort(token)
    line, place, token, split = line[order], place[order], token[order], split[order]
    meta = lines.size[line] << 32 | split.astype(np.int64) << 31 | place
    parity = lines.parities()[line]
    columns = [token, s[line], parity[:, 0], parity[:, 1], meta, key[line], number[line]]
    to = (token >> np.uint64(shift)).astype(np.int64)
    cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(to)) if len(to) else cuts
    return [(int(to[i]), kind, *(planes(c[i:j]) for c in columns)) for i, j in zip(cuts, ends, strict=True)]


def _entries(shift: int, shared, limits: tuple[int, int] = (HOT, PART)):
    """The entries and places of all lines."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                lines = Lines(part.column(1))
                if not len(lines.size):
                    continue
                key, tid = (part.column(i).to_numpy(zero_copy_only=False)[lines.text] for i in (0, 2))
                s, more = lines.digests(), lines.digests(2)
                order = np.lexsort((lines.number, key, s))
                new = np.append(True, s[order][1:] != s[order][:-1])
                first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
                once = np.zeros(len(s), bool)
                once[order[new]] = True
                # the set's first place in this slice, also by other rows of that key
                at_first = np.zeros(len(s), bool)
                at_first[order] = (key[order] == key[first]) & (lines.number[order] == lines.number[first])
                spread = -1 - int(s[0] % np.uint64(1 << 30))
                rows = [(spread, kind, *(planes(x[which]) for x in (s, more, key, tid, lines.number)), None, None) for kind, which in ((FIRST, at_first), (LATE, ~at_first)) if which.any()]
                line, place, token, parts = lines.prefixes(shared.value, *limits)
                keep = once[line]
                line, place, token, parts = line[keep], place[keep], token[keep], parts[keep]
                split = parts > 1
                token = np.where(split, mix(token + s[line] % parts.astype(np.uint64)), token)
                rows += _packed(shift, SET, lines, s, key, lines.number, line, place, token, split)
                yield _row_batch(rows)

    return run


class Places:
    """The lines of a column of texts, by their line feeds alone."""

    def __init__(self, column: pa.Array, key: np.ndarray):
        self.data, self.offsets = buffer(column)
        self.feed = np.flatnonzero(self.data == 10)
        self.before = np.searchsorted(self.feed, self.offsets)  # line feeds before each text
        self.count = np.diff(self.before) + 1
        self.text = np.repeat(np.arange(len(self.count)), self.count)
        self.number = _ramp(self.count)
        self.key = key[self.text]

    def of_words(self, start: np.ndarray) -> np.ndarray:
        """Which lines the words that start at these bytes stand in."""
        text = np.searchsorted(self.offsets, start, side="right") - 1
        return np.searchsorted(self.feed, start) + text

    def take(self, at: np.ndarray) -> pa.Array:
        """The bytes of some lines as a column of texts."""
        text, number = self.text[at], self.number[at]
        after = self.before[text] + number  # the line feed that ends the line, if it isn't the text's last
        edge = np.append(self.feed, len(self.data))
        start = np.where(number > 0, edge[np.maximum(after - 1, 0)] + 1, self.offsets[text])
        end = np.where(number + 1 < self.count[text], edge[np.minimum(after, len(self.feed))], self.offsets[text + 1])
        size = end - start
        kept = self.data[np.repeat(start, size) + _ramp(size)]
        to = pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32).tobytes())
        return pa.Array.from_buffers(pa.string(), len(size), [None, to, pa.py_buffer(kept.tobytes())])


SET_NAMES = ["s", "key", "line", "tokens"]
SET_SCHEMA = "s long, key long, line long, tokens array<long>"


def _set_batch(places: Places, at: np.ndarray) -> pa.RecordBatch | None:
    """(s, key, line, tokens) of some lines; tokens are 64-bit hashes in ascending order."""
    lines = Lines(places.take(at))
    if not len(lines.size):
        return None
    h = lines.words.hashes()
    of = np.searchsorted(lines.first_word, np.arange(len(h)), side="right") - 1
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=len(lines.size)))]).astype(np.int32)
    tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[new].view(np.int64)))
    at = at[lines.text]
    return pa.RecordBatch.from_arrays([pa.array(lines.digests().view(np.int64)), pa.array(places.key[at]), pa.array(places.number[at].astype(np.int64)), tokens], SET_NAMES)


def _sets(asked):
    """The sets of the lines whose places may be in the map `asked`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                places = Places(part.column(1), part.column(0).to_numpy(zero_copy_only=False))
                at = np.flatnonzero(_in_map(asked.value, place_hash(places.key, places.number)))
                found = _set_batch(places, at) if len(at) else None
                if found is not None:
                    yield found

    return run


def _entry_hash(token: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Of the entry key of a set whose size is in a band."""
    return mix(token + band.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _asked_entries(shared, limits: tuple[int, int] = (HOT, PART)):
    """(h): the entry keys of sets, with the bands that similar sets are in."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = Lines.of_sets(batch.column(0))
            line, _, token, _ = lines.prefixes(shared.value, *limits)
            at = band(lines.size[line])
            h = [np.unique(_entry_hash(token, at + step)) for step in (-2, -1, 0, 1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64))], ["h"])

    return run


def _near(words, entries, shared, limits: tuple[int, int] = (HOT, PART)):
    """The sets of the lines that may share an entry key and a range of sizes with one in the map `entries`; all its lines have a word of the map `words`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                places = Places(part.column(1), part.column(0).to_numpy(zero_copy_only=False))
                w = Words(part.column(1), lower=True)
                at = np.unique(places.of_words(w.start[_in_map(words.value, mix(w.hashes() >> _T))]))
                if not len(at):
                    continue
                lines = Lines(places.take(at))
                line, _, token, _ = lines.prefixes(shared.value, *limits)
                met = np.unique(line[_in_map(entries.value, _entry_hash(token, band(lines.size[line])))])
                found = _set_batch(places, at[lines.text[met]]) if len(met) else None
                if found is not None:
                    yield found

    return run


def _of_sets(shift: int, shared, kind: int, limits: tuple[int, int] = (HOT, PART)):
    """Entries of sets (s, key, line, tokens); those that only ask go to all parts of their groups."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s, key, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            s, lines = s.view(np.uint64), Lines.of_sets(batch.column(3))
            line, place, token, parts = lines.prefixes(shared.value, *limits)
            if kind == ASK:
                of = np.repeat(np.arange(len(line)), parts)
                part = _ramp(parts).astype(np.uint64)
                line, place, token, parts = line[of], place[of], token[of], parts[of]
            else:
                part = s[line] % parts.astype(np.uint64)
            token = np.where(parts > 1, mix(token + part), token)
            rows = _packed(shift, kind, lines, s, key, number, line, place, token, parts > 1)
            if rows:
                yield _row_batch(rows)

    return run


def _prefix_words(shared):
    """(h): what the words of sets are found by that a similar line must have one of."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = Lines.of_sets(batch.column(0))
            kind = shared.value[(lines.token & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64)
            order = np.lexsort((kind << np.uint64(36) | (lines.token & _LOW36), lines.line))
            line, token = lines.line[order], lines.token[order]
            early = np.arange(len(line)) - lines.first[line] < (lines.size - (4 * lines.size + 4) // 5 + 1)[line]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(mix(token[early])).view(np.int64))], ["h"])

    return run


def band(size: np.ndarray) -> np.ndarray:
    """Sets whose sizes differ by a quarter at most are at most two bands apart."""
    return np.floor(2 * np.log(size) / np.log(1.25) + 1e-9).astype(np.int64)


class Group:
    """The entries of one token range by key, band and first place, each set once in a group; those that only ask apart."""

    def __init__(self, asks: np.ndarray, token: np.ndarray, s: np.ndarray, parity: np.ndarray, parity2: np.ndarray, meta: np.ndarray, key: np.ndarray, line: np.ndarray):
        key, line, meta = key.view(np.int64), line.view(np.int64), meta.view(np.int64)
        # one number a place, in order; the first place of each set in each group stays
        small = len(key) and 0 <= key.min() and key.max() < 1 << 40 and line.max() < 1 << 22
        order = np.argsort(key << 22 | line) if small else np.lexsort((line, key))
        key, line = key[order], line[order]
        rank = np.cumsum(np.append(False, (key[1:] != key[:-1]) | (line[1:] != line[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.most = int(rank[-1]) + 1 if len(rank) else 1
        token, s, asks = token[order], s[order], asks[order]
        once = np.argsort(mix(token ^ asks) ^ s, kind="stable")
        new = np.append(True, (token[once][1:] != token[once][:-1]) | (s[once][1:] != s[once][:-1]) | (asks[once][1:] != asks[once][:-1])) if len(once) else np.zeros(0, bool)
        at = once[new]
        at = at[np.argsort(token[at])]
        group = np.cumsum(np.append(False, token[at][1:] != token[at][:-1])) if len(at) else np.zeros(0, np.int64)
        size = meta[order[at]] >> 32
        code = (group * 128 + band(size) + 2) * self.most + rank[at]
        by_code = np.lexsort((code, asks[at])) if asks.any() else np.argsort(code)
        at = at[by_code]
        self.code, self.asks, self.n = code[by_code], asks[at], int((~asks[at]).sum())
        self.s, self.key, self.line = s[at], key[at], line[at]
        of = order[at]
        self.parity, self.parity2 = parity[of], parity2[of]
        self.size, self.rest = size[by_code].astype(np.int32), (size[by_code] - (meta[of] & 0x7FFFFFFF)).astype(np.int32)
        self.split = (meta[of] >> 31 & 1).astype(bool)

    def partners(self, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(set, earlier set, whether the first may have further ones): pairs that pass all filters.

        Without a limit, for those that only ask; with a limit, for all others, until
        they have `most` that are most likely similar.  Whoever has a pair left out,
        likely or not, may have further ones.
        """
        mine = np.arange(self.n, len(self.code)) if most is None else np.arange(self.n)
        sets = self.code[: self.n]
        segment = self.code[mine] // self.most
        asks, start, count = [], [], []
        for step in (-2, -1, 0, 1, 2):
            first = (segment + step) * self.most
            low = np.searchsorted(sets, first)
            high = np.searchsorted(sets, first + self.code[mine] % self.most)  # strictly earlier places
            some = high > low
            asks.append(mine[some]), start.append(low[some]), count.append((high - low)[some])
        asks, start, count = (np.concatenate(x) for x in (asks, start, count))
        sure, left_out = np.zeros(len(self.code), np.int64), np.zeros(len(self.code), bool)
        low, high = 0, 16
        while len(asks):
            todo = np.minimum(count, high) - low
            total = np.cumsum(todo)
            for chunk in np.split(np.arange(len(asks)), np.searchsorted(total, np.arange(STEP, int(total[-1]), STEP))):
                c = todo[chunk]
                i = np.repeat(asks[chunk], c)
                j = np.repeat(start[chunk] + low, c) + _ramp(c)
                size, other = self.size[i], self.size[j]
                need = (4 * (size + other) + 8) // 9
                ok = np.flatnonzero((np.minimum(self.rest[i], self.rest[j]) >= need) & (5 * np.minimum(size, other) >= 4 * np.maximum(size, other)))
                i, j, may = i[ok], j[ok], (size + other - 2 * need)[ok]
                mixed = (self.size[i] > LONG) != (self.size[j] > LONG)
                a, b, a2, b2 = self.parity[i], self.parity[j], self.parity2[i], self.parity2[j]
                differ = np.bitwise_count(np.where(mixed, a ^ a2 ^ b ^ b2, a ^ b)).astype(np.int64) + np.where(mixed, 0, np.bitwise_count(a2 ^ b2))
                ok = (differ <= may) & (self.s[i] != self.s[j])
                i, j = i[ok], j[ok]
                if most is None:
                    yield i, j, np.zeros(len(i), bool)
                    continue
                # tokens that differ, if the bits that do are as many as can be expected
                bits = np.where((self.size[i] > LONG) & ~mixed[ok], 128.0, 64.0)
                likely = -bits / 2 * np.log1p(-np.minimum(2 * differ[ok] / bits, 0.999)) * 1.15 + 1 <= may[ok]
                before = sure[i]
                sure += np.bincount(i[likely], minlength=len(sure))
                # the likeliest up to the limit, others while there are no likely ones
                order = np.lexsort((differ[ok], ~likely, i))
                i, j, likely, before = i[order], j[order], likely[order], before[order]
                begin = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
                nth = _ramp(np.diff(np.append(begin, len(i))))
                keep = np.where(likely, before + nth < most, sure[i] == 0)
                lost = np.zeros(len(self.code), bool)
                lost[i[~keep]] = True
                i, j = i[keep], j[keep]
                yield i, j, lost[i] | self.split[i]
                lost[i] = False
                left_out |= lost
            if most is not None:
                left_out[asks[(count > high) & (sure[asks] >= most)]] = True
            left = (count > high) & (sure[asks] < (most or 1))
            asks, start, count = asks[left], start[left], count[left]
            low, high = high, high * 4
        if most is not None:
            # those with a pair left out and none yielded beside it; a part of a split group may be too small to hold any partner
            alone = np.flatnonzero((left_out | self.split)[: self.n])
            yield alone, alone, np.ones(len(alone), bool)


PAIR = ["s", "key", "line", "s2", "key2", "line2", "more"]
PAIR_SCHEMA = "s long, key long, line long, s2 long, key2 long, line2 long, more boolean"


def _pairs(most: int | None):
    """Pairs to verify from the entries, whose rows of one token range follow each other, and the places packed as they are.

    A pair of a set with itself only says that the set may have partners elsewhere.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []

        def flush() -> list[tuple]:
            if not held:
                return []
            asks = np.concatenate([np.full(len(r[1]) // 8, r[0] == ASK) for r in held])
            group = Group(asks, *(np.concatenate([numbers(r[i]) for r in held]) for i in range(1, 8)))
            held.clear()
            found = [np.concatenate(x) for x in zip(*group.partners(most), strict=True)]
            if not found or not len(found[0]):
                return []
            i, j, more = found
            rows = np.stack([group.s[i].view(np.int64), group.key[i], group.line[i], group.s[j].view(np.int64), group.key[j], group.line[j], more.astype(np.int64)], 1)
            rows = rows[np.lexsort(rows.T[[6, 3, 0]])]
            last = np.append((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 3] != rows[:-1, 3]), True)
            return [(-1, -1 - k, *(planes(c) for c in rows[last & (rows[:, 6] == k)][:, :6].T), None) for k in (0, 1)]

        for batch in batches:
            out = []
            for p, kind, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind in (FIRST, LATE):
                    out.append((p, kind, *raw))
                    continue
                if p != place:
                    out += flush()
                    place = p
                held.append((kind, *raw))
            yield _row_batch(out)
        yield _row_batch(flush())

    return run


def _unpacked(kinds: dict[int, int], names: list[str]):
    """Rows of the given kinds, one for each place or pair; the last column is what the kind stands for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, kind, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind in kinds:
                    columns = [numbers(r, np.int64) for r in raw[: len(names) - 1]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(np.full(len(columns[0]), bool(kinds[kind])))], names)

    return run


def shared_tokens(a: pa.ListArray, b: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size of a, size of b, tokens that both have) of rows of two columns of ascending tokens."""
    sizes, tokens, keys = [], [], []
    for c in (a, b):
        offsets = c.offsets.to_numpy()
        sizes.append(np.diff(offsets))
        tokens.append(c.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64))
        keys.append(np.repeat(np.arange(len(c), dtype=np.uint64), sizes[-1]) << np.uint64(40) | tokens[-1] >> np.uint64(24))
    # in order of row and token; the last bits are compared where the first 40 are equal
    at = np.minimum(np.searchsorted(keys[0], keys[1]), max(len(keys[0]) - 1, 0))
    same = (keys[0][at] >> np.uint64(40) == keys[1] >> np.uint64(40)) & (tokens[0][at] == tokens[1]) if len(keys[0]) else np.zeros(len(keys[1]), bool)
    return sizes[0], sizes[1], np.bincount((keys[1] >> np.uint64(40)).astype(np.int64)[same], minlength=len(a))


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both sets: the places that have a partner of Jaccard similarity 0.8 or more."""
    for batch in batches:
        n, m, both = shared_tokens(batch.column(3), batch.column(4))
        chosen = pa.array(5 * both >= 4 * (n + m - both))
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(chosen) for i in range(3)], ["s", "key", "line"])


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST_KEY)).alias("key"), whole.alias("text"), F.xxhash64(whole).alias("tid"))


def _hash_of(key: str, line: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, line = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(place_hash(key, line).view(np.int64))], ["h"])

    return lambda df: df.select(key, line).mapInArrow(lean(run), "h long")


def _map_of(places: DataFrame):
    """The shared bit map of places (key, line)."""
    return places.sparkSession.sparkContext.broadcast(bit_map(_hash_of("key", "line")(places)))


def _judged(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(s, key, line): the first places of sets that have a verified partner."""
    other = sets.withColumnsRenamed({"s": "s2", "key": "key2", "line": "line2", "tokens": "tokens2"})
    both = pairs.join(sets, ["s", "key", "line"]).join(other, ["s2", "key2", "line2"])
    return cut(both.select("s", "key", "line", "tokens", "tokens2").mapInArrow(lean(_verified), "s long, key long, line long").distinct())


def repeated(docs: DataFrame, few: int = FEW, limits: tuple[int, int] = (HOT, PART)) -> DataFrame:
    """(key, tid, removed): the numbers of the lines of a text that have an earlier match; docs: (key, text, tid).

    `few` and `limits` (stand-ins for `FEW`, `HOT` and `PART`) change the work and not the result.
    """
    sc = docs.sparkSession.sparkContext
    classes, size = rarity(docs)
    bits = max(4, (size // SHARE).bit_length())
    shift, ranges = 64 - bits, 1 << bits
    shared = sc.broadcast(classes)
    sent = docs.mapInArrow(lean(_entries(shift, shared, limits)), ENTRY_SCHEMA)
    met = cut(sent.repartition(ranges, "place").sortWithinPartitions("place").mapInArrow(lean(_pairs(few)), ENTRY_SCHEMA))
    # little is left of each range: a task unpacks several
    met = met.coalesce(max(4, ranges // 8))
    pairs = met.where("kind < 0").mapInArrow(lean(_unpacked({-1: 0, -2: 1}, PAIR)), PAIR_SCHEMA).groupBy(*PAIR[:6]).agg(F.max("more").alias("more"))
    pairs = cut(pairs)
    ends = pairs.select("s", "key", "line").unionByName(pairs.select(F.col("s2").alias("s"), F.col("key2").alias("key"), F.col("line2").alias("line")))
    texts, once = docs.select("key", "text"), ["s", "key", "line"]
    sets = cut(texts.mapInArrow(lean(_sets(_map_of(ends))), SET_SCHEMA).dropDuplicates(once))
    settled = _judged(pairs.where("s <> s2").drop("more"), sets)
    rest = cut(pairs.where("more").select(once).distinct().join(settled, once, "left_anti").join(sets, once))
    if not rest.isEmpty():
        # only lines that share an entry key with one of these, looked for where they share a prefix word
        words = sc.broadcast(bit_map(rest.select("tokens").mapInArrow(lean(_prefix_words(shared)), "h long")))
        entries = sc.broadcast(bit_map(rest.select("tokens").mapInArrow(lean(_asked_entries(shared, limits)), "h long")))
        near = cut(texts.mapInArrow(lean(_near(words, entries, shared, limits)), SET_SCHEMA).dropDuplicates(once))
        both = rest.select(SET_NAMES).mapInArrow(lean(_of_sets(shift, shared, ASK, limits)), ENTRY_SCHEMA).unionByName(near.mapInArrow(lean(_of_sets(shift, shared, SET, limits)), ENTRY_SCHEMA))
        found = both.repartition("place").sortWithinPartitions("place").mapInArrow(lean(_pairs(None)), ENTRY_SCHEMA).mapInArrow(lean(_unpacked({-1: 0}, PAIR)), PAIR_SCHEMA).drop("more").distinct()
        settled = settled.unionByName(_judged(cut(found), rest.select(SET_NAMES).unionByName(near).dropDuplicates(once))).distinct()
    names = ["s", "s2", "key", "tid", "line", "late"]
    places = met.mapInArrow(lean(_unpacked({FIRST: 0, LATE: 1}, names)), "s long, s2 long, key long, tid long, line long, late boolean")
    least = F.min(F.struct("key", "line")).over(Window.partitionBy("s", "s2"))
    firsts = places.where("NOT late").withColumn("least", least).withColumn("late", F.struct("key", "line") > F.col("least")).drop("least", "s2")
    partner = settled.withColumn("partner", F.lit(True))
    late = firsts.join(partner, ["s", "key", "line"], "left").where("late OR partner").select("key", "tid", "line")
    late = late.unionByName(places.where("late").select("key", "tid", "line"))
    return late.groupBy("key", "tid").agg(F.array_sort(F.collect_set(F.col("line").cast("int"))).alias("removed"))


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_lines, n_removed, removed) of each row; line numbers start at 0."""
    rows = keyed(docs, key, text)
    counts = rows.select("key", "tid", (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1).cast("long").alias("n_lines"))
    out = counts.join(repeated(rows), ["key", "tid"], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    return out.select(F.nullif("key", F.lit(LAST_KEY)).alias("key"), "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the lines that have an earlier match; texts that had words and keep none go."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    whole = F.coalesce(F.col(at[text]), F.lit(""))
    rows = docs.toDF(*names).select(F.coalesce(F.col(at[key]).cast("long"), F.lit(LAST_KEY)).alias("_key"), F.xxhash64(whole).alias("_tid"), *names)
    gone = repeated(keyed(docs, key, text)).withColumnsRenamed({"key": "_k", "tid": "_t"})
    both = rows.join(gone, (F.col("_key") == F.col("_k")) & (F.col("_tid") == F.col("_t")), "left")
    kept = F.array_join(F.filter(F.split(at[text], "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    left = both.withColumn("_kept", F.when(F.col("removed").isNotNull(), kept).otherwise(F.col(at[text])))
    left = left.where(F.col("removed").isNull() | F.col("_kept").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*(F.col("_kept" if c == text else n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


#: `removals` in DuckDB's SQL, with the numbers of the removed lines as text: prefixes of the rarest words find the pairs, sets verify them.
SQL = r"""
WITH t AS (
  SELECT doc_id, string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, i - 1 AS line, list_sort(list_distinct(regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+'))) AS words FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM t)
), s AS (
  SELECT words, len(words) AS n, min({'d': doc_id, 'l': line}) AS first, row_number() OVER () AS id FROM l WHERE len(words) > 0 GROUP BY words
), w AS (
  SELECT id, n, first, unnest(words) AS word FROM s
), c AS (
  SELECT word, count(*) AS k FROM w GROUP BY word
), p AS (
  SELECT id, n, first, word FROM w JOIN c USING (word) QUALIFY row_number() OVER (PARTITION BY id ORDER BY k, word) <= n - (4 * n + 4) // 5 + 1
), near AS (
  SELECT DISTINCT a.id, b.id AS other FROM p a JOIN p b ON a.word = b.word AND b.first < a.first AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
), late AS (
  SELECT DISTINCT near.id FROM near JOIN s a ON a.id = near.id JOIN s b ON b.id = near.other
  WHERE 5 * len(list_intersect(a.words, b.words)) >= 4 * (a.n + b.n - len(list_intersect(a.words, b.words)))
), gone AS (
  SELECT l.doc_id, l.line FROM l JOIN s ON l.words = s.words LEFT JOIN late ON late.id = s.id WHERE late.id IS NOT NULL OR {'d': l.doc_id, 'l': l.line} > s.first
)
SELECT t.doc_id, len(lines)::BIGINT AS n_lines, count(gone.line)::BIGINT AS n_removed, coalesce(string_agg(gone.line, ',' ORDER BY gone.line), '') AS removed
FROM t LEFT JOIN gone ON t.doc_id = gone.doc_id GROUP BY t.doc_id, len(lines)
"""
