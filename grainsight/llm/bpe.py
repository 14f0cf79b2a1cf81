"""Byte-level BPE encoding and decoding (operator 7).

Encoding splits a text into pre-tokens, then merges the bytes of each one with
a priority queue of merge ranks over a doubly linked list of symbols; queue
entries whose pair has changed since are skipped.  Decoding concatenates the
vocabulary's byte strings.  Nothing is shuffled: texts are encoded where they
are read, and a bounded memo per Python worker keeps the ids of pre-tokens.

Defined results: a null text counts as empty, an empty text has no ids, a text
of any length is encoded whole, repeated rows are encoded alike, an empty table
gives an empty table.  Extra input columns pass through in `encode` and clash
with nothing but the names that it adds, which it replaces.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .common import lean
from .textcols import slices

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Memo entries per Python worker, about 200 bytes each.
MEMO_ENTRIES = 800_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols, spare = [""] * 256, 256
    for b in range(256):
        if b in kept:
            symbols[b] = chr(b)
        else:
            symbols[b], spare = chr(spare), spare + 1
    return symbols


class _Memo(dict):
    """Packed ids by pre-token; forgets all once it is full."""

    def __init__(self, merge_word: Callable[[bytes], list[int]]):
        super().__init__()
        self.merge_word = merge_word

    def __missing__(self, word: str) -> bytes:
        packed = array("I", self.merge_word(word.encode()))
        packed = (packed if sys.byteorder == "little" else packed.byteswap() or packed).tobytes()
        if len(word) <= 64:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[word] = packed
        return packed


class Codec:
    """Encoder and decoder for one tokenizer file in the JSON format of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE vocabulary is needed")
        symbols = byte_symbols()
        to_byte = {c: b for b, c in enumerate(symbols)}
        vocab: dict[str, int] = model["vocab"]
        self.start = [vocab[c] for c in symbols]
        self.merge: dict[int, int] = {}  # left << 32 | right -> rank
        self.merged: list[int] = []  # rank -> id
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge.setdefault(vocab[a] << 32 | vocab[b], rank)
            self.merged.append(vocab[a + b])
        self.bytes_of = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memo = _Memo(self.merge_word)

    def merge_word(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        ids = [self.start[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        rank_of, merged = self.merge.get, self.merged
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            rank = rank_of(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                queue.append(rank << 32 | i)
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of(ids[i] << 32 | ids[j]) != rank:
                continue  # stale: one of the two was merged meanwhile
            new = ids[i] = merged[rank]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = rank_of(new << 32 | ids[k])
                if rank is not None:
                    push(queue, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = rank_of(ids[h] << 32 | new)
                if rank is not None:
                    push(queue, rank << 32 | h)
        return [i for i in ids if i >= 0]

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or self.cut.search(text) is None:
            return self._ordinary(text)
        return b"".join(self.special[part].to_bytes(4, "little") if part in self.special else self._ordinary(part) for part in self.cut.split(text) if part)

    def _ordinary(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return memoryview(self.packed(text)).cast("I").tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per file and Python worker."""
    return Codec(path)


def _rows(path: str, text: str, row: Callable[[Codec, str], tuple], fields: list[pa.Field], keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in (part for whole in batches for part in slices(whole, text)):
            rows = [row(c, x or "") for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)]
            kept = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*keep, *(f.name for f in fields)])

    return run


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with a column of token ids; null texts get an empty list."""
    keep = [c for c in docs.columns if c != ids]
    schema = docs.select(*keep).schema.add(ids, ArrayType(IntegerType()), False)
    return docs.select(*keep).mapInArrow(lean(_rows(path, text, lambda c, x: (c.encode(x),), [pa.field(ids, pa.list_(pa.int32()))], keep)), schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`docs` with the text of a column of token ids; a null list gives a null text."""
    keep = [c for c in docs.columns if c != text]
    schema = docs.select(*keep).schema.add(text, StringType(), True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            out = pa.array([None if x is None else c.decode(x) for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*keep, text])

    return docs.select(*keep).mapInArrow(lean(run), schema)


def _digest(c: Codec, text: str) -> tuple:
    packed = c.packed(text)
    ids = memoryview(packed).cast("I").tolist()
    decoded = c.decode(ids)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, then decode from the ids, each text; the number of ids and the digests of both forms."""
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(_rows(path, "text", _digest, fields, ["doc_id"])), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
