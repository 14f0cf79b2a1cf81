"""Baseline JPEG media columns (operator 9).

`encode` stores bytes losslessly in baseline JPEG: every byte is the DC term of
its own 8 x 8 luminance block (quantised by 8, so a block decodes to exactly that
gray level), 576 blocks a row and one restart interval a row.  A payload of more
rows than one frame can hold continues in further frames of the same value.

`decode` parses the markers of any baseline JPEG, Huffman-decodes its scan and
reconstructs the DC-only luminance thumbnail in numpy.  Restart intervals are
independent of each other, so all intervals of a slice of rows are decoded in
lockstep, one symbol of each at a time.

Defined results: null counts as empty, an empty text is one row of 576 bytes of
value 255, texts of any length are stored whole, equal texts give equal values,
an empty table gives an empty table.  Rows keep only the key, so other columns
clash with nothing.  Media that are no baseline JPEG raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .textcols import buffer, slices

#: Payload bytes a row of blocks.
ROW = 576
#: Rows of blocks that a frame of at most 65,535 lines holds.
FRAME_ROWS = 8191
SLICE_BYTES = 3 << 20

#: Code lengths of the DC categories 0 to 11, made for text, and of the only AC symbol used, end of block.
DC_LENGTHS = [4, 4, 4, 3, 3, 3, 3, 3, 4, 6, 6, 6]


def canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """DHT body (16 counts, then symbols) and symbol -> (code, length)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, code, last = {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    return bytes(counts) + bytes(order), codes


_DC_BODY, _DC_CODES = canonical(dict(enumerate(DC_LENGTHS)))
_AC_BODY, _AC_CODES = canonical({0: 1})


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference from -255 to 255, the whole block's bits and their number."""
    value, length = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = _DC_CODES[size]
        extra = d if d > 0 else d + (1 << size) - 1 if size else 0
        value[d + 255], length[d + 255] = (code << size | extra) << 1, n + size + 1
    return value, length


_VALUE, _LENGTH = _block_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(rows: int) -> bytes:
    """All that comes before the scan of a frame."""
    quant = bytes([8] + [1] * 63)
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, b"\x00" + quant),
            _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0])),
            _segment(0xC4, b"\x00" + _DC_BODY),
            _segment(0xC4, b"\x10" + _AC_BODY),
            _segment(0xDD, struct.pack(">H", ROW)),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def padded(sizes: np.ndarray) -> np.ndarray:
    """Sizes filled up to a positive multiple of `ROW`."""
    return np.maximum(-(-sizes // ROW), 1) * ROW


def encode_many(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A media value for each run of bytes."""
    sizes = np.diff(offsets)
    full = padded(sizes)
    to = np.concatenate([[0], np.cumsum(full)])
    payload = np.full(to[-1], 255, np.uint8)
    payload[np.arange(len(data)) + np.repeat(to[:-1] - offsets[:-1], sizes)] = data
    # each row of blocks is one restart interval with its own DC prediction
    samples = payload.reshape(-1, ROW).astype(np.int16) - 128
    index = samples + 255
    index[:, 1:] -= samples[:, :-1]
    value, length = _VALUE[index], _LENGTH[index]
    bits = length.sum(1)
    size = -(-bits // 8)
    begin = np.concatenate([[0], np.cumsum(size)])
    at = np.cumsum(length, axis=1)
    at -= length
    at += (begin[:-1] * 8)[:, None]
    byte = (at >> 3).ravel()
    code = (value.astype(np.int64) << (24 - (at & 7) - length)).ravel()
    total = int(begin[-1])
    stream = np.bincount(byte, code >> 16, total + 2)
    stream[1:] += np.bincount(byte, code >> 8 & 255, total + 2)[:-1]
    stream[2:] += np.bincount(byte, code & 255, total + 2)[:-2]
    stream = stream[:total].astype(np.uint8)
    stream[begin[1:] - 1] |= ((1 << (size * 8 - bits)) - 1).astype(np.uint8)
    # stuff a zero after each 255, and leave room for a marker after each row
    high = stream == 255
    shift = np.cumsum(high) - high
    row_of = np.repeat(np.arange(len(size)), size)
    place = np.arange(total) + shift + 2 * row_of
    out = np.zeros(total + int(high.sum()) + 2 * len(size), np.uint8)
    out[place] = stream
    stuffed = begin[1:] + np.cumsum(high)[begin[1:] - 1] + 2 * np.arange(1, len(size) + 1)  # end of each row with its marker
    rows_of = full // ROW
    first = np.concatenate([[0], np.cumsum(rows_of)])
    number = np.arange(len(size)) - np.repeat(first[:-1], rows_of)
    out[stuffed - 2], out[stuffed - 1] = 255, 0xD0 + number % FRAME_ROWS % 8
    starts = np.concatenate([[0], stuffed])
    raw = out.tobytes()
    media = []
    for i, rows in enumerate(rows_of.tolist()):
        parts = []
        for r in range(0, rows, FRAME_ROWS):
            n = min(FRAME_ROWS, rows - r)
            a, b = starts[first[i] + r], starts[first[i] + r + n] - 2
            parts += [_head(n), raw[a:b], b"\xff\xd9"]
        media.append(b"".join(parts))
    return media


@dataclass
class Frame:
    """A parsed baseline frame: its geometry, tables and where its scan data are."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantisation table
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # id, DC table, AC table
    quant: dict[int, bytes] = field(default_factory=dict)
    huffman: dict[int, bytes] = field(default_factory=dict)
    interval: int = 0
    begin: int = 0
    end: int = 0

    def plan(self) -> list[tuple[int, int, int]]:
        """(component number, DC table, AC table) of each block of an MCU."""
        tables = {c: (d, a) for c, d, a in self.scan}
        if len(self.components) == 1:
            return [(0, *tables[self.components[0][0]])]
        return [(k, *tables[c]) for k, (c, h, v, _) in enumerate(self.components) for _ in range(h * v)]

    def mcus(self) -> tuple[int, int]:
        """MCUs across and down."""
        h, v = (max(c[i] for c in self.components) if len(self.components) > 1 else 1 for i in (1, 2))
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def layout(self) -> tuple:
        """What frames need in common to be decoded together."""
        plan = self.plan()
        return tuple((k, self.huffman[d], self.huffman[16 + a]) for k, d, a in plan)


def parse(media: bytes) -> list[Frame]:
    """The frames of a media value, in order."""
    frames, at, n = [], 0, len(media)
    while at < n:
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        frame = Frame()
        while True:
            while at + 1 < n and media[at] == 0xFF and media[at + 1] == 0xFF:
                at += 1
            if at + 4 > n or media[at] != 0xFF:
                raise ValueError("broken marker")
            marker, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
            body, at = media[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    if body[0] >> 4:
                        raise ValueError("quantisation tables of 16 bits aren't baseline")
                    frame.quant[body[0]], body = body[1:65], body[65:]
            elif marker == 0xC4:
                while body:
                    count = 17 + sum(body[1:17])
                    frame.huffman[body[0]], body = body[1:count], body[count:]
            elif marker == 0xC0:
                depth, frame.height, frame.width, k = struct.unpack(">BHHB", body[:6])
                if depth != 8 or not frame.height or not frame.width:
                    raise ValueError("no baseline frame")
                frame.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * k, 3)]
            elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise ValueError("not a baseline JPEG")
            elif marker == 0xDD:
                frame.interval = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                frame.scan = [(body[i], body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
                if len(frame.scan) != len(frame.components):
                    raise ValueError("scans of single components aren't supported")
                break
        frame.begin = at
        while True:
            at = media.find(b"\xff", at)
            if at < 0 or at + 1 >= n:
                raise ValueError("no end of image")
            if media[at + 1] == 0xD9:
                break
            if media[at + 1] and not 0xD0 <= media[at + 1] <= 0xD7:
                raise ValueError("unexpected marker in a scan")
            at += 2
        frame.end, at = at, at + 2
        frames.append(frame)
    return frames


def _lookup(body: bytes) -> np.ndarray:
    """For each 16 bits, symbol << 8 | code length; 0 where no code matches."""
    table, code, at = np.zeros(1 << 16, np.int32), 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            table[code << (16 - n) : (code + 1) << (16 - n)] = body[at] << 8 | n
            code, at = code + 1, at + 1
        code <<= 1
    return table


def _dc_terms(stream: np.ndarray, start: np.ndarray, mcus: np.ndarray, layout: tuple) -> np.ndarray:
    """DC terms of each lane (restart interval), blocks in scan order: lanes x blocks; lanes in lockstep."""
    wide = np.concatenate([stream, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
    tables: dict[bytes, np.ndarray] = {}
    for _, dc, ac in layout:
        for body in (dc, ac):
            if body not in tables:
                tables[body] = _lookup(body)
    order = np.argsort(-mcus, kind="stable")  # so that lanes that still run come first
    bit, left = start[order].astype(np.int64) * 8, mcus[order]
    last = len(window) - 1
    steps = int(left[0]) if len(left) else 0
    out = np.zeros((steps * len(layout), len(bit)), np.int16)
    guess = np.zeros((max((k for k, _, _ in layout), default=0) + 1, len(bit)), np.int32)

    def peek(b: np.ndarray) -> np.ndarray:
        return window[np.minimum(b >> 3, last)] << (b & 7).astype(np.uint32)

    for step in range(steps):
        n = int(np.searchsorted(-left, -step, side="left"))  # lanes with more MCUs than that
        b, g = bit[:n], guess[:, :n]
        for place, (k, dc, ac) in enumerate(layout):
            entry = tables[dc][peek(b) >> 16]
            b += entry & 255
            size = entry >> 8
            extra = (peek(b) >> 7 >> (25 - size).astype(np.uint32)).astype(np.int32)
            b += size
            g[k] += extra - np.where(extra < 1 << np.maximum(size - 1, 0), (1 << size) - 1, 0)
            out[step * len(layout) + place, :n] = g[k]
            if not entry.all():
                raise ValueError("broken scan data")
            entry = tables[ac][peek(b) >> 16]
            b += entry & 255
            if (entry > 255).any() or not entry.all():  # not the end of the block everywhere
                lanes, at = np.arange(n), np.zeros(n, np.int64)
                while True:
                    symbol = entry >> 8
                    if not entry.all():
                        raise ValueError("broken scan data")
                    b[lanes] += symbol & 15
                    at += np.where(symbol & 15, (symbol >> 4) + 1, np.where(symbol == 0xF0, 16, 64))
                    more = at < 63
                    lanes, at = lanes[more], at[more]
                    if not len(lanes):
                        break
                    entry = tables[ac][peek(b[lanes]) >> 16]
                    b[lanes] += entry & 255
    back = np.empty_like(out)
    back[:, order] = out
    return back.T


def thumbnails(media: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each media value, (width, height, DC-only luminance thumbnail) of its frames."""
    parsed = [parse(m) for m in media]
    groups: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    for i, frames in enumerate(parsed):
        for j, f in enumerate(frames):
            groups[f.layout()].append((i, j))
    found: dict[tuple[int, int], np.ndarray] = {}
    for layout, members in groups.items():
        scans = [np.frombuffer(media[i], np.uint8)[parsed[i][j].begin : parsed[i][j].end] for i, j in members]
        data = np.concatenate([x for s in scans for x in (s, np.array([0xFF, 0xD9], np.uint8))])
        mark = (data[:-1] == 255) & (data[1:] != 0)
        gone = np.zeros(len(data), bool)  # markers, and zeros after 255
        gone[:-1] |= mark
        gone[1:] |= data[:-1] == 255
        stream = data[~gone]
        kept = np.cumsum(~gone)
        stops = kept[np.flatnonzero(mark)]  # in the stream, where each lane ends
        starts = np.concatenate([[0], stops[:-1]])
        lane, plan = 0, []
        for i, j in members:
            f = parsed[i][j]
            across, down = f.mcus()
            interval = f.interval or across * down
            full, rest = divmod(across * down, interval)
            plan.append([interval] * full + [rest] * bool(rest))
            lane += len(plan[-1])
        if lane != len(starts):
            raise ValueError("restart markers don't fit the frame")
        mcus = np.concatenate([np.asarray(p, np.int64) for p in plan])
        terms = _dc_terms(stream, starts, mcus, layout)
        lane = 0
        for (i, j), p in zip(members, plan, strict=True):
            f = parsed[i][j]
            rows = terms[lane : lane + len(p)]
            lane += len(p)
            across, down = f.mcus()
            flat = rows[:, : p[0] * len(layout)].reshape(-1)[: across * down * len(layout)].reshape(down, across, len(layout))
            _, h, v, q = f.components[0]
            h, v = (h, v) if len(f.components) > 1 else (1, 1)
            luma = flat[:, :, : h * v].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            most = [max(c[x] for c in f.components) if len(f.components) > 1 else 1 for x in (1, 2)]
            wide, high = -(-f.width * h // (8 * most[0])), -(-f.height * v // (8 * most[1]))
            level = luma[:high, :wide].astype(np.int32) * f.quant[q][0]
            found[i, j] = np.clip((level + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    return [[(f.width, f.height, found[i, j]) for j, f in enumerate(frames)] for i, frames in enumerate(parsed)]


def feature(shape: tuple[int, int, int], pixels: np.ndarray) -> str:
    """Dimensions, frames, an average hash over 64 equal stretches and a checksum of the thumbnail."""
    mean = np.add.reduceat(pixels, np.arange(64) * len(pixels) // 64, dtype=np.int64) if len(pixels) >= 64 else np.resize(pixels.astype(np.int64), 64)
    bits = np.packbits(mean > np.median(mean)).tobytes().hex()
    return f"{shape[0]}x{shape[1]}x{shape[2]}:{bits}:{zlib.crc32(pixels):08x}"


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes as baseline JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                data, offsets = buffer(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(encode_many(data, offsets), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), "doc_id long, n_bytes long, media binary")


def decode(media: DataFrame) -> DataFrame:
    """Reads media columns back: dimensions and the DC-only thumbnail with its hashes.  A null value gives nulls."""
    schema = "doc_id long, n_bytes long, width int, height int, thumbnail binary, feature string, media_bytes long, media_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", SLICE_BYTES):
                values = part.column(2).to_pylist()
                seen = iter(thumbnails([v for v in values if v is not None]))
                rows = []
                for v in values:
                    if v is None:
                        rows.append((None,) * 6)
                        continue
                    frames = next(seen)
                    pixels = np.concatenate([t.reshape(-1) for _, _, t in frames])
                    width, height = frames[0][0], sum(f[1] for f in frames)
                    rows.append((width, height, pixels.tobytes(), feature((width, height, len(frames)), pixels), len(v), hashlib.sha256(v).hexdigest()))
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.string()]
                names = ["width", "height", "thumbnail", "feature", "media_bytes", "media_sha256"]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["doc_id", "n_bytes", *names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(lean(run), schema)
