"""Photos from bytes: PNG, BMP and TIFF in numpy; what a file is follows from its first bytes, not from its name.

JPEG is told apart and measured here; its pixels come from Spark's own image
source (see `tiles.photos`).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: What files of each kind begin with.
MAGIC = {"jpeg": (b"\xff\xd8\xff",), "bmp": (b"BM",), "png": (b"\x89PNG",), "tiff": (b"II*\x00", b"MM\x00*")}


def kind(head: bytes) -> str:
    return next((k for k, starts in MAGIC.items() if head.startswith(starts)), "unknown")


def size(data: bytes) -> tuple[int, int] | None:
    """(height, width) from a file's header; null where it doesn't say."""
    what = kind(data[:8])
    if what == "png" and data[12:16] == b"IHDR" and len(data) >= 24:
        width, height = struct.unpack(">II", data[16:24])
        return height, width
    if what == "bmp" and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        return abs(height), abs(width)
    if what == "tiff":
        tags, _ = Tiff(data).directory()
        return (tags[257][0], tags[256][0]) if 256 in tags and 257 in tags else None
    return jpeg_size(data) if what == "jpeg" else None


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """(height, width) of the first frame header: markers C0 to CF but for C4, C8 and CC."""
    at = 2
    while (at := data.find(b"\xff", at)) >= 0 and at + 4 <= len(data):
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker in (0x00, 0x01) or 0xD0 <= marker <= 0xD8:
            at += 2
        elif marker == 0xD9:
            return None
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return struct.unpack(">HH", data[at + 5 : at + 9]) if at + 9 <= len(data) else None
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def gray(image: np.ndarray) -> np.ndarray:
    """Two dimensions: the luma of RGB(A); of a stack the first of up to four pages, else means along the last axis."""
    image = np.asarray(image)
    if image.ndim == 3 and image.shape[-1] in (3, 4):
        if image.dtype == np.uint8:
            weights = np.array([9798, 19235, 3735], np.int64)  # 0.299, 0.587 and 0.114 of 2**15
            return ((image[..., :3].astype(np.int64) @ weights + (1 << 14)) >> 15).astype(np.uint8)
        return image[..., :3].astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32)
    while image.ndim > 2:
        image = image[0] if len(image) <= 4 else image.mean(-1, dtype=np.float32)
    return image


def read(data: bytes) -> np.ndarray:
    """The pixels of a PNG, BMP or TIFF as they are stored; ValueError for anything else."""
    found = {"png": png, "bmp": bmp, "tiff": tiff}.get(kind(data[:8]))
    if found is None:
        raise ValueError("not a PNG, BMP or TIFF file")
    try:
        return found(data)
    except (struct.error, zlib.error, IndexError, KeyError) as e:
        raise ValueError(f"a broken image file: {e}") from e


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """A PNG's rows without their filters; `step` is the bytes of a pixel, one at least."""
    rows = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride), np.uint8)
    for y in range(height):
        how, line, above = rows[y, 0], rows[y, 1:], out[y]
        if how == 0:
            out[y + 1] = line
        elif how == 1:
            wide = np.zeros(-(-stride // step) * step, np.uint8)
            wide[:stride] = line
            out[y + 1] = np.cumsum(wide.reshape(-1, step), 0, dtype=np.uint8).ravel()[:stride]
        elif how == 2:
            out[y + 1] = line + above
        elif how in (3, 4):
            done, up = bytearray(step) + line.tobytes(), bytes(step) + above.tobytes()
            for i in range(step, stride + step):
                a, b = done[i - step], up[i]
                if how == 3:
                    guess = a + b >> 1
                else:
                    c = up[i - step]
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                done[i] = done[i] + guess & 255
            out[y + 1] = np.frombuffer(bytes(done[step:]), np.uint8)
        else:
            raise ValueError("an unknown PNG filter")
    return out[1:]


def _unpacked(rows: np.ndarray, width: int, channels: int, bits: int) -> np.ndarray:
    """height x width x channels from rows of bytes, most significant bits first."""
    if bits == 16:
        values = rows.reshape(len(rows), -1, 2).astype(np.uint16)
        return (values[..., 0] << 8 | values[..., 1])[:, : width * channels].reshape(len(rows), width, channels)
    if bits < 8:
        each = np.unpackbits(rows, axis=1).reshape(len(rows), -1, bits)
        rows = (each @ (1 << np.arange(bits - 1, -1, -1))).astype(np.uint8)
    return rows[:, : width * channels].reshape(len(rows), width, channels)


def png(data: bytes) -> np.ndarray:
    """All colour types and depths, also interlaced; gray of few bits at full scale, palettes as colours."""
    at, chunks = 8, {}
    while at + 8 <= len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        chunks.setdefault(name, []).append(data[at + 8 : at + 8 + n])
        at += 12 + n
    width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"][0])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw, step = zlib.decompress(b"".join(chunks[b"IDAT"])), max(1, channels * bits // 8)
    out = np.zeros((height, width, channels), np.uint16 if bits == 16 else np.uint8)
    # the seven passes of an interlaced file: first row and column, and the steps between them
    passes = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)) if interlaced else ((0, 0, 1, 1),)
    at = 0
    for y, x, dy, dx in passes:
        h, w = -(-(height - y) // dy), -(-(width - x) // dx)
        if h <= 0 or w <= 0:
            continue
        stride = -(-w * channels * bits // 8)
        out[y::dy, x::dx] = _unpacked(_unfiltered(raw[at:], h, stride, step), w, channels, bits)
        at += h * (stride + 1)
    if colour == 3:
        return np.frombuffer(chunks[b"PLTE"][0], np.uint8).reshape(-1, 3)[out[..., 0]]
    if bits < 8:
        out = out * np.uint8(255 // ((1 << bits) - 1))
    return out[..., 0] if channels <= 2 else out


def bmp(data: bytes) -> np.ndarray:
    """Uncompressed, with 1, 4 or 8 bits and a palette, or 24 or 32 bits; a gray palette gives gray."""
    offset, header = struct.unpack("<I", data[10:14])[0], struct.unpack("<I", data[14:18])[0]
    width, height, _, bits, packed = struct.unpack("<iiHHI", data[18:34])
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError("a compressed or unusual BMP file")
    stride = -(-width * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, abs(height) * stride, offset).reshape(abs(height), stride)
    rows = rows if height < 0 else rows[::-1]
    if bits >= 24:
        return np.ascontiguousarray(rows[:, : width * bits // 8].reshape(len(rows), width, bits // 8)[..., 2::-1])
    colours = (offset - 14 - header) // 4
    palette = np.frombuffer(data, np.uint8, colours * 4, 14 + header).reshape(-1, 4)[:, 2::-1]
    index = _unpacked(rows, width, 1, bits)[..., 0]
    is_gray = (palette == palette[:, :1]).all()
    return palette[index, 0] if is_gray else palette[index]


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 1 if n == 128 else 2
    return bytes(out)


def _lzw(data: bytes) -> bytes:
    """TIFF's variant: codes of 9 to 12 bits, most significant first, one code early."""
    bits, have, out = 0, 0, bytearray()
    table: list[bytes] = []
    width, last = 9, b""
    for byte in data:
        bits, have = (bits << 8 | byte) & 0xFFFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = bits >> have & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        piece = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + piece[:1])
            width = min(12, max(9, (len(table) + 1).bit_length()))
        out += piece
        last = piece
    return bytes(out)


class Tiff:
    """The directories of a TIFF file."""

    #: Bytes and letters of the field types.
    TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}

    def __init__(self, data: bytes):
        self.data, self.order = data, "<" if data[:2] == b"II" else ">"
        self.first = struct.unpack(self.order + "I", data[4:8])[0]

    def directory(self, at: int | None = None) -> tuple[dict[int, tuple], int]:
        """(values by tag, where the next directory is)."""
        at, tags = self.first if at is None else at, {}
        n = struct.unpack(self.order + "H", self.data[at : at + 2])[0]
        for i in range(n):
            entry = self.data[at + 2 + 12 * i : at + 14 + 12 * i]
            tag, kind_, count = struct.unpack(self.order + "HHI", entry[:8])
            if kind_ not in self.TYPES:
                continue
            form = f"{self.order}{count}{self.TYPES[kind_]}"
            wide = struct.calcsize(form)
            where = struct.unpack(self.order + "I", entry[8:])[0] if wide > 4 else None
            tags[tag] = struct.unpack(form, entry[8 : 8 + wide] if where is None else self.data[where : where + wide])
        return tags, struct.unpack(self.order + "I", self.data[at + 2 + 12 * n : at + 6 + 12 * n])[0]

    def page(self, tags: dict[int, tuple]) -> np.ndarray:
        one = lambda tag, default: tags.get(tag, (default,))[0]
        width, height, channels, bits = tags[256][0], tags[257][0], one(277, 1), one(258, 1)
        packing, apart = one(259, 1), one(284, 1) == 2 and one(277, 1) > 1
        undo = {1: bytes, 5: _lzw, 8: zlib.decompress, 32773: _packbits, 32946: zlib.decompress}[packing]
        if 324 in tags:
            h, w, offsets, counts = tags[323][0], tags[322][0], tags[324], tags[325]
        else:
            h, w, offsets, counts = min(one(278, height), height), width, tags[273], tags.get(279) or (len(self.data),)
        each = 1 if apart else channels
        if bits in (8, 16, 32, 64):
            letter = {1: "u", 2: "i", 3: "f"}[one(339, 1)]
            dtype = np.dtype(f"{self.order}{letter}{bits // 8}")
        elif bits < 8:
            dtype = np.dtype("u1")
        else:
            raise ValueError(f"TIFF samples of {bits} bits")
        out = np.zeros((height, width, channels), dtype.newbyteorder("="))
        across, down = -(-width // w), -(-height // h)
        for i, (offset, count) in enumerate(zip(offsets, counts, strict=False)):
            plane, i = divmod(i, across * down) if apart else (0, i)
            y, x = i // across * h, i % across * w
            raw = undo(self.data[offset : offset + count])
            if bits < 8:
                stride = -(-w * each * bits // 8)
                part = _unpacked(np.frombuffer(raw, np.uint8)[: len(raw) // stride * stride].reshape(-1, stride), w, each, bits)
            else:
                part = np.frombuffer(raw, dtype)
                part = part[: len(part) // (w * each) * w * each].reshape(-1, w, each).astype(out.dtype)
            if one(317, 1) == 2:
                part = np.cumsum(part, 1, dtype=out.dtype)
            hh, ww = min(len(part), height - y, h), min(w, width - x)
            out[y : y + hh, x : x + ww, plane : plane + each] = part[:hh, :ww]
        return out[..., 0] if channels == 1 else out


def tiff(data: bytes) -> np.ndarray:
    """Strips or tiles, plain, LZW, deflate or PackBits; pages alike in size make a stack."""
    file, pages, at, seen = Tiff(data), [], None, set()
    while at != 0 and at not in seen:
        seen.add(at)
        tags, following = file.directory(at)
        pages.append(file.page(tags))
        at = following
    alike = [p for p in pages if p.shape == pages[0].shape and p.dtype == pages[0].dtype]
    return pages[0] if len(alike) == 1 else np.stack(alike)
