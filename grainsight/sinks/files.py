"""Files of a run: CSV, XLSX, JSON, PNG, PDF and JPEG.

Tables are written by Spark where they may be large; a workbook, a settings file
and pictures are of bounded size and come from the driver.
"""

from __future__ import annotations

import io
import json
import os
import struct
import zipfile
import zlib
from collections.abc import Iterable, Mapping, Sequence
from typing import Any
from xml.sax.saxutils import escape

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..config import flattened, get, with_preset
from ..operators.report import export_table

#: Names of a workbook's sheets, widest column, rows that widths are taken from.
SHEETS, WIDEST, WIDTH_ROWS = ("particles", "parameters"), 60, 200
#: Rows that one worksheet holds beside its header.
SHEET_ROWS = 1_048_575


def write_csv(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """The exported columns with a header: a folder of parts written by Spark, or one file of a table that a task can hold."""
    table = export_table(rows)
    (table.coalesce(1) if one_file else table).write.mode("overwrite").option("header", "true").csv(path)


def write_csv_file(rows: DataFrame, path: str) -> None:
    """One plain CSV file in order of the ids, row by row through the driver."""
    import csv

    table = export_table(rows)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(table.columns)
        for r in table.orderBy("id").toLocalIterator():
            out.writerow(["" if v is None else v for v in r])


def _json_ready(value: Any) -> Any:
    if isinstance(value, Mapping):
        return {str(k): _json_ready(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_json_ready(v) for v in value]
    return value if isinstance(value, (str, int, float, bool)) or value is None else str(value)


def settings(config: Mapping[str, Any] | None) -> dict[str, Any]:
    """What is written of a run's settings: with the chosen preset's values, without the presets."""
    out = _json_ready(with_preset(config or {}))
    if isinstance(out.get("report"), dict):
        out["report"].pop("beta_presets", None)
    return out


def write_settings(config: Mapping[str, Any] | None, path: str, csv: str | None = None) -> None:
    """Settings as JSON, with the table's path; an older file `parameters.json` beside it goes."""
    payload = settings(config) | ({"csv": os.path.abspath(csv)} if csv else {})
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(payload, indent=2, ensure_ascii=False) + "\n")
    old = os.path.join(os.path.dirname(path), "parameters.json")
    if os.path.isfile(old) and os.path.abspath(old) != os.path.abspath(path):
        os.remove(old)


def write_json(payload: Any, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(payload, indent=2) + "\n")


def _column(i: int) -> str:
    text = ""
    while i >= 0:
        text, i = chr(65 + i % 26) + text, i // 26 - 1
    return text


def _cell(name: str, value: Any, style: int) -> str:
    if value is None or value == "":
        return ""
    if isinstance(value, bool):
        return f'<c r="{name}" s="{style}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and not (isinstance(value, float) and not np.isfinite(value)):
        return f'<c r="{name}" s="{style}"><v>{value!r}</v></c>'
    return f'<c r="{name}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _sheet(columns: Sequence[str], rows: Iterable[Sequence[Any]], tenths: frozenset[str]) -> Iterable[str]:
    """A worksheet: bold frozen header, columns as wide as their first rows need."""
    rows = iter(rows)
    first = [r for r, _ in zip(rows, range(WIDTH_ROWS), strict=False)]
    widths = [min(max([len(c), 12, *(len(str(r[i])) for r in first)]) + 2, WIDEST) for i, c in enumerate(columns)]
    yield '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>'
    yield "".join(f'<col min="{i + 1}" max="{i + 1}" width="{w}" style="{2 if c in tenths else 0}" customWidth="1"/>' for i, (c, w) in enumerate(zip(columns, widths, strict=True)))
    yield "</cols><sheetData><row r=\"1\">" + "".join(_cell(f"{_column(i)}1", c, 1) for i, c in enumerate(columns)) + "</row>"
    number = 1
    for group in (first, rows):
        for r in group:
            number += 1
            if number > SHEET_ROWS + 1:
                raise ValueError("a worksheet can't hold so many rows; write CSV")
            yield f'<row r="{number}">' + "".join(_cell(f"{_column(i)}{number}", v, 2 if c in tenths else 0) for i, (c, v) in enumerate(zip(columns, r, strict=True))) + "</row>"
    yield "</sheetData></worksheet>"


def workbook(rows: DataFrame, config: Mapping[str, Any] | None = None) -> bytes:
    """An XLSX file of the exported table and the parameters, rows streamed one by one; more rows than a sheet holds are an error."""
    table = export_table(rows)
    parameters = [(k, v) for k, v in flattened(dict(config))] if config else []
    sheets = [
        _sheet(table.columns, (tuple(r) for r in table.orderBy("id").toLocalIterator()), frozenset({"x_global_um", "y_global_um", "size_um"})),
        _sheet(["parameter", "value"], parameters, frozenset()),
    ]
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    packages = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    numbers = range(1, len(SHEETS) + 1)
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="{packages}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in numbers) + "</Types>",
        "_rels/.rels": f'{head}<Relationships xmlns="{packages}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(numbers, SHEETS, strict=True)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{packages}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + f'<Relationship Id="rId9" Type="{office}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'{head}<styleSheet xmlns="{main}"><numFmts count="1"><numFmt numFmtId="164" formatCode="0.0"/></numFmts><fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><name val="Calibri"/></font></fonts><fills count="1"><fill><patternFill patternType="none"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" applyFont="1"/><xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
        for i, sheet in zip(numbers, sheets, strict=True):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                for piece in sheet:
                    f.write(piece.encode())
    return out.getvalue()


def write_bytes(data: bytes, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def png(image: np.ndarray, dpi: float | None = None) -> bytes:
    """A PNG of 8 or 16 bits, gray or RGB; resolution in dots per inch."""
    image = np.asarray(image)
    bits, colour = 8 * image.dtype.itemsize, 2 if image.ndim == 3 else 0
    if image.dtype not in (np.uint8, np.uint16):
        raise ValueError("a PNG holds 8 or 16 bit numbers")
    height, width = image.shape[:2]
    rows = np.ascontiguousarray(image.astype(image.dtype.newbyteorder(">"))).view(np.uint8).reshape(height, -1)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], 1).tobytes()

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    density = chunk(b"pHYs", struct.pack(">IIB", *[round(dpi / 0.0254)] * 2, 1)) if dpi and dpi > 0 else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, 0)) + density + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def png_dpi(data: bytes) -> float | None:
    """The resolution that a PNG states."""
    at = data.find(b"pHYs")
    if at < 0 or len(data) < at + 13:
        return None
    x, _, unit = struct.unpack(">IIB", data[at + 4 : at + 13])
    return x * 0.0254 if unit == 1 and x > 0 else None


def jpeg(spark: SparkSession, rgb: np.ndarray, quality: int = 90) -> bytes:
    """A JPEG of an RGB picture, encoded by the driver's JVM."""
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(png(rgb))))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    how.setCompressionMode(2)  # explicit
    how.setCompressionQuality(float(quality) / 100)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    stream.close()
    writer.dispose()
    return bytes(out.toByteArray())


#: Points of a page and of its margin.
PAGE, MARGIN = (595, 842), 31


class Pdf:
    """A minimal PDF: pages of text lines and pictures."""

    def __init__(self):
        self.objects: list[bytes] = [b"", b""]  # catalogue and page tree
        self.font = self._add(b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>")
        self.bold = self._add(b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica-Bold/Encoding/WinAnsiEncoding>>")
        self.pages: list[int] = []

    def _add(self, body: bytes) -> int:
        self.objects.append(body)
        return len(self.objects)

    def _stream(self, head: bytes, data: bytes) -> int:
        return self._add(b"<<" + head + b"/Length %d>>stream\n" % len(data) + data + b"\nendstream")

    def page(self, lines: Sequence[tuple[str, int, bool]], pictures: Sequence[tuple[str, np.ndarray]] = ()) -> None:
        """Lines (text, size, bold) from the top, then pictures with captions that share the rest of the page."""
        y, ops, images = PAGE[1] - MARGIN, [], {}

        def write(text: str, size: int, bold: bool) -> None:
            nonlocal y
            y -= size * 1.4
            raw = text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
            ops.append(b"BT /F%d %d Tf %d %.1f Td (" % (2 if bold else 1, size, MARGIN, y) + raw + b") Tj ET")

        for line in lines:
            write(*line)
        room = (y - MARGIN) / max(len(pictures), 1) - 30
        for i, (caption, rgb) in enumerate(pictures):
            write(caption, 10, False)
            height, width = rgb.shape[:2]
            scale = min((PAGE[0] - 2 * MARGIN) / width, max(room, 1) / height)
            y -= height * scale + 6
            ops.append(b"q %.2f 0 0 %.2f %d %.1f cm /I%d Do Q" % (width * scale, height * scale, MARGIN, y, i))
            images[i] = self._stream(b"/Type/XObject/Subtype/Image/Width %d/Height %d/ColorSpace/DeviceRGB/BitsPerComponent 8/Filter/FlateDecode" % (width, height), zlib.compress(np.ascontiguousarray(rgb, np.uint8).tobytes(), 6))
        content = self._stream(b"", b"\n".join(ops))
        used = b" ".join(b"/I%d %d 0 R" % x for x in images.items())
        self.pages.append(self._add(b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 %d %d]/Contents %d 0 R/Resources<</Font<</F1 %d 0 R/F2 %d 0 R>>/XObject<<" % (*PAGE, content, self.font, self.bold) + used + b">>>>>>"))

    def data(self) -> bytes:
        self.objects[0] = b"<</Type/Catalog/Pages 2 0 R>>"
        self.objects[1] = b"<</Type/Pages/Count %d/Kids[" % len(self.pages) + b" ".join(b"%d 0 R" % p for p in self.pages) + b"]>>"
        out, at = bytearray(b"%PDF-1.4\n"), []
        for i, body in enumerate(self.objects, 1):
            at.append(len(out))
            out += b"%d 0 obj" % i + body + b"endobj\n"
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(at) + 1) + b"".join(b"%010d 00000 n \n" % a for a in at)
        return bytes(out + b"trailer<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(at) + 1, start))


def report_pdf(rows: DataFrame, config: Mapping[str, Any], mosaic: tuple[np.ndarray, np.ndarray] | None = None, unplaced: Iterable[tuple[str, np.ndarray, np.ndarray]] = ()) -> bytes:
    """A run's report: summary, the mosaic with and without circles, and each photo without a place."""
    from ..operators import report

    um = lambda v: f"{v / 1000:.1f}"
    s = report.summary(rows).head()
    lines = [("Particles", 18, True), (str(get(config, "input_dir", "") or ""), 10, False), (f"{s['n']} particles; mean {um(s['mean'])}, deviation {um(s['std'])}, from {um(s['min'])} to {um(s['max'])} micrometres", 10, False), ("At least", 12, True)]
    lines += [(f"{r['threshold_um']:g} micrometres: {r['n']}", 10, False) for r in report.at_least(rows).collect()]
    least = float(get(config, "detection.min_size_nm", 0) or 0) / 1000
    bins = report.histogram(rows, least).orderBy("bin").limit(40).collect()
    lines += [("Sizes", 12, True), *((f"{report.bin_label(r['left_um'], r['right_um'])}: {r['n']}", 9, False) for r in bins)]
    pdf = Pdf()
    pdf.page(lines)
    if mosaic is not None and mosaic[0].size:
        pdf.page([("Mosaic", 18, True)], [("With circles", mosaic[0]), ("Without", mosaic[1])])
    for name, marked, plain in unplaced:
        pdf.page([(name, 14, True)], [(t, p) for t, p in (("With circles", marked), ("Without", plain)) if p.size])
    return pdf.data()
