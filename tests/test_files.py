"""Sources and sinks: decoding, listing, matching, results of earlier runs, files of a run."""

import io
import json
import os
import re
import struct
import zipfile
import zlib

import numpy as np
import photos as make
import pytest
from grainsight import config
from grainsight.operators import capture
from grainsight.plans import run as runs
from grainsight.sinks import files
from grainsight.sources import decode, results, tiles
from grainsight.streaming import jobs, scan
from pyspark.sql import functions as F

RNG = np.random.default_rng(4)
GRAY = RNG.integers(0, 255, (13, 17), np.uint8)
RGB = RNG.integers(0, 255, (13, 17, 3), np.uint8)


def tiff(image, order="<", packing=1, predictor=1, rows=5):
    """A TIFF with strips."""
    image = np.asarray(image)
    h, w, c = (*image.shape, 1)[:3]
    body, offsets, counts = b"", [], []
    for y in range(0, h, rows):
        part = image[y : y + rows].reshape(-1, w, c)
        if predictor == 2:
            part = np.concatenate([part[:, :1], np.diff(part, axis=1)], 1).astype(image.dtype)
        raw = part.astype(part.dtype.newbyteorder(order)).tobytes()
        raw = {1: raw, 8: zlib.compress(raw), 32773: b"".join(bytes([min(len(raw) - i, 128) - 1]) + raw[i : i + 128] for i in range(0, len(raw), 128))}[packing]
        offsets.append(8 + len(body))
        counts.append(len(raw))
        body += raw
    body += b"\0" * (len(body) % 2)
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [image.dtype.itemsize * 8] * c), (259, 3, [packing]), (273, 4, offsets), (277, 3, [c]), (278, 4, [rows]), (279, 4, counts), (317, 3, [predictor]), (339, 3, [kind] * c)]
    at = 8 + len(body)
    extra, entries = b"", b""
    for tag, form, values in tags:
        raw = struct.pack(order + str(len(values)) + {3: "H", 4: "I"}[form], *values)
        where = raw.ljust(4, b"\0")
        if len(raw) > 4:
            where = struct.pack(order + "I", at + 6 + 12 * len(tags) + len(extra))
            extra += raw
        entries += struct.pack(order + "HHI", tag, form, len(values)) + where
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at)
    return head + body + struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0) + extra


def bmp(image):
    h, w = image.shape[:2]
    bits = 8 if image.ndim == 2 else 24
    rows = image[::-1] if bits == 8 else image[::-1, :, ::-1]
    stride = -(-w * bits // 32) * 4
    raw = b"".join(r.tobytes().ljust(stride, b"\0") for r in rows)
    palette = b"".join(bytes([i, i, i, 0]) for i in range(256)) if bits == 8 else b""
    start = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", start + len(raw), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, len(raw), 0, 0, 0, 0) + palette + raw


def filtered_png(image, how):
    """A PNG whose rows use one filter."""
    h, w = image.shape[:2]
    step = 1 if image.ndim == 2 else 3
    rows = image.reshape(h, -1).astype(int)
    left = np.pad(rows, ((0, 0), (step, 0)))[:, : rows.shape[1]]
    up = np.vstack([np.zeros_like(rows[:1]), rows[:-1]])
    corner = np.pad(up, ((0, 0), (step, 0)))[:, : rows.shape[1]]
    p = left + up - corner
    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
    guess = [np.zeros_like(rows), left, up, (left + up) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))][how]
    raw = b"".join(bytes([how]) + bytes(r) for r in ((rows - guess) % 256).astype(np.uint8))
    plain = files.png(image)
    at, end = plain.index(b"IDAT"), plain.index(b"IEND")
    data = zlib.compress(raw)
    return plain[: at - 4] + struct.pack(">I", len(data)) + b"IDAT" + data + struct.pack(">I", zlib.crc32(b"IDAT" + data)) + plain[end - 4 :]


@pytest.mark.parametrize("image", [GRAY, RGB, GRAY.astype(np.uint16) * 200])
def test_png(image):
    data = files.png(image, dpi=300)
    assert np.array_equal(decode.read(data), image) and decode.size(data) == (13, 17) and files.png_dpi(data) == pytest.approx(300, abs=0.1)


@pytest.mark.parametrize("how", range(5))
def test_png_filters(how):
    for image in (GRAY, RGB):
        assert np.array_equal(decode.read(filtered_png(image, how)), image)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("packing", [1, 8, 32773])
def test_tiff(order, packing):
    for image in (GRAY, RGB, GRAY.astype(np.uint16) * 257, GRAY.astype(np.float32) / 7):
        data = tiff(image, order, packing)
        assert np.array_equal(decode.read(data), image) and decode.size(data) == (13, 17)
    assert np.array_equal(decode.read(tiff(GRAY, order, packing, predictor=2)), GRAY)


def test_tiff_lzw():
    """Codes 256, 65, 258 (a repeated byte), 257 of nine bits each."""
    bits = "".join(f"{c:09b}" for c in (256, 65, 258, 257))
    data = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    assert decode._lzw(data) == b"AAA"


def test_bmp():
    for image in (GRAY, RGB):
        assert np.array_equal(decode.read(bmp(image)), image) and decode.size(bmp(image)) == (13, 17)


def test_gray():
    assert decode.gray(np.full((2, 2, 3), [255, 0, 0], np.uint8))[0, 0] == 76
    assert decode.gray(np.stack([GRAY, GRAY + 1])).shape == GRAY.shape
    assert decode.gray(np.full((2, 2, 3), 100, np.uint16))[0, 0] == pytest.approx(100)


@pytest.mark.parametrize("data", [b"", b"xx", b"\x89PNG", b"BM", b"II*\x00", files.png(GRAY)[:40], tiff(GRAY)[:100]])
def test_broken(data):
    with pytest.raises(ValueError):
        decode.read(data)


@pytest.fixture
def folder(tmp_path):
    """Grid photos, a mislabelled JPEG, a submap with shots, and files that don't count."""
    top = tmp_path / "input v1"

    def put(name, data):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(data)

    put("R3_5_1_5X.tif", tiff(GRAY))
    put("R3_2_0_5X.tif", tiff(GRAY))
    put("r4_6_2_10x.bmp", bmp(RGB))
    put("loose.png", files.png(GRAY))
    put("notes.txt", b"text")
    put("v2/wafer_shot_0_quad1_exp200.png", files.png(GRAY))
    put("v2/other.png", files.png(GRAY))
    put("deep/er/x.png", files.png(GRAY))
    return top, put


def test_listing(spark, folder):
    top, _ = folder
    rows = tiles.list_tiles(spark, str(top)).orderBy("place").collect()
    assert [r.rel for r in rows] == ["R3_2_0_5X.tif", "R3_5_1_5X.tif", "r4_6_2_10x.bmp", "loose.png", "v2/wafer_shot_0_quad1_exp200.png"]
    assert [r.rel for r in tiles.submap_tiles(spark, str(top)).collect()] == ["v2/wafer_shot_0_quad1_exp200.png"]
    names = lambda **k: {r.rel for r in tiles.match(tiles.list_tiles(spark, str(top)), tiles.TILE_PATTERN, **k).collect()}
    assert names() == {"R3_5_1_5X.tif", "r4_6_2_10x.bmp"}
    assert names(run=3) == {"R3_5_1_5X.tif"} and names(magnification=10) == {"r4_6_2_10x.bmp"}
    assert names(run=3, unmatched=True) == {"R3_5_1_5X.tif", "loose.png", "v2/wafer_shot_0_quad1_exp200.png"}
    assert {r.folder for r in tiles.input_folders(spark, str(top.parent)).collect()} == {"input v1", "input v1/v2", "input v1/deep/er"}
    assert {r.tile for r in tiles.tile_ids(tiles.list_tiles(spark, str(top))).collect()} >= {"v2/wafer_shot_0_quad1_exp200.png", "loose.png"}
    assert tiles.unplaced(tiles.list_tiles(spark, str(top)), tiles.TILE_PATTERN).count() == 2
    origin = tiles.grid_origin(tiles.match(tiles.list_tiles(spark, str(top)), tiles.TILE_PATTERN)).head()
    assert (origin.row0, origin.col0) == (5, 1)


def test_photos(spark, folder):
    top, put = folder
    put("(1,1).tif", files.jpeg(spark, np.repeat(np.full((16, 24, 1), 120, np.uint8), 3, -1)))
    put("broken.png", b"\x89PNG....")
    got = {os.path.basename(r.path): r for r in tiles.photos(spark, str(top)).collect()}
    assert np.array_equal(tiles.pixels(got["R3_5_1_5X.tif"].height, got["R3_5_1_5X.tif"].width, got["R3_5_1_5X.tif"].dtype, bytes(got["R3_5_1_5X.tif"].pixels)), GRAY)
    jpeg = got["(1,1).tif"]
    assert (jpeg.height, jpeg.width) == (16, 24) and abs(np.frombuffer(bytes(jpeg.pixels), np.uint8).astype(int) - 120).max() <= 2
    assert got["broken.png"].pixels is None
    content = tiles.list_tiles(spark, str(top), content=True)
    sizes = {os.path.basename(r.path): (r.kind, r.height, r.width) for r in tiles.sizes(content).collect()}
    assert sizes["(1,1).tif"] == ("jpeg", 16, 24) and sizes["r4_6_2_10x.bmp"] == ("bmp", 13, 17) and sizes["broken.png"][1] is None
    assert content.select(tiles.kind(F.col("content")).alias("k")).where("k = 'tiff'").count() == 2


def test_resolve():
    roots = {"cwd": "/c", "package": "/p", "inputs": "/w/Inputs", "workspace": "/w"}
    there = {"/w/Inputs/R3", "/p/../x", "/abs"}
    assert tiles.resolve(" 'R3' ", roots, there.__contains__) == "/w/Inputs/R3"
    assert tiles.resolve("Inputs/R3", roots, there.__contains__) == "/w/Inputs/R3"
    assert tiles.resolve("/abs", roots, there.__contains__) == "/abs"
    for bad in ("", "nowhere"):
        with pytest.raises(FileNotFoundError):
            tiles.resolve(bad, roots, there.__contains__)


def test_sides(spark):
    paths = spark.createDataFrame([("a/N.png",), ("a/s.png",), ("b/wafer_shot_0_quad1_exp9.png",), ("c/(1,2)_N.png",), ("c/(1,2)_S.tif",), ("c/(1,2)_S.png",), ("c/(1,2)_E.png",), ("c/(1,2)_W.png",), ("c/(3,4)_N.png",)], "path string")
    found = {r.folder: r for r in tiles.directions(paths.where("path NOT LIKE 'c/%'")).collect()}
    assert found["a"].N == "a/N.png" and found["a"].S == "a/s.png" and found["a"].E is None and found["b"].E.endswith("quad1_exp9.png")
    cells = tiles.cell_sides(paths).collect()
    assert [(r.row, r.col, r.N) for r in cells] == [(1, 2, "c/(1,2)_N.png")]
    with pytest.raises(Exception, match="several photos"):
        tiles.directions(spark.createDataFrame([("a/N.png",), ("a/n.tif",)], "path string")).collect()
    kin = tiles.combined_family(spark.createDataFrame([("v4/combi_2of4.png",), ("v4/wafer_shot_0_quad0_exp1.png",), ("v3/combi.png",), ("v3/N.png",), ("x/combi.png",)], "path string"))
    assert {r.path: r.siblings for r in kin.collect() if "combi" in r.path} == {"v4/combi_2of4.png": "light", "v3/combi.png": "nsew", "x/combi.png": ""}


def test_freshness(spark):
    sources = spark.createDataFrame([("o1", 5), ("o1", 7), ("o2", 7), ("o3", 1)], "output string, modified int")
    outputs = spark.createDataFrame([("o1", 7, True), ("o2", 6, True), ("o4", 1, False)], "path string, modified int, readable boolean")
    assert {r.path: r.current for r in tiles.current_outputs(outputs, sources).collect()} == {"o1": True, "o2": False, "o3": False, "o4": False}


@pytest.fixture
def particles(spark):
    rows = [(1, 335260.0, 10060.0, 15620.0, "N.png", 0.5), (2, 1000.0, 2000.0, 30000.0, "S.png", 0.25)]
    return spark.createDataFrame(rows, "id long, x_global double, y_global double, size double, source_tile string, confidence double")


def test_tables(spark, particles, tmp_path):
    path = str(tmp_path / "out" / "particles.csv")
    files.write_csv_file(particles, path)
    assert open(path).read().splitlines()[:2] == ["id,x_global_um,y_global_um,size_um,source_tile,confidence", "1,335.3,10.1,15.6,N.png,0.5"]
    files.write_csv(particles, str(tmp_path / "folder"), one_file=True)
    back = results.read_particles(spark, path).orderBy("id").collect()
    assert (back[0].x_global, back[0].key) == (pytest.approx(335300.0), "NSEW_335300_10100")
    with pytest.raises(ValueError, match="missing"):
        (tmp_path / "bad.csv").write_text("id,size\n1,2\n")
        results.read_particles(spark, str(tmp_path / "bad.csv"))
    book = zipfile.ZipFile(io.BytesIO(files.workbook(particles, {"a": {"b": [1, 2]}, "c": True})))
    first, second = (book.read(f"xl/worksheets/sheet{i}.xml").decode() for i in (1, 2))
    assert 'state="frozen"' in first and "<v>335.3</v>" in first and "a.b" in second and "[1, 2]" in second
    assert re.search(r'width="14"', first) and book.testzip() is None


def test_settings(spark, particles, tmp_path):
    settings = {"input_dir": "in/x", "pixel_size_nm": 3610, "detection": {"min_size_nm": 20000}, "report": {"f_beta": 1.0, "beta_presets": [{"beta": 1, "model_path": "m", "threshold": 0.31}]}}
    csv = str(tmp_path / "r1" / "particles.csv")
    files.write_csv_file(particles, csv)
    (tmp_path / "r1" / "parameters.json").write_text("{}")
    files.write_settings(settings, str(tmp_path / "r1" / "last_pipeline.json"), csv)
    saved = json.loads((tmp_path / "r1" / "last_pipeline.json").read_text())
    assert saved["ml"] == {"model_path": "m", "threshold": 0.31} and "beta_presets" not in saved["report"] and not (tmp_path / "r1" / "parameters.json").exists()
    path, merged = results.last_run(spark, str(tmp_path), {"pixel_size_nm": 1, "output_dir": "o"})
    assert path == csv and merged["pixel_size_nm"] == 3610 and merged["detection"]["min_size_nm"] == 20000.0
    os.makedirs(tmp_path / "r2")
    (tmp_path / "r2" / "last_pipeline.json").write_text("not json")
    os.utime(tmp_path / "r2" / "last_pipeline.json", (2e9, 2e9))
    assert results.last_run(spark, str(tmp_path), {"output_dir": str(tmp_path / "r1")}) == (csv, {"output_dir": str(tmp_path / "r1")})


def test_marker(tmp_path):
    csv = tmp_path / "p.csv"
    csv.write_text("a")
    assert not results.is_cleared(str(csv), str(tmp_path))
    results.clear_queue(str(csv), str(tmp_path))
    assert results.is_cleared(str(csv), str(tmp_path))
    csv.write_text("bb")
    assert not results.is_cleared(str(csv), str(tmp_path)) and not results.is_cleared(None, str(tmp_path))
    results.restore_queue(str(tmp_path))
    results.restore_queue(str(tmp_path))


def test_names():
    assert config.next_version("R3", ["R3 v1", "R3 v3", "R4 v9"]) == "R3 v4" and config.next_version("R3", []) == "R3 v1"
    assert config.advanced_version("R3", "R3 v7", ["R3 v1"]) == "R3 v8" and config.advanced_version("R3", "mine", []) == "mine"
    assert config.reserved("R3 v1", "R3", ["R3 v1"]) == "R3 v2" and config.reserved("x", "R3", []) == "x" and config.reserved("x", "", ["x", "x v2"]) == "x v3"
    assert config.summary_name('a/b "R3: 04"/') == "Summary of b R3 04.pdf" and config.summary_name("") == "Summary of run.pdf"


def test_presets():
    rows = [{"beta": 0.5, "model_path": "a", "threshold": 0.6}, {"beta": 1, "model_path": "b", "threshold": "0.31"}]
    settings = {"report": {"f_beta": 0.5, "beta_presets": rows}, "ml": {"enabled": True}}
    assert config.with_preset(settings)["ml"] == {"enabled": True, "model_path": "a", "threshold": 0.6}
    assert config.with_preset({"report": {"beta_presets": rows}})["ml"]["model_path"] == "b" and config.with_preset({"a": 1}) == {"a": 1}
    for bad in ([], [1], [{"beta": "x"}], [{"beta": 1}], [{"beta": 1, "model_path": "m", "threshold": "x"}], rows + [{"beta": 1.001, "model_path": "m", "threshold": 1}]):
        with pytest.raises(ValueError):
            config.presets({"report": {"beta_presets": bad}})
    with pytest.raises(ValueError, match="known: 0.50, 1.00"):
        config.preset_for(config.presets(settings), 3)
    base = {"a": {"x": 1, "y": 2}, "nsew_profile": {"a": {"y": 3}}}
    assert config.with_overlay(base)["a"] == {"x": 1, "y": 3} and config.with_overlay(base, {"a": {"x": 9}})["a"] == {"x": 9, "y": 2}


def test_pictures(spark):
    pdf = files.Pdf()
    pdf.page([("Title (a)", 18, True)], [("one", RGB)])
    data = pdf.data()
    assert data.startswith(b"%PDF") and data.rstrip().endswith(b"%%EOF") and b"/Count 1" in data
    start = int(data.split(b"startxref\n")[1].split(b"\n")[0])
    assert data[start : start + 4] == b"xref"
    for i, at in enumerate(re.findall(rb"(\d{10}) 00000 n", data), 1):
        assert data[int(at) :].startswith(b"%d 0 obj" % i)
    assert decode.size(files.jpeg(spark, RGB)) == (13, 17)


def test_whole_run(spark, tmp_path):
    """Four-sided cells combined, placed, searched, reported; a loose photo by itself."""
    top = tmp_path / "R3"
    spot = (np.clip(make.lattice((96, 96), particles=[(40.0, 42.0, 3.5)]) / 2.6, 0, 1) * 255).astype(np.uint8)
    for row, col in ((1, 1), (1, 2)):
        for side in "NSEW":
            files.write_bytes(files.png(spot), str(top / f"({row},{col})_{side}.png"))
    files.write_bytes(files.png(spot), str(top / "loose.png"))
    settings = make.settings() | {"input_dir": str(top), "filename_pattern": r"\((?P<row>\d+),(?P<col>\d+)\)\.png", "report": {"target_mb": 20.0}, "measurement": {"merge_radius_px": 6.0}}
    done = runs.run(spark, settings)
    found = done.particles.orderBy("id").collect()
    assert [r.id for r in found] == list(range(1, len(found) + 1))
    assert {r.source_tile for r in found} == {"(1,1).png", "(1,2).png", "loose.png"}
    placed = {os.path.basename(r.path): (r.y0, r.x0) for r in done.placements().collect()}
    assert placed == {"(1,1).png": (0, 0), "(1,2).png": (0, 72)}
    near = [r for r in found if r.source_tile == "(1,2).png" and abs(r.x_global - 114) < 3 and abs(r.y_global - 40) < 3]
    assert near
    out = runs.write(done, str(tmp_path / "out" / "R3 v1"))
    assert sorted(os.listdir(out)) == ["Summary of R3.pdf", "last_pipeline.json", "mosaic_overlay.png", "mosaic_plain.png", "particles.csv", "particles.xlsx"]
    plain, marked = (decode.read(open(os.path.join(out, f"mosaic_{n}.png"), "rb").read()) for n in ("plain", "overlay"))
    assert plain.shape == (96, 168, 3) and (plain != marked).any()
    assert runs.write(done, out).endswith("R3 v2")
    variants = runs.write_variants(done.photos.limit(0).unionByName(tiles.photos(spark, str(top)).select(*done.photos.columns)), str(tmp_path / "v"))
    assert len(variants) == 20 and np.array_equal(decode.read(open([v for v in variants if v.endswith("(1,1)/combi_4of4.png")][0], "rb").read()).shape, (96, 96))
    with pytest.raises(FileNotFoundError):
        runs.run(spark, settings | {"input_dir": str(tmp_path / "v" / "none")} if os.makedirs(tmp_path / "v" / "none") is None else settings)


def test_job():
    import threading

    go = threading.Event()

    def work(settings, progress, should_stop):
        progress(1, 2, "one")
        go.wait(5)
        if should_stop():
            raise InterruptedError
        if settings.get("bad"):
            raise ValueError("bad")
        return settings["x"]

    job = jobs.Job(work)
    job.start({"x": 5})
    with pytest.raises(RuntimeError):
        job.start({})
    go.set()
    job.wait(5)
    assert job.claim()["value"] == 5 and job.claim() is None
    job.start({"bad": True})
    job.wait(5)
    assert job.claim()["error"] == "bad"
    go.clear()
    job.start({"x": 1})
    job.stop()
    go.set()
    job.wait(5)
    assert job.claim()["stopped"]
    focus = jobs.FocusJob(lambda c, note, stop: note({"phase": "coarse"}))
    focus.start({})
    focus.wait(5)
    assert focus.claim_still() and not focus.claim_still() and len(focus.steps) == 1


def test_capture_stream(spark, tmp_path):
    """Stops follow as photos arrive; a second run over more files adds to the same log."""
    folder, state = str(tmp_path / "scan"), str(tmp_path / "state")
    put = lambda name, image: files.write_bytes(files.png(image), os.path.join(folder, name))
    put("(1,1)_N.png", GRAY)
    put("(1,1)_S.png", np.full((13, 17), 9, np.uint8))
    scan.capture_stream(spark, folder, state, {"mode": "NSEW"}).awaitTermination()
    put("(1,2).png", GRAY)
    put("notes.png", GRAY)
    scan.capture_stream(spark, folder, state, {"mode": "NSEW"}).awaitTermination()
    log = json.load(open(os.path.join(folder, "sharpness.json")))["stops"]
    manifest = json.load(open(os.path.join(folder, "manifest.json")))
    assert [(s["row"], s["col"], len(s["files"])) for s in log] == [(1, 1, 2), (1, 2, 1)] and manifest["mode"] == "NSEW"
    assert log[0]["sharpness"] == pytest.approx(log[1]["sharpness"] / 2) and manifest["stops"][0]["files"] == ["(1,1)_N.png", "(1,1)_S.png"]


def test_moves(spark):
    """The moves back undo what a scan has moved so far."""
    stops = capture.scan_stops(spark, 3, 2, 1.5).withColumn("back", capture.return_moves(F.col("row"), F.col("col"), 1.5)).orderBy("stop_index").collect()
    x = y = 0.0
    for s in stops:
        x, y = x + (s.delta_mm if s.axis == "X" else 0), y + (s.delta_mm if s.axis == "Y" else 0)
        back = {m.axis: m.delta_mm for m in s.back}
        assert (back.get("X", 0), back.get("Y", 0)) == (-x, -y)
    one = spark.range(1)
    assert [tuple(m) for m in one.select(capture.return_to_start(F.lit(3), F.lit(2), 1.5)).head()[0]] == [("Y", 1.5)]
    with pytest.raises(Exception, match="start at 1"):
        one.select(capture.return_moves(F.lit(0), F.lit(1), 1.0)).collect()
    assert one.select(capture.grab_timeout_ms(F.lit(4e6))).head()[0] == 6000
    line = lambda *v: one.select(capture.trace_line(*map(F.lit, v))).head()[0]
    assert line(1, 0.0, 250.4, "start", "start") == " 1. Start      +0.000 mm   250" and line(12, -0.05, 3.25, "coarse", "not sharper") == "12. Coarse     -0.050 mm   3.25   not sharper"
