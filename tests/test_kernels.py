"""Kernels against plain versions and on synthetic photos; detection end to end through Spark."""

import numpy as np
import photos as make
import pytest
from grainsight.kernels import blobs, filters, residual, shapes
from grainsight.operators import detect
from grainsight.sources.tiles import PHOTO_SCHEMA, photo_row

RNG = np.random.default_rng(3)


def table(spark, **images):
    rows = [(p, h, w, d, bytearray(raw)) for p, h, w, d, raw in (photo_row(k, v) for k, v in images.items())]
    return spark.createDataFrame(rows, PHOTO_SCHEMA)


def places(spark, image, config, **more):
    rows = detect.detect(table(spark, photo=np.asarray(image)), config, **more).collect()
    return [(r.y, r.x, r.size) for r in rows]


def near(found, y, x):
    return min((np.hypot(a - y, b - x) for a, b, _ in found), default=np.inf)


def test_gaussian():
    """Against a direct sum; long kernels against short ones' definition."""
    image = RNG.random((40, 50)).astype(np.float32)
    for sigma in (0.8, 2.0, 7.0):
        half = int(round(sigma * 8 + 1)) // 2
        w = np.exp(-np.arange(-half, half + 1) ** 2 / (2 * sigma**2))
        w /= w.sum()
        wide = np.pad(image.astype(float), half, mode="reflect")
        rows = sum(w[k] * wide[k : k + 40] for k in range(2 * half + 1))
        want = sum(w[k] * rows[:, k : k + 50] for k in range(2 * half + 1))
        assert np.allclose(filters.gaussian(image, sigma), want, atol=1e-5)
    assert np.allclose(filters.gaussian(np.full((5, 7), 3.0), 9.0), 3.0, atol=1e-4)


def test_resize():
    image = RNG.random((12, 18))
    assert np.allclose(filters.area_resize(image, 4, 6), image.reshape(4, 3, 6, 3).mean((1, 3)), atol=1e-6)
    assert np.isclose(filters.area_resize(image, 5, 7).mean(), image.mean(), atol=1e-6)
    assert np.allclose(filters.linear_resize(np.full((3, 4), 2.0), 9, 11), 2.0)
    assert filters.shrunk(RNG.random((65, 33)), 8).shape == (8, 4)


@pytest.mark.parametrize("radius", [1, 2, 5])
def test_morphology(radius):
    image = RNG.random((17, 23)).astype(np.float32)
    half = filters.disc(radius)
    spots = [(dy, dx) for dy, w in zip(range(-radius, radius + 1), half, strict=True) for dx in range(-w, w + 1)]
    wide = np.pad(image, radius, constant_values=-np.inf)
    want = np.max([wide[radius + dy : radius + dy + 17, radius + dx : radius + dx + 23] for dy, dx in spots], 0)
    assert np.array_equal(filters.dilated(image, radius), want)
    assert np.array_equal(filters.eroded(image, radius), -filters.dilated(-image, radius))
    mask = image > 0.7
    assert np.array_equal(filters.dilated(mask, radius), filters.dilated(mask.astype(np.float32), radius) > 0)
    assert (filters.top_hat(image, radius) >= 0).all()


def test_statistics():
    flat = RNG.random(1000)
    assert filters.percentiles(flat, 1, 99.5) == pytest.approx(list(np.percentile(flat.astype(np.float32), (1, 99.5))))
    large = RNG.random((300, 300))
    assert filters.percentiles(large, 50)[0] == pytest.approx(0.5, abs=0.01)
    assert filters.noise(RNG.normal(5, 2, 100_000)) == pytest.approx(2, rel=0.02)
    assert filters.noise(np.full(5, 3.0)) == 1e-6
    assert filters.to_float(np.full((2, 2), 40, np.uint8)).max() == pytest.approx(40 / 255)
    assert [float(filters.to_float(np.array([v])).max()) for v in (1.5, 255.0, 65535.0, 70000.0)] == pytest.approx([1.5, 1, 1, 1])


def test_sharpness():
    sharp = RNG.integers(0, 255, (80, 80)).astype(float)
    assert filters.sharpness(sharp) > 10 * filters.sharpness(filters.gaussian(sharp, 3.5))
    assert filters.sharpness(np.zeros((2, 9))) == 0.0 and filters.sharpness(np.full((40, 40, 3), 7)) == 0.0
    with pytest.raises(ValueError):
        filters.sharpness(np.zeros((4, 4, 2)))


def flood(mask):
    label, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if label[y, x]:
            continue
        n, todo = n + 1, [(y, x)]
        while todo:
            i, j = todo.pop()
            if 0 <= i < mask.shape[0] and 0 <= j < mask.shape[1] and mask[i, j] and not label[i, j]:
                label[i, j] = n
                todo += [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return label, n


@pytest.mark.parametrize("share", [0.1, 0.35, 0.5, 0.9])
def test_shapes(share):
    mask = RNG.random((40, 37)) < share
    label, n = flood(mask)
    got = shapes.shapes(mask)
    assert len(got.area) == n and (got.label > 0).sum() == mask.sum()
    for k in range(1, n + 1):
        y, x = np.nonzero(label == k)
        of = got.label[y[0], x[0]]
        assert (got.label[y, x] == of).all() and got.area[of - 1] == len(y)
        assert (got.height[of - 1], got.width[of - 1]) == (np.ptp(y) + 1, np.ptp(x) + 1)
        assert (got.y[of - 1], got.x[of - 1]) == pytest.approx((y.mean(), x.mean()))


def test_distance():
    """Straight, diagonal and knight's steps, by relaxation of every pixel."""
    mask = RNG.random((25, 31)) < 0.01
    mask[3, 4] = True
    want = np.where(mask, 0.0, np.inf)
    moves = [(dy, dx, (shapes.STRAIGHT, shapes.DIAGONAL, shapes.KNIGHT)[abs(dy) + abs(dx) - 1]) for dy in (-2, -1, 0, 1, 2) for dx in (-2, -1, 0, 1, 2) if (dy, dx) != (0, 0) and abs(dy) + abs(dx) <= 3 and abs(dy) + abs(dx) - (max(abs(dy), abs(dx)) == 2 and min(abs(dy), abs(dx)) == 0) * 9 > 0]
    for _ in range(60):
        for dy, dx, cost in moves:
            at = np.full(want.shape, np.inf)
            src = want[max(dy, 0) : 25 + min(dy, 0), max(dx, 0) : 31 + min(dx, 0)]
            at[max(-dy, 0) : 25 + min(-dy, 0), max(-dx, 0) : 31 + min(-dx, 0)] = src + cost
            want = np.minimum(want, at)
    assert np.allclose(shapes.distance_to(mask), want, atol=1e-3)
    assert np.isinf(shapes.distance_to(np.zeros((4, 4), bool))).all()


def test_ridge():
    thick = np.zeros((30, 60), bool)
    thick[10:19, 5:55] = True
    line = shapes.ridge(thick)
    assert line.sum() < 70 and line[:, 15:45].sum(0).max() == 1 and not (line & ~thick).any()
    assert not shapes.ridge(np.zeros((5, 5), bool)).any()


def test_pruned():
    """Against the rule on all pairs, in order."""
    found = np.column_stack([RNG.uniform(0, 60, (80, 2)), RNG.uniform(1, 5, 80)])
    live = [True] * 80
    for i in range(80):
        for j in range(i + 1, 80):
            d, ra, rb = np.hypot(*(found[i, :2] - found[j, :2])), found[i, 2] * 2**0.5, found[j, 2] * 2**0.5
            share = 1.0 if d <= abs(ra - rb) else (ra + rb - d) / (2 * min(ra, rb))
            if d < ra + rb and share > 0.5 and live[i] and live[j]:
                live[j if found[i, 2] > found[j, 2] else i] = False
    assert np.array_equal(blobs.pruned(found), found[live])


def test_measures():
    yy, xx = np.indices((81, 81))
    disc = ((yy - 40) ** 2 + (xx - 40) ** 2 <= 100).astype(np.float32)
    want = 2 * np.sqrt(disc.sum() / np.pi)
    for image in (disc, 0.4 + 0.6 * disc):
        assert blobs.footprint(blobs.Window(image, 40, 40, 30), 10.0) == pytest.approx(want, abs=0.05)
    assert blobs.footprint(blobs.Window(1 - disc, 40, 40, 30), 10.0, bright=False) == pytest.approx(want, abs=0.05)
    assert blobs.footprint(blobs.Window(np.zeros((9, 9)), 4, 4, 4), 2.0) == 0
    round_ = make.blob((81, 81), 40, 40, 4)
    assert blobs.circularity(blobs.Window(round_, 40, 40, 24)) > 0.95
    long = np.exp(-((yy - 40) ** 2) / 8 - (xx - 40) ** 2 / 200)
    assert blobs.circularity(blobs.Window(long, 40, 40, 24)) < 0.3
    inner, mid, outer = blobs.radial_means(blobs.Window(round_, 40, 40, 24), 8.0)
    assert inner > mid > outer
    w = blobs.Window(round_, 40, 40, 24)
    assert blobs.support(w) == (w.values >= 0.4).sum()


def test_maxima():
    peaks = blobs.maxima(make.blob((64, 64), 20, 30, 3), 1.5, 6.0)
    best = blobs.pruned(peaks)
    assert len(best) == 1 and tuple(best[0, :2]) == (20, 30)
    assert len(blobs.maxima(np.zeros((8, 8)), 1, 4)) == 0


def test_notches():
    image = make.lattice(particles=[(64, 48, 4.0)]).astype(np.float32)
    mask = residual.notch_mask(image, 0.3, 2)
    assert mask.any() and np.allclose(residual.suppressed(image, 0.3, 2, mask), residual.suppressed(image, 0.3, 2), atol=1e-5)
    assert residual.is_patterned(np.zeros((64, 64), np.float32), 0.3, 2)
    noise = RNG.random((400, 400)).astype(np.float32)
    assert not residual.is_patterned(noise, 0.9, 2) and residual.is_patterned(make.lattice((400, 400)).astype(np.float32), 0.3, 2)
    alone, by_top_hat = residual.foreground((0.2 + make.blob((64, 64), 32, 32, 2.5, 0.8)).astype(np.float32), residual.Settings.of(make.settings(method="fft")))
    assert by_top_hat and alone.max() > 0.5


def test_edges():
    distance = residual.edge_distance((make.step() + make.blob((128, 192), 64, 48, 4, 0.75)).astype(np.float32), 6.0, 40.0)
    assert distance[64, 96] < 4 and distance[64, 48] > 20 and distance[64, 80] > 8


def test_corrections():
    ramp = np.arange(256, dtype=np.uint8).reshape(16, 16)
    out = residual.corrected(ramp, residual.Settings(denoise_sigma=0.8, flatten_sigma=8.0))
    assert out.dtype == np.float32 and out.shape == ramp.shape and out.min() >= -1e-5 and out.max() <= 1 + 1e-5


def test_finds_blobs(spark):
    at = [(40.0, 36.0, 3.8), (90.0, 88.0, 4.2)]
    rows = detect.detect(table(spark, a=make.lattice(particles=at)), make.settings()).collect()
    found = [(r.y, r.x, r.size) for r in rows]
    assert all(near(found, y, x) < 3 for y, x, _ in at)
    assert all(6 <= r.size <= 40 and r.confidence > 0 and 0 <= r.circularity <= 1 and r.n_neighbors_48 >= 0 for r in rows)
    by_fft = places(spark, make.lattice(particles=[(64.0, 48.0, 4.0)]), make.settings(method="fft", blob_threshold=0.08))
    assert near(by_fft, 64, 48) < 4


def test_sizes_come_from_the_photo(spark):
    image = (1 + make.blob((160, 160), 80, 80, 10, 30) + make.blob((160, 160), 80, 80, 2.2, 200)).astype(np.float32)
    wide = dict(min_size_nm=10.0, max_size_nm=80.0, blob_min_sigma=1.2, blob_max_sigma=8.0, min_circularity=0.0, min_prominence=0.1, blob_threshold=0.04)
    assert near(places(spark, image, make.settings(**wide)), 80, 80) > 4
    kept = [f for f in places(spark, image, make.settings(**wide | dict(min_size_nm=4.0))) if near([f], 80, 80) < 4]
    assert kept and kept[0][2] < 12


def test_step_is_no_particle(spark):
    image = make.step() + make.blob((128, 192), 64, 48, 4, 0.75)
    found = places(spark, image, make.settings(blob_threshold=0.03, local_snr_sigma=20.0, edge_soften_sigma=6.0, edge_soften_strength=2.0, edge_exclude_px=20.0))
    assert near(found, 64, 48) < 4 and all(abs(x - 96) > 20 for _, x, _ in found)


def test_pads_and_flakes(spark):
    corners = [(40, 40), (40, 199), (179, 40), (179, 199)]
    for config in (make.SMALL_DEBRIS, make.DEBRIS, make.ISLANDS | dict(structure_neighbor_px=48.0, min_circularity=0.30)):
        found = places(spark, make.pad(), make.settings(**config))
        assert all(near(found, *c) > 24 for c in corners)
    inside = places(spark, make.pad() + make.blob((256, 320), 110, 120, 6, 0.75), make.settings(**make.SMALL_DEBRIS | dict(min_prominence=0.2, min_circularity=0.35, structure_neighbor_px=0.0)))
    assert near(inside, 110, 120) < 6
    large = places(spark, make.flake(np.full((280, 320), 0.12), 140, 160, 36, 32, 0.83), make.settings(**make.DEBRIS | dict(structure_neighbor_px=0.0)))
    assert near(large, 140, 160) < 12 and any(s >= 20 for _, _, s in large)
    for ry, rx in ((28, 26), (18, 16)):
        image = residual.corrected(make.flake(make.step((220, 280), 140, 0.9, 0.15), 110, 140, ry, rx, 0.8), residual.Settings.of(make.settings()))
        found = places(spark, image, make.settings({"contrast_stretch": False}, **make.ISLANDS))
        assert near(found, 110, 140) < 16


def test_trace(spark):
    image = make.lattice(particles=[(40.0, 42.0, 3.0)])
    hit = min(places(spark, image, make.settings()), key=lambda f: np.hypot(f[0] - 40, f[1] - 42))
    points = spark.createDataFrame([("a", 1, hit[0], hit[1]), ("a", 2, 5.0, 5.0), ("b", 1, 5.0, 5.0)], "path string, point long, y double, x double")
    rows = {(r.path, r.point): r for r in detect.trace(table(spark, a=image, b=np.zeros((32, 32))), points, make.settings()).collect()}
    assert rows["a", 1].reason == "already_kept" and rows["a", 1].nearest_kept_px == 0
    assert rows["a", 2].reason != "already_kept" and np.isnan(rows["a", 2].edge_distance_px)
    assert rows["b", 1].reason == "no_dog_peak_low_residual" and np.isinf(rows["b", 1].nearest_blob_px)


def test_empty(spark):
    none = table(spark, a=np.zeros((8, 8))).where("false")
    assert detect.detect(none, make.settings()).count() == 0
    assert places(spark, np.zeros((16, 16)), make.settings()) == []


def edges(low, high):
    """Photos of 64 bytes and their exact totals from (low, high) percentiles, a twentieth off the next tenth: what 32 bits can't tell."""
    from fractions import Fraction

    def at(s, share):
        k = 63 * share
        return s[int(k)] + (s[min(int(k) + 1, 63)] - s[int(k)]) * (k - int(k))

    rng = np.random.default_rng(7)
    for _ in range(20_000):
        photo = rng.integers(40, 200, 64)
        s = sorted(map(int, photo))
        a, b = at(s, low), at(s, high)
        total = sum((min(max((int(p) - a) / Fraction(b - a), 0), 1) for p in photo), Fraction(0))
        if total * 20 % 2 == 1:
            yield photo.astype(np.uint8).reshape(8, 8), total


def test_stretched_on_edges():
    from fractions import Fraction

    from grainsight.plans.photo_queries import added

    found = list(edges(Fraction(1, 100), Fraction(99, 100)))
    assert found and all(abs(added(filters.stretched(x, 1, 99, np.float64)) - float(total)) < 1e-12 for x, total in found)


def test_unit_on_edges():
    from fractions import Fraction

    from grainsight.plans.photo_queries import added

    found = list(edges(Fraction(0), Fraction(199, 200)))
    assert found and all(abs(added(filters.unit(x, np.float64)) - float(total)) < 1e-12 for x, total in found)
