"""Synthetic photos and settings for the image tests."""

import numpy as np


def blob(shape, y, x, sigma, height=1.0):
    yy, xx = np.indices(shape)
    return height * np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / (2 * sigma**2))


def lattice(shape=(128, 128), period=16, sigma=1.1, particles=()):
    """A grid of small dots with particles between them."""
    centre = np.arange(period // 2, max(shape), period)
    rows, cols = (np.exp(-((np.arange(n)[:, None] - centre) ** 2) / (2 * sigma**2)).sum(1) for n in shape)
    return rows[:, None] * cols + 0.02 + sum((blob(shape, y, x, s, 2.4) for y, x, s in particles), np.zeros(shape))


def step(shape=(128, 192), at=96, bright=0.9, dark=0.2):
    image = np.full(shape, dark)
    image[:, at:] = bright
    return image


def pad(shape=(256, 320), box=(40, 40, 180, 200), bright=0.9, dark=0.15):
    image = np.full(shape, dark)
    image[box[0] : box[2], box[1] : box[3]] = bright
    return image


def flake(image, y, x, ry, rx, height):
    yy, xx = np.indices(image.shape)
    return image + height * np.clip(1 - ((yy - y) / ry) ** 2 - ((xx - x) / rx) ** 2, 0, 1) ** 2


def settings(preprocessing=None, **detection):
    """A configuration with few filters on, in pixels."""
    return {
        "pixel_size_nm": 1.0,
        "overlap_fraction": 0.25,
        "preprocessing": {"denoise": False, "flatten_illumination": False, "contrast_percentiles": [0.5, 99.5], **(preprocessing or {})},
        "detection": {
            "method": "tophat", "fft_peak_threshold": 0.3, "fft_notch_radius": 2, "tophat_radius": 7, "min_size_nm": 6.0, "max_size_nm": 40.0, "blob_min_sigma": 1.5, "blob_max_sigma": 6.0, "blob_threshold": 0.05, "min_area_px": 8, "local_snr_sigma": 0.0,
            "edge_soften_sigma": 0.0, "edge_soften_strength": 0.0, "edge_exclude_px": 0.0, "min_circularity": 0.35, "structure_neighbor_px": 0.0, "structure_line_bin_px": 0.0, "min_prominence": 0.15, **detection,
        },
    }


DEBRIS = dict(tophat_radius=50, blob_min_sigma=5.5, blob_max_sigma=36.0, min_size_nm=15.0, max_size_nm=100.0, blob_threshold=0.08, min_prominence=0.30, edge_soften_sigma=12.0, edge_soften_strength=2.0, edge_exclude_px=48.0, min_circularity=0.30, structure_neighbor_px=48.0)
SMALL_DEBRIS = DEBRIS | dict(tophat_radius=17, blob_max_sigma=12.0, max_size_nm=32.0)
ISLANDS = DEBRIS | dict(min_circularity=0.0, structure_neighbor_px=0.0, island_min_nm=20.0, island_large_nm=40.0)
