"""Pixel kernels in numpy, for Arrow UDFs over decoded images.

Each takes a 2-D array of grey values 0..255.  ``on_images`` runs one over the
``image`` source's rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grey(pixels: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luma of the image source's bytes (blue, green, red, alpha)."""
    x = np.frombuffer(pixels, dtype=np.uint8).reshape(height, width, channels).astype(np.float64)
    return x[:, :, 0] if channels == 1 else np.floor(0.114 * x[:, :, 0] + 0.587 * x[:, :, 1] + 0.299 * x[:, :, 2] + 0.5)


def invert(x: np.ndarray) -> np.ndarray:
    return 255 - x


def otsu_threshold(x: np.ndarray) -> int:
    """The threshold with the greatest variance between classes, the first of equals."""
    n = np.bincount(x.astype(np.int64).ravel(), minlength=256).astype(np.float64)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.argmax(np.nan_to_num(between)))


def binarise(x: np.ndarray, inverted: bool = False) -> np.ndarray:
    bright = x > otsu_threshold(x)
    return np.where(bright != inverted, 255.0, 0.0)


def _windows(x: np.ndarray, k: int, mode: str = "edge") -> np.ndarray:
    r = k // 2
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, r, mode=mode), (k, k))


def gaussian_kernel(k: int, sigma: float = 0) -> np.ndarray:
    if k % 2 == 0:
        raise ValueError("the kernel's size must be odd")
    sigma = sigma or 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    w = np.exp(-((np.arange(k) - k // 2) ** 2) / (2 * sigma * sigma))
    return w / w.sum()


def gaussian_blur(x: np.ndarray, k: int = 5, sigma: float = 0) -> np.ndarray:
    w = gaussian_kernel(k, sigma)
    padded = np.pad(x, k // 2, mode="reflect")
    rows = np.apply_along_axis(np.convolve, 1, padded, w, "valid")
    return np.apply_along_axis(np.convolve, 0, rows, w, "valid")


def adaptive_threshold(x: np.ndarray, block: int = 11, c: float = 2) -> np.ndarray:
    """255 where a pixel is above the mean of its block less ``c``."""
    if block % 2 == 0:
        raise ValueError("the block's size must be odd")
    return np.where(x > _windows(x, block).mean(axis=(2, 3)) - c, 255.0, 0.0)


def dilate(x: np.ndarray, k: int = 3, times: int = 1) -> np.ndarray:
    for _ in range(times):
        x = _windows(x, k).max(axis=(2, 3))
    return x


def erode(x: np.ndarray, k: int = 3, times: int = 1) -> np.ndarray:
    for _ in range(times):
        x = _windows(x, k).min(axis=(2, 3))
    return x


def open_close(x: np.ndarray, operation: str, k: int = 3) -> np.ndarray:
    return {"open": lambda: dilate(erode(x, k), k), "close": lambda: erode(dilate(x, k), k)}[operation]()


def resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area averages."""
    def spread(n, m):
        edges = np.linspace(0, n, m + 1)
        low, high = np.maximum(edges[:-1, None], np.arange(n)), np.minimum(edges[1:, None], np.arange(n) + 1)
        w = np.maximum(high - low, 0)
        return w / w.sum(axis=1, keepdims=True)

    return spread(x.shape[0], height) @ x @ spread(x.shape[1], width).T


def fit_within(x: np.ndarray, most_height: int, most_width: int) -> np.ndarray:
    """Smaller by the longer side, shape kept."""
    share = min(most_height / x.shape[0], most_width / x.shape[1], 1.0)
    return resize(x, max(1, round(x.shape[0] * share)), max(1, round(x.shape[1] * share)))


def skew_angle(x: np.ndarray) -> float:
    """Half the angle of the second moments in degrees; 0 if undetermined or above 15."""
    y, z = np.nonzero(x > 0)
    if not len(y):
        return 0.0
    v = x[y, z]
    cy, cx = (y * v).sum() / v.sum(), (z * v).sum() / v.sum()
    m11, m20, m02 = ((z - cx) * (y - cy) * v).sum(), ((z - cx) ** 2 * v).sum(), ((y - cy) ** 2 * v).sum()
    angle = float(np.degrees(0.5 * np.arctan2(2 * m11, m20 - m02)))
    return 0.0 if abs(m02) < 1e-2 or abs(angle) > 15 else angle


def perceptual_hash(x: np.ndarray) -> int:
    """63 bits: an 8x8 corner of the cosine transform of the 32x32 image, without its first term, against the upper median."""
    small = resize(x, 32, 32)
    basis = np.cos(np.pi * (2 * np.arange(32)[None, :] + 1) * np.arange(8)[:, None] / 64)
    terms = (basis @ small @ basis.T).ravel()[1:]
    median = np.sort(terms)[len(terms) // 2]
    return int(sum(1 << i for i, t in enumerate(terms) if t > median))


def projections(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of set pixels of each row and each column."""
    return (x > 0).mean(axis=1), (x > 0).mean(axis=0)


def nonzero_share(x: np.ndarray) -> float:
    return float((x > 0).mean())


def two_valued_share(x: np.ndarray) -> float:
    return float(((x == 0) | (x == 255)).mean())


def laplacian_variance(x: np.ndarray) -> float:
    p = np.pad(x, 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * x).var())


def hu_moments(x: np.ndarray) -> np.ndarray:
    """The seven invariant moments."""
    total = x.sum()
    if not total:
        return np.zeros(7)
    yy, xx = np.indices(x.shape)
    cy, cx = (yy * x).sum() / total, (xx * x).sum() / total
    eta = lambda p, q: ((xx - cx) ** p * (yy - cy) ** q * x).sum() / total ** (1 + (p + q) / 2)
    n20, n02, n11, n30, n03, n21, n12 = eta(2, 0), eta(0, 2), eta(1, 1), eta(3, 0), eta(0, 3), eta(2, 1), eta(1, 2)
    a, b = n30 + n12, n21 + n03
    return np.array([
        n20 + n02, (n20 - n02) ** 2 + 4 * n11**2, (n30 - 3 * n12) ** 2 + (3 * n21 - n03) ** 2, a * a + b * b,
        (n30 - 3 * n12) * a * (a * a - 3 * b * b) + (3 * n21 - n03) * b * (3 * a * a - b * b),
        (n20 - n02) * (a * a - b * b) + 4 * n11 * a * b,
        (3 * n21 - n03) * a * (a * a - 3 * b * b) - (n30 - 3 * n12) * b * (3 * a * a - b * b),
    ])


def features(x: np.ndarray) -> tuple[float, float, list[float], list[float], float]:
    """(area, aspect ratio, log Hu moments, histogram, extent) of the set pixels."""
    y, z = np.nonzero(x > 0)
    area = float(len(y))
    height, width = (int(np.ptp(y)) + 1, int(np.ptp(z)) + 1) if area else (1, 1)
    hu = hu_moments(x)
    return area, width / height, (-np.sign(hu) * np.log10(np.abs(hu) + 1)).tolist(), np.bincount(x.astype(np.int64).ravel(), minlength=256).astype(float).tolist(), area / (height * width)


def gaussian_smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """A signal smoothed; edges repeat; below half a step it stays."""
    if sigma < 0.5:
        return x
    r = int(np.ceil(3 * sigma))
    w = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    return np.convolve(np.pad(x, r, mode="edge"), w / w.sum(), "valid")


def magnitudes(x: np.ndarray) -> np.ndarray:
    """Spectrum of the signal under a Hann window, filled to twice the next power of two."""
    n = 2 << max(0, int(np.ceil(np.log2(max(len(x), 1)))))
    return np.abs(np.fft.rfft(x * np.hanning(len(x)), n))


def period_by_autocorrelation(x: np.ndarray, low: int, high: int) -> tuple[float, float]:
    """(period, peak over root mean square); refined by a parabola."""
    x = x - x.mean()
    c = np.correlate(x, x, "full")[len(x) - 1 :]
    c = c / c[0] if c[0] else c
    high = min(high, len(c) - 2)
    if high <= low:
        return 0.0, 0.0
    k = low + int(np.argmax(c[low : high + 1]))
    den = c[k - 1] - 2 * c[k] + c[k + 1]
    shift = 0.5 * (c[k - 1] - c[k + 1]) / den if den else 0.0
    rms = float(np.sqrt((c[low : high + 1] ** 2).mean()))
    return k + float(shift), float(c[k]) / rms if rms else 0.0


def on_images(images: DataFrame, kernel: Callable[[np.ndarray], object], schema: str) -> DataFrame:
    """origin and ``kernel``'s value for each row of ``spark.read.format('image')``."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"origin": f["origin"], "value": [kernel(grey(d, h, w, c)) for d, h, w, c in zip(f["data"], f["height"], f["width"], f["nChannels"])]})

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, f"origin string, value {schema}")


def grid_positions(images: DataFrame, least: float = 0.5) -> DataFrame:
    """(puzzle_id, axis, pos, amplitude): row and column projections of dark lines, for the operators on signals."""
    def run(frames):
        for f in frames:
            for origin, d, h, w, c in zip(f["origin"], f["data"], f["height"], f["width"], f["nChannels"]):
                for axis, p in zip(("row", "col"), projections(binarise(grey(d, h, w, c), inverted=True))):
                    at = np.flatnonzero(p >= least)
                    yield pd.DataFrame({"puzzle_id": origin, "axis": axis, "pos": at, "amplitude": p[at]})

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, "puzzle_id string, axis string, pos long, amplitude double").withColumn("key", F.concat_ws("#", "puzzle_id", "axis"))
