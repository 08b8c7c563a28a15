"""Chains of pixel kernels, in numpy, for ``kernels.on_images``: contrast, rotation, preprocessing, symbols of cells, periods of projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import kernels as k


def crop(x: np.ndarray, top: int, left: int, height: int, width: int) -> np.ndarray:
    """The part of a box that lies in the image."""
    return x[max(top, 0) : max(top + height, 0), max(left, 0) : max(left + width, 0)]


def columns(x: np.ndarray, edges: list[int]) -> list[np.ndarray]:
    """Slices between neighbouring edges."""
    return [x[:, a:b] for a, b in zip(edges, edges[1:])]


def equalise(x: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation: a clipped histogram per tile, its maps blended between tile centres."""
    h, w = x.shape
    grey = np.clip(x, 0, 255).astype(np.int64)
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(grey, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric" if min(h, w) >= tiles else "edge")
    blocks = padded.reshape(tiles, th, tiles, tw).swapaxes(1, 2).reshape(tiles * tiles, th * tw)
    counts = np.stack([np.bincount(b, minlength=256) for b in blocks]).astype(np.float64)
    limit = max(1.0, np.floor(clip * th * tw / 256))
    over = np.maximum(counts - limit, 0).sum(axis=1, keepdims=True)
    maps = (np.cumsum(np.minimum(counts, limit) + over / 256, axis=1) * 255 / (th * tw)).reshape(tiles, tiles, 256)

    def between(n: int, step: int):
        at = (np.arange(n) + 0.5) / step - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    (r0, r1, fr), (c0, c1, fc) = between(h, th), between(w, tw)
    value = lambda r, c: maps[r[:, None], c[None, :], grey]
    top = value(r0, c0) * (1 - fc) + value(r0, c1) * fc
    bottom = value(r1, c0) * (1 - fc) + value(r1, c1) * fc
    return np.clip(np.rint(top * (1 - fr[:, None]) + bottom * fr[:, None]), 0, 255)


def rotate(x: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned counter-clockwise about its centre, same size; bilinear, edges repeated."""
    h, w = x.shape
    a = np.radians(degrees)
    cy, cx = h / 2, w / 2
    yy, xx = np.indices(x.shape, dtype=np.float64)
    sx = np.clip((xx - cx) * np.cos(a) - (yy - cy) * np.sin(a) + cx, 0, w - 1)
    sy = np.clip((xx - cx) * np.sin(a) + (yy - cy) * np.cos(a) + cy, 0, h - 1)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    x1, y1, fx, fy = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1), sx - x0, sy - y0
    return (x[y0, x0] * (1 - fx) + x[y0, x1] * fx) * (1 - fy) + (x[y1, x0] * (1 - fx) + x[y1, x1] * fx) * fy


def deskew(x: np.ndarray) -> np.ndarray:
    angle = k.skew_angle(x)
    return rotate(x, angle) if angle else x


def gaussian_threshold(x: np.ndarray, block: int = 11, c: float = 2) -> np.ndarray:
    """255 where a pixel is above the Gaussian mean of its block less ``c``."""
    return np.where(x > k.gaussian_blur(np.pad(x, block, mode="edge"), block)[block:-block, block:-block] - c, 255.0, 0.0)


def denoise(x: np.ndarray, strength: float = 10, patch: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means: each pixel is the mean of those around it, weighted by how alike their patches are."""
    r, p = search // 2, patch // 2
    padded = np.pad(x, r + p, mode="reflect") if min(x.shape) > r + p else np.pad(x, r + p, mode="edge")
    h, w = x.shape
    base = padded[r : r + h + 2 * p, r : r + w + 2 * p]
    total, weight = np.zeros_like(x, dtype=np.float64), np.zeros_like(x, dtype=np.float64)
    for dy in range(search):
        for dx in range(search):
            other = padded[dy : dy + h + 2 * p, dx : dx + w + 2 * p]
            sums = np.pad(np.cumsum(np.cumsum((other - base) ** 2, axis=0), axis=1), ((1, 0), (1, 0)))
            distance = (sums[patch:, patch:] - sums[:-patch, patch:] - sums[patch:, :-patch] + sums[:-patch, :-patch]) / (patch * patch)
            like = np.exp(-np.maximum(distance, 0) / (strength * strength))
            total += like * other[p : p + h, p : p + w]
            weight += like
    return total / weight


def preprocess(x: np.ndarray) -> np.ndarray:
    """The seven steps for whole pages: grey (as given), deskew, contrast, blur, threshold, close, open."""
    x = gaussian_threshold(k.gaussian_blur(equalise(deskew(x)), 3))
    return k.open_close(k.open_close(x, "close"), "open")


def dark_background(binary: np.ndarray) -> np.ndarray:
    """Inverted if the image's edges are mostly bright."""
    edge = np.concatenate([binary[0], binary[-1], binary[:, 0], binary[:, -1]])
    return 255 - binary if edge.mean() > 128 else binary


def finish(x: np.ndarray, height: int = 128) -> np.ndarray:
    """Scaled to a height, at least 64 wide, with a dark border of 30 %."""
    width = max(int(height * x.shape[1] / x.shape[0]), 64)
    return np.pad(k.resize(x, height, width), ((int(height * 0.3),) * 2, (int(width * 0.3),) * 2))


#: The ways in which a reader's image is prepared, in the order in which they are tried.
STRATEGIES = {
    "binary_otsu": lambda x: finish(dark_background(k.binarise(x))),
    "clahe_grayscale": lambda x: finish(equalise(x, 3.0)),
    "adaptive_denoise": lambda x: finish(dark_background(gaussian_threshold(denoise(x)))),
}


def symbol_box(binary: np.ndarray) -> tuple[int, int, int, int] | None:
    """(top, left, height, width) of the largest connected part (8 neighbours) of the set pixels; None without one."""
    label = np.where(binary > 0, np.arange(1, binary.size + 1).reshape(binary.shape), 0)
    while True:  # the largest number of a part spreads over it
        spread = np.where(label > 0, k.dilate(label), 0)
        if (spread == label).all():
            break
        label = spread
    numbers, counts = np.unique(label[label > 0], return_counts=True)
    if not len(numbers):
        return None
    y, z = np.nonzero(label == numbers[np.argmax(counts)])
    return int(y.min()), int(z.min()), int(np.ptp(y)) + 1, int(np.ptp(z)) + 1


def crop_symbol(x: np.ndarray, box: tuple[int, int, int, int], margin: int = 5) -> np.ndarray:
    """The box with a margin, as far as the image goes."""
    top, left, height, width = box
    return crop(x, top - margin, left - margin, height + 2 * margin, width + 2 * margin)


def normalise_symbol(x: np.ndarray, size: int = 64) -> np.ndarray:
    """Scaled to fit a square, shape kept, centred on black."""
    ratio = x.shape[1] / x.shape[0]
    height, width = (max(1, int(size / ratio + 0.5)), size) if ratio > 1 else (size, max(1, int(size * ratio + 0.5)))
    out = np.zeros((size, size))
    top, left = (size - height) // 2, (size - width) // 2
    out[top : top + height, left : left + width] = k.resize(x, height, width)
    return out


def symbol_of(cell: np.ndarray, empty: float = 0.02) -> tuple[int, tuple] | None:
    """(hash, features) of a cell's symbol; None if the cell is empty."""
    ink = k.binarise(cell, inverted=True)
    box = symbol_box(ink) if k.nonzero_share(ink) >= empty else None
    if box is None:
        return None
    symbol = normalise_symbol(crop_symbol(ink, box))
    return k.perceptual_hash(symbol), k.features(symbol)


def cell_symbols(images: DataFrame, rows: int, cols: int, first_col: int = 1) -> DataFrame:
    """(origin, row, col, hash, area, aspect_ratio): the symbols of an even grid's cells, a row each; empty cells and the first columns are left out."""

    def run(frames):
        for f in frames:
            for origin, d, h, w, c in zip(f["origin"], f["data"], f["height"], f["width"], f["nChannels"]):
                x, out = k.grey(d, h, w, c), []
                for row in range(rows):
                    for col in range(first_col, cols):
                        found = symbol_of(x[row * h // rows : (row + 1) * h // rows, col * w // cols : (col + 1) * w // cols])
                        if found:
                            out.append((origin, row, col, found[0], found[1][0], found[1][1]))
                yield pd.DataFrame(out, columns=["origin", "row", "col", "hash", "area", "aspect_ratio"])

    parts = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return parts.mapInPandas(run, "origin string, row int, col int, hash long, area double, aspect_ratio double")


def local_peaks(signal: np.ndarray, apart: float) -> list[int]:
    """Positive inner maxima, the highest first (the first of equals), each at least ``apart`` (rounded, 1 or more) from those taken."""
    inner = signal[1:-1]
    at = np.flatnonzero((inner >= signal[:-2]) & (inner >= signal[2:]) & (inner > 0)) + 1
    taken: list[int] = []
    for p in at[np.argsort(-signal[at], kind="stable")].tolist():
        if all(abs(p - q) >= max(1, int(apart + 0.5)) for q in taken):
            taken.append(p)
    return sorted(taken)


def fill_by_median_gap(positions: list[int], most: int = 4, gate: float = 2.0) -> list[int]:
    """The positions, and 1 to ``most`` evenly spaced ones in gaps of more than ``gate`` median gaps (the upper median)."""
    if len(positions) < 2:
        return positions
    step = sorted(np.diff(positions).tolist())[(len(positions) - 1) // 2]
    out = positions[:1]
    for a, b in zip(positions, positions[1:]):
        missing = int((b - a) / step + 0.5) - 1 if step > 0 and (b - a) / step > gate else 0
        out += [int(a + step * m + 0.5) for m in range(1, missing + 1)] if 0 < missing <= most else []
        out.append(b)
    return out


def borders_by_period(projection: np.ndarray, period: float) -> list[int]:
    """Peaks of the smoothed projection above half its maximum (three tenths if those are fewer than two), gaps filled; none if there are fewer than two."""
    smooth = k.gaussian_smooth(projection, max(1.0, period * 0.05))
    peaks = local_peaks(smooth, period * 0.6)
    for share in (0.5, 0.3):
        high = [p for p in peaks if smooth[p] >= share * smooth.max()]
        if len(high) >= 2:
            return fill_by_median_gap(high)
    return []


def positions_by_peaks(projection: np.ndarray, least_period: float) -> list[int]:
    """Peaks above a fifth of the maximum, with the image's ends where they are far from a peak; none if there are fewer than two."""
    smooth = k.gaussian_smooth(projection, least_period * 0.4)
    peaks = [p for p in local_peaks(smooth, least_period * 0.5) if smooth[p] >= 0.2 * smooth.max()]
    if len(peaks) < 2:
        return []
    far = least_period * 0.5
    return [0] * (peaks[0] > far) + peaks + [len(projection)] * (len(projection) - peaks[-1] > far)


def dominant_period(projection: np.ndarray, low: int, high: int, least_snr: float = 3.0, harmonic: float = 0.30) -> tuple[float, float]:
    """(period, signal over noise): by autocorrelation if clear enough, else the spectrum's peak, led down to the lowest strong harmonic."""
    period, snr = k.period_by_autocorrelation(projection, low, high)
    if snr >= least_snr:
        return period, snr
    spectrum = k.magnitudes(projection)[:-1]
    n = 2 * len(spectrum)
    first, last = max(1, -(-n // high)), min(n // low, len(spectrum) - 1)
    if first >= last:
        raise ValueError(f"no frequencies between the periods {low} and {high}")
    at = first + int(np.argmax(spectrum[first : last + 1]))

    def lower(at: int) -> int | None:
        for part in range(2, 6):
            if at / part >= first:
                middle = int(at / part + 0.5)
                strong = [f for f in (middle - 1, middle, middle + 1) if first <= f and spectrum[f] >= harmonic * spectrum[at]]
                if strong and strong[0] < at:
                    return strong[0]
        return None

    while (down := lower(at)) is not None:
        at = down
    band = spectrum[max(first, int(at * 0.7 + 0.5)) : min(last, int(at * 1.3 + 0.5)) + 1]
    snr = float(spectrum[at] / band.mean()) if band.mean() > 0 else 0.0
    shift = 0.0
    if first < at < last:
        a, b, c = spectrum[at - 1 : at + 2]
        shift = (a - c) / (2 * (a - 2 * b + c)) if abs(a - 2 * b + c) > 1e-10 else 0.0
    return n / (at + shift), snr
