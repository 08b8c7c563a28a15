"""Connected parts and edges of stacks of images, in numpy: the images of an Arrow batch at once."""

from __future__ import annotations

import numpy as np


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(image, row, first, end) of the runs of set pixels of images x rows x columns, in reading order."""
    edge = np.diff(np.pad(x.astype(np.int8), ((0, 0), (0, 0), (1, 1))), axis=2)
    image, row, first = np.nonzero(edge == 1)
    return image, row, first, np.nonzero(edge == -1)[2]


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items the smallest that it is linked with, by the links a - b: hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return root
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            jump = root[root]
            if (jump == root).all():
                break
            root = jump


def part_of_runs(x: np.ndarray, found: tuple[np.ndarray, ...]) -> np.ndarray:
    """The first run of each run's part; runs of rows above one another that touch, by a corner too, are of one part."""
    image, row, first, end = found
    line, wide = image * (x.shape[1] + 1) + row, x.shape[2] + 2
    low = np.searchsorted(line * wide + end, (line + 1) * wide + first, side="left")
    high = np.searchsorted(line * wide + first, (line + 1) * wide + end, side="right")
    n = np.maximum(high - low, 0)
    above = np.repeat(np.arange(len(line)), n)
    below = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    return joined(len(line), above, below)


def exposed(x: np.ndarray) -> np.ndarray:
    """How many of each set pixel's four sides face a pixel that is not set, or the outside."""
    p = np.pad(x, ((0, 0), (1, 1), (1, 1)))
    sides = 4 - (p[:, :-2, 1:-1].astype(np.int64) + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:])
    return np.where(x, sides, 0)


def largest_parts(x: np.ndarray) -> list[tuple | None]:
    """Of each image: (number of parts, area, top, left, bottom, right, perimeter, outline) of its largest part, the first of equals in reading order; None of an image without one.

    The perimeter counts pixel sides, those of holes too; the outline is the numbers (row x columns + column) of the pixels with such a side.
    """
    found = runs(x)
    image, row, first, end = found
    root = part_of_runs(x, found)
    sides = exposed(x)
    upto = np.concatenate([np.zeros(x.shape[:2] + (1,), dtype=np.int64), np.cumsum(sides, axis=2)], axis=2)
    area = np.bincount(root, weights=end - first, minlength=len(root)).astype(np.int64)
    around = np.bincount(root, weights=upto[image, row, end] - upto[image, row, first], minlength=len(root)).astype(np.int64)
    out: list[tuple | None] = [None] * len(x)
    begin = np.searchsorted(image, np.arange(len(x) + 1))
    for i in np.unique(image).tolist():
        mine = np.arange(begin[i], begin[i + 1])
        parts = np.unique(root[mine])
        best = parts[np.argmax(area[parts])]
        own = mine[root[mine] == best]
        rows, a, b = row[own], first[own], end[own]
        outline = [int(r * x.shape[2] + c) for r, s, e in zip(rows, a, b) for c in range(s, e) if sides[i, r, c]]
        out[i] = (len(parts), int(area[best]), int(rows.min()), int(a.min()), int(rows.max()), int(b.max()) - 1, int(around[best]), outline)
    return out


def edges(x: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """The edges of images (0 to 255): Sobel gradients, the greatest across their direction, those below ``high`` only where they hang together with one above.

    A gradient's size is the sum of both parts; its direction is one of four, told at 22.5 degrees; the image's edge repeats outside.
    """
    p = np.pad(x.astype(np.int64), ((0, 0), (1, 1), (1, 1)), mode="edge")
    at = lambda dy, dx: p[:, 1 + dy : p.shape[1] - 1 + dy, 1 + dx : p.shape[2] - 1 + dx]
    gx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    size = np.abs(gx) + np.abs(gy)
    m = np.pad(size, ((0, 0), (1, 1), (1, 1)))
    near = lambda dy, dx: m[:, 1 + dy : m.shape[1] - 1 + dy, 1 + dx : m.shape[2] - 1 + dx]
    tangent = 13573 / 32768  # of 22.5 degrees
    flat, steep = np.abs(gy) < tangent * np.abs(gx), np.abs(gy) > (tangent + 2) * np.abs(gx)
    falling = (gx < 0) != (gy < 0)
    top = lambda dy, dx: (size > near(-dy, -dx)) & (size >= near(dy, dx))
    ridge = np.where(flat, top(0, 1), np.where(steep, top(1, 0), np.where(falling, top(1, -1), top(1, 1))))
    weak = ridge & (size > low)
    found = runs(weak)
    image, row, first, end = found
    root = part_of_runs(weak, found)
    strong = np.concatenate([np.zeros(weak.shape[:2] + (1,), dtype=np.int64), np.cumsum(weak & (size > high), axis=2)], axis=2)
    kept = np.bincount(root, weights=strong[image, row, end] - strong[image, row, first], minlength=len(root))[root] > 0
    out = np.zeros_like(weak)
    for i, r, a, b in zip(image[kept], row[kept], first[kept], end[kept]):
        out[i, r, a:b] = True
    return out
