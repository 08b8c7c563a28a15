"""Operators on small grey pictures (arrays or bytes of their pixels, row by row) and on points in images."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels, parts

#: Pictures along each side of a photo.
ACROSS = 8
#: Steps of a quarter of a circle in which :func:`axis_lines` votes.
QUARTER = 18


def sheets(pictures: DataFrame, side: int, key: str = "vec_id") -> DataFrame:
    """(name, width, pixels): photos of 64 pictures each, by key; places of keys that are missing are black.

    A row of a photo is its pictures' rows side by side; a photo's pictures meet in one row, 64 at most (of rows that repeat a key the first by pixels).
    """
    one = pictures.groupBy(key).agg(F.min("pixels").alias("pixels"))
    by_place = F.map_from_entries(F.collect_list(F.struct((F.col(key) % (ACROSS * ACROSS)).cast("int").alias("place"), "pixels")))
    held = one.groupBy(F.floor(F.col(key) / (ACROSS * ACROSS)).cast("long").alias("sheet")).agg(by_place.alias("_at"))
    black = F.array_repeat(F.lit(0), side)
    lines = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(ACROSS - 1)), lambda down: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda row: F.flatten(
        F.transform(F.sequence(F.lit(0), F.lit(ACROSS - 1)), lambda right: F.coalesce(F.slice(F.try_element_at("_at", down * ACROSS + right), row * side + 1, F.lit(side)), black)))))))
    octets = F.unhex(F.array_join(F.transform(lines, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return held.select(F.format_string("sheet-%d.png", "sheet").alias("name"), F.lit(side * ACROSS).alias("width"), octets.alias("pixels"))


def cut_sheets(images: DataFrame, side: int) -> DataFrame:
    """(sheet, place, pixels) of the pictures of photos that :func:`sheets` made, as Spark's image source reads them."""

    def run(batches):
        for b in batches:
            sheet, place, pixels = [], [], []
            for number, width, channels, data in zip(*(b.column(i).to_pylist() for i in range(4))):
                x = np.frombuffer(data, dtype=np.uint8).reshape(-1, width, channels)[:, :, 0]
                cells = x.reshape(x.shape[0] // side, side, width // side, side).swapaxes(1, 2).reshape(-1, side * side)
                sheet += [number] * len(cells)
                place += range(len(cells))
                pixels += list(cells.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(sheet, type=pa.int64()), pa.array(place, type=pa.int32()), pa.array(pixels, type=pa.list_(pa.int32()))], names=["sheet", "place", "pixels"])

    number = F.regexp_extract("image.origin", r"sheet-(-?\d+)\.png$", 1).cast("long")
    return images.select(number.alias("sheet"), "image.width", "image.nChannels", "image.data").mapInArrow(run, "sheet long, place int, pixels array<int>")


def _stack(column: pa.Array, side: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, side, side)


def largest_parts(pictures: DataFrame, side: int, above: int, key: str = "vec_id") -> DataFrame:
    """(key, parts, area, top, left, bottom, right, perimeter, outline) of each picture's largest part of pixels above a value; pictures without one have no row."""
    names = ("parts", "area", "top", "left", "bottom", "right", "perimeter")

    def run(batches):
        for b in batches:
            if b.num_rows:
                found = [(k, *r) for k, r in zip(b.column(0).to_pylist(), parts.largest_parts(_stack(b.column(1), side) > above)) if r]
                columns = [*zip(*found)] or [[] for _ in range(9)]
                arrays = [pa.array(columns[0], type=pa.int64()), *[pa.array(c, type=pa.int32()) for c in columns[1:8]], pa.array([" ".join(map(str, o)) for o in columns[8]], type=pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, *names, "outline"])

    return pictures.select(F.col(key).cast("long"), "pixels").mapInArrow(run, f"{key} long, {', '.join(f'{n} int' for n in names)}, outline string")


def edge_pixels(pictures: DataFrame, side: int, low: float, high: float, key: str = "vec_id") -> DataFrame:
    """(key, n, edge): how many pixels of each picture are on an edge, and their numbers."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                at = [np.flatnonzero(e).tolist() for e in parts.edges(_stack(b.column(1), side), low, high)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(a) for a in at], type=pa.int32()), pa.array([" ".join(map(str, a)) for a in at], type=pa.string())], names=[key, "n", "edge"])

    return pictures.select(F.col(key).cast("long"), "pixels").mapInArrow(run, f"{key} long, n int, edge string")


#: What :func:`kernel_report` tells of a picture, with its Spark type.
REPORT = {
    "otsu": "int", "ink": "int", "inverted": "long", "dilated": "long", "eroded": "long", "opened": "long", "closed": "long", "adaptive": "int", "blurred": "double", "halved": "double",
    "rows": "string", "cols": "string", "nonzero": "double", "two_valued": "double", "laplacian": "double", "skew": "double",
}


def kernel_report(pictures: DataFrame, side: int, key: str = "vec_id") -> DataFrame:
    """(key, one column for each of :data:`REPORT`): the pixel kernels' results on each picture, as sums, counts and shares."""

    def report(x: np.ndarray) -> tuple:
        ink = kernels.binarise(x)
        rows, cols = kernels.projections(ink)
        total = lambda y: int(y.sum())
        half = kernels.fit_within(x, side // 2, side // 2)
        place = np.arange(half.size).reshape(half.shape)
        shown = lambda p: " ".join(str(int(round(v * side))) for v in p)
        return (
            kernels.otsu_threshold(x), total(ink > 0), total(kernels.invert(x)), total(kernels.dilate(x)), total(kernels.erode(x)), total(kernels.open_close(x, "open")), total(kernels.open_close(x, "close")),
            total(kernels.adaptive_threshold(x, 5, 2) > 0), round(float((kernels.gaussian_blur(x, 5) * np.arange(x.size).reshape(x.shape)).sum()), 4), round(float((half * place).sum()), 6),
            shown(rows), shown(cols), kernels.nonzero_share(x), kernels.two_valued_share(x), round(kernels.laplacian_variance(x), 6), round(kernels.skew_angle(ink), 6))

    def run(batches):
        for b in batches:
            if b.num_rows:
                columns = [*zip(*(report(x) for x in _stack(b.column(1), side).astype(np.float64)))]
                types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, type=types[t]) for c, t in zip(columns, REPORT.values())]], names=[key, *REPORT])

    return pictures.select(F.col(key).cast("long"), "pixels").mapInArrow(run, f"{key} long, " + ", ".join(f"{n} {t}" for n, t in REPORT.items()))


def angle_table(angles: int) -> list[tuple[int, float, float]]:
    """(number, cosine, sine) of equal steps of half a circle."""
    return [(t, math.cos(math.pi * t / angles), math.sin(math.pi * t / angles)) for t in range(angles)]


def line_votes(owner: np.ndarray, x: np.ndarray, y: np.ndarray, table: list[tuple[int, float, float]], least: int, apart: int) -> tuple[np.ndarray, ...]:
    """(owner, angle, rho, votes) of the lines that at least ``least`` of an owner's points lie on and that no better line is within ``apart`` steps of."""
    angle, c, s = (np.array(v) for v in zip(*table))
    rho = np.floor(x[:, None] * c + y[:, None] * s + 0.5).astype(np.int64)
    low = rho.min() - apart if rho.size else 0
    width, height = (rho.max() if rho.size else 0) + apart + 1 - low, angle.max() + 2 * apart + 1  # a step past either end meets nothing
    cell = ((owner[:, None] * height + angle + apart) * width + rho - low).ravel()
    if cell.size and cell.max() < cell.size and least > 0:  # few cells: no sort
        votes = np.bincount(cell)
        cell = np.flatnonzero(votes >= least)
        votes = votes[cell]
    else:
        cell, votes = np.unique(cell, return_counts=True)
        cell, votes = cell[votes >= least], votes[votes >= least]
    stays = np.ones(len(cell), dtype=bool)
    for step in [(a, r) for a in range(-apart, apart + 1) for r in range(-apart, apart + 1) if (a or r) and len(cell)]:
        beside = cell + step[0] * width + step[1]
        at = np.minimum(np.searchsorted(cell, beside), len(cell) - 1)
        stays &= (cell[at] != beside) | (votes[at] < votes) | ((votes[at] == votes) & (step > (0, 0)))
    cell, votes = cell[stays], votes[stays]
    return cell // width // height, cell // width % height - apart, cell % width + low, votes


def voted_lines(points: DataFrame, key: str, angles: int, least: int, apart: int) -> DataFrame:
    """(key, angle, rho, votes): lines x cos + y sin = rho that at least ``least`` points (key, x, y) lie on, to half a step.

    Every point votes once for each angle.  Of lines within ``apart`` steps of angle and distance of one another only the one
    with the most votes stays (the lower angle, then distance, of equals).  A key's points, as many as its picture has
    at most, meet in one row, and only its lines leave the task.
    """
    table, at_once = angle_table(angles), 1 << 16

    def run(batches):
        for b in batches:
            ends = np.cumsum(b.column(1).value_lengths().to_numpy(zero_copy_only=False))
            first = 0
            while first < len(ends):  # some points at a time, whole keys
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + at_once, "right")))
                some = b.slice(first, last - first)
                x, y = (some.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for i in (1, 2))
                owner, *found = line_votes(np.repeat(np.arange(last - first), some.column(1).value_lengths().to_numpy(zero_copy_only=False)), x, y, table, least, apart)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(owner)), *[pa.array(v, type=t) for v, t in zip(found, (pa.int32(), pa.int64(), pa.int64()))]], names=[key, "angle", "rho", "votes"])
                first = last

    held = points.where("x is not null and y is not null").groupBy(key).agg(F.collect_list("x").alias("x"), F.collect_list("y").alias("y"))
    return held.mapInArrow(run, f"`{key}` {points.schema[key].dataType.simpleString()}, angle int, rho long, votes long")


def grid_drawer(pitch: int, margin: int, dark: int = 20, paper: int = 230):
    """A function of Arrow batches of grids (name, rows, cols, marks: array of (i, j)): (name, picture) of each, one at a time: dark lines ``pitch`` apart, a dot in each marked cell."""

    def drawn(b: pa.RecordBatch):
        marks = b.column(3)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(marks), 0).to_numpy(zero_copy_only=False))
        at = dict(zip((f.name for f in marks.type.value_type), marks.flatten().flatten()))
        i, j = (margin + at[n].to_numpy(zero_copy_only=False).astype(np.int64) * pitch + pitch // 2 for n in ("i", "j"))
        first = 0
        for name, rows, cols, last in zip(*(b.column(c).to_pylist() for c in range(3)), ends.tolist()):
            x = np.full((2 * margin + rows * pitch + 1, 2 * margin + cols * pitch + 1), paper, dtype=np.uint8)
            end_y, end_x = margin + rows * pitch + 1, margin + cols * pitch + 1
            x[margin:end_y:pitch, margin:end_x] = dark
            x[margin:end_y, margin:end_x:pitch] = dark
            for dy, dx in ((0, 0), (0, 1), (1, 0), (1, 1)):
                y, z = i[first:last] + dy, j[first:last] + dx
                inside = (y < x.shape[0]) & (z < x.shape[1])
                x[y[inside], z[inside]] = dark
            first = last
            yield name, x

    return drawn


def draw_grids(grids: DataFrame, pitch: int, margin: int, dark: int = 20, paper: int = 230, at_once: int = 1 << 22) -> DataFrame:
    """(name, width, pixels) of the photos of :func:`grid_drawer`; about ``at_once`` bytes of them leave the task at once."""
    drawn = grid_drawer(pitch, margin, dark, paper)

    def run(batches):
        def batch():
            return pa.RecordBatch.from_arrays([pa.array(names, type=pa.string()), pa.array(widths, type=pa.int32()), pa.array(data, type=pa.binary())], names=["name", "width", "pixels"])

        for b in batches:
            names, widths, data, size = [], [], [], 0
            for name, x in drawn(b):
                names.append(name), widths.append(x.shape[1]), data.append(x.tobytes())
                size += x.size
                if size >= at_once:
                    yield batch()
                    names, widths, data, size = [], [], [], 0
            if names:
                yield batch()

    return grids.select("name", "rows", "cols", "marks").mapInArrow(run, "name string, width int, pixels binary")


def axis_lines(images: DataFrame) -> DataFrame:
    """(origin, height, width, angles, rhos, votes): the straight lines near the two axes that the dark pixels (those not above Otsu's threshold) of each of Spark's image rows vote for, as arrays.

    Angles are of :data:`QUARTER` steps a quarter.  A picture's pixels stay in the task that holds it, one picture at a time.
    """
    table = [t for t in angle_table(2 * QUARTER) if t[0] in (0, 1, QUARTER - 1, QUARTER, QUARTER + 1, 2 * QUARTER - 1)]

    def run(batches):
        for b in batches:
            for image in range(b.num_rows):
                origin, height, width, channels, data = (b.column(c)[image].as_py() for c in range(5))
                y, x = np.nonzero(kernels.binarise(kernels.grey(data, height, width, channels), inverted=True))
                _, *found = line_votes(np.zeros(len(x), dtype=np.int64), x, y, table, 12, 1)
                lists = [pa.array([v.tolist()], type=pa.list_(t)) for v, t in zip(found, (pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([origin], type=pa.string()), *(pa.array([n], type=pa.int32()) for n in (height, width)), *lists], names=["origin", "height", "width", "angles", "rhos", "votes"])

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(run, "origin string, height int, width int, angles array<int>, rhos array<long>, votes array<long>")


def detected_grids(lines: DataFrame, share: float = 0.6, apart: float = 2) -> DataFrame:
    """(origin, rows, cols, left, top, right, bottom): the grid that the long straight lines (of :func:`axis_lines`) of each photo form.

    Level lines are kept if their votes are ``share`` of the photo's width, upright ones of its height; lines at most ``apart``
    pixels from one another are one; a grid needs two each way.  A photo's lines stay in its row.
    """
    from .signal import merge_sorted

    each = F.arrays_zip("angles", "rhos", "votes")
    along = lambda angle, length: F.array_sort(F.transform(F.filter(each, lambda l: (l["angles"] == angle) & (l["votes"] >= share * F.col(length))), lambda l: l["rhos"]))  # noqa: E731, E741
    found = lines.select("origin", merge_sorted(along(QUARTER, "width"), apart).alias("y"), merge_sorted(along(0, "height"), apart).alias("x")).where("size(y) > 1 and size(x) > 1")
    count = lambda axis, name: (F.size(axis) - 1).cast("long").alias(name)
    return found.select("origin", count("y", "rows"), count("x", "cols"), F.array_min("x").alias("left"), F.array_min("y").alias("top"), F.array_max("x").alias("right"), F.array_max("y").alias("bottom"))


def filled_up(pictures: DataFrame, side: int, key: str = "vec_id", label: str = "label") -> DataFrame:
    """(label, key, copy, pixels): every picture (copy 0), and copies until each label has as many as the most frequent one.

    The copies are dealt evenly over a label's pictures, in an order drawn by their keys.  A copy is moved by at most
    one pixel each way, dimmed or lit by up to a fifth, and made noisy by up to 8; all draws
    are of the key's and the copy's digest, so reruns and lost tasks give the same pictures.  Inside the JVM.
    """
    counts = pictures.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    most = counts.agg(F.max("_n").alias("_most"))
    plan = counts.join(F.broadcast(most), F.lit(True))  # one row
    more = F.col("_most") - F.col("_n")
    numbered = _numbered(pictures.select(key, F.col(label).alias("label"), "pixels", F.md5(F.concat(F.lit("order:"), F.col(key).cast("string"))).alias("_order")), key)
    sized = numbered.join(plan.withColumnRenamed(label, "_label"), F.col("label").eqNullSafe(F.col("_label")))
    copies = F.floor(more / F.col("_n")) + F.when(F.col("_nth") - 1 < more % F.col("_n"), 1).otherwise(0)
    each = sized.select("label", key, "pixels", F.explode(F.sequence(F.lit(0).cast("long"), copies)).alias("copy"))
    draw = lambda what: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(what), F.col(key).cast("string"), F.col("copy").cast("string"))), 1, 8), 16, 10).cast("long")
    first = F.col("copy") == 0
    drawn = each.withColumns({
        "_dy": F.when(first, 0).otherwise(draw("down") % 3 - 1), "_dx": F.when(first, 0).otherwise(draw("across") % 3 - 1),
        "_light": F.when(first, 100).otherwise(80 + draw("light") % 41), "_seed": F.when(~first, draw("noise"))})

    def pixel(i: Column) -> Column:
        y, x = F.floor(i / side) - F.col("_dy"), i % side - F.col("_dx")
        noise = F.when(F.col("_seed").isNull(), 0).otherwise(F.floor(F.col("_seed") * (2 * i + 1) / 64) % 17 - 8)
        lit = F.floor(F.get("pixels", (y * side + x).cast("int")) * F.col("_light") / 100) + noise
        return F.when(y.between(0, side - 1) & x.between(0, side - 1), F.greatest(F.lit(0), F.least(F.lit(255), lit))).otherwise(0).cast("int")

    changed = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), pixel)
    return drawn.select("label", key, F.col("copy").cast("int").alias("copy"), changed.alias("pixels"))


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """``_nth`` along a label's drawn order; a label may hold a third of all rows."""
    from .running import numbered

    return numbered(rows, "label", ["_order", key], "_nth").drop("_order")


def quadrilaterals(orders: DataFrame) -> DataFrame:
    """(quad, x0, y0, ... x3, y3): four orders are the corners (around it) of a quadrilateral of about 200 by 150; incomplete ones are left out."""
    corner = (F.col("o_orderkey") % 4).cast("int")
    at = orders.groupBy(F.floor(F.col("o_orderkey") / 4).cast("long").alias("quad"), corner.alias("corner")).agg(F.min((F.col("o_custkey") % 50).cast("double")).alias("jx"), F.min((F.floor("o_totalprice") % 40).cast("double")).alias("jy"))
    placed = at.select("quad", "corner", (F.col("jx") + F.when(F.col("corner").isin(1, 2), 200).otherwise(0)).alias("x"), (F.col("jy") + F.when(F.col("corner") >= 2, 150).otherwise(0)).alias("y"))
    take = lambda c, i: F.max(F.when(F.col("corner") == i, F.col(c))).alias(f"{c}{i}")
    return placed.groupBy("quad").agg(F.count(F.lit(1)).alias("_n"), *[take(c, i) for i in range(4) for c in "xy"]).where("_n = 4").drop("_n")


def homography(corners: DataFrame) -> DataFrame:
    """Adds g and h of the map from the unit square to the quadrilateral x0, y0, ... x3, y3; those whose opposite sides make it impossible are left out.

    The map is (u, v) to ((x1 - x0 + g x1) u + (x3 - x0 + h x3) v + x0) / (g u + h v + 1), and so for y.
    """
    c = F.col
    sums = {"_ax": c("x1") - c("x2"), "_bx": c("x3") - c("x2"), "_sx": c("x0") - c("x1") + c("x2") - c("x3"), "_ay": c("y1") - c("y2"), "_by": c("y3") - c("y2"), "_sy": c("y0") - c("y1") + c("y2") - c("y3")}
    den = c("_ax") * c("_by") - c("_bx") * c("_ay")
    solved = corners.withColumns(sums).where(den != 0).withColumns({"g": (c("_sx") * c("_by") - c("_bx") * c("_sy")) / den, "h": (c("_ax") * c("_sy") - c("_sx") * c("_ay")) / den})
    return solved.drop(*sums)


def mapped(axis: str, u: Column, v: Column) -> Column:
    """The coordinate, ``x`` or ``y``, to which the map of :func:`homography` takes (u, v)."""
    a, b, d = (F.col(f"{axis}{i}") for i in (0, 1, 3))
    return ((b - a + F.col("g") * b) * u + (d - a + F.col("h") * d) * v + a) / (F.col("g") * u + F.col("h") * v + 1)


def perspective_grid(corners: DataFrame, n: int) -> DataFrame:
    """(quad, i, j, x, y): where the middles of an n by n grid on the rectified image lie in the photo."""
    steps = F.array(*[F.lit(i) for i in range(n)])
    grid = homography(corners).withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    u, v = (2 * F.col("i") + 1) / (2 * n), (2 * F.col("j") + 1) / (2 * n)
    return grid.select("quad", "i", "j", F.round(mapped("x", u, v), 6).alias("x"), F.round(mapped("y", u, v), 6).alias("y"))


def rectified(image: np.ndarray, corners: list[tuple[float, float]], height: int, width: int) -> np.ndarray:
    """The quadrilateral of an image (corners around it, from the top left), made a rectangle: each pixel is that nearest to where the map takes its middle; 0 outside."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = corners
    matrix = np.array([[x1 - x2, x3 - x2], [y1 - y2, y3 - y2]], dtype=float)
    g, h = np.linalg.solve(matrix, np.array([x0 - x1 + x2 - x3, y0 - y1 + y2 - y3], dtype=float))
    v, u = np.meshgrid((np.arange(height) + 0.5) / height, (np.arange(width) + 0.5) / width, indexing="ij")
    scale = g * u + h * v + 1
    x = np.floor(((x1 - x0 + g * x1) * u + (x3 - x0 + h * x3) * v + x0) / scale).astype(int)
    y = np.floor(((y1 - y0 + g * y1) * u + (y3 - y0 + h * y3) * v + y0) / scale).astype(int)
    inside = (x >= 0) & (y >= 0) & (x < image.shape[1]) & (y < image.shape[0])
    return np.where(inside, image[np.clip(y, 0, image.shape[0] - 1), np.clip(x, 0, image.shape[1] - 1)], 0)
