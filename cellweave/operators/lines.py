"""Boxes, lines and crops: filters and projections over tables of shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digits import js_round
from .signal import by_index, dealt_pairs, modal_value


def contour_filter(contours: DataFrame, key: str, image_area: float) -> DataFrame:
    """Contours (area, vertices, width, height) that may be cells: size, corners, shape and solidity, then near the key's modal box."""
    box = F.col("width") * F.col("height")
    shape = F.col("width") / F.greatest(F.col("height"), F.lit(1))
    some = contours.where(F.col("area").between(50, image_area * 0.5) & F.col("vertices").between(4, 6) & shape.between(1 / 2.5, 2.5) & (F.coalesce(F.try_divide(F.col("area"), box), F.lit(0.0)) >= 0.7)).withColumn("box", box)
    return some.join(modal_value(some, key, "box", 20), key).where(F.col("box").between(F.col("modal") * 0.35, F.col("modal") * 2.8)).drop("modal")


def long_lines(lines: DataFrame, width: float, height: float, share: float = 0.3) -> DataFrame:
    length = F.hypot(F.col("line.x2") - F.col("line.x1"), F.col("line.y2") - F.col("line.y1"))
    return lines.where(length >= share * min(width, height))


def extend_lines(lines: DataFrame, width: float, height: float) -> DataFrame:
    """Lines over the whole image, at the rounded middle of the line."""
    x, y = js_round((F.col("line.x1") + F.col("line.x2")) / 2).cast("double"), js_round((F.col("line.y1") + F.col("line.y2")) / 2).cast("double")
    flat = F.abs(F.degrees(F.atan2(F.col("line.y2") - F.col("line.y1"), F.col("line.x2") - F.col("line.x1")))) < 45
    point = lambda x1, y1, x2, y2: F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    zero = F.lit(0.0)
    return lines.withColumn("line", F.when(flat, point(zero, y, F.lit(float(width)), y)).otherwise(point(x, zero, x, F.lit(float(height)))))


def midpoint_crossings(lines: DataFrame, key: str) -> DataFrame:
    """Each horizontal line's middle height against each vertical line's middle place."""
    h = lines.where("kind = 'horizontal'").select(key, js_round((F.col("line.y1") + F.col("line.y2")) / 2).alias("y"))
    v = lines.where("kind = 'vertical'").select(key, js_round((F.col("line.x1") + F.col("line.x2")) / 2).alias("x"))
    return dealt_pairs(h, v, key).select(key, "x", "y")


def column_edges(boxes: DataFrame, centres: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Per column centre: a tenth's left edge and nine tenths' right edge of the boxes within the tolerance; a box may count for several."""
    near = boxes.join(centres, key).where(F.abs(F.col("x") + F.col("width") / 2 - F.col("centre")) <= tolerance)
    return near.groupBy(key, "centre").agg(by_index(F.collect_list("x"), 0.1).alias("left"), by_index(F.collect_list(F.col("x") + F.col("width")), 0.9).alias("right"), F.count(F.lit(1)).alias("boxes"))


def corner_order(points: DataFrame, key: str) -> DataFrame:
    """The corners of a quadrilateral: extreme sums and differences of the coordinates, the first of equals by ``ord``."""
    p, s, d = F.struct("x", "y"), F.col("x") + F.col("y"), F.col("y") - F.col("x")
    return points.groupBy(key).agg(F.min_by(p, F.struct(s, "ord")).alias("top_left"), F.min_by(p, F.struct(d, "ord")).alias("top_right"), F.max_by(p, F.struct(s, -F.col("ord"))).alias("bottom_right"), F.max_by(p, F.struct(d, -F.col("ord"))).alias("bottom_left"))


def crop_box(x0: Column, x1: Column, y0: Column, y1: Column, width: float, height: float) -> Column:
    """A cell's inside: margins of 2 % and 3 %, clamped to the image; null if 4 pixels or less are left."""
    xs, xe, ys, ye = js_round(x0), js_round(x1), js_round(y0), js_round(y1)
    mx, my = F.greatest(F.lit(1), js_round((xe - xs) * 0.02)), F.greatest(F.lit(1), js_round((ye - ys) * 0.03))
    left, top = F.greatest(F.lit(0), F.least(xs + mx, F.lit(width - 1).cast("long"))), F.greatest(F.lit(0), F.least(ys + my, F.lit(height - 1).cast("long")))
    right, bottom = F.greatest(left + 1, F.least(xe - mx, F.lit(width).cast("long"))), F.greatest(top + 1, F.least(ye - my, F.lit(height).cast("long")))
    return F.when((right - left > 4) & (bottom - top > 4), F.struct(left.alias("x"), top.alias("y"), (right - left).alias("width"), (bottom - top).alias("height")))


def even_crop(row: Column, col: Column, rows: int, cols: int, width: float, height: float) -> Column:
    """A cell's inside where the grid is only known by its size: outer margins of 8 % and 3 %, inner ones of a quarter."""
    mx, my = F.floor(F.lit(width * 0.08)), F.floor(F.lit(height * 0.03))
    w, h = (F.lit(width) - 2 * mx) / cols, (F.lit(height) - 2 * my) / rows
    return F.struct(F.floor(mx + (col + 0.25) * w).alias("x"), F.floor(my + (row + 0.25) * h).alias("y"), F.floor(w * 0.5).alias("width"), F.floor(h * 0.5).alias("height"))


def highlight_letters(words: DataFrame, key: str, target: Column) -> DataFrame:
    """In order, each word gives the next letter of ``target`` if it has it, at its first place: (key, ord, place); a fold over the key's words."""
    rows = words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "answer"))).alias("w"), F.max(target).alias("t"))
    start = F.expr("cast(named_struct('next', 1, 'found', array()) as struct<next:int,found:array<struct<ord:bigint,place:int>>>)")

    def step(s, w):
        letter = F.col("t").substr(s["next"], F.lit(1))
        place = F.when(letter != "", F.instr(w["answer"], letter)).otherwise(0)
        return F.when(place > 0, F.struct((s["next"] + 1).alias("next"), F.concat(s["found"], F.array(F.struct(w["ord"].cast("long").alias("ord"), (place - 1).cast("int").alias("place")))).alias("found"))).otherwise(s)

    return rows.select(key, F.explode(F.aggregate("w", start, step)["found"]).alias("f")).select(key, "f.ord", "f.place")


def largest(shapes: DataFrame, key: str, area: str = "area") -> DataFrame:
    """The key's largest shape, the first of equals by ``ord``."""
    return shapes.groupBy(key).agg(F.max_by("ord", F.struct(area, -F.col("ord"))).alias("ord"), F.max(area).alias(area))


def top_per_key(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def random_hint(cells: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """One cell a key that is not filled in yet, the same for the same seed."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key), F.col("row"), F.col("col")))
    return cells.where("number is null").groupBy(key).agg(F.min_by(F.struct("row", "col"), draw).alias("hint")).select(key, "hint.row", "hint.col")


def table_structure(grid: DataFrame) -> DataFrame:
    """A grid's row and column positions as an array of rows of crossing points."""
    return grid.withColumn("points", F.transform("row_positions", lambda y: F.transform("col_positions", lambda x: F.struct(x.alias("x"), y.alias("y")))))


def confidence_band(percent: Column) -> Column:
    return F.when(percent >= 80, "High").when(percent >= 50, "Medium").otherwise("Low")


def lines_of_rows(keys: DataFrame, rows: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """(key, row, line): each key's lines by the row in which their middle lies; a row without lines has one with null.

    rows: row, top, bottom, a few for all keys and broadcast; lines: key, middle, line.
    """
    row = F.broadcast(rows)
    placed = lines.join(row, (F.col("middle") >= F.col("top")) & (F.col("middle") < F.col("bottom"))).select(key, "row", "line")
    grid = keys.distinct().join(row.select("row"), F.lit(True))
    return grid.join(placed, [key, "row"], "left")
