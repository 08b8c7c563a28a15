"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import percent

REPORT_COLUMNS = ("file", "tier", "number", "confidence", "raw_text", "raw_digits", "action", "reason")


def write_runs(runs: DataFrame, path: str) -> None:
    """A folder per puzzle; the timestamp stays in the rows."""
    runs.write.mode("append").partitionBy("puzzle_id").json(path)


def write_csv_report(report: DataFrame, path: str) -> None:
    """Only the named columns, with a header."""
    report.select(*REPORT_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def write_json_report(report: DataFrame, path: str) -> None:
    """A report as JSON, an object a line."""
    report.write.mode("overwrite").json(path)


def run_report(scored: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """(key, section, place, html): a run's report as rows of its tables; text is escaped.

    Sections: the metrics; the two grids, a row of the puzzle each; the cells that
    are not correct.  scored: key, row, col, expected, actual, match.
    """
    shown = ("accuracy", "precision", "recall", "f1", "coverage")
    lines = F.array(*[F.struct(F.lit(i).alias("place"), html_table(F.lit(n), percent(F.col(n))).alias("html")) for i, n in enumerate(shown)])
    tables = metrics.select(key, F.lit("metrics").alias("section"), F.explode(lines).alias("x")).select(key, "section", "x.*")
    parts = [tables]
    for name in ("expected", "actual"):
        cell = F.concat(F.lit("<td>"), F.coalesce(F.col(name).cast("string"), F.lit("")), F.lit("</td>"))
        cells = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", cell.alias("td")))), lambda x: x["td"]), "")
        grid = scored.groupBy(key, "row").agg(F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("html"))
        parts.append(grid.select(key, F.lit(name).alias("section"), F.col("row").alias("place"), "html"))
    wrong = scored.where("match <> 'correct'").withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("row", "col")) - 1)
    parts.append(wrong.select(key, F.lit("mismatches").alias("section"), "place", html_table(F.col("row"), F.col("col"), F.col("expected"), F.col("actual"), F.col("match")).alias("html")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_batch(metrics: DataFrame, report: DataFrame, path: str) -> None:
    """A batch's results and its report side by side: ``path/results`` as JSON, ``path/report`` as HTML lines."""
    write_json_report(metrics, f"{path}/results")
    report.select("html").write.mode("overwrite").text(f"{path}/report")


def write_label_file(items: DataFrame, path: str) -> None:
    """``name<TAB>label`` lines."""
    items.select(F.concat_ws("\t", "name", F.col("digit").cast("string"))).write.mode("overwrite").text(path)


def mapping_json(mapping: DataFrame, group: str) -> DataFrame:
    """A group's mapping as a JSON object; bounded by its symbols."""
    return mapping.groupBy(group).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol_id", "letter"))))).alias("json"))


def diagnostic_json(cells: DataFrame) -> DataFrame:
    """Per puzzle what is needed to look into its reading: counts, unrecognised and unsure cells, confidence in percent."""
    pct = F.floor(F.col("confidence") * 100 + 0.5).cast("int")
    unread = F.array_sort(F.collect_list(F.when(F.col("number").isNull(), F.struct(F.col("row").alias("r"), F.col("col").alias("c")))))
    unsure = F.array_sort(F.collect_list(F.when(F.col("number").isNotNull() & (F.col("confidence") < 0.60), F.struct(F.col("row").alias("r"), F.col("col").alias("c"), F.col("number").alias("n"), pct.alias("conf")))))
    meta = F.struct(F.count("number").alias("recognized"), F.count(F.lit(1)).alias("total"), F.countDistinct("number").alias("uniqueSymbols"))
    return cells.groupBy("puzzle").agg(meta.alias("meta"), unread.alias("unrecognized"), unsure.alias("lowConf")).select("puzzle", F.to_json(F.struct("meta", "unrecognized", "lowConf")).alias("json"))


def truth_json(cells: DataFrame, shift: int = 0) -> DataFrame:
    """Per puzzle a truth grid as JSON; ``shift`` leaves out that many first columns."""
    kept = cells.where(F.col("col") >= shift)
    rows = kept.groupBy("puzzle", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "number"))), lambda x: x["number"]).alias("r"))
    return rows.groupBy("puzzle").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "r"))), lambda x: x["r"]).alias("grid")).select("puzzle", F.to_json(F.struct(F.col("puzzle").cast("string").alias("puzzleId"), "grid"), {"ignoreNullFields": "false"}).alias("json"))


def html_table(*cells: Column) -> Column:
    """One row of a report's table; text is escaped."""
    escape = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), F.coalesce(escape(c), F.lit("")), F.lit("</td>")) for c in cells], F.lit("</tr>"))
