"""Worksheets as cells: one row (file, sheet, row, col, value, ...) for every cell that is not empty."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import LoomError
from ..functions.cells import compatible, header_text, key_of, trimmed

SHEET = ("file", "sheet")


def header_rows(cells: DataFrame, header_row: int | None = None) -> DataFrame:
    """(file, sheet, header_row): the first row with a value (empty text is one), or the row given, where it is in the sheet's rows."""
    if header_row is not None:
        if header_row < 1:
            raise LoomError("XLSX_INVALID_HEADER_ROW", "The header row must be a positive integer.", {"headerRow": header_row})
        inside = cells.groupBy(*SHEET).agg(F.min("row").alias("low"), F.max("row").alias("high")).filter(F.lit(header_row).between(F.col("low"), F.col("high")))
        return inside.select(*SHEET, F.lit(header_row).cast("long").alias("header_row"))
    return cells.filter("value is not null").groupBy(*SHEET).agg(F.min("row").alias("header_row"))


def header_place(cells: DataFrame, column: str, header_row: int | None = None) -> DataFrame:
    """(file, sheet, header_row, header_col): the first cell, row by row, whose text is the column's name, in the row given if any."""
    if header_row is not None:
        cells = cells.filter(F.col("row") == header_row)
    found = cells.filter(F.lower(trimmed(compatible(F.col("value")))) == header_text(column))
    first = found.groupBy(*SHEET).agg(F.min(F.struct("row", "col")).alias("at"))
    return first.select(*SHEET, F.col("at.row").alias("header_row"), F.col("at.col").alias("header_col"))


def unique_header_names(cells: DataFrame) -> DataFrame:
    """(file, sheet, col, name) of header cells (value may be null): blanks are column_N, repeats get their number."""
    base = F.when(key_of(F.coalesce("value", F.lit(""))) == "", F.concat(F.lit("column_"), F.col("col"))).otherwise(F.trim("value"))
    rows = cells.withColumn("base", base)
    n = F.row_number().over(Window.partitionBy(*SHEET, key_of(F.col("base"))).orderBy("col"))
    return rows.withColumn("n", n).select(*SHEET, "col", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", "n")).alias("name"))


def rows_with_values(cells: DataFrame) -> DataFrame:
    """(file, sheet, row) of rows with a cell that is neither null nor empty text; white space counts."""
    return cells.filter("value is not null and value <> ''").select(*SHEET, "row").distinct()


def in_ranges(cells: DataFrame, ranges: DataFrame, block: int = 1024) -> DataFrame:
    """Cells with each range (file, sheet, name, top, left, bottom, right) they are in.

    Joined on the sheet and blocks of rows, so that a long sheet is many keys, and a cell meets only the ranges of its block.
    """
    blocks = F.sequence(F.expr(f"top div {block}"), F.expr(f"bottom div {block}"))
    spread = ranges.withColumn("_block", F.explode(blocks))
    inside = F.col("row").between(F.col("top"), F.col("bottom")) & F.col("col").between(F.col("left"), F.col("right"))
    return cells.withColumn("_block", F.expr(f"row div {block}")).join(spread, [*SHEET, "_block"]).filter(inside).drop("_block")


def matched_tables(headers: DataFrame, tables: DataFrame) -> DataFrame:
    """headers (file, sheet, header_row, header_col) with the first Excel table (file, sheet, place, name, top, left, header, columns, ...) whose header is there: the same row, and a column of the same name at the same place."""
    named = tables.filter("header").select(*SHEET, "place", F.struct(*[c for c in tables.columns if c not in SHEET]).alias("table"))
    met = headers.join(named, list(SHEET)).filter((F.col("table.top") == F.col("header_row")))
    own = F.get("table.columns", F.col("header_col") - F.col("table.left"))
    met = met.filter((F.col("header_col") >= F.col("table.left")) & (F.lower(trimmed(compatible(own))) == F.lower(trimmed(compatible(F.col("header"))))))
    return met.groupBy(*SHEET, "header_row", "header_col").agg(F.min_by("table", "place").alias("table"))


def duplicate_names(names: DataFrame) -> DataFrame:
    """(name, times) of names (name) that are there more than once."""
    return names.groupBy("name").agg(F.count("*").alias("times")).filter("times > 1")


def empty_rows(cells: DataFrame) -> DataFrame:
    """(file, sheet, n) rows of cells in which all are null or empty text."""
    full = cells.groupBy(*SHEET, "row").agg(F.max(F.coalesce(F.col("value") != "", F.lit(False))).alias("full"))
    return full.groupBy(*SHEET).agg(F.count_if(~F.col("full")).alias("n"))


def split_counts(rows: DataFrame) -> DataFrame:
    """(group_key, sheet, kept, deleted) for every group and every sheet of rows (sheet, key, ...); null keys are in no group.

    Zero counts are there too: the table is groups times sheets, and both come from sums, not from rows.
    """
    counts = rows.groupBy("sheet", "key").agg(F.count("*").alias("n"))
    totals = counts.groupBy("sheet").agg(F.sum("n").alias("total"))
    groups = counts.filter("key is not null").select(F.col("key").alias("group_key")).distinct()
    pairs = groups.join(totals, how="cross").join(counts.withColumnRenamed("key", "group_key"), ["group_key", "sheet"], "left")
    kept = F.coalesce("n", F.lit(0)).cast("long")
    return pairs.select("group_key", "sheet", kept.alias("kept"), (F.col("total") - kept).cast("long").alias("deleted"))


def compacted(rows: DataFrame, keep: Column, by: list[str], order: str = "row", block: int = 100_000) -> DataFrame:
    """Kept rows with new_row: the old number less the rows deleted before it. order is a row number from 1.

    The running count is taken in blocks of rows and over the blocks' sums, so no task sees all rows of a long sheet.
    """
    marked = rows.withColumn("_gone", F.when(keep, 0).otherwise(1)).withColumn("_block", F.floor(F.col(order) / block))
    sums = marked.groupBy(*by, "_block").agg(F.sum("_gone").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*by, "_block", before.alias("_before"))
    within = F.sum("_gone").over(Window.partitionBy(*by, "_block").orderBy(order))
    out = marked.withColumn("_within", within).join(sums, [*by, "_block"]).filter("_gone = 0")
    return out.withColumn("new_row", (F.col(order) - F.col("_within") - F.col("_before")).cast("long")).drop("_gone", "_block", "_within", "_before")


def named_areas(names: DataFrame) -> DataFrame:
    """(name, sheet, range) of names (name, ref) that people made and that stand for one area, as sources.xlsx.named_area() reads them."""
    quoted, plain, cells = r"'((?:[^']|'')+)'", "([^'!,:]+)", r"(\$?[A-Za-z]{1,3}\$?\d+(?::\$?[A-Za-z]{1,3}\$?\d+)?)"
    ref, pattern = F.trim("ref"), rf"^(?:{quoted}|{plain})!{cells}$"
    found = names.filter(~F.col("name").startswith("_xlnm.") & ref.rlike(pattern))
    sheet = F.concat(F.replace(F.regexp_extract(ref, pattern, 1), F.lit("''"), F.lit("'")), F.regexp_extract(ref, pattern, 2))
    return found.select("name", sheet.alias("sheet"), F.replace(F.regexp_extract(ref, pattern, 3), F.lit("$"), F.lit("")).alias("range"))


def chosen_areas(areas: DataFrame, kind: str, names: Iterable[str] | None = None, sheets: Iterable[str] | None = None, include_hidden: bool = False) -> DataFrame:
    """The areas (area, name, sheet, visibility, ...) of one kind that are visible (or all), on the sheets and of the names given, whatever their case."""
    areas = areas.filter(F.col("area") == kind)
    if not include_hidden:
        areas = areas.filter("visibility = 0")
    for column, wanted in (("name", names), ("sheet", sheets)):
        if wanted is not None:
            areas = areas.filter(F.lower(column).isin([w.lower() for w in wanted]))
    return areas


def merge_counts(sheets: DataFrame) -> DataFrame:
    """(output_sheets, hidden_sheets) of the sheets (visibility) that are merged; the index isn't one of them."""
    return sheets.agg(F.count("*").alias("output_sheets"), F.count_if(F.col("visibility") > 0).alias("hidden_sheets"))


def split_totals(rows: DataFrame) -> DataFrame:
    """Counts of a split over rows (sheet, key): every group's workbook loses the rows of all others, and those without a key."""
    groups, n, kept = F.count_distinct("key"), F.count("*"), F.count("key")
    return rows.agg(n.alias("input_rows"), F.count_if(F.col("key").isNull()).alias("skipped_rows"), groups.alias("groups"), kept.alias("output_rows"), F.count_distinct("sheet").alias("sheets_filtered"), (groups * n - kept).alias("rows_deleted"))


def table_rows(rows: DataFrame, by: list[str], top: str, order: str) -> DataFrame:
    """Kept rows of tables with new_row, right below the header in row top, and totals_row, the one after the last; by: the table."""
    w = Window.partitionBy(*by)
    return rows.withColumn("new_row", (F.col(top) + F.row_number().over(w.orderBy(order))).cast("long")).withColumn("totals_row", (F.col(top) + 1 + F.count("*").over(w)).cast("long"))


def column_widths(df: DataFrame) -> DataFrame:
    """(column, width): the longest text and two more, from 10 to 60."""
    longest = df.agg(*[F.max(F.length(F.col(c).cast("string"))).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.greatest(F.lit(len(c)), F.coalesce(F.col(c), F.lit(0))).alias("n")) for c in df.columns])
    return longest.select(F.explode(pairs).alias("p")).select("p.column", F.least(F.lit(60), F.greatest(F.lit(10), F.col("p.n") + 2)).cast("long").alias("width"))


def relocatable(formula: Column) -> Column:
    """Whether a formula can move to another row: it refers to no cell. Text in quotes doesn't count."""
    bare = F.regexp_replace(formula, '"[^"]*"', '""')
    return ~bare.rlike(r"(?i)(^|[^A-Z0-9_.])\$?[A-Z]{1,3}\$?[0-9]+($|[^A-Z0-9_(.])")
