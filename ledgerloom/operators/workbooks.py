"""Tables of workbooks, and operations on them: consolidate, merge, and display-text records. Splitting is in splits.py."""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LoomError
from ..functions.cells import column_key, unique_headers
from ..functions.names import sheet_names
from ..plans.control import Control, OperationPlan, OperationResult, PlannedOutput, commit, refuse_overwriting_inputs
from ..sources.packages import values_only, write_parts
from ..sources.xlsx import Workbook, read_areas, read_cells, workbook_bytes
from .sheets import chosen_areas, header_rows, in_ranges
from .tables import SOURCE_COLUMNS, Table

XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
CONSOLIDATE, MERGE = "sheets.consolidate", "sheets.merge"
LABELS = ("Visible", "Hidden", "Very hidden")


@dataclass(frozen=True)
class Placed:
    """An area with its header: columns are at left, left + 1, ...; data from first to bottom."""

    file: str
    order: tuple
    name: str
    sheet: str
    ref: str
    left: int
    header_row: int
    first: int
    bottom: int
    columns: list[str]


def placed_areas(cells: DataFrame, areas: DataFrame, header_row: int | None = None) -> list[Placed]:
    """The areas with a header row, in order of file, sheet and place; as long as the catalogue. Areas without one are left out.

    A sheet's header is the first row with a value, or header_row; a named range's is its first row; Excel tables have their own columns.
    """
    found = areas.collect()
    heads = areas.filter("area = 'name'").select("file", "sheet", F.col("top").alias("header_row"), F.col("ref"))
    rows = header_rows(cells.filter("kind <> 'empty'"), header_row) if header_row is None else header_rows(cells, header_row)
    of_sheets = areas.filter("area = 'sheet'").select("file", "sheet", "ref").join(rows, ["file", "sheet"]).select("file", "sheet", "header_row", "ref")
    header = {}
    texts: dict = {}
    wanted = heads.unionByName(of_sheets).distinct()
    for r in wanted.collect():
        header[r["file"], r["sheet"], r["ref"]] = r["header_row"]
    if header:
        for c in cells.join(wanted.select("file", "sheet", F.col("header_row").alias("row")).distinct(), ["file", "sheet", "row"]).filter("value is not null").select("file", "sheet", "row", "col", "value").collect():
            texts[c["file"], c["sheet"], c["row"], c["col"]] = c["value"]
    out = []
    for a in found:
        at = a["top"] if a["area"] == "table" else header.get((a["file"], a["sheet"], a["ref"]))
        if at is None:
            continue
        if a["area"] == "table":
            names = unique_headers([c or None for c in a["columns"]])
            first, bottom = a["top"] + bool(a["header"]), a["bottom"] - bool(a["totals"])
        else:
            names = unique_headers([texts.get((a["file"], a["sheet"], at, c)) for c in range(a["left"], a["right"] + 1)])
            first, bottom = at + 1, a["bottom"]
        out.append(Placed(a["file"], (a["file"], a["sheet_order"], a["place"]), a["name"], a["sheet"], a["ref"], a["left"], at, first, bottom, names))
    return sorted(out, key=lambda p: p.order)


def _column_type(kinds: set[str]) -> str:
    return {frozenset({"number"}): "double", frozenset({"boolean"}): "boolean"}.get(frozenset(kinds), "string")


def typed(kind: str) -> Column:
    """A cell's value as a column's type; columns of several kinds are text."""
    return {"double": F.col("number"), "boolean": F.col("value") == "true"}.get(kind, F.col("value"))


def _data(spark: SparkSession, cells: DataFrame, places: list[Placed]) -> DataFrame:
    """Cells with a value in the areas' data rows, with area (number of the place) and at (number of the column)."""
    rows = spark.createDataFrame([(i, p.file, p.sheet, p.first, p.left, max(p.bottom, p.first), p.left + len(p.columns) - 1) for i, p in enumerate(places) if p.columns], "area int, file string, sheet string, top long, left int, bottom long, right int")
    found = in_ranges(cells.filter("kind <> 'empty'"), rows).withColumn("at", F.col("col") - F.col("left"))
    return found.filter(F.col("row") <= F.col("bottom"))


def read_tables(spark: SparkSession, paths: str | list[str] | DataFrame, kind: str = "sheet", names: Iterable[str] | None = None, sheets: Iterable[str] | None = None, include_hidden: bool = False, header_row: int | None = None) -> list[Table]:
    """A table for each worksheet (kind sheet), Excel table (table) or named range (name) that has a row with a value.

    Columns of one kind keep it: numbers, booleans; others are text, dates in ISO form. Empty rows are left out, and rows know their
    place. The list is as long as the catalogue; rows stay on the executors.
    """
    cells = read_cells(spark, paths, sheets, include_hidden)
    places = placed_areas(cells, chosen_areas(read_areas(spark, paths), kind, names, sheets, include_hidden), header_row)
    if not places:
        return []
    data = _data(spark, cells, places).filter("value <> '' OR kind <> 'string'")
    kinds: dict = {}
    for r in data.groupBy("area", "at").agg(F.collect_set("kind").alias("kinds")).collect():
        kinds.setdefault(r["area"], {})[r["at"]] = set(r["kinds"])
    tables = []
    for i, p in enumerate(places):
        if i not in kinds:
            continue
        own = cells.filter((F.col("file") == p.file) & (F.col("sheet") == p.sheet) & F.col("row").between(p.first, p.bottom) & (F.col("kind") != "empty"))
        # of columns with one name, which made-up names can give, each keeps its values
        values = [F.max(F.when(F.col("col") == p.left + j, typed(_column_type(kinds[i].get(j, {"string"}))))).alias(f"c{j}") for j in range(len(p.columns))]
        rows = own.groupBy("row").agg(F.max((F.col("value") != "") & F.col("col").between(p.left, p.left + len(p.columns) - 1)).alias("_full"), *values)
        tables.append(Table(rows.filter("_full").drop("_full").toDF("_at", *p.columns), "_at", os.path.basename(p.file), p.sheet, 0, p.name, p.ref))
    return tables


def header_names(spark: SparkSession, paths: str | list[str] | DataFrame, kind: str = "sheet", include_hidden: bool = False, header_row: int | None = None) -> list[tuple[str, str, list[str]]]:
    """(file, area's name, its columns) of every worksheet, Excel table or named range: headers only, to choose a column from."""
    cells = read_cells(spark, paths, include_hidden=include_hidden)
    places = placed_areas(cells, chosen_areas(read_areas(spark, paths), kind, include_hidden=include_hidden), header_row)
    return [(os.path.basename(p.file), p.name, p.columns) for p in places]


def consolidate(spark: SparkSession, paths: str | list[str] | DataFrame, add_source: bool = True, names: tuple[str, ...] = SOURCE_COLUMNS, sheets: Iterable[str] | None = None, include_hidden: bool = False, header_row: int | None = None) -> DataFrame:
    """One table of all worksheets of all files, by column name, with where each row comes from, and _table and _order for its order.

    One plan, however many sheets there are: cells meet the catalogue of headers and become rows in one aggregation. Columns meet
    as in union_tables(). Sheets count by their whole path; the file's name is shown.
    """
    cells = read_cells(spark, paths, sheets, include_hidden)
    places = placed_areas(cells, chosen_areas(read_areas(spark, paths), "sheet", None, sheets, include_hidden), header_row)
    data = _data(spark, cells, places) if places else None
    full = {r["area"] for r in data.filter("value <> ''").select("area").distinct().collect()} if places else set()
    if not full:
        raise LoomError("XLSX_NO_TABLES", "No worksheet with data rows was found.")
    spelled: dict[str, str] = {}
    heads = []
    for i, p in enumerate(places):
        if i in full:
            last = {column_key(c): j for j, c in enumerate(p.columns)}  # of equal names in a table, the last has the values
            for c in p.columns:
                spelled.setdefault(column_key(c), c)
            heads += [(i, j, k, os.path.basename(p.file), p.sheet) for k, j in last.items()]
    for name in names if add_source else ():
        if column_key(name) in spelled:
            raise LoomError("TABLE_SOURCE_COLUMN_COLLISION", f"A column is already called {name}.", {"column": name})
    if add_source and len({column_key(n) for n in names}) < len(names):
        raise LoomError("TABLE_SOURCE_COLUMN_COLLISION", "Source columns need different names.")
    number = {k: n for n, k in enumerate(spelled)}
    headers = spark.createDataFrame([(i, j, number[k], f, s) for i, j, k, f, s in heads], "area int, at int, n int, _file string, _sheet string")
    known = data.join(headers, ["area", "at"])
    kinds = {r["n"]: set(r["kinds"]) for r in known.filter("value <> '' OR kind <> 'string'").groupBy("n").agg(F.collect_set("kind").alias("kinds")).collect()}
    values = [F.max(F.when(F.col("n") == n, typed(_column_type(kinds.get(n, {"string"}))))).alias(f"c{n}") for n in number.values()]
    rows = known.groupBy("area", "row").agg(F.max(F.col("value") != "").alias("_full"), F.first("_file").alias("_file"), F.first("_sheet").alias("_sheet"), *values).filter("_full")
    columns = [F.col(f"c{n}").alias(name) for n, name in enumerate(spelled.values())]
    if add_source:
        columns += [F.col(c).alias(n) for c, n in zip(("_file", "_sheet", "row"), names, strict=True)]
    return rows.select(*columns, F.col("area").alias("_table"), F.col("row").alias("_order"))


def write_table(df: DataFrame, path: str, sheet: str = "Consolidated", overwrite: bool = False, order: tuple[str, ...] = ("_table", "_order"), operation: str = "sheets.write-table", metrics: dict[str, int] | None = None) -> OperationResult:
    """One worksheet of df, streamed from the executors in order. A worksheet has about a million rows at most; larger tables belong in Parquet."""
    rows = df.orderBy(*[c for c in order if c in df.columns]).drop(*order)
    if not rows.columns:
        raise LoomError("XLSX_NO_COLUMNS", "A table without columns cannot be written.")
    written = 0

    def counted():
        nonlocal written
        for row in rows.toLocalIterator():
            written += 1
            yield tuple(row)

    content = workbook_bytes([(sheet, rows.columns, counted())])
    return OperationResult(operation, tuple(commit([(path, content)], overwrite)), metrics={**(metrics or {}), "outputRows": written, "outputColumns": len(rows.columns)})


def plan_consolidate(paths: list[str], output: str, control: Control | None = None) -> OperationPlan:
    """What consolidate_workbooks() would write; reads no workbook."""
    if not paths:
        raise LoomError("XLSX_NO_INPUTS", "At least one workbook is needed.")
    refuse_overwriting_inputs([output], paths)
    (control or Control()).step(CONSOLIDATE, "planning", 0, 1)
    return OperationPlan(CONSOLIDATE, tuple(paths), (PlannedOutput(output, os.path.exists(output), XLSX),), metrics={"inputFiles": len(paths), "outputFiles": 1})


def consolidate_workbooks(spark: SparkSession, paths: list[str], output: str, sheet: str = "Consolidated", overwrite: bool = False, control: Control | None = None, **kind) -> OperationResult:
    """consolidate() into one workbook."""
    plan_consolidate(paths, output)
    control = control or Control()
    control.step(CONSOLIDATE, "reading-workbooks", 0, len(paths))
    df = consolidate(spark, list(paths), **kind)
    tables = df.select("_table").distinct().count()
    control.step(CONSOLIDATE, "writing-output", 0, 1, output)
    return write_table(df, output, sheet, overwrite, operation=CONSOLIDATE, metrics={"inputFiles": len(paths), "inputTables": tables})


def merged_bytes(contents: list[tuple[str, bytes]], with_index: bool = True, values: bool = False, control: Control | None = None) -> tuple[bytes, dict[str, int], list[str]]:
    """All worksheets' values one after the other, hidden ones hidden, with unique names, and an index sheet of where they come from."""
    if not contents:
        raise LoomError("XLSX_NO_INPUTS", "At least one workbook is needed.")
    sheets, index = [], []
    for i, (name, content) in enumerate(contents):
        (control or Control()).step(MERGE, "merging-inputs", i, len(contents), name)
        book = Workbook(content, name)
        grids: dict[str, dict] = {s: {} for s, _, _ in book.sheets}
        for sheet, _, _, row, col, kind, value, number, *_ in book.cells():
            grids[sheet][row, col] = number if kind == "number" else (value == "true" if kind == "boolean" else value)
        for sheet, visibility, _ in book.sheets:
            grid = {k: v for k, v in grids[sheet].items() if v is not None}
            width, height = max((c for _, c in grid), default=1), max((r for r, _ in grid), default=1)
            sheets.append((sheet, [tuple(grid.get((r, c)) for c in range(1, width + 1)) for r in range(1, height + 1)], visibility))
            index.append((os.path.basename(name), sheet, LABELS[visibility]))
    if not sheets:
        raise LoomError("XLSX_NO_SHEETS", "No worksheets were found in the workbooks.")
    names = sheet_names([s for s, _, _ in sheets], ["Sheet Index"] if with_index else [])
    out = [(n, list(rows[0]), rows[1:]) for n, (_, rows, _) in zip(names, sheets, strict=True)]
    states = [v for _, _, v in sheets]
    if with_index:
        out.append(("Sheet Index", ["Source file", "Original sheet", "Sheet", "Visibility"], [(f, s, n, v) for (f, s, v), n in zip(index, names, strict=True)]))
    hidden = sum(v > 0 for v in states)
    told = [f"{hidden} source worksheet{' was' if hidden == 1 else 's were'} hidden{'; see the Sheet Index worksheet' if with_index else ' in the merged workbook'}."] if hidden else []
    return workbook_bytes(out, states), {"hiddenSheets": hidden, "inputFiles": len(contents), "outputSheets": len(sheets)}, told


def merge_workbooks(contents: list[tuple[str, bytes]], path: str, with_index: bool = True, overwrite: bool = False, values: bool = False, control: Control | None = None) -> OperationResult:
    refuse_overwriting_inputs([path], [n for n, _ in contents])
    content, metrics, told = merged_bytes(contents, with_index, values, control)
    return OperationResult(MERGE, tuple(commit([(path, content)], overwrite)), tuple(told), metrics)


def values_workbook(content: bytes, name: str = "") -> tuple[bytes, int, list[str]]:
    """A workbook whose formulas are the values they had; how many there were, and the places (Sheet!A1) of those without one."""
    book = Workbook(content, name)
    parts, count, missing = values_only(book.parts)
    sheets = {part: sheet for sheet, _, part in book.sheets}
    return write_parts(parts), count, [f"{sheets.get(part, part)}!{cell}" for part, cell in missing]


@dataclass(frozen=True)
class Records:
    """A worksheet's rows as they are shown, all text; df has _at, the source row."""

    columns: list[str]
    df: DataFrame
    worksheet: str
    skipped: int


def worksheet_records(spark: SparkSession, paths: str | DataFrame, worksheet: str | None = None, header_row: int | None = None) -> Records:
    """Rows of one worksheet (the first, or the one of this name whatever its case) under strict headers: none empty, none twice."""
    areas = read_areas(spark, paths).filter("area = 'sheet'").orderBy("sheet_order").collect()
    cells = read_cells(spark, paths, include_hidden=True)
    wanted = (worksheet or "").strip().lower()
    chosen = next((a for a in areas if not wanted or a["sheet"].lower() == wanted), None)
    if chosen is None:
        raise LoomError("XLSX_WORKSHEET_NOT_FOUND", f"Worksheet {worksheet} was not found." if wanted else "The workbook has no worksheet with cells.", {"availableWorksheets": [a["sheet"] for a in areas], "worksheet": worksheet})
    sheet = chosen["sheet"]
    own = cells.filter(F.col("sheet") == sheet)
    head = header_rows(own.filter("kind <> 'empty'")).collect() if header_row is None else [{"header_row": header_row}]
    if header_row is not None and header_row < 1 or not head or head[0]["header_row"] > chosen["bottom"]:
        raise LoomError("XLSX_INVALID_HEADER_ROW", f"Worksheet {sheet} does not have this header row.", {"headerRow": header_row, "worksheet": sheet})
    at, left, right = head[0]["header_row"], chosen["left"], chosen["right"]
    texts = {c["col"]: c["display"].strip() for c in own.filter(F.col("row") == at).select("col", "display").collect()}
    columns = [texts.get(c, "") for c in range(left, right + 1)]
    if "" in columns:
        raise LoomError("XLSX_EMPTY_HEADER", f"Worksheet {sheet} has an empty column header.", {"column": left + columns.index(""), "headerRow": at, "worksheet": sheet})
    if twice := list(dict.fromkeys(c for i, c in enumerate(columns) if c in columns[:i])):
        raise LoomError("XLSX_DUPLICATE_HEADER", f"Worksheet {sheet} has columns of the same name.", {"duplicateHeaders": twice, "headerRow": at, "worksheet": sheet})
    below = own.filter((F.col("row") > at) & (F.col("row") <= chosen["bottom"]) & F.col("col").between(left, right))
    shown = [F.coalesce(F.max(F.when(F.col("col") == left + j, F.col("display"))), F.lit("")).alias(f"c{j}") for j in range(len(columns))]
    full = below.groupBy("row").agg(F.max(F.coalesce(F.col("value") != "", F.lit(False))).alias("_full"), *shown).filter("_full").drop("_full")
    return Records(columns, full.toDF("_at", *columns), sheet, max(0, chosen["bottom"] - at) - full.count())
