"""Splitting a workbook by a column: every worksheet at once with the package kept, or one worksheet, Excel table or named range."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LoomError
from ..functions.cells import column_key, is_blank, split_key, trimmed, typed_key
from ..functions.names import output_names, safe_name
from ..plans.control import Control, OperationPlan, OperationResult, PlannedOutput, check_outputs, commit, refuse_overwriting_inputs
from ..sources.packages import can_compact, compact_table, first_shown, values_only, with_reference, without_rows, write_parts
from ..sources.xlsx import Workbook, range_text, read_areas, read_cells, workbook_bytes
from .sheets import chosen_areas, header_place, matched_tables
from .workbooks import XLSX, Placed, placed_areas

SPLIT = "sheets.split-by-column"
XLSM = "application/vnd.ms-excel.sheet.macroEnabled.12"


@dataclass(frozen=True)
class Options:
    """What to split and how. Without a table, range or sheet every worksheet is split, unless preserve is False."""

    column: str
    table: str | None = None
    range: str | None = None
    sheet: str | None = None
    header_row: int | None = None
    prefix: str | None = None
    include_blank: bool = True
    include_hidden: bool = False
    preserve: bool | None = None
    strict: bool = False
    values: bool = False

    @property
    def every_sheet(self) -> bool:
        return not (self.table or self.range or self.sheet) and self.preserve is not False

    def checked(self) -> Options:
        """Itself, if its parts go together."""
        conflicts = (
            (self.table and self.range, "XLSX_SPLIT_TABLE_RANGE_CONFLICT", "Choose an Excel table or a named range, not both."),
            (self.table and self.header_row is not None, "XLSX_SPLIT_TABLE_HEADER_ROW", "An Excel table has its own header row."),
            (self.range and self.header_row is not None, "XLSX_SPLIT_RANGE_HEADER_ROW", "A named range's first row is its header."),
            (self.preserve and not self.table and not self.every_sheet, "XLSX_SPLIT_PRESERVE_REQUIRES_TABLE", "Only a split by an Excel table can keep the rest of the workbook."),
            (self.header_row is not None and self.header_row < 1, "XLSX_INVALID_HEADER_ROW", "The header row must be a positive integer."),
        )
        for wrong, code, message in conflicts:
            if wrong:
                raise LoomError(code, message, {"table": self.table, "range": self.range, "headerRow": self.header_row})
        return self


@dataclass(frozen=True)
class Group:
    key: str | None
    display: str | None
    rows: int


@dataclass(frozen=True)
class Split:
    """A split that has been looked at: its groups in first-seen order, its outputs and counts, and how to make the workbooks."""

    options: Options
    path: str
    groups: list[Group]
    outputs: list[str]
    metrics: dict[str, int]
    warnings: tuple[str, ...]
    details: list[dict]
    build: object  # () -> iterator of (place of the group, content, formulas, places without a value)


def _content(path: str) -> bytes:
    try:
        with open(path, "rb") as f:
            return f.read()
    except FileNotFoundError as error:
        raise LoomError("XLSX_INPUT_NOT_FOUND", f"{path} was not found.", {"input": path}) from error
    except OSError as error:
        raise LoomError("XLSX_READ_FAILED", f"{path} could not be read.", {"input": path}) from error


def _outputs(path: str, folder: str, names: list[str]) -> list[str]:
    outputs = [os.path.join(os.path.abspath(folder), n) for n in names]
    refuse_overwriting_inputs(outputs, [path])
    return outputs


def _skipped(n: int, column: str, tail: str = "") -> tuple[str, ...]:
    return (f"Skipped {n} row{'' if n == 1 else 's'} with blank values in \"{column}\"{tail}.",) if n else ()


def split_rows(cells: DataFrame, areas: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """(sheets, rows): the sheets with the column and their data rows' window and Excel table, and (sheet, sheet_order, row, key, display) of keyed rows.

    A sheet's window goes from below the header to its used range's end, or to the end of the Excel table whose header it is, without totals.
    """
    filled = cells.filter("kind <> 'empty'")
    places = header_place(filled, options.column, options.header_row).withColumn("header", F.lit(options.column))
    tables = areas.filter("area = 'table'").select("file", "sheet", "place", "name", "top", "left", "bottom", "right", "header", "totals", "columns")
    matched = matched_tables(places, tables).select("file", "sheet", "table")
    sheets = places.join(areas.filter("area = 'sheet'").select("file", "sheet", "sheet_order", "bottom"), ["file", "sheet"]).join(matched, ["file", "sheet"], "left")
    last = F.when(F.col("table").isNull(), F.col("bottom")).otherwise(F.col("table.bottom") - F.col("table.totals").cast("int"))
    sheets = sheets.select("file", "sheet", "sheet_order", "header_row", "header_col", "table", (F.col("header_row") + 1).alias("first"), last.alias("last"))
    inside = filled.drop("sheet_order").join(sheets, ["file", "sheet"]).filter((F.col("col") == F.col("header_col")) & F.col("row").between(F.col("first"), F.col("last")))
    key = split_key(F.col("value"), options.strict, F.when(F.col("kind") == "error", "string").otherwise(F.col("kind")))
    rows = inside.select("sheet", "sheet_order", "row", key.alias("key"), trimmed(F.col("value")).alias("display")).filter("key is not null")
    return sheets, rows


def _built(split: DataFrame) -> Iterator[tuple[int, bytes, int, list[str]]]:
    for r in split.orderBy("place").toLocalIterator():
        yield r["place"], bytes(r["content"]), r["formulas"], r["missing"]


BUILT = "place int, content binary, formulas long, missing array<string>"


def _table_written(parts: dict, table: dict, kept: list[int]) -> None:
    """A table and its worksheet changed in a package to hold the kept rows only."""
    xml, end = compact_table(parts[table["sheet_part"]].decode(), table["top"], table["bottom"], kept, table["totals"])
    parts[table["sheet_part"]] = xml.encode()
    left, right, top = table["left"], table["right"], table["top"]
    body = with_reference(parts[table["part"]].decode(), "table", range_text(top, left, end, right))
    parts[table["part"]] = with_reference(body, "autoFilter", range_text(top, left, max(top + len(kept), top), right)).encode()


def resolve_every_sheet(spark: SparkSession, path: str, folder: str, options: Options) -> Split:
    """All worksheets: each sheet with the column keeps a group's rows, moved up; others stay. Styles, formulas and macros are kept."""
    extension = os.path.splitext(path)[1].lower()
    if extension not in (".xlsx", ".xlsm"):
        raise LoomError("XLSX_SPLIT_UNSUPPORTED_FILE", f"{path} is neither an .xlsx nor an .xlsm workbook.", {"input": path})
    content = _content(path)
    book = Workbook(content, path)
    files = spark.createDataFrame([(path, bytearray(content))], "path string, content binary")
    cells, areas = read_cells(spark, files, include_hidden=True), read_areas(spark, files)
    sheets, rows = split_rows(cells, areas, options)
    found = sheets.orderBy("sheet_order").collect()
    if not found:
        raise LoomError("XLSX_SPLIT_COLUMN_NOT_FOUND", f"Column {options.column} was not found in any worksheet.", {"availableWorksheets": [s for s, _, _ in book.sheets], "column": options.column})
    at = F.struct("sheet_order", "row")
    grouped = rows.groupBy("key").agg(F.min_by("display", at).alias("display"), F.min(at).alias("at"), F.count("*").alias("n"))
    groups = [Group(g["key"], g["display"], g["n"]) for g in grouped.orderBy("at").collect()]
    if not groups:
        raise LoomError("XLSX_SPLIT_NO_GROUPS", f"Column {options.column} has no values.", {"column": options.column})
    names = output_names([g.display for g in groups], safe_name(options.prefix, "split") if options.prefix else "", extension[1:])
    parts_of = {s: p for s, _, p in book.sheets}
    tables = {(t["sheet"], t["name"]): t for t in book.tables()}
    plan = []
    for s in found:
        table = s["table"].asDict() | {k: tables[s["sheet"], s["table"]["name"]][k] for k in ("part", "sheet_part")} if s["table"] else None
        plan.append({"sheet": s["sheet"], "part": parts_of[s["sheet"]], "first": s["first"], "last": s["last"], "table": table})
    any_table, values = any(p["table"] for p in plan), options.values
    if not values:  # a table whose sheet has formulas tied to their places keeps its range, and its rows go as on a plain sheet
        loose = [p["sheet"] for p in plan if p["table"] and not can_compact(book.parts[p["part"]].decode())]
        plan = [p | {"table": None} if p["sheet"] in loose else p for p in plan]
    else:
        loose = []
    sheet_names = {part: sheet for sheet, _, part in book.sheets}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        original = Workbook(content, path).parts
        for batch in batches:
            for place, kept in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of = {k["sheet"]: sorted(k["rows"]) for k in kept}
                parts, formulas, missing = dict(original), 0, []
                if values and any_table:
                    parts, formulas, missing = values_only(parts)
                for p in plan:
                    own = of.get(p["sheet"], [])
                    if p["table"]:
                        _table_written(parts, p["table"] | {"sheet_part": p["part"]}, own)
                    else:
                        parts[p["part"]] = without_rows(parts[p["part"]].decode(), set(range(p["first"], p["last"] + 1)) - set(own)).encode()
                if values and not any_table:
                    parts, formulas, missing = values_only(parts)
                places = [f"{sheet_names.get(part, part)}!{cell}" for part, cell in missing]
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([write_parts(parts)], pa.binary()), pa.array([formulas]), pa.array([places], pa.list_(pa.string()))], ["place", "content", "formulas", "missing"])

    numbers = spark.createDataFrame([(i, g.key) for i, g in enumerate(groups)], "place int, key string")
    # a worksheet has a million rows at most, so a group's row numbers are few
    kept = rows.groupBy("key", "sheet").agg(F.collect_list("row").alias("rows")).groupBy("key").agg(F.collect_list(F.struct("sheet", "rows")).alias("kept"))
    per_group = numbers.join(kept, "key").select("place", "kept").repartition("place")
    counts = {(r["key"], r["sheet"]): r["n"] for r in rows.groupBy("key", "sheet").agg(F.count("*").alias("n")).collect()}
    windows = {p["sheet"]: max(0, p["last"] - p["first"] + 1) for p in plan}
    details = [{"group": g.display, "sheets": [{"sheet": s, "retainedRows": counts.get((g.key, s), 0), "deletedRows": n - counts.get((g.key, s), 0)} for s, n in windows.items()]} for g in groups]
    total, kept_rows = sum(windows.values()), sum(g.rows for g in groups)
    metrics = {
        "groups": len(groups), "inputFiles": 1, "inputRows": total, "outputFiles": len(groups), "outputRows": kept_rows, "rowsDeleted": total * len(groups) - kept_rows,
        "sheetsCopiedUnchanged": len(book.sheets) - len(plan), "sheetsFiltered": len(plan), "skippedRows": total - kept_rows, "valuesOnly": int(values),
    }
    told = _skipped(total - kept_rows, options.column, "; no workbook was made for them")
    if loose:
        told += (f"Excel tables on {', '.join(loose)} have formulas tied to their rows, so rows went without closing up the table's range.",)
    return Split(options, path, groups, _outputs(path, folder, names), metrics, told, details, lambda: _built(per_group.mapInArrow(build, BUILT)))


def resolve_one_source(spark: SparkSession, path: str, folder: str, options: Options, content: bytes | None = None) -> Split:
    """One worksheet, Excel table or named range: a workbook of a group's rows each, or, of an Excel table, the whole workbook with its rows only."""
    content = _content(path) if content is None else content
    preserve = bool(options.table) if options.preserve is None else options.preserve
    kind, name = ("table", options.table) if options.table else ("name", options.range) if options.range else ("sheet", options.sheet)
    files = spark.createDataFrame([(path, bytearray(content))], "path string, content binary")
    sheets = [options.sheet] if options.sheet else None
    cells = read_cells(spark, files, sheets, options.include_hidden)
    areas = chosen_areas(read_areas(spark, files), kind, [name] if name else None, sheets, options.include_hidden)
    sources = []
    for p in placed_areas(cells, areas, options.header_row):
        own = cells.filter((F.col("sheet") == p.sheet) & F.col("row").between(p.first, p.bottom) & F.col("col").between(p.left, p.left + len(p.columns) - 1) & (F.col("kind") != "empty"))
        if not own.filter("value <> ''").isEmpty():
            sources.append((p, own))
    if not sources:
        raise LoomError("XLSX_SPLIT_NO_TABLE", f"{name or 'A visible worksheet'} was not found or has no data rows.", {"table": options.table, "range": options.range, "sheet": options.sheet})
    if len(sources) > 1:
        raise LoomError("XLSX_SPLIT_MULTIPLE_TABLES", "More than one source fits; choose a worksheet.", {"availableSheets": [p.sheet for p, _ in sources]})
    place, own = sources[0]
    wanted = [j for j, c in enumerate(place.columns) if column_key(c) == column_key(options.column)]
    if not wanted:
        raise LoomError("TABLE_COLUMN_NOT_FOUND", f"No column is called {options.column}.", {"column": options.column, "available": place.columns})
    full = own.filter("value <> ''").select("row").distinct()
    split = own.filter(F.col("col") == place.left + wanted[0])
    text = F.when(F.col("kind").isin("number", "boolean"), F.concat(F.col("kind"), F.lit(":"), F.col("value"))).otherwise(typed_key(F.col("value"), "string"))
    blank = F.when(~F.col("kind").isin("number", "boolean") & is_blank(F.col("value")), True).otherwise(False)
    keyed = split.select("row", F.when(~blank, text).alias("key"), F.when(~blank, F.col("value")).alias("display"))
    rows = full.join(keyed, "row", "left")
    total = rows.count()
    if not options.include_blank:
        rows = rows.filter("key is not null")
    grouped = rows.groupBy("key").agg(F.min_by("display", "row").alias("display"), F.min("row").alias("at"), F.count("*").alias("n")).orderBy("at").collect()
    if not grouped:
        raise LoomError("XLSX_SPLIT_NO_GROUPS", f"No groups remain for column {options.column}.", {"column": options.column})
    groups = [Group(g["key"], g["display"], g["n"]) for g in grouped]
    prefix = safe_name(options.prefix if options.prefix is not None else os.path.splitext(os.path.basename(path))[0], "split")
    names = output_names([g.display for g in groups], prefix)
    numbers = spark.createDataFrame([(i, g.key) for i, g in enumerate(groups)], "place int, key string")
    of_group = rows.join(F.broadcast(numbers), rows["key"].eqNullSafe(numbers["key"])).select("place", "row")
    kept = sum(g.rows for g in groups)
    metrics = {
        "formulaCellsConverted": 0, "formulaCellsWithoutCachedValues": 0, "groups": len(groups), "inputFiles": 1, "inputRows": total, "outputFiles": len(groups),
        "outputRows": kept, "rowsDeleted": 0, "sheetsCopiedUnchanged": 0, "sheetsFiltered": 1, "skippedRows": total - kept, "valuesOnly": int(options.values),
    }
    made = _preserved(content, path, place, options, of_group) if preserve else _fresh(place, own, of_group)
    return Split(options, path, groups, _outputs(path, folder, names), metrics, _skipped(total - kept, options.column), [], lambda: _built(made))


def _preserved(content: bytes, path: str, place: Placed, options: Options, of_group: DataFrame) -> DataFrame:
    book = Workbook(content, path)
    table = next((t for t in book.tables() if t["name"] == place.name and t["sheet"] == place.sheet), None)
    if table is None:
        raise LoomError("XLSX_SPLIT_PRESERVE_TABLE_NOT_FOUND", f"{place.name} is not in the package.", {"table": place.name})
    table = table | {"top": place.first - table["header"], "bottom": place.bottom + table["totals"], "left": place.left, "right": place.left + len(place.columns) - 1}
    values = options.values

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        original, formulas = book.parts, 0
        if values:
            original, formulas, _ = values_only(original)
        for batch in batches:
            for place, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = dict(original)
                _table_written(parts, table, sorted(rows))
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([write_parts(parts)], pa.binary()), pa.array([formulas]), pa.array([[]], pa.list_(pa.string()))], ["place", "content", "formulas", "missing"])

    return of_group.groupBy("place").agg(F.collect_list("row").alias("rows")).repartition("place").mapInArrow(build, BUILT)


def _fresh(place: Placed, own: DataFrame, of_group: DataFrame) -> DataFrame:
    columns, left, sheet = place.columns, place.left, place.sheet

    def build(table: pa.Table) -> pa.Table:
        grid: dict[int, dict[int, object]] = {}
        for r in table.select(["row", "col", "kind", "value", "number"]).to_pylist():
            grid.setdefault(r["row"], {})[r["col"] - left] = r["number"] if r["kind"] == "number" else r["value"] == "true" if r["kind"] == "boolean" else r["value"]
        rows = (tuple(grid[n].get(j) for j in range(len(columns))) for n in sorted(grid))
        content = workbook_bytes([(sheet[:31], columns, rows)])
        return pa.table({"place": pa.array([table["place"][0].as_py()], pa.int32()), "content": pa.array([content], pa.binary()), "formulas": pa.array([0]), "missing": pa.array([[]], pa.list_(pa.string()))})

    return own.join(of_group, "row").groupBy("place").applyInArrow(build, BUILT)


def resolve(spark: SparkSession, path: str, folder: str, options: Options) -> Split:
    options = options.checked()
    return (resolve_every_sheet if options.every_sheet else resolve_one_source)(spark, path, folder, options)


def plan_split(spark: SparkSession, path: str, folder: str, options: Options) -> OperationPlan:
    """What split_workbook() would write; writes nothing."""
    split = resolve(spark, path, folder, options)
    media = XLSM if path.lower().endswith(".xlsm") and options.every_sheet else XLSX
    return OperationPlan(SPLIT, (path,), tuple(PlannedOutput(o, os.path.exists(o), media) for o in split.outputs), split.warnings, split.metrics)


def split_workbook(spark: SparkSession, path: str, folder: str, options: Options, overwrite: bool = False, control: Control | None = None) -> OperationResult:
    """A workbook for each group, made by the executors one group at a time; the driver stages each as it comes, and commits all or none."""
    split = resolve(spark, path, folder, options)
    check_outputs(split.outputs, overwrite, "XLSX_SPLIT_OUTPUT_NOT_FILE")
    control = control or Control()
    counts = {"formulas": 0}
    missing: list[str] = []

    def files() -> Iterator[tuple[str, bytes]]:
        for place, content, formulas, places in split.build():
            control.step(SPLIT, "staging-workbooks", place, len(split.groups), split.outputs[place])
            counts["formulas"] += formulas
            missing.extend(places)
            yield split.outputs[place], content
        control.step(SPLIT, "committing-outputs", len(split.groups), len(split.groups))

    done = commit(files(), overwrite, "XLSX_SPLIT_OUTPUT_NOT_FILE")
    told = list(split.warnings)
    if missing:
        told.append(f"{len(missing)} formula cell{' had' if len(missing) == 1 else 's had'} no cached value and became blank: {first_shown(missing)}. Recalculate and save the workbook if these values are needed.")
    metrics = split.metrics | {"formulaCellsConverted": counts["formulas"], "formulaCellsWithoutCachedValues": len(missing)}
    return OperationResult(SPLIT, tuple(done), tuple(told), metrics, split.details)


def split_bytes(spark: SparkSession, name: str, content: bytes, options: Options) -> list[tuple[str, bytes]]:
    """(file name, content) for each group of one source in memory."""
    split = resolve_one_source(spark, name, ".", options.checked(), content)
    return [(os.path.basename(split.outputs[place]), made) for place, made, *_ in split.build()]


