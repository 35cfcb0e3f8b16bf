"""Workbooks: worksheets of .xlsx packages as rows of cells, and a small deterministic writer; standard library only."""

from __future__ import annotations

import datetime
import posixpath
import re
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import LoomError
from ..functions.formats import BUILT_IN, is_date, shown
from .packages import read_parts, safe_xml, write_parts

CELLS = "file string, sheet string, sheet_order int, visibility int, row long, col int, kind string, value string, number double, formula string, display string"
#: Areas of workbooks that hold tables: used ranges of sheets, Excel tables and named ranges, in the workbook's order.
AREAS = "file string, area string, place int, name string, sheet string, sheet_order int, visibility int, ref string, top long, left int, bottom long, right int, header boolean, totals boolean, columns array<string>"
# A defined name's reference to one area, and the prefix of names that the program makes itself.
AREA_REF = re.compile(r"(?:'((?:[^']|'')+)'|([^'!,:]+))!(\$?[A-Za-z]{1,3}\$?\d+(?::\$?[A-Za-z]{1,3}\$?\d+)?)")
BUILT_IN_NAME = "_xlnm."


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _all(root: ET.Element, name: str) -> Iterator[ET.Element]:
    return (e for e in root.iter() if _name(e.tag) == name)


def _attribute(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if _name(k) == name), None)


def part_path(base: str, target: str) -> str:
    """Package path of a relationship's target; one that leaves the package is an error."""
    path = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(posixpath.dirname(base), target))
    if path.startswith(".."):
        raise LoomError("XLSX_READ_FAILED", f"{target} is outside the package.", {"target": target})
    return path


def column_index(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Za-z]+", reference)[0].upper():
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _iso(serial: float, since_1904: bool) -> str:
    start = datetime.datetime(1904, 1, 1) if since_1904 else datetime.datetime(1899, 12, 30)
    moment = start + datetime.timedelta(milliseconds=round(serial * 86_400_000))
    return moment.strftime("%Y-%m-%dT%H:%M:%S.") + f"{moment.microsecond // 1000:03d}Z"


def number_text(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def range_of(reference: str) -> tuple[int, int, int, int]:
    """top, left, bottom and right of A1 or A1:B2, dollar signs allowed."""
    ends = [re.fullmatch(r"([A-Za-z]{1,3})(\d+)", e) for e in reference.replace("$", "").split(":")]
    if not 1 <= len(ends) <= 2 or None in ends:
        raise LoomError("XLSX_INVALID_NAMED_RANGE", f"{reference} is not a range of cells.", {"range": reference})
    rows, cols = [int(e[2]) for e in ends], [column_index(e[1]) for e in ends]
    return min(rows), min(cols), max(rows), max(cols)


def range_text(top: int, left: int, bottom: int, right: int) -> str:
    return f"{column_letters(left)}{top}:{column_letters(right)}{bottom}"


def named_area(reference: str) -> tuple[str, str] | None:
    """Sheet and range of a defined name that stands for one area; None for any other."""
    m = AREA_REF.fullmatch(reference.strip())
    return m and ((m[1] or "").replace("''", "'") or m[2], m[3].replace("$", ""))


def _placed(root: ET.Element) -> Iterator[tuple[int, int, ET.Element]]:
    """Row, column and element of each cell; those without an address follow the one before."""
    at_row = 0
    for row in _all(root, "row"):
        at_row = int(row.attrib.get("r", at_row + 1))
        at_col = 0
        for cell in (e for e in row if _name(e.tag) == "c"):
            at_col = column_index(cell.attrib["r"]) if "r" in cell.attrib else at_col + 1
            yield at_row, at_col, cell


class Workbook:
    """Catalogues and cells of one package."""

    def __init__(self, content: bytes, name: str = ""):
        self.name = name
        self.parts = read_parts(content, name)
        if "xl/workbook.xml" not in self.parts:
            raise LoomError("XLSX_READ_FAILED", f"{name or 'The input'} is not a workbook.", {"input": name})
        book = safe_xml(self.parts["xl/workbook.xml"])
        self.since_1904 = any(_attribute(e, "date1904") in ("1", "true") for e in _all(book, "workbookPr"))
        links = self.links("xl/workbook.xml")
        states = {"hidden": 1, "veryHidden": 2}
        self.sheets = [(_attribute(e, "name"), states.get(_attribute(e, "state") or "", 0), links.get(_attribute(e, "id"))) for e in _all(book, "sheet")]
        self.names = [(_attribute(e, "name"), e.text or "") for e in _all(book, "definedName") if not (_attribute(e, "name") or BUILT_IN_NAME).startswith(BUILT_IN_NAME)]

    def links(self, part: str) -> dict[str, str]:
        folder, _, file = part.rpartition("/")
        path = f"{folder}/_rels/{file}.rels"
        if path not in self.parts:
            return {}
        return {e.attrib["Id"]: part_path(part, e.attrib["Target"]) for e in _all(safe_xml(self.parts[path]), "Relationship") if e.attrib.get("TargetMode") != "External"}

    def strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.parts:
            return []
        return ["".join(t.text or "" for t in _all(e, "t")) for e in _all(safe_xml(self.parts["xl/sharedStrings.xml"]), "si")]

    def formats(self) -> list[str]:
        """The number format of each cell style."""
        if "xl/styles.xml" not in self.parts:
            return []
        root = safe_xml(self.parts["xl/styles.xml"])
        own = BUILT_IN | {int(e.attrib["numFmtId"]): e.attrib.get("formatCode", "General") for e in _all(root, "numFmt")}
        used = next(_all(root, "cellXfs"), None)
        return [own.get(int(e.attrib.get("numFmtId", 0)), "General") for e in used] if used is not None else []

    def used_range(self, part: str) -> tuple[int, int, int, int] | None:
        """The sheet's own dimension if it is a range, else the extent of its cells."""
        root = safe_xml(self.parts[part])
        dimension = next(_all(root, "dimension"), None)
        if dimension is not None and ":" in dimension.attrib.get("ref", ""):
            return range_of(dimension.attrib["ref"])
        places = [(r, c) for r, c, _ in _placed(root)]
        return (min(r for r, _ in places), min(c for _, c in places), max(r for r, _ in places), max(c for _, c in places)) if places else None

    def areas(self) -> Iterator[tuple]:
        """Rows of AREAS but for the file. Sheets, tables and names that have no cells, or that point nowhere, are left out."""
        known = {s: (i, v, p) for i, (s, v, p) in enumerate(self.sheets)}
        for i, (sheet, visibility, part) in enumerate(self.sheets):
            if part in self.parts and (own := self.used_range(part)):
                yield "sheet", i, sheet, sheet, i, visibility, range_text(*own), *own, True, False, None
        for i, t in enumerate(self.tables()):
            order, visibility, _ = known[t["sheet"]]
            try:
                own = range_of(t["ref"])
            except LoomError as error:
                raise LoomError("XLSX_INVALID_EXCEL_TABLE", f"Table {t['name']} has an invalid range.", {"table": t["name"], "range": t["ref"]}) from error
            if own[3] - own[1] + 1 != len(t["columns"]):
                raise LoomError("XLSX_INVALID_EXCEL_TABLE", f"Table {t['name']} has another number of columns than its range.", {"table": t["name"], "range": t["ref"]})
            yield "table", i, t["name"], t["sheet"], order, visibility, t["ref"], *own, t["header"], t["totals"], t["columns"]
        for i, (name, text) in enumerate(self.names):
            found = named_area(text)
            if found and found[0] in known:
                order, visibility, _ = known[found[0]]
                yield "name", i, name, found[0], order, visibility, found[1], *range_of(found[1]), True, False, None

    def cells(self) -> Iterator[tuple]:
        """(sheet, order, visibility, row, col, kind, value, number, formula, display); cells without a value have kind empty."""
        strings, formats = self.strings(), self.formats()
        for order, (sheet, visibility, part) in enumerate(self.sheets):
            if part in self.parts:
                for row, col, cell in _placed(safe_xml(self.parts[part])):
                    yield sheet, order, visibility, row, col, *self._value(cell, strings, formats)

    def _value(self, cell: ET.Element, strings: list[str], formats: list[str]) -> tuple:
        parts = {_name(e.tag): e for e in cell}
        formula = (parts["f"].text or "") if "f" in parts else None
        raw = parts["v"].text if "v" in parts else None
        kind = cell.attrib.get("t", "n")
        if kind == "inlineStr":
            text = "".join(t.text or "" for t in _all(cell, "t"))
            return "string", text, None, formula, text
        if raw is None:
            return "empty", None, None, formula, ""
        if kind == "s":
            return "string", strings[int(raw)], None, formula, strings[int(raw)]
        if kind == "b":
            return "boolean", "true" if raw == "1" else "false", None, formula, "TRUE" if raw == "1" else "FALSE"
        if kind in ("str", "e"):
            return ("string" if kind == "str" else "error"), raw, None, formula, raw
        if kind == "d":
            return "date", raw, None, formula, raw
        number, style = float(raw), int(cell.attrib.get("s", 0))
        code = formats[style] if style < len(formats) else "General"
        if is_date(code):
            return "date", _iso(number, self.since_1904), number, formula, shown(number, code, self.since_1904)
        return "number", number_text(number), number, formula, shown(number, code)

    def tables(self) -> Iterator[dict]:
        """Excel tables: name, sheet, ref, header and totals rows, columns."""
        for sheet, _, part in self.sheets:
            for path in self.links(part).values() if part else ():
                if "/tables/" in path and path in self.parts:
                    root = safe_xml(self.parts[path])
                    yield {"name": root.attrib.get("displayName") or root.attrib.get("name"), "sheet": sheet, "ref": root.attrib["ref"], "header": root.attrib.get("headerRowCount", "1") != "0", "totals": root.attrib.get("totalsRowCount", "0") != "0", "columns": [e.attrib.get("name", "") for e in _all(root, "tableColumn")], "part": path, "sheet_part": part}


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _from_files(spark: SparkSession, paths: str | list[str] | DataFrame, schema: str, rows: Callable[[Workbook], Iterator[tuple]]) -> DataFrame:
    """A DataFrame of what rows() gives for each workbook; paths may also be a DataFrame (path, content) of workbooks in memory."""
    fields = [f.split(" ") for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [(path, *r) for r in rows(Workbook(content, path))]
                columns = list(zip(*found, strict=True)) or [()] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    files = paths if isinstance(paths, DataFrame) else spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select("path", "content").mapInArrow(run, schema)


def read_cells(spark: SparkSession, paths: str | list[str] | DataFrame, sheets: Iterable[str] | None = None, include_hidden: bool = False) -> DataFrame:
    """Cells of all workbooks under paths, one task for each few files. sheets: names to read, whatever their case."""
    wanted = None if sheets is None else {s.lower() for s in sheets}
    return _from_files(spark, paths, CELLS, lambda b: (c for c in b.cells() if (include_hidden or not c[2]) and (wanted is None or c[0].lower() in wanted)))


def read_areas(spark: SparkSession, paths: str | list[str] | DataFrame) -> DataFrame:
    """The catalogue of sheets, Excel tables and named ranges of all workbooks under paths; see AREAS."""
    return _from_files(spark, paths, AREAS, lambda b: b.areas())


_ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;"}


def _escaped(text: str) -> str:
    return "".join(_ESCAPES.get(c, c) for c in text if c >= " " or c in "\t\n\r")


def _cell(reference: str, value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{reference}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{reference}"><v>{number_text(float(value)) if isinstance(value, float) else value}</v></c>'
    return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{_escaped(str(value))}</t></is></c>'


def workbook_bytes(sheets: list[tuple[str, list, Iterable[tuple]]], states: Iterable[int] = ()) -> bytes:
    """A workbook of sheets (name, first row, other rows); the same input gives the same bytes. states: each sheet's visibility, 0 to 2."""
    states = [*states, *[0] * len(sheets)]
    hidden = ("", ' state="hidden"', ' state="veryHidden"')
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    parts = {}
    for i, (_, columns, rows) in enumerate(sheets, 1):
        width = [min(60, max(10, len(str(c)) + 2)) for c in columns]
        lines = ["<row r=\"1\">" + "".join(_cell(f"{column_letters(j)}1", c) for j, c in enumerate(columns, 1)) + "</row>"]
        n = 1
        for row in rows:
            n += 1
            lines.append(f'<row r="{n}">' + "".join(_cell(f"{column_letters(j)}{n}", v) for j, v in enumerate(row, 1)) + "</row>")
            width = [min(60, max(w, len(str(v)) + 2)) if v is not None else w for w, v in zip(width, row, strict=True)]
        cols = "".join(f'<col min="{j}" max="{j}" width="{w}" customWidth="1"/>' for j, w in enumerate(width, 1))
        ref = f"A1:{column_letters(max(1, len(columns)))}{n}"
        parts[f"xl/worksheets/sheet{i}.xml"] = f'{head}<worksheet {main}><dimension ref="{ref}"/>' + (f"<cols>{cols}</cols>" if cols else "") + f'<sheetData>{"".join(lines)}</sheetData><autoFilter ref="{ref}"/></worksheet>'
    numbers = range(1, len(sheets) + 1)
    parts["xl/workbook.xml"] = f'{head}<workbook {main} xmlns:r="{relation}"><sheets>' + "".join(f'<sheet name="{_escaped(sheets[i - 1][0])}" sheetId="{i}"{hidden[states[i - 1]]} r:id="rId{i}"/>' for i in numbers) + "</sheets></workbook>"
    package = "http://schemas.openxmlformats.org/package/2006"
    parts["xl/_rels/workbook.xml.rels"] = f'{head}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{relation}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + "</Relationships>"
    parts["_rels/.rels"] = f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts["[Content_Types].xml"] = f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in numbers) + "</Types>"
    return write_parts(parts)
