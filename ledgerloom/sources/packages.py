"""Packages of XML parts: reading and writing them deterministically, and editing worksheets without touching what stays."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable
from xml.etree import ElementTree as ET

from ..errors import LoomError

STAMP = (1980, 1, 1, 0, 0, 0)
#: An element may have a prefix, as in <x:row>.
TAG = r"(?:[A-Za-z_][\w.-]*:)?"
ROW = re.compile(rf"<{TAG}row\b[^>]*?(?:/>|>.*?</{TAG}row\s*>)", re.S)
CELL = re.compile(rf"<{TAG}c\b[^>]*?(?:/>|>.*?</{TAG}c\s*>)", re.S)
FORMULA = re.compile(rf"<{TAG}f\b([^>]*?)(?:/>|>(.*?)</{TAG}f\s*>)", re.S)
CACHED = re.compile(rf"<{TAG}v\b[^>]*>[^<]")
DATA = re.compile(rf"(<{TAG}sheetData\b[^>]*>)(.*)(</{TAG}sheetData\s*>)", re.S)
# The pattern of a cell's address in a formula, but not of a function's name that looks like one.
ADDRESS = re.compile(r"(?<![A-Za-z0-9_.$])\$?[A-Za-z]{1,3}\$?\d+(?![\dA-Za-z_(])")


class _Tree(ET.TreeBuilder):
    def doctype(self, name: str, public: str | None, system: str | None) -> None:
        raise LoomError("XLSX_READ_FAILED", "Document type declarations are not allowed.", {"doctype": name})


def safe_xml(data: bytes) -> ET.Element:
    """The root of an XML part in any encoding; one with a document type declaration is an error."""
    return ET.fromstring(data, ET.XMLParser(target=_Tree()))


def read_parts(content: bytes, name: str = "", code: str = "XLSX_READ_FAILED") -> dict[str, bytes]:
    try:
        package = zipfile.ZipFile(io.BytesIO(content))
        return {n: package.read(n) for n in package.namelist() if not n.endswith("/")}
    except zipfile.BadZipFile as error:
        raise LoomError(code, f"{name or 'The input'} could not be read.", {"input": name}) from error


def write_parts(parts: dict[str, bytes | str]) -> bytes:
    """The same parts give the same bytes: in order of name, with a fixed date."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(parts):
            z.writestr(zipfile.ZipInfo(name, STAMP), parts[name], zipfile.ZIP_DEFLATED)
    return out.getvalue()


def attribute(tag: str, name: str) -> str | None:
    m = re.search(rf"""\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", tag)
    return None if m is None else m[1] if m[1] is not None else m[2]


def _head(xml: str) -> str:
    return xml[: xml.index(">") + 1]


def position_dependent(formula: re.Match) -> bool:
    """Whether a formula element means something else in another row: shared and array formulas, and those with cell addresses outside quotes."""
    return attribute(f"<f {formula[1]}>", "t") in ("shared", "array") or bool(ADDRESS.search(re.sub('"[^"]*"', "", formula[2] or "")))


def _moved(row: str, to: int) -> str:
    """A row element with another number, which its cells have too."""
    head = _head(row)
    body = CELL.sub(lambda m: re.sub(r"""(\br\s*=\s*["'][A-Za-z]+)\d+""", rf"\g<1>{to}", _head(m[0]), count=1) + m[0][len(_head(m[0])) :], row[len(head) :])
    return re.sub(r"""(\br\s*=\s*["'])\d+""", rf"\g<1>{to}", head, count=1) + body


def _rows(xml: str, change: Callable[[list[tuple[int, str]]], list[str]]) -> str:
    """A worksheet with its list of (number, row element) changed. Rows without a number follow the one before."""
    data = DATA.search(xml)
    if data is None:
        return xml  # an empty sheet: <sheetData/>
    rows, at = [], 0
    for m in ROW.finditer(data[2]):
        at = int(attribute(_head(m[0]), "r") or at + 1)
        rows.append((at, m[0]))
    return xml[: data.start(2)] + "".join(change(rows)) + xml[data.end(2) :]


def without_rows(xml: str, gone: set[int]) -> str:
    """A worksheet without some rows: rows below move up by the deleted ones that were there, so gaps stay gaps."""

    def change(rows: list[tuple[int, str]]) -> list[str]:
        out, before = [], 0
        for number, row in rows:
            if number in gone:
                before += 1
            else:
                out.append(_moved(row, number - before) if before else row)
        return out

    return _rows(xml, change)


def compact_table(xml: str, top: int, bottom: int, kept: list[int], totals: bool) -> tuple[str, int]:
    """A worksheet whose table (header in row top, to row bottom) keeps some whole rows, right below the header, then its totals row; and the table's new end.

    Rows outside the table stay where they are. A formula that would move and means something else then is an error.
    """
    target = {old: top + 1 + i for i, old in enumerate(kept)}
    if totals:
        target[bottom] = top + 1 + len(kept)

    def change(rows: list[tuple[int, str]]) -> list[str]:
        out = []
        for number, row in rows:
            if top < number <= bottom:
                if number not in target:
                    continue
                to = target[number]
                if to != number:
                    for cell in CELL.finditer(row):
                        f = FORMULA.search(cell[0])
                        if f and position_dependent(f):
                            at = attribute(_head(cell[0]), "r")
                            raise LoomError("XLSX_SPLIT_PRESERVE_FORMULA", f"The formula in {at} refers to cells and its row would move.", {"cell": at, "destinationRow": to})
                    row = _moved(row, to)
                number = to
            out.append((number, row))
        return [row for _, row in sorted(out, key=lambda r: r[0])]

    end = top + len(kept) + totals
    return _rows(xml, change), max(end, top + 1)


def compact_cells(xml: str, top: int, left: int, bottom: int, right: int, kept: list[int], totals: bool) -> tuple[str, int]:
    """As compact_table(), but only the cells in the table's columns move up; what stands beside the table stays, and rows below it too."""
    target = {old: top + 1 + i for i, old in enumerate(kept)}
    if totals:
        target[bottom] = top + 1 + len(kept)

    def column(cell: str) -> int:
        letters = re.match(r"[A-Za-z]+", attribute(_head(cell), "r") or "A")[0].upper()
        return sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters)))

    def change(rows: list[tuple[int, str]]) -> list[str]:
        beside: dict[int, list[str]] = {}
        heads: dict[int, str] = {}
        for number, row in rows:
            inside = top < number <= bottom
            heads[number] = _head(row)
            for m in CELL.finditer(row[len(heads[number]) :]):
                to = number
                if inside and left <= column(m[0]) <= right:
                    if number not in target:
                        continue
                    to = target[number]
                    f = FORMULA.search(m[0])
                    if to != number and f and position_dependent(f):
                        raise LoomError("XLSX_SPLIT_PRESERVE_FORMULA", f"The formula in {attribute(_head(m[0]), 'r')} refers to cells and its row would move.", {"destinationRow": to})
                moved = re.sub(r"""(\br\s*=\s*["'][A-Za-z]+)\d+""", rf"\g<1>{to}", _head(m[0]), count=1) + m[0][len(_head(m[0])) :]
                beside.setdefault(to, []).append(moved)
        out = []
        for number in sorted({*heads, *beside}):
            head = heads.get(number)
            if head is None:  # a row that had no element
                head = re.sub(r"""(\br\s*=\s*["'])\d+""", rf"\g<1>{number}", next(iter(heads.values())), count=1)
            name = re.match(r"<([^\s/>]+)", head)[1]
            out.append(re.sub(r"\s*/?>$", ">", head) + "".join(sorted(beside.get(number, []), key=column)) + f"</{name}>")
        return out

    return _rows(xml, change), max(top + len(kept) + totals, top + 1)


def can_compact(xml: str) -> bool:
    """Whether no formula of a sheet depends on its place."""
    return not any(position_dependent(m) for m in FORMULA.finditer(xml))


def values_only(parts: dict[str, bytes]) -> tuple[dict[str, bytes], int, list[tuple[str, str]]]:
    """The parts with formulas replaced by the values they had; how many; and (part, cell) of those without one, which become blank."""
    out, count, missing = {}, 0, []
    for name, data in parts.items():
        if name == "xl/calcChain.xml":
            continue
        if re.fullmatch(r"(?i)xl/worksheets/[^/]+\.xml", name):

            def cell(m: re.Match, name: str = name) -> str:
                nonlocal count
                if not FORMULA.search(m[0]):
                    return m[0]
                count += 1
                if not CACHED.search(m[0]) and not re.search(rf"<{TAG}is\b", m[0]):
                    missing.append((name, attribute(_head(m[0]), "r") or "unknown cell"))
                return FORMULA.sub("", m[0])

            data = CELL.sub(cell, data.decode("utf-8")).encode()
        elif re.fullmatch(r"(?i)xl/tables/[^/]+\.xml", name):
            formula = rf"<{TAG}(calculatedColumnFormula|totalsRowFormula)\b[^>]*?(?:/>|>.*?</{TAG}\1\s*>)"
            data = re.sub(formula, "", data.decode("utf-8"), flags=re.S).encode()
        elif name in ("xl/_rels/workbook.xml.rels", "[Content_Types].xml"):
            data = re.sub(rf"<{TAG}(?:Relationship|Override)\b[^>]*calcChain[^>]*?/>", "", data.decode("utf-8")).encode()
        out[name] = data
    return out, count, missing


def with_reference(xml: str, element: str, reference: str) -> str:
    """The first such element's ref attribute replaced; without the element, nothing changes."""
    return re.sub(rf"""(<{TAG}{element}\b[^>]*?\bref\s*=\s*)(?:"[^"]*"|'[^']*')""", lambda m: f'{m[1]}"{reference}"', xml, count=1)


def first_shown(places: Iterable[str], most: int = 20) -> str:
    """The first places, each once, and how many more there are."""
    unique = list(dict.fromkeys(places))
    more = len(unique) - most
    return ", ".join(unique[:most]) + (f", and {more} more" if more > 0 else "")
