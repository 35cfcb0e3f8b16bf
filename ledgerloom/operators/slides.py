"""Presentation templates: one slide for each record, by replacing placeholders in a slide's text."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from ..errors import LoomError
from ..plans.control import Control, OperationPlan, OperationResult, PlannedOutput, commit, refuse_overwriting_inputs
from ..sources.packages import read_parts, write_parts
from .workbooks import worksheet_records

POPULATE = "pptx.populate"
PPTX = "application/vnd.openxmlformats-officedocument.presentationml.presentation"

SHAPE = re.compile(r"<p:sp>.*?</p:sp>|<p:sp .*?</p:sp>", re.S)
RUN = re.compile(r"(<a:t(?: [^>]*)?>)(.*?)(</a:t>)", re.S)
FIELD = re.compile(r"\{\{([^{}]*)\}\}")
# Named characters of XML.
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}
SLIDE = "application/vnd.openxmlformats-officedocument.presentationml.slide+xml"
SLIDE_LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/slide"


@dataclass(frozen=True)
class Inspection:
    """Names with how often they occur, shapes with stray braces, and names outside of shapes. Names may reach over several runs of text."""

    fields: dict[str, int]
    malformed: int
    elsewhere: tuple[str, ...]
    slide: int = 1

    @property
    def occurrences(self) -> int:
        return sum(self.fields.values())


def decoded(text: str) -> str:
    """XML text with its named and numbered characters; each is resolved once."""

    def one(m: re.Match) -> str:
        if m[1] is not None:
            return NAMED[m[1]]
        code = int(m[2], 16) if m[2] is not None else int(m[3])
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return re.sub(r"&(?:(lt|gt|quot|apos|amp)|#x([0-9A-Fa-f]+)|#([0-9]+));", one, text)


def _text(xml: str) -> str:
    return decoded("".join(m[2] for m in RUN.finditer(xml)))


def inspected(slide: str, number: int = 1) -> Inspection:
    fields: dict[str, int] = {}
    malformed = 0
    for shape in SHAPE.findall(slide):
        text = _text(shape)
        for m in FIELD.finditer(text):
            if name := m[1].strip():
                fields[name] = fields.get(name, 0) + 1
        rest = FIELD.sub(lambda m: "" if m[1].strip() else m[0], text)
        malformed += "{{" in rest or "}}" in rest
    outside = {m[1].strip() for m in FIELD.finditer(_text(SHAPE.sub("", slide))) if m[1].strip()}
    return Inspection(fields, malformed, tuple(sorted(outside)), number)


def validated(found: Inspection) -> None:
    """What makes a template unusable is an error: stray braces, placeholders that reach no text shape, or none at all."""
    if found.malformed:
        raise LoomError("PPTX_MALFORMED_PLACEHOLDER", "The template has unfinished placeholders.", {"malformedPlaceholderCount": found.malformed, "templateSlide": found.slide})
    if found.elsewhere:
        raise LoomError("PPTX_UNSUPPORTED_PLACEHOLDER_PLACEMENT", "Placeholders may only be in text shapes.", {"placeholders": list(found.elsewhere), "templateSlide": found.slide})
    if not found.fields:
        raise LoomError("PPTX_NO_PLACEHOLDERS", "The template has no placeholders.", {"templateSlide": found.slide})


def fitting(found: Inspection, columns: Sequence[str], records: int) -> None:
    """There must be records, and a column of exactly the name of each placeholder."""
    if not records:
        raise LoomError("PPTX_NO_DATA_ROWS", "There are no records.")
    if missing := [f for f in found.fields if f not in columns]:
        raise LoomError("PPTX_MISSING_EXCEL_COLUMN", f"Columns are missing: {', '.join(missing)}.", {"missingColumns": missing, "availableColumns": list(columns)})


def filled_slide(slide: str, values: dict[str, str]) -> tuple[str, int]:
    """The slide with its shapes' placeholders replaced, and how many. A placeholder may reach over several runs: its value goes where it begins."""
    count = 0

    def shape(m: re.Match) -> str:
        nonlocal count
        runs = list(RUN.finditer(m[0]))
        texts = [decoded(r[2]) for r in runs]
        whole = "".join(texts)
        hits = [h for h in FIELD.finditer(whole) if h[1].strip() in values]
        count += len(hits)
        if not hits:
            return m[0]
        out, at = [], 0
        for text in texts:
            start, end, own, place = at, at + len(text), "", at
            for h in hits:
                if h.start() >= end or h.end() <= start:
                    continue
                own += whole[place : max(place, h.start())]
                if h.start() >= start:
                    own += values[h[1].strip()]
                place = min(end, h.end())
            out.append(own + whole[place:end])
            at = end
        xml, last = "", 0
        for r, text in zip(runs, out, strict=True):
            head = r[1]
            if text != text.strip() and "xml:space" not in head:
                head = head[:-1] + ' xml:space="preserve">'
            xml += m[0][last : r.start()] + head + escape(text) + r[3]
            last = r.end()
        return xml + m[0][last:]

    return SHAPE.sub(shape, slide), count


@dataclass
class Template:
    """A presentation's parts, and the slide that is filled."""

    parts: dict[str, bytes]
    deck: str
    links: str
    targets: dict[str, str]
    chosen: str
    number: int

    @property
    def slide(self) -> str:
        return self.parts[self.chosen].decode()


def template_of(content: bytes, slide_number: int = 1, name: str = "") -> Template:
    if isinstance(slide_number, bool) or slide_number < 1:
        raise LoomError("PPTX_INVALID_TEMPLATE_SLIDE", "The template slide must be a positive integer.", {"templateSlide": slide_number})
    parts = read_parts(content, name, "PPTX_INVALID_TEMPLATE")
    needed = ("ppt/presentation.xml", "ppt/_rels/presentation.xml.rels", "[Content_Types].xml")
    if any(p not in parts for p in needed):
        raise LoomError("PPTX_INVALID_TEMPLATE", f"{name or 'The template'} is not a presentation.", {"template": name})
    if any(b"<!DOCTYPE" in parts[p].replace(b"\0", b"") for p in needed):
        raise LoomError("PPTX_INVALID_TEMPLATE", "Document type declarations are not allowed.", {"template": name})
    deck, links = parts[needed[0]].decode(), parts[needed[1]].decode()
    targets = {}
    for r in re.findall(r"<Relationship [^>]*/>", links):
        if SLIDE_LINK in r:
            target = re.search(r'Target="([^"]*)"', r)[1]
            targets[re.search(r'\bId="([^"]*)"', r)[1]] = target.lstrip("/") if target.startswith("/") else f"ppt/{target}"
    ids = re.findall(r"<p:sldId [^>]*r:id=\"([^\"]*)\"[^>]*/>", deck)
    if slide_number > len(ids) or ids[slide_number - 1] not in targets:
        raise LoomError("PPTX_TEMPLATE_SLIDE_NOT_FOUND", f"There is no slide {slide_number}.", {"slides": len(ids), "templateSlide": slide_number})
    return Template(parts, deck, links, targets, targets[ids[slide_number - 1]], slide_number)


def inspect(content: bytes, slide_number: int = 1, name: str = "") -> Inspection:
    """The placeholders of one slide of a presentation."""
    return inspected(template_of(content, slide_number, name).slide, slide_number)


def populated(template: bytes, records: list[dict[str, str]], slide_number: int = 1, control: Control | None = None, skipped: int = 0) -> tuple[bytes, dict[str, int]]:
    """The presentation with one slide for each record instead of its own slides; the same input gives the same bytes."""
    source = template_of(template, slide_number)
    parts, deck, links = dict(source.parts), source.deck, source.links
    folder, _, name = source.chosen.rpartition("/")
    own_links = parts.get(f"{folder}/_rels/{name}.rels")
    slide = source.slide
    found = inspected(slide, slide_number)
    validated(found)
    fitting(found, list(dict.fromkeys(k for r in records for k in r)), len(records))
    for target in source.targets.values():
        old, _, file = target.rpartition("/")
        parts.pop(target, None)
        parts.pop(f"{old}/_rels/{file}.rels", None)
    links = re.sub(rf'<Relationship [^>]*Type="{re.escape(SLIDE_LINK)}"[^>]*/>', "", links)
    types = re.sub(r'<Override [^>]*PartName="/ppt/slides/[^"]*"[^>]*/>', "", parts["[Content_Types].xml"].decode())
    used = [int(x) for x in re.findall(r'\bId="rId(\d+)"', links)]
    relation, number = max(used, default=0), max((int(x) for x in re.findall(r'<p:sldId [^>]*?\bid="(\d+)"', deck)), default=255)
    new_links, new_types, new_ids = [], [], []
    replaced = 0
    for i, record in enumerate(records, 1):
        (control or Control()).step(POPULATE, "generating-slides", i - 1, len(records))
        xml, n = filled_slide(slide, {k: "" if v is None else str(v) for k, v in record.items()})
        replaced += n
        parts[f"ppt/slides/slide{i}.xml"] = xml.encode()
        if own_links:
            parts[f"ppt/slides/_rels/slide{i}.xml.rels"] = own_links
        new_links.append(f'<Relationship Id="rId{relation + i}" Type="{SLIDE_LINK}" Target="slides/slide{i}.xml"/>')
        new_types.append(f'<Override PartName="/ppt/slides/slide{i}.xml" ContentType="{SLIDE}"/>')
        new_ids.append(f'<p:sldId id="{number + i}" r:id="rId{relation + i}"/>')
    parts["ppt/_rels/presentation.xml.rels"] = links.replace("</Relationships>", "".join(new_links) + "</Relationships>").encode()
    parts["[Content_Types].xml"] = types.replace("</Types>", "".join(new_types) + "</Types>").encode()
    parts["ppt/presentation.xml"] = re.sub(r"<p:sldIdLst>.*?</p:sldIdLst>", f"<p:sldIdLst>{''.join(new_ids)}</p:sldIdLst>", deck, flags=re.S).encode()
    metrics = {"generatedSlides": len(records), "inputFiles": 2, "inputRows": len(records), "outputFiles": 1, "placeholderFields": len(found.fields), "placeholderOccurrences": found.occurrences, "replacements": replaced, "skippedRows": skipped}
    return write_parts(parts), metrics


def records_from(spark: SparkSession | None = None, records: list[dict] | None = None, workbook: str | DataFrame | None = None, worksheet: str | None = None, header_row: int | None = None) -> tuple[list[str], list[dict[str, str]], int]:
    """Columns, rows and skipped empty rows of exactly one source: records, or a workbook's worksheet as it is shown. One slide is made of each, so rows are few."""
    if (records is None) == (workbook is None):
        raise LoomError("PPTX_INVALID_DATA_SOURCE", "Give either records or a workbook.", {"records": records is not None, "workbook": workbook is not None})
    if records is not None:
        return list(dict.fromkeys(k for r in records for k in r)), [dict(r) for r in records], 0
    if isinstance(workbook, str) and not os.path.exists(workbook):
        raise LoomError("XLSX_WORKBOOK_NOT_FOUND", f"{workbook} was not found.", {"workbook": workbook})
    found = worksheet_records(spark, workbook, worksheet, header_row)
    rows = [{c: r[c] for c in found.columns} for r in found.df.orderBy("_at").toLocalIterator()]
    return found.columns, rows, found.skipped


def _checked(template: str, output: str | None) -> bytes:
    if not template.lower().endswith(".pptx"):
        raise LoomError("PPTX_UNSUPPORTED_TEMPLATE_TYPE", f"{template} is not a .pptx presentation.", {"template": template})
    if output is not None:
        if not output.lower().endswith(".pptx"):
            raise LoomError("PPTX_UNSUPPORTED_OUTPUT_TYPE", f"{output} does not end in .pptx.", {"output": output})
        refuse_overwriting_inputs([output], [template])
    try:
        with open(template, "rb") as f:
            return f.read()
    except OSError as error:
        raise LoomError("PPTX_TEMPLATE_NOT_FOUND", f"{template} was not found.", {"template": template}) from error


def plan_populate(spark: SparkSession, template: str, output: str, slide_number: int = 1, **data) -> OperationPlan:
    """What populate() would write; checks template and records, and writes nothing."""
    found = inspect(_checked(template, output), slide_number, template)
    validated(found)
    columns, rows, skipped = records_from(spark, **data)
    fitting(found, columns, len(rows))
    metrics = {"generatedSlides": len(rows), "inputRows": len(rows), "placeholderFields": len(found.fields), "placeholderOccurrences": found.occurrences, "skippedRows": skipped}
    return OperationPlan(POPULATE, (template,), (PlannedOutput(output, os.path.exists(output), PPTX),), _told(skipped), metrics)


def _told(skipped: int) -> tuple[str, ...]:
    return (f"Skipped {skipped} empty row{'' if skipped == 1 else 's'}.",) if skipped else ()


def populate(spark: SparkSession, template: str, output: str, slide_number: int = 1, overwrite: bool = False, control: Control | None = None, **data) -> OperationResult:
    """One slide for each record or row of a workbook, written to output."""
    content = _checked(template, output)
    validated(inspect(content, slide_number, template))
    columns, rows, skipped = records_from(spark, **data)
    made, metrics = populated(content, [{c: r.get(c) for c in columns} for r in rows], slide_number, control, skipped)
    done = commit([(output, made)], overwrite, "PPTX_OUTPUT_NOT_FILE", "PPTX_OUTPUT_ROLLBACK_FAILED")
    return OperationResult(POPULATE, tuple(done), _told(skipped), metrics)
