"""What an operation did, in sentences, and what helps when it fails. Interfaces give their own words for what they call things."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import LoomError
from ..plans.control import OperationPlan, OperationResult
from . import templates as columns

# Media types.
MEDIA = {
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "Excel workbook",
    "application/vnd.ms-excel.sheet.macroEnabled.12": "Excel workbook",
    "application/pdf": "PDF document",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "PowerPoint presentation",
}


@dataclass(frozen=True)
class Vocabulary:
    """How an interface calls things."""

    action: str = "task"
    replace_outputs: str = "allow the existing output to be replaced"
    hidden_sheets: str = "include hidden worksheets"
    help: str = "the reference for this task"


GENERIC = Vocabulary()
CLI = replace(GENERIC, action="command", replace_outputs="use --force", hidden_sheets="use --hidden", help="the command with --help")


def artifact_label(media_type: str) -> str:
    return MEDIA.get(media_type, "File")


def artifact_labels(media_type: Column) -> Column:
    """artifact_label() of a column."""
    known = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    return F.coalesce(F.try_element_at(known, media_type), F.lit("File"))


def skipped_rows_text(n: Column) -> Column:
    """skipped_rows() of a column of counts."""
    return F.concat(F.lit("Skipped "), columns.quantity(n, "row", "rows"), F.lit("."))


def quantity(n: int, one: str, many: str | None = None) -> str:
    return f"{n:,} {one if n == 1 else many or one + 's'}"


def skipped_rows(n: int, column: str | None = None) -> str:
    where = f' with blank values in "{column}"' if column else ""
    return f"Skipped {quantity(n, 'row')}{where}."


def _summary(result: OperationResult | OperationPlan) -> list[str]:
    m = lambda name: result.metrics.get(name, 0)
    lines = {
        "sheets.consolidate": lambda: [f"{quantity(m('inputTables'), 'worksheet')} of {quantity(m('inputFiles'), 'workbook')} became {quantity(m('outputRows'), 'row')} in {quantity(m('outputColumns'), 'column')}."],
        "sheets.merge": lambda: [f"{quantity(m('outputSheets'), 'worksheet')} of {quantity(m('inputFiles'), 'workbook')} are in one workbook; {m('hiddenSheets'):,} of them hidden."],
        "sheets.split-by-column": lambda: [
            f"{quantity(m('inputRows'), 'row')} in {quantity(m('groups'), 'group')} became {quantity(m('outputFiles'), 'workbook')}.",
            f"{quantity(m('outputRows'), 'row')} kept, {quantity(m('skippedRows'), 'row')} skipped; {quantity(m('sheetsFiltered'), 'worksheet')} divided, {m('sheetsCopiedUnchanged'):,} copied as they were.",
        ],
        "pdf.split": lambda: [f"{quantity(m('pages'), 'page')} became {quantity(m('outputFiles'), 'document')}."],
        "pdf.merge": lambda: [f"{quantity(m('inputFiles'), 'document')} became one of {quantity(m('pages'), 'page')}."],
        "pptx.populate": lambda: [f"{quantity(m('inputRows'), 'record')} became {quantity(m('generatedSlides'), 'slide')} with {quantity(m('replacements'), 'replacement')}."],
    }
    return lines.get(result.operation, lambda: [f"{result.operation} is complete."])()


def told(result: OperationResult | OperationPlan, words: Vocabulary = GENERIC) -> str:
    """A result or plan in sentences: what happened, what was made, warnings, counts."""
    planned = isinstance(result, OperationPlan)
    lines = [f"The {words.action} would do this; nothing was written." if planned else "Done. The inputs were not changed.", *_summary(result)]
    files = [o.path + (" (exists)" if o.exists else "") for o in result.outputs] if planned else list(result.artifacts)
    lines += ["", "Files:", *(f"  {f}" for f in files)]
    if result.warnings:
        lines += ["", "Warnings:", *(f"  {w}" for w in result.warnings)]
    lines += ["", "Counts:", *(f"  {k}: {v:,}" for k, v in sorted(result.metrics.items()))]
    return "\n".join(lines) + "\n"


#: What helps, by the beginning of an error's code; the longest that fits counts.
HELP = {
    "FILES_NO_INPUTS": "Check the folders and patterns given, and put patterns in quotation marks.",
    "FILES_NOT_FOUND": "Check the path.",
    "FILES_OUTPUT_EXISTS": "Choose another output, or {replace_outputs} if it may go.",
    "FILES_INPUT_OVERWRITE": "Choose another output: inputs are never overwritten.",
    "TABLE_COLUMN_NOT_FOUND": "Check the column's name against the header row.",
    "TABLE_SOURCE_COLUMN_COLLISION": "Leave the source columns out or name them otherwise.",
    "XLSX_NO_TABLES": "Check that the worksheets have a header row and data; if they are hidden, {hidden_sheets}.",
    "XLSX_SPLIT_MULTIPLE_TABLES": "Name the worksheet, Excel table or named range to divide.",
    "XLSX_SPLIT_NO_TABLE": "Check the name; if the worksheet is hidden, {hidden_sheets}.",
    "XLSX_SPLIT_COLUMN_NOT_FOUND": "Check the column's name, or give the row of the headers.",
    "XLSX_SPLIT_PRESERVE_FORMULA": "Use structured references in the formula, or divide without keeping the workbook.",
    "XLSX_SPLIT_": "See {help} for what can be combined.",
    "XLSX_READ_FAILED": "Check that the file is a workbook without a password.",
    "XLSX_": "Check the workbook; see {help} for what is expected.",
    "PDF_": "Check that the file is a PDF without a password.",
    "PPTX_MALFORMED_PLACEHOLDER": "Write placeholders as {{{{name}}}}, and look for single braces.",
    "PPTX_MISSING_EXCEL_COLUMN": "Name a column exactly as the placeholder, upper and lower case included.",
    "PPTX_": "Inspect the template's placeholders first; see {help}.",
    "OPERATION_ABORTED": "Start the {action} again when you are ready.",
}


def recovery(error: LoomError, words: Vocabulary = GENERIC) -> str:
    """A sentence that says what to do about an error."""
    fits = [k for k in HELP if error.code.startswith(k)]
    return HELP[max(fits, key=len)].format(**vars(words)) if fits else f"See {words.help}."
