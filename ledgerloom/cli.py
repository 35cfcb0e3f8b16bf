"""Command line: python -m ledgerloom.cli {sheets,pptx,pdf} ...; with --json one line of JSON on standard output."""

from __future__ import annotations

import argparse
import dataclasses
import json
import os
import sys

from pyspark.sql import SparkSession

from .errors import LoomError
from .functions.messages import CLI, recovery, told
from .operators import pages, slides, splits, workbooks
from .plans.control import Control
from .sources.discover import discover_files


class _Usage(Exception):
    pass


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        raise _Usage(message)


def _whole(text: str) -> int:
    if not text.isdigit() or int(text) < 1:
        raise argparse.ArgumentTypeError("must be a positive whole number")
    return int(text)


def parser() -> argparse.ArgumentParser:
    top = _Parser(prog="ledgerloom", description="Combine, divide and reuse business tables.")
    groups = top.add_subparsers(dest="group", required=True, parser_class=_Parser)

    def command(group: argparse._SubParsersAction, name: str, run, help: str) -> argparse.ArgumentParser:
        c = group.add_parser(name, help=help)
        c.set_defaults(run=run)
        c.add_argument("--json", action="store_true", help="one line of JSON instead of sentences")
        return c

    sheets = groups.add_parser("sheets").add_subparsers(dest="command", required=True, parser_class=_Parser)
    merge = command(sheets, "merge", _merge, "put all worksheets of workbooks into one")
    consolidate = command(sheets, "consolidate", _consolidate, "put the rows of all worksheets into one table")
    split = command(sheets, "split", _split, "divide a workbook by the values of a column")
    pptx = groups.add_parser("pptx").add_subparsers(dest="command", required=True, parser_class=_Parser)
    inspect = command(pptx, "inspect-template", _inspect, "show the placeholders of a slide")
    populate = command(pptx, "populate", _populate, "make a slide for each row of a workbook")
    pdf = groups.add_parser("pdf").add_subparsers(dest="command", required=True, parser_class=_Parser)
    split_pdf = command(pdf, "split", _split_pdf, "divide a PDF into its pages")
    merge_pdf = command(pdf, "merge", _merge_pdf, "put PDFs into one")

    for c in (merge, consolidate, merge_pdf):
        c.add_argument("inputs", nargs="+", help="files, folders or patterns")
        c.add_argument("-o", "--output", required=True)
    for c in (split, split_pdf):
        c.add_argument("input")
        c.add_argument("-o", "--output-dir")
        c.add_argument("--prefix", help="beginning of the files' names")
    for c in (merge, consolidate, split, populate, split_pdf, merge_pdf):
        c.add_argument("--force", action="store_true", help="replace outputs that exist")
    for c in (consolidate, split, split_pdf, merge_pdf, populate):
        c.add_argument("--dry-run", action="store_true", help="show what would be written")
    for c in (merge, consolidate, split):
        c.add_argument("--values", action="store_true", help="values instead of formulas")
    for c in (consolidate, split, populate):
        c.add_argument("--header-row", type=_whole)
    for c in (consolidate, split):
        c.add_argument("--hidden", action="store_true", help="hidden worksheets too")
    merge.add_argument("--no-index", action="store_true", help="without the index sheet")
    consolidate.add_argument("--sheet", action="append", help="worksheet to read; all if not given")
    consolidate.add_argument("--output-sheet", default="Consolidated")
    consolidate.add_argument("--no-source-columns", action="store_true")
    split.add_argument("-c", "--column", required=True)
    split.add_argument("--sheet")
    split.add_argument("--table", help="Excel table")
    split.add_argument("--range", help="named range")
    split.add_argument("--strict", action="store_true", help="keep case, spaces and numbers in text apart")
    split.add_argument("--skip-blank", action="store_true")
    split.add_argument("--preserve-workbook", action=argparse.BooleanOptionalAction, default=None)
    inspect.add_argument("template")
    populate.add_argument("--template", required=True)
    populate.add_argument("--data", required=True)
    populate.add_argument("--worksheet")
    populate.add_argument("-o", "--output", required=True)
    for c in (inspect, populate):
        c.add_argument("--slide", type=_whole, default=1)
    return top


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("ledgerloom").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _files(a: argparse.Namespace, *extensions: str) -> list[str]:
    return discover_files(a.inputs, extensions=extensions)


def _merge(a: argparse.Namespace, control: Control):
    contents = []
    for path in _files(a, "xlsx"):
        with open(path, "rb") as f:
            contents.append((path, f.read()))
    return workbooks.merge_workbooks(contents, a.output, not a.no_index, a.force, a.values, control)


def _consolidate(a: argparse.Namespace, control: Control):
    paths = _files(a, "xlsx")
    if a.dry_run:
        return workbooks.plan_consolidate(paths, a.output, control)
    return workbooks.consolidate_workbooks(_session(), paths, a.output, a.output_sheet, a.force, control, add_source=not a.no_source_columns, sheets=a.sheet, include_hidden=a.hidden, header_row=a.header_row)


def _split(a: argparse.Namespace, control: Control):
    folder = a.output_dir or os.path.splitext(a.input)[0] + "-split"
    options = splits.Options(a.column, a.table, a.range, a.sheet, a.header_row, a.prefix, not a.skip_blank, a.hidden, a.preserve_workbook, a.strict, a.values)
    return splits.plan_split(_session(), a.input, folder, options) if a.dry_run else splits.split_workbook(_session(), a.input, folder, options, a.force, control)


def _inspect(a: argparse.Namespace, control: Control):
    return slides.inspect(slides._checked(a.template, None), a.slide, a.template)


def _populate(a: argparse.Namespace, control: Control):
    data = {"workbook": a.data, "worksheet": a.worksheet, "header_row": a.header_row}
    if a.dry_run:
        return slides.plan_populate(_session(), a.template, a.output, a.slide, **data)
    return slides.populate(_session(), a.template, a.output, a.slide, a.force, control, **data)


def _split_pdf(a: argparse.Namespace, control: Control):
    folder = a.output_dir or os.path.splitext(a.input)[0] + "-pages"
    return pages.plan_split_pdf(a.input, folder, a.prefix) if a.dry_run else pages.split_pdf(a.input, folder, a.prefix, a.force, control)


def _merge_pdf(a: argparse.Namespace, control: Control):
    paths = _files(a, "pdf")
    return pages.plan_merge_pdfs(paths, a.output) if a.dry_run else pages.merge_pdfs(paths, a.output, a.force, control)


def main(argv: list[str] | None = None) -> int:
    """0 if the command did its work, else 1. With --json, success and failure are one line each: {"ok": ...}."""
    argv = sys.argv[1:] if argv is None else argv
    as_json = "--json" in argv

    def failed(message: str, code: str | None, help: str = "") -> int:
        if as_json:
            line = json.dumps({"ok": False, "error": {"message": message, "code": code}}) + "\n"
            sys.stdout.write(line)
        else:
            line = f"{message}\n{help}\n" if help else f"{message}\n"
        sys.stderr.write(line)
        return 1

    try:
        a = parser().parse_args(argv)
        result = a.run(a, Control())
    except _Usage as error:
        return failed(str(error), "CLI_USAGE")
    except LoomError as error:
        return failed(str(error), error.code, recovery(error, CLI))
    except Exception as error:  # whatever else goes wrong is told without a code
        return failed(str(error), None)
    if as_json:
        sys.stdout.write(json.dumps({"ok": True, "result": dataclasses.asdict(result)}, default=str) + "\n")
    elif isinstance(result, slides.Inspection):
        sys.stdout.write("".join(f"{name}: {n:,}\n" for name, n in result.fields.items()) + f"unfinished: {result.malformed:,}\noutside of text shapes: {', '.join(result.elsewhere) or 'none'}\n")
    else:
        sys.stdout.write(told(result, CLI))
    return 0


if __name__ == "__main__":
    sys.exit(main())
