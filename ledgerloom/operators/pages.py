"""Pages: names and order over a catalogue (file_order, file, pages), and PDF documents split into pages and merged."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import LoomError
from ..functions.names import safe_name, without_extension
from ..functions.templates import page_name
from ..plans.control import Control, OperationPlan, OperationResult, PlannedOutput, check_outputs, commit, refuse_overwriting_inputs
from ..sources.pdf import Pdf, document, parse_pdf

SPLIT, MERGE = "pdf.split", "pdf.merge"
PDF = "application/pdf"


def split_pages(files: DataFrame) -> DataFrame:
    """(file, page, name) of every page."""
    rows = files.filter("pages > 0").select("file", "pages", F.explode(F.sequence(F.lit(1), F.col("pages").cast("int"))).alias("page"))
    return rows.select("file", F.col("page").cast("long").alias("page"), page_name(without_extension(F.col("file"), "pdf"), F.col("page"), F.col("pages")).alias("name"))


def merged_pages(files: DataFrame, block: int = 4096) -> DataFrame:
    """(file, page, merged_page): pages in the files' order (file_order, a whole number). Running sums are over blocks of files and in them, so no task sees all."""
    blocks = files.withColumn("_block", F.floor(F.col("file_order") / block))
    sums = blocks.groupBy("_block").agg(F.sum("pages").alias("_n"))
    sums = sums.select("_block", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("pages").over(Window.partitionBy("_block").orderBy("file_order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = blocks.withColumn("_within", within).join(sums, "_block").filter("pages > 0")
    rows = rows.select("file", (F.col("_before") + F.col("_within")).alias("before"), F.explode(F.sequence(F.lit(1), F.col("pages").cast("int"))).alias("page"))
    return rows.select("file", F.col("page").cast("long").alias("page"), (F.col("before") + F.col("page")).cast("long").alias("merged_page"))


def page_catalogue(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, pages, code) of each PDF under paths: its number of pages, or the error's code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows.append((path, len(parse_pdf(content, path).pages), None))
                except LoomError as error:
                    rows.append((path, 0, error.code))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], ["file", "pages", "code"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select("path", "content").mapInArrow(run, "file string, pages long, code string")


def page_counts(files: DataFrame) -> DataFrame:
    """(files, pages) in all."""
    return files.agg(F.count("*").alias("files"), F.sum("pages").alias("pages"))


def _read(path: str) -> Pdf:
    try:
        with open(path, "rb") as f:
            return parse_pdf(f.read(), path)
    except OSError as error:
        raise LoomError("PDF_READ_FAILED", f"Could not read PDF: {path}", {"source": path}) from error


def page_names(prefix: str, pages: int) -> list[str]:
    width = max(3, len(str(pages)))
    return [f"{prefix}-page-{n:0{width}d}.pdf" for n in range(1, pages + 1)]


def _split(path: str, folder: str, prefix: str | None) -> tuple[Pdf, list[str]]:
    pdf = _read(path)
    if not pdf.pages:
        raise LoomError("PDF_NO_PAGES", f"{path} has no pages.", {"source": path})
    stem = re.sub(r"(?i)\.pdf$", "", os.path.basename(path)) if prefix is None else prefix
    outputs = [os.path.join(folder, n) for n in page_names(stem, len(pdf.pages))]
    refuse_overwriting_inputs(outputs, [path])
    return pdf, outputs


def _plan(operation: str, inputs: list[str], outputs: list[str], metrics: dict[str, int]) -> OperationPlan:
    return OperationPlan(operation, tuple(inputs), tuple(PlannedOutput(o, os.path.exists(o), PDF) for o in outputs), metrics=metrics | {"inputFiles": len(inputs), "outputFiles": len(outputs)})


def plan_split_pdf(path: str, folder: str, prefix: str | None = None) -> OperationPlan:
    pdf, outputs = _split(path, folder, prefix)
    return _plan(SPLIT, [path], outputs, {"pages": len(pdf.pages)})


def split_pdf(path: str, folder: str, prefix: str | None = None, overwrite: bool = False, control: Control | None = None) -> OperationResult:
    """A document for each page. One document's pages are one machine's work; many documents are a DataFrame, see split_documents()."""
    pdf, outputs = _split(path, folder, prefix)
    check_outputs(outputs, overwrite)

    def files() -> Iterator[tuple[str, bytes]]:
        for i, output in enumerate(outputs):
            (control or Control()).step(SPLIT, "writing-pages", i, len(outputs), output)
            yield output, document([(pdf, i)])

    return OperationResult(SPLIT, tuple(commit(files(), overwrite)), metrics={"inputFiles": 1, "outputFiles": len(outputs), "pages": len(outputs)})


def split_documents(files: DataFrame) -> DataFrame:
    """(path, page, name, content) of every page of files (path, content), on the executors; names are made safe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pdf = parse_pdf(content, path)
                names = page_names(safe_name(re.sub(r"(?i)\.pdf$", "", os.path.basename(path)), "document"), len(pdf.pages))
                for i, name in enumerate(names):  # one page at a time: a document's pages together may be many times its size
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([i + 1]), pa.array([name]), pa.array([document([(pdf, i)])], pa.binary())], ["path", "page", "name", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, page long, name string, content binary")


def _merge(paths: list[str], output: str) -> None:
    if not paths:
        raise LoomError("PDF_NO_INPUTS", "At least one PDF is needed.")
    refuse_overwriting_inputs([output], paths)


def plan_merge_pdfs(paths: list[str], output: str) -> OperationPlan:
    _merge(paths, output)
    return _plan(MERGE, paths, [output], {})


def merge_pdfs(paths: list[str], output: str, overwrite: bool = False, control: Control | None = None) -> OperationResult:
    """All pages of all documents in order, as one document."""
    _merge(paths, output)
    check_outputs([output], overwrite)
    pages: list[tuple[Pdf, int]] = []
    for i, path in enumerate(paths):
        (control or Control()).step(MERGE, "merging-inputs", i, len(paths), path)
        pdf = _read(path)
        pages += [(pdf, n) for n in range(len(pdf.pages))]
    done = commit([(output, document(pages))], overwrite)
    return OperationResult(MERGE, tuple(done), metrics={"inputFiles": len(paths), "outputFiles": 1, "pages": len(pages)})


def split_pdf_bytes(name: str, content: bytes, prefix: str | None = None) -> list[tuple[str, bytes]]:
    """(file name, content) of each page of a document in memory; the names' beginning is made safe."""
    pdf = parse_pdf(content, name)
    if not pdf.pages:
        raise LoomError("PDF_NO_PAGES", f"{name} has no pages.", {"source": name})
    stem = safe_name(re.sub(r"(?i)\.pdf$", "", name) if prefix is None else prefix, "document")
    return [(n, document([(pdf, i)])) for i, n in enumerate(page_names(stem, len(pdf.pages)))]


def merge_pdfs_bytes(contents: list[tuple[str, bytes]]) -> bytes:
    """All pages of documents (name, content) in memory, in order."""
    if not contents:
        raise LoomError("PDF_NO_INPUTS", "At least one PDF is needed.")
    parsed = [parse_pdf(content, name) for name, content in contents]
    return document([(pdf, i) for pdf in parsed for i in range(len(pdf.pages))])
