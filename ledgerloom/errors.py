"""Errors with stable codes."""

from __future__ import annotations

from typing import Any

# The codes that errors may have.
CODES = (
    "FILES_INPUT_OVERWRITE", "FILES_NO_INPUTS", "FILES_NOT_FOUND", "FILES_OUTPUT_EXISTS",
    "TABLE_COLUMN_NOT_FOUND", "TABLE_SOURCE_COLUMN_COLLISION", "TABLES_EMPTY",
    "XLSX_DUPLICATE_HEADER", "XLSX_EMPTY_HEADER", "XLSX_INPUT_NOT_FOUND", "XLSX_INVALID_EXCEL_TABLE", "XLSX_INVALID_HEADER_ROW", "XLSX_INVALID_NAMED_RANGE",
    "XLSX_NO_COLUMNS", "XLSX_NO_INPUTS", "XLSX_NO_SHEETS", "XLSX_NO_TABLES", "XLSX_READ_FAILED", "XLSX_SPLIT_MULTIPLE_TABLES", "XLSX_SPLIT_COLUMN_NOT_FOUND",
    "XLSX_SPLIT_NO_GROUPS", "XLSX_SPLIT_NO_TABLE", "XLSX_SPLIT_OUTPUT_NOT_FILE", "XLSX_SPLIT_PRESERVE_FORMULA", "XLSX_SPLIT_PRESERVE_REQUIRES_TABLE",
    "XLSX_SPLIT_PRESERVE_TABLE_NOT_FOUND", "XLSX_SPLIT_RANGE_HEADER_ROW", "XLSX_SPLIT_ROLLBACK_FAILED", "XLSX_SPLIT_TABLE_HEADER_ROW",
    "XLSX_SPLIT_TABLE_RANGE_CONFLICT", "XLSX_SPLIT_UNSUPPORTED_FILE", "XLSX_WORKBOOK_NOT_FOUND", "XLSX_WORKSHEET_NOT_FOUND",
    "PDF_NO_INPUTS", "PDF_NO_PAGES", "PDF_PAGE_COPY_FAILED", "PDF_READ_FAILED",
    "PPTX_GENERATION_FAILED", "PPTX_INVALID_DATA_SOURCE", "PPTX_INVALID_TEMPLATE", "PPTX_INVALID_TEMPLATE_SLIDE", "PPTX_MALFORMED_PLACEHOLDER",
    "PPTX_MISSING_EXCEL_COLUMN", "PPTX_NO_DATA_ROWS", "PPTX_NO_PLACEHOLDERS", "PPTX_OUTPUT_NOT_FILE", "PPTX_OUTPUT_ROLLBACK_FAILED", "PPTX_TEMPLATE_NOT_FOUND",
    "PPTX_TEMPLATE_SLIDE_NOT_FOUND", "PPTX_UNSUPPORTED_OUTPUT_TYPE", "PPTX_UNSUPPORTED_PLACEHOLDER_PLACEMENT", "PPTX_UNSUPPORTED_SPLIT_RUN_PLACEHOLDER",
    "PPTX_UNSUPPORTED_TEMPLATE_TYPE", "OPERATION_ABORTED",
)


class LoomError(Exception):
    """An expected failure: code is stable, message is for people, details are data."""

    def __init__(self, code: str, message: str, details: dict[str, Any] | None = None):
        super().__init__(message)
        self.code, self.message, self.details = code, message, details or {}
