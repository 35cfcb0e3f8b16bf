"""Plans, results, progress and cancellation of operations that make files."""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import LoomError


@dataclass(frozen=True)
class PlannedOutput:
    path: str
    exists: bool
    media_type: str


@dataclass(frozen=True)
class OperationPlan:
    """What an operation would do; making one writes nothing."""

    operation: str
    inputs: tuple[str, ...]
    outputs: tuple[PlannedOutput, ...]
    warnings: tuple[str, ...] = ()
    metrics: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class OperationResult:
    operation: str
    artifacts: tuple[str, ...]
    warnings: tuple[str, ...] = ()
    metrics: dict[str, int] = field(default_factory=dict)
    outputs: list[dict] = field(default_factory=list)


@dataclass
class Control:
    """Progress reporter (operation, stage, completed, total, detail) and a flag that stops work before its next unit."""

    report: Callable[[str, str, int, int, str], None] | None = None
    aborted: bool = False

    def step(self, operation: str, stage: str, completed: int, total: int, detail: str = "") -> None:
        if self.aborted:
            raise LoomError("OPERATION_ABORTED", f"{operation} was cancelled.", {"stage": stage, "completed": completed})
        if self.report:
            self.report(operation, stage, completed, total, detail)


def _same(path: str) -> str:
    """A path as its file system compares it."""
    return os.path.realpath(path).lower() if sys.platform in ("win32", "darwin") else os.path.realpath(path)


def refuse_overwriting_inputs(outputs: Iterable[str], inputs: Iterable[str]) -> None:
    own = {_same(i) for i in inputs}
    for path in outputs:
        if _same(path) in own:
            raise LoomError("FILES_INPUT_OVERWRITE", f"{path} is also an input.", {"path": path})


def check_outputs(paths: Iterable[str], overwrite: bool = False, directory_code: str = "FILES_OUTPUT_EXISTS") -> None:
    """Nothing is written if an output is a folder, or exists and may not be replaced."""
    for path in paths:
        if os.path.isdir(path):
            raise LoomError(directory_code, f"{path} is a folder.", {"path": path})
        if os.path.exists(path) and not overwrite:
            raise LoomError("FILES_OUTPUT_EXISTS", f"{path} exists.", {"path": path})


def commit(files: Mapping[str, bytes] | Iterable[tuple[str, bytes]], overwrite: bool = False, directory_code: str = "FILES_OUTPUT_EXISTS", rollback_code: str = "XLSX_SPLIT_ROLLBACK_FAILED") -> list[str]:
    """Write all files or none: each is staged as it comes, all are renamed at last; on a failure what was there comes back.

    files may be an iterator, so only one file's content is in memory at a time.
    """
    stages: dict[str, str] = {}
    staged: dict[str, str] = {}
    moved: list[tuple[str, str | None]] = []
    if isinstance(files, Mapping):
        check_outputs(files, overwrite, directory_code)
        files = files.items()
    try:
        for i, (path, content) in enumerate(files):
            check_outputs([path], overwrite, directory_code)
            folder = os.path.dirname(os.path.abspath(path))
            if folder not in stages:
                os.makedirs(folder, exist_ok=True)
                stages[folder] = tempfile.mkdtemp(prefix=".staged-", dir=folder)
            staged[path] = os.path.join(stages[folder], f"{i}.new")
            with open(staged[path], "wb") as out:
                out.write(content)
        try:
            for path, new in staged.items():
                backup = new[:-3] + "old" if os.path.exists(path) else None
                if backup:
                    os.rename(path, backup)
                moved.append((path, backup))
                os.rename(new, path)
        except OSError as error:
            try:
                for path, backup in reversed(moved):
                    if backup:
                        os.replace(backup, path)
                    elif os.path.exists(path):
                        os.remove(path)
            except OSError as second:
                stages.clear()  # what could not be put back stays in the staging folders
                raise LoomError(rollback_code, "Files that were replaced could not be put back.", {"cause": str(second)}) from second
            raise
    finally:
        for folder in stages.values():
            shutil.rmtree(folder, ignore_errors=True)
    return list(staged)


def collisions(planned: DataFrame, taken: DataFrame, any_case: bool = False) -> DataFrame:
    """(path) of planned (path) outputs that are taken (path) already, as inputs or existing files; any_case: on a file system without case."""
    key = F.lower if any_case else F.col
    return planned.select("path").distinct().join(taken.select(key("path").alias("_taken")), key("path") == F.col("_taken"), "left_semi")
