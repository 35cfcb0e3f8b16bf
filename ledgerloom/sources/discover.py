"""Input files from paths, folders and patterns."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import LoomError


def normalized_extensions(extensions: Iterable[str]) -> set[str]:
    return {"." + e.strip().lower().removeprefix(".") for e in extensions}


def portable(pattern: str, windows: bool = os.name == "nt") -> str:
    """A pattern with forward slashes where backslashes separate folders."""
    return pattern.replace("\\", "/") if windows else pattern


def discover_files(inputs: Iterable[str], cwd: str | None = None, extensions: Iterable[str] | None = None) -> list[str]:
    """Absolute paths of all files, once each and sorted; folders are searched to the end. Nothing found is an error."""
    cwd, found = cwd or os.getcwd(), set()
    for given in inputs:
        path = os.path.join(cwd, given)
        if os.path.isfile(path):
            found.add(os.path.abspath(path))
        elif os.path.isdir(path):
            found.update(os.path.abspath(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)
        else:
            matches = [m for m in glob.glob(portable(path), recursive=True) if os.path.isfile(m)]
            if not matches and not glob.has_magic(path):
                raise LoomError("FILES_NOT_FOUND", f"{given} does not exist.", {"input": given})
            found.update(map(os.path.abspath, matches))
    if extensions is not None:
        wanted = normalized_extensions(extensions)
        found = {f for f in found if os.path.splitext(f)[1].lower() in wanted}
    if not found:
        raise LoomError("FILES_NO_INPUTS", "No input files were found.")
    return sorted(found, key=lambda f: (f.lower(), f))


def distinct_paths(files: DataFrame, extensions: Iterable[str] | None = None) -> DataFrame:
    """(path) of files (path), once each, with one of the extensions whatever its case."""
    if extensions is not None:
        files = files.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*normalized_extensions(extensions)))
    return files.select("path").distinct()
