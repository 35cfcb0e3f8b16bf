"""File names that are fit for every file system."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 80
# Characters and device names that Windows reserves.
UNSAFE = r'[<>:"/\\|?*]+'
RESERVED = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"


def truncated(text: str, most: int) -> str:
    """The longest head of whole characters that has at most so many bytes in UTF-8."""
    return text.encode("utf-8", "surrogatepass")[:most].decode("utf-8", "ignore")


def truncated_column(c: Column, most: int) -> Column:
    """truncated() of a column in built-in functions. No character has more than four bytes, so only heads from a quarter of that many characters on are tried."""
    heads = F.filter(F.sequence(F.lit(most // 4), F.lit(most)), lambda n: F.octet_length(F.substring(c, F.lit(1), n)) <= most)
    return F.substring(c, F.lit(1), F.array_max(heads))


def _fragment(value: str) -> str:
    value = "".join(c for c in unicodedata.normalize("NFKC", value) if ord(c) >= 32 and ord(c) != 127)
    for pattern, by in ((UNSAFE, "-"), (r"\s+", " "), ("-+", "-")):
        value = re.sub(pattern, by, value)
    return truncated(value.strip().rstrip(". "), LIMIT).rstrip(". ")


def safe_name(value: str, fallback: str = "file") -> str:
    name = _fragment(value) or _fragment(fallback) or "file"
    return f"_{name}" if re.match(RESERVED, name) else name


def safe_name_ascii(c: Column, fallback: str = "file") -> Column:
    """safe_name() of ASCII text in built-in functions."""
    c = F.regexp_replace(c, r"[\x00-\x1f\x7f]", "")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, UNSAFE, "-"), r"\s+", " "), "-+", "-")
    c = F.regexp_replace(F.substring(F.regexp_replace(F.trim(c), "[. ]+$", ""), 1, LIMIT), "[. ]+$", "")
    c = F.when(c == "", F.lit(safe_name(fallback))).otherwise(c)
    return F.when(c.rlike(RESERVED), F.concat(F.lit("_"), c)).otherwise(c)


def safe_name_column(c: Column, fallback: str = "file") -> Column:
    """safe_name() of any text: built-in functions for ASCII, an Arrow function for the rest."""

    @F.pandas_udf("string")
    def wide(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else safe_name(v, fallback))

    plain = c.rlike(r"^[\x00-\x7f]*$")
    return F.when(c.isNull(), F.lit(None)).when(plain, safe_name_ascii(c, fallback)).otherwise(wide(F.when(~plain, c)))


def without_extension(c: Column, extension: str) -> Column:
    return F.regexp_replace(c, rf"(?i)\.{extension}$", "")


def output_names(values: Iterable[str | None], prefix: str = "", extension: str = "xlsx") -> list[str]:
    """A file name for each group value in order; a name that is taken (whatever its case) gets -2, -3 and so on. prefix: a safe name."""
    used: set[str] = set()
    out = []
    for value in values:
        part = "blank" if value is None else safe_name(value, "value")
        base = name = f"{prefix}-{part}" if prefix else part
        n = 1
        while name.lower() in used:
            n += 1
            name = f"{base}-{n}"
        used.add(name.lower())
        out.append(f"{name}.{extension}")
    return out


def sheet_names(names: Iterable[str], reserved: Iterable[str] = ()) -> list[str]:
    """Worksheet names of at most 31 characters; one that is taken (whatever its case) gets (2), (3) and so on, shortened to fit."""
    used = {r.lower() for r in reserved}
    out = []
    for original in names:
        base = name = (original or "Sheet")[:31]
        n = 1
        while name.lower() in used:
            n += 1
            name = base[: 31 - len(f" ({n})")] + f" ({n})"
        used.add(name.lower())
        out.append(name)
    return out
