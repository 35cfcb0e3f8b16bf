"""Cell values, keys and headers: plain functions for the driver, Column expressions for the data."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The white space that is trimmed, all of Unicode's, and the form of text that is a number.
SPACE = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
NUMBER = r"(?i)^[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?$"


def column_key(name: str) -> str:
    """Columns are the same if their names are, but for case and space around them."""
    return name.strip().lower()


def unique_headers(values: Iterable[str | None]) -> list[str]:
    """Column names of a header row: blanks become column_N, and the n-th of equal names gets _n. A made-up name isn't checked again."""
    seen: dict[str, int] = {}
    out = []
    for place, value in enumerate(values, 1):
        name = (value or "").strip() or f"column_{place}"
        n = seen[column_key(name)] = seen.get(column_key(name), 0) + 1
        out.append(name if n == 1 else f"{name}_{n}")
    return out


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


@F.pandas_udf(StringType())
def _compatible(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def compatible(c: Column) -> Column:
    """NFKC of a text; ASCII text, which that leaves as it is, stays in built-in functions."""
    plain = is_ascii(c)
    return F.when(c.isNull() | plain, c).otherwise(_compatible(F.when(~plain, c)))


def header_text(name: str) -> str:
    """A header as it is looked for: compatible characters, trimmed, without case."""
    return unicodedata.normalize("NFKC", name).strip(SPACE).lower()


def key_of(c: Column) -> Column:
    return F.lower(trimmed(c))


def is_blank(c: Column) -> Column:
    """Null, or text of white space only."""
    return c.isNull() | (trimmed(c) == "")


def number_text(c: Column) -> Column:
    """Shortest decimal text of a double: 1 and not 1.0, 0 and not -0. Exponents are left as Spark writes them from 1e15 on."""
    c = c.cast("double")
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("decimal(20,0)").cast("string")).otherwise(c.cast("string"))


def iso_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def typed_key(c: Column, kind: str) -> Column:
    """Group key that keeps types apart: kind is string, number or boolean. Blank text and nulls have a null key."""
    text = {"string": c, "number": number_text(c), "boolean": F.when(c, "true").otherwise("false")}[kind]
    blank = is_blank(c) if kind == "string" else c.isNull()
    return F.when(~blank, F.concat(F.lit(f"{kind}:"), text))


def is_ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7f]*$")


def split_key(text: Column, strict: bool = False, kind: Column | None = None, normal: Callable[[Column], Column] = compatible, bare: Column | None = None) -> Column:
    """Key of a cell for splitting: numbers by value, booleans, dates, and other text trimmed, in compatible characters and without case.

    bare: the text trimmed, if it is at hand. Text that is a number counts as one. In strict mode text is kept as it is, apart from numbers and booleans. kind: the cell's
    (string, number, boolean, date, error), text if not given. Blank text has a null key. normal: makes characters compatible.
    """
    bare = trimmed(text) if bare is None else bare
    whole = F.when(bare != "", F.concat(F.lit("string:"), text))
    if not strict:
        number = F.when(bare.rlike(NUMBER), bare.try_cast("double"))
        number = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
        whole = F.when(bare != "", F.coalesce(F.concat(F.lit("number:"), number_text(number)), F.concat(F.lit("string:"), F.lower(normal(bare)))))
    if kind is None:
        return whole
    number = text.try_cast("double")
    return F.when(kind == "number", F.concat(F.lit("number:"), number_text(number))).when(kind.isin("boolean", "date"), F.concat(kind, F.lit(":"), text)).otherwise(whole)


def with_split_key(df: DataFrame, name: str, text: str, strict: bool = False) -> DataFrame:
    """df with split_key() of a text column. Only rows whose text isn't ASCII go through Python; they are read apart from the others, so df should be cheap to read."""
    if strict:
        return df.withColumn(name, split_key(F.col(text), True))
    wide, bare = ~F.coalesce(is_ascii(F.col(text)), F.lit(True)), F.col("_bare")
    rows = df.withColumn("_bare", trimmed(F.col(text)))
    plain = rows.filter(~wide).withColumn(name, split_key(F.col(text), normal=lambda c: c, bare=bare))
    return plain.union(rows.filter(wide).withColumn(name, split_key(F.col(text), bare=bare))).drop("_bare")


def display_text(c: Column, kind: str) -> Column:
    """What a cell shows: TRUE and FALSE, ISO dates, plain numbers, and nothing for nulls."""
    shown = {"string": c, "number": number_text(c), "date": iso_text(c), "boolean": F.when(c, "TRUE").when(~c, "FALSE")}[kind]
    return F.coalesce(shown, F.lit(""))


def column_number(letters: Column) -> Column:
    """1 for A, 27 for AA."""
    each = F.filter(F.split(F.upper(letters), ""), lambda x: x != "")
    return F.aggregate(each, F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64)


def visibility_label(c: Column) -> Column:
    return F.when(c == 0, "Visible").when(c == 1, "Hidden").otherwise("Very hidden")
