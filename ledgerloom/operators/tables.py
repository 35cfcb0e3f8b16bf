"""Tables: union by column name with provenance, and grouping by a column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import LoomError
from ..functions.cells import column_key, iso_text, number_text, typed_key

SOURCE_COLUMNS = ("_source_file", "_source_sheet", "_source_row")


@dataclass(frozen=True)
class Table:
    """A DataFrame with the place its rows come from. order: column of the rows' order; its value plus first_row is the source row. name, ref: of an Excel table or a named range."""

    df: DataFrame
    order: str
    file: str | None = None
    sheet: str | None = None
    first_row: int = 2
    name: str | None = None
    ref: str | None = None

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != self.order]


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "number"
    return "date" if isinstance(data_type, (T.DateType, T.TimestampType)) else "string"


def as_text(c: Column, data_type: T.DataType) -> Column:
    kind = kind_of(data_type)
    if kind == "number":
        return number_text(c)
    return iso_text(c) if kind == "date" else F.when(c, "true").when(~c, "false") if kind == "boolean" else c.cast("string")


def _common(types: list[T.DataType]) -> str:
    """One type for a column: the same, else double for numbers, else text."""
    if len({t.simpleString() for t in types}) == 1:
        return types[0].simpleString()
    return "double" if {kind_of(t) for t in types} == {"number"} else "string"


def union_tables(tables: Sequence[Table], add_source: bool = True, names: Sequence[str] = SOURCE_COLUMNS) -> DataFrame:
    """All rows of all tables, with _table and _order for their order.

    Columns meet by name, whatever the case or the space around it; the first spelling names the column, and columns come in the
    order in which they are first seen. Missing values are null. Of columns of one table with one name, the last has the values.
    Provenance columns that clash with others are an error, as is an empty list.
    """
    if not tables:
        raise LoomError("TABLES_EMPTY", "At least one table is required.")
    spelled: dict[str, str] = {}
    for table in tables:
        for c in table.columns:
            spelled.setdefault(column_key(c), c)
    if add_source:
        taken = set(spelled)
        for name in names:
            if column_key(name) in taken:
                raise LoomError("TABLE_SOURCE_COLUMN_COLLISION", f"A column is already called {name}.", {"column": name})
            taken.add(column_key(name))
    places = [{column_key(c): i for i, c in enumerate(t.df.columns) if c != t.order} for t in tables]
    types = {k: _common([t.df.schema[i[k]].dataType for t, i in zip(tables, places, strict=True) if k in i]) for k in spelled}
    parts = []
    for number, (table, place) in enumerate(zip(tables, places, strict=True)):
        plain = table.df.toDF(*[f"_c{i}" for i in range(len(table.df.columns))])  # by place: names may clash
        order = F.col(f"_c{table.df.columns.index(table.order)}")

        def value(k: str, table: Table = table, place: dict = place) -> Column:
            if k not in place:
                return F.lit(None).cast(types[k])
            c, t = F.col(f"_c{place[k]}"), table.df.schema[place[k]].dataType
            return as_text(c, t) if types[k] == "string" and kind_of(t) != "string" else c.cast(types[k])

        columns = [value(k).alias(name) for k, name in spelled.items()]
        if add_source:
            own = (F.lit(table.file).cast("string"), F.lit(table.sheet).cast("string"), (order + table.first_row).cast("long"))
            columns += [c.alias(n) for c, n in zip(own, names, strict=True)]
        parts.append(plain.select(*columns, F.lit(number).alias("_table"), order.cast("long").alias("_order")))
    return reduce(DataFrame.union, parts)


def resolved(df: DataFrame, column: str) -> str:
    for c in df.columns:
        if column_key(c) == column_key(column):
            return c
    raise LoomError("TABLE_COLUMN_NOT_FOUND", f"No column is called {column}.", {"column": column, "available": df.columns})


def keyed(df: DataFrame, column: str) -> DataFrame:
    """df with _key, the typed key of a column; null where it is blank."""
    name = resolved(df, column)
    kind = kind_of(df.schema[name].dataType)
    c = F.col(f"`{name}`")
    return df.withColumn("_key", typed_key(iso_text(c) if kind == "date" else c, "string" if kind == "date" else kind))


def groups_of(df: DataFrame, column: str, order: str, include_blank: bool = True) -> DataFrame:
    """(group_key, group_order, n_rows, first_row) in first-seen order; order: a column whose least value comes first.

    Partial sums meet, not rows, so a group with most of the rows is no burden.
    """
    rows = keyed(df, column)
    if not include_blank:
        rows = rows.filter("_key is not null")
    found = rows.groupBy("_key").agg(F.count("*").alias("n_rows"), F.min(order).alias("first_row"))
    return numbered(found, "first_row", F.col("first_row"), "group_order").select(F.col("_key").alias("group_key"), "group_order", "n_rows", F.col("first_row").cast("long").alias("first_row"))


def grouped_rows(df: DataFrame, column: str, order: str, include_blank: bool = True, first_row: int = 2) -> DataFrame:
    """Rows of df with group_key, group_order and source_row: a group's rows are its table. order is a row number from 0.

    Groups are a table of their own, so a group with most of the rows is no burden where they are few enough to be sent.
    """
    groups = groups_of(df, column, order, include_blank).select("group_key", "group_order")
    groups = F.broadcast(groups) if groups.count() <= SENT else groups
    rows = keyed(df, column).join(groups, F.col("_key").eqNullSafe(F.col("group_key"))).drop("_key")
    return rows.withColumn("source_row", (F.col(order) + first_row).cast("long"))


#: Groups that are sent to every executor, at most.
SENT = 100_000
#: Values of an order that are numbered together.
BLOCK = 1 << 20


def numbered(df: DataFrame, order: str, by: Column, name: str) -> DataFrame:
    """df with a column of numbers from 1 by order; by: a whole number that grows with order.

    Rows are numbered in blocks of by, and a row for each block is summed, so no task sees all rows.
    """
    blocks = df.withColumn("_block", F.floor(by / BLOCK))
    sums = blocks.groupBy("_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_block", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_block").orderBy(order))
    return blocks.withColumn("_within", within).join(sums, "_block").withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_block", "_within", "_before")


def record_columns(entries: DataFrame) -> DataFrame:
    """(column, place) of records given as (record, place, name), record a number: the union of their names in first-seen order."""
    first = entries.groupBy("name").agg(F.min(F.struct("record", "place")).alias("at"))
    return numbered(first, "at", F.col("at.record"), "place").select(F.col("name").alias("column"), "place")
