"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import cells as C
from .functions import messages as M
from .functions import names as N
from .functions import templates as P
from .operators import pages as G
from .operators import sheets as S
from .operators import workbooks as W
from .operators.splits import Options, split_rows
from .operators.tables import Table, grouped_rows, groups_of, record_columns, union_tables
from .plans.control import collisions
from .sources.discover import distinct_paths
from .sources.xlsx import workbook_bytes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _parties(spark: SparkSession, d: str) -> list[Table]:
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("_at"), F.col("c_name").alias("Name"), F.col("c_acctbal").alias("Balance"), F.col("c_nationkey").alias("Nation"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("_at"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias(" name "), F.col("s_acctbal").alias("BALANCE"), F.lit("yes").alias("Supplies"))
    return [Table(c, "_at", "customers.xlsx", "People", 4), Table(s, "_at", "suppliers.xlsx", "Firms", 7)]


_PARTIES = """SELECT c_name AS "Name", c_acctbal AS "Balance", c_nationkey AS "Nation", CAST(NULL AS VARCHAR) AS "Supplies", 'customers.xlsx' AS f, 'People' AS s, c_custkey + 4 AS r FROM customer
UNION ALL SELECT s_name, s_acctbal, s_nationkey, 'yes', 'suppliers.xlsx', 'Firms', s_suppkey + 7 FROM supplier"""


@query(f'SELECT "Name", "Balance", "Nation", "Supplies", f AS _source_file, s AS _source_sheet, r AS _source_row FROM ({_PARTIES})')
def union_by_name(spark, d):
    return union_tables(_parties(spark, d)).drop("_table", "_order")


@query(f'SELECT "Name", "Balance", "Nation", "Supplies" FROM ({_PARTIES})')
def union_no_source(spark, d):
    return union_tables(_parties(spark, d), add_source=False).drop("_table", "_order")


@query(f'SELECT "Name", "Balance", "Nation", "Supplies", f AS book, s AS page, r AS line FROM ({_PARTIES})')
def union_source_renamed(spark, d):
    return union_tables(_parties(spark, d), names=("book", "page", "line")).drop("_table", "_order")


@query("""SELECT key, amount, f AS _source_file, CAST(NULL AS VARCHAR) AS _source_sheet, r AS _source_row FROM (
SELECT CAST(c_custkey AS VARCHAR) AS key, c_acctbal AS amount, 'a' AS f, c_custkey + 2 AS r FROM customer
UNION ALL SELECT event_type, CAST(value AS DOUBLE), 'b', event_id + 2 FROM events
UNION ALL SELECT p_name, CAST(p_size AS DOUBLE), 'c', p_partkey + 2 FROM part)""")
def union_mixed_types(spark, d):
    """Three sources; the key is a number in one and text in the others, so it becomes text; sizes become doubles."""
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("_at"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount"))
    b = read(spark, d, "events").select(F.col("event_id").alias("_at"), F.col("value").alias("Amount"), F.col("event_type").alias("KEY"))
    c = read(spark, d, "part").select(F.col("p_partkey").alias("_at"), F.col("p_name").alias("Key "), F.col("p_size").alias("amount"))
    return union_tables([Table(t, "_at", n) for t, n in ((a, "a"), (b, "b"), (c, "c"))]).drop("_table", "_order")


@query(f'SELECT "Nation" AS nation, count(*) AS n_rows, count(DISTINCT f) AS sources, min(r) AS first_row FROM ({_PARTIES}) GROUP BY 1')
def consolidated_groups(spark, d):
    rows = union_tables(_parties(spark, d))
    return rows.groupBy(F.col("Nation").alias("nation")).agg(F.count("*").alias("n_rows"), F.count_distinct("_source_file").alias("sources"), F.min("_source_row").alias("first_row"))


@query(f"""SELECT CAST(count(DISTINCT f) AS BIGINT) AS input_files, CAST(count(DISTINCT f || s) AS BIGINT) AS input_tables, count(*) AS output_rows, (SELECT count(*) FROM (DESCRIBE {_PARTIES})) AS output_columns FROM ({_PARTIES})""")
def consolidation_metrics(spark, d):
    rows = union_tables(_parties(spark, d))
    return rows.agg(F.count_distinct("_source_file").alias("input_files"), F.count_distinct(F.concat("_source_file", "_source_sheet")).alias("input_tables"), F.count("*").alias("output_rows"), F.lit(len(rows.columns) - 2).cast("long").alias("output_columns"))


_BLANKED = "CASE WHEN event_id % 7 = 0 THEN '  ' WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 5 = 0 THEN upper(event_type) ELSE event_type END"


def _blanked(spark, d):
    return read(spark, d, "events").withColumn("kind", F.expr(_BLANKED))


def _groups_sql(source: str, blank: str = "") -> str:
    return f"""SELECT k AS group_key, row_number() OVER (ORDER BY min(o)) AS group_order, count(*) AS n_rows, min(o) AS first_row FROM ({source}) {blank} GROUP BY k"""


_BY_KIND = f"SELECT CASE WHEN trim({_BLANKED}) <> '' THEN 'string:' || ({_BLANKED}) END AS k, event_id AS o FROM events"


@query(_groups_sql(_BY_KIND))
def group_blank_value(spark, d):
    return groups_of(_blanked(spark, d), " KIND ", "event_id")


@query(_groups_sql(_BY_KIND, "WHERE k IS NOT NULL"))
def group_skip_blank(spark, d):
    return groups_of(_blanked(spark, d), "kind", "event_id", include_blank=False)


@query(f"""WITH k AS ({_BY_KIND}), g AS ({_groups_sql('SELECT * FROM k')}) SELECT o AS event_id, group_key, group_order, o + 2 AS source_row FROM k JOIN g ON k IS NOT DISTINCT FROM group_key""")
def group_tables(spark, d):
    """The rows of each group's table, in which they know their source rows."""
    return grouped_rows(_blanked(spark, d), "Kind", "event_id").select("event_id", "group_key", "group_order", "source_row")


@query(_groups_sql("SELECT 'number:' || CAST(p_size AS VARCHAR) AS k, p_partkey AS o FROM part"))
def group_typed_number(spark, d):
    return groups_of(read(spark, d, "part"), "P_Size", "p_partkey")


@query(_groups_sql("SELECT 'string:' || o_orderpriority AS k, o_orderkey AS o FROM orders"))
def group_first_seen(spark, d):
    return groups_of(read(spark, d, "orders"), "o_orderpriority", "o_orderkey")


_MIXED = "CASE WHEN event_id % 6 = 0 THEN ' ' || event_type || ' ' WHEN event_id % 6 = 1 THEN upper(event_type) WHEN event_id % 6 = 2 THEN CAST(event_id % 40 AS VARCHAR) || '.0' WHEN event_id % 6 = 3 THEN '+' || CAST(event_id % 40 AS VARCHAR) WHEN event_id % 6 = 4 THEN '   ' ELSE '1d' END"
_NUMERIC = r"regexp_full_match(trim(m), '[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?')"
_KEYED = f"SELECT event_id, m, CASE WHEN trim(m) = '' THEN NULL WHEN {_NUMERIC} THEN 'number:' || CAST(CAST(CAST(trim(m) AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE 'string:' || lower(trim(m)) END AS k FROM (SELECT event_id, {_MIXED} AS m FROM events)"


@query(f"SELECT k AS group_key, count(*) AS n_rows, min(event_id) AS first_row, trim(min_by(m, event_id)) AS display FROM ({_KEYED}) WHERE k IS NOT NULL GROUP BY k")
def split_key_normalized(spark, d):
    """Distinct normalized keys: numbers by value, text without case and space; the first spelling is shown."""
    rows = read(spark, d, "events").select("event_id", F.expr(_MIXED.replace("VARCHAR", "STRING")).alias("m"))
    rows = C.with_split_key(rows, "k", "m").filter("k is not null")
    return rows.groupBy(F.col("k").alias("group_key")).agg(F.count("*").alias("n_rows"), F.min("event_id").alias("first_row"), C.trimmed(F.min_by("m", "event_id")).alias("display"))


@query(f"SELECT 'string:' || m AS group_key, count(*) AS n_rows FROM ({_KEYED}) WHERE trim(m) <> '' GROUP BY m")
def split_key_strict(spark, d):
    rows = read(spark, d, "events").select(F.expr(_MIXED.replace("VARCHAR", "STRING")).alias("m"))
    return C.with_split_key(rows, "k", "m", strict=True).filter("k is not null").groupBy(F.col("k").alias("group_key")).agg(F.count("*").alias("n_rows"))


_SHEETS = "SELECT 'customer' AS sheet, c_custkey AS row, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'number:' || CAST(c_nationkey AS VARCHAR) END AS key FROM customer UNION ALL SELECT 'supplier', s_suppkey, 'number:' || CAST(s_nationkey AS VARCHAR) FROM supplier"


def _sheet_rows(spark, d):
    c = read(spark, d, "customer").select(F.lit("customer").alias("sheet"), F.col("c_custkey").alias("row"), F.when(F.col("c_custkey") % 9 != 0, C.typed_key(F.col("c_nationkey"), "number")).alias("key"))
    s = read(spark, d, "supplier").select(F.lit("supplier").alias("sheet"), F.col("s_suppkey").alias("row"), C.typed_key(F.col("s_nationkey"), "number").alias("key"))
    return c.union(s)


@query(f"""WITH r AS ({_SHEETS}), t AS (SELECT sheet, count(*) AS total FROM r GROUP BY 1), g AS (SELECT DISTINCT key FROM r WHERE key IS NOT NULL), n AS (SELECT sheet, key, count(*) AS n FROM r GROUP BY 1, 2)
SELECT g.key AS group_key, t.sheet, coalesce(n, 0) AS kept, total - coalesce(n, 0) AS deleted FROM g CROSS JOIN t LEFT JOIN n ON n.sheet = t.sheet AND n.key = g.key""")
def split_sheet_matrix(spark, d):
    return S.split_counts(_sheet_rows(spark, d))


@query(f"""WITH r AS ({_SHEETS}) SELECT count(*) AS input_rows, count(*) FILTER (WHERE key IS NULL) AS skipped_rows, count(DISTINCT key) AS groups, count(key) AS output_rows, count(DISTINCT sheet) AS sheets_filtered, count(DISTINCT key) * count(*) - count(key) AS rows_deleted FROM r""")
def split_metrics(spark, d):
    return S.split_totals(_sheet_rows(spark, d))


@query("SELECT table_name AS sheet, bool_or(lower(column_name) = 'n_regionkey') AS filtered, any_value(n) AS rows FROM information_schema.columns JOIN (SELECT 'region' AS t, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer) ON t = table_name GROUP BY 1")
def split_unchanged_sheets(spark, d):
    """A sheet without the column is copied as it is."""
    cells = None
    for name in ("region", "nation", "customer"):
        df = read(spark, d, name)
        heads = spark.createDataFrame([("book", name, 1, i, c) for i, c in enumerate(df.columns, 1)], "file string, sheet string, row long, col int, value string")
        rows = df.select(F.lit("book").alias("file"), F.lit(name).alias("sheet"), (F.col(df.columns[0]) + 2).cast("long").alias("row"), F.lit(1).alias("col"), F.col(df.columns[0]).cast("string").alias("value"))
        own = heads.union(rows)
        cells = own if cells is None else cells.union(own)
    found = S.header_place(cells, " N_RegionKey").select("sheet", F.lit(True).alias("found"))
    sheets = cells.groupBy("sheet").agg(F.count_if(F.col("row") > 1).alias("rows"))
    return sheets.join(found, "sheet", "left").select("sheet", F.coalesce("found", F.lit(False)).alias("filtered"), "rows")


@query("SELECT o_orderkey, new_row FROM (SELECT o_orderkey, o_orderstatus, CAST(rn - sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) OVER (ORDER BY rn) AS BIGINT) AS new_row FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders)) WHERE o_orderstatus = 'F'")
def row_compaction(spark, d):
    """Rows of a sheet that stay move up by the rows deleted before them."""
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit("s").alias("sheet"))
    # numbering all rows takes one order over all of them: by ranges of the key, then over the ranges' counts
    part = o.withColumn("_range", F.floor(F.col("o_orderkey") / 4096))
    n = part.groupBy("_range").count()
    n = n.select("_range", (F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    rows = part.join(n, "_range").withColumn("row", F.col("before") + F.row_number().over(Window.partitionBy("_range").orderBy("o_orderkey")))
    return S.compacted(rows.select("o_orderkey", "o_orderstatus", "sheet", "row"), F.col("o_orderstatus") == "F", ["sheet"]).select("o_orderkey", "new_row")


@query("SELECT n_regionkey AS grp, n_nationkey AS key, CAST(4 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS BIGINT) AS new_row, CAST(5 + count(*) OVER (PARTITION BY n_regionkey) AS BIGINT) AS totals_row FROM nation")
def table_compaction_with_totals(spark, d):
    """A table whose header is in row 4: kept rows follow it without gaps, then the totals row."""
    rows = read(spark, d, "nation").select(F.col("n_regionkey").alias("grp"), F.col("n_nationkey").alias("key"), F.lit(4).alias("top"))
    return S.table_rows(rows, ["grp"], "top", "key").drop("top")


_ODD = "CASE WHEN p_partkey % 5 = 0 THEN 'con.' || p_brand WHEN p_partkey % 5 = 1 THEN p_name || '/' || p_type || ': a  b. ' WHEN p_partkey % 5 = 2 THEN '<' || p_name || '>*' WHEN p_partkey % 5 = 3 THEN repeat(p_type, 8) ELSE ' .. ' END"
_SAFE = r"""WITH a AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(v, '[<>:"/\\|?*]+', '-', 'g'), '\s+', ' ', 'g'), '-+', '-', 'g')) AS v FROM (SELECT p_partkey, {v} AS v FROM part)),
b AS (SELECT p_partkey, regexp_replace(substr(regexp_replace(v, '[. ]+$', ''), 1, 80), '[. ]+$', '') AS v FROM a),
c AS (SELECT p_partkey, CASE WHEN v = '' THEN 'blank' ELSE v END AS v FROM b)
SELECT p_partkey, CASE WHEN regexp_matches(v, '(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$') THEN '_' || v ELSE v END AS name FROM c"""


@query(_SAFE.format(v=_ODD))
def safe_names(spark, d):
    return read(spark, d, "part").select("p_partkey", N.safe_name_column(F.expr(_ODD), "blank").alias("name"))


@query(r"SELECT p_partkey, regexp_matches(p_type, '(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$') OR p_partkey % 3 = 0 AS reserved FROM part")
def reserved_names(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("LPT"), F.col("p_partkey") % 9 + 1, F.lit(".x.y"))).otherwise(F.col("p_type"))
    return read(spark, d, "part").select("p_partkey", name.rlike(N.RESERVED).alias("reserved"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '\\.html$', '', 'i') AS stem FROM pages")
def stems_without_extension(spark, d):
    return read(spark, d, "pages").select("page_id", N.without_extension(F.regexp_replace("url", "^[a-z]+://", ""), "html").alias("stem"))


@query("""SELECT item_id, CASE WHEN octet_length(encode(text)) <= 80 THEN octet_length(encode(text)) ELSE (SELECT max(octet_length(encode(substr(text, 1, n)))) FROM range(1, 81) t(n) WHERE octet_length(encode(substr(text, 1, n))) <= 80) END AS bytes FROM benchmark""")
def truncate_utf8(spark, d):
    """Bytes of each text's longest head of whole characters within 80 bytes."""
    return read(spark, d, "benchmark").select("item_id", F.octet_length(N.truncated_column(F.col("text"), 80)).cast("long").alias("bytes"))


@query("""SELECT group_value, group_order, CASE WHEN n = 1 THEN base ELSE base || '-' || n END || '.xlsx' AS name FROM (
SELECT p_brand AS group_value, group_order, 'part-' || b AS base, row_number() OVER (PARTITION BY lower(b) ORDER BY group_order) AS n FROM (
SELECT p_brand, replace(p_brand, '#', '') AS b, row_number() OVER (ORDER BY min(p_partkey)) AS group_order FROM part GROUP BY p_brand))""")
def filename_suffixes(spark, d):
    """One file name for each group, in first-seen order. The groups' list is the size of the output folder's."""
    groups = groups_of(read(spark, d, "part"), "p_brand", "p_partkey").orderBy("group_order").collect()
    values = [g["group_key"].removeprefix("string:") for g in groups]
    names = N.output_names([v.replace("#", "") for v in values], "part")
    return spark.createDataFrame([(v, g["group_order"], n) for v, g, n in zip(values, groups, names)], "group_value string, group_order long, name string")


_HEADS = "SELECT 'f' AS file, CAST(n_regionkey AS VARCHAR) AS sheet, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS col, CASE WHEN n_nationkey % 4 = 0 THEN NULL WHEN n_nationkey % 4 = 1 THEN ' Name' WHEN n_nationkey % 4 = 2 THEN 'name ' ELSE n_name END AS value FROM nation"


@query(f"""WITH h AS ({_HEADS}), b AS (SELECT sheet, col, CASE WHEN trim(coalesce(value, '')) = '' THEN 'column_' || col ELSE trim(value) END AS base FROM h)
SELECT sheet, col, CASE WHEN row_number() OVER w = 1 THEN base ELSE base || '_' || row_number() OVER w END AS name FROM b WINDOW w AS (PARTITION BY sheet, lower(base) ORDER BY col)""")
def unique_headers(spark, d):
    col = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    value = F.expr("CASE WHEN n_nationkey % 4 = 0 THEN NULL WHEN n_nationkey % 4 = 1 THEN ' Name' WHEN n_nationkey % 4 = 2 THEN 'name ' ELSE n_name END")
    heads = read(spark, d, "nation").select(F.lit("f").alias("file"), F.col("n_regionkey").cast("string").alias("sheet"), col.alias("col"), value.alias("value"))
    return S.unique_header_names(heads).select("sheet", "col", "name")


@query(f"SELECT lower(trim(value)) AS header, count(*) AS times FROM ({_HEADS}) WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_headers(spark, d):
    value = F.expr("CASE WHEN n_nationkey % 4 = 0 THEN NULL WHEN n_nationkey % 4 = 1 THEN ' Name' WHEN n_nationkey % 4 = 2 THEN 'name ' ELSE n_name END")
    rows = read(spark, d, "nation").select(C.key_of(value).alias("name")).filter("name is not null")
    return S.duplicate_names(rows).withColumnRenamed("name", "header")


_CELLS = """SELECT 'f' AS file, event_type AS sheet, event_id AS row, 1 AS col, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN '' ELSE event_type END AS value FROM events
UNION ALL SELECT 'f', event_type, event_id, 2, CASE WHEN event_id % 5 = 0 THEN ' ' WHEN event_id % 5 = 1 THEN CAST(user_id AS VARCHAR) END FROM events"""


def _cells(spark, d):
    e = read(spark, d, "events")
    one = e.select(F.lit("f").alias("file"), F.col("event_type").alias("sheet"), F.col("event_id").alias("row"), F.lit(1).alias("col"), F.expr("CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN '' ELSE event_type END").alias("value"))
    two = e.select(F.lit("f").alias("file"), F.col("event_type").alias("sheet"), F.col("event_id").alias("row"), F.lit(2).alias("col"), F.expr("CASE WHEN event_id % 5 = 0 THEN ' ' WHEN event_id % 5 = 1 THEN CAST(user_id AS STRING) END").alias("value"))
    return one.union(two)


@query(f"SELECT sheet, min(row) AS header_row FROM ({_CELLS}) WHERE value IS NOT NULL GROUP BY 1")
def header_row_detect(spark, d):
    return S.header_rows(_cells(spark, d)).select("sheet", "header_row")


@query(f"SELECT sheet, min(row) AS header_row, arg_min(col, row * 10 + col) AS header_col FROM ({_CELLS}) WHERE lower(trim(value)) = 'click' GROUP BY 1")
def header_search(spark, d):
    return S.header_place(_cells(spark, d), " CLICK ").select("sheet", "header_row", "header_col")


@query(f"SELECT DISTINCT sheet, row FROM ({_CELLS}) WHERE value IS NOT NULL AND value <> ''")
def drop_empty_rows(spark, d):
    return S.rows_with_values(_cells(spark, d)).select("sheet", "row")


@query(f"SELECT sheet, count(DISTINCT row) - count(DISTINCT CASE WHEN value IS NOT NULL AND value <> '' THEN row END) AS empty_rows FROM ({_CELLS}) GROUP BY 1")
def empty_row_count(spark, d):
    return S.empty_rows(_cells(spark, d)).select("sheet", F.col("n").alias("empty_rows"))


_CATALOG = "SELECT n_nationkey AS sheet_order, n_name AS sheet, n_nationkey % 3 AS visibility FROM nation"


@query(f"SELECT sheet, sheet_order FROM ({_CATALOG}) WHERE visibility = 0")
def visibility_filter(spark, d):
    return S.chosen_areas(_areas(spark, d), "sheet").select("sheet", "sheet_order")


def _areas(spark, d):
    n = read(spark, d, "nation")
    return n.select(F.lit("sheet").alias("area"), F.col("n_name").alias("name"), F.col("n_name").alias("sheet"), F.col("n_nationkey").alias("sheet_order"), (F.col("n_nationkey") % 3).alias("visibility"))


@query("SELECT n_name AS sheet FROM nation WHERE lower(n_name) IN ('france', 'nation_1', 'nation_2', 'germany')")
def sheet_name_filter(spark, d):
    return S.chosen_areas(_areas(spark, d), "sheet", sheets=["France", "NATION_1", "Nation_2", "GERMANY"], include_hidden=True).select("sheet")


@query(r"""SELECT name, replace(regexp_extract(ref, '^''?(.*?)''?!', 1), '''''', '''') AS sheet, replace(regexp_extract(ref, '!(.*)$', 1), '$', '') AS range FROM (
SELECT CASE WHEN p_partkey % 4 = 0 THEN '_xlnm.Print_Area' ELSE 'Range' || p_partkey END AS name, CASE WHEN p_partkey % 5 = 0 THEN '#REF!' WHEN p_partkey % 5 = 1 THEN 'Plain!B' || p_size WHEN p_partkey % 5 = 2 THEN '''It''''s''!A1:B2' WHEN p_partkey % 5 = 3 THEN 'A!A1,B!B2' ELSE '''' || p_brand || '''!$A$' || p_size || ':$C$' || (p_size + 9) END AS ref FROM part)
WHERE NOT starts_with(name, '_xlnm.') AND ref <> '#REF!' AND NOT contains(ref, ',')""")
def defined_name_filter(spark, d):
    """Named ranges that people made and that point somewhere."""
    p = read(spark, d, "part")
    name = F.when(F.col("p_partkey") % 4 == 0, "_xlnm.Print_Area").otherwise(F.concat(F.lit("Range"), "p_partkey"))
    case = F.col("p_partkey") % 5
    ref = F.when(case == 0, "#REF!").when(case == 1, F.concat(F.lit("Plain!B"), "p_size")).when(case == 2, "'It''s'!A1:B2").when(case == 3, "A!A1,B!B2")
    ref = ref.otherwise(F.concat(F.lit("'"), "p_brand", F.lit("'!$A$"), "p_size", F.lit(":$C$"), F.col("p_size") + 9))
    return S.named_areas(p.select(name.alias("name"), ref.alias("ref")))


@query("""SELECT s_suppkey AS range_no, count(*) AS cells, sum(l_linenumber) AS total FROM lineitem JOIN supplier ON l_suppkey % 5 = s_suppkey % 5 AND l_partkey BETWEEN s_suppkey * 3 AND s_suppkey * 3 + 40 AND l_linenumber BETWEEN 2 AND 4 GROUP BY 1""")
def range_join_cells(spark, d):
    """Cells in ranges."""
    cells = read(spark, d, "lineitem").select(F.lit("f").alias("file"), (F.col("l_suppkey") % 5).alias("sheet"), F.col("l_partkey").alias("row"), F.col("l_linenumber").alias("col"))
    top = F.col("s_suppkey") * 3
    ranges = read(spark, d, "supplier").select(F.lit("f").alias("file"), (F.col("s_suppkey") % 5).alias("sheet"), F.col("s_suppkey").alias("range_no"), top.alias("top"), F.lit(2).alias("left"), (top + 40).alias("bottom"), F.lit(4).alias("right"))
    return S.in_ranges(cells, ranges, 64).groupBy("range_no").agg(F.count("*").alias("cells"), F.sum("col").alias("total"))


@query("""SELECT h.sheet, h.header_row, h.header_col, arg_min(t.name, t.place) AS name FROM (SELECT DISTINCT 's' || (n_nationkey % 3) AS sheet, 1 + n_nationkey % 4 AS header_row, 2 + n_nationkey % 2 AS header_col, ' col' || (n_nationkey % 2) AS header FROM nation) h
JOIN (SELECT 's' || (s_suppkey % 3) AS sheet, s_suppkey AS place, s_name AS name, 1 + s_suppkey % 4 AS top, 1 + s_suppkey % 3 AS left_, ['Col0', 'COL1 ', 'col0'] AS columns FROM supplier WHERE s_suppkey % 5 <> 0) t
ON t.sheet = h.sheet AND t.top = h.header_row AND h.header_col >= t.left_ AND lower(trim(t.columns[h.header_col - t.left_ + 1])) = trim(h.header) GROUP BY ALL""")
def match_excel_table(spark, d):
    """The first Excel table whose header is where a column was found."""
    n, s = read(spark, d, "nation"), read(spark, d, "supplier")
    key = F.col("n_nationkey")
    headers = n.select(F.lit("f").alias("file"), F.concat(F.lit("s"), key % 3).alias("sheet"), (1 + key % 4).alias("header_row"), (2 + key % 2).alias("header_col"), F.concat(F.lit(" col"), key % 2).alias("header")).distinct()
    key = F.col("s_suppkey")
    tables = s.select(F.lit("f").alias("file"), F.concat(F.lit("s"), key % 3).alias("sheet"), key.alias("place"), F.col("s_name").alias("name"), (1 + key % 4).alias("top"), (1 + key % 3).cast("int").alias("left"), (key % 5 != 0).alias("header"), F.array(F.lit("Col0"), F.lit("COL1 "), F.lit("col0")).alias("columns"))
    return S.matched_tables(headers, tables).select("sheet", "header_row", "header_col", F.col("table.name").alias("name"))


_FORMULA = """CASE WHEN p_partkey % 6 = 0 THEN 'SUM(1,2)' WHEN p_partkey % 6 = 1 THEN concat('LEN("A', p_size, '")') WHEN p_partkey % 6 = 2 THEN concat('B', p_size, '*2') WHEN p_partkey % 6 = 3 THEN concat('LOG', p_size, '(8)') WHEN p_partkey % 6 = 4 THEN concat(p_brand, '+1') ELSE concat('SUM($C$', p_size, ':D9)') END"""


@query(f"""SELECT p_partkey, len(list_filter(regexp_extract_all(regexp_replace({_FORMULA}, '"[^"]*"', '""', 'g'), '[A-Za-z0-9_.$]+[(]?'), lambda w: regexp_full_match(w, '[$]?[A-Za-z]{{1,3}}[$]?[0-9]+'))) = 0 AS relocatable FROM part""")
def formula_relocatable(spark, d):
    return read(spark, d, "part").select("p_partkey", S.relocatable(F.expr(_FORMULA)).alias("relocatable"))


_LETTERS = "CASE WHEN p_partkey % 3 = 0 THEN chr(CAST(65 + p_size % 26 AS INT)) WHEN p_partkey % 3 = 1 THEN chr(CAST(65 + p_size % 26 AS INT)) || 'B' ELSE 'A' || chr(CAST(97 + p_size % 26 AS INT)) || 'C' END"


@query(f"SELECT p_partkey, CAST(list_sum(list_transform(range(1, length(v) + 1), lambda i: (ascii(upper(v[i])) - 64) * power(26, length(v) - i))) AS INT) AS number FROM (SELECT p_partkey, {_LETTERS} AS v FROM part)")
def column_letters(spark, d):
    letters = F.expr(_LETTERS.replace("chr(CAST(", "chr((").replace(" AS INT))", "))"))
    return read(spark, d, "part").select("p_partkey", C.column_number(letters).alias("number"))


@query(f"""SELECT 'book' || (sheet_order % 2) AS source, sheet AS original, sheet_order AS position, CASE visibility WHEN 0 THEN 'Visible' WHEN 1 THEN 'Hidden' ELSE 'Very hidden' END AS visibility,
CASE WHEN sheet_order % 2 = 0 THEN 'Summary' ELSE substr(sheet, 1, 31) END || CASE WHEN sheet_order % 2 = 0 AND sheet_order > 0 THEN ' (' || (sheet_order // 2 + 1) || ')' ELSE '' END AS final FROM ({_CATALOG})""")
def sheet_index(spark, d):
    """Merged sheets with unique names, in order. The catalogue is the size of one output workbook's."""
    rows = read(spark, d, "nation").orderBy("n_nationkey").collect()
    names = N.sheet_names(["Summary" if r["n_nationkey"] % 2 == 0 else r["n_name"] for r in rows], ["Sheet Index"])
    out = spark.createDataFrame([(f"book{r['n_nationkey'] % 2}", r["n_name"], r["n_nationkey"], r["n_nationkey"] % 3, n) for r, n in zip(rows, names)], "source string, original string, position int, state int, final string")
    return out.select("source", "original", "position", C.visibility_label(F.col("state")).alias("visibility"), "final")


@query(f"SELECT count(*) AS output_sheets, count(*) FILTER (WHERE visibility > 0) AS hidden_sheets FROM ({_CATALOG})")
def merge_metrics(spark, d):
    return S.merge_counts(_areas(spark, d))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(extract('millisecond' FROM o_orderdate) % 1000 AS VARCHAR), 3, '0') || 'Z' AS day, CASE WHEN o_totalprice > 100000 THEN 'TRUE' ELSE 'FALSE' END AS large, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS price, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS status FROM orders""")
def display_text_records(spark, d):
    o = read(spark, d, "orders")
    return o.select("o_orderkey", C.display_text(F.col("o_orderdate"), "date").alias("day"), C.display_text(F.col("o_totalprice") > 100000, "boolean").alias("large"), C.display_text(F.floor("o_totalprice").cast("double"), "number").alias("price"), C.display_text(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), "string").alias("status"))


_TEMPLATE = "CASE WHEN c_custkey % 4 = 0 THEN 'Dear {{ name }}, balance {{balance}}; {{name}}' WHEN c_custkey % 4 = 1 THEN '{{segment}} {{other}} {{  }}' WHEN c_custkey % 4 = 2 THEN 'plain' ELSE '{{name}} and {{broken}' END"


@query(f"SELECT name, count(*) AS occurrences FROM (SELECT trim(unnest(regexp_extract_all({_TEMPLATE}, '\\{{\\{{([^{{}}]*)\\}}\\}}', 1))) AS name FROM customer) WHERE name <> '' GROUP BY 1")
def placeholders_extract(spark, d):
    rows = read(spark, d, "customer").select(F.explode(P.placeholders(F.expr(_TEMPLATE))).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("occurrences"))


@query(f"SELECT c_custkey, contains(rest, '{{{{') OR contains(rest, '}}}}') AS malformed FROM (SELECT c_custkey, regexp_replace({_TEMPLATE}, '\\{{\\{{[^{{}}]*[^{{}} ][^{{}}]*\\}}\\}}', '', 'g') AS rest FROM customer)")
def placeholders_malformed(spark, d):
    return read(spark, d, "customer").select("c_custkey", P.malformed(F.expr(_TEMPLATE)).alias("malformed"))


@query(f"SELECT DISTINCT trim(name) AS missing FROM (SELECT unnest(regexp_extract_all({_TEMPLATE}, '\\{{\\{{([^{{}}]*)\\}}\\}}', 1)) AS name FROM customer) WHERE trim(name) NOT IN ('', 'name', 'balance', 'segment')")
def placeholders_missing_columns(spark, d):
    names = read(spark, d, "customer").select(F.explode(P.placeholders(F.expr(_TEMPLATE))).alias("missing")).distinct()
    known = spark.createDataFrame([("name",), ("balance",), ("segment",)], "missing string")
    return names.join(known, "missing", "left_anti")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Dear ' || c_name || ', balance ' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) || '; ' || c_name WHEN 1 THEN c_mktsegment || ' {{other}} {{  }}' WHEN 2 THEN 'plain' ELSE c_name || ' and {{broken}' END AS text FROM customer""")
def populate_text(spark, d):
    values = {"name": F.col("c_name"), "balance": F.floor("c_acctbal").cast("long"), "segment": F.col("c_mktsegment")}
    return read(spark, d, "customer").select("c_custkey", P.filled(F.expr(_TEMPLATE), values).alias("text"))


@query("SELECT role AS \"column\", row_number() OVER (ORDER BY min(conv_id * 1000 + turn)) AS place FROM conversations GROUP BY role")
def records_columns(spark, d):
    return record_columns(read(spark, d, "conversations").select(F.col("conv_id").alias("record"), F.col("turn").alias("place"), F.col("role").alias("name")))


@query("SELECT c_custkey, 'é' || chr(CAST(65 + c_custkey % 26 AS INT)) || '<&lt;' || chr(CAST(256 + c_custkey % 500 AS INT)) || '&#0;\"' || c_name AS text FROM customer")
def xml_numbered(spark, d):
    """Numbered characters, decimal and hexadecimal, beside named ones."""
    e = F.concat(F.lit("é&#"), 65 + F.col("c_custkey") % 26, F.lit(";&lt;&amp;lt;&#x"), F.hex(256 + F.col("c_custkey") % 500), F.lit(";&#0;&quot;"), F.col("c_name"))
    return read(spark, d, "customer").select("c_custkey", P.xml_decoded(e).alias("text"))


@query("SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS encoded, TRUE AS same FROM pages")
def xml_escape_roundtrip(spark, d):
    e = P.xml_encoded(F.col("html"))
    return read(spark, d, "pages").select("page_id", F.md5(e.cast("binary")).alias("encoded"), (P.xml_decoded(e) == F.col("html")).alias("same"))


_FILES = "SELECT doc_id AS file_order, 'doc' || doc_id || '.PDF' AS file, CAST(n_chars // 2000 AS BIGINT) AS pages FROM documents"


def _files(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("file_order"), F.concat(F.lit("doc"), "doc_id", F.lit(".PDF")).alias("file"), F.expr("n_chars div 2000").alias("pages"))


@query(f"SELECT file, page, 'doc' || file_order || '-page-' || lpad(CAST(page AS VARCHAR), CAST(greatest(3, length(CAST(pages AS VARCHAR))) AS INT), '0') || '.pdf' AS name FROM (SELECT file, file_order, pages, unnest(range(1, pages + 1)) AS page FROM ({_FILES}))")
def pdf_page_names(spark, d):
    return G.split_pages(_files(spark, d))


@query(f"SELECT file, page, row_number() OVER (ORDER BY file_order, page) AS merged_page FROM (SELECT file, file_order, unnest(range(1, pages + 1)) AS page FROM ({_FILES}))")
def pdf_merge_order(spark, d):
    return G.merged_pages(_files(spark, d))


@query(f"SELECT count(*) AS files, CAST(sum(pages) AS BIGINT) AS pages FROM ({_FILES})")
def pdf_page_counts(spark, d):
    return G.page_counts(_files(spark, d))


@query("SELECT 'c_custkey' AS \"column\", least(60, greatest(10, greatest(9, max(length(CAST(c_custkey AS VARCHAR)))) + 2)) AS width FROM customer UNION ALL SELECT 'c_name', least(60, greatest(10, greatest(6, max(length(c_name))) + 2)) FROM customer UNION ALL SELECT 'c_mktsegment', least(60, greatest(10, greatest(12, max(length(c_mktsegment))) + 2)) FROM customer")
def column_widths(spark, d):
    return S.column_widths(read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"))


@query("SELECT DISTINCT lower(regexp_replace(url, '[?#].*$', '')) AS path FROM pages WHERE regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\\.html$')")
def discover_dedupe(spark, d):
    """Paths once each, with a wanted extension whatever its case."""
    path = F.lower(F.regexp_replace("url", "[?#].*$", ""))
    return distinct_paths(read(spark, d, "pages").select(path.alias("path")), [" HTML"])


@query("SELECT DISTINCT p_brand AS path FROM part WHERE lower(p_brand) IN (SELECT lower(p_brand) FROM part WHERE p_size < 10)")
def manifest_collisions(spark, d):
    """Planned outputs that exist already, on a file system without case."""
    p = read(spark, d, "part")
    return collisions(p.select(F.col("p_brand").alias("path")), p.filter("p_size < 10").select(F.upper("p_brand").alias("path")), any_case=True)


@query("SELECT o_custkey, 'Skipped ' || format('{:,}', count(*)) || CASE WHEN count(*) = 1 THEN ' row.' ELSE ' rows.' END AS message FROM orders GROUP BY 1")
def plural_messages(spark, d):
    n = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.select("o_custkey", M.skipped_rows_text(F.col("n")).alias("message"))


@query("SELECT c_custkey, c_custkey + 2 AS source_row FROM customer")
def source_row_numbers(spark, d):
    return union_tables([Table(read(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("_at")), "_at")], names=("f", "s", "source_row")).select("c_custkey", "source_row")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Excel workbook' WHEN 1 THEN 'PDF document' ELSE 'File' END AS label FROM part")
def artifact_labels(spark, d):
    media = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' WHEN 1 THEN 'application/pdf' ELSE 'text/plain' END")
    return read(spark, d, "part").select("p_partkey", M.artifact_labels(media).alias("label"))


def _workbooks(spark, d) -> DataFrame:
    """Two workbooks in memory, of as many rows as suppliers and nations are: fixtures of the next query."""
    n, s = ([tuple(r) for r in read(spark, d, t).orderBy(o).select(*c).collect()] for t, o, c in (("nation", "n_nationkey", ("n_name", "n_regionkey", "n_nationkey")), ("supplier", "s_suppkey", ("s_acctbal", "s_name", "s_suppkey"))))
    books = [
        ("mem:/a/book.xlsx", workbook_bytes([("Nations", ["Name", "Region", "Key"], n)])),
        ("mem:/b/book.xlsx", workbook_bytes([("Firms", [" Balance", "NAME ", "key"], s), ("Hidden", ["x"], [(1,)])], [0, 1])),
    ]
    return spark.createDataFrame([(p, bytearray(c)) for p, c in books], "path string, content binary")


@query("""SELECT n_name AS "Name", CAST(n_regionkey AS DOUBLE) AS "Region", CAST(n_nationkey AS DOUBLE) AS "Key", CAST(NULL AS DOUBLE) AS "Balance", 'book.xlsx' AS _source_file, 'Nations' AS _source_sheet, CAST(row_number() OVER (ORDER BY n_nationkey) + 1 AS BIGINT) AS _source_row FROM nation
UNION ALL SELECT s_name, NULL, CAST(s_suppkey AS DOUBLE), s_acctbal, 'book.xlsx', 'Firms', row_number() OVER (ORDER BY s_suppkey) + 1 FROM supplier""")
def consolidate_workbooks(spark, d):
    """Worksheets of two files of one name, typed columns, a hidden sheet left out."""
    return W.consolidate(spark, _workbooks(spark, d)).drop("_table", "_order")


@query("""SELECT 'string:' || lower(o_orderpriority) AS key, 'orders' AS sheet, count(*) AS n, min(o_orderkey) + 2 AS first_row FROM orders WHERE o_orderkey % 11 > 0 GROUP BY 1
UNION ALL SELECT 'number:' || CAST(s_suppkey % 7 AS VARCHAR), 'firms', count(*), min(s_suppkey) + 3 FROM supplier GROUP BY 1""")
def split_rows_of_sheets(spark, d):
    """Keyed rows of all sheets with the column: found by its header's text, which is in another place in each sheet."""
    o, s = read(spark, d, "orders"), read(spark, d, "supplier")
    schema = "file string, sheet string, sheet_order int, visibility int, row long, col int, kind string, value string"
    heads = spark.createDataFrame([("f", "orders", 0, 0, 1, 1, "string", "Id"), ("f", "orders", 0, 0, 1, 2, "string", "Ｇroup"), ("f", "firms", 1, 0, 2, 1, "string", " group ")], schema)
    place = lambda sheet, order, row, col, kind, value: (F.lit("f").alias("file"), F.lit(sheet).alias("sheet"), F.lit(order).alias("sheet_order"), F.lit(0).alias("visibility"), row.cast("long").alias("row"), F.lit(col).alias("col"), F.lit(kind).alias("kind"), value.alias("value"))
    keys = F.when(F.col("o_orderkey") % 11 == 0, "  ").when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), F.upper("o_orderpriority"))).otherwise(F.col("o_orderpriority"))
    cells = heads.union(o.select(*place("orders", 0, F.col("o_orderkey") + 2, 2, "string", keys))).union(s.select(*place("firms", 1, F.col("s_suppkey") + 3, 1, "number", (F.col("s_suppkey") % 7).cast("string"))))
    areas = spark.createDataFrame([("f", "sheet", n, s_, s_, n, 1, 1, 2**31, 2) for n, s_ in enumerate(("orders", "firms"))], "file string, area string, place int, name string, sheet string, sheet_order int, top long, left int, bottom long, right int").selectExpr("*", "true AS header", "false AS totals", "cast(null AS array<string>) AS columns")
    _, rows = split_rows(cells, areas, Options("GROUP"))
    return rows.groupBy("key", "sheet").agg(F.count("*").alias("n"), F.min("row").alias("first_row"))


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers as one table by column name, grouped by nation in first-seen order."""
    rows = union_tables(_parties(spark, d)).withColumn("_place", F.col("_table") * F.lit(2**40) + F.col("_order"))
    return groups_of(rows, " nation ", "_place")
