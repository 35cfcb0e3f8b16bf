import re
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.errors import LoomError
from ledgerloom.functions import cells, names, templates
from ledgerloom.operators.tables import Table, groups_of, union_tables
from pyspark.sql import functions as F


def test_headers():
    assert cells.unique_headers(["Name", " name ", None, "Amount"]) == ["Name", "name_2", "column_3", "Amount"]
    assert cells.unique_headers(["Name", "name", "name_2"]) == ["Name", "name_2", "name_2"]


def test_names():
    assert names.safe_name("con." + "a" * 76) == "_con." + "a" * 76
    assert names.safe_name("u\x07\u0301") == "u\u0301"  # composed before the control character goes
    assert names.safe_name("", "con") == "_con"
    assert names.safe_name("", "") == "file"
    assert len(names.safe_name("中" * 100).encode()) == 78
    assert names.safe_name("cli*ent<>secret") == "cli-ent-secret"
    assert names.output_names(["North", "South", None, "North/West", "North:West", "1", "1"], "clients") == [f"clients-{x}.xlsx" for x in ("North", "South", "blank", "North-West", "North-West-2", "1", "1-2")]
    assert names.output_names(["A/B", "CON", "Trailing. "]) == ["A-B.xlsx", "_CON.xlsx", "Trailing.xlsx"]
    assert names.output_names(["A", "A-2", "A"]) == ["A.xlsx", "A-2.xlsx", "A-3.xlsx"]
    assert names.sheet_names(["Summary", "Private", "Summary", "Sheet Index"], ["Sheet Index"]) == ["Summary", "Private", "Summary (2)", "Sheet Index (2)"]
    assert [len(n) for n in names.sheet_names(["x" * 40, "x" * 40])] == [31, 31]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=120), st.text(max_size=20))
def test_safe_name_properties(value, fallback):
    value, fallback = (x.encode("utf-8", "ignore").decode() for x in (value, fallback))
    name = names.safe_name(value, fallback)
    assert name and len(name.encode()) <= 81 and not name.endswith((".", " ")) and not set(name) & set('<>:"/\\|?*')
    assert names.safe_name(value, fallback) == name


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60), st.integers(0, 60))
def test_truncated(text, most):
    text = text.encode("utf-8", "ignore").decode()
    cut = names.truncated(text, most)
    assert text.startswith(cut) and len(cut.encode()) <= most
    assert cut == text or len(text[: len(cut) + 1].encode()) > most


def test_safe_name_column_agrees(spark):
    values = ["a/b", "CON", "x\ty  z", "..", "Ａ１", "é" * 60, "", None, "a\x07b. ", "-- --", "aux.txt"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", names.safe_name_column(F.col("v")).alias("n"))
    assert [r["n"] for r in df.collect()] == [None if v is None else names.safe_name(v) for v in values]


def test_split_keys(spark):
    cases = {"DGE": "string:dge", " dge ": "string:dge", "1": "number:1", "1.0": "number:1", "+1e0": "number:1", "-0": "number:0", "1d": "string:1d", "NaN": "string:nan", " ": None, " ": None, ".5": "number:0.5", "1e999": "string:1e999", "\t7\t": "number:7"}
    df = spark.createDataFrame([(c,) for c in cases], "v string")
    got = {r["v"]: r["k"] for r in df.select("v", cells.split_key(F.col("v")).alias("k")).collect()}
    assert got == cases
    strict = {r["v"]: r["k"] for r in df.select("v", cells.split_key(F.col("v"), True).alias("k")).collect()}
    assert strict[" dge "] == "string: dge " and strict[" "] is None


def test_templates(spark):
    texts = ["{{client_name}} / {{ client_name }}", "{{growth_rate}", "{{}}", "{{ a }}{{b}}", "no"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(templates.placeholders(F.col("t")).alias("p"), templates.malformed(F.col("t")).alias("m"), templates.filled(F.col("t"), {"a": F.lit("{{b}}"), "b": F.lit(None).cast("string")}).alias("f")).collect()
    assert [r["p"] for r in rows] == [["client_name"] * 2, [], [], ["a", "b"], []]
    assert [r["m"] for r in rows] == [False, True, True, False, False]
    assert rows[3]["f"] == "{{b}}" and rows[4]["f"] == "no" and rows[1]["f"] == texts[1]


def test_union(spark):
    one = Table(spark.createDataFrame([(0, "A", 10)], "o int, Client string, Amount int"), "o", "one.xlsx", "North", 4)
    two = Table(spark.createDataFrame([(0, "B", "Open")], "o int, client string, Status string"), "o", "two.xlsx", "South", 7)
    df = union_tables([one, two]).orderBy("_table", "_order").drop("_table", "_order")
    assert df.columns == ["Client", "Amount", "Status", "_source_file", "_source_sheet", "_source_row"]
    assert [tuple(r) for r in df.collect()] == [("A", 10, None, "one.xlsx", "North", 4), ("B", None, "Open", "two.xlsx", "South", 7)]
    with pytest.raises(LoomError, match="_source_file") as e:
        union_tables([Table(spark.createDataFrame([(0, 1)], "o int, ` _SOURCE_FILE` int"), "o")])
    assert e.value.code == "TABLE_SOURCE_COLUMN_COLLISION"
    with pytest.raises(LoomError):
        union_tables([])
    last_wins = union_tables([Table(spark.createDataFrame([(0, "x", "y")], "o int, A string, `a ` string"), "o")], add_source=False).collect()
    assert last_wins[0]["A"] == "y"


def test_groups(spark):
    df = spark.createDataFrame([(2, "A", "North"), (3, "B", "1"), (4, "C", "North"), (5, "D", "North "), (6, "E", " ")], "row int, Client string, Region string")
    got = [(r["group_key"], r["n_rows"]) for r in groups_of(df, " region ", "row").orderBy("group_order").collect()]
    assert got == [("string:North", 2), ("string:1", 1), ("string:North ", 1), (None, 1)]
    with pytest.raises(LoomError) as e:
        groups_of(df, "missing", "row")
    assert e.value.code == "TABLE_COLUMN_NOT_FOUND"


def test_codes_are_known():
    import pathlib

    import ledgerloom
    from ledgerloom.errors import CODES

    source = "".join(p.read_text() for p in pathlib.Path(ledgerloom.__file__).parent.rglob("*.py") if p.name not in ("errors.py", "messages.py"))
    used = set(re.findall(r'"((?:XLSX|PPTX|PDF|FILES|TABLE|TABLES|OPERATION)_[A-Z_]+[A-Z])"', source))
    assert used <= set(CODES) and len(set(CODES)) == len(CODES)
