import os

import pytest

from ledgerloom.errors import LoomError
from ledgerloom.plans.control import Control, commit, refuse_overwriting_inputs
from ledgerloom.sources.discover import discover_files
from ledgerloom.sources.xlsx import Workbook, column_index, column_letters, part_path, read_cells, workbook_bytes
from ledgerloom.streaming.folders import arriving_files


def test_discover(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("a/x.XLSX", "a/b/y.xlsx", "a/b/z.txt"):
        (tmp_path / name).write_text("")
    got = discover_files(["a", "a/b/*.xlsx", "a/x.XLSX"], str(tmp_path), ["xlsx"])
    assert [os.path.relpath(p, tmp_path) for p in got] == ["a/b/y.xlsx", "a/x.XLSX"]
    with pytest.raises(LoomError):
        discover_files(["a/*.pdf"], str(tmp_path))
    with pytest.raises(LoomError):
        discover_files(["missing"], str(tmp_path))


def test_commit_is_all_or_nothing(tmp_path):
    a, b = str(tmp_path / "a.bin"), str(tmp_path / "b.bin")
    assert commit({a: b"1", b: b"2"}) == [a, b]
    with pytest.raises(LoomError) as e:
        commit({str(tmp_path / "c.bin"): b"3", b: b"4"})
    assert e.value.code == "FILES_OUTPUT_EXISTS" and not (tmp_path / "c.bin").exists()
    commit({b: b"4"}, overwrite=True)
    assert (tmp_path / "b.bin").read_bytes() == b"4" and sorted(os.listdir(tmp_path)) == ["a.bin", "b.bin"]
    with pytest.raises(LoomError):
        commit({str(tmp_path): b""}, overwrite=True)
    with pytest.raises(LoomError):
        refuse_overwriting_inputs([a], [a])


def test_control():
    seen = []
    control = Control(lambda *x: seen.append(x))
    control.step("merge", "reading", 0, 2, "a")
    control.aborted = True
    with pytest.raises(LoomError) as e:
        control.step("merge", "reading", 1, 2)
    assert e.value.code == "OPERATION_ABORTED" and len(seen) == 1


def test_letters():
    assert [column_letters(n) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"]
    assert [column_index(x) for x in ("A1", "Z9", "AA3", "AAA1")] == [1, 26, 27, 703]
    with pytest.raises(LoomError):
        part_path("xl/workbook.xml", "../../x.xml")


def test_workbooks(spark, tmp_path):
    rows = [("A & B", 10.0, True, None), ("é<", 0.5, False, " x ")]
    content = workbook_bytes([("First", ["Name", "Amount", "Active", "Note"], rows), ("Second", ["K"], [(1,)])])
    assert content == workbook_bytes([("First", ["Name", "Amount", "Active", "Note"], iter(rows)), ("Second", ["K"], [(1,)])])
    (tmp_path / "book.xlsx").write_bytes(content)
    cells = {(r["sheet"], r["row"], r["col"]): (r["kind"], r["value"]) for r in read_cells(spark, str(tmp_path)).collect()}
    assert cells[("First", 2, 1)] == ("string", "A & B") and cells[("First", 3, 2)] == ("number", "0.5")
    assert cells[("First", 2, 2)] == ("number", "10") and cells[("First", 3, 3)] == ("boolean", "false")
    assert ("First", 2, 4) not in cells and cells[("First", 3, 4)] == ("string", " x ")
    assert {k[0] for k in cells} == {"First", "Second"}
    assert {r["sheet"] for r in read_cells(spark, str(tmp_path), sheets=["SECOND"]).collect()} == {"Second"}
    assert [s[:2] for s in Workbook(content).sheets] == [("First", 0), ("Second", 0)]
    with pytest.raises(LoomError):
        Workbook(b"nothing")


def test_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xlsx").write_bytes(b"123")
    q = arriving_files(spark, str(tmp_path / "in"), "*.xlsx").select("length").writeStream.format("memory").queryName("arrived").start()
    q.processAllAvailable()
    q.stop()
    assert [r["length"] for r in spark.sql("select * from arrived").collect()] == [3]
