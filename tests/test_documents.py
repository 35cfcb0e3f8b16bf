import io
import os
import re
import zipfile

import pytest

from ledgerloom.errors import LoomError
from ledgerloom.operators import slides, splits, workbooks
from ledgerloom.plans.control import Control
from ledgerloom.sources import packages, xlsx
from ledgerloom.sources.xlsx import Workbook, workbook_bytes


def values(content):
    return {(c[0], c[3], c[4]): c[6] for c in Workbook(content).cells()}


MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package(sheets, tables=(), names="", styles="", more=()):
    """A workbook of worksheet XML: sheets (name, state, inside of sheetData, dimension); tables (sheet number, xml)."""
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as out:
        n = range(1, len(sheets) + 1)
        out.writestr("[Content_Types].xml", '<Types><Override PartName="/xl/calcChain.xml" ContentType="calcChain+xml"/></Types>')
        out.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{OFFICE}"><sheets>' + "".join(f'<sheet name="{s[0]}" sheetId="{i}" r:id="rId{i}"' + (f' state="{s[1]}"' if s[1] else "") + "/>" for i, s in zip(n, sheets)) + f"</sheets><definedNames>{names}</definedNames></workbook>")
        out.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + '<Relationship Id="rId99" Type="x/calcChain" Target="calcChain.xml"/></Relationships>')
        for i, (_, _, body, dimension) in zip(n, sheets):
            x = "x:" if "<x:" in body else ""
            space = f'xmlns:x="http://schemas.openxmlformats.org/spreadsheetml/2006/main"' if x else MAIN
            out.writestr(f"xl/worksheets/sheet{i}.xml", f"<{x}worksheet {space}>" + (f'<{x}dimension ref="{dimension}"/>' if dimension else "") + f"<{x}sheetData>{body}</{x}sheetData></{x}worksheet>")
        for i, (sheet, xml) in enumerate(tables, 1):
            out.writestr(f"xl/tables/table{i}.xml", xml)
            out.writestr(f"xl/worksheets/_rels/sheet{sheet}.xml.rels", f'<Relationships><Relationship Id="rId1" Type="{OFFICE}/table" Target="../tables/table{i}.xml"/></Relationships>')
        if styles:
            out.writestr("xl/styles.xml", f"<styleSheet {MAIN}>{styles}</styleSheet>")
        for name, data in more:
            out.writestr(name, data)
    return z.getvalue()


def row(n, **cells):
    """A row of cells: text, numbers, or raw XML after the reference."""
    def cell(c, v):
        if isinstance(v, str) and v.startswith("<"):
            return f'<c r="{c}{n}"{v[1:]}</c>'
        return f'<c r="{c}{n}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{c}{n}" t="inlineStr"><is><t>{v}</t></is></c>'

    return f'<row r="{n}">' + "".join(cell(c, v) for c, v in cells.items()) + "</row>"


def clients(prefix="x:"):
    """A sheet with a title, a table B4:D8 with a totals row, styles, and cells beside it."""
    body = row(1, A="Client allocation report") + row(4, B="Client", C="Region", D="Amount")
    for n, (a, r, v) in enumerate([("A", "North", 10), ("B", "South", 20), ("C", "North", 30)], 5):
        body += row(n, B=a, C=r, D=f'< s="6"><v>{v}</v>', F=f"beside {n}")
    body += row(8, B="Total", D='< s="6"><f>SUBTOTAL(109,ClientData[Amount])</f><v>60</v>') + row(10, A="Cells outside ClientData")
    body = body.replace("<", "<" + prefix).replace(f"<{prefix}/", f"</{prefix}")
    table = f'<table {MAIN} id="1" name="ClientData" displayName="ClientData" ref="B4:D8" totalsRowCount="1"><autoFilter ref="B4:D7"/><tableColumns count="3"><tableColumn id="1" name="Client"/><tableColumn id="2" name="Region"/><tableColumn id="3" name="Amount"/></tableColumns></table>'
    return package([("Cover", "", row(1, A="Cover"), ""), ("Clients", "", body, "A1:F10")], [(2, table)])


def test_consolidate(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "book.xlsx").write_bytes(workbook_bytes([("S", ["Client", "Amount", "Ok"], [("A", 10.0, True), ("B", 11.0, None)])]))
    (tmp_path / "b" / "book.xlsx").write_bytes(workbook_bytes([("S", ["amount", "Status", " client "], [(20.0, "Open", "C"), (None, None, None), (None, "", "D")]), ("Empty", ["Client"], [])]))
    (tmp_path / "c.xlsx").write_bytes(package([("N", "", row(2, B="Client") + row(3, B="E", C="no header"), "A2:C5"), ("H", "hidden", row(1, A="Client") + row(2, A="X"), "")]))
    df = workbooks.consolidate(spark, str(tmp_path))
    assert df.columns == ["Client", "Amount", "Ok", "Status", "column_1", "column_3", "_source_file", "_source_sheet", "_source_row", "_table", "_order"]
    assert dict(df.dtypes)["Amount"] == "double" and dict(df.dtypes)["Ok"] == "boolean"
    rows = [tuple(r) for r in df.orderBy("_table", "_order").drop("_table", "_order").collect()]
    assert rows == [
        ("A", 10.0, True, None, None, None, "book.xlsx", "S", 2), ("B", 11.0, None, None, None, None, "book.xlsx", "S", 3),
        ("C", 20.0, None, "Open", None, None, "book.xlsx", "S", 2), ("D", None, None, "", None, None, "book.xlsx", "S", 4),
        ("E", None, None, None, None, "no header", "c.xlsx", "N", 3),
    ]
    paths = sorted(map(str, tmp_path.rglob("*.xlsx")))
    result = workbooks.consolidate_workbooks(spark, paths, str(tmp_path / "out" / "all.xlsx"))
    assert result.metrics == {"inputFiles": 3, "inputTables": 3, "outputRows": 5, "outputColumns": 9}
    assert values((tmp_path / "out" / "all.xlsx").read_bytes())["Consolidated", 4, 4] == "Open"
    assert workbooks.consolidate(spark, paths, include_hidden=True).count() == 6
    with pytest.raises(LoomError) as e:
        workbooks.consolidate(spark, str(tmp_path / "out"))
    assert e.value.code == "TABLE_SOURCE_COLUMN_COLLISION"
    with pytest.raises(LoomError) as e:
        workbooks.consolidate(spark, paths, sheets=["nothing"])
    assert e.value.code == "XLSX_NO_TABLES"


def test_areas_as_tables(spark, tmp_path):
    ranges = row(1, A="Title") + row(2, A="Client", B="Region", C="Amount") + row(3, A="A", B="North", C=1) + row(4, A="B", B="South", C=2.5) + row(5, A="C", B="", C=3) + row(6, A="Total", C=6.5)
    names = "<definedName name=\"ClientRange\">'My ''Clients'!$A$2:$C$5</definedName><definedName name=\"_xlnm.Print_Area\">X!$A$1</definedName><definedName name=\"Broken\">#REF!</definedName><definedName name=\"Two\">'My ''Clients'!$A$2:$C$5,'My ''Clients'!$A$1</definedName>"
    (tmp_path / "names.xlsx").write_bytes(package([("My 'Clients", "", ranges, "A1:C6")], names=names))
    (tmp_path / "table.xlsx").write_bytes(clients())
    (only,) = workbooks.read_tables(spark, str(tmp_path), "name")
    assert (only.name, only.ref, only.columns, only.file) == ("ClientRange", "A2:C5", ["Client", "Region", "Amount"], "names.xlsx")
    assert [tuple(r) for r in only.df.orderBy("_at").collect()] == [(3, "A", "North", 1.0), (4, "B", "South", 2.5), (5, "C", "", 3.0)]
    (table,) = workbooks.read_tables(spark, str(tmp_path), "table", names=["CLIENTDATA"])
    assert [tuple(r) for r in table.df.orderBy("_at").collect()] == [(5, "A", "North", 10.0), (6, "B", "South", 20.0), (7, "C", "North", 30.0)]
    assert workbooks.read_tables(spark, str(tmp_path), "table", names=["other"]) == [] == workbooks.read_tables(spark, str(tmp_path), "table", sheets=["Cover"])
    sheets = workbooks.read_tables(spark, str(tmp_path / "names.xlsx"), header_row=2)
    assert [r["Client"] for r in sheets[0].df.orderBy("_at").collect()] == ["A", "B", "C", "Total"]
    assert workbooks.read_tables(spark, str(tmp_path / "names.xlsx"), header_row=40) == []
    with pytest.raises(LoomError) as e:
        workbooks.read_tables(spark, str(tmp_path), header_row=0)
    assert e.value.code == "XLSX_INVALID_HEADER_ROW"
    assert [h for h in workbooks.header_names(spark, str(tmp_path / "names.xlsx"), "name")] == [("names.xlsx", "ClientRange", ["Client", "Region", "Amount"])]
    assert xlsx.named_area("Sheet1!$B$3") == ("Sheet1", "B3") and xlsx.named_area("'a!b'!A1:B2,C!D1") is None


def test_merge(tmp_path):
    a = workbook_bytes([("Summary", ["x"], [(1,)]), ("Private", [7, True], [])], [0, 2])
    b = workbook_bytes([("Summary", ["z"], []), ("Sheet Index", ["q"], [])])
    out = workbooks.merge_workbooks([("a.xlsx", a), ("b.xlsx", b)], str(tmp_path / "m.xlsx"))
    content = (tmp_path / "m.xlsx").read_bytes()
    assert [s[:2] for s in Workbook(content).sheets] == [("Summary", 0), ("Private", 2), ("Summary (2)", 0), ("Sheet Index (2)", 0), ("Sheet Index", 0)]
    assert out.metrics == {"outputSheets": 4, "hiddenSheets": 1, "inputFiles": 2} and len(out.warnings) == 1
    assert values(content)["Sheet Index", 4, 3] == "Summary (2)" and values(content)["Sheet Index", 3, 4] == "Very hidden"
    assert [c[5] for c in Workbook(content).cells() if c[0] == "Private"] == ["number", "boolean"]


def operations(calculated='< s="3"><f>1+1</f><v>2</v>', extension=()):
    first = row(1, A="Title") + row(3, A="Record", B="Entity Name", C="Calculated") + row(4, A=1, B="DGE", C=calculated) + row(5, A=2, B="dge ", C=5) + row(6, A=3, B="Other") + row(7, A=4) + row(9, A="footer")
    second = row(1, A="Code", B="Amount", C="Ｅntity Name") + row(2, A="a", B=1, C=" DGE") + row(3, A="b", B=2, C="Third") + row(4, A="c", B=3)
    return package([("Operations", "", first, "A1:C9"), ("Finance", "", second, "A1:C4"), ("Cover", "veryHidden", row(1, A="Notes", B="<><f>1+1</f>"), "")], more=[("xl/calcChain.xml", "<c/>"), *extension])


def test_split_every_sheet(spark, tmp_path):
    path = tmp_path / "in.xlsm"
    path.write_bytes(operations(extension=[("xl/vbaProject.bin", b"macro")]))
    options = splits.Options("entity name")
    plan = splits.plan_split(spark, str(path), str(tmp_path / "out"), options)
    assert [os.path.basename(o.path) for o in plan.outputs] == ["DGE.xlsm", "Other.xlsm", "Third.xlsm"] and not (tmp_path / "out").exists()
    seen = []
    result = splits.split_workbook(spark, str(path), str(tmp_path / "out"), options, control=Control(lambda *x: seen.append(x[1:3])))
    assert {k: result.metrics[k] for k in ("groups", "inputRows", "outputRows", "skippedRows", "sheetsFiltered", "sheetsCopiedUnchanged")} == {"groups": 3, "inputRows": 9, "outputRows": 5, "skippedRows": 4, "sheetsFiltered": 2, "sheetsCopiedUnchanged": 1}
    assert result.outputs[0] == {"group": "DGE", "sheets": [{"sheet": "Operations", "retainedRows": 2, "deletedRows": 4}, {"sheet": "Finance", "retainedRows": 1, "deletedRows": 2}]}
    assert seen == [("staging-workbooks", 0), ("staging-workbooks", 1), ("staging-workbooks", 2), ("committing-outputs", 3)]
    dge, third = ((tmp_path / "out" / f"{n}.xlsm").read_bytes() for n in ("DGE", "Third"))
    v = values(dge)
    # the title and the gap below it stay where they are
    assert [v.get(("Operations", r, 1)) for r in range(1, 8)] == ["Title", None, "Record", "1", "2", None, None]
    assert v["Cover", 1, 1] == "Notes" and values(third)["Finance", 2, 1] == "b" and ("Operations", 4, 1) not in values(third)
    inside = zipfile.ZipFile(io.BytesIO(dge))
    assert inside.read("xl/vbaProject.bin") == b"macro" and b'<c r="C4" s="3"><f>1+1</f>' in inside.read("xl/worksheets/sheet1.xml")
    assert dge == (splits.split_workbook(spark, str(path), str(tmp_path / "out"), options, overwrite=True), (tmp_path / "out" / "DGE.xlsm").read_bytes())[1]
    for kind, code in ((options, "FILES_OUTPUT_EXISTS"), (splits.Options("nothing"), "XLSX_SPLIT_COLUMN_NOT_FOUND"), (splits.Options("Record", header_row=9), "XLSX_SPLIT_COLUMN_NOT_FOUND")):
        with pytest.raises(LoomError) as e:
            splits.split_workbook(spark, str(path), str(tmp_path / "out"), kind)
        assert e.value.code == code


def test_split_values_only(spark, tmp_path):
    path = tmp_path / "in.xlsx"
    path.write_bytes(operations())
    result = splits.split_workbook(spark, str(path), str(tmp_path / "out"), splits.Options("Entity Name", values=True))
    assert result.metrics["formulaCellsWithoutCachedValues"] == 3 and "Cover!B1" in result.warnings[-1]
    inside = zipfile.ZipFile(tmp_path / "out" / "DGE.xlsx")
    assert b"<f>" not in inside.read("xl/worksheets/sheet1.xml") and "xl/calcChain.xml" not in inside.namelist() and b"calcChain" not in inside.read("xl/_rels/workbook.xml.rels")


def test_values_workbook():
    body = row(1, A="< s=\"2\"><f>1+1</f><v>2</v>", B="< t='str'><f>\"a\"</f><v>a</v>", C="><f>NOW()</f>".replace(">", "< >", 1))
    content, count, missing = workbooks.values_workbook(package([("My Sheet", "", body, "")], more=[("xl/calcChain.xml", "<c/>")]))
    assert count == 3 and missing == ["My Sheet!C1"] and [c[5:7] for c in Workbook(content).cells()] == [("number", "2"), ("string", "a"), ("empty", None)]
    assert packages.first_shown([f"S!A{i}" for i in range(25)] + ["S!A1"]).endswith("S!A19, and 5 more")


def test_split_filenames_and_keys(spark, tmp_path):
    kinds = ["A/B", "A:B", 1, "1", "CON", "Arabic العربية", "Trailing. ", "＋1", "TRUE", "<t t='b'><v>1</v>"]
    body = row(1, A="K") + "".join(row(i, A=v if not str(v).startswith("<t") else "< t='b'><v>1</v>") for i, v in enumerate(kinds, 2))
    path = tmp_path / "in.xlsx"
    path.write_bytes(package([("S", "", body, f"A1:A{len(kinds) + 1}")]))
    split = splits.resolve(spark, str(path), str(tmp_path), splits.Options("k"))
    assert [os.path.basename(o) for o in split.outputs] == ["A-B.xlsx", "A-B-2.xlsx", "1.xlsx", "_CON.xlsx", "Arabic العربية.xlsx", "Trailing.xlsx", "+1.xlsx", "TRUE.xlsx", "true-2.xlsx"]
    strict = splits.resolve(spark, str(path), str(tmp_path), splits.Options("k", strict=True))
    assert len(strict.groups) == 10 and {g.key for g in strict.groups} >= {"number:1", "string:1", "string:TRUE", "boolean:true", "string:Trailing. "}


def test_split_one_source(spark, tmp_path):
    rows = [("a", "North", 1), ("b", "South", 2), ("c", "North", 3), ("d", None, 4), ("e", "North/West", 5), ("f", "North:West", 6), ("g", 1, 7), ("h", "1", 8)]
    path = tmp_path / "clients.xlsx"
    path.write_bytes(workbook_bytes([("Clients", ["Client", "Region", "Amount"], rows)]))
    result = splits.split_workbook(spark, str(path), str(tmp_path / "out"), splits.Options("region", sheet="CLIENTS"))
    assert [os.path.basename(a) for a in result.artifacts] == [f"clients-{n}.xlsx" for n in ("North", "South", "blank", "North-West", "North-West-2", "1", "1-2")]
    got = values((tmp_path / "out" / "clients-North.xlsx").read_bytes())
    assert [got["Clients", n, 3] for n in (1, 2, 3)] == ["Amount", "1", "3"] and ("Clients", 4, 1) not in got
    assert splits.resolve(spark, str(path), str(tmp_path), splits.Options("region", sheet="Clients", include_blank=False)).metrics["skippedRows"] == 1
    assert [n for n, _ in splits.split_bytes(spark, "c.xlsx", path.read_bytes(), splits.Options("Client", sheet="Clients", prefix="p"))][:2] == ["p-a.xlsx", "p-b.xlsx"]
    two = tmp_path / "two.xlsx"
    two.write_bytes(workbook_bytes([("A", ["K"], [("x",)]), ("B", ["K"], [("y",)])]))
    for kind, code in (
        (splits.Options("K", preserve=False), "XLSX_SPLIT_MULTIPLE_TABLES"), (splits.Options("K", sheet="C"), "XLSX_SPLIT_NO_TABLE"), (splits.Options("Z", sheet="A"), "TABLE_COLUMN_NOT_FOUND"),
        (splits.Options("K", table="t", range="r"), "XLSX_SPLIT_TABLE_RANGE_CONFLICT"), (splits.Options("K", table="t", header_row=1), "XLSX_SPLIT_TABLE_HEADER_ROW"),
        (splits.Options("K", range="t", header_row=1), "XLSX_SPLIT_RANGE_HEADER_ROW"), (splits.Options("K", sheet="A", preserve=True), "XLSX_SPLIT_PRESERVE_REQUIRES_TABLE"),
    ):
        with pytest.raises(LoomError) as e:
            splits.resolve(spark, str(two), str(tmp_path), kind)
        assert e.value.code == code


def table_ref(content):
    return re.search(rb'ref="([^"]*)"', zipfile.ZipFile(io.BytesIO(content)).read("xl/tables/table1.xml"))[1].decode()


def test_split_keeps_the_workbook_around_a_table(spark, tmp_path):
    path = tmp_path / "s.xlsx"
    path.write_bytes(clients())
    splits.split_workbook(spark, str(path), str(tmp_path / "out"), splits.Options("Region", table="clientdata"))
    north, south = ((tmp_path / "out" / f"s-{n}.xlsx").read_bytes() for n in ("North", "South"))
    assert (table_ref(north), table_ref(south)) == ("B4:D7", "B4:D6")
    v = values(north)
    assert [v.get(("Clients", r, 2)) for r in range(4, 9)] == ["Client", "A", "C", "Total", None] and v["Clients", 10, 1] == "Cells outside ClientData" and v["Clients", 6, 6] == "beside 7"
    xml = zipfile.ZipFile(io.BytesIO(north)).read("xl/worksheets/sheet2.xml").decode()
    assert '<x:c r="D6" s="6"><x:v>30</x:v>' in xml and "SUBTOTAL" in xml
    # the table is found by its header when every sheet is split, and closes up too
    splits.split_workbook(spark, str(path), str(tmp_path / "all"), splits.Options("Region"))
    assert table_ref((tmp_path / "all" / "South.xlsx").read_bytes()) == "B4:D6"
    xml, end = packages.compact_table(zipfile.ZipFile(path).read("xl/worksheets/sheet2.xml").decode(), 4, 8, [], True)
    assert end == 5 and 'r="B5"' in xml and "beside" not in xml
    original = zipfile.ZipFile(path).read("xl/worksheets/sheet2.xml").decode()
    xml, end = packages.compact_cells(original, 4, 2, 8, 4, [6], True)
    assert end == 6 and [m for m in re.findall(r'r="([A-Z]+\d+)"', xml)] == ["A1", "B4", "C4", "D4", "B5", "C5", "D5", "F5", "B6", "D6", "F6", "F7", "A10"]
    assert not packages.can_compact("<f>B4*2</f>") and packages.can_compact('<f>LOG10(2)&amp;"A1"</f>') and not packages.can_compact('<f t="shared" si="0"/>')


def test_declared_types_are_refused_in_any_encoding():
    for encoding in ("utf-8", "utf-16"):
        with pytest.raises(LoomError):
            packages.safe_xml('<?xml version="1.0"?><!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'.encode(encoding))


def test_records(spark, tmp_path):
    styles = '<numFmts><numFmt numFmtId="164" formatCode="0.0%"/><numFmt numFmtId="165" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
    body = row(1, A="name", B="percentage", C="date", D="active", E="empty", F="formula") + row(2, A="A", B='< s="1"><v>0.125</v>', C='< s="2"><v>45293</v>', D='< t="b"><v>1</v>', F='< s="1"><f>1/4</f><v>0.25</v>') + row(4, A="B", B=1)
    path = tmp_path / "r.xlsx"
    path.write_bytes(package([("Data", "", body, "A1:F4"), ("Bad", "", row(1, A="x", C="x") + row(2, A=1), "A1:C2"), ("Twice", "", row(1, A="x", B=" x") + row(2, A=1), "A1:B2")], styles=styles))
    found = workbooks.worksheet_records(spark, str(path))
    assert found.columns == ["name", "percentage", "date", "active", "empty", "formula"] and found.skipped == 1 and found.worksheet == "Data"
    assert [tuple(r) for r in found.df.orderBy("_at").collect()] == [(2, "A", "12.5%", "2024-01-02", "TRUE", "", "25.0%"), (4, "B", "1", "", "", "", "")]
    for kind, code in (({"worksheet": "bad"}, "XLSX_EMPTY_HEADER"), ({"worksheet": "twice"}, "XLSX_DUPLICATE_HEADER"), ({"worksheet": "none"}, "XLSX_WORKSHEET_NOT_FOUND"), ({"header_row": 9}, "XLSX_INVALID_HEADER_ROW")):
        with pytest.raises(LoomError) as e:
            workbooks.worksheet_records(spark, str(path), **kind)
        assert e.value.code == code


def deck(*slides_xml):
    out = io.BytesIO()
    n = range(1, len(slides_xml) + 1)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types>" + "".join(f'<Override PartName="/ppt/slides/slide{i}.xml" ContentType="{slides.SLIDE}"/>' for i in n) + "</Types>")
        z.writestr("ppt/presentation.xml", "<p:presentation><p:sldIdLst>" + "".join(f'<p:sldId id="{255 + i}" r:id="rId{i}"/>' for i in n) + "</p:sldIdLst></p:presentation>")
        z.writestr("ppt/_rels/presentation.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Type="{slides.SLIDE_LINK}" Target="slides/slide{i}.xml"/>' for i in n) + '<Relationship Id="rId9" Type="theme" Target="theme.xml"/></Relationships>')
        for i, x in enumerate(slides_xml, 1):
            z.writestr(f"ppt/slides/slide{i}.xml", f"<p:sld>{x}</p:sld>")
    return out.getvalue()


def shape(*runs):
    return "<p:sp><a:p>" + "".join(f"<a:r><a:t>{r}</a:t></a:r>" for r in runs) + "</a:p></p:sp>"


def test_slides():
    template = deck(shape("{{name}} / {{ name }}") + shape("{{reve", "nue}} &amp; more", "!"))
    content, metrics = slides.populated(template, [{"name": "A<B", "revenue": " $1 "}, {"name": "C", "revenue": "2"}])
    assert {k: metrics[k] for k in ("generatedSlides", "placeholderFields", "placeholderOccurrences", "replacements")} == {"generatedSlides": 2, "placeholderFields": 2, "placeholderOccurrences": 3, "replacements": 6}
    z = zipfile.ZipFile(io.BytesIO(content))
    first = z.read("ppt/slides/slide1.xml").decode()
    assert "A&lt;B / A&lt;B" in first and '<a:t xml:space="preserve"> $1 </a:t>' in first and "<a:t xml:space=\"preserve\"> &amp; more</a:t>" in first
    assert z.read("ppt/presentation.xml").decode().count("<p:sldId ") == 2
    assert content == slides.populated(template, [{"name": "A<B", "revenue": " $1 "}, {"name": "C", "revenue": "2"}])[0]
    bad = [
        (deck(shape("a")), "PPTX_NO_PLACEHOLDERS"), (deck(shape("{{a}} {{b}")), "PPTX_MALFORMED_PLACEHOLDER"), (deck(shape("{{a}")), "PPTX_MALFORMED_PLACEHOLDER"), (deck(shape("{{a}} {{ }}")), "PPTX_MALFORMED_PLACEHOLDER"),
        (deck(shape("{{a}}") + "<a:t>{{t}}</a:t>"), "PPTX_UNSUPPORTED_PLACEHOLDER_PLACEMENT"), (deck(shape("{{A}}")), "PPTX_MISSING_EXCEL_COLUMN"), (b"nothing", "PPTX_INVALID_TEMPLATE"),
    ]
    for content, code in bad:
        with pytest.raises(LoomError) as e:
            slides.populated(content, [{"a": "1"}])
        assert e.value.code == code
    for number, code in ((0, "PPTX_INVALID_TEMPLATE_SLIDE"), (3, "PPTX_TEMPLATE_SLIDE_NOT_FOUND")):
        with pytest.raises(LoomError) as e:
            slides.inspect(template, number)
        assert e.value.code == code
    found = slides.inspect(deck(shape("x"), shape("{{client_name}} / {{ client_name }}") + shape("{{reve", "nue}}") + shape("{{growth_rate}") + "<a:t>{{table_value}}</a:t>"), 2)
    assert (found.fields, found.occurrences, found.malformed, found.elsewhere) == ({"client_name": 2, "revenue": 1}, 3, 1, ("table_value",))
    assert slides.decoded("&#65;&#x42;&amp;lt; &unknown; &lt;") == "AB&lt; &unknown; <"


def test_populate_from_a_workbook(spark, tmp_path):
    (tmp_path / "t.pptx").write_bytes(deck(shape("{{client}}: {{n}}")))
    (tmp_path / "d.xlsx").write_bytes(package([("D", "", row(1, A="client", B="n") + row(2, A="A", B=1) + row(4, A="B", B=2.5), "A1:B4")]))
    template, data, output = (str(tmp_path / n) for n in ("t.pptx", "d.xlsx", "o.pptx"))
    plan = slides.plan_populate(spark, template, output, workbook=data)
    assert plan.metrics["generatedSlides"] == 2 and plan.warnings == ("Skipped 1 empty row.",) and not os.path.exists(output)
    result = slides.populate(spark, template, output, workbook=data)
    assert result.metrics["replacements"] == 4 and b"B: 2.5" in zipfile.ZipFile(output).read("ppt/slides/slide2.xml")
    for kind, code in (({"workbook": data}, "FILES_OUTPUT_EXISTS"), ({"workbook": data, "records": []}, "PPTX_INVALID_DATA_SOURCE"), ({"records": []}, "PPTX_NO_DATA_ROWS"), ({"workbook": "none.xlsx"}, "XLSX_WORKBOOK_NOT_FOUND")):
        with pytest.raises(LoomError) as e:
            slides.populate(spark, template, output, **kind)
        assert e.value.code == code
    with pytest.raises(LoomError) as e:
        slides.populate(spark, template, template, overwrite=True, records=[{"client": "x"}])
    assert e.value.code == "FILES_INPUT_OVERWRITE"
