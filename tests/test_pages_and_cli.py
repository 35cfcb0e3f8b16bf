import json
import os
import zlib

import pytest
from tests.test_documents import clients, deck, package, row, shape

from ledgerloom import cli
from ledgerloom.errors import LoomError
from ledgerloom.functions import messages
from ledgerloom.operators import pages
from ledgerloom.plans.control import Control, OperationResult
from ledgerloom.sources.pdf import document, parse_pdf
from ledgerloom.sources.xlsx import workbook_bytes


def pdf(n, packed=False, first=0):
    """A PDF of n pages, each (300 + 100 i) wide; packed: its objects in a compressed stream."""
    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(n))
    plain = {1: "<</Type /Catalog /Pages 2 0 R /Note (10 0 R is no reference)>>", 2: f"<</Type /Pages /Kids [{kids}] /Count {n} /MediaBox [0 0 9 9] /Resources <</Font <</F1 3 0 R>>>>>>", 3: "<</Type /Font /BaseFont /Helvetica /Subtype /Type1>>"}
    streams = {}
    for i in range(n):
        box = "" if i == 2 else f"/MediaBox [0 0 {300 + 100 * (i + first)} {400 + 100 * (i + first)}]"
        plain[10 + 2 * i] = f"<</Type /Page /Parent 2 0 R {box} /Contents {11 + 2 * i} 0 R>>"
        streams[11 + 2 * i] = f"BT (page {i + first}) Tj ET endobj 5 0 obj".encode()
    out = b"%PDF-1.5\n"
    if packed:
        bodies = [(k, v.encode()) for k, v in plain.items()]
        heads, at = [], 0
        for k, v in bodies:
            heads.append(f"{k} {at}")
            at += len(v) + 1
        head = " ".join(heads).encode() + b" "
        data = zlib.compress(head + b"\n".join(v for _, v in bodies))
        out += b"90 0 obj\n<</Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d>>\nstream\n" % (len(bodies), len(head), len(data)) + data + b"\nendstream\nendobj\n"
        out += b"91 0 obj\n<</Type /XRef /Root 1 0 R /Size 99 /Length 0>>\nstream\n\nendstream\nendobj\n"
    else:
        out += "".join(f"{k} 0 obj\n{v}\nendobj\n" for k, v in plain.items()).encode()
    out += b"".join(b"%d 0 obj\n<</Length %d>>\nstream\n" % (k, len(v)) + v + b"\nendstream\nendobj\n" for k, v in streams.items())
    return out + (b"" if packed else b"trailer\n<</Root 1 0 R /Size 99>>\n") + b"%%EOF"


def boxes(content):
    found = parse_pdf(content)
    return [found.objects[p][0].split(b"/MediaBox [")[1].split(b"]")[0].decode() for p in found.pages]


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_split_and_merge(tmp_path, packed):
    path = tmp_path / "source.pdf"
    path.write_bytes(pdf(3, packed))
    plan = pages.plan_split_pdf(str(path), str(tmp_path / "out"))
    assert [os.path.basename(o.path) for o in plan.outputs] == [f"source-page-00{i}.pdf" for i in (1, 2, 3)] and not (tmp_path / "out").exists()
    seen = []
    result = pages.split_pdf(str(path), str(tmp_path / "out"), control=Control(lambda *x: seen.append(x[1:4])))
    assert result.metrics == {"inputFiles": 1, "outputFiles": 3, "pages": 3} and seen[2] == ("writing-pages", 2, 3)
    merged = str(tmp_path / "m.pdf")
    assert pages.merge_pdfs([*result.artifacts, result.artifacts[0]], merged).metrics["pages"] == 4
    content = open(merged, "rb").read()
    assert boxes(content) == ["0 0 300 400", "0 0 400 500", "0 0 9 9", "0 0 300 400"]
    found = parse_pdf(content)
    texts = [found.objects[int(found.objects[p][0].split(b"/Contents ")[1].split()[0])][1] for p in found.pages]
    assert [t[:10] for t in texts] == [b"BT (page 0", b"BT (page 1", b"BT (page 2", b"BT (page 0"]
    assert all(b"/Font" in found.objects[p][0] for p in found.pages) and content.count(b"/Helvetica") <= 4
    assert content == document([(parse_pdf(open(a, "rb").read()), 0) for a in [*result.artifacts, result.artifacts[0]]])
    with pytest.raises(LoomError) as e:
        pages.split_pdf(str(path), str(tmp_path / "out"))
    assert e.value.code == "FILES_OUTPUT_EXISTS"
    made = pages.split_pdf_bytes("a" * 300 + ".pdf", path.read_bytes())
    assert made[1][0] == "a" * 80 + "-page-002.pdf" and boxes(pages.merge_pdfs_bytes(made)) == ["0 0 300 400", "0 0 400 500", "0 0 9 9"]


def test_pdf_errors_and_catalogue(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf(2))
    (tmp_path / "none.pdf").write_bytes(pdf(0))
    (tmp_path / "bad.pdf").write_bytes(b"no pdf")
    (tmp_path / "locked.pdf").write_bytes(pdf(1).replace(b"/Size 99", b"/Encrypt 7 0 R /Size 99"))
    got = {os.path.basename(r["file"]): (r["pages"], r["code"]) for r in pages.page_catalogue(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": (2, None), "none.pdf": (0, None), "bad.pdf": (0, "PDF_READ_FAILED"), "locked.pdf": (0, "PDF_READ_FAILED")}
    files = spark.createDataFrame([("cli*ent<>secret.pdf", bytearray(pdf(2))), ("CON.pdf", bytearray(pdf(1)))], "path string, content binary")
    assert sorted(r["name"] for r in pages.split_documents(files).collect()) == ["_CON-page-001.pdf", "cli-ent-secret-page-001.pdf", "cli-ent-secret-page-002.pdf"]
    for call, code in ((lambda: pages.split_pdf(str(tmp_path / "none.pdf"), str(tmp_path)), "PDF_NO_PAGES"), (lambda: pages.merge_pdfs([], "x"), "PDF_NO_INPUTS"), (lambda: pages.split_pdf("missing.pdf", "x"), "PDF_READ_FAILED"), (lambda: pages.merge_pdfs([str(tmp_path / "a.pdf")], str(tmp_path / "a.pdf"), True), "FILES_INPUT_OVERWRITE")):
        with pytest.raises(LoomError) as e:
            call()
        assert e.value.code == code


def run(capsys, *argv):
    code = cli.main([*map(str, argv)])
    out, err = capsys.readouterr()
    return code, out, err


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xlsx").write_bytes(workbook_bytes([("A", ["K", "V"], [("x", 1), ("y", 2)])]))
    (tmp_path / "in" / "b.xlsx").write_bytes(workbook_bytes([("B", ["k", "W"], [("z", 3)])]))
    code, out, _ = run(capsys, "sheets", "consolidate", tmp_path / "in", "-o", tmp_path / "all.xlsx", "--json")
    assert code == 0 and out.count("\n") == 1
    assert json.loads(out)["result"]["metrics"] == {"inputFiles": 2, "inputTables": 2, "outputColumns": 6, "outputRows": 3}
    code, out, err = run(capsys, "sheets", "consolidate", tmp_path / "in", "-o", tmp_path / "all.xlsx", "--json")
    assert code == 1 and out == err and json.loads(out)["error"]["code"] == "FILES_OUTPUT_EXISTS"
    code, out, err = run(capsys, "sheets", "merge", tmp_path / "in" / "*.xlsx", "-o", tmp_path / "m.xlsx")
    assert code == 0 and "2 worksheets of 2 workbooks" in out and str(tmp_path / "m.xlsx") in out
    code, out, _ = run(capsys, "sheets", "split", tmp_path / "in" / "a.xlsx", "-c", "k", "--dry-run")
    assert code == 0 and "nothing was written" in out and not (tmp_path / "in" / "a-split").exists()
    assert run(capsys, "sheets", "split", tmp_path / "in" / "a.xlsx", "-c", "k")[0] == 0 and sorted(os.listdir(tmp_path / "in" / "a-split")) == ["x.xlsx", "y.xlsx"]
    code, out, err = run(capsys, "sheets", "split", tmp_path / "in" / "a.xlsx", "-c", "missing")
    assert code == 1 and not out and "header" in err
    (tmp_path / "t.pptx").write_bytes(deck(shape("{{K}} {{V}}")))
    assert run(capsys, "pptx", "inspect-template", tmp_path / "t.pptx")[1].startswith("K: 1\nV: 1\n")
    code, out, _ = run(capsys, "pptx", "populate", "--template", tmp_path / "t.pptx", "--data", tmp_path / "in" / "a.xlsx", "-o", tmp_path / "o.pptx", "--json")
    assert code == 0 and json.loads(out)["result"]["metrics"]["generatedSlides"] == 2
    (tmp_path / "p.pdf").write_bytes(pdf(2))
    assert run(capsys, "pdf", "split", tmp_path / "p.pdf")[0] == 0 and len(os.listdir(tmp_path / "p-pages")) == 2
    assert run(capsys, "pdf", "merge", tmp_path / "p-pages", "-o", tmp_path / "q.pdf")[0] == 0 and len(boxes((tmp_path / "q.pdf").read_bytes())) == 2
    code, out, err = run(capsys, "sheets", "split", "--unknown", "--json")
    assert code == 1 and json.loads(out)["error"]["code"] == "CLI_USAGE"
    assert run(capsys, "pdf", "merge", tmp_path / "nowhere", "-o", "x")[0] == 1
    (tmp_path / "s.xlsx").write_bytes(clients())
    assert run(capsys, "sheets", "split", tmp_path / "s.xlsx", "-c", "Region", "--table", "ClientData", "-o", tmp_path / "t", "--json")[0] == 0
    assert sorted(os.listdir(tmp_path / "t")) == ["s-North.xlsx", "s-South.xlsx"]


def test_messages():
    assert messages.quantity(1, "row") == "1 row" and messages.quantity(1234, "row") == "1,234 rows"
    assert messages.skipped_rows(2, "Region") == 'Skipped 2 rows with blank values in "Region".'
    assert "3 pages became 3 documents." in messages.told(OperationResult("pdf.split", ("a",), ("w",), {"pages": 3, "outputFiles": 3}))
    assert "--force" in messages.recovery(LoomError("FILES_OUTPUT_EXISTS", ""), messages.CLI) and "{{name}}" in messages.recovery(LoomError("PPTX_MALFORMED_PLACEHOLDER", ""))
    assert messages.recovery(LoomError("SOMETHING", "")).startswith("See")
    assert messages.artifact_label("application/pdf") == "PDF document" and messages.artifact_label("x") == "File"
    assert package([("A", "", row(1, A="x"), "")])
