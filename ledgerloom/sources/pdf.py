"""PDF documents: their pages as objects, and new documents made of some of them. Plain and compressed object streams; encrypted files are refused."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from ..errors import LoomError

#: Texts in brackets or angles, where nothing is a reference, or a reference itself.
TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\([^()]*\))*\))*\)|<[0-9A-Fa-f\s]*>(?!>)|(?<![\w.])(\d+)\s+(\d+)\s+R(?!\w)", re.S)
OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
#: Page attributes that come from the page tree where a page has none.
INHERITED = (b"Resources", b"MediaBox", b"CropBox", b"Rotate")


@dataclass
class Pdf:
    """Objects by number: (the object without its stream, the stream or None); page numbers in order."""

    objects: dict[int, tuple[bytes, bytes | None]]
    pages: list[int]


def _entry(body: bytes, key: bytes) -> bytes | None:
    """The value of a key at the top level of a dictionary, as it is written."""
    depth, at = 0, 0
    part = re.compile(rb"\((?:[^()\\]|\\.)*\)|<<|>>|\[|\]|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()]*|[^\s/<>\[\]()]+", re.S)
    tokens = list(part.finditer(body))
    for i, m in enumerate(tokens):
        t = m[0]
        if t in (b"<<", b"["):
            depth += 1
        elif t in (b">>", b"]"):
            depth -= 1
        elif depth == 1 and t == b"/" + key and not (i and at == i):
            level = 0
            for j in range(i + 1, len(tokens)):
                u = tokens[j][0]
                level += (u in (b"<<", b"[")) - (u in (b">>", b"]"))
                if level < 0:
                    return body[m.end() : tokens[j].start()].strip()
                if level == 0:
                    if u.isdigit() and j + 2 < len(tokens) and tokens[j + 1][0].isdigit() and tokens[j + 2][0] == b"R":
                        return b" ".join(tokens[k][0] for k in range(j, j + 3))
                    return body[tokens[i + 1].start() : tokens[j].end()]
    return None


def _number(value: bytes | None) -> int | None:
    m = re.fullmatch(rb"(\d+)\s+\d+\s+R", value or b"")
    return int(m[1]) if m else None


def parse_pdf(content: bytes, name: str = "") -> Pdf:
    """The newest version of each object, wherever it stands in the file."""
    error = LoomError("PDF_READ_FAILED", f"Could not read PDF: {name}", {"source": name})
    if b"%PDF-" not in content[:1024]:
        raise error
    objects: dict[int, tuple[bytes, bytes | None]] = {}
    at = 0
    while m := OBJECT.search(content, at):
        end = content.find(b"endobj", m.end())
        stream = re.compile(rb"stream\r?\n").search(content, m.end(), end if end >= 0 else len(content))
        if stream and b">>" in content[m.end() : stream.start()]:
            head = content[m.end() : stream.start()].strip()
            length = _entry(head, b"Length")
            size = int(length) if length and length.isdigit() else None
            if size is None or content[stream.end() + size : stream.end() + size + 20].strip()[:9] != b"endstream":
                stop = content.find(b"endstream", stream.end())
                if stop < 0:
                    raise error
                size = stop - stream.end()
                data = re.sub(rb"\r?\n$", b"", content[stream.end() : stream.end() + size])
            else:
                data = content[stream.end() : stream.end() + size]
            objects[int(m[1])] = (head, data)
            at = content.find(b"endobj", stream.end() + size)
        else:
            if end < 0:
                raise error
            objects[int(m[1])] = (content[m.end() : end].strip(), None)
            at = end
        if at < 0:
            break
        at += 6
    trailers = [content[m.end() :] for m in re.finditer(rb"trailer\s*(?=<<)", content)] + [h for h, s in objects.values() if s is not None and _entry(h, b"Type") == b"/XRef"]
    if any(_entry(t, b"Encrypt") for t in trailers):
        raise error
    for head, data in list(objects.values()):
        if data is not None and _entry(head, b"Type") == b"/ObjStm":
            try:
                plain = zlib.decompress(data) if b"FlateDecode" in head else data
                first, n = int(_entry(head, b"First")), int(_entry(head, b"N"))
                places = list(map(int, plain[:first].split()))[: 2 * n]
            except (zlib.error, ValueError, TypeError) as cause:
                raise error from cause
            starts = places[1::2] + [len(plain) - first]
            for i, number in enumerate(places[::2]):
                objects.setdefault(number, (plain[first + starts[i] : first + starts[i + 1]].strip(), None))
    roots = [r for t in reversed(trailers) if (r := _number(_entry(t, b"Root"))) in objects]
    root = roots[0] if roots else next((n for n, (h, _) in objects.items() if _entry(h, b"Type") == b"/Catalog"), None)
    if root is None:
        raise error
    pages: list[int] = []

    def walk(number: int, given: dict[bytes, bytes], seen: frozenset[int]) -> None:
        if number not in objects or number in seen:
            return
        head, _ = objects[number]
        own = given | {k: v for k in INHERITED if (v := _entry(head, k)) is not None}
        if (kids := _entry(head, b"Kids")) is not None:
            if _number(kids) in objects:
                kids = objects[_number(kids)][0]
            for k in re.findall(rb"(\d+)\s+\d+\s+R", kids):
                walk(int(k), own, seen | {number})
            return
        missing = b"".join(b"/" + k + b" " + v + b" " for k, v in own.items() if _entry(head, k) is None)
        objects[number] = (re.sub(rb"^<<", lambda _: b"<<" + missing, head), None)
        pages.append(number)

    walk(_number(_entry(objects[root][0], b"Pages")) or -1, {}, frozenset())
    return Pdf(objects, pages)


def _renumbered(body: bytes, numbers: dict[int, int]) -> bytes:
    def one(m: re.Match) -> bytes:
        if m[1] is None:
            return m[0]
        return b"%d 0 R" % numbers[int(m[1])] if int(m[1]) in numbers else b"null"

    return TOKEN.sub(one, body)


def document(pages: list[tuple[Pdf, int]]) -> bytes:
    """A new document of pages (document, place from 0) in order, with what they refer to; the same pages give the same bytes."""
    out: list[tuple[bytes, bytes | None]] = [(b"", None), (b"", None)]  # 1: catalogue, 2: page tree
    known: dict[int, dict[int, int]] = {}
    kids = []
    for pdf, place in pages:
        numbers = known.setdefault(id(pdf), {})
        page = pdf.pages[place]
        own = dict(numbers)
        own.pop(page, None)
        new = len(out) + 1  # a page that is taken twice is two pages
        out.append((b"", None))
        own[page] = new
        kids.append(new)
        tree = {n for n, (h, _) in pdf.objects.items() if _entry(h, b"Type") in (b"/Pages", b"/Catalog")} | set(pdf.pages) - {page}
        waiting = [page]
        found = [page]
        while waiting:
            body = pdf.objects[waiting.pop()][0]
            for m in TOKEN.finditer(body):
                if m[1] is not None and (n := int(m[1])) in pdf.objects and n not in own and n not in tree:
                    own[n] = numbers[n] = len(out) + 1
                    out.append((b"", None))
                    waiting.append(n)
                    found.append(n)
        for n in found:
            head, data = pdf.objects[n]
            if n == page:
                parent = _entry(head, b"Parent")
                head = re.sub(rb"/Parent\s*" + re.escape(parent), b"", head) if parent else head
                body = re.sub(rb"^<<", b"<</Parent 2 0 R ", _renumbered(head, own))
            else:
                body = _renumbered(head, own)
            if data is not None:
                length = _entry(body, b"Length")
                body = re.sub(rb"/Length\s*" + re.escape(length), b"/Length %d" % len(data), body, count=1) if length else body
            out[own[n] - 1] = (body, data)
    out[0] = (b"<</Type /Catalog /Pages 2 0 R>>", None)
    out[1] = (b"<</Type /Pages /Count %d /Kids [%s]>>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids)), None)
    content, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
    for number, (body, data) in enumerate(out, 1):
        places.append(len(content))
        content += b"%d 0 obj\n" % number + body + (b"\nstream\n" + data + b"\nendstream" if data is not None else b"") + b"\nendobj\n"
    start = len(content)
    content += b"xref\n0 %d\n0000000000 65535 f \n" % (len(out) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    content += b"trailer\n<</Size %d /Root 1 0 R /Info <</Producer (ledgerloom) /CreationDate (D:19800101000000Z)>>>>\nstartxref\n%d\n%%%%EOF\n" % (len(out) + 1, start)
    return bytes(content)
