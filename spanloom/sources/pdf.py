"""A plain PDF in and out, without a library: text in the standard encoding of Western languages.

Written: pages of wrapped lines in a fixed-width font. Read: pages in the order of the page tree, with the strings that their content
streams show, streams plain or deflated. Fonts with an encoding of their own need another reader; a file whose
text can't be read for certain is refused, never read as something else.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

LINE_WIDTH, LINES_OF_PAGE = 95, 62
ENCODING = "cp1252"

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.DOTALL)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_REFERENCE = rb"(\d+)\s+\d+\s+R"
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[^\s/<>\[\]()]+", re.DOTALL)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.DOTALL)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


def wrapped(text: str, width: int = LINE_WIDTH) -> list[str]:
    """Lines of at most `width` characters, cut at blanks where a line has one; nothing but the blanks at cuts is lost."""
    out = []
    for line in text.split("\n"):
        while len(line) > width:
            at = line.rfind(" ", 1, width + 1)
            out.append(line[: at if at > 0 else width])
            line = line[at + 1 :] if at > 0 else line[width:]
        out.append(line)
    return out


def pdf_bytes(text: str) -> bytes:
    """A4 pages of LINES_OF_PAGE wrapped lines. A character that the encoding lacks raises ValueError."""
    try:
        lines = [line.encode(ENCODING) for line in wrapped(text)]
    except UnicodeEncodeError as wrong:
        raise ValueError(f"a PDF in {ENCODING} has no {text[wrong.start : wrong.end] or wrong.object[wrong.start : wrong.end]!r}; write text or DOCX") from None
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
    kids = []
    for k in range(0, len(lines), LINES_OF_PAGE):
        shown = b" T* ".join(b"(" + re.sub(rb"([\\()])", rb"\\\1", line.replace(b"\r", b"\\r")) + b") Tj" for line in lines[k : k + LINES_OF_PAGE])
        stream = b"BT /F1 9 Tf 12 TL 40 800 Td " + shown + b" ET"
        objects.append(b"<< /Length %d >>\nstream\n%b\nendstream" % (len(stream), stream))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % len(objects))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Kids [%b] /Count %d >>" % (b" ".join(kids), len(kids))
    out, places = b"%PDF-1.4\n", []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%b\nendobj\n" % (k, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%btrailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, table, len(objects) + 1, len(out))


def _string(token: bytes) -> str:
    if token.startswith(b"<"):
        raw = bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode().ljust(2, "0"))
    else:
        raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] < b"8" else _NAMED.get(m[1], m[1]), token[1:-1])
    return raw.decode(ENCODING, "replace")


def _shown(content: bytes) -> str:
    """Text of a content stream: strings shown, a new line where the position moves to one."""
    out, held, numbers = [], [], []
    for token in _TOKEN.findall(content):
        if token[:1] in b"(<":
            held.append(_string(token))
        elif token in (b"Tj", b"TJ"):
            out += held
            held = []
        elif token in (b"'", b'"'):
            out += ["\n", *held]
            held = []
        elif token == b"T*" or (token in (b"Td", b"TD") and out and numbers and numbers[-1] != 0):
            out.append("\n")
            held = []
        elif token not in (b"[", b"]") and not token.startswith(b"/") and not re.fullmatch(rb"[-+.\d]+", token):
            held = []
        numbers = [*numbers[-1:], float(token)] if re.fullmatch(rb"[-+]?\d*\.?\d+", token) else numbers if token in (b"[", b"]") else []
    return "".join(out)


def pdf_pages(data: bytes) -> list[str]:
    """Text of each page. ValueError where the file isn't plain enough to be read for certain."""
    if not data.startswith(b"%PDF"):
        raise ValueError("no PDF")
    if b"/Encrypt" in data or b"/ObjStm" in data:
        raise ValueError("an encrypted or packed PDF needs a reader of PDF")
    objects = {int(n): body for n, body in _OBJECT.findall(data)}
    if any(b"/Type0" in body or b"/Differences" in body or b"/Identity-H" in body for body in objects.values()):
        raise ValueError("a PDF with fonts of their own encoding needs a reader of PDF")

    def contents(page: bytes) -> Iterator[bytes]:
        found = re.search(rb"/Contents\s*(?:\[([^\]]*)\]|" + _REFERENCE + rb")", page)
        for number in re.findall(_REFERENCE, found[1]) if found and found[1] is not None else [found[2]] if found else []:
            body = objects[int(number)]
            stream = _STREAM.search(body)
            if stream is None:
                raise ValueError("a page without a content stream")
            filters = re.findall(rb"/(\w+Decode)", body[: stream.start()])
            if filters not in ([], [b"FlateDecode"]):
                raise ValueError(f"content packed as {filters}")
            yield zlib.decompress(stream[1]) if filters else stream[1]

    def pages(number: int, depth: int = 0) -> Iterator[bytes]:
        node = objects.get(number, b"")
        kids = re.search(rb"/Kids\s*\[([^\]]*)\]", node)
        if kids is None:
            yield node
        elif depth < 50:
            for kid in re.findall(_REFERENCE, kids[1]):
                yield from pages(int(kid), depth + 1)

    root = next((re.search(rb"/Pages\s+" + _REFERENCE, body) for body in objects.values() if re.search(rb"/Type\s*/Catalog\b", body)), None)
    if root is None:
        raise ValueError("a PDF without a page tree")
    return ["".join(_shown(c) for c in contents(page)).removeprefix("\n") for page in pages(int(root[1]))]
