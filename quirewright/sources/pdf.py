"""Plain text of PDF files, in pure Python, for machines without a PDF library.

It reads objects (also those in object streams), Flate and uncompressed streams, the page tree, and
the text operators of page contents, with ToUnicode tables where fonts have them and Latin-1 where
not. Lines follow the text positions. Encrypted files and other filters are errors.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\([^()]*\))*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()%]*|\[|\]|[-+]?\d*\.?\d+|[A-Za-z'\"*]+\d?|%[^\r\n]*", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


class PdfError(ValueError):
    """The file can't be read."""


@dataclass
class Document:
    """Objects by number: the dictionary's source, and the decoded stream, if there is one."""

    bodies: dict[int, bytes] = field(default_factory=dict)
    streams: dict[int, bytes] = field(default_factory=dict)

    def value(self, body: bytes, key: str) -> bytes:
        """What follows a key of a dictionary, references resolved; b'' without the key."""
        m = re.search(rb"/" + key.encode() + rb"(?![A-Za-z0-9])\s*", body)
        if not m:
            return b""
        rest = body[m.end() :]
        ref = _REF.match(rest)
        return self.bodies.get(int(ref[1]), b"") if ref else rest


def _unescape(s: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c[:1].isdigit() and c[:1] < b"8" else _PLAIN.get(c, c)

    return _ESCAPE.sub(one, s)


def read(content: bytes) -> Document:
    """The objects of a file."""
    if not content.lstrip()[:5] == b"%PDF-":
        raise PdfError("not a PDF file")
    if re.search(rb"/Encrypt\s+\d", content):
        raise PdfError("the file is encrypted")
    doc = Document()
    at = 0
    while m := _OBJECT.search(content, at):
        number, begin = int(m[1]), m.end()
        end = content.find(b"endobj", begin)
        end = len(content) if end < 0 else end
        stream = re.search(rb"stream\r?\n", content[begin:end])
        body = content[begin : begin + stream.start()] if stream else content[begin:end]
        at = end + 6
        if stream:
            data = begin + stream.end()
            length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", body)
            stop = data + int(length[1]) if length else -1
            if stop < 0 or content[stop : stop + 12].lstrip()[:9] != b"endstream":
                stop = content.find(b"endstream", data)
            raw = content[data:stop]
            at = max(at, content.find(b"endobj", stop) + 6)
            if b"/FlateDecode" in body:
                try:
                    raw = zlib.decompressobj().decompress(raw)
                except zlib.error as e:
                    raise PdfError(f"object {number}: {e}") from e
            doc.streams[number] = raw
        doc.bodies[number] = body
    for number, body in list(doc.bodies.items()):
        if re.search(rb"/Type\s*/ObjStm", body) and number in doc.streams:
            data, n, first = doc.streams[number], *(int(re.search(rb"/" + k + rb"\s+(\d+)", body)[1]) for k in (b"N", b"First"))
            head = [int(x) for x in data[:first].split()[: 2 * n]]
            offsets = [*head[1::2], len(data) - first]
            for i, inner in enumerate(head[::2]):
                doc.bodies.setdefault(inner, data[first + offsets[i] : first + offsets[i + 1]])
    return doc


def _pages(doc: Document) -> list[int]:
    """The numbers of the pages, in order."""
    root = next((b for b in doc.bodies.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
    top = re.search(rb"/Pages\s+(\d+)", root)
    out: list[int] = []
    seen: set[int] = set()

    def walk(n: int) -> None:
        if n in seen or n not in doc.bodies:
            return
        seen.add(n)
        body = doc.bodies[n]
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if kids:
            for r in _REF.finditer(kids[1]):
                walk(int(r[1]))
        else:
            out.append(n)

    if top:
        walk(int(top[1]))
    return out or [n for n, b in sorted(doc.bodies.items()) if re.search(rb"/Type\s*/Page(?![A-Za-z])", b)]


def _unicode_table(data: bytes) -> dict[bytes, str]:
    """Codes of a ToUnicode table and their texts."""
    text = lambda h: bytes.fromhex(re.sub(rb"\s", b"", h).decode()).decode("utf-16-be", "replace")
    out: dict[bytes, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]*)>", block):
            out[bytes.fromhex(a.decode())] = text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            for i in range(min(65_536, int(b, 16) - int(a, 16) + 1)):
                out[(int(a, 16) + i).to_bytes(len(a) // 2, "big")] = chr(int(c, 16) + i) if len(c) <= 4 else text(c)
    return out


def _decoded(s: bytes, table: dict[bytes, str]) -> str:
    if not table:
        return s.decode("latin-1")
    width = len(next(iter(table)))
    return "".join(table.get(s[i : i + width], "") for i in range(0, len(s), width))


def _text(data: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    """The text that page contents show; a new line where the position moves down."""
    out: list[str] = []
    stack: list[bytes] = []
    table: dict[bytes, str] = {}
    inside = 0
    parts: list[bytes] = []

    def show(items: list[bytes]) -> None:
        for t in items:
            if t[:1] == b"(":
                out.append(_decoded(_unescape(t[1:-1]), table))
            elif t[:1] == b"<" and t[:2] != b"<<":
                h = re.sub(rb"\s", b"", t[1:-1])
                out.append(_decoded(bytes.fromhex((h + b"0" * (len(h) % 2)).decode()), table))
            elif t[:1] in b"-+.0123456789" and float(t) < -180:
                out.append(" ")  # a wide step back inside an array is a space

    def line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    for m in _TOKEN.finditer(data):
        t = m[0]
        if t == b"[":
            inside, parts = 1, []
        elif t == b"]":
            inside = 0
        elif inside:
            parts.append(t)
        elif t[:1] in b"(</-+.0123456789":
            stack.append(t)
        else:
            if t == b"Tf" and len(stack) > 1:
                table = fonts.get(stack[-2][1:], {})
            elif t == b"TJ":
                show(parts)
            elif t in (b"Tj", b"'", b'"'):
                if t != b"Tj":
                    line()
                show(stack[-1:])
            elif t in (b"T*", b"Tm", b"ET") or t in (b"Td", b"TD") and len(stack) > 1 and float(stack[-1]) != 0:
                line()
            elif t in (b"Td", b"TD") and out and not out[-1].endswith((" ", "\n")):
                out.append(" ")
            stack = []
    return "".join(out).strip("\n")


def decode_pdf(content: bytes) -> tuple[list[str], dict[str, str]]:
    """Pages and metadata of a PDF file."""
    doc = read(content)
    pages = []
    for n in _pages(doc):
        body = doc.bodies[n]
        resources = doc.value(body, "Resources")
        fonts = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", doc.value(resources, "Font").split(b">>")[0]):
            table = re.search(rb"/ToUnicode\s+(\d+)", doc.bodies.get(int(number), b""))
            fonts[name] = _unicode_table(doc.streams.get(int(table[1]), b"")) if table else {}
        where = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", body, re.S)
        parts = [doc.streams.get(int(r[1]), b"") for r in _REF.finditer(where[1])] if where else []
        pages.append(_text(b"\n".join(parts), fonts))
    info = {}
    number = re.search(rb"/Info\s+(\d+)", content) or next((m for s in doc.bodies.values() if (m := re.search(rb"/Info\s+(\d+)", s))), None)
    if number:
        for key, value in re.findall(rb"/([A-Za-z]+)\s*(\((?:[^()\\]|\\.)*\))", doc.bodies.get(int(number[1]), b""), re.S):
            s = _unescape(value[1:-1])
            info[key.decode().lower()] = s[2:].decode("utf-16-be", "replace") if s[:2] == b"\xfe\xff" else s.decode("latin-1")
    return pages, info
