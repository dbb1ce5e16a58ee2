"""PDF files as objects: what merging needs of the format, reading and writing.

``page_objects`` gives the pages of a file with all that they refer to, numbered
anew from 1 on; inherited page attributes are moved into the pages. Cross-reference tables,
cross-reference streams, hybrids and object streams are read; encrypted and damaged files are errors.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

_SPACE = b"\x00\t\n\x0c\r "
_STOP = _SPACE + b"()<>[]{}/%"
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_REF = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_BEGIN = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+obj")
_STREAM = re.compile(rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*[\r\n])*stream(?:\r\n|\n|\r)")
#: Attributes that a page has from the nodes above it.
INHERITED = (b"/Resources", b"/MediaBox", b"/CropBox", b"/Rotate")
#: What stands for the new root of the pages in the references of ``page_objects``.
PARENT = 0


class PdfError(ValueError):
    pass


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    head: dict
    data: bytes


def _skip(data: bytes, at: int) -> int:
    while at < len(data):
        if data[at] in _SPACE:
            at += 1
        elif data[at : at + 1] == b"%":
            ends = [x for x in (data.find(b"\n", at), data.find(b"\r", at)) if x >= 0]
            at = min(ends) + 1 if ends else len(data)
        else:
            break
    return at


def _literal(data: bytes, at: int) -> int:
    """Where the string that begins at ``at`` ends."""
    depth = 0
    while at < len(data):
        c = data[at]
        if c == 0x5C:
            at += 1
        elif c == 0x28:
            depth += 1
        elif c == 0x29:
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    raise PdfError("a string does not end")


def value(data: bytes, at: int) -> tuple[object, int]:
    """The value at a place and where it ends: dict, list, Ref, int, or bytes as they stand (names, strings, other numbers, keywords)."""
    at = _skip(data, at)
    two = data[at : at + 2]
    if two == b"<<":
        out, at = {}, _skip(data, at + 2)
        while data[at : at + 2] != b">>":
            if data[at : at + 1] != b"/":
                raise PdfError("a dictionary without a key")
            key, at = value(data, at)
            out[key], at = value(data, at)
            at = _skip(data, at)
        return out, at + 2
    if two[:1] == b"[":
        items, at = [], _skip(data, at + 1)
        while data[at : at + 1] != b"]":
            item, at = value(data, at)
            items.append(item)
            at = _skip(data, at)
        return items, at + 1
    if two[:1] == b"(":
        end = _literal(data, at)
    elif two[:1] == b"<":
        end = data.find(b">", at) + 1
    else:
        if ref := _REF.match(data, at):
            return Ref(int(ref[1])), ref.end()
        end = at + 1 if two[:1] == b"/" else at
        while end < len(data) and data[end] not in _STOP:
            end += 1
    if end <= at:
        raise PdfError(f"no value at byte {at}")
    word = data[at:end]
    return (int(word) if word.isdigit() else word), end


def _decoded(stream: Stream) -> bytes:
    """The data of a cross-reference or object stream."""
    filters = stream.head.get(b"/Filter", [])
    parms = stream.head.get(b"/DecodeParms", {})
    data = stream.data
    for f in filters if isinstance(filters, list) else [filters]:
        if f != b"/FlateDecode":
            raise PdfError(f"a filter that is not read: {f!r}")
        data = zlib.decompressobj().decompress(data)
    parms = parms[0] if isinstance(parms, list) and parms else parms
    if isinstance(parms, dict) and parms.get(b"/Predictor", 1) >= 10:
        data = _unpredicted(data, parms.get(b"/Columns", 1) * parms.get(b"/Colors", 1) * parms.get(b"/BitsPerComponent", 8) // 8)
    return data


def _unpredicted(data: bytes, width: int) -> bytes:
    """Rows with the filters none, sub and up; the others aren't used by writers of such streams."""
    out, before = bytearray(), bytes(width)
    for i in range(0, len(data), width + 1):
        kind, row = data[i], bytearray(data[i + 1 : i + 1 + width])
        if kind == 1:
            for j in range(1, len(row)):
                row[j] = (row[j] + row[j - 1]) & 255
        elif kind == 2:
            row = bytearray((a + b) & 255 for a, b in zip(row, before, strict=True))
        elif kind:
            raise PdfError(f"a predictor that is not read: {kind}")
        out += row
        before = bytes(row)
    return bytes(out)


class Reader:
    """The objects of a file by their numbers."""

    def __init__(self, data: bytes):
        self.data, self.where, self.trailer = data, {}, {}
        self.packed: dict[int, list] = {}
        start = data.rfind(b"startxref")
        if start < 0:
            raise PdfError("no cross-reference table")
        todo, done = [self._number(start + 9)], set()
        while todo:
            at = todo.pop(0)
            if at in done:
                continue
            done.add(at)
            trailer = self._table(at) if data[_skip(data, at) :].startswith(b"xref") else self._xref_stream(at)
            self.trailer = trailer | self.trailer
            todo += [trailer[k] for k in (b"/XRefStm", b"/Prev") if isinstance(trailer.get(k), int)]
        if b"/Encrypt" in self.trailer:
            raise PdfError("the file is encrypted")

    def _number(self, at: int) -> int:
        found, _ = value(self.data, at)
        if not isinstance(found, int):
            raise PdfError("not a number")
        return found

    def _table(self, at: int) -> dict:
        at = _skip(self.data, at) + 4
        while True:
            first, at = value(self.data, at)
            if first == b"trailer":
                return value(self.data, at)[0]
            count, at = value(self.data, at)
            if not isinstance(first, int) or not isinstance(count, int):
                raise PdfError("a damaged cross-reference table")
            for i in range(first, first + count):
                offset, at = value(self.data, at)
                _, at = value(self.data, at)
                kind, at = value(self.data, at)
                if kind == b"n":
                    self.where.setdefault(i, (1, offset, 0))
                else:
                    self.where.setdefault(i, (0, 0, 0))

    def _xref_stream(self, at: int) -> dict:
        stream = self._at(at)
        if not isinstance(stream, Stream):
            raise PdfError("a damaged cross-reference stream")
        data, widths = _decoded(stream), stream.head[b"/W"]
        index = stream.head.get(b"/Index", [0, stream.head[b"/Size"]])
        x = 0
        for first, count in zip(index[::2], index[1::2], strict=True):
            for i in range(first, first + count):
                row = []
                for k, w in enumerate(widths):
                    row.append(int.from_bytes(data[x : x + w]) if w else int(k == 0))
                    x += w
                self.where.setdefault(i, tuple(row))
        return stream.head

    def _at(self, at: int, number: int | None = None) -> object:
        begin = _BEGIN.match(self.data, at)
        if not begin or (number is not None and int(begin[1]) != number):
            raise PdfError(f"no object {number} at byte {at}")
        found, end = value(self.data, begin.end())
        if isinstance(found, dict) and (opened := _STREAM.match(self.data, end)):
            length = self.resolved(found.get(b"/Length"))
            if not isinstance(length, int) or self.data[_skip(self.data, opened.end() + length) :][:9] != b"endstream":
                raise PdfError(f"a stream without its length at byte {at}")
            return Stream(found, self.data[opened.end() : opened.end() + length])
        return found

    def get(self, number: int) -> object:
        kind, a, b = self.where.get(number, (0, 0, 0))
        if kind == 1:
            return self._at(a, number)
        if kind == 2:
            if a not in self.packed:
                stream = self.get(a)
                data, at, places = _decoded(stream), 0, []
                for _ in range(2 * stream.head[b"/N"]):
                    x, at = value(data, at)
                    places.append(x)
                self.packed[a] = [value(data, stream.head[b"/First"] + x)[0] for x in places[1::2]]
            return self.packed[a][b]
        return b"null"

    def resolved(self, x: object) -> object:
        for _ in range(50):
            if not isinstance(x, Ref):
                return x
            x = self.get(x.number)
        raise PdfError("references in a circle")

    def pages(self) -> Iterator[tuple[int, dict]]:
        """The number and dictionary of each page in order, with what it inherits."""
        root = self.resolved(self.trailer.get(b"/Root"))
        if not isinstance(root, dict):
            raise PdfError("no catalog")
        todo, met = [(root.get(b"/Pages"), {})], set()
        while todo:
            ref, above = todo.pop()
            node = self.resolved(ref)
            if not isinstance(node, dict) or not isinstance(ref, Ref) or ref.number in met:
                raise PdfError("a damaged page tree")
            met.add(ref.number)
            own = above | {k: node[k] for k in INHERITED if k in node}
            kids = self.resolved(node.get(b"/Kids"))
            if isinstance(kids, list):
                todo += [(kid, own) for kid in reversed(kids)]
            else:
                yield ref.number, {k: v for k, v in node.items() if k != b"/Parent"} | own | {b"/Parent": Ref(-1)}


def _segments(x: object, out: list) -> None:
    """The value as bytes with Refs between them."""
    if isinstance(x, Ref):
        out.append(x)
    elif isinstance(x, dict):
        out.append(b"<<")
        for k, v in x.items():
            out.append(k + b" ")
            _segments(v, out)
        out.append(b">>")
    elif isinstance(x, list):
        out.append(b"[")
        for v in x:
            _segments(v, out)
            out.append(b" ")
        out.append(b"]")
    elif isinstance(x, Stream):
        _segments(x.head | {b"/Length": len(x.data)}, out)
        out.append(b"\nstream\n" + x.data + b"\nendstream")
    else:
        out.append(x if isinstance(x, bytes) else str(x).encode())


def page_objects(data: bytes) -> list[tuple[int, bool, list[bytes], list[int]]]:
    """(number, is_page, pieces, refs) of a file's pages, in order and first, and of all that they need.

    An object is its pieces with the references between them: ``refs`` are numbers of this list, or PARENT.
    """
    file = Reader(data)
    pages = list(file.pages())
    new = {old: i + 1 for i, (old, _) in enumerate(pages)} | {-1: PARENT}
    todo, out = deque((n, True, page) for n, page in pages), []
    while todo:
        old, is_page, x = todo.popleft()
        parts: list = []
        _segments(x, parts)
        pieces, refs = [b""], []
        for part in parts:
            if isinstance(part, Ref):
                if part.number not in new:
                    new[part.number] = len(new)
                    todo.append((part.number, False, file.get(part.number)))
                refs.append(new[part.number])
                pieces.append(b"")
            else:
                pieces[-1] += part
        out.append((new[old], is_page, pieces, refs))
    return out


def one_page(text: str) -> bytes:
    """A PDF file of one page that shows a text (Latin-1; other characters as question marks), a line for each of its lines."""
    shown = [re.sub(rb"([\\()])", rb"\\\1", line.encode("latin-1", "replace")) for line in text.split("\n")]
    content = b"BT /F1 11 Tf 14 TL 50 780 Td " + b" ".join(b"(" + x + b") Tj T*" for x in shown) + b" ET"
    bodies = [b"<</Type /Catalog /Pages 2 0 R>>", b"<</Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 595 842]>>", b"<</Type /Page /Parent 2 0 R /Contents 4 0 R /Resources <</Font <</F1 5 0 R>>>>>>", b"<</Length %d>>\nstream\n%s\nendstream" % (len(content), content), b"<</Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding>>"]
    out, places = b"%PDF-1.7\n", []
    for i, body in enumerate(bodies):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i + 1, body)
    table = b"".join(b"%010d 00000 n \n" % x for x in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<</Size %d /Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, table, len(bodies) + 1, len(out))


def page_texts(data: bytes) -> list[str]:
    """The strings that each page shows, a line each; for uncompressed content in Latin-1."""
    file, out = Reader(data), []
    for _, page in file.pages():
        content, at, lines, last = file.resolved(page.get(b"/Contents")), 0, [], b""
        body = content.data if isinstance(content, Stream) else b""
        while (at := _skip(body, at)) < len(body):
            word, at = value(body, at)
            if word == b"Tj" and isinstance(last, bytes):
                lines.append(re.sub(rb"\\([\\()])", rb"\1", last[1:-1]).decode("latin-1"))
            last = word
        out.append("\n".join(lines))
    return out
