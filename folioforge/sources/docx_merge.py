"""Merging word-processor files as packages.

The first file is the base. Of each other file the body follows after a page break; its parts (images, headers,
embedded files) go into a folder of their own, so that their own references hold; ids of relationships,
numberings and styles get names that the base does not have. A style that both define alike is one; a
paragraph without a style gets the other file's default one where that differs from the base's. The page layout at the
end of a body is the base's; document-wide settings, fonts and themes are the base's too.

A job's files are one group: the intake takes ten files of 10 MB at most.
"""

from __future__ import annotations

import copy
import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from folioforge.sources.docx import BREAK

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
_MC = "http://schemas.openxmlformats.org/markup-compatibility/2006"
#: Kinds of parts that a document has once: the base's count, styles and numberings are merged.
_ONCE = ("styles", "numbering", "settings", "fontTable", "theme", "webSettings")
_BODY = "word/document.xml"
_STYLE_REFS = ("pStyle", "rStyle", "tblStyle", "basedOn", "next", "link", "numStyleLink", "styleLink")

for _prefix, _uri in {
    "w": W, "r": R, "wp": "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing",
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main", "pic": "http://schemas.openxmlformats.org/drawingml/2006/picture",
    "v": "urn:schemas-microsoft-com:vml", "o": "urn:schemas-microsoft-com:office:office", "mc": _MC,
}.items():
    ElementTree.register_namespace(_prefix, _uri)


def w(name: str) -> str:
    return f"{{{W}}}{name}"


class Package:
    """The parts of a file by name, and the ones that merging changes as trees."""

    def __init__(self, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            self.parts = {n: z.read(n) for n in z.namelist() if not n.endswith("/")}
        self.document = self._tree(_BODY)
        self.body = self.document.find(w("body"))
        self.document.attrib.pop(f"{{{_MC}}}Ignorable", None)  # its prefixes may go when the tree is written
        self.rels_name = "word/_rels/document.xml.rels"
        self.rels = self._tree(self.rels_name, f"{{{_RELS}}}Relationships")
        self.types = self._tree("[Content_Types].xml")
        self.styles = self._once("styles", w("styles"))
        self.numbering = self._once("numbering", w("numbering"))

    def _tree(self, name: str, empty: str | None = None) -> ElementTree.Element:
        if name not in self.parts and empty:
            return ElementTree.Element(empty)
        return ElementTree.fromstring(self.parts[name])

    def _once(self, kind: str, empty: str) -> ElementTree.Element:
        name = self.part_of(kind)
        return self._tree(name, empty) if name else ElementTree.Element(empty)

    def part_of(self, kind: str) -> str | None:
        """The name of the document's part of a kind."""
        for rel in self.rels:
            if rel.get("Type", "").rpartition("/")[2] == kind:
                return self.resolved(rel.get("Target"))
        return None

    @staticmethod
    def resolved(target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("word", target))

    def type_of(self, part: str) -> str | None:
        by_name = {x.get("PartName"): x.get("ContentType") for x in self.types if x.tag.endswith("Override")}
        by_extension = {x.get("Extension", "").lower(): x.get("ContentType") for x in self.types if x.tag.endswith("Default")}
        return by_name.get("/" + part) or by_extension.get(part.rpartition(".")[2].lower())

    def add_part(self, name: str, content: bytes, kind: str | None) -> None:
        self.parts[name] = content
        if kind and self.type_of(name) != kind:
            ElementTree.SubElement(self.types, f"{{{_TYPES}}}Override", PartName="/" + name, ContentType=kind)

    def add_once(self, kind: str, tree: ElementTree.Element) -> None:
        """Write the tree of the part of a kind, which the document gets where it has none."""
        name = self.part_of(kind)
        if name is None and len(tree):
            name = f"word/{kind}.xml"
            ElementTree.SubElement(self.rels, f"{{{_RELS}}}Relationship", Id=f"rIdMerged{kind}", Type=f"{R}/{kind}", Target=f"{kind}.xml")
            self.add_part(name, b"", f"application/vnd.openxmlformats-officedocument.wordprocessingml.{kind}+xml")
        if name is not None:
            self.parts[name] = ElementTree.tostring(tree, "utf-8", xml_declaration=True)

    def content(self) -> bytes:
        self.add_once("styles", self.styles)
        self.add_once("numbering", self.numbering)
        for name, tree in ((_BODY, self.document), (self.rels_name, self.rels), ("[Content_Types].xml", self.types)):
            self.parts[name] = ElementTree.tostring(tree, "utf-8", xml_declaration=True)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name in sorted(self.parts, key=lambda n: (n != "[Content_Types].xml", n)):
                z.writestr(zipfile.ZipInfo(name), self.parts[name], zipfile.ZIP_DEFLATED)
        return out.getvalue()


def _default(styles: ElementTree.Element, kind: str) -> str | None:
    return next((s.get(w("styleId")) for s in styles.findall(w("style")) if s.get(w("type")) == kind and s.get(w("default")) in ("1", "true")), None)


def _same(a: ElementTree.Element, b: ElementTree.Element) -> bool:
    return ElementTree.canonicalize(ElementTree.tostring(a), strip_text=True) == ElementTree.canonicalize(ElementTree.tostring(b), strip_text=True)


def _merge_numbering(base: Package, other: Package) -> dict[str, str]:
    """Add the other's numberings; the new id of each of its old ones."""
    top = lambda tag, key: max([int(x.get(w(key))) for x in base.numbering.findall(w(tag))], default=-1) + 1
    abstract, new = top("abstractNum", "abstractNumId"), max(top("num", "numId"), 1)
    at = len(base.numbering.findall(w("abstractNum")))  # before the first num
    shift, ids = {}, {}
    for x in copy.deepcopy(other.numbering.findall(w("abstractNum"))):
        shift[x.get(w("abstractNumId"))] = str(abstract)
        x.set(w("abstractNumId"), str(abstract))
        base.numbering.insert(at, x)
        abstract, at = abstract + 1, at + 1
    for x in copy.deepcopy(other.numbering.findall(w("num"))):
        ids[x.get(w("numId"))] = str(new)
        x.set(w("numId"), str(new))
        ref = x.find(w("abstractNumId"))
        ref.set(w("val"), shift.get(ref.get(w("val")), ref.get(w("val"))))
        base.numbering.append(x)
        new += 1
    return ids


def _merge_styles(base: Package, other: Package, number: int) -> tuple[dict[str, str], list[ElementTree.Element]]:
    """Add the other's styles that the base has not, or has otherwise; the new names, and the elements added."""
    known = {s.get(w("styleId")): s for s in base.styles.findall(w("style"))}
    names, added = {}, []
    for s in other.styles.findall(w("style")):
        old = s.get(w("styleId"))
        if old in known and _same(known[old], s):
            continue
        s = copy.deepcopy(s)
        kind = s.get(w("type"))
        if old in known:
            names[old] = f"{old}_{number}"
            s.set(w("styleId"), names[old])
            title = s.find(w("name"))
            if title is not None:
                title.set(w("val"), f"{title.get(w('val'))} ({number})")
        if _default(base.styles, kind):
            s.attrib.pop(w("default"), None)
        base.styles.append(s)
        added.append(s)
    return names, added


def append(base: Package, other: Package, number: int) -> None:
    """Append the other file, the ``number``-th after the base."""
    numbers = _merge_numbering(base, other)
    own_default, base_default = _default(other.styles, "paragraph"), _default(base.styles, "paragraph")
    styles, added = _merge_styles(base, other, number)
    folder, ids = f"part{number}", {}
    once = {other.part_of(k) for k in _ONCE}
    for name, content in other.parts.items():
        inside = re.match(r"word/(.+)$", name)
        if inside and name not in once and name not in (_BODY, other.rels_name):
            base.add_part(f"word/{folder}/{inside[1]}", content, None if "/_rels/" in name else other.type_of(name))
    for rel in other.rels:
        if rel.get("Type", "").rpartition("/")[2] in _ONCE:
            continue
        rel = copy.deepcopy(rel)
        ids[rel.get("Id")] = f"{folder}_{rel.get('Id')}"
        rel.set("Id", ids[rel.get("Id")])
        if rel.get("TargetMode") != "External":
            part = other.resolved(rel.get("Target"))
            rel.set("Target", f"{folder}/{part.removeprefix('word/')}" if part.startswith("word/") else f"/{part}")
            if not part.startswith("word/") and part in other.parts and part not in base.parts:
                base.add_part(part, other.parts[part], other.type_of(part))
        base.rels.append(rel)
    body = [copy.deepcopy(x) for x in other.body if x.tag != w("sectPr")]
    for root in [*body, *added, *base.numbering.findall(w("abstractNum"))[-len(other.numbering.findall(w("abstractNum"))) or len(base.numbering) :]]:
        for x in root.iter():
            name = x.tag.removeprefix(f"{{{W}}}")
            if name in _STYLE_REFS:
                x.set(w("val"), styles.get(x.get(w("val")), x.get(w("val"))))
            elif name == "numId" and x.get(w("val")) in numbers:
                x.set(w("val"), numbers[x.get(w("val"))])
            for key, v in list(x.attrib.items()):
                if key.startswith(f"{{{R}}}") and v in ids:
                    x.set(key, ids[v])
    wanted = styles.get(own_default, own_default)
    if wanted and wanted != base_default:
        for p in (p for root in body for p in root.iter(w("p"))):
            props = p.find(w("pPr"))
            if props is None:
                props = ElementTree.Element(w("pPr"))
                p.insert(0, props)
            if props.find(w("pStyle")) is None:
                props.insert(0, ElementTree.Element(w("pStyle"), {w("val"): wanted}))
    page_break = ElementTree.fromstring(f'<x xmlns:w="{W}">{BREAK}</x>')[0]
    at = next((i for i, x in enumerate(base.body) if x.tag == w("sectPr")), len(base.body))
    for x in [page_break, *body]:
        base.body.insert(at, x)
        at += 1


def merged(contents: list[bytes]) -> bytes:
    """One file of several, in order."""
    base = Package(contents[0])
    for i, content in enumerate(contents[1:], 1):
        append(base, Package(content), i)
    return base.content()


def merge_documents(files: DataFrame) -> DataFrame:
    """job_id, ok, content and error: the files (job_id, file_seq, content) of each job as one, or what is wrong with the first that can't be read."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            row = [True, merged(list(pdf.sort_values("file_seq").content)), None]
        except (ValueError, KeyError, AttributeError, zipfile.BadZipFile, ElementTree.ParseError) as e:  # what a damaged file leads to
            row = [False, None, f"not a document: {e}"]
        return pd.DataFrame([[pdf.job_id.iloc[0], *row]], columns=["job_id", "ok", "content", "error"])

    return files.select("job_id", "file_seq", "content").groupBy("job_id").applyInPandas(one, f"job_id {files.schema['job_id'].dataType.simpleString()}, ok boolean, content binary, error string")
