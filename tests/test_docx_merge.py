"""Merging packages: images, lists, headings and links of all inputs survive a read back."""

import io
import re
import zipfile
from xml.etree import ElementTree

from folioforge.sources import docx, docx_merge

W, R, A = docx_merge.W, docx_merge.R, "http://schemas.openxmlformats.org/drawingml/2006/main"
OFFICE = "application/vnd.openxmlformats-officedocument.wordprocessingml"


def document(name, image, start, heading_size, default="Normal", ignorable=False, header=False):
    """A file with a heading, two lists, an image, a link and, if asked for, a header with an image of its own."""
    listed = lambda n, t: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="{n}"/></w:numPr></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    section = f'<w:sectPr>{"<w:headerReference w:type=\'default\' r:id=\'rId9\'/>" * header}<w:pgSz w:w="{start}" w:h="200"/></w:sectPr>'
    body = (
        f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>{name} head</w:t></w:r></w:p><w:p><w:r><w:t>{name} text</w:t></w:r></w:p>{listed(1, name + " one")}{listed(2, name + " two")}'
        f'<w:p><w:r><w:drawing><a:blip r:embed="rId4"/></w:drawing></w:r></w:p><w:p><w:hyperlink r:id="rId5"><w:r><w:t>{name} link</w:t></w:r></w:hyperlink></w:p>'
        f'<w:p><w:pPr>{section if header else ""}</w:pPr></w:p>{section}'
    )
    styles = f'<w:style w:type="paragraph" w:default="1" w:styleId="{default}"><w:name w:val="{default}"/></w:style><w:style w:type="paragraph" w:styleId="Heading1"><w:name w:val="heading 1"/><w:basedOn w:val="{default}"/><w:rPr><w:sz w:val="{heading_size}"/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="Shared"><w:name w:val="Shared"/></w:style>'
    numbering = "".join(f'<w:abstractNum w:abstractNumId="{i}"><w:lvl w:ilvl="0"><w:start w:val="{start + i}"/></w:lvl></w:abstractNum>' for i in (0, 1)) + "".join(f'<w:num w:numId="{i + 1}"><w:abstractNumId w:val="{i}"/></w:num>' for i in (0, 1))
    rel = lambda i, kind, target, mode="": f'<Relationship Id="rId{i}" Type="{R}/{kind}" Target="{target}"{mode}/>'
    rels = rel(1, "styles", "styles.xml") + rel(2, "numbering", "numbering.xml") + rel(4, "image", "media/image1.png") + rel(5, "hyperlink", f"http://{name}.example", ' TargetMode="External"') + rel(9, "header", "header1.xml") * header
    root = f'xmlns:w="{W}" xmlns:r="{R}" xmlns:a="{A}"' + ' xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:w14="urn:x" mc:Ignorable="w14"' * ignorable
    relations = lambda inner: f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'
    parts = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="png" ContentType="image/png"/><Override PartName="/word/document.xml" ContentType="{OFFICE}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{OFFICE}.styles+xml"/><Override PartName="/word/header1.xml" ContentType="{OFFICE}.header+xml"/></Types>',
        "_rels/.rels": relations(rel(1, "officeDocument", "word/document.xml")),
        "word/document.xml": f"<w:document {root}><w:body>{body}</w:body></w:document>",
        "word/_rels/document.xml.rels": relations(rels), "word/styles.xml": f'<w:styles xmlns:w="{W}">{styles}</w:styles>', "word/numbering.xml": f'<w:numbering xmlns:w="{W}">{numbering}</w:numbering>', "word/media/image1.png": image,
    }
    if header:
        parts |= {"word/header1.xml": f'<w:hdr xmlns:w="{W}"/>', "word/_rels/header1.xml.rels": relations(rel(1, "image", "media/logo.png")), "word/media/logo.png": b"logo"}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, x in parts.items():
            z.writestr(n, x)
    return out.getvalue()


def opened(content):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        assert z.testzip() is None and len(z.namelist()) == len(set(z.namelist()))
        return {n: z.read(n) for n in z.namelist()}


def rows_of(name):
    return [("heading", f"{name} head"), ("paragraph", f"{name} text"), ("list_item", f"{name} one"), ("list_item", f"{name} two"), ("image", None), ("paragraph", f"{name} link"), ("paragraph", "")]


def test_merge_keeps_images_lists_headings_and_links():
    files = [document("a", b"A", 100, 20), document("b", b"B", 300, 30, ignorable=True, header=True), document("c", b"C", 500, 20, default="Base")]
    content = docx_merge.merged(files)
    parts = opened(content)
    rows = docx.document_rows(content)
    assert [(k, None if k == "image" else t) for k, t, _ in rows] == [*rows_of("a"), ("page_break", ""), *rows_of("b"), ("page_break", ""), *rows_of("c")]
    assert [parts["word/" + t] for k, t, _ in rows if k == "image"] == [b"A", b"B", b"C"]
    tree = lambda n: ElementTree.fromstring(parts[n])
    w = docx_merge.w
    body, styles, numbering = tree("word/document.xml"), tree("word/styles.xml"), tree("word/numbering.xml")
    # each list counts from its own file's start, and numberings come in the order that the format asks for
    starts = {n.get(w("numId")): next(a for a in numbering.findall(w("abstractNum")) if a.get(w("abstractNumId")) == n.find(w("abstractNumId")).get(w("val"))).find(f".//{w('start')}").get(w("val")) for n in numbering.findall(w("num"))}
    assert [starts[x.get(w("val"))] for x in body.iter(w("numId"))] == ["100", "101", "300", "301", "500", "501"] and len(starts) == 6
    tags = [x.tag for x in numbering]
    assert tags == sorted(tags, key=lambda t: t != w("abstractNum"))
    # headings keep their own look, equal styles are one
    sizes = {s.get(w("styleId")): s.find(f".//{w('sz')}").get(w("val")) for s in styles.findall(w("style")) if s.find(f".//{w('sz')}") is not None}
    used = [p.find(f"{w('pPr')}/{w('pStyle')}").get(w("val")) for p in body.iter(w("p")) if "head" in "".join(p.itertext())]
    assert [sizes[s] for s in used] == ["20", "30", "20"] and [s.get(w("styleId")) for s in styles.findall(w("style"))].count("Shared") == 1
    assert sum(s.get(w("default")) == "1" for s in styles.findall(w("style"))) == 1
    plain = [p.find(f"{w('pPr')}/{w('pStyle')}") for p in body.iter(w("p")) if "".join(p.itertext()) in ("a text", "c text")]
    assert plain[0] is None and plain[1].get(w("val")) == "Base"
    # links, headers and what these refer to
    rels = {r.get("Id"): r for r in tree("word/_rels/document.xml.rels")}
    assert [rels[x.get(f"{{{R}}}id")].get("Target") for x in body.iter(w("hyperlink"))] == [f"http://{n}.example" for n in "abc"]
    (ref,) = body.iter(w("headerReference"))
    header = rels[ref.get(f"{{{R}}}id")].get("Target")
    assert "word/" + header in parts and parts["word/part1/media/logo.png"] == b"logo" and "word/part1/_rels/header1.xml.rels" in parts
    assert len(rels) == len(tree("word/_rels/document.xml.rels"))
    kinds = {x.get("PartName") for x in tree("[Content_Types].xml") if x.get("PartName")}
    assert {"/word/part1/header1.xml", "/word/document.xml"} <= kinds
    # the base's page at the end, and no prefix that isn't declared
    assert body.find(w("body"))[-1].tag == w("sectPr") and body.find(w("body"))[-1].find(w("pgSz")).get(w("w")) == "100"
    assert b"Ignorable" not in parts["word/document.xml"] and re.search(rb"<w:document", parts["word/document.xml"])


def test_merge_of_plain_and_merged_files(spark):
    plain = docx.document_bytes([("heading", "H"), ("paragraph", "p"), ("table", "", [(0, 0, "x", 1, 1)], 1, 1)])
    once = docx_merge.merged([plain, document("b", b"B", 1, 2)])
    again = docx_merge.merged([document("a", b"A", 5, 6), once, plain])
    got = [(k, None if k == "image" else t) for k, t, _ in docx.document_rows(again)]
    own = [("heading", "H"), ("paragraph", "p"), ("table", "")]
    assert got == [*rows_of("a"), ("page_break", ""), *own, ("page_break", ""), *rows_of("b"), ("page_break", ""), *own]
    parts = opened(again)
    assert [parts["word/" + t] for k, t, _ in docx.document_rows(again) if k == "image"] == [b"A", b"B"]
    assert [k for k, *_ in docx.document_rows(docx_merge.merged([plain]))] == ["heading", "paragraph", "table"]
    files = spark.createDataFrame([("j", 1, bytearray(plain)), ("j", 0, bytearray(once)), ("k", 0, bytearray(plain)), ("k", 1, bytearray(b"junk"))], "job_id string, file_seq int, content binary")
    made = {r.job_id: r for r in docx_merge.merge_documents(files).collect()}
    assert made["j"].ok and [k for k, *_ in docx.document_rows(bytes(made["j"].content))].count("page_break") == 2
    assert not made["k"].ok and made["k"].content is None and "not a document" in made["k"].error
