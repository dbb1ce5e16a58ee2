"""Reading and merging PDF files: tables, streams, object streams, updates, inherited attributes, damage."""

import random
import zlib

import pytest

from folioforge.operators import pdf_merge
from folioforge.sources import pdf


def plain(bodies, root=1, extra=b""):
    """A file of these objects (by number) with a cross-reference table."""
    out, places = b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n", {}
    for n, body in bodies.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    top = max(bodies) + 1
    rows = b"".join(b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 00001 f \n" for n in range(1, top))
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<</Size %d /Root %d 0 R %s>>\nstartxref\n%d\n%%%%EOF" % (top, rows, top, root, extra, len(out))


def shown(text):
    body = b"BT (" + text + b") Tj ET"
    return b"<</Length %d>> stream\r\n%s\r\nendstream" % (len(body), body)


def nested():
    """Three pages in a tree of two levels, out of numerical order, with inherited attributes and a length that is a reference."""
    return plain({
        9: b"<< /Type/Catalog /Pages 8 0 R >>", 8: b"<</Type/Pages/Kids[6 0 R 3 0 R]/Count 3/MediaBox[0 0 100 200]/Resources 7 0 R>>", 6: b"<</Type/Pages/Parent 8 0 R/Kids[5 0 R 2 0 R]/Count 2/Rotate 90>>",
        5: b"<</Type/Page/Parent 6 0 R/Contents 10 0 R/Note(a \\) (b) 1 0 R) % no 4 0 R\n/Annots[<</P 2 0 R>>]>>", 2: b"<</Type/Page/Parent 6 0 R/Contents 11 0 R/MediaBox [0 0 1 1]>>", 3: b"<</Type/Page/Parent 8 0 R/Contents 12 0 R>>",
        7: b"<</Font<</F 4 0 R>>>>", 4: b"<</Type/Font/BaseFont/Helvetica/Subtype/Type1>>", 10: shown(b"one"), 11: b"<</Length 1 0 R>>\nstream\nBT (two) Tj ET\nendstream", 12: shown(b"three \\(x\\)"), 1: b"14",
    }, root=9)


def compressed(predictor):
    """A file with an object stream and a cross-reference stream."""
    inner = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 9 9]>>", 3: b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>"}
    at, heads = 0, b""
    for n, body in inner.items():
        heads += b"%d %d " % (n, at)
        at += len(body) + 1
    packed = zlib.compress(heads + b" ".join(inner.values()))
    out, places = b"%PDF-1.5\n", {}
    for n, body in {4: shown(b"packed"), 5: b"<</Type/ObjStm/N 3/First %d/Filter/FlateDecode/Length %d>>stream\n%s\nendstream" % (len(heads), len(packed), packed)}.items():
        places[n] = len(out)
        out += b"%d 0 obj %s endobj\n" % (n, body)
    places[6] = len(out)
    rows = [(0, 0, 0), *((2, 5, i) for i in range(3)), *((1, places[n], 0) for n in (4, 5, 6))]
    raw = [bytes([k]) + a.to_bytes(3) + bytes([b]) for k, a, b in rows]
    if predictor:
        raw = [b"\x02" + bytes((x - y) & 255 for x, y in zip(row, before, strict=True)) for row, before in zip(raw, [bytes(5), *raw[:-1]], strict=True)]
    data = zlib.compress(b"".join(raw))
    parms = b"/DecodeParms<</Predictor 12/Columns 5>>" if predictor else b""
    return out + b"6 0 obj <</Type/XRef/W[1 3 1]/Size 7/Root 1 0 R/Filter/FlateDecode%s/Length %d>>stream\n%s\nendstream endobj\nstartxref\n%d\n%%%%EOF" % (parms, len(data), data, places[6])


def updated():
    """A file whose page content was replaced by an incremental update."""
    first = pdf.one_page("old")
    body = b"4 0 obj\n" + shown(b"new") + b"\nendobj\n"
    at = len(first) + len(body)
    old = int(first[first.rfind(b"startxref") + 9 :].split()[0])
    return first + body + b"xref\n4 1\n%010d 00000 n \ntrailer\n<</Size 6 /Root 1 0 R /Prev %d>>\nstartxref\n%d\n%%%%EOF" % (len(first), old, at)


def test_reading():
    assert pdf.page_texts(pdf.one_page("a (b)\\\nc")) == ["a (b)\\\nc"]
    assert pdf.page_texts(nested()) == ["one", "two", "three (x)"]
    assert pdf.page_texts(compressed(False)) == pdf.page_texts(compressed(True)) == ["packed"]
    assert pdf.page_texts(updated()) == ["new"]


@pytest.mark.parametrize(("data", "why"), [(b"", "cross-reference"), (b"%PDF startxref 3", "."), (plain({1: b"<</Pages 2 0 R>>", 2: b"<</Kids[2 0 R]>>"}), "tree"), (plain({1: b"<</Pages 2 0 R>>", 2: b"<</Kids[]>>"}, extra=b"/Encrypt 1 0 R"), "encrypted"), (nested()[:200] + nested()[-60:], ".")])
def test_damage(data, why):
    with pytest.raises((ValueError, KeyError, TypeError, IndexError), match=why):
        pdf.page_objects(data)


def test_merge(spark, tmp_path):
    rng = random.Random(4)
    many = [pdf.one_page(f"p{i}") for i in range(30)]
    jobs = {"a": [nested(), compressed(True), updated(), pdf.one_page("last")], "b": many, "bad": [many[0], b"junk", nested()], "one": [nested()]}
    rows = [(j, i, bytearray(c)) for j, parts in jobs.items() for i, c in enumerate(parts)]
    rng.shuffle(rows)
    files = spark.createDataFrame(rows, "job_id string, file_seq int, content binary").repartition(6)
    got = {r.job_id: (r.ok, r.pages, r.error) for r in pdf_merge.merge_pdfs(files, str(tmp_path / "out")).collect()}
    assert got == {"a": (True, 6, None), "b": (True, 30, None), "one": (True, 3, None), "bad": (False, 0, "no cross-reference table")}
    read = lambda name: (tmp_path / "out" / f"{name}.pdf").read_bytes()
    assert pdf.page_texts(read("a")) == ["one", "two", "three (x)", "packed", "new", "last"] and pdf.page_texts(read("b")) == [f"p{i}" for i in range(30)]
    assert not (tmp_path / "out" / "bad.pdf").exists()
    pages = [p for _, p in pdf.Reader(read("a")).pages()]
    assert [(p[b"/MediaBox"], p.get(b"/Rotate")) for p in pages[:4]] == [([0, 0, 100, 200], 90), ([0, 0, 1, 1], 90), ([0, 0, 100, 200], None), ([0, 0, 9, 9], None)]
    file = pdf.Reader(read("a"))
    assert file.resolved(file.resolved(pages[0][b"/Resources"])[b"/Font"][b"/F"])[b"/BaseFont"] == b"/Helvetica"
    assert pages[0][b"/Note"] == b"(a \\) (b) 1 0 R)" and file.resolved(pages[0][b"/Annots"][0][b"/P"])[b"/MediaBox"] == [0, 0, 1, 1]
    # every object is where the table says, and a merged file can be merged again
    assert all(file.get(n) != b"null" for n in range(1, len(file.where)))
    again = spark.createDataFrame([("x", 0, bytearray(read("a"))), ("x", 1, bytearray(read("one")))], files.schema)
    pdf_merge.merge_pdfs(again, str(tmp_path / "out"))
    assert pdf.page_texts(read("x")) == pdf.page_texts(read("a")) + ["one", "two", "three (x)"]
    assert pdf_merge.merge_pdfs(files.where("false"), str(tmp_path / "none")).collect() == []


def test_python_gets_few_files(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def few(batches):
        for b in batches:
            assert b.num_rows <= pdf_merge.FILES_AT_ONCE
            yield b

    rows = [(i % 2, i, bytearray(pdf.one_page(f"p{i}"))) for i in range(100)]
    files = spark.createDataFrame(rows, "job_id long, file_seq long, content binary").coalesce(1)
    merged = pdf_merge.merge_pdfs(files.mapInArrow(few, files.schema), str(tmp_path / "out"))
    assert {r.job_id: r.pages for r in merged.collect()} == {0: 50, 1: 50} and spark.conf.get(key) == before
    paths = spark.createDataFrame([(f"file:{tmp_path}/out/{j}.pdf",) for j in (0, 1)], "path string")
    got = [(r.path[-5], r.page, r.text) for r in pdf_merge.page_texts(paths).orderBy("path", "page").collect()]
    assert got == [(str(j), k, f"p{2 * k + j}") for j in (0, 1) for k in range(50)]
