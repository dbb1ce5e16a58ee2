import datetime
import json
import os
import subprocess
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from folioforge import session
from folioforge.operators import anchored, documents, elements, history, intake, results
from folioforge.plans.documents import extract, save
from folioforge.sources import config, docx, history_tree, providers, sinks
from folioforge.sources.files import dealt_by_size, in_natural_order, read_history, scan_file, scan_history, scan_images, uploaded_files

ELEMENTS = "page_id string, elem_idx int, kind string, text string, html string, lines array<string>"


def test_page_gate_and_blocks(spark):
    pages = spark.createDataFrame([("a", 0, "a.jpg"), ("b", 1, "b.jpg"), ("c", 2, "c.jpg"), ("d", 3, "d.jpg")], "page_id string, page_seq int, filename string")
    rows = [
        ("a", 0, "table", None, "<table></table>", None), ("a", 1, "text", None, None, ["dropped"]),
        ("b", 0, "Text", None, None, ["x", " y "]), ("b", 1, None, "plain", None, None), ("b", 2, None, "　", None, None), ("b", 3, "table", None, "", None),
        ("c", 0, "title", None, None, ["t"]),
    ]
    found = spark.createDataFrame(rows, ELEMENTS)
    got = [tuple(r) for r in elements.blocks(pages, found).orderBy("page_id", "block_seq").select("page_id", "kind", "text").collect()]
    assert got == [
        ("a", "heading", "Content from a.jpg"), ("a", "table", "<table></table>"), ("a", "blank", ""), ("a", "page_break", None),
        ("b", "heading", "Content from b.jpg"), ("b", "paragraph", "x"), ("b", "paragraph", "y"), ("b", "paragraph", "plain"), ("b", "page_break", None),
        ("c", "heading", "Content from c.jpg"), ("c", "page_break", None),
        ("d", "heading", "Content from d.jpg"), ("d", "paragraph", "[No content could be extracted from d.jpg]\n"),
    ]
    single = elements.blocks(pages, found, single=True)
    assert single.where("kind in ('heading', 'page_break')").count() == 0
    assert elements.blocks(pages, found, keep_text=True).where("text = 'dropped'").count() == 1


def test_document_blocks_take_every_document(spark, tmp_path):
    from folioforge.plans import catalog

    rows = [(0, "a\n b "), (3, "c"), (4, None), (5, " \n\t"), (6, "d\n\ne"), (7, "not read")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(7).selectExpr("id as doc_id").write.parquet(f"{tmp_path}/labels.parquet")
    got = catalog.queries()["document_blocks"](spark, str(tmp_path)).where("kind = 'paragraph'").orderBy("page_id", "block_seq")
    empty = "[No content could be extracted from doc{}.jpg]\n"
    assert [(r.page_id, r.text) for r in got.collect()] == [(0, "a"), (0, "b"), (3, "c"), (4, empty.format(4)), (5, empty.format(5)), (6, "d"), (6, "e"), (7, empty.format(7))]


def test_suppression(spark):
    boxes = [("p", "a", 0.9, 0.0, 0.0, 10.0, 10.0), ("p", "a", 0.8, 0.0, 0.0, 10.0, 9.0), ("p", "b", 0.8, 0.0, 0.0, 10.0, 9.0), ("p", "a", 0.2, 50.0, 50.0, 60.0, 60.0), ("p", "a", 0.5, 50.0, 0.0, 60.0, 9.0)]
    df = spark.createDataFrame(boxes, "page_id string, label string, score double, x1 double, y1 double, x2 double, y2 double")
    assert sorted((r.label, r.score) for r in elements.suppressed(df).collect()) == [("a", 0.5), ("a", 0.9), ("b", 0.8)]
    assert elements.suppressed(df.where("false")).count() == 0
    many = spark.range(40).selectExpr("id % 4 as page_id", "'a' as label", "0.5 + id / 1000 as score", "100.0 * id as x1", "0.0 as y1", "100.0 * id + 9 as x2", "9.0 as y2")
    assert {r["count"] for r in elements.suppressed(many, most=7).groupBy("page_id").count().collect()} == {7}
    assert {r["count"] for r in elements.suppressed(many, before=3).groupBy("page_id").count().collect()} == {3}
    # pages that go over several Arrow batches
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {r["count"] for r in elements.suppressed(many).groupBy("page_id").count().collect()} == {10}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def texts(spark, *pages):
    return spark.createDataFrame([(str(i), p) for i, p in enumerate(pages)], "page_id string, texts array<string>")


def test_six_jpg(spark):
    words = ["标题", "西汉", "1", "2", "3", "4", "x", "北宋", "5", "6", "7", "37.1%", "尾", "注"]
    df = texts(spark, words, ["a", "唐代", "b"], ["a", "b"])
    rows = {(r.page_id, r.table_row): r.cells for r in anchored.anchored_table(df, anchored.SIX_JPG).collect()}
    assert rows["0", 2] == ["西汉", "1", "2", "3", "4"] and rows["0", 3] == ["北宋", "5", "6", "7", "37.1%"]
    assert rows["1", 2] == ["唐代", "b", "", "", ""] and ("2", 2) not in rows and rows["2", 0] == ["", "南方", "南方", "北方", "北方"]
    tail = anchored.anchored_tail(df, anchored.SIX_JPG).groupBy("page_id").agg(F.sort_array(F.collect_list("text")).alias("t"))
    assert {r.page_id: r.t for r in tail.collect()} == {"0": sorted(["尾", "注"]), "2": ["a", "b"]}
    pages = spark.createDataFrame([("1", "6.jpg"), ("2", "x.jpg")], "page_id string, filename string")
    assert {r.filename: r.handler for r in anchored.dispatch(pages, anchored.handler_table(spark)).collect()} == {"6.jpg": "anchored", "x.jpg": "generic"}


def test_intake(spark):
    files = [("j", i, f"f{i}", 10) for i in range(12)] + [("j", 12, "big", 11 * 1024 * 1024), ("j", 13, "f0", 5)]
    taken = intake.intake(spark.createDataFrame(files, "job_id string, file_seq int, name string, size long"))
    assert sorted(r.name for r in taken.collect()) == sorted(f"f{i}" for i in range(10))


def test_merge_and_individual(spark):
    rows = [("a", 0, "x", False, True), ("a", 1, "y", False, False), ("b", 0, "p", False, False), ("b", 1, "q", True, False), ("b", 2, "r", False, False)]
    files = spark.createDataFrame(rows, "job_id string, file_seq long, name string, failed boolean, upload_error boolean")
    got = sorted((r.job_id, r.original_name, r.status, r.hidden_errors) for r in results.merged_results(files).collect())
    assert got == [("a", "x,y", "success", 1), ("b", "p", "success", 0), ("b", "q", "conversion_error", 0)]
    one = files.withColumnsRenamed({"failed": "pdf_failed", "upload_error": "script_failed"})
    assert results.individual_results(one).count() == 6 and results.individual_results(one, dedupe=True).count() == 5


def test_history(spark, tmp_path):
    rows = [("u", "20240101", "a.docx", "converted_files", False, None), ("u", "20240101", "a.docx.meta", "converted_files", True, "scan.jpg"), ("u", "20240102", ".jpg", "converted_files", False, None), ("u", "2024010", "z", "converted_files", False, None)]
    df = spark.createDataFrame(rows, "username string, ymd string, filename string, area string, is_meta boolean, meta_content string")
    uploads = spark.createDataFrame([("u", "20240101", "a.docx", "uploads", False, None), ("u", "20240103", "b.jpg", "uploads", False, None)], df.schema)
    assert {r.converted_name: r.original_name for r in history.listing(df.union(uploads)).collect()} == {"a.docx": "scan.jpg", ".jpg": ".jpg"}
    left = history.delete_outputs(df.union(uploads), df.where("filename = 'a.docx'"))
    assert sorted((r.filename, r.area) for r in left.where("area = 'uploads'").collect()) == [("a.docx", "uploads"), ("b.jpg", "uploads")]
    assert [r.ymd for r in history.dates(df).collect()] == ["20240102", "20240101"]
    gone = history.delete_outputs(df, df.where("filename = 'a.docx'"))
    assert sorted(r.filename for r in gone.collect()) == [".jpg", "z"]
    history.overwrite_history(df, str(tmp_path / "h"))
    back = read_history(spark, str(tmp_path / "h")).where("ymd = '20240101'")
    assert back.count() == 2 and "PartitionFilters: [isnotnull(ymd" in back._jdf.queryExecution().toString()
    # only the touched date is written anew, and goes when nothing is left of it
    before = {f.path: f.stat().st_mtime_ns for f in os.scandir(tmp_path / "h" / "username=u" / "ymd=20240102")}
    history.delete_from(str(tmp_path / "h"), read_history(spark, str(tmp_path / "h")), df.where("filename = 'a.docx'"))
    assert {f.path: f.stat().st_mtime_ns for f in os.scandir(tmp_path / "h" / "username=u" / "ymd=20240102")} == before
    assert not (tmp_path / "h" / "username=u" / "ymd=20240101").exists()
    assert sorted(r.filename for r in read_history(spark, str(tmp_path / "h")).collect()) == [".jpg", "z"]
    users = spark.createDataFrame([("u",), ("v",)], "username string")
    assert history.delete_user(users, df, "u", "u")[0].count() == 2 and history.delete_user(users, df, "u", "v")[1].count() == 0


def test_file_sources(spark, tmp_path):
    for n in ("10.jpg", "2.jpg", "note.txt"):
        (tmp_path / n).write_text(n)
    files = in_natural_order(scan_images(spark, str(tmp_path)))
    assert [r.filename for r in files.orderBy("page_seq").collect()] == ["2.jpg", "10.jpg"]
    assert scan_file(spark, str(tmp_path / "note.txt")).count() == 1
    assert scan_file(spark, str(tmp_path / "none.jpg")).count() == 0
    assert uploaded_files(spark, str(tmp_path)).count() == 3
    sent = spark.createDataFrame([("2.jpg", 5), ("10.jpg", 7), ("lost.jpg", 9)], "name string, size long")
    got = {r.name: (r.status, r.message) for r in uploaded_files(spark, str(tmp_path), sent).collect()}
    assert got == {"2.jpg": ("uploaded", None), "10.jpg": ("upload_error", "the file is not whole"), "lost.jpg": ("upload_error", "the file did not arrive")}
    tree = tmp_path / "t" / "u" / "20240101" / "converted_files"
    tree.mkdir(parents=True)
    (tree / "a.docx").write_text("x")
    (tree / "a.docx.meta").write_text("one\ntwo")
    got = {r.filename: r.meta_content for r in scan_history(spark, str(tmp_path / "t")).collect()}
    assert got == {"a.docx": None, "a.docx.meta": "one\ntwo"}


def test_numbering_one_large_folder(spark):
    """A folder's files are numbered by several tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the listing is small
    before = session.shared_tables(spark)
    files = spark.range(3000).selectExpr("concat('/in/p', id * 7919 % 3000, '.jpg') as path").union(spark.createDataFrame([("/other/x.jpg",)], "path string"))
    got = in_natural_order(files)
    assert [r.path for r in got.where("path like '/in/%'").orderBy("page_seq").collect()] == [f"/in/p{i}.jpg" for i in range(3000)]
    assert got.where("path like '/other/%'").first().page_seq == 0
    (folder,) = session.shared_tables(spark) - before
    ranges = spark.read.parquet(folder).where("path like '/in/%'").groupBy("_range").count().collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(ranges) >= 3 and max(r["count"] for r in ranges) < 1500


def test_files_are_dealt_by_size(spark):
    """A few large files and many small ones: no task has much more than its share."""
    sizes = [40_000_000, 30_000_000, 30_000_000] + [3_000_000] * 40 + [100_000] * 900
    files = spark.createDataFrame([(f"/in/{i * 7919 % 10007}.jpg", n) for i, n in enumerate(sizes)], "path string, length long")
    got = dealt_by_size(files, 7)
    assert got.rdd.getNumPartitions() == 7 and got.columns == files.columns
    loads = got.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("length").alias("n"), F.count("*").alias("files")).collect()
    assert sum(r.files for r in loads) == len(sizes) and len(loads) == 7
    assert max(r.n for r in loads) < 1.3 * sum(sizes) / 7
    assert dealt_by_size(files.where("false"), 3).count() == 0


def test_providers(spark):
    pages = spark.createDataFrame([("p", "x.jpg", bytearray(b"a\nb")), ("q", "y.jpg", bytearray(b"\xff"))], "page_id string, path string, content binary")
    found, errors = providers.page_errors(providers.ocr_elements(pages, providers.text_lines_provider))
    assert [(r.page_id, r.text) for r in found.orderBy("elem_idx").collect()] == [("p", "a"), ("p", "b")]
    (bad,) = errors.collect()
    assert bad.page_id == "q" and bad.error_type == "other" and "decode" in bad.error

    def missing():
        raise FileNotFoundError("no engine")

    assert {(r.page_id, r.error, r.error_type) for r in providers.ocr_elements(pages, missing).collect()} == {("p", "no engine", "missing"), ("q", "no engine", "missing")}
    files = spark.createDataFrame([("j", 0, "a.ppt"), ("j", 1, "b.ppt"), ("j", 2, "c.ppt")], "job_id string, file_seq long, path string")

    def engine(ok):
        def make():
            def run(path):
                if path[0] not in ok:
                    raise ValueError("no")
                return path + ".pdf"

            return run

        return make

    out = providers.convert_with_fallback(files, engine("a"), engine("b"), "none works")
    assert sorted((r.file_seq, r.ok, r.error) for r in out.collect()) == [(0, True, None), (1, True, None), (2, False, "none works")]
    assert providers.within(5, lambda x: x + 1, 1) == 2 and providers.within(None, len, "ab") == 2
    assert providers.normalise_lines([("a", 1), "b", ([[0, 0]], ("c", 0.9)), 3]) == ["a", "b", "c"]
    assert providers.normalise_lines(("d", 1)) == ["d"] and providers.normalise_lines(5) is None


def test_engines_run_once(spark, tmp_path):
    """Each engine has one call a file at most, the second only for failures; limits and types of error."""
    files = spark.createDataFrame([("j", i, f"{i}.ppt") for i in range(6)], "job_id string, file_seq long, path string")
    folder = str(tmp_path)

    def engine(name, fails):
        def make():
            def run(path):
                with open(f"{folder}/{name}", "a") as f:
                    f.write(path + "\n")
                n = int(path[0])
                if n == 4 and name == "one":
                    time.sleep(30)
                if n == 3:
                    raise FileNotFoundError("engine")
                if n in fails:
                    raise subprocess.CalledProcessError(1, "engine")
                return path + ".pdf"

            return run

        return make

    out = providers.convert_with_fallback(files, engine("one", (1, 2)), engine("two", (2,)), "no engine", seconds=1.0)
    got = {r.file_seq: (r.ok, r.error, r.error_type) for r in out.unionByName(out.where("false")).collect()}
    assert got == {0: (True, None, None), 1: (True, None, None), 2: (False, "no engine", "failed"), 3: (False, "no engine", "missing"), 4: (True, None, None), 5: (True, None, None)}
    calls = {n: sorted((tmp_path / n).read_text().split()) for n in ("one", "two")}
    assert calls == {"one": [f"{i}.ppt" for i in range(6)], "two": ["1.ppt", "2.ppt", "3.ppt", "4.ppt"]}
    slow = providers.convert(files.where("file_seq = 4"), engine("one", ()), seconds=0.5).first()
    assert (slow.ok, slow.error_type) == (False, "timeout")


def pages_provider():
    """A stand-in engine: a page is JSON, its elements as they are."""
    return lambda path, content: json.loads(content.decode())


def test_documents_end_to_end(spark, tmp_path):
    box = lambda y: [{"x": 0.0, "y": float(y)}, {"x": 1.0, "y": float(y)}]
    table = '<table><tr><td rowspan="2">A</td><td colspan="2">B</td></tr><tr><td>C</td><td rowspan="5">D</td></tr></table>'
    words = ["1", "15.", "西汉", "a", "b", "c", "d", "北宋", "e", "f", "g", "37.1%", "end"]
    pages = {
        "2.jpg": [{"kind": "text", "lines": ["x", " y\n"]}, {"text": "plain"}],
        "10.jpg": [{"kind": "table", "html": table}, {"kind": "text", "lines": ["hidden"]}, {"kind": "table", "html": "<p>"}],
        "6.jpg": [{"text": w, "box": box(100 - i)} for i, w in enumerate(words)],
        "7.jpg": [],
    }
    for name, found in pages.items():
        (tmp_path / name).write_text(json.dumps(found))
    cfg = config.Config(input_directory=str(tmp_path))
    made = extract(spark, pages_provider, cfg)
    got = docx.parse(made.select(F.col("doc_id").alias("path"), "content")).orderBy("block_seq").collect()
    flat = [(r.kind, r.text) if r.cells is None else (r.kind, [tuple(c) for c in r.cells]) for r in got]
    end = ("page_break", "")
    line = lambda t: ("paragraph", t)
    head = lambda t: ("heading", t)
    six = [(0, 0, "", 1, 1), (0, 1, "南方", 2, 1), (0, 3, "北方", 2, 1)] + [(1, i, t, 1, 1) for i, t in enumerate(("朝代", "人口（户）", "占全国户口数比例", "人口（户）", "占全国户口数比例"))]
    six += [(2, i, t, 1, 1) for i, t in enumerate(words[2:7])] + [(3, i, t, 1, 1) for i, t in enumerate(words[7:12])]
    ten = [(0, 0, "A", 1, 2), (0, 1, "B", 2, 1), (1, 1, "C", 1, 1), (1, 2, "D", 1, 1)]
    assert flat == [
        head("Content from 2.jpg"), line("x"), line("y"), line("plain"), end,
        head("Content from 6.jpg"), line("end"), line("37.1%"), ("table", six), line(""), line("end"), end,
        head("Content from 7.jpg"), line("[No content could be extracted from 7.jpg]\n"), end,
        head("Content from 10.jpg"), ("table", ten), line(""), line("[Warning: Could not find table structure in provided HTML]"), line(""),
    ]
    one = extract(spark, pages_provider, path=str(tmp_path / "2.jpg"))
    assert [r.text for r in docx.parse(one.select(F.col("doc_id").alias("path"), "content")).orderBy("block_seq").collect()] == ["x", "y", "plain"]
    assert extract(spark, pages_provider, path=str(tmp_path / "none.jpg")).count() == 0
    assert (made.first().failed_pages, made.first().page_error) == (0, None)
    (tmp_path / "11.jpg").write_text("no json")
    hurt = extract(spark, pages_provider, cfg).first()
    assert hurt.failed_pages == 1 and "Expecting value" in hurt.page_error and hurt.status == "success"
    assert docx.document_rows(bytes(hurt.content))[-1][1] == "[No content could be extracted from 11.jpg]\n"

    def printer():
        def run(content):
            return b"%PDF" + content[:2]

        return run

    def broken():
        raise FileNotFoundError("no printer")

    done = extract(spark, pages_provider, path=str(tmp_path / "2.jpg"), output_format="pdf", to_pdf=printer)
    save(done, str(tmp_path / "out"))
    assert (tmp_path / "out" / "2.pdf").read_bytes() == b"%PDFPK"
    kept = extract(spark, pages_provider, path=str(tmp_path / "2.jpg"), output_format="pdf", to_pdf=lambda: lambda c: broken()).first()
    assert (kept.format, kept.status, kept.message) == ("docx", "conversion_error_fallback", "no printer")


def test_handlers_are_called_once_a_page(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def count(page):
        with open(calls, "a") as f:
            f.write(f"{page[0]['page_id']}\n")
        return [("paragraph", " ".join(e["text"] for e in page)), ("table", "", [(0, 0, "x", 1, 1)], 1, 1)]

    pages = spark.createDataFrame([(0, i, i, "own.jpg" if i % 2 else "6.jpg") for i in range(6)], "doc_id int, page_id long, page_seq int, filename string")
    box = [{"x": 0.0, "y": 1.0}]
    rows = [(i, j, None, f"t{j}", box, None, None) for i in range(6) for j in (2, 0, 1)]
    found = spark.createDataFrame(rows, "page_id long, elem_idx int, kind string, text string, box array<struct<x:double,y:double>>, html string, lines array<string>").repartition(5)
    out = documents.document_blocks(pages, found, handlers=anchored.HANDLERS | {"own.jpg": count}).collect()
    assert sorted(open(calls).read().split()) == ["1", "3", "5"]
    own = [r for r in sorted(out, key=lambda r: r.block_seq)]
    assert [r.text for r in own if r.text == "t0 t1 t2"] == ["t0 t1 t2"] * 3 and [r.kind for r in own][:6] == ["heading", "paragraph", "paragraph", "table", "blank", "paragraph"]
    assert sum(r.kind == "table" for r in own) == 6 and own[3].n_rows == 2 and own[3].n_cols == 5


def test_history_tree(spark, tmp_path):
    """A filter on user and date lists that folder alone."""
    for user in ("u", "v", "w"):
        for day in ("20240101", "20240102", "notes"):
            folder = tmp_path / user / day / "converted_files"
            folder.mkdir(parents=True)
            (folder / f"{user}.docx").write_text("x")
            (folder / f"{user}.docx.meta").write_text("one,two")
            (tmp_path / user / day / "uploads").mkdir()
    (tmp_path / "note.txt").write_text("x")
    every = history_tree.read_tree(spark, str(tmp_path))
    assert sorted(map(tuple, every.where("is_meta").collect())) == sorted((u, d, "converted_files", f"{u}.docx.meta", True, "one,two") for u in "uvw" for d in ("20240101", "20240102"))
    assert every.count() == 12 and every.rdd.getNumPartitions() == 6
    old = scan_history(spark, str(tmp_path))
    assert sorted(map(repr, every.select(sorted(old.columns)).collect())) == sorted(map(repr, old.select(sorted(old.columns)).collect()))
    one = every.where("username = 'v' and ymd = '20240102' and filename like '%.docx'")
    assert [r.filename for r in one.collect()] == ["v.docx"] and one.rdd.getNumPartitions() == 1
    reader = history_tree.HistoryReader(str(tmp_path))
    left = list(reader.pushFilters([EqualTo(("username",), "v"), In(("ymd",), ("20240102", "19990101")), EqualTo(("filename",), "v.docx")]))
    assert [f.attribute for f in left] == [("filename",)]
    (day,) = reader.partitions()
    assert (day.username, day.ymd, reader.listed) == ("v", "20240102", [])
    assert len(list(reader.read(day))) == 2 and reader.listed == [str(tmp_path / "v" / "20240102"), str(tmp_path / "v" / "20240102" / "converted_files"), str(tmp_path / "v" / "20240102" / "uploads")]
    assert every.where("username = 'none'").count() == 0 and every.where("username = '..'").count() == 0
    assert history_tree.read_tree(spark, str(tmp_path / "none")).count() == 0


def test_pages_of_several_documents(spark):
    """Each document ends without a page break."""
    pages = spark.createDataFrame([("d", "a", 0, "a.jpg"), ("d", "b", 1, "b.jpg"), ("e", "c", 0, "c.jpg")], "doc_id string, page_id string, page_seq int, filename string")
    out = documents.document_blocks(pages, spark.createDataFrame([], ELEMENTS + ", box array<struct<x:double,y:double>>"))
    assert sorted((r.doc_id, r.block_seq) for r in out.where("kind = 'page_break'").collect()) == [("d", 2)]


def test_merge_files(spark):
    files = spark.createDataFrame([("j", 1, bytearray(b"b")), ("j", 0, bytearray(b"a")), ("k", 0, bytearray(b"x"))], "job_id string, file_seq long, content binary")

    def engine():
        def run(parts):
            if parts == [b"x"]:
                raise ValueError("bad file")
            return b"".join(parts)

        return run

    got = {r.job_id: (r.ok, r.content and bytes(r.content), r.error) for r in providers.merge_files(files, engine).collect()}
    assert got == {"j": (True, b"ab", None), "k": (False, None, "bad file")}
    assert providers.unwrap_page([[1]]) == [1] and providers.unwrap_page(None) == [] and providers.unwrap_page([None]) == []


def test_docx_round_trip(spark):
    tables = [(0, 0, "a\nb", 2, 1), (0, 2, "c", 1, 3), (1, 0, "<d>", 1, 2), (2, 1, "e", 1, 1)]
    spanned = docx.document_rows(docx.document_bytes([("paragraph", "p"), ("table", "", tables, 3, 3), ("blank", "")]))
    assert [(k, t) for k, t, _ in spanned] == [("paragraph", "p"), ("table", ""), ("paragraph", "")]
    assert [c for c in spanned[1][2] if c[2]] == sorted(tables) and (1, 1, "", 1, 1) in spanned[1][2]
    wide = docx.document_rows(docx.document_bytes([("table", "", [(0, 0, "x", 2_000_000_000, 1), (0, 2_000_000_000, "y", 1, 1), (1, 0, "z", 7, 1)], 2, 2_000_000_001)]))
    assert wide[0][2] == [(0, 0, "x", 2, 1), (0, 2, "y", 1, 1), (1, 0, "z", 1, 1), (1, 1, "", 1, 1), (1, 2, "", 1, 1)]
    blocks = spark.createDataFrame([("d", 0, "heading", "H"), ("d", 1, "paragraph", "a <b>\nc"), ("d", 2, "page_break", None)], "doc_id string, block_seq int, kind string, text string")
    made = docx.render(blocks).select(F.col("doc_id").alias("path"), "content")
    assert [(r.kind, r.text) for r in docx.parse(made).orderBy("block_seq").collect()] == [("heading", "H"), ("paragraph", "a <b>\nc"), ("page_break", "")]


def test_docx_tables_of_any_width(spark):
    """Each so many columns are a table of their own; no text is lost, and a cell that goes on has it once."""
    for width in (63, 64, 70, 200):
        cells = [(0, i, f"a{i}", 1, 1) for i in range(width)] + [(1, 0, "wide", width, 2)] + [(3, i, f"b{i}", 1, 1) for i in range(0, width, 2)]
        parts = [c for kind, _, c in docx.document_rows(docx.document_bytes([("table", "", cells, 4, width)])) if kind == "table"]
        assert [max(x + n for _, x, _, n, _ in p) for p in parts] == [63] * (width // 63) + [width % 63] * (width % 63 > 0)
        assert [t for p in parts for y, _, t, *_ in p if y == 0] == [f"a{i}" for i in range(width)]
        assert [(t, n, h) for p in parts for y, _, t, n, h in p if y == 1] == [("wide" * (i == 0), min(63, width - 63 * i), 2) for i in range(len(parts))]
        assert [t for p in parts for y, _, t, *_ in p if y == 3 and t] == [f"b{i}" for i in range(0, width, 2)]


def test_document_sink(spark, tmp_path):
    """Whole files from the tasks, or none."""
    out = tmp_path / "out"
    rows = [(f"/in/d{d}.x", i, "paragraph", f"{d}.{i}") for d in range(20) for i in range(30)]
    blocks = spark.createDataFrame(rows, "doc_id string, block_seq int, kind string, text string").repartition(5, "block_seq")
    sinks.write_documents(blocks, str(out))
    files = scan_images(spark, str(out), "*.docx")
    got = docx.parse(files.select("path", "content")).collect()
    assert sorted((r.path.rpartition("/")[2], r.block_seq, r.text) for r in got) == sorted((f"d{d}.docx", i, f"{d}.{i}") for d in range(20) for i in range(30))
    assert sorted(os.listdir(out)) == sorted([f"d{d}.docx" for d in range(20)] + ["_SUCCESS"])
    before = {p.name: p.read_bytes() for p in out.iterdir()}
    # blocks of a document in several tasks, or out of order; two documents of one name; a task that fails
    sinks.register(spark)
    plain = blocks.write.format("docx").mode("append")
    other = blocks.withColumn("doc_id", F.concat(F.lit("/else"), "doc_id"))
    bad = blocks.where("text <> '7.3'").union(blocks.where("text = '7.3'").withColumn("kind", F.raise_error(F.lit("broken"))))
    for attempt, why in ((lambda: plain.save(str(out)), "several tasks|not together|comes after"), (lambda: sinks.write_documents(blocks.union(other), str(out)), "same name"), (lambda: sinks.write_documents(bad, str(out)), "broken")):
        with pytest.raises(Exception, match=why):
            attempt()
        assert {p.name: p.read_bytes() for p in out.iterdir()} == before
    # overwriting leaves what is new
    sinks.write_documents(blocks.where("doc_id = '/in/d3.x'"), str(out), mode="overwrite")
    assert sorted(os.listdir(out)) == ["_SUCCESS", "d3.docx"]
    files = spark.createDataFrame([("a.bin", bytearray(b"xy")), ("b.bin", None)], "name string, content binary")
    sinks.write_files(files, str(tmp_path / "plain"))
    assert (tmp_path / "plain" / "a.bin").read_bytes() == b"xy" and (tmp_path / "plain" / "b.bin").read_bytes() == b""
    with pytest.raises(Exception, match="not a file name"):
        sinks.write_files(files.withColumn("name", F.lit("../x")), str(tmp_path / "plain"))
    sinks.write_files(files.withColumn("name", F.concat(F.lit("a/b/"), "name")), str(tmp_path / "plain"))
    assert sorted(os.listdir(tmp_path / "plain" / "a" / "b")) == ["a.bin", "b.bin"]
    assert sinks.document_name("a/.x") == ".x.docx" and sinks.document_name("a/b/") == "b.docx"


SCRIPTS = {
    "good": 'echo done > "$2/$(basename "${1%.*}").pdf"; sleep 100 & exit 0',
    "hang": "(sleep 200; echo x) & sleep 200",
    "bad": "echo no licence >&2; exit 3",
    "none": "exit 0",
}


def test_supervised_programs(spark, tmp_path):
    """Programs that succeed, hang, fail or write nothing; no process and no scratch folder is left."""
    scratch = tmp_path / "tmp"
    scratch.mkdir()
    files = spark.createDataFrame([("j", i, f"/in/{i}.ppt") for i in range(3)], "job_id string, file_seq long, path string")
    got = {}
    for name, body in SCRIPTS.items():
        script = tmp_path / f"{name}.sh"
        script.write_text(f"#!/bin/bash\nexport MARK={tmp_path.name}\n{body}\n")
        script.chmod(0o755)
        make = providers.command([str(script), "{path}", "{out}"], str(tmp_path / "made"), seconds=1.5)

        def local(make=make):
            import tempfile

            tempfile.tempdir = str(scratch)
            return make()

        got[name] = {(r.ok, r.path, r.error_type) for r in providers.convert(files, local).collect()}
    assert got["good"] == {(True, str(tmp_path / "made" / f"{i}.pdf"), None) for i in range(3)}
    assert got["hang"] == {(False, None, "timeout")} and got["bad"] == {(False, None, "failed")} and got["none"] == {(False, None, "no_output")}
    gone = providers.convert(files, providers.command(["/no/such/program"], str(tmp_path))).collect()
    assert {(r.ok, r.error_type) for r in gone} == {(False, "missing")}
    assert sorted(os.listdir(tmp_path / "made")) == ["0.pdf", "1.pdf", "2.pdf"] and (tmp_path / "made" / "0.pdf").read_text() == "done\n"
    assert os.listdir(scratch) == []
    alive = [p for p in os.listdir("/proc") if p.isdigit() and f"MARK={tmp_path.name}".encode() in _environment(p)]
    assert alive == []


def _environment(pid):
    try:
        with open(f"/proc/{pid}/environ", "rb") as f:
            return f.read()
    except OSError:
        return b""


def test_config(spark, tmp_path):
    assert config.load_config(spark, str(tmp_path / "none")) == config.Config()
    (tmp_path / "c.yaml").write_text("input_directory: 'in'\nfont_size: 12\nother: 1\nlog_file:\n")
    assert config.load_config(spark, str(tmp_path / "c.yaml")) == config.Config(input_directory="in", font_size=12)
    (tmp_path / "long.yaml").write_text("".join(f"key{i}: {i}\n" for i in range(5000)) + "font_name: Last\n")
    assert config.load_config(spark, str(tmp_path / "long.yaml")).font_name == "Last"


def test_settings_as_yaml(spark, tmp_path):
    text = "---\n# a comment\ninput_directory: his pic # where\noutput_filename: 'it''s #1.docx'  # name\nlog_file: \"a\\tb\"\nlogger_name: ~\nother:\n  font_name: Nested\n  - x\nlist:\n- a\n- b\nfont_name: A:B\nnote: |\n  free text: here\nfont_size: 12\n"
    (tmp_path / "c.yaml").write_text(text)
    assert config.load_config(spark, str(tmp_path / "c.yaml")) == config.Config(input_directory="his pic", output_filename="it's #1.docx", log_file="a\tb", font_name="A:B", font_size=12)
    for bad, why in (("no colon", "line 1: not a key"), ("a: 1\n  b: 2", "line 2: something below"), ("a: 'x", "line 1: a quote"), ("a: \"x\" y", "line 1: a quote"), ("font_size: big", "font_size is no number")):
        (tmp_path / "bad.yaml").write_text(bad)
        with pytest.raises(config.ConfigError, match=why):
            config.load_config(spark, str(tmp_path / "bad.yaml"))


def test_shared_tables(spark):
    a = session.written(spark.range(3))
    before = session.shared_tables(spark)
    b, c = session.written(spark.range(4)), session.written(spark.range(5))
    session.release(spark, before, keep=[c])
    assert a.count() == 3 and c.count() == 5
    with pytest.raises(Exception, match="does not exist|FAILED_READ_FILE"):
        b.collect()
    assert len(session.shared_tables(spark) - before) == 1


def test_streaming(spark, tmp_path):
    from folioforge.streaming import incremental

    (tmp_path / "in" / "ann").mkdir(parents=True)
    (tmp_path / "in" / "ann" / "a.jpg").write_text("xx")
    rows = incremental.upload_rows(incremental.arriving(spark, str(tmp_path / "in")))
    q = incremental.append_history(rows, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.username, r.filename, r["size"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("ann", "a.jpg", 2)]
    day = spark.createDataFrame([(datetime.datetime(2024, 1, 1), "u", 5)], "ts timestamp, username string, size long")
    assert incremental.daily_counts(day).count() == 1


def test_stream_intake(spark, tmp_path):
    """The rows of the batch rules, however the stream is cut, also over restarts."""
    from folioforge.streaming.intake import drain, stream_intake

    rows = [(f"j{i % 3}", i, f"f{i * i % (17 if i % 3 else 5)}", 11 * 1024 * 1024 if i % 7 == 0 else 5) for i in range(90)]
    schema = "job_id string, file_seq int, name string, size long"
    want = sorted((r.job_id, r.file_seq, r.name, r["size"], r.slot) for r in intake.intake(spark.createDataFrame(rows, schema)).collect())
    for cuts in ([90], [7, 8, 40, 90], [60, 61, 90]):
        src, out = tmp_path / f"in{len(cuts)}", tmp_path / f"out{len(cuts)}"
        src.mkdir()
        last = 0
        for n in cuts:  # each a run of its own
            part = rows[last:n][::-1]
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
            last = n
            files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
            drain(stream_intake(files).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", f"{out}.state"))
        got = sorted((r.job_id, r.file_seq, r.name, r["size"], r.slot) for r in spark.read.parquet(str(out)).collect())
        assert got == want
