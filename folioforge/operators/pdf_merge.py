"""Merging PDF files as a job over their objects.

Files become rows of objects (sources.pdf). A file's numbers follow those of the files before it in its
job, by a sum over the files' counts; an object's place follows from the lengths of
those before it, by sums over ranges of objects; the cross-reference table is made of these rows. A task writes a file
row by row. No file and no job is held whole; only the list of a job's pages is one row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.ranges import with_running
from folioforge.session import small_batches, written
from folioforge.sources import pdf, sinks

HEADER = b"%PDF-1.7\n"
_ROWS = "number long, is_page boolean, pieces array<binary>, refs array<long>, error string"
_EACH = 64
#: Whole files that Python gets at a time.
FILES_AT_ONCE = 32


def objects(files: DataFrame) -> DataFrame:
    """job_id, file_seq, number, is_page, pieces, refs and error of the objects of files (job_id, file_seq, content); a file that can't be read is one row with its error."""

    def run(batches):
        names = ["job_id", "file_seq", "number", "is_page", "pieces", "refs", "error"]
        kinds = [None, None, pa.int64(), pa.bool_(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.string()]
        for b in batches:
            for i, content in enumerate(b.column("content")):  # one file at a time
                try:
                    rows = [(*r, None) for r in pdf.page_objects(content.as_py() or b"")]
                except (ValueError, KeyError, TypeError, IndexError, RecursionError) as e:  # whatever a damaged file leads to
                    rows = [(None, None, None, None, str(e) if isinstance(e, pdf.PdfError) else f"a damaged file: {e!r}")]
                for lo in range(0, len(rows), _EACH):
                    part = rows[lo : lo + _EACH]
                    keys = [b.column(k).take(pa.array([i] * len(part))) for k in ("job_id", "file_seq")]
                    yield pa.RecordBatch.from_arrays([*keys, *(pa.array([r[k] for r in part], kinds[k + 2]) for k in range(5))], names=names)

    keys = ", ".join(f"{c} {files.schema[c].dataType.simpleString()}" for c in ("job_id", "file_seq"))
    return files.select("job_id", "file_seq", "content").mapInArrow(run, f"{keys}, {_ROWS}")


def _assembled(batches):
    """The bytes of each object, with its references raised by its file's base."""
    for b in batches:
        out = []
        for number, base, pieces, refs in zip(*(b.column(c).to_pylist() for c in ("number", "base", "pieces", "refs")), strict=True):
            body = pieces[0] + b"".join((b"%d 0 R" % (r + base if r else 2)) + p for r, p in zip(refs, pieces[1:], strict=True))
            out.append(b"%d 0 obj\n%s\nendobj\n" % (number + base, body))
        numbers = pa.array([n + x for n, x in zip(b.column("number").to_pylist(), b.column("base").to_pylist(), strict=True)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("job_id"), numbers, b.column("is_page"), pa.array(out, pa.binary())], names=["job_id", "number", "is_page", "content"])


def merged_parts(found: DataFrame) -> DataFrame:
    """job_id, part and content: the merged file of each job in parts, of the rows of ``objects`` (written) of jobs without errors."""
    job = dict(found.dtypes)["job_id"]
    sizes = found.groupBy("job_id", "file_seq").agg(F.count("*").alias("n"))
    before = Window.partitionBy("job_id").orderBy("file_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = sizes.select("job_id", "file_seq", (F.sum("n").over(before) - F.col("n") + 2).alias("base"))
    based = found.join(bases, ["job_id", "file_seq"]).select("job_id", "number", "base", "is_page", "pieces", "refs")
    with small_batches(found.sparkSession):
        bodies = written(based.mapInArrow(_assembled, f"job_id {job}, number long, is_page boolean, content binary"))
    # pages have the smallest numbers of their file, in order
    pages = bodies.where("is_page").groupBy("job_id").agg(F.array_sort(F.collect_list("number")).alias("kids"))
    total = bodies.groupBy("job_id").agg(F.max("number").alias("last"))
    kids = F.concat_ws(" ", F.transform("kids", lambda x: F.concat(x.cast("string"), F.lit(" 0 R"))))
    tree = F.concat(F.lit("2 0 obj\n<</Type /Pages /Count "), F.size("kids").cast("string"), F.lit(" /Kids ["), kids, F.lit("]>>\nendobj\n"))
    roots = pages.select("job_id", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("number"), F.lit("1 0 obj\n<</Type /Catalog /Pages 2 0 R>>\nendobj\n").alias("t")), F.struct(F.lit(2).cast("long").alias("number"), tree.alias("t")))).alias("_r"))
    all_ = bodies.select("job_id", "number", "content").union(roots.select("job_id", "_r.number", F.col("_r.t").cast("binary")))
    placed = with_running(all_.withColumn("_size", F.length("content").cast("long")), "_size", ["job_id"], ["number"], "_at")
    place = F.col("_at") + len(HEADER)
    entries = placed.select("job_id", F.lit(1).alias("section"), "number", F.concat(F.lpad(place.cast("string"), 10, "0"), F.lit(" 00000 n \n")).cast("binary").alias("content"))
    ends = placed.groupBy("job_id").agg(F.max(place + F.col("_size")).alias("_end")).join(total, "job_id")
    count = (F.col("last") + 1).cast("string")
    table = F.concat(F.lit("xref\n0 "), count, F.lit("\n0000000000 65535 f \n")).cast("binary")
    tail = F.concat(F.lit("trailer\n<</Size "), count, F.lit(" /Root 1 0 R>>\nstartxref\n"), F.col("_end").cast("string"), F.lit("\n%%EOF\n")).cast("binary")
    fixed = lambda section, content: ends.select("job_id", F.lit(section).alias("section"), F.lit(0).cast("long").alias("number"), content.alias("content"))
    parts = placed.select("job_id", F.lit(0).alias("section"), "number", "content").union(entries).union(fixed(0, F.lit(HEADER))).union(fixed(1, table)).union(fixed(2, tail))
    return parts.select("job_id", F.struct("section", "number").alias("part"), "content")


def merge_pdfs(files: DataFrame, folder: str) -> DataFrame:
    """Merge the files (job_id, file_seq, content) of each job, in order, into ``<job_id>.pdf`` in a shared folder; job_id, ok, pages and error of each job.

    A job with a file that can't be read has the error of the first such file, and no output.
    """
    with small_batches(files.sparkSession, FILES_AT_ONCE):  # also what makes the files, if that is Python
        found = written(objects(files))
    bad = found.where("error is not null").groupBy("job_id").agg(F.min_by("error", "file_seq").alias("error"))
    good = found.join(bad, "job_id", "left_anti")
    sinks.write_parts(merged_parts(good).withColumn("name", F.concat(F.col("job_id").cast("string"), F.lit(".pdf"))), folder)
    pages = good.groupBy("job_id").agg(F.count_if("is_page").alias("pages"))
    return pages.select("job_id", F.lit(True).alias("ok"), "pages", F.lit(None).cast("string").alias("error")).union(bad.select("job_id", F.lit(False), F.lit(0).cast("long"), "error"))


def page_texts(paths: DataFrame) -> DataFrame:
    """path, page (from 0) and text of each page of the PDF files of these paths, in a folder that all tasks share; a task holds one file at a time."""

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                files, at = sinks.filesystem(path)
                with files.open_input_file(at) as f:
                    texts = pdf.page_texts(f.read())
                for lo in range(0, len(texts), _EACH):
                    part = texts[lo : lo + _EACH]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), pa.array(range(lo, lo + len(part)), pa.int64()), pa.array(part, pa.string())], names=["path", "page", "text"])

    return paths.select("path").mapInArrow(run, "path string, page long, text string")
