"""From a folder of images, or one image, to written documents."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text
from folioforge.operators.anchored import HANDLERS, Anchored
from folioforge.operators.documents import document_blocks
from folioforge.session import written
from folioforge.sources import docx, sinks
from folioforge.sources.config import Config
from folioforge.sources.files import dealt_by_size, in_natural_order, scan_file, scan_images
from folioforge.sources.providers import LIMIT, Ocr, ocr_elements, page_errors, within

ToPdf = Callable[[], Callable[[bytes], bytes]]


def pages_of(files: DataFrame, single: bool = False) -> DataFrame:
    """doc_id, page_id, page_seq and filename of image files (path); a folder, or a ``single`` file, is one document."""
    doc = F.col("path") if single else F.regexp_replace("path", "/[^/]*$", "")
    return in_natural_order(files.select("path")).select(doc.alias("doc_id"), F.col("path").alias("page_id"), "page_seq", "filename")


def as_pdf(documents: DataFrame, provider: ToPdf, seconds: float | None = LIMIT) -> DataFrame:
    """Documents (doc_id, content) with their status: the PDF, or the document itself where the conversion fails."""

    def run(batches):
        engine = provider()
        for pdf in batches:
            rows = []
            for d in pdf.itertuples():
                try:
                    rows.append([d.doc_id, within(seconds, engine, d.content), "pdf", "success", None])
                except Exception as e:
                    rows.append([d.doc_id, d.content, "docx", "conversion_error_fallback", str(e)])
            yield pd.DataFrame(rows, columns=["doc_id", "content", "format", "status", "message"])

    return documents.select("doc_id", "content").mapInPandas(run, "doc_id string, content binary, format string, status string, message string")


def extract(spark: SparkSession, ocr: Ocr, config: Config | None = None, path: str | None = None, output_format: str = "docx", to_pdf: ToPdf | None = None, handlers: dict[str, Anchored] | None = None, keep_text: bool = False) -> DataFrame:
    """doc_id, content, format, status, message, failed_pages and page_error of the document of config's input folder, or of the one image at ``path``.

    Pages are dealt to tasks by their sizes and read by the engine once. A page that fails is an empty page in the document;
    ``page_error`` is the first one's error. A missing image gives no document. Without ``to_pdf`` the wish for a PDF counts as docx.
    """
    config = config or Config()
    files = scan_file(spark, path) if path else scan_images(spark, config.input_directory)
    pages = pages_of(files, path is not None)
    dealt = dealt_by_size(files, spark.sparkContext.defaultParallelism).select(F.col("path").alias("page_id"), "path", "content")
    found, errors = page_errors(written(ocr_elements(dealt, ocr)))
    blocks = document_blocks(pages, found, single=path is not None, keep_text=keep_text, handlers=HANDLERS if handlers is None else handlers)
    made = docx.render(blocks, config.font_name, config.font_size)
    if output_format == "pdf" and to_pdf is not None:
        made = as_pdf(made, to_pdf)
    else:
        made = made.select("doc_id", "content", F.lit("docx").alias("format"), F.lit("success").alias("status"), F.lit(None).cast("string").alias("message"))
    failed = errors.join(pages, "page_id").groupBy("doc_id").agg(F.count("*").alias("failed_pages"), F.min_by("error", "page_seq").alias("page_error"))
    return made.join(failed, "doc_id", "left").withColumn("failed_pages", F.coalesce("failed_pages", F.lit(0)))


def save(documents: DataFrame, folder: str, name: str | None = None) -> None:
    """Write the documents of ``extract`` into a shared folder, from the tasks; ``name`` (without extension) if there is only one."""
    stem = F.lit(name) if name else text.stem(text.basename(F.col("doc_id")))
    sinks.write_files(documents.select(F.concat(stem, F.lit("."), F.col("format")).alias("name"), "content"), folder)
