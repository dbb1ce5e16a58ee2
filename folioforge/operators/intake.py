"""Upload intake and routing of conversion jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions.text import extension, has_extension, stem

MOST_FILES = 10
MOST_BYTES = 10 * 1024 * 1024
NOT_IMPLEMENTED = "未实现的处理类型。"
# The file types that each input tab accepts.
ACCEPTS = {
    "images": (".jpg", ".jpeg", ".png", ".bmp"),
    "word": (".doc", ".docx"),
    "excel": (".xls", ".xlsx"),
    "ppt": (".ppt", ".pptx"),
    "txt": (".txt",),
    "pdf": (".pdf",),
}
# The routes, the input they take, and whether something handles them.
ROUTES = (
    ("imgToFile", "imgToWord", "images", True),
    ("imgToFile", "imgToPdf", "images", True),
    ("fileToPdf", "wordToPdf", "word", True),
    ("fileToPdf", "pptToPdf", "ppt", True),
    ("fileToPdf", "excelToPdf", "excel", False),
    ("fileToPdf", "txtToPdf", "txt", False),
    ("pdfToFile", "pdfToWord", "pdf", False),
    ("pdfToFile", "pdfToImg", "pdf", False),
)


def routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTES, "main_tab string, sub_tab string, input string, implemented boolean")


def accepted_types(spark: SparkSession) -> DataFrame:
    rows = [(main, sub, ext) for main, sub, kind, _ in ROUTES for ext in ACCEPTS[kind]]
    return spark.createDataFrame(rows, "main_tab string, sub_tab string, ext string")


def intake(uploads: DataFrame, job: str = "job_id") -> DataFrame:
    """The files of each job that are taken: not too large, the first of each name, the first ten by file_seq."""
    small = uploads.where(F.col("size") <= MOST_BYTES)
    by_name = Window.partitionBy(job, "name").orderBy("file_seq")
    firsts = small.withColumn("_r", F.row_number().over(by_name)).where("_r = 1")
    taken = firsts.withColumn("slot", F.row_number().over(Window.partitionBy(job).orderBy("file_seq")))
    return taken.where(F.col("slot") <= MOST_FILES).drop("_r")


def accepted(files: DataFrame, types: DataFrame) -> DataFrame:
    """Files whose extension their route accepts; ``types`` is the fixed list of accepted_types."""
    return files.withColumn("ext", F.lower(extension(F.col("name")))).join(F.broadcast(types), ["main_tab", "sub_tab", "ext"], "left_semi").drop("ext")


def unrouted(jobs: DataFrame, known: DataFrame) -> DataFrame:
    """Jobs of no implemented route, as error results; ``known`` is the fixed list of routes."""
    missing = jobs.join(F.broadcast(known.where("implemented")), ["main_tab", "sub_tab"], "left_anti")
    return missing.withColumn("status", F.lit("error")).withColumn("message", F.lit(NOT_IMPLEMENTED))


def wrong_type(name: Column, sub_tab: Column) -> Column:
    """Whether a file of the Word or PowerPoint route has another extension."""
    word, slides = has_extension(name, "docx", "doc"), has_extension(name, "pptx", "ppt")
    return F.when(sub_tab == "wordToPdf", ~word).when(sub_tab == "pptToPdf", ~slides).otherwise(F.lit(False))


def prepared(files: DataFrame) -> DataFrame:
    """Staged path of uploaded Word and PowerPoint files; Word files are staged as .docx whatever they were."""
    staged = F.when(F.col("sub_tab") == "wordToPdf", F.concat(stem(F.col("name")), F.lit("_prePdf.docx"))).when(F.col("sub_tab") == "pptToPdf", F.concat(stem(F.col("name")), F.lit("_prePdf"), extension(F.col("name"))))
    good = files.where((F.col("status") == "uploaded") & ~wrong_type(F.col("name"), F.col("sub_tab")))
    return good.select("*", F.coalesce(staged, F.col("name")).alias("path"), F.col("name").alias("original_name"), stem(F.col("name")).alias("base_filename_no_ext"))


def route_results(files: DataFrame) -> DataFrame:
    """Error rows of wrong types, failed uploads as they are, and the others as ready."""
    failed = files.where("status <> 'uploaded'").withColumn("outcome", F.col("status"))
    uploaded = files.where("status = 'uploaded'")
    wrong = wrong_type(F.col("name"), F.col("sub_tab"))
    return failed.unionByName(uploaded.where(wrong).withColumn("outcome", F.lit("error"))).unionByName(uploaded.where(~wrong).withColumn("outcome", F.lit("ready")))
