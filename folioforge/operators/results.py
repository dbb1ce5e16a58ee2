"""Results of conversion jobs, one by one or merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import first_text, media_url, ordered_join


# What stands before and after the file's name where its PDF failed and the document is kept.
FALLBACK = ("文件 ", " 的PDF转换失败，保留原始文件。错误: ")


def script_outcome(return_code: Column, exists: Column, stderr: Column, stdout: Column, default: str = "Unknown error") -> Column:
    """struct(ok, error): the error is the first text that the script left, or the default."""
    ok = F.coalesce((return_code == 0) & exists, F.lit(False))
    return F.struct(ok.alias("ok"), F.when(~ok, first_text(stderr, stdout, F.lit(default))).alias("error"))


def first_success(*outcomes: Column, error: str) -> Column:
    """The first outcome (ok, path, error) that succeeded, else one fixed error."""
    failed = F.struct(F.lit(False).alias("ok"), F.lit(None).cast("string").alias("path"), F.lit(error).alias("error"))
    return F.coalesce(*[F.when(o["ok"], o) for o in outcomes], failed)


def until_failure(files: DataFrame, job: str = "job_id") -> DataFrame:
    """The files of each job up to and with the first that failed."""
    before = Window.partitionBy(job).orderBy("file_seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("_stop", F.coalesce(F.max(F.col("failed").cast("int")).over(before), F.lit(0))).where("_stop = 0").drop("_stop")


def merged_results(files: DataFrame, job: str = "job_id") -> DataFrame:
    """One row for each job that merges without failure; the rows up to the failure for the others.

    A merge hides earlier errors of its job; ``hidden_errors`` tells their number.
    """
    reached = until_failure(files, job)
    totals = files.groupBy(job).agg(F.max("failed").alias("any_failed"), ordered_join(F.col("file_seq"), F.col("name")).alias("names"), F.count_if("upload_error").alias("hidden_errors"))
    merged = totals.where("not any_failed").select(job, F.lit(None).cast("long").alias("file_seq"), F.col("names").alias("original_name"), F.lit("success").alias("status"), "hidden_errors")
    single = reached.join(totals.where("any_failed").select(job), job, "left_semi")
    status = F.when(F.col("failed"), "conversion_error").when(F.col("upload_error"), "upload_error").otherwise("success")
    rows = single.select(job, "file_seq", F.col("name").alias("original_name"), status.alias("status"), F.lit(0).cast("long").alias("hidden_errors"))
    return merged.unionByName(rows)


def individual_results(files: DataFrame, dedupe: bool = False) -> DataFrame:
    """A row for each file; one whose PDF failed has its fallback row before its success row (``dedupe`` keeps the latter)."""
    success = files.where("not script_failed").withColumn("status", F.lit("success"))
    failed = files.where("script_failed").withColumn("status", F.lit("conversion_error"))
    out = success.unionByName(failed)
    if not dedupe:
        out = out.unionByName(files.where("pdf_failed and not script_failed").withColumn("status", F.lit("conversion_error_fallback")))
    return out


def result_rows(results: DataFrame, username: Column, ymd: Column, error: Column | None = None) -> DataFrame:
    """Results (job_id, file_seq, original_name, status, converted_name) with their link and message.

    Only a success has a link; every other status has a message, which ends in ``error``.
    """
    success = F.col("status") == "success"
    url = media_url(F.concat_ws("/", username, ymd, F.lit("converted_files"), F.col("converted_name")))
    text = F.when(F.col("status") == "conversion_error_fallback", F.concat(F.lit(FALLBACK[0]), "original_name", F.lit(FALLBACK[1]))).otherwise(F.lit(""))
    message = F.concat(text, F.coalesce(error if error is not None else F.lit(None).cast("string"), F.lit("")))
    return results.select("job_id", "file_seq", "original_name", "converted_name", F.when(success, url).alias("download_url"), "status", F.when(~success, message).alias("message"))


def without_result(files: DataFrame, results: DataFrame) -> DataFrame:
    """Files that have no result yet, by job and place in it; a repeated name is a file of its own."""
    return files.join(results.select("job_id", "file_seq").distinct(), ["job_id", "file_seq"], "left_anti")


def job_flags(files: DataFrame, job: str = "job_id") -> DataFrame:
    return files.groupBy(job).agg(F.bool_or(F.col("status") == "uploaded").alias("any_uploaded"), F.every(F.col("status") == "uploaded").alias("all_uploaded"), F.min_by("name", "file_seq").alias("first_name"), F.count("*").alias("n_files"))


def merged_name(user: Column, ymd: Column, job: Column) -> Column:
    """user_date_xxxxxxxx; the eight characters are hex digits of a hash, so that reruns agree."""
    return F.concat_ws("_", user, ymd, F.substring(F.sha2(job.cast("string"), 256), 1, 8))


def result_json(results: DataFrame, job: str = "job_id") -> DataFrame:
    """One JSON text for each job with its results in file order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("file_seq", "original_name", "status"))), lambda x: F.struct(x["original_name"].alias("original_name"), x["status"].alias("status")))
    return results.groupBy(job).agg(F.to_json(F.struct(rows.alias("results"), F.first("merge_output").alias("merge_output"))).alias("body"))


def merged_blocks(blocks: DataFrame, job: str = "job_id") -> DataFrame:
    """Documents of a job one after the other, with a page break before each but the first."""
    later = blocks.select(job, "file_seq").distinct().join(blocks.groupBy(job).agg(F.min("file_seq").alias("_first")), job).where("file_seq > _first")
    breaks = later.select(job, "file_seq", F.lit(-1).alias("block_seq"), F.lit("page_break").alias("kind"), F.lit(None).cast("string").alias("text"))
    every = blocks.select(job, "file_seq", "block_seq", "kind", "text").unionByName(breaks)
    return every.withColumn("seq", F.row_number().over(Window.partitionBy(job).orderBy("file_seq", "block_seq")) - 1)


def document_outcome(wanted: Column, converted: Column, docx_path: Column, can_convert: bool = True) -> Column:
    """struct(path, status) of a written document: the PDF if it is wanted and was made, else the document itself.

    ``converted`` is the outcome (ok, path, error) of its conversion. Without a converter the wish counts as docx.
    """
    to_pdf = (F.lower(wanted) == "pdf") & F.lit(can_convert)
    made = F.coalesce(converted["ok"], F.lit(False))
    path = F.when(to_pdf & made, converted["path"]).otherwise(docx_path)
    return F.struct(path.alias("path"), F.when(to_pdf & ~made, "conversion_error_fallback").otherwise("success").alias("status"))


def library_gate(main_tab: Column, output_format: Column, has_converter: bool) -> Column:
    """The error of a job that needs the PDF library where it is missing; null if it may run."""
    blocked = (F.lower(output_format) == "pdf") & (main_tab != "imgToFile") & F.lit(not has_converter)
    return F.when(blocked, "PDF library is not available")


def sidecars(rows: DataFrame) -> DataFrame:
    """name and content of the sidecar of each success (username, ymd, converted_name, original_name, status): a merged file's holds its joined names, a single one's its own."""
    name = F.concat_ws("/", "username", "ymd", F.lit("converted_files"), F.concat("converted_name", F.lit(".meta")))
    return rows.where("status = 'success'").select(name.alias("name"), F.col("original_name").cast("binary").alias("content"))
