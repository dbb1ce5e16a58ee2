"""Conversion history: listing, deletion, and users.

``history`` has username, ymd, filename, area (uploads or converted_files),
is_meta and meta_content (FIXTURES R8). Listing and deletion look at converted files only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import first_text, is_day, media_url, stem
from folioforge.session import written

# What the listings show.
DONE = "已完成"
YES, NO = "是", "否"
OUTPUTS = "converted_files"


def dates(history: DataFrame) -> DataFrame:
    """The users' dates that have a folder, newest first."""
    return history.where(is_day(F.col("ymd"))).select("username", "ymd").distinct().orderBy("username", F.desc("ymd"))


def listing(history: DataFrame, selected: DataFrame | None = None, trim: str | None = None) -> DataFrame:
    """Converted files with the name they came from: the sidecar's, else the file's stem (less ``trim`` at its end).

    ``selected`` (username, ymd) keeps those dates only, if they exist.
    """
    files = history.where(is_day(F.col("ymd")) & (F.col("area") == OUTPUTS))
    if selected is not None:
        files = files.join(selected, ["username", "ymd"], "left_semi")
    out = files.where("not is_meta")
    meta = files.where("is_meta").select("username", "ymd", F.regexp_replace("filename", r"\.meta$", "").alias("filename"), "meta_content")
    name = stem(F.col("filename"))
    name = F.regexp_replace(name, f"{trim}$", "") if trim else name
    url = media_url(F.concat_ws("/", F.lit("his_pic"), "username", "ymd", F.lit(OUTPUTS), "filename"))
    return out.select("username", "ymd", "filename").join(meta, ["username", "ymd", "filename"], "left").select("username", "ymd", F.coalesce("meta_content", name).alias("original_name"), F.col("filename").alias("converted_name"), url.alias("download_url"), F.lit(DONE).alias("status"))


def delete_outputs(history: DataFrame, deleted: DataFrame) -> DataFrame:
    """The history without the deleted outputs (username, ymd, filename) and their sidecars; uploads of the same name stay."""
    gone = deleted.select("username", "ymd", "filename").unionByName(deleted.select("username", "ymd", F.concat("filename", F.lit(".meta")).alias("filename")))
    return history.join(gone.withColumn("area", F.lit(OUTPUTS)), ["username", "ymd", "filename", "area"], "left_anti")


def delete_user(users: DataFrame, history: DataFrame, target: str, requester: str) -> tuple[DataFrame, DataFrame]:
    """Users and history without the target and all that is theirs; nobody deletes themself."""
    if target == requester:
        return users, history
    return users.where(F.col("username") != target), history.where(F.col("username") != target)


def overwrite_history(history: DataFrame, path: str) -> None:
    """Write the dataset by user and date; readers then list one folder for one date."""
    history.write.mode("overwrite").partitionBy("username", "ymd").parquet(path)


def delete_from(path: str, history: DataFrame, deleted: DataFrame) -> None:
    """Delete outputs from the dataset at the path, of which ``history`` is the reading: only the dates touched are written anew.

    A date of which nothing is left loses its folder last. If the job fails before that, the date's outputs are still there; run it again.
    """
    spark = history.sparkSession
    dates = [(r.username, r.ymd) for r in deleted.select("username", "ymd").distinct().collect()]  # those of one request
    touched = history.where(F.struct("username", "ymd").isin([F.struct(F.lit(u), F.lit(d)) for u, d in dates])) if dates else history.where("false")
    left = written(delete_outputs(touched, deleted))
    left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("username", "ymd").parquet(path)
    kept = {(r.username, r.ymd) for r in left.select("username", "ymd").distinct().collect()}
    for user, ymd in dates:
        if (user, ymd) not in kept:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/username={user}/ymd={ymd}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def user_listing(users: DataFrame) -> DataFrame:
    return users.select("id", "username", first_text(F.col("email"), F.lit("N/A")).alias("email"), F.when(F.col("is_superuser"), YES).otherwise(NO).alias("superuser"), (~F.col("is_superuser")).alias("has_delete_link"))


def client_rows(results: DataFrame, *keys: str) -> DataFrame:
    """What the page shows of results, beside the keys."""
    linked = (F.col("status") == "success") & F.nullif(F.col("download_url"), F.lit("")).isNotNull()
    return results.select(*keys, first_text(F.col("original_name"), F.lit("N/A")).alias("original_name"), first_text(F.col("message"), F.col("status")).alias("shown"), F.when(linked, F.col("download_url")).alias("link"))


def latest(history: DataFrame) -> DataFrame:
    """The newest date of each user."""
    return history.withColumn("_r", F.row_number().over(Window.partitionBy("username").orderBy(F.desc("ymd"), "filename"))).where("_r = 1").drop("_r")
