"""Uploads that arrive one after the other, as a stream (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from folioforge.functions.text import basename, day
from folioforge.sources.files import FILE_SCHEMA


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Files that appear in a folder of users' folders."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)


def upload_rows(files: DataFrame) -> DataFrame:
    """username, ymd, filename, size and status of arriving files; the user is the file's folder."""
    user = F.element_at(F.split("path", "/"), -2)
    return files.select(user.alias("username"), day(F.col("modificationTime")).alias("ymd"), basename(F.col("path")).alias("filename"), F.col("length").alias("size"), F.lit("uploaded").alias("status"))


def append_history(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends rows to the dataset by user and date."""
    return rows.writeStream.format("parquet").partitionBy("username", "ymd").option("checkpointLocation", checkpoint).option("path", path).outputMode("append")


def daily_counts(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """Files of each user and day; ``ts`` is the event time, rows later than ``late`` are left out."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "username").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))
