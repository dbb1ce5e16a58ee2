"""Sources: image folders, single files, history folders and sidecars."""

from __future__ import annotations

import heapq
import itertools

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import basename, is_day, natural_key
from folioforge.operators.ranges import with_running

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def scan_images(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """The images of one folder (not of its subfolders)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)


def scan_file(spark: SparkSession, path: str) -> DataFrame:
    """One file, whatever its extension; no row where there is none."""
    try:
        return spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FILE_SCHEMA)


def in_natural_order(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add filename and page_seq (from 0) by natural order of the path within ``keys``, its folder unless given; ties by the path itself.

    A folder may hold any number of files: they are numbered by ranges of the key, and its numbers added up.
    The listing is written; leave contents out and read them by path.
    """
    named = files.withColumn("filename", basename(F.col("path"))).withColumn("_key", natural_key(F.col("path"))).withColumn("_one", F.lit(1))
    own = keys or ["_folder"]
    named = named if keys else named.withColumn("_folder", F.regexp_replace("path", "[^/]*$", ""))
    return with_running(named, "_one", own, ["_key", "path"], "page_seq").drop("_key", "_one", "_folder")


#: A file is large if its weight is at least a partition's share over this; there are this many times the partitions at most.
LARGE = 8


def dealt_by_size(files: DataFrame, parts: int, size: str = "length", each: int = 1 << 16) -> DataFrame:
    """The files in ``parts`` partitions of about equal weight, a file's size and ``each`` besides.

    The large files (LARGE * parts at most, on the driver) go one by one, the largest first, to the partition with the least;
    the others fill up what is left, by running sums over ranges. So no partition has more than its share and a small file, unless one file does.
    """
    weighed = files.select("path", (F.coalesce(F.col(size), F.lit(0)) + F.lit(each)).cast("long").alias("_weight"))
    total = weighed.agg(F.sum("_weight").alias("n")).first().n or 0
    large = F.col("_weight") * (LARGE * parts) >= F.lit(total)
    loads, chosen = [(0, i) for i in range(parts)], []
    for r in sorted(weighed.where(large).collect(), key=lambda r: (-r["_weight"], r.path)):
        load, i = heapq.heappop(loads)
        chosen.append((r.path, i))
        heapq.heappush(loads, (load + r["_weight"], i))
    # the level up to which the partitions, the emptiest first, take the small files
    loads.sort()
    left, n = total - sum(load for load, _ in loads), parts
    while n > 1 and loads[n - 1][0] * n - sum(load for load, _ in loads[:n]) > left:
        n -= 1
    level = (left + sum(load for load, _ in loads[:n])) / n
    ends = list(itertools.accumulate(level - load for load, _ in loads[:n]))[:-1]
    placed = with_running(weighed.where(~large), "_weight", [], ["path"], "_at")
    spot = F.size(F.filter(F.lit(ends).cast("array<double>"), lambda x: x <= F.col("_at") + F.col("_weight") / 2))
    small = placed.select("path", F.get(F.lit([i for _, i in loads]), spot).alias("_part"))
    dealt = files.sparkSession.createDataFrame(chosen, "path string, _part int").union(small)
    return files.join(dealt, "path").repartitionById(parts, "_part").drop("_part")


def scan_history(spark: SparkSession, root: str) -> DataFrame:
    """History rows of the tree user/date/area/file, with sidecars' text; contents of other files are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    parts = F.split("path", "/")
    rows = found.select(F.element_at(parts, -4).alias("username"), F.element_at(parts, -3).alias("ymd"), F.element_at(parts, -2).alias("area"), F.element_at(parts, -1).alias("filename"), "path")
    rows = rows.where(is_day(F.col("ymd"))).withColumn("is_meta", F.col("filename").endswith(".meta"))
    texts = spark.read.option("pathGlobFilter", "*.meta").option("recursiveFileLookup", "true").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("meta_content"))
    return rows.join(texts, "path", "left").drop("path")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The history dataset, partitioned by username and ymd; dates stay text."""
    schema = "filename string, area string, is_meta boolean, meta_content string, username string, ymd string"
    return spark.read.schema(schema).parquet(path)


def uploaded_files(spark: SparkSession, folder: str, sent: DataFrame | None = None) -> DataFrame:
    """Upload rows of the files in a folder (name, size, status, path, message); an unreadable file would stop the read, so only names and sizes are taken.

    With ``sent`` (name, size) there is a row for each file sent: one that did not arrive whole is an upload error.
    """
    found = spark.read.format("binaryFile").load(folder).select("path", "length")
    found = found.select(basename(F.col("path")).alias("name"), F.col("length").alias("size"), "path")
    if sent is None:
        return found.select("name", "size", F.lit("uploaded").alias("status"), "path", F.lit(None).cast("string").alias("message"))
    both = sent.select("name", F.col("size").alias("_sent")).join(found, "name", "left")
    whole = F.coalesce(F.col("size") == F.col("_sent"), F.lit(False))
    why = F.when(F.col("size").isNull(), "the file did not arrive").when(~whole, "the file is not whole")
    return both.select("name", "size", F.when(whole, "uploaded").otherwise("upload_error").alias("status"), F.when(whole, F.col("path")).alias("path"), why.alias("message"))
