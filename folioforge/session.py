"""Session helpers: a local session for tests and benchmarks, shipping this package to executors, and tables in the shared folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("folioforge")
    conf = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors of the session, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    path = os.path.join(tempfile.mkdtemp(prefix="folioforge-"), "folioforge.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


#: Folders written by each application, for release.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir.

    Where that is unset, a local session, whose executors are on this machine,
    gets a temporary one; any other session is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="folioforge-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/folioforge-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Cut the lineage of df: write it to the shared folder and read it again."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """What is run inside sends Python this many rows at a time: for rows that hold large values."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_tables(spark: SparkSession) -> set[str]:
    """The folders that this application has written so far, to be given to ``release``."""
    return set(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, but: set[str], keep: list[DataFrame] | None = None) -> None:
    """Delete the shared folders of this application other than ``but`` and those that the frames to keep read."""
    kept = [f for df in keep or [] for f in df.inputFiles()]
    app = spark.sparkContext.applicationId
    gone = [p for p in _written.get(app, []) if p not in but and not any(p.rpartition("/")[2] in f for f in kept)]
    _written[app] = [p for p in _written.get(app, []) if p not in gone]
    for p in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
