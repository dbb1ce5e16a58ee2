"""Anchored tables: labels found among a page's texts start the rows of a table.

``anchored_table`` is the general handler; SIX_JPG is the one configuration that
is shipped. Handlers are chosen by file name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Anchored:
    labels: tuple[str, ...]
    width: int
    end_marker: str
    headers: tuple[tuple[str, ...], ...]


# The labels, headers and end marker of the one page that has a handler.
SIX_JPG = Anchored(
    labels=("西汉", "唐代", "北宋"),
    width=5,
    end_marker="37.1%",
    headers=(("", "南方", "南方", "北方", "北方"), ("朝代", "人口（户）", "占全国户口数比例", "人口（户）", "占全国户口数比例")),
)
HANDLERS = {"6.jpg": SIX_JPG}


def handler_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, "anchored") for name in HANDLERS], "filename string, handler string")


def dispatch(pages: DataFrame, handlers: DataFrame) -> DataFrame:
    """Add the handler of each page's file name; generic where none is registered."""
    return pages.join(F.broadcast(handlers), "filename", "left").withColumn("handler", F.coalesce("handler", F.lit("generic")))  # one row for each registered file


def anchors(texts: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """page_id, label_idx, label and idx (0-based, first exact match) of the labels found; ``texts`` has page_id and texts."""
    found = F.array(*[F.struct(F.lit(i).alias("label_idx"), F.lit(label).alias("label"), (F.array_position("texts", label) - 1).alias("idx")) for i, label in enumerate(labels)])
    return texts.select("page_id", "texts", F.explode(found).alias("a")).select("page_id", "texts", "a.*").where("idx >= 0")


def anchored_rows(texts: DataFrame, spec: Anchored) -> DataFrame:
    """page_id, table_row (after the headers), idx and cells of each anchor's row; short rows end in blanks."""
    row = F.row_number().over(Window.partitionBy("page_id").orderBy("label_idx")) + F.lit(len(spec.headers) - 1)
    cells = F.slice("texts", F.col("idx").cast("int") + 1, spec.width)
    padded = F.slice(F.concat(cells, F.array_repeat(F.lit(""), spec.width)), 1, spec.width)
    return anchors(texts, spec.labels).select("page_id", row.alias("table_row"), "label", "idx", padded.alias("cells"))


def anchored_tail(texts: DataFrame, spec: Anchored) -> DataFrame:
    """page_id, elem_idx and text of what follows the table: after the end marker, else after the last anchor's row, else all."""
    last = F.greatest(*[F.when(F.array_position("texts", label) > 0, F.array_position("texts", label) - 1 + spec.width).otherwise(-1) for label in spec.labels], F.lit(-1))
    marker = F.array_position("texts", spec.end_marker) - 1
    ends = texts.withColumn("last", F.when(marker >= 0, marker).otherwise(last))
    return ends.select("page_id", "last", F.posexplode("texts").alias("elem_idx", "text")).where("elem_idx > last").drop("last")


def anchored_table(texts: DataFrame, spec: Anchored) -> DataFrame:
    """All rows of the table, headers first."""
    headers = texts.select("page_id", F.posexplode(F.lit([list(h) for h in spec.headers])).alias("table_row", "cells"))
    return headers.unionByName(anchored_rows(texts, spec).select("page_id", "table_row", "cells"))
