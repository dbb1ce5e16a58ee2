"""Pages with their elements to the blocks of whole documents, tables included.

A block has doc_id, block_seq, kind, text and, for a table, its cells (row, col, text,
colspan, rowspan; one that would reach beyond the table is not merged) and its numbers of rows and columns. Tables without a grid become
paragraphs. Pages that have a handler get an anchored table in place of the general rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators import elements, html_tables
from folioforge.operators.anchored import Anchored
from folioforge.operators.handlers import Handler, handled_blocks


def with_tables(blocks: DataFrame, *keys: str) -> DataFrame:
    """The keys, kind, text, cells, n_rows, n_cols and sub of blocks (keys, kind, text); ``sub`` orders what one block became.

    Each table is read once, in its row: it becomes a table, or a paragraph for each line of one without a grid.
    """
    made = blocks.withColumn("_grid", html_tables.grid(F.when(F.col("kind") == "table", F.coalesce("text", F.lit("")))))
    line = F.transform("_grid.lines", lambda x: F.struct(F.lit("paragraph").alias("kind"), x.alias("text")))
    own = F.array(F.struct("kind", F.when(F.col("kind") == "table", "").otherwise(F.col("text")).alias("text")))
    parts = F.posexplode(F.coalesce(line, own)).alias("sub", "_part")
    return made.select(*keys, "_grid", parts).select(*keys, "_part.kind", "_part.text", F.col("_grid.cells").alias("cells"), F.col("_grid.n_rows").alias("n_rows"), F.col("_grid.n_cols").alias("n_cols"), "sub")


def document_blocks(pages: DataFrame, found: DataFrame, single: bool = False, keep_text: bool = False, handlers: dict[str, Handler | Anchored] | None = None) -> DataFrame:
    """doc_id, block_seq, kind, text, cells, n_rows and n_cols of the documents.

    ``pages`` has doc_id, page_id, page_seq and filename; ``found`` the elements of the pages. ``handlers``
    are functions (operators.handlers), or specifications of anchored tables, by file name.
    """
    special = handlers or {}
    named = pages.select("page_id", "filename").where(F.col("filename").isin(list(special))) if special else None
    general = found
    if named is not None:
        # a handled page keeps an element, so that it is not taken for an empty one, but none that the general rules write
        mark = named.select("page_id", F.lit(True).alias("_handled"))
        general = found.join(mark, "page_id", "left").withColumn("kind", F.when(F.col("_handled"), F.lit("handled")).otherwise(F.col("kind"))).drop("_handled")
    order = ["page_id", "block_seq"]
    out = with_tables(elements.blocks(pages, general, single, keep_text, doc="doc_id"), *order)
    out = out.withColumn("part", F.when(F.col("kind") == "heading", -1).when(F.col("kind") == "page_break", 9).otherwise(5))
    if special:
        own = handled_blocks(found, pages, special)
        out = out.unionByName(own.withColumns({"part": F.lit(5), "block_seq": F.lit(0)}))
    full = out.join(pages.select("doc_id", "page_id", "page_seq"), "page_id")
    place = Window.partitionBy("doc_id").orderBy("page_seq", "part", "block_seq", "sub")
    return full.select("doc_id", (F.row_number().over(place) - 1).alias("block_seq"), "kind", "text", "cells", "n_rows", "n_cols")
