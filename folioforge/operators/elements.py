"""Page elements to ordered document blocks.

``elements`` has page_id, elem_idx, kind, text, html and lines (FIXTURES R2).
A page on which a table is written drops all its text (``keep_text`` keeps it);
of typed elements only tables and texts count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import is_blank, segment_text

HEADING = "Content from {}"
EMPTY_PAGE = "[No content could be extracted from {}]\n"


def is_table() -> Column:
    return F.coalesce((F.lower("kind") == "table") & F.nullif(F.col("html"), F.lit("")).isNotNull(), F.lit(False))


def element_text() -> Column:
    """The text of a typed text element (its lines joined) or of a plain line that is not blank; else null."""
    typed = F.when(F.lower("kind") == "text", F.array_join("lines", "\n"))
    plain = F.when(F.col("kind").isNull() & ~is_blank(F.col("text")), F.col("text"))
    return F.coalesce(typed, plain)


def gate(elements: DataFrame, keep_text: bool = False) -> DataFrame:
    """Add page_has_table, is_table and body (the text to write, null if none)."""
    page = Window.partitionBy("page_id")
    marked = elements.withColumn("is_table", is_table()).withColumn("page_has_table", F.max("is_table").over(page))
    blocked = F.lit(False) if keep_text else F.col("page_has_table")
    return marked.withColumn("body", F.when(~blocked, element_text()))


def _with_name(template: str) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), F.col("filename"), F.lit(after))


def blocks(pages: DataFrame, elements: DataFrame, single: bool = False, keep_text: bool = False, doc: str | None = None) -> DataFrame:
    """page_id, block_seq, kind, text and elem_idx: heading, tables or paragraphs, placeholder, page break.

    ``pages`` has page_id, page_seq and filename, and with ``doc`` the column of its document; all pages are
    one document without. A single file has neither heading nor page break, the last page of a document no break.
    """
    gated = gate(elements.select("page_id", "elem_idx", "kind", "text", "html", "lines"), keep_text)
    item = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text"))
    table = F.when(F.col("is_table"), F.array(item("table", F.col("html")), item("blank", F.lit(""))))
    texts = F.transform(segment_text(F.col("body")), lambda x: item("paragraph", x))
    # an element is a table, or a text, or nothing
    own = gated.select("page_id", F.lit(1).alias("part"), F.col("elem_idx").cast("int").alias("elem_idx"), F.posexplode(F.coalesce(table, texts)).alias("sub", "_item"))
    full = pages.join(elements.select("page_id").distinct().withColumn("_full", F.lit(True)), "page_id", "left")
    around = [F.struct(F.lit(1).alias("part"), F.when(F.col("_full").isNull(), item("paragraph", _with_name(EMPTY_PAGE))).alias("_item"))]
    if not single:
        last = pages.groupBy(*([doc] if doc else [])).agg(F.max("page_seq").alias("_last"))
        full = full.join(last, doc) if doc else full.crossJoin(F.broadcast(last))  # one row
        around.append(F.struct(F.lit(0).alias("part"), item("heading", _with_name(HEADING)).alias("_item")))
        around.append(F.struct(F.lit(2).alias("part"), F.when(F.col("page_seq") < F.col("_last"), item("page_break", F.lit(None))).alias("_item")))
    rest = full.select("page_id", F.explode(F.array(*around)).alias("_a")).select("page_id", "_a.part", F.lit(None).cast("int").alias("elem_idx"), F.lit(0).alias("sub"), "_a._item").where("_item is not null")
    order = Window.partitionBy("page_id").orderBy("part", "elem_idx", "sub")
    return own.unionByName(rest).withColumn("block_seq", F.row_number().over(order) - 1).select("page_id", "block_seq", "_item.kind", "_item.text", "elem_idx")


def legacy_text(lines: Column) -> Column:
    """The lines of a page as one text, or the sentence for a page without text."""
    return F.coalesce(F.nullif(F.array_join(lines, "\n"), F.lit("")), F.lit("No text detected in this image."))


def mean_y(box: Column) -> Column:
    """The mean y of a box of points."""
    return F.aggregate(box, F.lit(0.0), lambda a, p: a + p["y"]) / F.size(box)


def top_by_y(elements: DataFrame, n: int = 2) -> DataFrame:
    """The n elements of each page that lie highest; ties by elem_idx."""
    order = Window.partitionBy("page_id").orderBy("mean_y", "elem_idx")
    return elements.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _greedy(label: np.ndarray, box: np.ndarray, overlap: float, most: int) -> list[int]:
    """The boxes (x1, y1, x2, y2), in their order, that no kept one of their label covers by more than ``overlap`` of the union."""
    area = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
    open_, kept = np.ones(len(box), bool), []
    while len(kept) < most and open_.any():
        i = int(np.argmax(open_))
        kept.append(i)
        both = np.prod(np.maximum(np.minimum(box[i, 2:], box[:, 2:]) - np.maximum(box[i, :2], box[:, :2]), 0), axis=1)
        open_ &= (label != label[i]) | (both <= overlap * (area[i] + area - both))
        open_[i] = False
    return kept


def suppressed(boxes: DataFrame, score: float = 0.3, overlap: float = 0.5, most: int = 100, before: int = 1000) -> DataFrame:
    """Greedy non-maximum suppression of each page's boxes (page_id, label, score, x1, y1, x2, y2), highest scores first.

    Of each label of a page the ``before`` highest scores above ``score`` take part; a page keeps ``most`` boxes.
    """
    order = [F.desc("score"), "x1", "y1", "x2", "y2"]
    first = boxes.where(F.col("score") > score).withColumn("_n", F.row_number().over(Window.partitionBy("page_id", "label").orderBy(*order)))
    ordered = first.where(F.col("_n") <= before).drop("_n").repartition("page_id").sortWithinPartitions("page_id", *order, "label")

    def keep(table: pa.Table) -> pa.RecordBatch:
        page = table.column("page_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        label = table.column("label").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        box = np.stack([table.column(c).cast(pa.float64()).to_numpy() for c in ("x1", "y1", "x2", "y2")], axis=1)
        ends = np.append(np.flatnonzero(page[1:] != page[:-1]) + 1, len(page))
        starts = np.concatenate(([0], ends[:-1]))
        kept = [s + i for s, e in zip(starts.tolist(), ends.tolist(), strict=True) for i in _greedy(label[s:e], box[s:e], overlap, most)]
        return table.take(pa.array(kept, pa.int64())).combine_chunks().to_batches()[0]

    def run(batches):
        held = None  # rows of the page that the next batch may go on with
        for b in batches:
            table = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            page = table.column("page_id").to_pylist()
            n = next((i + 1 for i in range(len(page) - 2, -1, -1) if page[i] != page[-1]), 0)
            held = table.slice(n)
            if n:
                yield keep(table.slice(0, n))
        if held is not None and held.num_rows:
            yield keep(held)

    return ordered.mapInArrow(run, boxes.schema)
