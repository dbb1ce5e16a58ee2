"""HTML tables to cells on a grid.

Rules of the reader: the first table counts; rows and cells of tables nested in
it count too; a new cell or row closes an open one of the same table; the text of
script and style is left out; text nodes are stripped and joined by line feeds.
A span that is no number counts as 1, one above a 32-bit number as the largest of
these, one below 0 as 0; each of them sets attr_error.

Every cell has two columns: ``col``, where the occupancy of earlier row spans puts
it, and ``write_col``, the sum of the column spans before it in its row. A cell
that starts beyond the width has neither. The placeholders of a span come as runs of
columns, ``col`` to ``last_col``, one for each row and gap, however wide; ``slots`` gives each column a row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL_SCHEMA = "table_row int, ord int, col int, write_col int, text string, flat_text string, colspan int, rowspan int, is_placeholder boolean, merge_in_bounds boolean, attr_error boolean, n_rows int, max_cols int, last_col int"

NO_TABLE = "[Warning: Could not find table structure in provided HTML]"
EMPTY_TABLE = "[Empty Table]"
LARGEST = (1 << 31) - 1


class _Cell:
    def __init__(self, attrs: dict[str, str | None]):
        self.texts, self.error = [], False
        self.colspan, self.rowspan = (self._span(attrs.get(k)) for k in ("colspan", "rowspan"))

    def _span(self, value: str | None) -> int:
        if value is None:
            return 1
        try:
            self.error |= not 0 <= int(value) <= LARGEST
            return max(0, min(int(value), LARGEST))
        except ValueError:
            self.error = True
            return 1


class _Reader(HTMLParser):
    """Collects rows, each a list of cells, in the order of their start tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[_Cell]] = []
        self.open: list[tuple[str, object]] = []  # of the kinds table, row, cell
        self.seen = self.done = False
        self.mute = 0

    def _close(self, kinds: tuple[str, ...]) -> None:
        """Close what is open above the innermost table, if it is of these kinds."""
        while self.open and self.open[-1][0] in kinds:
            self.open.pop()

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag in ("script", "style"):
            self.mute += 1
        elif tag == "table":
            self.seen = True
            self.open.append(("table", None))
        elif self.open and tag == "tr":
            self._close(("cell", "row"))
            row: list[_Cell] = []
            self.rows.append(row)
            self.open.append(("row", row))
        elif self.open and tag in ("td", "th"):
            self._close(("cell",))
            if any(kind == "row" for kind, _ in self.open):
                cell = _Cell(dict(attrs))
                for kind, row in self.open:
                    if kind == "row":
                        row.append(cell)
                self.open.append(("cell", cell))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
        elif self.open and tag in ("td", "th"):
            self._close(("cell",))
        elif self.open and tag == "tr":
            self._close(("cell", "row"))
        elif self.open and tag == "table":
            self._close(("cell", "row"))
            self.open.pop()
            self.done = not self.open

    def handle_data(self, data):
        if not self.mute and not self.done and (text := data.strip()):
            for kind, cell in self.open:
                if kind == "cell":
                    cell.texts.append(text)


def read_table(html: str | None) -> list[list[_Cell]] | None:
    """Rows of the first table, or None without one."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.rows if reader.seen else None


class _Block(NamedTuple):
    """The columns first to stop (not included) of a cell, from its row to the row ``end`` (not included); later cells cover earlier ones."""

    first: int
    stop: int
    number: int
    row: int
    end: int
    slot: tuple


def _runs(blocks: list[_Block]) -> Iterator[tuple[int, int, _Block]]:
    """Disjoint runs (first, stop, block) of what is seen of blocks in the order of their first column; of several, the latest is."""
    heap, i, x = [], 0, 0
    while i < len(blocks) or heap:
        if not heap:
            x = max(x, blocks[i].first)
        while i < len(blocks) and blocks[i].first <= x:
            heapq.heappush(heap, (-blocks[i].number, blocks[i]))
            i += 1
        while heap and heap[0][1].stop <= x:
            heapq.heappop(heap)
        if heap:
            top = heap[0][1]
            begin, x = x, top.stop
            while i < len(blocks) and blocks[i].first < top.stop:  # one that is covered waits, one that covers ends the run
                if blocks[i].number > top.number:
                    x = blocks[i].first
                    break
                heapq.heappush(heap, (-blocks[i].number, blocks[i]))
                i += 1
            yield begin, x, top


def _taken(blocks: list[_Block]) -> list[tuple[int, int]]:
    """What blocks in the order of their first column take together, as intervals with columns between them."""
    out: list[tuple[int, int]] = []
    for b in blocks:
        if out and b.first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b.stop))
        else:
            out.append((b.first, b.stop))
    return out


def place(rows: list[list[_Cell]]) -> Iterator[tuple]:
    """Rows of CELL_SCHEMA: cells, runs of placeholders, and a marker (ord null) for each row without cells.

    A span's block ends at the table's edge. Row by row, the blocks that come from above are merged with the row's own cells, which
    go from left to right: the work follows the cells and the runs that are given out, not the columns.
    """
    height, width = len(rows), min(LARGEST, max((sum(c.colspan for c in r) for r in rows), default=0))
    if not rows:
        yield (None, None, None, None, None, None, None, None, False, None, False, 0, 0, None)
    above, number = [], 0
    for r, cells in enumerate(rows):
        if not cells:
            yield (r, None, None, None, None, None, None, None, False, None, False, height, width, None)
        taken, t = _taken(above), 0
        own, at, written = [], 0, 0
        for i, cell in enumerate(cells):
            if own:
                at = max(at, own[-1].stop)
            while t < len(taken) and taken[t][1] <= at:
                t += 1
            if t < len(taken) and taken[t][0] <= at:
                at = taken[t][1]
            text, flat = "\n".join(cell.texts), " ".join(cell.texts)
            fits = r + cell.rowspan <= height and written + cell.colspan <= width
            tail = (text, flat, cell.colspan, cell.rowspan, False, fits, cell.error, height, width)
            if at >= width:
                yield (r, i, None, None, *tail, None)
                continue
            yield (r, i, at, written if written < width else None, *tail, at)
            hidden = (i, None, None, None, cell.colspan, cell.rowspan, True, fits, cell.error, height, width)
            number += 1
            own.append(_Block(at, min(at + max(cell.colspan, 1), width), number, r, min(r + max(cell.rowspan, 1), height), hidden))
            at += cell.colspan
            written += cell.colspan
        alive = list(heapq.merge(above, own))
        for first, stop, block in _runs(alive):
            first += block.row == r and first == block.first  # the cell itself
            if first < stop:
                i, *slot = block.slot
                yield (r, i, first, *slot, stop - 1)
        above = [b for b in alive if b.end > r + 1]


@F.udtf(returnType=CELL_SCHEMA)
class HtmlCells:
    """Table function: the slots of the first table of an HTML text; one row of nulls without a table."""

    def eval(self, html):
        rows = read_table(html)
        yield from [(None,) * 14] if rows is None else place(rows)


def html_cells(df: DataFrame, html: str = "html") -> DataFrame:
    """Each row of df with each slot of its first table; rows without a table have nulls."""
    return df.lateralJoin(HtmlCells(F.col(html).outer()))


def slots(cells: DataFrame) -> DataFrame:
    """The cells with a row for each column of a run of placeholders."""
    columns = F.explode_outer(F.when(F.col("col").isNotNull(), F.sequence("col", "last_col"))).alias("col")
    return cells.select(*[columns if c == "col" else F.col(c) for c in cells.columns]).withColumn("last_col", F.col("col"))


def table_dims(cells: DataFrame, *keys: str) -> DataFrame:
    """n_rows and max_cols of each table, by sums over its cells."""
    kept = cells.where(~F.coalesce(F.col("is_placeholder"), F.lit(False)))
    by_row = kept.groupBy(*keys, "table_row").agg(F.coalesce(F.sum("colspan"), F.lit(0)).alias("width"))
    return by_row.groupBy(*keys).agg(F.count("table_row").alias("n_rows"), F.max("width").alias("max_cols"))


def write_cursor(cells: DataFrame, *keys: str) -> DataFrame:
    """The running sum of column spans before each kept cell of a row, as window expression."""
    before = Window.partitionBy(*keys, "table_row").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    kept = cells.where("not is_placeholder and col is not null")
    cursor = F.coalesce(F.sum("colspan").over(before), F.lit(0))
    return kept.withColumn("cursor", F.when(cursor < F.col("max_cols"), cursor).cast("int"))


def fallback_paragraphs(cells: DataFrame, *keys: str) -> DataFrame:
    """Paragraphs for tables that have no grid: none found, no rows, or rows without width; a table is read once."""
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("ord").isNotNull(), F.struct("ord", F.col("flat_text").alias("t"))))), lambda x: x["t"]), ", ")
    rows = cells.groupBy(*keys, "table_row").agg(F.max("n_rows").alias("n_rows"), F.max("max_cols").alias("max_cols"), items.alias("_t"))
    number = F.col("table_row") + 1
    line = F.when(F.col("n_rows").isNull(), NO_TABLE).when(F.col("n_rows") == 0, EMPTY_TABLE).otherwise(F.concat(F.lit("Row "), number.cast("string"), F.lit(": "), F.col("_t")))
    return rows.where("n_rows is null or max_cols = 0").select(*keys, F.coalesce(number, F.lit(0)).alias("n"), line.alias("text"))


#: What one HTML text becomes in a document: a table with its cells, or lines where it has no grid.
GRID = T.StructType(
    [
        T.StructField("cells", T.ArrayType(T.StructType([T.StructField(c, T.StringType() if c == "text" else T.IntegerType()) for c in ("row", "col", "text", "colspan", "rowspan")]))),
        T.StructField("n_rows", T.IntegerType()),
        T.StructField("n_cols", T.IntegerType()),
        T.StructField("lines", T.ArrayType(T.StringType())),
    ]
)


def _grid(html: str) -> dict:
    rows = read_table(html)
    if rows is None:
        return {"lines": [NO_TABLE]}
    if not rows:
        return {"lines": [EMPTY_TABLE]}
    found = [c for c in place(rows) if c[1] is not None]
    width = max((c[12] for c in found), default=0)
    if not width:
        return {"lines": [f"Row {i + 1}: " + ", ".join(" ".join(c.texts) for c in r) for i, r in enumerate(rows)]}
    span = lambda c, n: max(n, 1) if c[9] else 1
    cells = [(c[0], c[2], c[4], span(c, c[6]), span(c, c[7])) for c in found if not c[8] and c[2] is not None]
    return {"cells": [dict(zip(("row", "col", "text", "colspan", "rowspan"), c, strict=True)) for c in sorted(cells)], "n_rows": len(rows), "n_cols": width}


@F.pandas_udf(GRID)
def grid(html: pd.Series) -> pd.DataFrame:
    """The first table of each HTML text, parsed once; null for null. A cell that would reach beyond its table is not merged."""
    empty = {"cells": None, "n_rows": None, "n_cols": None, "lines": None}
    out = pd.DataFrame([empty if x is None else empty | _grid(x) for x in html], columns=list(empty), dtype=object)
    return out.astype({"n_rows": "Int32", "n_cols": "Int32"})

