"""Pages with a handler of their own, as a table function over a page's elements.

A handler is a function from the elements of one page, in order, to its blocks (kind, text, cells,
n_rows, n_cols; the last three may be left out). Handlers are registered by file name. The table function is called
once for each page that has one; its result carries page_id in whatever type the pages have it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from folioforge.operators.anchored import Anchored
from folioforge.operators.html_tables import GRID

Handler = Callable[[list[dict]], Iterable[tuple]]


def _table(handlers: dict[str, Handler]):
    """The table function over (page_id, filename, elements...) that is partitioned by page_id and ordered by elem_idx."""

    @F.udtf
    class HandledPage:
        @staticmethod
        def analyze(page: AnalyzeArgument) -> AnalyzeResult:
            if not page.isTable or "filename" not in page.dataType.names:
                raise ValueError("a table of elements with page_id and filename is asked for")
            rest = [T.StructField("sub", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), *GRID.fields[:3]]
            return AnalyzeResult(T.StructType([page.dataType["page_id"], *rest]))

        def __init__(self):
            self.elements = []

        def eval(self, page):
            self.elements.append(page.asDict(recursive=True))

        def terminate(self):
            if self.elements:
                first = self.elements[0]
                for i, (kind, text, *table) in enumerate(handlers[first["filename"]](self.elements)):
                    cells, n_rows, n_cols = table or (None, None, None)
                    yield first["page_id"], i, kind, text, cells, n_rows, n_cols

    return HandledPage


def handled_blocks(found: DataFrame, pages: DataFrame, handlers: dict[str, Handler | Anchored]) -> DataFrame:
    """page_id, sub, kind, text, cells, n_rows and n_cols of the pages (page_id, filename) whose file name has a handler; ``found`` are the elements."""
    functions = {name: anchored_page(h) if isinstance(h, Anchored) else h for name, h in handlers.items()}
    named = pages.select("page_id", "filename").where(F.col("filename").isin(list(functions)))
    own = found.drop("filename").join(named, "page_id")
    return _table(functions)(own.asTable().partitionBy("page_id").orderBy("elem_idx"))


def anchored_page(spec: Anchored) -> Handler:
    """The handler of an anchored table: the two highest texts, the table, a blank and what follows it; equal neighbours in a header row are one cell."""

    def mean_y(element: dict) -> float:
        box = element.get("box")
        return sum(p["y"] for p in box) / len(box) if box else float("-inf")

    def header_cells(y: int, row: tuple[str, ...]) -> list[tuple]:
        out = []
        for x, c in enumerate(row):
            if c and x and row[x - 1] == c:
                out[-1][3] += 1
            else:
                out.append([y, x, c, 1, 1])
        return [tuple(c) for c in out]

    def handle(elements: list[dict]) -> Iterable[tuple]:
        texts = [e["text"] for e in elements]
        tops = sorted(range(len(texts)), key=lambda i: (mean_y(elements[i]), i))[:2]
        yield from (("paragraph", texts[i]) for i in tops)
        places = [texts.index(label) for label in spec.labels if label in texts]
        cells = [c for y, row in enumerate(spec.headers) for c in header_cells(y, row)]
        for y, at in enumerate(places, len(spec.headers)):
            row = texts[at : at + spec.width]
            cells += [(y, x, t, 1, 1) for x, t in enumerate(row + [""] * (spec.width - len(row)))]
        yield "table", "", cells, len(spec.headers) + len(places), spec.width
        yield "blank", ""
        last = texts.index(spec.end_marker) if spec.end_marker in texts else max((at + spec.width for at in places), default=-1)
        yield from (("paragraph", t) for t in texts[last + 1 :])

    return handle
