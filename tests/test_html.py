import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.operators import html_tables as h


def cells(html):
    return h.place(h.read_table(html))


def by_text(html):
    return {r[4]: r for r in cells(html) if r[4] is not None}


def test_no_table():
    assert h.read_table("<p>x</p>") is None and h.read_table(None) is None and h.read_table("") is None


def test_rowspan_disagreement():
    got = by_text('<table><tr><td rowspan="2">A</td><td>B</td></tr><tr><td>C</td></tr></table>')
    assert got["C"][2:4] == (1, 0) and got["B"][2:4] == (1, 1) and got["A"][2:4] == (0, 0)


def test_colspan_width():
    got = by_text('<table><tr><td colspan="2">A</td></tr><tr><td>B</td><td>C</td></tr></table>')
    assert got["A"][12] == 2 and got["C"][2] == 1


def test_overflow_is_dropped():
    got = by_text('<table><tr><td rowspan="2">A</td></tr><tr><td>B</td></tr></table>')
    assert got["B"][2] is None and got["B"][3] is None


def test_first_table_only_and_nested():
    assert set(by_text("<table><tr><td>1</td></tr></table><table><tr><td>2</td></tr></table>")) == {"1"}
    rows = h.read_table("<table><tr><td>a<table><tr><td>b</td></tr></table></td></tr></table>")
    assert [len(r) for r in rows] == [2, 1] and rows[0][0].texts == ["a", "b"]


@pytest.mark.parametrize(("span", "value", "error"), [("x", 1, True), ("", 1, True), ("3", 3, False), ("-2", 0, True), ("0", 0, False)])
def test_spans(span, value, error):
    (cell,) = h.read_table(f'<table><tr><td colspan="{span}">A</td></tr></table>')[0]
    assert (cell.colspan, cell.error) == (value, error)


def test_bounds_and_unclosed():
    got = by_text('<table><tr><td rowspan="3">A<td>B<tr><td>C')
    assert got["A"][9] is False and got["C"][2] == 1
    assert by_text("<table><tr><td> x <b>y</b><script>z</script></td></tr></table>")["x\ny"][5] == "x y"


def each_slot(rows):
    """(row, column) to (ord, text, placeholder) of the runs."""
    out = {}
    for r in rows:
        if r[2] is not None:
            for x in range(r[2], r[13] + 1):
                assert (r[0], x) not in out
                out[r[0], x] = (r[1], r[4], r[8])
    return out


def test_slots_of_apart_spans_are_unique():
    assert len(each_slot(cells('<table><tr><td colspan="2" rowspan="2">A</td><td>B</td></tr><tr><td>C</td></tr></table>'))) == 6


def painted(rows):
    """The grid by painting slot after slot."""
    width = max((sum(c.colspan for c in r) for r in rows), default=0)
    grid, lost = {}, []
    for y, cells_ in enumerate(rows):
        at = 0
        for i, c in enumerate(cells_):
            while (y, at) in grid:
                at += 1
            if at >= width:
                lost.append((y, i))
                continue
            for r in range(y, min(y + max(c.rowspan, 1), len(rows))):
                for x in range(at, min(at + max(c.colspan, 1), width)):
                    grid[r, x] = (i, None, True)
            grid[y, at] = (i, "\n".join(c.texts), False)
            at += c.colspan
    return grid, lost


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), max_size=6), max_size=7))
def test_grid_is_what_painting_gives(spans):
    html = "<table>" + "".join("<tr>" + "".join(f'<td colspan="{c}" rowspan="{r}">{y}.{i}</td>' for i, (c, r) in enumerate(row)) + "</tr>" for y, row in enumerate(spans)) + "</table>"
    rows = h.read_table(html)
    grid, lost = painted(rows)
    found = list(h.place(rows))
    assert each_slot(found) == grid
    assert [(r[0], r[1]) for r in found if r[1] is not None and r[2] is None] == lost


def test_many_cells_and_wide_spans_take_no_time():
    n = 100_000
    plain = h.read_table("<table><tr>" + "<td>x" * n + "</table>")
    # every second column comes from above
    held = h.read_table("<table><tr>" + '<td rowspan="2">x<td>y' * (n // 2) + "</tr><tr>" + "<td>z" * (n // 2) + "</table>")
    wide = h.read_table(f'<table><tr><td colspan="{1 << 31}">A<td rowspan="2">B</tr><tr><td>C</table>')
    begin = time.process_time()
    assert sum(1 for _ in h.place(plain)) == n and sum(1 for _ in h.place(held)) == 2 * n
    found = list(h.place(wide))
    assert len(found) == 4 and found[2][2] == 1 and found[2][13] == h.LARGEST - 1  # B starts beyond the width
    assert time.process_time() - begin < 4


def test_function_and_fallbacks(spark):
    html = ["<p>x</p>", "<table></table>", "<table><tr></tr></table>", "<table><tr><td>a</td></tr></table>", None]
    df = h.html_cells(spark.createDataFrame([(i, x) for i, x in enumerate(html)], "k int, html string"))
    got = sorted((r.k, r.text) for r in h.fallback_paragraphs(df, "k").collect())
    assert got == [(0, h.NO_TABLE), (1, h.EMPTY_TABLE), (2, "Row 1: "), (4, h.NO_TABLE)]
    dims = {r.k: (r.n_rows, r.max_cols) for r in h.table_dims(df, "k").collect()}
    assert dims[3] == (1, 1) and dims[2] == (1, 0)


def test_wide_spans():
    """Spans have no cap; a wide one's placeholders are one run a row, and only inside the table."""
    slots = cells('<table><tr><td colspan="2000000" rowspan="9">A</td><td>B</td></tr><tr><td>C</td></tr></table>')
    assert next(slots)[2:9] == (0, 0, "A", "A", 2_000_000, 9, False) and next(slots)[4] == "B" and (run := next(slots))[2:9] == (1, None, None, None, 2_000_000, 9, True) and run[13] == 1_999_999
    got = by_text('<table><tr><td colspan="20000">A</td><td>B</td></tr><tr><td>C</td></tr></table>')
    assert got["B"][2:4] == (20_000, 20_000) and got["A"][12] == 20_001 and got["A"][9] is True
    (cell,) = h.read_table('<table><tr><td colspan="99999999999999999999">A</td></tr></table>')[0]
    assert (cell.colspan, cell.error) == (h.LARGEST, True)


def test_covered_spans():
    """A block that runs over an earlier one takes its slots."""
    rows = {(r[0], r[2]): r for r in cells('<table><tr><td>a<td rowspan="3">b<td>c</tr><tr><td colspan="3">d</tr><tr><td>e<td>f</table>') if r[2] is not None}
    assert rows[1, 0][4] == "d" and rows[1, 1][6] == 3 and rows[1, 1][13] == 2 and rows[2, 1][7] == 3 and rows[2, 2][4] == "f"
