import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.functions import rules, text


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_strip(spark):
    values = ["  a ", "　b ", "\tc\r", "\x1cd\x1f", "", None, "e f"]
    assert column(spark, values, text.strip_u) == [v.strip() if v is not None else None for v in values]


def segments(t):
    return [x.strip() for x in t.split("\n") if x.strip()] or [t]


def test_segments(spark):
    values = ["a\n\n b ", "  ", "", "　x　\ny", "a\r\nb\r\n", "\n\n"]
    assert column(spark, values, text.segment_text) == [segments(v) for v in values]
    assert column(spark, [None], text.segment_text) == [None]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text("aB./10 2_", min_size=1, max_size=9), min_size=30, max_size=60, unique=True))
def test_stem(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.s for r in df.select("n", text.stem(F.col("n")).alias("s")).collect()} == {n: os.path.splitext(n)[0] for n in names}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "Page ", "x_"]), st.integers(0, 10**30), st.sampled_from(["", ".jpg", "b"])), min_size=20, max_size=40, unique=True))
def test_natural_order_by_number(spark, parts):
    """Among names of the same words, numbers go by value, however many digits they have."""
    df = spark.createDataFrame([(f"{w}{n}{e}", w, str(n), e) for w, n, e in parts], "n string, w string, v string, e string")
    got = [(r.w, int(r.v), r.e) for r in df.orderBy(text.natural_key(F.col("n")), "n").collect()]
    for w in ("a", "Page ", "x_"):
        numbers = [n for x, n, _ in got if x == w]
        assert numbers == sorted(numbers)
    assert [w for w, _, _ in got] == sorted((w for w, _, _ in got), key=str.lower)


@pytest.mark.parametrize(
    "names",
    [
        ["1.jpg", "2.jpg", "10.jpg"],
        ["01.jpg", "1.jpg", "2.jpg"],  # equal numbers: by the name itself
        ["9a", "10a", "10B", "10c"],  # letters whatever their case
        ["a2", "A10", "b1"],
        ["IMG_2_3", "IMG_2_12", "IMG_10_1"],
        ["x" + "9" * 22, "x1" + "0" * 22],
        ["", "0", "a", "a0"],
        ["x" + "9" * 500, "x1" + "0" * 500, "x1" + "0" * 499 + "1"],
        ["p٢", "p3", "p١٠", "p0011", "p１２"],  # digits of other scripts have their values
        ["a\x00z", "a\x01a", "a\x02", "ab"],
    ],
)
def test_natural_order_cases(spark, names):
    df = spark.createDataFrame([(n,) for n in reversed(names)], "n string")
    assert [r.n for r in df.orderBy(text.natural_key(F.col("n")), "n").collect()] == names


def test_paths(spark):
    assert column(spark, ["a/b.c.jpg", ".jpg", "a.b/c", "x"], text.stem) == ["a/b.c", ".jpg", "a.b/c", "x"]
    assert column(spark, ["a/b.c.jpg", ".jpg"], text.extension) == [".jpg", ""]
    assert column(spark, ["a/b", "c"], text.basename) == ["b", "c"]
    assert column(spark, ["a\\b"], lambda c: text.media_url(c)) == ["/media/a/b"]
    assert column(spark, ["A.DOCX", "a.doc", "docx"], lambda c: text.has_extension(c, ".doc", ".docx")) == [True, True, False]
    assert column(spark, ["20240101", "2024010", "abcdefgh"], text.is_day) == [True, False, False]


def test_rules(spark):
    assert column(spark, ["ab1", "a b", "abcdefghijk", "", None, "ab\n"], rules.valid_username) == [True, False, False, False, False, False]
    assert column(spark, ["abcdefgh", "short", "abcdefghijk"], rules.valid_password) == [True, False, False]
    assert column(spark, ["x", "", None, "y"], lambda c: rules.passwords_agree(c, F.lit("x"))) == [True, True, True, False]
