"""Text and file-name expressions (Column to Column)."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_u(c: Column) -> Column:
    """Strip Unicode white space and U+001C to U+001F from both ends; null stays null."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def is_blank(c: Column) -> Column:
    return strip_u(c) == ""


def segment_text(c: Column) -> Column:
    """Non-blank stripped lines; the text itself, alone, if there are none; null for null."""
    lines = F.filter(F.transform(F.split(c, "\n", -1), strip_u), lambda x: x != "")
    return F.when(F.size(lines) > 0, lines).when(c.isNotNull(), F.array(c))


def _digits() -> tuple[str, str]:
    """All decimal digits of Unicode beyond ASCII, and the ASCII digits that they stand for."""
    found = [chr(i) for i in range(128, sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Nd"]
    return "".join(found), "".join(str(unicodedata.digit(c)) for c in found)


def natural_key(c: Column) -> Column:
    """Sort key, as bytes, that compares digit runs as numbers, however long and in any script, and the rest in lower case.

    A run of text ends with a zero byte (U+0000 and U+0001 in it are two characters); a number is the length of its
    digits without leading zeros, then these digits, so a shorter one comes first.
    """
    plain = F.replace(F.replace(F.lower(F.translate(c, *_digits())), F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))
    run = lambda x: F.concat(F.regexp_extract(x, r"^(\D*)", 1), F.lit("\x00"), number(F.regexp_extract(x, r"(\d*)$", 1)))
    significant = lambda d: F.regexp_replace(d, "^0+", "")
    number = lambda d: F.when(d == "", "").otherwise(F.concat(F.lit("1"), F.lpad(F.length(significant(d)).cast("string"), 10, "0"), significant(d)))
    return F.array_join(F.transform(F.regexp_extract_all(plain, F.lit(r"(\D*)(\d*)"), F.lit(0)), run), "").cast("binary")


def stem(c: Column) -> Column:
    """The path without its last extension; a name that only has dots before it keeps it."""
    return F.regexp_replace(c, r"^(.*/)?(\.*[^/.][^/]*?)(\.[^./]*)$", r"$1$2")


def extension(c: Column) -> Column:
    """What stem takes off, with the dot; empty if nothing."""
    return F.substring(c, F.length(stem(c)) + 1, F.length(c))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/", -1), -1)


def with_suffix(c: Column, suffix: str) -> Column:
    return F.concat(stem(c), F.lit(suffix))


def join_path(*parts: Column) -> Column:
    return F.concat_ws("/", *[F.replace(p, F.lit("\\"), F.lit("/")) for p in parts])


def media_url(path: Column, root: str = "/media/") -> Column:
    return F.concat(F.lit(root), F.replace(path, F.lit("\\"), F.lit("/")))


def first_text(*alternatives: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(a, F.lit("")) for a in alternatives])


def is_true(c: Column) -> Column:
    return F.lower(c) == "true"


def has_extension(c: Column, *extensions: str) -> Column:
    """Whether the name ends in one of the extensions (with dots), in any case."""
    pattern = "|".join(e.lstrip(".") for e in extensions)
    return F.lower(c).rlike(rf"\.({pattern})$")


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def is_day(c: Column) -> Column:
    return c.rlike("^[0-9]{8}$")


def ordered_join(order: Column, value: Column, separator: str = ",") -> Column:
    """Aggregate: the values joined in the given order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), separator)


def megabytes(size: Column) -> Column:
    return F.round(size / 1048576, 2)


def output_format(sub_tab: Column, wanted: Column) -> Column:
    """pdf where the route ends in Pdf or pdf is asked for, else docx."""
    return F.when(F.lower(sub_tab).endswith("pdf") | (F.lower(wanted) == "pdf"), "pdf").otherwise("docx")
