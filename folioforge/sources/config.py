"""Settings with defaults."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    input_directory: str = "input_images"
    output_filename: str = "output.docx"
    log_file: str = "extraction.log"
    logger_name: str = "folioforge"
    font_name: str = "SimSun"
    font_size: int = 11


def from_dict(values: dict | None) -> Config:
    """Missing and null keys take their defaults; unknown ones are left out."""
    known = {f.name for f in fields(Config)}
    return Config(**{k: v for k, v in (values or {}).items() if k in known and v is not None})


class ConfigError(ValueError):
    """A settings file that can't be read, with the number of the line."""


_PLAIN = re.compile(r"(?P<key>[^\s#'\":{}\[\],&*!|>%@`-][^:#]*?)\s*:(?:\s+(?P<value>.*))?$")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


def _scalar(text: str, line: int) -> str | None:
    """A value: quoted either way or plain, with a comment after it or not; null for none."""
    text = text.strip()
    if text[:1] in ("'", '"'):
        quote = text[0]
        found = re.match(r"'((?:[^']|'')*)'\s*(?:\s#.*)?$" if quote == "'" else r'"((?:[^"\\]|\\.)*)"\s*(?:\s#.*)?$', text)
        if not found:
            raise ConfigError(f"line {line}: a quote that does not end, or something after it")
        if quote == "'":
            return found[1].replace("''", "'")
        return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), found[1])
    text = re.sub(r"(^|\s)#.*$", "", text).strip()
    return None if text in ("", "~", "null") else text


def read_settings(text: str) -> dict[str, str | None]:
    """The top level of a YAML file of keys and scalars; what is nested below a key belongs to it and is left out, the key being null."""
    out, open_, lines = {}, False, text.removeprefix("\ufeff").splitlines()
    for n, line in enumerate(lines, 1):
        if not line.strip() or line.lstrip().startswith("#") or line.rstrip() in ("---", "..."):
            continue
        if line[0] in " \t" or line.startswith("- "):
            if not open_:
                raise ConfigError(f"line {n}: something below no key")
            continue
        found = _PLAIN.match(line)
        if not found:
            raise ConfigError(f"line {n}: not a key and a value")
        value = found["value"] or ""
        out[found["key"]] = None if value.strip() in ("|", ">", "|-", ">-") else _scalar(value, n)
        open_ = out[found["key"]] is None
    return out


def load_config(spark: SparkSession, path: str) -> Config:
    """Settings of a YAML file, read whole by Spark; defaults if there is no such file, ConfigError if it can't be understood."""
    try:
        found = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return Config()
    values = {k: v for r in found.collect() for k, v in read_settings(r.value).items()}
    size = values.get("font_size")
    if size is not None:
        if not size.isdecimal():
            raise ConfigError(f"font_size is no number: {size}")
        values["font_size"] = int(size)
    return from_dict(values)
