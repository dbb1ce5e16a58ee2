"""The history tree user/date/area/file as a data source that lists only the folders that are asked for.

``spark.read.format("history").load(root)``: username, ymd, area, filename, is_meta and meta_content (the text of
a sidecar). Filters on username, ymd and area are taken over by the source, so one user's date is one listed
folder; each user's date is a partition. Folders that are no dates are left out; a missing root is empty.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from folioforge.sources.sinks import filesystem

SCHEMA = "username string, ymd string, area string, filename string, is_meta boolean, meta_content string"


@dataclass
class Day(InputPartition):
    username: str
    ymd: str


class HistoryReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root
        self.wanted: dict[str, set[str]] = {}
        #: Folders listed so far, by this copy of the reader.
        self.listed: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("username",), ("ymd",), ("area",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f

    def _folders(self, level: str, path: str) -> list[str]:
        """The names of the folders below a path that the filters let in; where the filters name them, only these are looked at."""
        files, root = filesystem(self.root)
        path = posixpath.join(root, path)
        if level in self.wanted:
            names = sorted(n for n in self.wanted[level] if n and "/" not in n and n not in (".", ".."))
            found = files.get_file_info([posixpath.join(path, n) for n in names])
        else:
            self.listed.append(path)
            found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.Directory)

    def partitions(self) -> list[Day]:
        return [Day(user, day) for user in self._folders("username", "") for day in self._folders("ymd", user) if re.fullmatch("[0-9]{8}", day)]

    def read(self, partition: Day) -> Iterator[tuple]:
        if partition is None or not hasattr(partition, "username"):
            return
        files, root = filesystem(self.root)
        for area in self._folders("area", posixpath.join(partition.username, partition.ymd)):
            folder = posixpath.join(root, partition.username, partition.ymd, area)
            self.listed.append(folder)
            for f in sorted(files.get_file_info(fs.FileSelector(folder)), key=lambda f: f.base_name):
                if f.type == fs.FileType.File:
                    meta = f.base_name.endswith(".meta")
                    text = files.open_input_stream(f.path).read().decode() if meta else None
                    yield partition.username, partition.ymd, area, f.base_name, meta, text


class History(DataSource):
    @classmethod
    def name(cls) -> str:
        return "history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(self.options["path"])


def read_tree(spark: SparkSession, root: str):
    """The history rows of a tree; filter them by username, ymd and area to list no more than that."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(History)
    return spark.read.format("history").load(root)
