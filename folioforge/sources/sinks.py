"""File sinks as data sources: tasks stage whole files, the commit gives them their names.

``docx``: blocks (operators.documents) to one word-processor file for each document.
``whole_files``: rows (name, content) to files. ``file_parts``: rows (name, part, content) to files, of which one part is in memory at a time.

A task writes below ``_staging-*`` in the target folder, which the driver and all tasks must
share. Only when every task has succeeded do the files move to their names; a failed
job leaves none, nor what its tasks have staged. Names may have folders. A name that two files would have, or a document
whose blocks came in several pieces, fails the job. ``overwrite`` removes files that the folder itself had,
once the new ones are there. The rows of a document need one task and their order: ``write_documents`` sees to it.
"""

from __future__ import annotations

import contextlib
import itertools
import posixpath
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from folioforge.session import small_batches
from folioforge.sources.docx import write_document

STAGING = "_staging-"
#: Whole files that a task gets at a time.
WHOLE_ROWS = 32


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    names: list[str]


class FileWriter(DataSourceWriter):
    """``files`` gives (name, function that writes it to a stream) for a task's rows."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.options, self.overwrite = dict(options), overwrite
        self.token = uuid.uuid4().hex

    def files(self, rows: Iterator[Row]) -> Iterator[tuple[str, Callable]]:
        raise NotImplementedError

    def _root(self) -> tuple[fs.FileSystem, str, str]:
        files, root = filesystem(self.options["path"])
        return files, root, posixpath.join(root, STAGING + self.token)

    def write(self, rows: Iterator[Row]) -> Staged:
        files, _, staging = self._root()
        task = TaskContext.get()
        folder = posixpath.join(staging, f"{task.partitionId()}-{task.taskAttemptId()}")
        files.create_dir(folder, recursive=True)
        names = []
        for name, fill in self.files(rows):
            if not name or any(not x or x in (".", "..") or x.startswith("_") for x in name.split("/")):
                raise ValueError(f"not a file name: {name!r}")
            with files.open_output_stream(posixpath.join(folder, str(len(names)))) as out:
                fill(out)
            names.append(name)
        return Staged(folder, names)

    def commit(self, messages: list[Staged | None]) -> None:
        files, root, staging = self._root()
        told = [m for m in messages if m is not None]
        twice = [name for name, n in Counter(name for m in told for name in m.names).items() if n > 1]
        if twice:
            self.abort(messages)
            raise ValueError(f"several files would have the same name, or a document's blocks came from several tasks: {twice[:3]}")
        files.create_dir(root, recursive=True)
        before = {f.base_name for f in files.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File}
        for folder in {posixpath.dirname(name) for m in told for name in m.names} - {""}:
            files.create_dir(posixpath.join(root, folder), recursive=True)
        for m in told:
            for i, name in enumerate(m.names):
                files.move(posixpath.join(m.folder, str(i)), posixpath.join(root, name))
        if self.overwrite:
            for name in before - {name for m in told for name in m.names}:
                files.delete_file(posixpath.join(root, name))
        files.open_output_stream(posixpath.join(root, "_SUCCESS")).close()
        self._drop(files, staging)

    def abort(self, messages: list[Staged | None]) -> None:
        files, _, staging = self._root()
        self._drop(files, staging)

    def _drop(self, files: fs.FileSystem, staging: str) -> None:
        with contextlib.suppress(FileNotFoundError):
            files.delete_dir(staging)


class WholeFileWriter(FileWriter):
    def files(self, rows):
        for r in rows:
            yield r.name, lambda out, content=r.content: out.write(content or b"")


class PartWriter(FileWriter):
    """Parts in the order of their file and place."""

    def files(self, rows):
        for name, parts in itertools.groupby(rows, key=lambda r: r.name):

            def fill(out, own=parts):
                for r in own:
                    out.write(r.content or b"")

            yield name, fill


class DocumentWriter(FileWriter):
    """Blocks in the order of their document and place; of a document one block is in memory at a time."""

    def files(self, rows):
        font, size = self.options.get("font", "SimSun"), int(self.options.get("size", "11"))
        met = set()
        for doc_id, blocks in itertools.groupby(rows, key=lambda r: r.doc_id):
            if doc_id in met:
                raise ValueError(f"the blocks of document {doc_id} are not together")
            met.add(doc_id)
            yield document_name(doc_id), lambda out, own=blocks: write_document(out, _in_order(own), font, size)


def _in_order(blocks: Iterator[Row]) -> Iterator[tuple]:
    last = None
    for r in blocks:
        if last is not None and r.block_seq <= last:
            raise ValueError(f"block {r.block_seq} of document {r.doc_id} comes after block {last}")
        last = r.block_seq
        cells = r["cells"] if "cells" in r else None
        yield (r.kind, r.text) if cells is None else (r.kind, r.text, [tuple(c) for c in cells], r.n_rows, r.n_cols)


def document_name(doc_id: object) -> str:
    """The last part of the id, as a path, without its extension, and .docx."""
    base = posixpath.basename(str(doc_id).rstrip("/"))
    stem, dot, _ = base.rpartition(".")
    return (stem if dot and stem.strip(".") else base) + ".docx"


class WholeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return WholeFileWriter(self.options, overwrite)


class FileParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_parts"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return PartWriter(self.options, overwrite)


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docx"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return DocumentWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    for source in (WholeFiles, FileParts, Documents):
        spark.dataSource.register(source)


def write_files(files: DataFrame, folder: str, mode: str = "append") -> None:
    """Write rows (name, content) as files of the folder, from the tasks."""
    register(files.sparkSession)
    with small_batches(files.sparkSession, WHOLE_ROWS):
        files.select("name", "content").write.format("whole_files").mode(mode).save(folder)


def write_parts(parts: DataFrame, folder: str, mode: str = "append") -> None:
    """Write rows (name, part, content) as files of the folder, each its parts in order."""
    register(parts.sparkSession)
    dealt = parts.select("name", "part", "content").repartition("name").sortWithinPartitions("name", "part")
    with small_batches(parts.sparkSession):
        dealt.write.format("file_parts").mode(mode).save(folder)


def write_documents(blocks: DataFrame, folder: str, font: str = "SimSun", size: int = 11, mode: str = "append") -> None:
    """Write the blocks as one file for each document, named after its doc_id."""
    register(blocks.sparkSession)
    dealt = blocks.repartition("doc_id").sortWithinPartitions("doc_id", "block_seq")
    with small_batches(blocks.sparkSession):
        dealt.write.format("docx").option("font", font).option("size", str(size)).mode(mode).save(folder)
