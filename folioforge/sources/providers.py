"""External engines behind one interface; deterministic stand-ins for tests.

A provider is a factory called once in each partition; it gives a function from
a file's path and content to the engine's answer. A failing call, or one that takes
longer than its limit, gives an empty page or an outcome with an error and never stops
the job; what failed is told beside the results. Engines are dear: write their answers before using them twice.

An engine that is a program runs under supervision (``command``): in a process group and a scratch
folder of its own; the whole group is killed at the limit and gone when the call ends, however it ends.
"""

from __future__ import annotations

import contextlib
import os
import queue
import shutil
import signal
import subprocess
import tempfile
import threading
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ELEMENT_SCHEMA = "page_id string, elem_idx int, kind string, box array<struct<x:double,y:double>>, text string, score double, html string, lines array<string>, error string, error_type string"
OUTCOME_SCHEMA = "job_id string, file_seq long, ok boolean, path string, error string, error_type string"
#: Seconds that a conversion may take.
LIMIT = 60.0

Ocr = Callable[[], Callable[[str, bytes], list[dict]]]
Converter = Callable[[], Callable[[str], str]]


def within(seconds: float | None, call: Callable, *args):
    """What the call gives; TimeoutError if that takes longer. A call that hangs keeps its thread, not the task."""
    if seconds is None:
        return call(*args)
    answer: queue.Queue = queue.Queue()

    def run():
        try:
            answer.put((True, call(*args)))
        except BaseException as e:
            answer.put((False, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        ok, value = answer.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer within {seconds:g} s") from None
    if not ok:
        raise value
    return value


class NoOutputError(RuntimeError):
    """A program that ended well and wrote nothing."""


def command(argv: list[str], folder: str, suffix: str = ".pdf", seconds: float = LIMIT) -> Converter:
    """An engine that runs a program for a file and puts what it wrote into the shared ``folder``.

    ``{path}`` and ``{out}`` in ``argv`` stand for the file and a scratch folder, which is the program's working and output
    folder as well as its home. The output is found by the file's own name with ``suffix``, and takes that name in
    ``folder`` in one step. Errors: TimeoutExpired, CalledProcessError with what the program said, FileNotFoundError without the program, NoOutputError.
    """

    def make():
        def run(path: str) -> str:
            stem = os.path.splitext(os.path.basename(path))[0]
            scratch = tempfile.mkdtemp(prefix="convert-")
            try:
                _supervised([x.replace("{path}", path).replace("{out}", scratch) for x in argv], scratch, seconds)
                made = os.path.join(scratch, stem + suffix)
                if not os.path.exists(made):
                    raise NoOutputError(f"the program ended without {stem}{suffix}")
                os.makedirs(folder, exist_ok=True)
                target, part = os.path.join(folder, stem + suffix), os.path.join(folder, f".{uuid.uuid4().hex}")
                shutil.copyfile(made, part)
                os.replace(part, target)
                return target
            finally:
                shutil.rmtree(scratch, ignore_errors=True)

        run.supervised = True
        return run

    return make


def _supervised(argv: list[str], scratch: str, seconds: float) -> None:
    with open(os.path.join(scratch, ".said"), "w+b") as said:
        process = subprocess.Popen(argv, stdin=subprocess.DEVNULL, stdout=said, stderr=subprocess.STDOUT, cwd=scratch, env=os.environ | {"HOME": scratch}, start_new_session=True)
        try:
            code = process.wait(seconds)
        finally:
            with contextlib.suppress(ProcessLookupError):  # what the program has left running goes too
                os.killpg(process.pid, signal.SIGKILL)
            process.wait()
        if code:
            said.seek(0)
            raise subprocess.CalledProcessError(code, argv[0], stderr=said.read().decode(errors="replace"))


def office_to_pdf(folder: str, seconds: float = LIMIT) -> Converter:
    """Slides to PDF by an office suite on the executors' path, each call with a profile of its own."""
    return command(["soffice", "-env:UserInstallation=file://{out}/profile", "--headless", "--convert-to", "pdf", "--outdir", "{out}", "{path}"], folder, ".pdf", seconds)


def error_type(e: BaseException) -> str:
    """timeout, missing (no such engine or file), failed (the engine's own error code), no_output or other."""
    if isinstance(e, NoOutputError):
        return "no_output"
    if isinstance(e, TimeoutError | subprocess.TimeoutExpired):
        return "timeout"
    if isinstance(e, FileNotFoundError | ModuleNotFoundError):
        return "missing"
    return "failed" if isinstance(e, subprocess.CalledProcessError) else "other"


def ocr_elements(pages: DataFrame, provider: Ocr, seconds: float | None = None) -> DataFrame:
    """Elements of each page (page_id, path, content), in the engine's order; a page that failed is one row without elem_idx, with its error."""
    names = ["kind", "box", "text", "score", "html", "lines"]

    def run(batches):
        engine = None
        for pdf in batches:
            rows = []
            for page in pdf.itertuples():
                try:
                    engine = engine or provider()
                    found = within(seconds, engine, page.path, page.content) or []
                    rows += [[page.page_id, i, *(e.get(n) for n in names), None, None] for i, e in enumerate(found)]
                except Exception as e:
                    rows.append([page.page_id, None, *[None] * len(names), str(e) or type(e).__name__, error_type(e)])
            yield pd.DataFrame(rows, columns=["page_id", "elem_idx", *names, "error", "error_type"]).astype({"elem_idx": "Int32"})

    return pages.select("page_id", "path", "content").mapInPandas(run, ELEMENT_SCHEMA)


def page_errors(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The elements of what ``ocr_elements`` gave, and page_id, error and error_type of the pages that failed."""
    failed = F.col("error_type").isNotNull()
    return found.where(~failed).drop("error", "error_type"), found.where(failed).select("page_id", "error", "error_type")


def convert(files: DataFrame, *providers: Converter, error: str | None = None, seconds: float | None = LIMIT) -> DataFrame:
    """The outcome of each file (job_id, file_seq, path): that of the first engine that succeeds, each tried once at most.

    Where all fail, ``error`` is told, or the last engine's own error if there is none.
    """

    def run(batches):
        engines: list = [None] * len(providers)
        for pdf in batches:
            rows = []
            for f in pdf.itertuples():
                row = [f.job_id, f.file_seq, False, None, error, "missing"]
                for i, make in enumerate(providers):
                    try:
                        engines[i] = engines[i] or make()
                        limit = None if getattr(engines[i], "supervised", False) else seconds
                        row = [f.job_id, f.file_seq, True, within(limit, engines[i], f.path), None, None]
                        break
                    except Exception as e:
                        row = [f.job_id, f.file_seq, False, None, str(e) if error is None else error, error_type(e)]
                rows.append(row)
            yield pd.DataFrame(rows, columns=["job_id", "file_seq", "ok", "path", "error", "error_type"])

    return files.select("job_id", "file_seq", "path").mapInPandas(run, OUTCOME_SCHEMA)


def convert_with_fallback(files: DataFrame, first: Converter, second: Converter, error: str, seconds: float | None = LIMIT) -> DataFrame:
    """Try the first engine; the second only where it failed, in the same pass; one fixed error where both did."""
    return convert(files, first, second, error=error, seconds=seconds)


def merge_files(files: DataFrame, provider: Callable[[], Callable[[list[bytes]], bytes]]) -> DataFrame:
    """One file for each job from its files (job_id, file_seq, content) in order, by an engine that joins their bytes."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = list(pdf.sort_values("file_seq").content)
        try:
            return pd.DataFrame({"job_id": [pdf.job_id.iloc[0]], "ok": [True], "content": [provider()(parts)], "error": [None]})
        except Exception as e:
            return pd.DataFrame({"job_id": [pdf.job_id.iloc[0]], "ok": [False], "content": [None], "error": [str(e)]})

    return files.select("job_id", "file_seq", "content").groupBy("job_id").applyInPandas(one, "job_id string, ok boolean, content binary, error string")


def unwrap_page(result: object) -> list:
    """An engine's answer for one image is a list whose first item is the page; anything else is an empty page."""
    return result[0] if isinstance(result, list) and result and isinstance(result[0], list) else []


def normalise_lines(res: object) -> list[str] | None:
    """The accepted shapes of a text element's result as a list of lines, other shapes left out."""
    if isinstance(res, tuple) and res and isinstance(res[0], str):
        return [res[0]]
    if not isinstance(res, list):
        return None
    lines = []
    for item in res:
        if isinstance(item, str):
            lines.append(item)
        elif isinstance(item, tuple | list) and item:
            if isinstance(item[0], str):
                lines.append(item[0])
            elif len(item) > 1 and isinstance(item[1], tuple | list) and item[1] and isinstance(item[1][0], str):
                lines.append(item[1][0])
    return lines


def text_lines_provider() -> Callable[[str, bytes], list[dict]]:
    """A stand-in engine: a page's content is UTF-8 text, each line an element below the one before."""

    def read(path: str, content: bytes) -> list[dict]:
        return [{"kind": None, "text": line, "score": 1.0, "box": [{"x": 0.0, "y": float(i)}, {"x": 1.0, "y": float(i + 1)}]} for i, line in enumerate(content.decode().split("\n"))]

    return read
