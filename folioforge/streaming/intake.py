"""Upload intake over a stream: the rules of operators.intake with state by job.

A job's state is the names it has taken, ten at most, and goes ``ttl`` after the job's last
file. Of a micro-batch a job's rows are looked at in the order of file_seq; of the files of several
micro-batches the earlier batch's come first, so the result is that of the batch rules, however the stream is cut, as
long as a job's files arrive in their order. Rows come out in append mode, once each, also after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioforge.operators.intake import MOST_BYTES, MOST_FILES

DAY_MS = 86_400_000


def _take(ttl: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = list(state.get[0]) if state.exists else []
        room, first = MOST_FILES - len(known), {}  # of each new name the first file; no more names than there is room for
        for pdf in parts:
            for seq, name, size in zip(pdf.file_seq, pdf.name, pdf["size"], strict=True):
                if room and name not in known and (name not in first or seq < first[name][0]):
                    first[name] = (seq, size)
                    if len(first) > room:
                        del first[max(first, key=lambda n: first[n][0])]
        taken = sorted((seq, name, size) for name, (seq, size) in first.items())
        state.update((known + [name for _, name, _ in taken],))
        state.setTimeoutDuration(ttl)
        rows = [(key[0], seq, name, size, len(known) + i + 1) for i, (seq, name, size) in enumerate(taken)]
        yield pd.DataFrame(rows, columns=["job_id", "file_seq", "name", "size", "slot"])

    return run


def stream_intake(files: DataFrame, ttl: int = DAY_MS) -> DataFrame:
    """job_id, file_seq, name, size and slot of the files (job_id, file_seq, name, size) of a stream that are taken."""
    kinds = dict(files.dtypes)
    small = files.select("job_id", "file_seq", "name", "size").where(F.col("size") <= MOST_BYTES)
    schema = f"job_id {kinds['job_id']}, file_seq {kinds['file_seq']}, name string, size {kinds['size']}, slot int"
    return small.groupBy("job_id").applyInPandasWithState(_take(ttl), schema, "names array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def drain(writer: DataStreamWriter) -> None:
    """Run a stream over all that is there now, and end.

    State with a time to live asks for batches without data, which would never end; they are off meanwhile.
    """
    spark = SparkSession.getActiveSession()
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        query = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)
    query.awaitTermination()
