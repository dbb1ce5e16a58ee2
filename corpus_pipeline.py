"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), with docs the documents that the stage
before kept, and returns the documents that it keeps, with the same columns;
the last returns the pieces of the packed sequences.

Defined cases: null and empty texts count as clean, have no language and so go
at the second stage; repeated rows stay until near_dedup keeps one of them;
empty tables give empty results; further columns, whatever their names, stay. The first two stages
leave the session with Arrow batches of ``BATCH_ROWS`` rows at most; ``run`` restores its setting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import language, mixing, neardup, packing, toxicity
from folioforge.llm.common import read, remainder, small_batches, written
from folioforge.llm.queries import labelled_documents, vocabulary_path
from folioforge.session import release, shared_tables


#: Rows that Python gets at a time; of Spark's 10,000, documents make tens of MB in each process.
BATCH_ROWS = 1000


def few_rows(spark: SparkSession) -> None:
    """From now on the session sends Python no more than BATCH_ROWS rows at a time: a stage's rows are planned after it has returned."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def whole(docs: DataFrame) -> DataFrame:
    """The text beside the rest of the row, so that no column's name can clash with an operator's."""
    return docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"))


def unwrapped(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows that ``whole`` made, with the columns of docs again."""
    return found.select(*[F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier, learnt from the labelled ones, marks as toxic."""
    model = toxicity.fit(labelled_documents(docs, read(spark, sf_dir, "labels")))
    few_rows(spark)
    return unwrapped(toxicity.predict(whole(docs), model).where("predicted = 0"), docs)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that lie far from every language's centroids or have no letter."""
    model = language.fit(docs.where(remainder(F.col("doc_id"), 5) != 0))
    few_rows(spark)
    return unwrapped(language.predict(whole(docs), model).where("not rejected"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest doc_id of each group of 5-word-shingle similarity 0.8 or more; a repeated row once."""
    found = neardup.near_duplicates(docs, shingle_words=5, percent=80)
    kept = found.where("kept").select(F.col("doc_id").alias("_kept"))
    rows = whole(docs).withColumn("_id", F.col("_row.doc_id"))
    return unwrapped(rows.join(kept, F.col("_id").eqNullSafe(F.col("_kept")), "left_semi").dropDuplicates(["_id", "text"]), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, cut or drop documents block by block until each source has its target number of words."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and pack the documents into sequences of at most 2048 ids."""
    return packing.pack_documents(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Trained classifiers and a tokenizer have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), shared_tables(spark)
    with small_batches(spark, BATCH_ROWS):  # the session has its own setting again afterwards
        for _, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir))
            release(spark, before, keep=[docs])  # what the stage wrote besides its result, and the result of the one before
    return docs
