"""The pipeline's stages, each on its own input, and the registration of the queries."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioforge.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        from folioforge.llm.common import written

        docs = out[name] = written(stage(spark, docs, SF))
    return out


def test_stages_keep_columns(kept):
    for name in ("toxicity", "language_id", "near_dedup", "mixing"):
        assert kept[name].columns == kept["documents"].columns


def test_filters_take_subsets(kept):
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in kept.items() if k != "packing"}
    assert ids["documents"] >= ids["toxicity"] >= ids["language_id"] >= ids["near_dedup"] >= ids["mixing"]
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    clean = set(labels[labels.toxic == 0].doc_id) & ids["documents"]
    assert clean <= ids["toxicity"] and ids["language_id"] == ids["toxicity"]


def test_dedup_keeps_one_of_each_group(kept):
    from tests.llm.test_operators import brute_components

    rows = [(r.doc_id, r.text) for r in kept["language_id"].select("doc_id", "text").collect()]
    want = {c for _, _, c in brute_components(rows, 5, 80)}
    assert {r.doc_id for r in kept["near_dedup"].collect()} == want and kept["near_dedup"].count() == len(want)


def test_mix_and_packing(kept):
    size = lambda df: df.selectExpr(r"sum(regexp_count(text, '[^\\x20\\x09-\\x0D]+')) as n").first().n
    assert abs(size(kept["mixing"]) / size(kept["near_dedup"]) - 1.5) < 0.05
    assert kept["packing"].select("doc_id").distinct().count() == kept["mixing"].count()


def test_run(spark, kept):
    assert corpus_pipeline.run(spark, SF).columns == kept["packing"].columns


def test_stages_on_odd_rows(spark):
    base = "the quick brown fox jumps over the lazy dog and runs into the dark wood where nobody ever goes at night"
    rows = [(1, base, "en", "a"), (1, base, "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, base + " once", None, None), (None, "x", "en", "a"), (5, "12 34", "en", "c"), (6, "loup " * 3000, "fr", "c")]
    names = ["start", "size", "score", "predicted", "rejected", "lang_pred", "kept", "component_id", "class", "block", "times", "target", "taken", "label", "place"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text")).withColumns({n: F.lit(n) for n in names})
    for df in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            if name != "packing":
                assert out.columns == df.columns
                assert out.where(" or ".join(f"{n} <> '{n}'" for n in names)).count() == 0
            assert (out.count() > 0) == (df.limit(1).count() > 0)
    assert {r.doc_id for r in corpus_pipeline.drop_unknown_language(spark, docs, SF).collect()} == {1, 4, None, 6}
    assert corpus_pipeline.drop_near_duplicates(spark, docs, SF).where("doc_id = 1").count() == 1


def test_python_gets_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    docs = spark.range(1200).selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang", "'a' as source", "7L as n_chars").coalesce(1)

    def bounded(df):
        def run(batches):
            for b in batches:
                assert b.num_rows <= 1000
                yield b

        return df.mapInArrow(run, df.schema)

    def predicts(column, value):
        def predict(df, model):
            assert "text" not in df.schema["_row"].dataType.names  # the text goes once
            return bounded(df).withColumn(column, F.lit(value))

        return predict

    for module in (corpus_pipeline.toxicity, corpus_pipeline.language):
        monkeypatch.setattr(module, "fit", lambda rows: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "predict", predicts("predicted", 0))
    monkeypatch.setattr(corpus_pipeline.language, "predict", predicts("rejected", False))
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_unknown_language):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.exceptAll(docs).count() == 0 and out.count() == 1200
    pieces = corpus_pipeline.packing.pieces
    monkeypatch.setattr(corpus_pipeline.packing, "pieces", lambda df, *rest: pieces(bounded(df), *rest))
    assert corpus_pipeline.pack(spark, docs, SF).select("doc_id").distinct().count() == 1200
    spark.conf.unset(key)


def test_registered():
    import __spark_entry__ as entry

    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries()) and set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    from tests.test_queries import rows

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    result = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns) and rows(df.columns, df.collect()) == rows(columns, result.fetchall())
