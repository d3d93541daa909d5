"""The corpus pipeline stage by stage, and the queries against their SQL."""

import duckdb
import pyarrow as pa
import pytest
from check_oracles import canonical
from conftest import DATA

import corpus_pipeline as pipeline
from seriesloom.llm.queries import ORACLES, QUERIES
from tests.llm.test_texts import HOSTILE, docs


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_a_row_per_document(spark, name):
    rows = QUERIES[name](spark, DATA)
    sources = {"op7_main_text": ("pages", "page_id"), "op13_conversation_repair": ("conversations", "conv_id")}
    source, key = sources.get(name, ("documents", "doc_id"))
    whole = spark.read.parquet(f"{DATA}/{source}.parquet")
    assert rows.count() >= rows.select(key).distinct().count() == whole.select(key).distinct().count()


def test_stages_keep_columns_whatever_their_names(spark):
    frame = docs(spark, HOSTILE)
    ids = {}
    for name, step in pipeline.STAGES:
        out = step(spark, frame, DATA)
        if name != "packing":
            assert out.columns == frame.columns
            assert {r["bucket"] for r in out.select("bucket").distinct().collect()} == {"b"}
            frame = out.cache()
        ids[name] = [r["doc_id"] for r in out.collect()]
    assert sorted(i or 0 for i in ids["language_id"]) == [0, 4, 5, 6, 7, 8, 9, 9, 10, 11, 12, 13]
    assert sorted(i or 0 for i in ids["ngram_join"]) == [0, 4, 6, 7, 8, 9, 10, 11, 12, 13]
    assert set(ids["packing"]) == set(ids["mixing"]) <= set(ids["ngram_join"])


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_bound_the_bytes_of_arrow_batches(spark, name):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    frame = docs(spark, [(i, f"{i} " + "word " * 20_000, "en", "a") for i in range(120)])
    dict(pipeline.STAGES)[name](spark, frame, DATA)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["size"])

    most = frame.coalesce(1).select("text").mapInArrow(sizes, "size long").agg({"size": "max"}).first()[0]
    assert most < 6_000_000
    spark.conf.set(key, "1000000")
    dict(pipeline.STAGES)[name](spark, frame, DATA)
    assert spark.conf.get(key) == "1000000"  # the caller's own limit stays
    spark.conf.unset(key)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_take_an_empty_table(spark, name):
    step = dict(pipeline.STAGES)[name]
    assert step(spark, docs(spark, []), DATA).count() == 0


def test_run_mixes_what_is_left(spark):
    rows = pipeline.run(spark, DATA).toPandas()
    assert set(rows.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    ends = rows.assign(end=rows["sequence_id"] * 2048 + rows["offset"] + rows["length"]).sort_values("end")
    assert (ends["end"] - ends["length"]).tolist() == [0, *ends["end"].tolist()[:-1]]
    assert rows["doc_id"].nunique() > 100


def test_language_stage_without_labels_keeps_texts_with_letters(spark):
    rows = [(1, "some words", None, "a", 10), (2, "日本語", None, "a", 3), (3, "12 !", None, "a", 4), (4, None, None, "a", None)]
    inner = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stay = dict(pipeline.STAGES)["language_id"](spark, inner, "")
    assert sorted(r["doc_id"] for r in stay.collect()) == [1, 2]
