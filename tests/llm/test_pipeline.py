"""The pipeline's stages on a small corpus with planted cases."""

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from civicpulse.session import BATCH_BOUNDS

TABLES = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_only_drop(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, rows, TABLES)
        assert kept.columns == docs.columns, name
        kept = kept.cache()
        assert kept.exceptAll(rows).count() == 0, name
        assert 0 < kept.count() <= rows.count()
        rows = kept
    texts = rows.groupBy("text").count()
    assert texts.where("count > 1").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, TABLES)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows.collect())
    assert packed.agg(F.sum("length")).first()[0] == want


def test_stages_take_awkward_rows(spark, docs, nothing):
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        # Columns of clashing names come through as they are.
        out = stage(spark, docs, TABLES)
        rows = out.collect()
        assert stage(spark, nothing, TABLES).count() == 0
        if name == "packing":
            assert {r.doc_id for r in rows} == {k for k, _ in texts}
        else:
            assert out.columns == docs.columns
            assert {(r.doc_id, r.text) for r in rows} <= texts and {(r.row, r.block, r.kept) for r in rows} <= {("clash", 7, "clash")}


def test_registered():
    names = contract.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in names}
    assert "pipeline" in names and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_bound_the_batches_of_texts(spark, nothing):
    before = {key: spark.conf.get(key) for key in BATCH_BOUNDS}
    long_texts = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("word "), 20_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    for name, stage in corpus_pipeline.STAGES:
        for key in before:
            spark.conf.unset(key)
        stage(spark, nothing, TABLES)
        most = long_texts.mapInArrow(sizes, "bytes long").agg(F.max("bytes")).first()[0]
        assert most < 6 << 20, name
    for key, value in before.items():
        spark.conf.set(key, value)


def test_run_leaves_the_settings_as_they_were(spark):
    before = {key: spark.conf.get(key) for key in BATCH_BOUNDS}
    corpus_pipeline.run(spark, TABLES)
    assert {key: spark.conf.get(key) for key in BATCH_BOUNDS} == before
