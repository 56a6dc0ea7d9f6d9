"""Registered queries of the training-data operators: SQL where there is any, else shape and totals."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import catalog
from tests import oracle

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_jaccard_join": ["doc_id", "n_shingles", "component_id", "n_links"],
    "op2_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op3_repeats": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op4_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op5_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op6_pivots": ["vec_id", "n_links", "component_id", "kept"],
    "op7_quality": ["doc_id", "held_out", "score", "predicted"],
    "op8_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op9_language_model": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op11_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "op12_chat": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op13_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op10_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
}
TABLE = {"op5_warc": "pages", "op6_pivots": "embeddings"}


def test_one_query_per_operator():
    assert set(catalog.PLANS) == set(COLUMNS)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "tokens"]


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    found = catalog.PLANS[name](spark, SF)
    assert found.columns == COLUMNS[name]
    if name in catalog.SQL:
        db = oracle.connect(SF)
        assert oracle.compare(found, db, catalog.SQL[name]) is None
        assert oracle.types(found, db, catalog.SQL[name]) == {}
    else:
        assert found.count() == catalog.table(spark, SF, TABLE.get(name, "documents")).count()


def test_pipeline_stages(spark):
    docs = catalog.table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
        assert docs.columns == columns and docs.count() > 0, name
    found = corpus_pipeline.tokens(spark, docs, SF)
    assert found.columns == COLUMNS["op2_token_files"] and found.count() == docs.count()


def test_mix_stage_in_several_batches(spark):
    docs = spark.range(0, 600, 1, 4).select(
        F.col("id").alias("doc_id"),
        F.expr("repeat('word ', cast(1 + id % 50 as int))").alias("text"),
        F.lit("en").alias("lang"),
        F.concat(F.lit("s"), F.col("id") % 3).alias("source"),
        F.lit(0).cast("long").alias("n_chars"),
    )
    whole = collections.Counter(tuple(r) for r in corpus_pipeline.mixed(spark, docs, SF).collect())
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    try:
        spark.conf.set(key, 16)
        assert collections.Counter(tuple(r) for r in corpus_pipeline.mixed(spark, docs, SF).collect()) == whole
    finally:
        spark.conf.set(key, was)
    assert {r[0] for r in whole} <= set(range(600)) and len({r[3] for r in whole}) == 3
