"""A corpus pipeline over ``documents``: five stages, each applying one operator to all that the one before kept.

* quality: documents that the classifier rejects go.
* near_duplicates: of each component of documents with similar 5-word shingles (0.8 or more) the one with the
  smallest id stays.
* decontaminate: documents that hold a window of a benchmark go.
* mix: documents are left out or repeated until every source has its target share of words.
* tokens: the rest as token ids in bit-packed files; returned is what the files say of each document.

Every stage is written as Parquet to the shared folder and read again, so none is computed twice.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, jaccard_join, mixing, quality, token_files
from spanloom.llm.catalog import table
from spanloom.llm.common import free_name, stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    name = free_name("score", docs.columns)
    return quality.score(docs, model, name=name).where(F.col(name) >= 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, size=5, num=80, den=100)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.search(docs, table(spark, sf_dir, "benchmark"))
    spans = found.columns[len(docs.columns) + 1]
    return found.where(F.size(spans) == 0).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = mixing.mix(docs)
    copies, again = found.columns[-2], free_name("copy", found.columns)
    return found.where(F.col(copies) > 0).withColumn(again, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("mix", mixed),
    ("tokens", tokens),
]

#: A trained classifier and a library's tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


PLANS = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
