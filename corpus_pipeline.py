"""A training corpus from documents: toxicity, quality, near duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of documents. Rows are judged one
by one, also those that share an id. Null and empty texts, repeated rows and
ties are treated as each stage says; an empty table stays empty.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, mixing, packing, quality, toxicity
from tidemark.llm.bpe import with_token_count
from tidemark.llm.common import fold
from tidemark.llm.queries import BYTE_BPE, DOMAIN, LEVELS, WEIGHTS
from tidemark.session import settle, settle_table, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str, column: str, folds: int, held_out: int) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.filter(fold(F.col("doc_id"), folds) != held_out).select("doc_id", F.col(column).alias("label"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity under 0.7. Null and empty texts have the score of a text without a match; repeated rows share one."""
    model = toxicity.train(docs, _labels(spark, sf_dir, "toxic", 3, 1))
    scored = toxicity.score(docs.select(*COLUMNS, F.col("text").alias("_read")), model, "_read", threshold=0.7)
    return scored.filter("predicted = 0").select(COLUMNS)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a quality of 0.3 or more. A null text is scored as an empty one; repeated rows share a score."""
    model = quality.train(docs, _labels(spark, sf_dir, "quality", 5, 0))
    scored = quality.score(docs.select(*COLUMNS, F.col("text").alias("_read")), model, "_read", threshold=0.3)
    return scored.filter("predicted = 1").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) the row of the smallest id; texts without words stay.

    Rows are numbered first, so rows that share an id are rows of their own:
    two texts under one id may both stay, and of two copies under one id one
    does (the first by number). A null id comes after all others.
    """
    rows = settle_table(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))
    groups = settle(jaccard_join.jaccard_components(rows.select("_row", "text"), width=5, num=80, den=100, doc_id="_row"))
    shared = groups.filter("doc_id <> component_id").select("component_id").distinct()
    members = groups.join(shared, "component_id", "left_semi").select(F.col("doc_id").alias("_row"), "component_id")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = members.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(place)["_row"].alias("_first"))
    gone = members.join(first, F.col("_row") == F.col("_first"), "left_anti").select("_row")
    return rows.join(gone, "_row", "left_anti").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of each leaf's seeded token-prefix that its budget pays for whole: 0.8 of all tokens, no document twice.

    Tokens are the ids that `pack` writes. A null or empty text has none and
    stays if its place is in the prefix; null languages and sources are leaves.
    """
    counted = settle_table(with_token_count(docs.select(*COLUMNS), public_tokenizers.path(BYTE_BPE)).withColumn("domain", F.expr(DOMAIN)))
    mixed = mixing.mix(counted, LEVELS, WEIGHTS, share=0.8, epochs=1, seed="mix-1", tokens=F.col("n_tokens"), then=F.md5(F.coalesce("text", F.lit(""))))
    return mixed.filter("copies > 0").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens; a null or empty text is one end id, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path(BYTE_BPE), capacity=1024)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_copies", drop_near_copies), ("mixture", mix_sources), ("packing", pack)]

#: Learned models and a tokenizer decide what stays: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
