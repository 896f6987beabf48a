"""From raw documents to packed training sequences, each stage a Spark job over what its predecessor kept.

A stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's documents, so a lost executor costs at most one stage's tasks. All but the last
stage return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from crashloom.llm import decontamination, line_dedup, ngram_join, packing, toxicity
from crashloom.llm.common import checkpoint_dir, held_out, table
from crashloom.llm.queries import END_ID, SEQUENCE, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as toxic go."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), lambda k: ~held_out(k, 5, 0))
    return toxicity.drop_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go; a document of which nothing is left keeps its row."""
    return line_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences."""
    return packing.pack(docs, tokenizer_path(), SEQUENCE, END_ID)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("ngram_join", drop_near_copies), ("decontamination", drop_contaminated), ("packing", pack)]

#: The first stage learns its decisions and the last one searches for combinations, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = f"{checkpoint_dir(spark)}/crashloom-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{i}-{name}")
        docs = spark.read.parquet(f"{where}/{i}-{name}")
    return docs
