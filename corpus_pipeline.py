"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

quality       documents that the quality classifier rejects go
near_dedup    one document of each group of similar ones (five-word shingles, 0.8 or more) stays, that of the smallest doc_id
decontaminate documents that hold a benchmark item go
mix           documents are repeated or left out so that sources meet their target weights
tokens        token ids are written in directly addressable files; a row a document tells its place and checksum

All stages but the last return the columns of documents. An empty table passes through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, mixing, quality, shingles, tokens
from quillspark.llm.common import load, shared_dir


def _rows(docs: DataFrame) -> DataFrame:
    """The text beside the whole row, so no column of docs can clash with those that a stage adds."""
    return docs.select("text", F.struct(*docs.columns).alias("row"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    return model.score(_rows(docs)).where("predicted = 1").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.search(_rows(docs), load(spark, sf_dir, "benchmark")).where(F.size("hits") == 0).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emitted(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokens.write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.documents(spark, folder)


STAGES = [("quality", keep_quality), ("near_dedup", near_dedup), ("decontaminate", drop_benchmark), ("mix", mix), ("tokens", write_tokens)]

#: The classifier, the fingerprints and the tokenizer have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
