"""From raw documents to token ids: language, near duplicates, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as
Parquet to the shared folder and hands what it reads back to the next. All but the last return the
columns of documents. Tables that a stage writes on its way go when its rows are written, and a stage's rows
go when the next stage's are; what run() returns is read from one folder, which the caller may delete after use.

Null and empty texts: the first stage finds no language in them, so they go. Rows without an id are documents of their own and stay
through all stages; rows that repeat an id are one document, of which the second stage keeps one row. Extra columns go through all stages but the last
as they are. An empty table gives no row.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, langid, mixing, neardup, pii
from tidelog.llm.common import give_back, remove, shared_dir, table, workspace


def lean(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, beginning and ending with no native memory held that earlier plans have freed."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        out = stage(spark, docs, sf_dir)
        give_back(spark)
        return out

    return run_stage


@lean
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that some document names; texts that fit none go."""
    return langid.keep_identified(docs, langid.learn(docs))


@lean
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate class."""
    return neardup.keep_one(docs)


@lean
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets; n_chars follows the text."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@lean
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mixed_rows(docs)


@lean
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document of the mixture."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mixture),
    ("byte_bpe", tokens),
]
#: The stages learn, sign and sample by hashes that SQL doesn't have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        with workspace(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
