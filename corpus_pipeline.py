"""The training-data pipeline: each stage works on all rows that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.bpe import bpe_digests, encode_and_decode
from sieveline.llm.columns import fresh, quoted
from sieveline.llm.mixing import mix
from sieveline.llm.near_dup import one_of_each
from sieveline.llm.pii import pseudonymise_documents
from sieveline.llm.quality_model import train_quality
from sieveline.plans.durable import durable

#: Documents with a lower score are rejected.
GOOD = 0.3
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labelled ones that aren't held out.

    Null and empty texts get the model's bias as score; repeated rows stay or go together; columns of any name are kept.
    """
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    copy, score = fresh(docs, "_copy", "_score")
    scored = model.score(docs.withColumn(copy, F.col("text")), text_col=copy, score_col=score)
    return scored.where(F.col(score) >= GOOD).select(*map(quoted, docs.columns))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, whatever ids its rows have.

    Five-word shingles and a similarity of 0.8, as the job asks of stages; ``op7_minhash_near_dup`` takes two words, as its
    contract says, and so links more. Texts without words are in no group and stay; repeated rows become one.
    """
    return one_of_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with pseudonyms in place of personal data. Null texts stay null; columns of any name are kept."""
    [spans] = fresh(docs, "_spans")
    return pseudonymise_documents(docs, spans_col=spans).drop(spans)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them; null and wordless texts have no size and aren't taken."""
    return mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document taken; null and empty texts have no token; repeated rows get equal ones."""
    coded = encode_and_decode(docs.select("doc_id", "source", "text"), VOCABULARY, public_tokenizers.PATTERN)
    return coded.select("doc_id", "source", *bpe_digests())


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_dup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("byte-level bpe", bpe_stage),
]
#: Training, hashing, random rounding and tokenizing are beyond SQL; a test holds each stage against a plain version of it on
#: what its predecessor kept (the classifier's fit and the draw of the mix against plain versions of their own).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each stage's rows kept in the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
