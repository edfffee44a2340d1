"""A corpus from raw documents to token counts, as stages of written tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusrules.llm import bpe, decontaminate, ngram_join, pii, quality
from corpusrules.llm.catalog import PII_KEY, RANKS
from corpusrules.session import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects. A null text has no words and is rejected."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that with the smallest id."""
    return ngram_join.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in the text replaced; n_chars follows the text."""
    out = pii.pseudonymise(docs, PII_KEY, counts=False)
    if "n_chars" in out.columns:
        from pyspark.sql import functions as F

        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digest of the ids, digest of the bytes decoded from them."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe.round_trip(docs.select("doc_id", "text"), path, pattern).drop("text")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("pii", pii_pseudonyms),
    ("byte bpe", byte_bpe),
]
#: SQL expresses neither the pseudonyms nor the tokens. Each stage calls an operator that tests/llm holds
#: against DuckDB or brute force; run() itself is not compared with a brute-force form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet in the shared folder and reread."""
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{home}/{number}")
        docs = spark.read.schema(out.schema).parquet(f"{home}/{number}")
    return docs
