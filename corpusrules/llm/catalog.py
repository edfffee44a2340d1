"""Registered queries of this subpackage, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    collocations,
    decontaminate,
    html_text,
    licenses,
    packing,
    ngram_join,
    pii,
    quality,
    secrets_scan,
    substring_dedup,
    url_filter,
    whitening,
)
from .oracles import ORACLES  # noqa: F401
from .rows import spread

RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"
PII_KEY = "corpus-release-1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_classes(_texts(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_texts(spark, sf_dir))
    return found.select(
        "doc_id",
        F.array_join("licenses", ",").alias("licenses"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.digests(_texts(spark, sf_dir)).drop("text")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.mark(_texts(spark, sf_dir), digest=True).drop("text")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return html_text.extract(pages).drop("html")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, intercept = url_filter.fit(url_filter.labelled_urls(spark))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, weights, intercept).drop("url")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(_texts(spark, sf_dir))
    base = F.col("failed").bitwiseAND(F.lit(quality.POLICIES["base"]).cast("long"))
    judged = quality.apply_policy(entries).withColumn("base_failed", base != 0)
    return judged.drop("text", "n_lines", "n_upper", "n_exclaims")


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_texts(spark, sf_dir), PII_KEY)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe.round_trip(_texts(spark, sf_dir), path, pattern).drop("text")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    found = decontaminate.find_items(_texts(spark, sf_dir), benchmark)
    return decontaminate.report(found).drop("text")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_texts(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_license_scan,
        op3_secret_scan,
        op4_substring_dedup,
        op5_html_extraction,
        op6_url_filter,
        op7_quality_rules,
        op8_pii_pseudonyms,
        op9_byte_bpe,
        op10_benchmark_decontamination,
        op11_best_fit_packing,
        op12_embedding_whitening,
        op13_phrase_collocations,
        pipeline,
    )
}
