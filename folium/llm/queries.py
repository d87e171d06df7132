"""The corpus operators as registered queries, with DuckDB SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, common, fingerprint, html_text, jaccard, mixing, pii, quality, tokenfile, toxicity, warc
from .oracle import oracle_sql  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(common.table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(common.table(spark, sf_dir, "pages"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_of(common.table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(common.table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(common.table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(common.table(spark, sf_dir, "documents"), vocabulary())


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(common.table(spark, sf_dir, "pages"))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(common.table(spark, sf_dir, "documents"), vocabulary())


def queries() -> dict[str, Query]:
    return {"op1_warc": op1_warc, "op2_token_file": op2_token_file, "op3_pii": op3_pii, "op4_toxicity": op4_toxicity, "op5_html_text": op5_html_text, "op6_jaccard": op6_jaccard, "op7_quality": op7_quality, "op8_mixing": op8_mixing, "op9_fingerprint": op9_fingerprint, "op10_bpe": op10_bpe}
