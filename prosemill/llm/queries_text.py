"""Queries of the operators on texts, pages and media."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import audio, bpe, html_text, mixlm, toxicity
from .common import table


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixlm.language_scores(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(audio.store_texts(table(spark, sf_dir, "documents")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op2_html_text": op2_html_text, "op3_mixing_lm": op3_mixing_lm, "op6_audio": op6_audio, "op4_toxicity": op4_toxicity, "op9_bpe": op9_bpe}
SQL: dict[str, str] = {}
