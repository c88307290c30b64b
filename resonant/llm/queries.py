"""The queries opN_<name>, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, html_text, jaccard, lm, quality, secrets, sql, token_counts, toxicity, url_filter
from .spark_io import spread_table, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(spread_table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.report(spread_table(spark, sf_dir, "pages"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(spread_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(spread_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(spread_table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(spark, sf_dir).select("doc_id", "n_shingles", "component_id")


def jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 with the number of links of every row, which its SQL does not have."""
    return jaccard.join(spread_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(spread_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(spread_table(spark, sf_dir, "documents"), spread_table(spark, sf_dir, "labels"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(spread_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_decontaminate, op2_token_counts, op3_html, op4_secrets, op5_bpe, op6_url_filter, op7_jaccard, jaccard_links, op8_quality, op9_toxicity, op10_lm)}
ORACLE_SQL: dict[str, str] = {"op1_decontaminate": sql.OP1, "op6_url_filter": sql.OP6, "op7_jaccard": sql.OP7, "op8_quality": sql.OP8}
