"""The registered queries on text, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm import languages, leaks, tokens
from sedimenta.operators.common import read


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(read(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(read(spark, d, "documents"), read(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.mislabelled(read(spark, d, "documents")).select("doc_id", "lang")


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """Every passage of every page with its language and confidence."""
    return languages.tag(read(spark, d, "documents")).drop("lang_label", "copy")


QUERIES = {f.__name__: f for f in (p7_ids, p8_found, p9_found, p9_passages)}
SQL: dict[str, str] = {}
