"""Registered queries of the text-analytics core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.operators import tally


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def token_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each last word ends a sentence."""
    return tally.last_words(_docs(spark, sf_dir), text="text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"token_tally": token_tally}


def oracle_sql() -> dict[str, str]:
    return {
        "token_tally": r"""
            SELECT token, count(*) AS n FROM (
              SELECT list_extract(w, -1) AS token FROM (
                SELECT list_filter(string_split_regex(s, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w
                FROM (SELECT unnest(string_split(text, '.')) AS s FROM documents)
              ) WHERE len(w) > 0
            ) GROUP BY token
        """,
    }


