"""All named queries over the given tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import edit_queries, html_queries, pdf_queries, rewrite_queries, stream_queries, text_queries
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "edit_queries", "flagship", "html_queries", "pdf_queries", "rewrite_queries", "stream_queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_queries.flagship_phrase_by_page(spark, sf_dir)
