"""Named queries with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Lines of documents at their virtual places, as SQL.
LINES = """lines AS (
  SELECT doc_id, i - 1 AS line_no, (i - 1) // 50 + 1 AS page_no, (i - 1) % 50 + 1 AS frag_idx, t AS text, 72.0::DOUBLE AS x, (792.0 - 14.0 * ((i - 1) % 50))::DOUBLE AS y
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
)"""
#: Documents with their numbers of lines and pages, as SQL.
SIZES = "d AS (SELECT *, len(string_split(coalesce(text, ''), chr(10))) AS n_lines, (len(string_split(coalesce(text, ''), chr(10))) + 49) // 50 AS n_pages FROM documents)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
