"""Shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenflow.functions.text import TOKEN_PATTERN

Case = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """Partitions for work that is heavy per row: the tables' text files have a single row group."""
    return 2 * spark.sparkContext.defaultParallelism


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def one_line(column: str = "text") -> Column:
    """The whole text with line breaks as blanks, so that tokens reproduce it."""
    return F.translate(F.col(column), "\n", " ")


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Whole texts for work that is heavy per row."""
    return table(spark, folder, "documents").select(*columns)


def lines(spark: SparkSession, folder: str, name: str = "documents", id: str = "doc_id") -> DataFrame:
    return table(spark, folder, name).select(id, one_line().alias("text"))


def lineitem_rows(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with a row number and a readable id."""
    return table(spark, folder, "lineitem").withColumns(
        {
            "row_id": F.col("l_orderkey") * 10 + F.col("l_linenumber"),
            "id": F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")),
        }
    )


LINEITEM_ROWS = """rows AS (
  SELECT *, l_orderkey * 10 + l_linenumber AS row_id,
         CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id FROM lineitem)"""

LINES = "lines AS (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents)"


def token_list(text: str = "text") -> str:
    return f"regexp_extract_all({text}, '{TOKEN_PATTERN}', 1)"
