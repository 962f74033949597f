"""Tables in and out: Parquet between steps, CSV and JSON as exchange formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenflow.functions.ordering import global_rank
from screenflow.operators.quality import nan_to_null


_CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
_NO_TEXT = "\x00"  # stands for NULL while reading, so that a quoted empty text is not taken for it


def read_table(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    fmt: str = "csv",
    row_id: str | None = "row_id",
    line_breaks: bool = False,
) -> DataFrame:
    """Read a table, NaN as NULL, with a `row_id` that numbers the rows from 0: files by path, rows by place.

    Numbering sorts the rows by file and place and writes them once; without `row_id` the table is
    only scanned.

    CSV has a header and keeps blanks at the ends of a text; an empty field is NULL, and an empty
    text stands in quotes. `line_breaks` allows them inside a quoted text, at the price that one
    task reads a whole file.
    JSON holds one value per line, or with `line_breaks` one value (or array) per file.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV table needs a schema")
        reader = reader.options(**_CSV, multiLine=line_breaks, nullValue=_NO_TEXT, emptyValue="")
    elif fmt == "json":
        reader = reader.option("multiLine", line_breaks)
    df = nan_to_null(reader.format(fmt).load(path))
    if row_id is None:
        return df
    # A split of a file is read by one task from front to back, so the running id is in its order.
    place = {
        "_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_running": F.monotonically_increasing_id()
    }
    ranked = global_rank(df.select("*", *[c.alias(n) for n, c in place.items()]), list(place), row_id)
    return ranked.withColumn(row_id, F.col(row_id) - 1).drop(*place)


def select_rename(df: DataFrame, names: dict[str, str], ignore_case: bool = False) -> DataFrame:
    """Keep the columns named by the keys of `names`, under new names.

    With `ignore_case` a key must match exactly one column up to case.
    """
    picked: list[Column] = []
    for old, new in names.items():
        found = [c for c in df.columns if c == old or (ignore_case and c.lower() == old.lower())]
        if len(found) != 1:
            raise ValueError(f"column {old!r} should match one column, found {found}")
        picked.append(df[f"`{found[0]}`"].alias(new))
    return df.select(*picked)


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None
) -> None:
    """Write a table; parent folders are made. An empty text survives in CSV."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.options(**_CSV, nullValue="", emptyValue='""')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_by_split(df: DataFrame, path: str, split: str = "split", fmt: str = "parquet") -> None:
    """One folder per split value, so that reading one split touches only its files."""
    write_table(df, path, fmt, partition_by=[split])


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """Vocabulary (token, id) as JSON lines."""
    write_table(vocabulary, path, "json")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token string, id int").json(path)
