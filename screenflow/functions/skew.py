"""Joins of many rows to one row per key that stay even when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt_out(df: DataFrame, parts: int | None) -> DataFrame:
    """Rows in `parts` partitions, for heavy work on few large files; None leaves them where they are read."""
    return df if parts is None else df.repartition(parts)


# A key is hot when it has more than ROWS_PER_TASK rows, whatever the size of the table. There is at
# most one hot key per ROWS_PER_TASK rows, so the table of hot keys is a millionth of the rows.
ROWS_PER_TASK = 1_000_000


def hot_keys(keyed: DataFrame, on: list[str], count: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The hot keys and into how many parts each is to be split."""
    parts = F.ceil(F.col(count) / rows_per_task).cast("int")
    return keyed.where(F.col(count) > rows_per_task).select(*on, parts.alias("_parts"))


def salted_join(
    rows: DataFrame,
    keyed: DataFrame,
    on: list[str],
    count: str,
    salt_by: list[str],
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join `rows` to `keyed` (unique on `on`; `count` = rows per key), splitting hot keys.

    The rows of a hot key are spread over several tasks by a hash of `salt_by`, and its one row of
    `keyed` is repeated once per part. All other keys take part in the same shuffle with salt 0.
    Rows with a NULL key match nothing, so their salt is the hash itself and they spread freely.
    `how` is inner, left, left_semi or left_anti.
    """
    hot = F.broadcast(hot_keys(keyed, on, count, rows_per_task))
    spreading = F.xxhash64(*salt_by)
    no_key = F.greatest(*[F.col(c).isNull() for c in on]) if len(on) > 1 else F.col(on[0]).isNull()
    salt = (
        F.when(no_key, F.pmod(spreading, F.lit(2**31 - 1)))
        .when(F.col("_parts").isNull(), F.lit(0))
        .otherwise(F.pmod(spreading, F.col("_parts")))
        .cast("int")
    )
    spread = rows.join(hot, on, "left").withColumn("_salt", salt).drop("_parts")
    repeated = keyed.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))
    ).drop("_parts")
    return spread.join(repeated, [*on, "_salt"], how).drop("_salt")
