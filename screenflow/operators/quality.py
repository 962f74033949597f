"""Profiling, coercion, row functions and checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from screenflow.functions.ordering import exact_quantiles
from screenflow.functions.text import formal_charge, fragment_count, heavy_atom_count, outside_brackets, ring_count


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating-point columns becomes NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats})


def long_form(df: DataFrame, columns: list[str], keep: list[str] | None = None, name: str = "variable") -> DataFrame:
    """One row per (row, column) with the column's value as DOUBLE."""
    keep = keep or []
    doubles = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot(keep, columns, name, "value")


def missing_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NULLs per column: (variable, missing)."""
    columns = columns or df.columns
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "variable", "missing")


def coerce_numeric(df: DataFrame, column: str) -> DataFrame:
    """The column as DOUBLE; text that is no number (or NaN) becomes NULL."""
    number = F.col(column).try_cast("double")
    return df.withColumn(column, F.when(~F.isnan(number), number))


def coercion_summary(df: DataFrame, column: str) -> DataFrame:
    """Rows, values that were missing, and values that are no numbers."""
    number = F.col(column).try_cast("double")
    bad = F.col(column).isNotNull() & (number.isNull() | F.isnan(number))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(column).isNull()).alias("n_missing"),
        F.count_if(bad).alias("n_not_numeric"),
    )


def enrich_rows(
    df: DataFrame, fn: Callable[[dict], dict | None], out_schema: T.StructType | str, valid: str = "valid"
) -> DataFrame:
    """Apply a user's row function and add its outputs and a `valid` flag.

    `fn` gets a row as a dict and returns the new columns, or None for a row it cannot handle. An
    exception counts as None, so one bad row never fails the job. Filter first: nothing is pushed
    down through a Python function.
    """
    added = T.StructType.fromDDL(out_schema) if isinstance(out_schema, str) else out_schema
    names = added.fieldNames()
    schema = T.StructType([*df.schema.fields, *added.fields, T.StructField(valid, T.BooleanType())])

    def attempt(row: dict) -> dict | None:
        try:
            return fn(row)
        except Exception:
            return None

    kinds = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [attempt(row) for row in batch.to_pylist()]
            new = [pa.array([r.get(n) if r else None for r in found], kind) for n, kind in zip(names, kinds)]
            flags = pa.array([r is not None for r in found], pa.bool_())
            # The input columns go through untouched.
            yield pa.RecordBatch.from_arrays([*batch.columns, *new, flags], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def validity_summary(df: DataFrame, flag: str) -> DataFrame:
    valid = F.coalesce(F.col(flag), F.lit(False))
    return df.agg(F.count_if(valid).alias("n_valid"), F.count_if(~valid).alias("n_invalid"))


def quarantine(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and the others (also where the test gives NULL)."""
    passed = F.coalesce(good, F.lit(False))
    return df.where(passed), df.where(~passed)


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return nan_to_null(df).dropna(subset=columns)


def value_counts(df: DataFrame, column: str, dropna: bool = True, order: str | None = "count") -> DataFrame:
    """How often each value occurs, by count (largest first), by value, or in no order."""
    counts = (df.where(F.col(column).isNotNull()) if dropna else df).groupBy(column).count()
    if order is None:
        return counts
    return counts.orderBy(F.desc("count"), F.asc(column)) if order == "count" else counts.orderBy(column)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, std, min, quartiles and max per column; quartiles are exact."""
    rows = long_form(df, columns)
    moments = rows.groupBy("variable").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(rows, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, within=("variable",))
    return moments.join(quartiles, "variable", "left").select(
        "variable", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with at most one distinct non-NULL value: smallest equals largest."""
    bounds = df.agg(
        *[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in columns],
    )
    flags = bounds.unpivot([], columns, "variable", "is_constant")
    return flags.where("is_constant").select("variable")


def top_n(df: DataFrame, by: list[str], n: int, ascending: bool | list[bool] = False) -> DataFrame:
    """The n first rows; end `by` in a unique column. NULLs come last in both directions."""
    directions = ascending if isinstance(ascending, list) else [ascending] * len(by)
    keys = [F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in zip(by, directions)]
    return df.orderBy(*keys).limit(n)


class ExpectationError(RuntimeError):
    """A table broke at least one rule."""


def expect(
    df: DataFrame,
    never: dict[str, Column] | None = None,
    unique: list[str] | None = None,
    rows: int | None = None,
    not_empty: bool = False,
    values: dict[str, set[str]] | None = None,
) -> DataFrame:
    """Return `df`, or fail when a rule does not hold.

    `never`: conditions no row may meet. `unique`: columns that form a key. `rows`: exact row
    count. `values`: columns whose set of distinct values must be the given one.
    """
    broken = []
    never = never or {}
    first = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(condition).alias(f"rule {name}") for name, condition in never.items()],
    ).first()
    broken += [f"{name}: {first[f'rule {name}']} rows" for name in never if first[f"rule {name}"]]
    if rows is not None and first["rows"] != rows:
        broken.append(f"{first['rows']} rows instead of {rows}")
    if not_empty and first["rows"] == 0:
        broken.append("no rows")
    if unique:
        repeated = df.groupBy(*unique).count().where("count > 1").limit(1).count()
        if repeated:
            broken.append(f"repeated key in {unique}")
    for column, wanted in (values or {}).items():
        seen = {r[0] for r in df.select(column).distinct().limit(len(wanted) + 1).collect()}
        if seen != wanted:
            broken.append(f"values of {column} include {sorted(map(str, seen))}, wanted {sorted(wanted)}")
    if broken:
        raise ExpectationError("; ".join(broken))
    return df


def text_structure(df: DataFrame, text: str) -> DataFrame:
    """Fragments, net charge, heavy atoms and rings read off a line-notation text."""
    whole, outside = F.col(text), F.col("_outside")
    return (
        df.withColumn("_outside", outside_brackets(whole))
        .withColumns(
            {
                "fragment_count": fragment_count(outside),
                "formal_charge": formal_charge(whole),
                "heavy_atom_count": heavy_atom_count(whole, outside),
                "ring_count": ring_count(outside),
            }
        )
        .withColumn("multi_fragment", F.col("fragment_count") > 1)
        .drop("_outside")
    )


def empty_group_stats(df: DataFrame, group: str) -> DataFrame:
    """Rows whose group name is empty: count and share."""
    empty = F.col(group) == ""
    return df.agg(
        F.count_if(empty).alias("n_empty"), F.avg(F.coalesce(empty, F.lit(False)).cast("int")).alias("fraction_empty")
    )
