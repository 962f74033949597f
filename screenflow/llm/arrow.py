"""Whole-column work on Arrow batches that leaves all other columns as they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

ROWS_PER_BATCH = 500  # whole texts: Spark's default of 10,000 rows can be gigabytes
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> None:
    """Lower the session's rows per Arrow batch, where it is above what whole texts allow."""
    conf = df.sparkSession.conf
    now = int(conf.get(_BATCH_CONF))
    if now <= 0 or now > ROWS_PER_BATCH:
        conf.set(_BATCH_CONF, str(ROWS_PER_BATCH))


def unused(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def append_columns(
    df: DataFrame, column: str, fields: dict[str, T.DataType], work: Callable[[pa.Array], list[list]], drop: bool = False
) -> DataFrame:
    """Add `fields`, made by `work` from slices of `column`; a column of the same name is replaced.

    `work` gets an Arrow array and gives one list of values per field. The session's rows per Arrow
    batch are lowered to ROWS_PER_BATCH where they are more. With `drop` the source column
    is left out of the result.
    """
    new = {name.lower() for name in fields} | ({column.lower()} if drop else set())
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    schema = T.StructType(kept + [T.StructField(name, kind) for name, kind in fields.items()])
    names = [f.name for f in kept]
    kinds = [to_arrow_type(kind) for kind in fields.values()]
    source = next(f.name for f in df.schema.fields if f.name.lower() == column.lower())

    small_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = work(batch.column(source))
            arrays = [batch.column(name) for name in names]
            arrays += [pa.array(v, type=kind) for v, kind in zip(values, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=names + list(fields))

    return df.mapInArrow(run, schema)
