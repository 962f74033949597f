"""Global order without a one-partition window.

Rows are range-partitioned on the order columns and sorted inside each partition. A row's place is
then its partition number and its position there; what lies in earlier partitions is added from a
table with one row per partition. One value that fills a third of the table is no problem as long
as the order ends in a unique column, since ranges may cut through it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenflow.functions.skew import salted_join
from screenflow.session import materialize

_POSITION_BITS = 33  # layout of monotonically_increasing_id: partition number above 33 position bits


def _placed(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """Rows in range partitions, written out, with `_part` and `_pos`.

    Range bounds are sampled, so the rows are written once instead of being placed again by every
    reader.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumn("_place", F.monotonically_increasing_id()))
    return placed.withColumns(
        {
            "_part": F.shiftright("_place", _POSITION_BITS),
            "_pos": F.col("_place").bitwiseAND((1 << _POSITION_BITS) - 1),
        }
    ).drop("_place")


def global_rank(df: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """Add 1, 2, 3 ... in the given order, which should end in a unique column."""
    placed = _placed(df, order)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    # One row per partition: bounded by the partition count, not by the data.
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_start")
    )


def running(
    df: DataFrame,
    order: list[str | Column],
    sums: dict[str, str] | None = None,
    maxima: dict[str, str] | None = None,
    within: tuple[str, ...] = (),
) -> DataFrame:
    """Add, per row, sums and maxima over all rows before it (inside its `within` group).

    `sums` and `maxima` map a new column to the column it runs over. `within` is for a handful of
    groups such as property names. Before the first row a sum is 0 and a maximum NULL.
    """
    sums, maxima = sums or {}, maxima or {}
    placed = _placed(df, [*within, *order])
    totals = placed.groupBy(*within, "_part").agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_t_{n}") for n, c in maxima.items()],
    )
    across = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *within,
        "_part",
        *[F.sum(f"_t_{n}").over(across).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(across).alias(f"_c_{n}") for n in maxima],
    )
    inside = Window.partitionBy(*within, "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    out = placed.withColumns(
        {
            **{n: F.sum(c).over(inside) for n, c in sums.items()},
            **{n: F.max(c).over(inside) for n, c in maxima.items()},
        }
    )
    # One row per (group, partition) that holds rows of the group: groups + partitions at most.
    out = out.join(F.broadcast(carried), [*within, "_part"])
    out = out.withColumns(
        {
            **{n: F.coalesce(F.col(n), zero) + F.coalesce(F.col(f"_c_{n}"), zero) for n in sums},
            **{n: F.greatest(F.col(n), F.col(f"_c_{n}")) for n in maxima},
        }
    )
    return out.drop("_part", "_pos", *[f"_c_{n}" for n in (*sums, *maxima)])


def exact_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], within: tuple[str, ...] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per `within` group.

    Equal values are counted together first; the running count tells which value sits at a wanted
    position. No task ever holds all values of a group.
    """
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*within, value).agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = running(counts, [value], sums={"_before": "_n"}, within=within)
    totals = placed.groupBy(*within).agg(F.sum("_n").alias("_total"))
    if within:
        placed = placed.join(F.broadcast(totals), list(within))
        total = F.col("_total")
    else:
        total = totals.scalar()

    def at(index: Column) -> Column:
        here = (F.col("_before") <= index) & (index < F.col("_before") + F.col("_n"))
        return F.max(F.when(here, F.col(value)))

    picks, results = [], []
    for name, p in probabilities.items():
        position = F.lit(p) * (total - 1)
        picks += [
            at(F.floor(position)).alias(f"_lo_{name}"),
            at(F.ceil(position)).alias(f"_hi_{name}"),
            F.max(position - F.floor(position)).alias(f"_w_{name}"),
        ]
        low, high, weight = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_w_{name}")
        results.append((low + (high - low) * weight).alias(name))
    return placed.groupBy(*within).agg(*picks).select(*within, *results)


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """One row per distinct non-NULL value: its average rank (from 1) and `_n`, how often it occurs."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running(counts, [value], sums={"_before": "_n"})
    return placed.select(value, "_n", (F.col("_before") + (F.col("_n") + 1) / 2).alias(name))


def with_average_rank(df: DataFrame, value: str, name: str, salt_by: list[str]) -> DataFrame:
    """Add the average rank of `value`; NULL values get NULL."""
    ranks = average_ranks(df, value, name)
    return salted_join(df, ranks, [value], "_n", salt_by, how="left").drop("_n")


def shuffle_key(ids: list[str], seed: int) -> Column:
    """A reproducible random order: md5 of the id and the seed."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))))


_PREFIX = 4  # hex digits per round: at most 65,536 counts come to the driver
_SHORT_LIST = 10_000


def cutoffs(df: DataFrame, key: str, tie: str, positions) -> tuple[int, list[tuple | None]]:
    """Find the (key, tie) pairs at given positions of the order by a hex-digest `key`, then `tie`.

    `positions` turns the row count into a list of 1-based positions. Instead of sorting the table,
    digest prefixes are counted, longer ones only inside the prefix that holds a wanted position,
    until few enough rows are left to look at. Returns the row count and one pair per position
    (None for position 0).
    """

    def prefix_counts(rows: DataFrame, width: int) -> list[tuple[str, int]]:
        found = rows.groupBy(F.substring(key, 1, width).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        return sorted((r["p"], r["n"]) for r in found.collect())

    first = prefix_counts(df, _PREFIX)
    total = sum(n for _, n in first)
    pairs: list[tuple | None] = []
    for position in positions(total):
        if position <= 0:
            pairs.append(None)
            continue
        if position > total:
            raise ValueError(f"position {position} asked for, but the table has {total} rows")
        counts, width, rest, rows = first, _PREFIX, position, df
        while True:
            for prefix, n in counts:
                if rest <= n:
                    break
                rest -= n
            rows = df.where(F.col(key).startswith(prefix))
            if n <= _SHORT_LIST or width >= 32:
                break
            width += _PREFIX
            counts = prefix_counts(rows, width)
        head = rows.select(key, tie).orderBy(key, tie).limit(rest)
        last = head.agg(F.max(F.struct(key, tie)).alias("pair")).first()["pair"]
        pairs.append((last[0], last[1]))
    return total, pairs


def up_to(key: str, tie: str, pair: tuple | None) -> Column:
    """Whether a row comes no later than `pair` in the order by (key, tie)."""
    if pair is None:
        return F.lit(False)
    return (F.col(key) < pair[0]) | ((F.col(key) == pair[0]) & (F.col(tie) <= F.lit(pair[1])))
