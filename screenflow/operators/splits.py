"""Splits that keep groups whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenflow.functions.ordering import global_rank
from screenflow.functions.skew import ROWS_PER_TASK, salted_join
from screenflow.operators.quality import ExpectationError, top_n

SPLITS = ["train", "validation", "test"]


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))


def largest_groups(df: DataFrame, group: str, k: int = 15) -> DataFrame:
    """The k largest groups, equal sizes by name."""
    return top_n(group_sizes(df, group), ["size", group], k, ascending=[False, True])


def split_targets(total: int, train: float = 0.8, validation: float = 0.1) -> dict[str, int]:
    """Wanted rows per split; the last one gets what rounding leaves."""
    sizes = {"train": int(total * train), "validation": int(total * validation)}
    return {**sizes, "test": total - sum(sizes.values())}


def _segments(room: list[int], size: int, groups: int) -> tuple[list[tuple[int, list[int]]], list[int]]:
    """Where the next `groups` groups of one size go, when each goes where most room is left.

    A split's room falls by `size` per group, so once a split has come into play it is chosen again
    at every turn: with k splits in play the choice repeats with period k. Returns the segments
    (number of groups before, splits in turn) and the room left afterwards.
    """
    by_room = sorted(range(len(room)), key=lambda j: (-room[j], j))
    left, before, segments = list(room), 0, []
    for k in range(1, len(room) + 1):
        playing = by_room[:k]
        if k < len(room):
            entrant = by_room[k]
            # Offers of a playing split that come before the entrant's first one.
            turns = {}
            for j in playing:
                gap = left[j] - room[entrant]
                turns[j] = max(0, -(-gap // size)) + (1 if gap >= 0 and gap % size == 0 and j < entrant else 0)
            count = sum(turns.values())
        else:
            count = groups - before
        count = min(count, groups - before)
        if count <= 0:
            continue
        turn = sorted(playing, key=lambda j: (-left[j], j))
        segments.append((before, turn))
        whole, part = divmod(count, k)
        for place, j in enumerate(turn):
            left[j] -= size * (whole + (1 if place < part else 0))
        before += count
        if before == groups:
            break
    return segments, left


def group_split(
    df: DataFrame,
    group: str,
    tie: str | None = None,
    train: float = 0.8,
    validation: float = 0.1,
) -> DataFrame:
    """Assign whole groups to splits: (group, size, split).

    Groups go, largest first, to the split with the most room left (equal room: train, validation,
    test). Equal sizes go by `tie`, a column that is constant in a group (default: its name).
    The driver sees how many groups there are of each size, and works out for each size the turns
    in which its groups are dealt; groups find their split by size and rank on the executors.
    """
    extra = [] if tie is None else [F.min(tie).alias("_tie")]
    groups = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"), *extra)
    order = [F.desc("size"), F.asc(group)] if tie is None else [F.desc("size"), F.asc("_tie"), F.asc(group)]
    ranked = global_rank(groups, order, "_rank")
    # At most sqrt(2 * rows) different sizes.
    histogram = sorted(((r["size"], r["count"]) for r in ranked.groupBy("size").count().collect()), reverse=True)
    total = sum(size * count for size, count in histogram)
    left = list(split_targets(total, train, validation).values())
    plan, start = [], 0
    for size, count in histogram:
        segments, left = _segments(left, size, count)
        plan.append((size, start, [(before, [SPLITS[j] for j in turn]) for before, turn in segments]))
        start += count
    schema = "size long, _start long, _segments array<struct<before: long, turn: array<string>>>"
    turns = df.sparkSession.createDataFrame(plan, schema)
    place = F.col("_rank") - F.col("_start") - 1
    segment = F.element_at(F.filter("_segments", lambda s: s["before"] <= place), -1)
    found = F.get(segment["turn"], F.pmod(place - segment["before"], F.size(segment["turn"])).cast("int"))
    return ranked.join(turns, "size").withColumn("split", found).select(group, "size", "split")


def assign_split(
    df: DataFrame, group: str, assignment: DataFrame, salt_by: list[str], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Give every row the split of its group."""
    named = assignment.select(group, "split", F.col("size").alias("_size"))
    return salted_join(df, named, [group], "_size", salt_by, rows_per_task=rows_per_task).drop("_size")


def leaking_groups(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups with rows in more than one split."""
    per_group = df.groupBy(group).agg(F.min(split).alias("_a"), F.max(split).alias("_b"))
    return per_group.where(F.col("_a") != F.col("_b")).select(group)


def leakage_check(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Return `df`, or fail if a group is in more than one split."""
    found = leaking_groups(df, group, split).limit(10).collect()
    if found:
        raise ExpectationError(f"groups in several splits, such as {[r[0] for r in found]}")
    return df


def split_summary(df: DataFrame, split: str, group: str, label: str, order: list[str] = SPLITS) -> DataFrame:
    """Per split in the given order: rows, share, groups, and the label's mean, std and range."""
    moments = df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(label).alias("mean_label"),
        F.stddev_samp(label).alias("std_label"),
        F.min(label).alias("min_label"),
        F.max(label).alias("max_label"),
    )
    groups = df.select(split, group).distinct().groupBy(split).agg(F.count(group).alias("n_groups"))
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    place = F.array_position(F.lit(order), F.col(split))
    return (
        moments.join(groups, split)
        .withColumn("fraction", F.col("n") / total)
        .orderBy(place)
        .select(split, "n", "fraction", "n_groups", "mean_label", "std_label", "min_label", "max_label")
    )


def group_report(df: DataFrame, group: str, split: str, label: str) -> DataFrame:
    """Rows and mean label per (group, split), most rows first; rows without a group are kept."""
    return (
        df.groupBy(group, split)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("mean_label"))
        .orderBy(F.desc("n"), F.asc(group))
    )
