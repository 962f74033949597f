"""Duplicate keys: finding, merging, setting aside; and set measures between two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenflow.functions.skew import ROWS_PER_TASK, salted_join

COUNT = "_n_rows"


def equality_key(df: DataFrame, column: str) -> Column:
    """What to group on where only equality counts: a digest for texts, so that long texts stay put."""
    if dict(df.dtypes)[column] == "string":
        return F.unhex(F.sha2(F.col(column), 256))
    return F.col(column)


def duplicate_rows(df: DataFrame, key: str, row_id: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """All rows whose (non-NULL) key occurs more than once, with `n_copies`."""
    keyed = df.withColumn("_key", equality_key(df, key))
    repeated = (
        keyed.where(F.col(key).isNotNull())
        .groupBy("_key")
        .agg(F.count(F.lit(1)).alias("n_copies"))
        .where("n_copies > 1")
    )
    return salted_join(keyed, repeated, ["_key"], "n_copies", [row_id], rows_per_task=rows_per_task).drop("_key")


def duplicate_summary(df: DataFrame, key: str) -> DataFrame:
    """Number of rows in duplicated keys, and of such keys."""
    counts = (
        df.where(F.col(key).isNotNull())
        .groupBy(equality_key(df, key).alias("_key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))


def _stats(df: DataFrame, keys: list[str], label: str, *more: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        *more,
        F.count(F.lit(1)).alias(COUNT),
        F.count(label).alias("n_labels"),
        F.avg(label).alias("label_mean"),
        F.stddev_samp(label).alias("label_std"),
        F.min(label).alias("label_min"),
        F.max(label).alias("label_max"),
    )


def duplicate_label_summary(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Per key with several rows: spread of its labels, widest first."""
    stats = _stats(df, keys, label).where(F.col(COUNT) > 1)
    return stats.select(
        *keys,
        F.col("n_labels").alias("count"),
        F.col("label_mean").alias("mean"),
        F.col("label_std").alias("std"),
        F.col("label_min").alias("minimum"),
        F.col("label_max").alias("maximum"),
        (F.col("label_max") - F.col("label_min")).alias("range"),
    ).orderBy(F.desc("range"), *keys)


def _decided(df: DataFrame, keys: list[str], label: str, max_range: float, *more: Column) -> DataFrame:
    """One row per key with its label range and what is done with it."""
    spread = F.col("label_max") - F.col("label_min")
    agrees = F.coalesce(spread <= max_range, F.lit(False))
    action = (
        F.when(F.col(COUNT) == 1, "keep_unique")
        .when(agrees, "aggregate_duplicates")
        .otherwise("exclude_conflicting_duplicate")
    )
    return _stats(df.dropna(subset=keys), keys, label, *more).withColumns(
        {"label_range": F.when(F.col(COUNT) == 1, F.lit(0.0)).otherwise(spread), "action": action}
    )


def curate_duplicates(
    df: DataFrame, keys: list[str], label: str, id: str, text: str, row_id: str, max_range: float = 0.30
) -> DataFrame:
    """One row per key whose labels agree: the row itself, or the mean of its copies.

    A key is kept when its labels differ by at most `max_range`; ids are joined in row order, and
    each text once, where it was first seen. Keys with other rows are left out (`conflict_rows`
    has them). The result's definition puts all ids of a key into one cell; where a key's list is
    too long for that, `curation_log` with `merged_members` has the same as rows.
    """
    member = F.struct(F.col(row_id), F.col(id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    decided = _decided(df, keys, label, max_range, F.array_sort(F.collect_list(member)).alias("_members"))
    return decided.where("action != 'exclude_conflicting_duplicate'").select(
        *keys,
        F.array_join(F.col("_members.id"), "|").alias("ids"),
        F.array_join(F.array_distinct("_members.text"), "|").alias("texts"),
        F.col("label_mean").alias(label),
        F.col(COUNT).alias("replicate_n"),
        F.when(F.col(COUNT) > 1, F.col("label_std")).alias("replicate_std"),
        F.col("label_range").alias("replicate_range"),
        F.when(F.col(COUNT) == 1, "unique_keep").otherwise("duplicate_aggregated").alias("curation_action"),
        F.col("_members")[0][row_id].alias("first_row"),
    )


def merged_members(
    df: DataFrame,
    keys: list[str],
    label: str,
    row_id: str,
    max_range: float = 0.30,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The source rows behind every merged key, one row each."""
    merged = _decided(df, keys, label, max_range).where("action = 'aggregate_duplicates'").select(*keys, COUNT)
    return salted_join(df, merged, keys, COUNT, [row_id], rows_per_task=rows_per_task).drop(COUNT)


def curation_log(df: DataFrame, keys: list[str], label: str, max_range: float = 0.30) -> DataFrame:
    return _decided(df, keys, label, max_range).select(
        *keys, F.col(COUNT).alias("n_source_records"), "label_min", "label_max", "label_range", "action"
    )


def conflict_rows(
    df: DataFrame,
    keys: list[str],
    label: str,
    row_id: str,
    max_range: float = 0.30,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The source rows of keys whose labels disagree, with the key's smallest and largest label."""
    conflicting = (
        _decided(df, keys, label, max_range)
        .where("action = 'exclude_conflicting_duplicate'")
        .select(
            *keys,
            COUNT,
            F.col("label_min").alias("group_label_min"),
            F.col("label_max").alias("group_label_max"),
            F.col("label_range").alias("group_label_range"),
        )
    )
    return salted_join(df, conflicting, keys, COUNT, [row_id], rows_per_task=rows_per_task).drop(COUNT)


def curation_summary(df: DataFrame, keys: list[str], label: str, max_range: float = 0.30) -> DataFrame:
    decided = _decided(df, keys, label, max_range)
    return decided.agg(
        F.coalesce(F.sum(COUNT), F.lit(0)).alias("n_source_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("action") == "keep_unique").alias("n_unique"),
        F.count_if(F.col("action") == "aggregate_duplicates").alias("n_merged"),
        F.count_if(F.col("action") == "exclude_conflicting_duplicate").alias("n_conflicting"),
        F.coalesce(
            F.sum(F.when(F.col("action") == "exclude_conflicting_duplicate", F.col(COUNT))), F.lit(0)
        ).alias("n_conflicting_rows"),
    )


def dedup_first(df: DataFrame, key: str, row_id: str) -> DataFrame:
    """The first row of every key, in row order. Only digests and row ids are grouped."""
    firsts = df.groupBy(equality_key(df, key).alias("_key")).agg(F.min(row_id).alias(row_id))
    return df.join(firsts.select(row_id), row_id, "left_semi")


def dedup_summary(df: DataFrame, key: str) -> DataFrame:
    per_key = df.groupBy(equality_key(df, key).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_kept"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_removed"),
    )


def length_filter(df: DataFrame, text: str, lo: int = 5, hi: int = 120, length: str = "length") -> DataFrame:
    """Add the length in characters and keep lo <= length <= hi."""
    return df.withColumn(length, F.length(text)).where(F.col(length).between(lo, hi))


def prep_funnel(df: DataFrame, text: str, valid: Column, lo: int = 5, hi: int = 120) -> DataFrame:
    """One row: how many rows each cleaning stage takes out, and the lengths of what is left.

    Stages: missing text, invalid text, copies, length. Copies share their length, so one group
    per text tells everything.
    """
    present = df.where(F.col(text).isNotNull())
    per_text = (
        present.select(
            equality_key(df, text).alias("_key"), F.coalesce(valid, F.lit(False)).alias("_ok"), F.length(text).alias("_len")
        )
        .groupBy("_key", "_ok", "_len")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ok, fits = F.col("_ok"), F.col("_ok") & F.col("_len").between(lo, hi)
    zero = F.lit(0)
    return per_text.agg(
        F.coalesce(F.sum("n"), zero).alias("raw_rows"),
        F.coalesce(F.sum(F.when(~ok, F.col("n"))), zero).alias("invalid"),
        F.coalesce(F.sum(F.when(ok, F.col("n") - 1)), zero).alias("duplicates_removed"),
        F.count_if(ok & ~F.col("_len").between(lo, hi)).alias("length_filtered"),
        F.count_if(fits).alias("final_rows"),
        F.min(F.when(fits, F.col("_len"))).alias("minimum_length"),
        F.max(F.when(fits, F.col("_len"))).alias("maximum_length"),
        F.avg(F.when(fits, F.col("_len"))).alias("mean_length"),
    )


def _key_presence(made: DataFrame, known: DataFrame, key: str, valid: Column, row_id: str | None = None) -> DataFrame:
    """Per key: rows made, valid rows made, first row made, and whether the key is known."""
    none = F.lit(None).cast("long")
    ours = made.select(
        equality_key(made, key).alias("_key"),
        F.lit(1).alias("_made"),
        (F.coalesce(valid, F.lit(False)) & F.col(key).isNotNull()).cast("int").alias("_valid"),
        (F.col(row_id).cast("long") if row_id else none).alias("_row"),
        F.lit(0).alias("_known"),
    )
    theirs = known.select(
        equality_key(known, key).alias("_key"),
        F.lit(0).alias("_made"),
        F.lit(0).alias("_valid"),
        none.alias("_row"),
        F.lit(1).alias("_known"),
    )
    return (
        ours.unionByName(theirs)
        .groupBy("_key")
        .agg(
            F.sum("_made").alias("_made"),
            F.sum("_valid").alias("_valid"),
            F.min(F.when(F.col("_valid") == 1, F.col("_row"))).alias("_row"),
            F.max("_known").alias("_known"),
        )
    )


def set_metrics(made: DataFrame, known: DataFrame, key: str, valid: Column) -> DataFrame:
    """Validity, uniqueness and novelty of `made` against `known`, with 0.0 for an empty denominator."""
    counts = _key_presence(made, known, key, valid).agg(
        F.coalesce(F.sum("_made"), F.lit(0)).alias("n_generated"),
        F.coalesce(F.sum("_valid"), F.lit(0)).alias("n_valid"),
        F.count_if(F.col("_valid") > 0).alias("n_unique_valid"),
        F.count_if((F.col("_valid") > 0) & (F.col("_known") == 0)).alias("n_novel"),
    )

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))

    return counts.select(
        "n_generated",
        "n_valid",
        share("n_valid", "n_generated").alias("validity"),
        "n_unique_valid",
        share("n_unique_valid", "n_valid").alias("uniqueness"),
        "n_novel",
        share("n_novel", "n_unique_valid").alias("novelty"),
    )


def mark_novel(
    made: DataFrame,
    known: DataFrame,
    key: str,
    row_id: str,
    flag: str = "novel",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add whether the row's key is not among the known ones (a NULL key is not known)."""
    presence = _key_presence(made, known, key, F.lit(True)).where("_made > 0").select("_key", "_made", "_known")
    keyed = made.withColumn("_key", equality_key(made, key))
    joined = salted_join(keyed, presence, ["_key"], "_made", [row_id], how="left", rows_per_task=rows_per_task)
    return joined.withColumn(flag, F.coalesce(F.col("_known"), F.lit(0)) == 0).drop("_key", "_made", "_known")


def novel_rows(made: DataFrame, known: DataFrame, key: str, row_id: str, valid: Column | None = None) -> DataFrame:
    """Rows whose key is not known, the first one of each key."""
    valid = F.lit(True) if valid is None else valid
    firsts = _key_presence(made, known, key, valid, row_id).where("_known = 0 and _row is not null")
    return made.join(firsts.select(F.col("_row").alias(row_id)), row_id, "left_semi")


def membership_filter(
    df: DataFrame, members: DataFrame, on: list[str], salt_by: list[str] | None = None, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Rows whose key is in `members`; a NULL key is in none.

    With `salt_by` (columns that tell rows of one key apart) keys with very many rows are split.
    """
    wanted = members.select(*on).dropna().distinct()
    if not salt_by:
        return df.join(wanted, on, "left_semi")
    counted = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).join(wanted, on, "left_semi")
    return salted_join(df, counted, on, "_rows", salt_by, "left_semi", rows_per_task)


def in_splits(df: DataFrame, splits: list[str], split: str = "split") -> DataFrame:
    return df.where(F.col(split).isin(splits))
