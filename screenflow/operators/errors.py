"""Comparing prediction errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenflow.functions.ordering import exact_quantiles, running
from screenflow.functions.skew import salted_join
from screenflow.functions.stats import correlation_p_value
from screenflow.operators.models import join_one_to_one
from screenflow.operators.quality import top_n
from screenflow.session import materialize


def compare_models(
    a: DataFrame, b: DataFrame, key: list[str], error_a: str, error_b: str, names: tuple[str, str], checked: bool = True
) -> DataFrame:
    """Both models' errors side by side: difference (b - a) and which one is smaller."""
    joined = join_one_to_one(a, b, key) if checked else a.join(b, key)
    ea, eb = F.col(error_a), F.col(error_b)
    better = F.when(eb < ea, names[1]).when(eb > ea, names[0]).otherwise("tie")
    return joined.withColumns({"absolute_error_difference": eb - ea, "better_model": better})


def difference_stats(comparison: DataFrame, difference: str = "absolute_error_difference") -> DataFrame:
    """How often each model wins, and mean and median difference."""
    comparison = materialize(comparison.select("better_model", difference))  # read three times
    median = exact_quantiles(comparison, difference, {"m": 0.5}).scalar()
    means = comparison.agg(F.avg(difference).alias("mean")).scalar()
    wins = comparison.groupBy("better_model").agg(F.count(F.lit(1)).alias("n"))
    return wins.withColumns({"mean_difference": means, "median_difference": median})


def spearman(df: DataFrame, x: str, y: str, p_value: bool = True) -> DataFrame:
    """Rank correlation with average ranks over rows that have both values, and its p-value.

    Equal (x, y) pairs are counted together before they are joined to their ranks.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    pairs = materialize(known.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))  # read for both ranks and the sums

    def ranks(column: str) -> DataFrame:
        repeated = pairs.groupBy(column).agg(F.sum("n").alias("w"), F.count(F.lit(1)).alias("_pairs"))
        return _weighted_ranks(repeated, column)

    ranked = salted_join(pairs, ranks("x"), ["x"], "_pairs", ["y"])
    ranked = salted_join(ranked.drop("_pairs"), ranks("y"), ["y"], "_pairs", ["x"]).drop("_pairs")
    # Ranks are at most n, so centring by (n + 1) / 2 keeps the sums small.
    total = pairs.agg(F.sum("n").alias("n")).scalar()
    cx, cy = F.col("rank_x") - (total + 1) / 2, F.col("rank_y") - (total + 1) / 2
    sums = ranked.select("n", cx.alias("cx"), cy.alias("cy")).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("cx") * F.col("cy")).alias("xy"),
        F.sum(F.col("n") * F.col("cx") * F.col("cx")).alias("xx"),
        F.sum(F.col("n") * F.col("cy") * F.col("cy")).alias("yy"),
    )
    result = sums.select("n", F.try_divide(F.col("xy"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy"))).alias("rho"))
    if not p_value:
        return result
    row = result.first()
    n, rho = row["n"] or 0, row["rho"]
    p = None if rho is None else correlation_p_value(rho, n)
    return df.sparkSession.createDataFrame([(n, rho, p)], "n long, rho double, p_value double")


def _weighted_ranks(values: DataFrame, column: str) -> DataFrame:
    placed = running(values, [column], sums={"_before": "w"})
    return placed.select(column, "_pairs", (F.col("_before") + (F.col("w") + 1) / 2).alias(f"rank_{column}"))


def bin_and_aggregate(
    df: DataFrame, x: str, edges: list[float], labels: list[str], aggregates: list[Column], bin: str = "bin"
) -> DataFrame:
    """Aggregates per bin [edge, next edge); empty bins stay, values outside all bins are left out."""
    number = F.lit(None).cast("int")
    for i in range(len(labels)):
        number = F.when((F.col(x) >= edges[i]) & (F.col(x) < edges[i + 1]), F.lit(i)).otherwise(number)
    every = df.sparkSession.createDataFrame(list(enumerate(labels)), f"_bin int, {bin} string")
    found = df.withColumn("_bin", number).groupBy("_bin").agg(F.count(F.lit(1)).alias("n"), *aggregates)
    return (
        every.join(found, "_bin", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .orderBy("_bin")
        .drop("_bin")
    )


def axis_limits(df: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest and largest value over two columns."""
    return df.agg(
        F.least(F.min(a), F.min(b)).alias("low"), F.greatest(F.max(a), F.max(b)).alias("high")
    )


def histogram(df: DataFrame, column: str, bins: int = 20, density: bool = False, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins from the smallest to the largest value (the last one closed), empty ones too.

    With `by`, all groups share the edges and each has its own counts (and density).
    """
    by = by or []
    known = df.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("_v"))
    low = known.agg(F.min("_v").alias("v")).scalar()
    high = known.agg(F.max("_v").alias("v")).scalar()
    width = F.try_divide(high - low, F.lit(float(bins)))
    place = F.least(F.coalesce(F.floor(F.try_divide(F.col("_v") - low, width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = known.withColumn("bin", place).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    every = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = every.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.withColumns({"bin_low": low + F.col("bin") * width, "bin_high": low + (F.col("bin") + 1) * width})
    if density:
        out = out.withColumn("density", F.try_divide(F.col("n"), F.col("_total") * width))
    return out.drop("_total")


def label_rows(df: DataFrame, by: list[str], ascending: list[bool], pattern: str, columns: list[str], n: int = 20) -> DataFrame:
    """The first n rows with a text made from their values, such as '%d: %.3f'."""
    return top_n(df, by, n, ascending).withColumn("label", F.format_string(pattern, *columns))
