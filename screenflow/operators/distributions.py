"""Comparing the distributions of two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenflow.functions.ordering import exact_quantiles, running
from screenflow.functions.stats import ks_p_value
from screenflow.operators.quality import long_form
from screenflow.operators.sampling import tagged_union


def _stacked(a: DataFrame, b: DataFrame, properties: list[str], names: tuple[str, str]) -> DataFrame:
    both = tagged_union({names[0]: a.select(*properties), names[1]: b.select(*properties)})
    return long_form(both, properties, ["source"], "property").where("value is not null")


def property_summary(
    a: DataFrame, b: DataFrame, properties: list[str], names: tuple[str, str] = ("reference", "generated")
) -> DataFrame:
    """Per property and table: n, mean, std, median, min and max of the non-NULL values."""
    rows = _stacked(a, b, properties, names)
    moments = rows.groupBy("property", "source").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    medians = exact_quantiles(rows, "value", {"median": 0.5}, within=("property", "source"))
    return moments.join(medians, ["property", "source"]).select(
        "property", "source", "n", "mean", "std", "median", "min", "max"
    )


def ks_two_sample(a: DataFrame, b: DataFrame, properties: list[str], p_value: bool = True) -> DataFrame:
    """Largest distance between the two empirical distribution functions, per property.

    Also the two means and their difference (b - a), and the two-sided p-value.
    """
    rows = _stacked(a, b, properties, ("a", "b"))
    counts = rows.groupBy("property", "value").agg(
        F.count_if(F.col("source") == "a").alias("n_a"), F.count_if(F.col("source") == "b").alias("n_b")
    )
    placed = running(counts, ["value"], sums={"before_a": "n_a", "before_b": "n_b"}, within=("property",))
    totals = rows.groupBy("property").agg(
        F.count_if(F.col("source") == "a").alias("total_a"),
        F.count_if(F.col("source") == "b").alias("total_b"),
        F.avg(F.when(F.col("source") == "a", F.col("value"))).alias("mean_a"),
        F.avg(F.when(F.col("source") == "b", F.col("value"))).alias("mean_b"),
    )
    here = placed.join(F.broadcast(totals), "property")  # one row per property
    distance = F.abs(
        F.try_divide(F.col("before_a") + F.col("n_a"), F.col("total_a"))
        - F.try_divide(F.col("before_b") + F.col("n_b"), F.col("total_b"))
    )
    result = here.groupBy("property", "total_a", "total_b", "mean_a", "mean_b").agg(
        F.max(distance).alias("ks_statistic")
    )
    columns = ["property", "ks_statistic", "mean_a", "mean_b"]
    if not p_value:
        return result.select(*columns, (F.col("mean_b") - F.col("mean_a")).alias("mean_difference"))
    rows_out = [
        (
            r["property"],
            r["ks_statistic"],
            ks_p_value(r["ks_statistic"], r["total_a"], r["total_b"]) if r["ks_statistic"] is not None else None,
            r["mean_a"],
            r["mean_b"],
            None if r["mean_a"] is None or r["mean_b"] is None else r["mean_b"] - r["mean_a"],
        )
        for r in result.collect()  # one row per property
    ]
    schema = "property string, ks_statistic double, p_value double, mean_a double, mean_b double, mean_difference double"
    return a.sparkSession.createDataFrame(rows_out, schema)
