"""Rules, ranges, scores and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenflow.functions.ordering import exact_quantiles, global_rank, running, with_average_rank
from screenflow.operators.quality import ExpectationError, long_form, top_n

# Rule-of-five limits, hard filter and score weights.
RULE_OF_FIVE = {"mw": 500.0, "logp": 5.0, "hbd": 5.0, "hba": 10.0}
MIN_SCORE = 0.5
MAX_VIOLATIONS = 1
WEIGHTS = (0.45, 0.35, 0.20)


def rule_violations(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """A flag per column above its limit, their number, and whether there are none. NULL is no violation."""
    flags = {f"{c}_violation": F.coalesce(F.col(c) > limit, F.lit(False)) for c, limit in limits.items()}
    count = sum((F.col(f).cast("int") for f in list(flags)[1:]), F.col(next(iter(flags))).cast("int"))
    return df.withColumns(flags).withColumn("violations", count).withColumn("compliant", F.col("violations") == 0)


def inside_range(df: DataFrame, development: DataFrame, columns: list[str]) -> DataFrame:
    """How many columns lie outside the range of the development rows, and whether none does."""
    bounds = development.agg(
        F.struct(
            *[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]
        ).alias("bounds")
    ).scalar()
    outside = F.lit(0)
    for c in columns:
        out = (F.col(c) < bounds[f"lo_{c}"]) | (F.col(c) > bounds[f"hi_{c}"])
        outside = outside + F.coalesce(out, F.lit(False)).cast("int")
    return df.withColumn("n_outside", outside).withColumn("inside", F.col("n_outside") == 0)


def power10(column: str) -> Column:
    return F.pow(F.lit(10.0), F.col(column))


def _is_candidate(score: str, violations: str, inside: str | None, min_score: float, max_violations: int) -> Column:
    keep = (F.col(score) >= min_score) & (F.col(violations) <= max_violations)
    return keep if inside is None else keep & F.col(inside)


def candidate_filter(
    df: DataFrame,
    score: str,
    violations: str,
    inside: str | None = "inside",
    min_score: float = MIN_SCORE,
    max_violations: int = MAX_VIOLATIONS,
) -> DataFrame:
    """Rows with enough score, few violations and (if named) inside the known range."""
    return df.where(_is_candidate(score, violations, inside, min_score, max_violations))


def retained(
    df: DataFrame,
    score: str,
    violations: str,
    inside: str | None = "inside",
    min_score: float = MIN_SCORE,
    max_violations: int = MAX_VIOLATIONS,
) -> DataFrame:
    """Rows before and after the filter, and the share kept."""
    keep = F.coalesce(_is_candidate(score, violations, inside, min_score, max_violations), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("n_input"),
        F.count_if(keep).alias("n_kept"),
        F.avg(keep.cast("int")).alias("fraction_kept"),
    )


def require_candidates(df: DataFrame) -> DataFrame:
    if not df.limit(1).count():
        raise ExpectationError("no row passed the filter")
    return df


def percent_rank_avg(df: DataFrame, column: str, out: str, salt_by: list[str]) -> DataFrame:
    """Average rank of equal values, divided by the number of values; NULL stays NULL."""
    total = df.agg(F.count(column).alias("n")).scalar()
    ranked = with_average_rank(df, column, "_rank", salt_by)
    return ranked.withColumn(out, F.col("_rank") / total).drop("_rank")


def clipped_score(violations: Column, worst: float = 4.0) -> Column:
    """1 for no violation down to 0 for `worst` or more."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - violations / F.lit(worst)))


def weighted_score(weights: dict[str, float]) -> Column:
    parts = [F.lit(w) * F.col(c) for c, w in weights.items()]
    return sum(parts[1:], parts[0])


def _front(df: DataFrame, x: str, y: str, row_id: str) -> DataFrame:
    """Row ids of the front: rows whose y is above that of all rows before them by x, then y."""
    points = df.select(row_id, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(
        "x is not null and y is not null and not isnan(x) and not isnan(y)"
    )
    # A few good points rule most rows out in a plain filter, before anything is sorted.
    middle = points.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    scale = middle.select(F.struct("mx", "my", "sx", "sy")).scalar()
    balance = F.coalesce(F.try_divide(F.col("x") - scale["mx"], scale["sx"]), F.lit(0.0)) + F.coalesce(
        F.try_divide(F.col("y") - scale["my"], scale["sy"]), F.lit(0.0)
    )
    point = F.struct("x", "y")
    pivots = points.agg(
        F.max_by(point, F.struct("x", "y")), F.max_by(point, F.struct("y", "x")), F.max_by(point, balance)
    ).first()
    left = points
    for pivot in (p for p in pivots if p is not None):
        at_least = (F.col("x") <= pivot["x"]) & (F.col("y") <= pivot["y"])
        left = left.where(~(at_least & ((F.col("x") < pivot["x"]) | (F.col("y") < pivot["y"]))))
    # Copies of a point: only the first row can be on the front.
    left = left.groupBy("x", "y").agg(F.min(row_id).alias(row_id))
    scanned = running(left, [F.desc("x"), F.desc("y")], maxima={"best": "y"})
    return scanned.where(F.col("best").isNull() | (F.col("y") > F.col("best"))).select(row_id)


def pareto_front(df: DataFrame, x: str, y: str, row_id: str, flag: str = "pareto_front") -> DataFrame:
    """Mark rows that no other row beats in both x and y; of equal points only the first is marked.

    Rows without x or y are never marked.
    """
    front = _front(df, x, y, row_id).withColumn(flag, F.lit(True))
    return df.join(front, row_id, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def overall_rank(df: DataFrame, front: str, score: str, row_id: str, out: str = "overall_rank") -> DataFrame:
    """1, 2, 3 ...: front rows first, then by score."""
    return global_rank(df, [F.desc(front), F.desc_nulls_last(score), F.asc(row_id)], out)


def rank_by(df: DataFrame, columns: list[str], row_id: str, n: int = 100) -> DataFrame:
    """The n best rows by several columns, largest first."""
    return top_n(df, [*columns, row_id], n, [False] * len(columns) + [True])


def screening_summary(
    df: DataFrame, score: str, prediction: str, compliant: str, inside: str, candidate: str
) -> DataFrame:
    """One row: size, mean and median of score and prediction, and the shares of the three flags."""
    medians = exact_quantiles(
        long_form(df, [score, prediction]), "value", {"median": 0.5}, within=("variable",)
    )
    median = medians.agg(
        F.struct(
            F.max(F.when(F.col("variable") == score, F.col("median"))).alias("score"),
            F.max(F.when(F.col("variable") == prediction, F.col("median"))).alias("prediction"),
        )
    ).scalar()

    def share(flag: str) -> Column:
        return F.avg(F.coalesce(F.col(flag), F.lit(False)).cast("int"))

    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(score).alias("mean_score"),
        F.avg(prediction).alias("mean_prediction"),
        share(compliant).alias("compliant_fraction"),
        share(inside).alias("inside_fraction"),
        F.count_if(F.col(candidate)).alias("candidate_count"),
        share(candidate).alias("candidate_fraction"),
    ).withColumns({"median_score": median["score"], "median_prediction": median["prediction"]})


def ranking_summary(
    n_input: int, ranked: DataFrame, front: str, n_diverse: int, parameters: dict[str, float]
) -> DataFrame:
    """One row: rows put in, ranked, on the front and picked, and the parameters used."""
    return ranked.agg(F.count(F.lit(1)).alias("n_after_filter"), F.count_if(F.col(front)).alias("n_pareto")).select(
        F.lit(n_input).cast("long").alias("n_input"),
        "n_after_filter",
        "n_pareto",
        F.lit(n_diverse).cast("long").alias("n_diverse_selected"),
        *[F.lit(v).alias(k) for k, v in parameters.items()],
    )
