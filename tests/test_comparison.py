import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from screenflow.functions.stats import correlation_p_value, ks_p_value
from screenflow.operators import distributions, errors, screening
from screenflow.operators.quality import ExpectationError


# Published two-sample statistics for 20,000 against 8,789 values, and their p-values.
@pytest.mark.parametrize(
    "statistic,p",
    [
        (0.10376607122539538, 1.0703581272765135e-57),
        (0.05736571282284675, 6.592054875004169e-18),
        (0.031864813972010464, 8.047859080742036e-06),
        (0.041955569461827324, 8.908126841101898e-10),
        (0.04082717032654448, 2.791859219562236e-09),
        (0.05880337922403002, 8.541535132293309e-19),
    ],
)
def test_ks_p_value(statistic, p):
    assert ks_p_value(statistic, 20_000, 8_789) == pytest.approx(p, rel=1e-6)


def test_ks_p_value_at_the_ends():
    assert ks_p_value(0.0, 10, 10) == 1.0 and ks_p_value(1.0, 10, 10) == 0.0
    assert ks_p_value(1e-9, 10**7, 10**7) == pytest.approx(1.0)
    # The exact sum and the limiting form meet where one takes over from the other.
    assert ks_p_value(0.0015, 1_999_990, 1_999_990) == pytest.approx(ks_p_value(0.0015, 2_000_020, 2_000_020), rel=1e-3)


def test_correlation_p_value():
    assert correlation_p_value(0.0, 50) == pytest.approx(1.0)
    # Two degrees of freedom: p = 1 - |rho|.
    assert correlation_p_value(0.3, 4) == pytest.approx(0.7)
    assert correlation_p_value(-0.9, 4) == pytest.approx(0.1)
    assert correlation_p_value(0.632, 10) == pytest.approx(0.05, abs=1e-3)


def test_spearman_with_ties(spark):
    rng = random.Random(2)
    data = pd.DataFrame({"x": [rng.randrange(9) for _ in range(200)]})
    data["y"] = [x + rng.randrange(5) for x in data.x]
    row = errors.spearman(spark.createDataFrame(data), "x", "y").first()
    expected = data.x.rank().corr(data.y.rank())
    assert row["rho"] == pytest.approx(expected) and row["p_value"] < 1e-10


def test_ks_equals_a_walk_over_the_values(spark):
    rng = random.Random(3)
    a = [float(rng.randrange(30)) for _ in range(150)]
    b = [float(rng.randrange(40)) for _ in range(90)]
    found = distributions.ks_two_sample(
        spark.createDataFrame([(v,) for v in a], "v double"), spark.createDataFrame([(v,) for v in b], "v double"), ["v"]
    ).first()
    expected = max(abs(sum(x <= v for x in a) / 150 - sum(x <= v for x in b) / 90) for v in a + b)
    assert found["ks_statistic"] == pytest.approx(expected)


def test_bins_keep_empty_ones(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.29,), (1.0,), (1.01,)], "s double")
    rows = errors.bin_and_aggregate(df, "s", [0.0, 0.3, 0.4, 0.5, 1.01], ["a", "b", "c", "d"], [F.avg("s").alias("m")])
    assert [(r.bin, r.n) for r in rows.collect()] == [("a", 2), ("b", 1), ("c", 0), ("d", 1)]


def test_histogram_closes_the_last_bin(spark):
    rows = errors.histogram(spark.range(11).select(F.col("id").cast("double").alias("v")), "v", 5).orderBy("bin").collect()
    assert [r.n for r in rows] == [2, 2, 2, 2, 3] and rows[-1].bin_high == 10.0
    same = errors.histogram(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v", 3).orderBy("bin").collect()
    assert [r.n for r in same] == [2, 0, 0]


def test_front_is_the_set_of_unbeaten_points(spark):
    rng = random.Random(9)
    points = [(i, float(rng.randrange(30)), float(rng.randrange(30))) for i in range(300)]
    points += [(300, None, 1.0), (301, float("nan"), 50.0), (302, 31.0, 2.0), (303, 31.0, 2.0)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    found = {r.id for r in screening.pareto_front(df, "x", "y", "id").collect() if r.pareto_front}
    usable = [p for p in points if p[1] is not None and not math.isnan(p[1])]
    best = {}
    for i, x, y in usable:
        if not any((u >= x and v >= y) and (u > x or v > y) for _, u, v in usable):
            best.setdefault((x, y), i)
    assert found == set(best.values())


def test_rules_and_ranges(spark):
    df = spark.createDataFrame([(1, 500.0, 6.0), (2, 501.0, None), (3, 1.0, 5.0)], "id int, mw double, logp double")
    rows = screening.rule_violations(df, {"mw": 500.0, "logp": 5.0}).orderBy("id").collect()
    assert [(r.violations, r.compliant) for r in rows] == [(1, False), (1, False), (0, True)]
    ranged = screening.inside_range(df, df.where("id = 3"), ["mw", "logp"]).orderBy("id").collect()
    assert [r.n_outside for r in ranged] == [2, 1, 0]
    with pytest.raises(ExpectationError):
        screening.require_candidates(df.where("false"))


def test_percent_rank_and_scores(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 2.0, 5.0, None])], "id int, v double")
    rows = screening.percent_rank_avg(df, "v", "p", ["id"]).orderBy("id").collect()
    assert [r.p for r in rows] == [0.25, 0.625, 0.625, 1.0, None]
    scores = [spark.range(1).select(screening.clipped_score(F.lit(v)).alias("s")).first().s for v in (0, 1, 4, 9)]
    assert scores == [1.0, 0.75, 0.0, 0.0]


def test_p_values_of_large_tables_are_plain_numbers(spark):
    # From some 40,000 rows on the tail is integrated, and Spark takes no NumPy numbers.
    assert type(ks_p_value(0.0015, 1_999_990, 1_999_990)) is float
    a, b = (spark.range(100_000).select((F.col("id") * k).alias("v")) for k in (1.0, 1.004))
    assert 0 < distributions.ks_two_sample(a, b, ["v"]).first()["p_value"] <= 1
