import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from screenflow.functions.ordering import exact_quantiles, global_rank, running, with_average_rank
from screenflow.functions.skew import salted_join
from screenflow.operators.sampling import sample_exact, split_exact


def skewed(n, seed=1):
    """A third of the rows share one value."""
    rng = random.Random(seed)
    return pd.DataFrame({"id": range(n), "v": [7.0 if rng.random() < 0.34 else float(rng.randrange(40)) for _ in range(n)]})


@pytest.mark.parametrize("n_partitions", [1, 4, 17])
def test_global_rank_equals_a_sort(spark, partitions, n_partitions):
    partitions(n_partitions)
    data = skewed(500)
    ranked = global_rank(spark.createDataFrame(data), [F.desc("v"), F.asc("id")]).toPandas().set_index("id")["rank"]
    expected = data.sort_values(["v", "id"], ascending=[False, True])["id"].tolist()
    assert ranked.sort_values().index.tolist() == expected
    assert sorted(ranked) == list(range(1, 501))


@pytest.mark.parametrize("n_partitions", [1, 4, 17])
def test_running_sums_and_maxima(spark, partitions, n_partitions):
    partitions(n_partitions)
    data = skewed(300).assign(g=lambda d: np.where(d.id % 3 == 0, "a", "b"))
    out = running(
        spark.createDataFrame(data), ["id"], sums={"s": "v"}, maxima={"m": "v"}, within=("g",)
    ).toPandas().sort_values("id")
    for _, part in out.groupby("g"):
        assert part["s"].tolist() == pytest.approx((part["v"].cumsum() - part["v"]).tolist())
        assert part["m"].tolist()[1:] == part["v"].cummax().tolist()[:-1]
        assert pd.isna(part["m"].tolist()[0])


@pytest.mark.parametrize("n_partitions", [1, 4, 17])
def test_quantiles_equal_numpy(spark, partitions, n_partitions):
    partitions(n_partitions)
    data = skewed(301)
    found = exact_quantiles(spark.createDataFrame(data), "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}).first()
    assert list(found) == pytest.approx(np.quantile(data.v, [0, 0.25, 0.5, 0.9, 1]).tolist())


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "v double")
    assert exact_quantiles(empty, "v", {"m": 0.5}).first()["m"] is None


def test_average_rank_equals_pandas(spark):
    data = skewed(400)
    data.loc[5, "v"] = None
    rows = spark.createDataFrame(data).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    found = with_average_rank(rows, "v", "r", ["id"]).toPandas().set_index("id")["r"].sort_index()
    expected = data["v"].rank(method="average")
    assert found.fillna(-1).tolist() == expected.fillna(-1).tolist()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_a_join(spark, how):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}") for i in range(600)], "id long, k string")
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k != 'k3'").withColumn("x", F.length("k"))
    salted = salted_join(rows, keyed, ["k"], "n", ["id"], how, rows_per_task=10)
    plain = rows.join(keyed, ["k"], how)
    assert sorted(map(str, salted.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_salted_join_splits_the_hot_key(spark):
    rows = spark.createDataFrame([(i, "hot") for i in range(200)], "id long, k string")
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    from screenflow.functions.skew import hot_keys

    assert hot_keys(keyed, ["k"], "n", rows_per_task=10).first()["_parts"] == 20


def hashed(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), i))


@pytest.mark.parametrize("n", [0, 1, 99, 1000])
def test_sample_is_exact_and_repeatable(spark, n):
    rows = spark.range(1000)
    found = sorted(r.id for r in sample_exact(rows, n, "id", seed=7).collect())
    assert found == sorted(hashed(range(1000), 7)[:n])


def test_sample_of_a_small_table(spark):
    with pytest.raises(ValueError):
        sample_exact(spark.range(5), 6, "id")
    assert sample_exact(spark.range(5), 6, "id", all_if_fewer=True).count() == 5


def test_cutoffs_look_at_longer_prefixes(spark, monkeypatch):
    from screenflow.functions import ordering

    monkeypatch.setattr(ordering, "_PREFIX", 1)
    monkeypatch.setattr(ordering, "_SHORT_LIST", 3)
    found = sorted(r.id for r in sample_exact(spark.range(1000), 321, "id", seed=7).collect())
    assert found == sorted(hashed(range(1000), 7)[:321])


def test_split_sizes(spark):
    parts = split_exact(spark.range(1003), "id", {"train": 0.9, "validation": 0.05}, "holdout")
    sizes = {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()}
    assert sizes == {"train": 902, "validation": 50, "holdout": 51}
