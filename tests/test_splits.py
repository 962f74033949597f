import random

import pytest
from pyspark.sql import functions as F

from screenflow.operators import splits
from screenflow.operators.quality import ExpectationError


def greedy(sizes, names):
    left = splits.split_targets(sum(sizes))
    placed = {}
    for name, size in sorted(zip(names, sizes), key=lambda x: (-x[1], x[0])):
        best = max(left, key=left.get)
        placed[name] = best
        left[best] -= size
    return placed


# Published group sizes of a clustered table: size -> number of groups.
PUBLISHED = {
    59: 1, 35: 1, 29: 1, 23: 1, 21: 1, 20: 2, 19: 1, 18: 2, 16: 2, 15: 1, 14: 1, 13: 2, 12: 2, 11: 2, 10: 3,
    9: 1, 8: 1, 7: 8, 6: 7, 5: 6, 4: 17, 3: 28, 2: 63, 1: 268,
}


def cases():
    rng = random.Random(4)
    yield [size for size, count in PUBLISHED.items() for _ in range(count)]
    for _ in range(6):
        yield [rng.choice([1, 1, 1, 2, 3, 5, 8, 40]) for _ in range(rng.randrange(1, 120))]
    yield [90, 5, 5]
    yield [1]


@pytest.mark.parametrize("sizes", list(cases()))
def test_split_equals_the_sequential_greedy(spark, sizes):
    names = [f"g{i:04d}" for i in range(len(sizes))]
    random.Random(1).shuffle(names)
    groups = spark.createDataFrame(list(zip(names, sizes)), "g string, n int")
    rows = groups.select("g", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    found = {r.g: r.split for r in splits.group_split(rows, "g").collect()}
    assert found == greedy(sizes, names)


def test_published_sizes(spark):
    """892, 111 and 113 rows, with 89 single-row groups each in validation and test."""
    sizes = [size for size, count in PUBLISHED.items() for _ in range(count)]
    groups = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "g int, n int")
    rows = groups.select("g", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    assignment = splits.group_split(rows, "g")
    totals = {r["split"]: r["n"] for r in assignment.groupBy("split").agg(F.sum("size").alias("n")).collect()}
    assert totals == {"train": 892, "validation": 111, "test": 113}
    placed = splits.assign_split(rows, "g", assignment, ["i"], rows_per_task=5)
    assert placed.count() == 1116
    splits.leakage_check(placed, "g")


def test_leaks_are_found(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "test"), ("", "train")], "g string, split string")
    with pytest.raises(ExpectationError, match="'a'"):
        splits.leakage_check(df, "g")
