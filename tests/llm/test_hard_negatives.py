import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenflow.llm.hard_negatives import Rules, hard_negatives, mined, scores

FOLDER = "/root/testdata/sf0.001"


def plain(rows, every=50, rules=Rules()):
    """Rows (vec_id, vector, label) against all others, sorted whole."""
    used = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        used.append((vec_id, label, [math.floor(256 * float(x)) for x in vector]))
    out = []
    for i, (anchor, label, v) in enumerate(used):
        if anchor is None or anchor % every:
            continue
        others = [
            (-sum(x * y for x, y in zip(v, w)), b is None, b or 0, b, other)
            for j, (b, other, w) in enumerate(used)
            if j != i and len(w) == len(v)
        ]
        others.sort(key=lambda o: o[:3])
        for p in [o for o in others if o[4] == label][: rules.positives]:
            inside = [o for o in others if o[4] != label and rules.low * -p[0] <= 100 * -o[0] <= rules.high * -p[0]]
            for rank, o in enumerate(inside[: rules.negatives], 1):
                out.append((anchor, p[3], rank, o[3], -p[0], -o[0]))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table_like_brute_force(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    wanted = plain([(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()])
    assert got(hard_negatives(table)) == wanted and len(wanted) > 20


ROWS = "vec_id long, embedding array<float>, label int"


def odd_rows():
    draw = random.Random(5)
    rows = [(i, [draw.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(3)], i % 3) for i in range(120)]  # many ties
    rows += [(50, [1.0, 0.25, 0.0], 2), (50, [1.0, 0.25, 0.0], 2), (50, [0.0, 0.0, 0.0], 0)]  # repeated ids
    rows += [(None, [1.0, 1.0, 0.25], 2), (None, [0.5, 0.25, 0.25], 1), (100, None, 1), (0, [1.0, None, 0.0], 1)]
    rows += [(150, [1.0, float("nan"), 0.0], 1), (200, [float("inf"), 0.0, 0.0], 1), (250, [1.0, 1.0, 1.0], None)]
    rows += [(300, [1.0, 1.0], 1), (301, [0.5, 0.5], 1), (302, [0.5, 0.25], 0), (350, [], 1), (351, [], 2), (352, [], 2)]
    return rows


@pytest.mark.parametrize("anchors_per_block", [1, 4, 2048])
def test_odd_rows_like_brute_force(spark, anchors_per_block):
    rows = odd_rows()
    table = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("own") for c in ("uid", "anchor", "score", "kind")})
    found = got(hard_negatives(table.repartition(5), every=10, anchors_per_block=anchors_per_block))
    assert found == plain(rows, every=10) and len(found) > 100


def test_a_third_of_the_rows_are_one_vector(spark):
    rows = [(i, [1.0, 0.5], 1) for i in range(400)] + [(i, [1.0, 0.1 * (i % 9)], i % 4) for i in range(400, 1200)]
    assert got(hard_negatives(spark.createDataFrame(rows, ROWS))) == plain(rows)


def test_empty_tables(spark):
    assert hard_negatives(spark.createDataFrame([], ROWS)).count() == 0
    assert hard_negatives(spark.createDataFrame([(1, [1.0], 1)], ROWS)).count() == 0
    assert hard_negatives(spark.createDataFrame([(50, [1.0], 1)], ROWS)).count() == 0


def test_scores_are_exact():
    draw = np.random.default_rng(1)
    for size in (2**10, 2**27, 2**32):
        a, b = (np.floor(draw.uniform(-size, size, (4, 3))) for _ in range(2))
        wanted = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
        if max(abs(x) for row in wanted for x in row) < 2**63:
            assert scores(a, b).tolist() == wanted
    with pytest.raises(OverflowError):
        scores(np.full((1, 2), 2.0**40), np.full((1, 2), 2.0**40))


def test_windows_close_when_full():
    rows = [(1, 9, 100, 0, 5)] + [(1, 9, 90 - i, 1, i) for i in range(50)] + [(2, 8, 0, 0, 4), (2, 8, 0, 1, 3)]
    assert [r[2:4] for r in mined(iter(rows), Rules())] == [(1, 0), (2, 1), (3, 2), (1, 3)]
