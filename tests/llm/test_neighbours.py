import numpy as np
import pytest

from screenflow.llm.neighbours import Tables, _hamming, nearest

FOLDER = "/root/testdata/sf0.01"


def plain(rows, k=20, every=20):
    ids = sorted(rows)
    out = {}
    for q in ids:
        if q % every == 0:
            scored = sorted(((-sum(a * b for a, b in zip(rows[q], rows[i])), i) for i in ids if i != q))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def got(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(found) + 1
        found.append((r["vec_id"], r["score"]))
    return out


def test_tables_retrieve_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (400, 16), dtype=np.uint16)
    queries = codes[:20] ^ (rng.random((20, 16)) < 0.3).astype(np.uint16)
    for radius in (0, 3, 16, 40, 110, 256):
        assert (Tables(codes).within(queries, radius) == (_hamming(queries, codes) <= radius)).all()


def test_recall_and_order(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in table.collect()}
    wanted, found = plain(rows), got(nearest(table))
    assert set(found) == set(wanted) and all(len(f) == 20 for f in found.values())
    hit = sum(len({i for i, _ in wanted[q]} & {i for i, _ in found[q]}) for q in wanted)
    assert hit / (20 * len(wanted)) >= 0.9
    for q, f in found.items():
        assert f == sorted(f, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - sum(a * b for a, b in zip(rows[q], rows[i]))) < 1e-12 for i, s in f)


def plain_rows(rows, k=20, every=20):
    """As `plain`, for rows whose ids may repeat or be NULL: one list per query row."""
    out = []
    for i, (q, v) in enumerate(rows):
        if q is not None and q % every == 0:
            others = [(-sum(a * b for a, b in zip(v, w)), x is None, x or 0, x) for j, (x, w) in enumerate(rows) if j != i and len(w) == len(v)]
            out += [(q, rank, o[3], -o[0]) for rank, o in enumerate(sorted(others, key=lambda o: o[:3])[:k], 1)]
    return sorted(out, key=str)


def test_whole_tables(spark):
    nan, inf = float("nan"), float("inf")
    valid = [
        (0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [3.0, 0.0]), (2, [3.0, 0.0]), (3, [-1.0, 0.5]), (3, [-1.0, 0.5]), (3, [5.0, 0.0]),
        (None, [1.0, 1.0]), (None, [4.0, 0.0]), (9, [0.5, 0.5]), (40, [1.0, 0.0]), (40, [0.0, 1.0]), (40, [1.0, 2.0, 3.0]),
        (60, [1.0, 0.0, 0.0]), (61, [0.0, 1.0, 1.0]), (80, [1.0]),
    ]
    rows = valid + [(4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (40, None), (60, [])]
    table = spark.createDataFrame([(*r, "own", 1) for r in rows], "vec_id long, embedding array<double>, score string, uid int")
    columns = ("query_id", "rank", "vec_id", "score")
    for k in (2, 20):
        found = sorted((tuple(r[c] for c in columns) for r in nearest(table.repartition(3), k=k, covered=1.0).collect()), key=str)
        assert found == plain_rows(valid, k=k)
    assert nearest(table.limit(0)).count() == 0 and nearest(table.where("vec_id = 0")).count() == 0


def test_queries_with_few_hits_are_compared_with_all_rows(spark):
    rng = np.random.default_rng(2)
    rows = {i: rng.standard_normal(8).tolist() for i in range(60)}
    table = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    found, wanted = got(nearest(table, k=5, covered=0.0)), plain(rows, k=5)
    assert all(len(f) == 5 for f in found.values())
    narrow = [q for q in wanted if [i for i, _ in found[q]] == [i for i, _ in wanted[q]]]
    assert narrow


def test_queries_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(50)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    columns = ("query_id", "rank", "vec_id")
    monkeypatch.setattr("screenflow.llm.neighbours.QUERIES_PER_BLOCK", 4)
    found = sorted(tuple(r[c] for c in columns) for r in nearest(table, k=3, every=5, covered=1.0).collect())
    assert found == sorted(r[:3] for r in plain_rows(rows, 3, 5))
