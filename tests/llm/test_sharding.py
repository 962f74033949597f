import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from screenflow.llm.sharding import Shard, place, shard_documents, standard_tree


def test_whole_tables(documents, no_documents):
    rows = shard_documents(documents).collect()
    text = lambda r: r["text"] or ""
    got = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    assert got == Counter((r["doc_id"], len(text(r).encode()) + 1, zlib.crc32(text(r).encode())) for r in documents.collect())
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_documents(no_documents).count() == 0


@pytest.mark.parametrize("shards", [8, 9, 12])
def test_one_more_shard_takes_rows_only_into_itself(spark, shards):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    rows = keys.select(place(F.col("k"), standard_tree(shards)).alias("a"), place(F.col("k"), standard_tree(shards + 1)).alias("b")).collect()
    assert {r["b"] for r in rows if r["a"] != r["b"]} == {shards}
    sizes = Counter(r["a"] for r in rows)
    assert set(sizes) == set(range(shards)) and max(sizes.values()) < 1.35 * 4000 / shards


def test_weights_and_confined_movement(spark):
    keys = spark.range(6000).select(F.col("id").cast("string").alias("k"))
    tree = [Shard(0, 0, 0, 3.0), Shard(0, 0, 1), Shard(1, 1, 2), Shard(1, 1, 3), Shard(1, 2, 4, 2.0), Shard(1, 2, 5, 0.0)]
    more = [s if s.shard != 3 else Shard(1, 1, 3, 2.0) for s in tree]
    rows = keys.select(place(F.col("k"), tree).alias("a"), place(F.col("k"), more).alias("b")).collect()
    sizes = Counter(r["a"] for r in rows)
    assert 5 not in sizes and abs(sizes[0] / 6000 - 3 / 8) < 0.03 and abs(sizes[4] / 6000 - 2 / 8) < 0.03
    # Region 1 and rack 1 became heavier: nothing moves inside region 0, nothing out of region 1.
    moved = {(r["a"], r["b"]) for r in rows if r["a"] != r["b"]}
    assert moved and all(b in (2, 3, 4) for _, b in moved) and all(b in (2, 3) for a, b in moved if a in (2, 3, 4))


def test_repeats_beyond_one_run_get_all_slots(spark, monkeypatch):
    monkeypatch.setattr("screenflow.llm.sharding.RUN", 7)
    same = spark.range(50).select(F.lit(5).alias("doc_id"), F.lit("copy").alias("text"))
    assert sorted(r["slot"] for r in shard_documents(same).collect()) == list(range(50))


def test_bad_trees():
    with pytest.raises(ValueError):
        place(F.lit("k"), [Shard(0, 0, 0), Shard(0, 1, 0)])


def test_rows_without_an_id_fall_into_many_buckets(spark):
    texts = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    rows = shard_documents(texts, buckets=16).collect()
    assert len({r["shard"] for r in rows}) == 1 and sorted(r["slot"] for r in rows) == list(range(400))
    # Slots go bucket by bucket, so rows next to each other in size and checksum are far apart.
    order = [r["text_crc32"] for r in sorted(rows, key=lambda r: (r["size"], r["text_crc32"]))]
    by_slot = [r["text_crc32"] for r in sorted(rows, key=lambda r: r["slot"])]
    assert by_slot != order
