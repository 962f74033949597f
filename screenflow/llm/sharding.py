"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard levels. At each level every child makes a draw, ln(u) / weight
with u from a hash of key and child, and the largest draw wins; a child is drawn in proportion to
its weight. A change of weights moves keys only between the children whose weights changed and the
rest of their level, and leaves all draws inside other subtrees alone. A further shard opens a region
of its own, so all that moves goes into it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenflow.session import materialize

BUCKETS = 1024  # parts into which each shard is cut to number its rows
RUN = 100_000  # repeats of one row numbered at a time
_HEX = 13  # hex digits of a draw: 52 bits


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def standard_tree(shards: int, base: int = 8) -> list[Shard]:
    """Equal weights: the first `base` shards in racks of 2 and regions of 2 racks, then one region each."""
    if shards < 1:
        raise ValueError("at least one shard")
    first = [Shard(i // 4, i // 2, i) for i in range(min(shards, base))]
    return first + [Shard(base + i, base + i, i) for i in range(base, shards)]


def _levels(tree: list[Shard]) -> list[list[tuple[str, str, float]]]:
    """Per level the nodes as (parent, node, weight); a node is named by its path, shards come last."""
    levels: list[dict[tuple[str, str], float]] = [{}, {}, {}]
    for s in tree:
        path = ["", f"{s.region}", f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.shard}"]
        for depth, (parent, node) in enumerate(zip(path, path[1:])):
            levels[depth][parent, node] = levels[depth].get((parent, node), 0.0) + s.weight
    return [[(*names, weight) for names, weight in level.items()] for level in levels]


def _draw(key: Column, node: Column, weight: Column) -> Column:
    """ln(u) / weight; u in (0, 1] comes from 52 bits of an md5 over key and node."""
    digest = F.md5(F.concat(key, F.lit(":"), node).cast("binary"))
    number = F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("double")
    return F.ln((number + 1) / float(16**_HEX)) / weight


def place(key: Column, tree: list[Shard]) -> Column:
    """The shard of a key (text). Shards without weight get nothing; of equal draws the last name wins."""
    live = [s for s in tree if s.weight > 0]
    if not live or len({s.shard for s in live}) < len(live) or not all(math.isfinite(s.weight) for s in live):
        raise ValueError("the tree needs distinct shards of finite positive weight")

    def child(parent: Column, level: list[tuple[str, str, float]]) -> Column:
        nodes = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(n).alias("n"), F.lit(w).alias("w")) for p, n, w in level])
        own = F.filter(nodes, lambda x: x["p"] == parent)
        drawn = F.transform(own, lambda x: F.struct(_draw(key, x["n"], x["w"]).alias("d"), x["n"].alias("n")))
        return F.array_max(drawn)["n"]

    def descend(parents: Column, level: list[tuple[str, str, float]]) -> Column:
        return F.transform(parents, lambda parent: child(parent, level))

    chosen = F.array(F.lit(""))  # one element: each level is worked out once for the level below
    for level in _levels(live):
        chosen = descend(chosen, level)
    return F.substring_index(chosen[0], "/", -1).cast("int")


def shard_documents(
    docs: DataFrame, shards: int = 8, id: str = "doc_id", text: str = "text", tree: list[Shard] | None = None,
    grown: list[Shard] | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """Per document: size, checksum, shard, place in the shard, and the shard in the grown tree.

    The id (as text; NULL as empty) and the tree decide the shard, so repeated ids stay together.
    `size` is the bytes of the text plus 1, `text_crc32` its checksum; NULL texts count as empty.
    `slot` numbers a shard's rows from 0 without gaps: shards are cut into hashed buckets, bucket
    counts give each bucket's first slot, and repeats of one row are counted before they are dealt.
    An empty table gives no rows.
    """
    tree = standard_tree(shards) if tree is None else tree
    grown = standard_tree(shards + 1) if grown is None else grown
    key = F.coalesce(F.col(id).cast("string"), F.lit(""))
    # From all that tells rows apart: the rows of one id, or of none, fall into many buckets.
    whole_row = F.concat_ws(":", key, F.col("size").cast("string"), F.col("text_crc32").cast("string"))
    bucket = (F.conv(F.substring(F.md5(whole_row.cast("binary")), 1, 8), 16, 10).cast("long") % buckets).cast("int")
    whole = F.coalesce(F.col(text), F.lit(""))
    # Placed after repeats are counted, once per distinct row.
    rows = (
        docs.select(
            F.col(id), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32")
        )
        .groupBy(id, "size", "text_crc32").agg(F.count("*").alias("_n"))
        .withColumns({"shard": place(key, tree), "grown_shard": place(key, grown), "_bucket": bucket})
    )
    rows = materialize(rows)  # a few numbers for each distinct row; read for the counts and for the rows
    counts = rows.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_bucket").orderBy(id, "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    # At most shards * buckets rows of three numbers.
    placed = placed.join(F.broadcast(starts), ["shard", "_bucket"], "left")
    runs = placed.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / RUN))))
    last = F.least(F.lit(RUN), F.col("_n") - F.col("_run") * RUN) - 1
    dealt = runs.withColumn("_place", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    slot = F.col("_start") + F.col("_before") + F.col("_run") * RUN + F.col("_place")
    return dealt.select(
        id, "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.cast("long").alias("slot"), "grown_shard"
    )
