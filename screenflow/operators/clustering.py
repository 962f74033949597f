"""Clusters of near neighbours, visited from the most connected row down."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenflow.functions.components import connected_components
from screenflow.functions.ordering import exact_quantiles, global_rank
from screenflow.functions.skew import ROWS_PER_TASK, salted_join
from screenflow.operators.dense import packed, similar_words, word_names
from screenflow.operators.quality import top_n
from screenflow.operators.similarity import similar_pairs
from screenflow.session import materialize, written

COMPONENT_EDGES = 1_000_000  # edges of a component that one task settles

def butina_clusters(
    nodes: DataFrame,
    id: str,
    edges: DataFrame,
    later_ties_first: bool = True,
    rows_per_task: int = ROWS_PER_TASK,
    weight: str | None = None,
    rounds_before_components: int = 6,
    component_edges: int = COMPONENT_EDGES,
) -> DataFrame:
    """(id, cluster_id, is_center) for every node, given neighbour pairs (src, dst).

    Sequentially: take rows by number of neighbours, most first; a row not yet taken becomes the
    next centre and takes its free neighbours. Here, in rounds: a row becomes a centre once all
    its neighbours that come before it are known to be members; neighbours of centres are members.
    After `rounds_before_components` rounds what is open is cut into connected components, and those
    of at most `component_edges` edges are settled in one task each; rounds go on with the others.
    The outcome is the same. `later_ties_first`: of rows with equally many neighbours, the one with
    the larger id goes first. With `weight` (a column of `nodes`) a node stands for that many equal
    rows, which count as neighbours of each other and of the node's neighbours.
    """
    both = edges.select(F.col("src").alias(id), F.col("dst").alias("_other")).unionAll(
        edges.select(F.col("dst").alias(id), F.col("src").alias("_other"))
    )
    degrees = both.groupBy(id).agg(F.count(F.lit(1)).alias("degree"))
    visits = nodes.select(id).join(degrees, id, "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    if weight is None:
        visits = visits.withColumn("_neighbours", F.col("degree"))
    else:
        weights = nodes.select(F.col(id).alias("_other"), F.col(weight).alias("_w"))
        counted = weights.join(degrees.withColumnRenamed(id, "_other"), "_other")
        around = salted_join(both, counted, ["_other"], "degree", [id], rows_per_task=rows_per_task)
        around = around.groupBy(id).agg(F.sum("_w").alias("_around"))
        own = weights.withColumnRenamed("_other", id)
        visits = visits.join(around, id, "left").join(own, id)
        visits = visits.withColumn("_neighbours", F.coalesce("_around", F.lit(0)) + F.col("_w") - 1)
    tie = F.desc(id) if later_ties_first else F.asc(id)
    visits = global_rank(visits.select(id, "degree", "_neighbours"), [F.desc("_neighbours"), tie], "visit")
    visits = materialize(visits.drop("_neighbours"))

    most = visits.agg(F.max("degree").alias("most")).first()["most"] or 0
    degrees = visits.select("visit", "degree")

    def touching(rows: DataFrame, marked: DataFrame, end: str, other: str, how: str) -> DataFrame:
        """Join edges to marked rows at one end; if any row has very many edges, those are split."""
        if most <= rows_per_task:
            return rows.join(marked.withColumnRenamed("visit", end), end, how)
        keyed = marked.join(degrees.withColumnRenamed("degree", "_degree"), "visit").withColumnRenamed("visit", end)
        return salted_join(rows, keyed, [end], "_degree", [other], how, rows_per_task).drop("_degree")

    # Edges between visiting numbers, from the earlier to the later row.
    places = visits.where("degree > 0").select(id, "visit", "degree")
    ends = edges.select("src", "dst")
    for end, number, other in (("src", "a", "dst"), ("dst", "b", "a")):
        named = places.select(F.col(id).alias(end), F.col("visit").alias(number), F.col("degree").alias("_degree"))
        if most > rows_per_task:
            ends = salted_join(ends, named, [end], "_degree", [other], rows_per_task=rows_per_task)
        else:
            ends = ends.join(named, end)
        ends = ends.drop("_degree", end)
    forward = materialize(ends.select(F.least("a", "b").alias("first"), F.greatest("a", "b").alias("later")))

    # An edge is live while both its rows are open. A row that is nobody's later row has no open
    # row before it, so it is a centre, and its later rows are members. Chains of rows that wait for
    # each other would take a round per centre: after some rounds small components are settled whole.
    live, members, rounds = forward, None, 0
    while not live.isEmpty():
        if rounds == rounds_before_components:
            settled, live = _settle(live, component_edges)
            members = settled if members is None else members.unionByName(settled)
            rounds += 1
            continue
        rounds += 1
        reached = live.select(F.col("later").alias("visit")).distinct()
        heads = live.select(F.col("first").alias("visit")).distinct().join(reached, "visit", "left_anti")
        taken = touching(live, heads, "first", "later", "left_semi").select(F.col("later").alias("visit")).distinct()
        taken = materialize(taken)
        members = taken if members is None else members.unionByName(taken)
        rest = touching(live, taken, "later", "first", "left_anti")
        live = materialize(touching(rest, taken, "first", "later", "left_anti"))

    centers = visits.select("visit")
    if members is not None:
        centers = centers.join(members, "visit", "left_anti")
    numbered = global_rank(centers, ["visit"], "cluster_id").withColumn("cluster_id", F.col("cluster_id") - 1)
    # A member belongs to its earliest centre.
    of_centers = touching(forward, numbered.select("visit"), "first", "later", "left_semi")
    home = of_centers.groupBy(F.col("later").alias("visit")).agg(F.min("first").alias("center"))
    own = numbered.select("visit", F.col("visit").alias("center"))
    assigned = own.unionByName(home)
    sizes = assigned.groupBy("center").agg(F.count(F.lit(1)).alias("_n"))
    named = numbered.select(F.col("visit").alias("center"), "cluster_id").join(sizes, "center")
    placed = salted_join(assigned, named, ["center"], "_n", ["visit"], rows_per_task=rows_per_task)
    return visits.select("visit", id).join(placed, "visit").select(
        id, "cluster_id", (F.col("visit") == F.col("center")).alias("is_center")
    )


def _settle(live: DataFrame, component_edges: int) -> tuple[DataFrame, DataFrame]:
    """Members among the rows of small components of the live edges, and the live edges of the others."""
    roots = connected_components(live, "first", "later").select(F.col("node").alias("later"), "root")
    rooted = live.join(roots, "later")  # a later row is never the smallest of its component
    sizes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("_edges"))
    rooted = materialize(salted_join(rooted, sizes, ["root"], "_edges", ["first", "later"]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, members = None, set()
        for batch in batches:
            new = []
            for component, first, later in zip(*(c.to_pylist() for c in batch.columns)):
                if component != root:
                    root, members = component, set()
                # Rows come in visiting order: one that no centre has taken is a centre itself.
                if first not in members and later not in members:
                    members.add(later)
                    new.append(later)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64())], names=["visit"])

    small = rooted.where(F.col("_edges") <= component_edges).select("root", "first", "later")
    taken = small.repartition("root").sortWithinPartitions("root", "first", "later").mapInArrow(walk, "visit long")
    return materialize(taken), materialize(rooted.where(F.col("_edges") > component_edges).select("first", "later"))


def cluster_fingerprints(
    df: DataFrame,
    id: str,
    bits: str,
    max_distance: float = 0.60,
    later_ties_first: bool = True,
    rows_per_task: int = ROWS_PER_TASK,
    n_bits: int | None = None,
) -> DataFrame:
    """(id, cluster_id) for rows with fingerprints: neighbours are at most `max_distance` apart.

    `n_bits` is the width of the fingerprints, if known (see `similar_pairs`).

    Rows with equal fingerprints have the same neighbours and always share a cluster, so each
    fingerprint is clustered once, by its first visited row and weighted with its number of rows.
    However many copies there are, no pairs of copies are made. A row with an empty fingerprint is
    a cluster of its own.
    """
    first = F.max(id) if later_ties_first else F.min(id)
    if n_bits is None:
        key, rows = ["_bits"], df.select(id, F.col(bits).alias("_bits"), F.coalesce(F.size(bits), F.lit(0)).alias("n"))
    else:
        # Written once, as words: what follows reads rows that may be dear to make, and wide, several times.
        key, rows = word_names(n_bits), written(packed(df, id, bits, n_bits, empty=True)).withColumnRenamed("id", id)
    filled = rows.where("n > 0")
    copies = filled.groupBy(*key, "n").agg(first.alias("_node"), F.count(F.lit(1)).alias("_copies"))
    copies = materialize(copies)
    alone = rows.where("n <= 0").select(F.col(id).alias("_node"), F.lit(1).cast("long").alias("_copies"))
    nodes = copies.select("_node", "_copies").unionByName(alone)
    if n_bits is None:
        pairs = materialize(similar_pairs(copies, "_node", "_bits", max_distance))
    else:
        pairs = materialize(similar_words(copies.select(F.col("_node").alias("id"), "n", *key), n_bits, max_distance))
    clusters = butina_clusters(nodes, "_node", pairs, later_ties_first, rows_per_task, weight="_copies")
    named = copies.join(clusters.select("_node", "cluster_id"), "_node").select(*key, "_copies", "cluster_id")
    placed = salted_join(filled.select(id, *key), named, key, "_copies", [id], rows_per_task=rows_per_task)
    single = alone.select("_node").join(clusters, "_node").select(F.col("_node").alias(id), "cluster_id")
    return placed.select(id, "cluster_id").unionByName(single)


def cluster_summary(clusters: DataFrame, cluster: str) -> DataFrame:
    """Number of clusters, size of the largest, median size, and how many have one row."""
    sizes = clusters.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    median = exact_quantiles(sizes, "size", {"median": 0.5}).scalar()
    single: Column = F.count_if(F.col("size") == 1)
    return sizes.agg(
        F.count(F.lit(1)).alias("n_clusters"), F.max("size").alias("largest"), single.alias("n_singletons")
    ).withColumn("median_size", median)


def first_cluster_sizes(clusters: DataFrame, cluster: str, n: int = 15) -> DataFrame:
    """Sizes of the first clusters in visiting order."""
    sizes = clusters.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    return top_n(sizes, [cluster], n, ascending=True)
