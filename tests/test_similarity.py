import random

import pytest

from screenflow.functions.ordering import global_rank
from screenflow.operators import clustering, diversity
from screenflow.operators import similarity as sim

SCHEMA = "id long, bits array<int>"


def fingerprints(n, width, size, seed):
    """Families of near copies, one bit that a third of the rows share, and an empty row."""
    rng = random.Random(seed)
    rows = []
    while len(rows) < n - 1:
        base = set(rng.sample(range(width), size))
        for _ in range(rng.randrange(1, 5)):
            mine = {b for b in base if rng.random() < 0.8} | set(rng.sample(range(width), 2))
            if rng.random() < 0.33:
                mine.add(0)
            rows.append(sorted(mine))
    rows = rows[: n - 1] + [[]]
    return dict(enumerate(rows))


def tanimoto(a, b):
    both = len(set(a) & set(b))
    return both / (len(a) + len(b) - both) if a or b else 0.0


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), SCHEMA)


def brute_pairs(rows, cutoff):
    return {
        (a, b): tanimoto(rows[a], rows[b])
        for a in rows
        for b in rows
        if a < b and rows[a] and rows[b] and 1.0 - tanimoto(rows[a], rows[b]) <= cutoff
    }


@pytest.mark.parametrize("width,size", [(40, 12), (600, 10)])  # word comparison, array comparison
@pytest.mark.parametrize("cutoff,block_rows", [(0.6, 20_000), (0.6, 7), (0.2, 20_000), (0.95, 11)])
def test_pairs_equal_brute_force(spark, width, size, cutoff, block_rows):
    rows = fingerprints(90, width, size, seed=width)
    found = sim.similar_pairs(frame(spark, rows), "id", "bits", cutoff, block_rows).collect()
    expected = brute_pairs(rows, cutoff)
    assert len(found) == len(expected)
    assert {(r.src, r.dst): r.similarity for r in found} == pytest.approx(expected)


def test_pair_exactly_at_the_cutoff(spark):
    rows = {1: [1, 2], 2: [1, 2, 3, 4, 5], 3: [8, 9]}  # similarity 0.4
    assert [(r.src, r.dst) for r in sim.similar_pairs(frame(spark, rows), "id", "bits", 0.6).collect()] == [(1, 2)]


@pytest.mark.parametrize("width,size", [(40, 12), (600, 10)])
def test_nearest_equals_brute_force(spark, width, size):
    rows = fingerprints(80, width, size, seed=3)
    asked = {k: v for k, v in rows.items() if k >= 40}
    asked[999] = [width + 50]  # no bit in common with anything
    asked.update({500 + i: asked[41] for i in range(30)})
    rows.update({100 + i: rows[5] for i in range(30)})
    known = {k: v for k, v in rows.items() if k < 40 or k >= 100}
    found = sim.nearest_reference(frame(spark, asked), "id", frame(spark, known), "id", "id", block_rows=9).collect()
    assert len(found) == len(asked)
    for row in found:
        best = max(known, key=lambda k: (tanimoto(asked[row.id], known[k]), -k))
        assert (row.nearest, row.max_similarity) == (best, pytest.approx(tanimoto(asked[row.id], known[best])))


def sequential_clusters(ids, edges, later_first):
    neighbours = {i: set() for i in ids}
    for a, b in edges:
        neighbours[a].add(b)
        neighbours[b].add(a)
    order = sorted(ids, key=lambda i: (-len(neighbours[i]), -i if later_first else i))
    seen, clusters = {}, 0
    for i in order:
        if i in seen:
            continue
        for j in [i, *neighbours[i]]:
            seen.setdefault(j, clusters)
        clusters += 1
    return seen


@pytest.mark.parametrize("later_first,rows_per_task", [(True, 1_000_000), (False, 3)])
@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_the_sequential_walk(spark, later_first, rows_per_task, seed):
    rng = random.Random(seed)
    ids = list(range(60))
    edges = {tuple(sorted(rng.sample(ids, 2))) for _ in range(70)} | {(0, i) for i in range(1, 25)}
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    pairs = spark.createDataFrame(sorted(edges), "src long, dst long")
    found = clustering.butina_clusters(nodes, "id", pairs, later_first, rows_per_task).collect()
    assert {r.id: r.cluster_id for r in found} == sequential_clusters(ids, edges, later_first)
    assert sum(r.is_center for r in found) == len({r.cluster_id for r in found})


@pytest.mark.parametrize("later_first", [True, False])
def test_copies_are_clustered_like_single_rows(spark, later_first):
    rows = fingerprints(60, 50, 8, seed=8)
    rows = {i: (rows[3] if i % 3 == 0 else rows[i]) for i in rows}  # a third are copies
    edges = brute_pairs(rows, 0.6)
    found = clustering.cluster_fingerprints(frame(spark, rows), "id", "bits", 0.6, later_first, rows_per_task=4).collect()
    assert len(found) == len(rows)
    assert {r.id: r.cluster_id for r in found} == sequential_clusters(list(rows), edges, later_first)


def test_rows_without_neighbours_are_clusters(spark):
    nodes = spark.range(3)
    none = spark.createDataFrame([], "src long, dst long")
    assert sorted(r.cluster_id for r in clustering.butina_clusters(nodes, "id", none).collect()) == [0, 1, 2]


@pytest.mark.parametrize("limit,n,window", [(0.65, 100, 10_000), (0.3, 20, 8), (0.1, 5, 3)])
def test_diverse_pick_equals_the_sequential_walk(spark, limit, n, window):
    rows = fingerprints(120, 200, 8, seed=5)
    ranked = global_rank(frame(spark, rows), ["id"])
    found = diversity.diverse_pick(ranked, "rank", "bits", n, limit, window).orderBy("diverse_rank").collect()
    chosen, expected = [], []
    for key in sorted(rows):
        near = max((tanimoto(rows[key], rows[c]) for c in chosen), default=0.0)
        if near <= limit:
            chosen.append(key)
            expected.append((key, near))
        if len(chosen) == n:
            break
    assert [r.id for r in found] == chosen
    assert {r.id: r.max_similarity_to_previous_selected for r in found} == pytest.approx(dict(expected))


def _greedy(n, edges):
    """Clusters of nodes 0 to n - 1 taken one by one: by neighbours, most first, later ones first among equals."""
    near = {i: set() for i in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    cluster, k = {}, 0
    for i in sorted(range(n), key=lambda i: (-len(near[i]), -i)):
        if i not in cluster:
            cluster.update({j: k for j in near[i] if j not in cluster} | {i: k})
            k += 1
    return cluster


@pytest.mark.parametrize("component_edges, length", [(1_000_000, 400), (10, 24)])
def test_long_paths_are_settled_in_few_rounds(spark, monkeypatch, component_edges, length):
    import random

    from screenflow.operators import clustering

    draw = random.Random(6)
    edges = [(i, i + 1) for i in range(length)] + [(500 + i, 501 + i) for i in range(9)]
    edges += [tuple(sorted(draw.sample(range(600, 700), 2))) for _ in range(120)]
    edges = sorted(set(edges))
    written = []
    original = clustering.materialize
    monkeypatch.setattr("screenflow.operators.clustering.materialize", lambda df: written.append(1) or original(df))
    nodes = spark.range(700).select("id")
    frame = spark.createDataFrame(edges, "src long, dst long")
    found = {r["id"]: r["cluster_id"] for r in clustering.butina_clusters(nodes, "id", frame, component_edges=component_edges).collect()}
    assert found == _greedy(700, edges)
    if component_edges > 1_000:
        assert len(written) < 30  # a path of 400 nodes alone took some 200 before
