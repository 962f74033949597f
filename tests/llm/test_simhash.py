import random
import re

import numpy as np
import pytest
import xxhash

from screenflow.functions.components import connected_components
from screenflow.llm.simhash import _joining, fingerprint, keep_one, near_duplicates, near_links, shingle_hashes

FOLDER = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=4):
    """doc_id -> smallest doc_id reachable, comparing all pairs."""
    label = {i: i for i in range(len(prints))}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
                label[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(root(i), []).append(prints[i][0])
    return sorted((prints[i][0], min(groups[root(i)])) for i in range(len(prints)))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "a b c d", "A\x0bb\tc\x0cd é É f", "x " * 500, "\x1fa\x1cb\u00a0c d e"])
def test_fingerprints(text):
    assert fingerprint(shingle_hashes(text)) == plain_fingerprint(text)


def test_long_texts_count_in_blocks(monkeypatch):
    monkeypatch.setattr("screenflow.llm.simhash._BLOCK", 3)
    text = " ".join(f"w{i}" for i in range(50))
    assert fingerprint(shingle_hashes(text)) == plain_fingerprint(text)


def test_documents_like_all_pairs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    rows = near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["fingerprint"]) for r in rows) == sorted((i, f"{p:016x}") for i, p in prints)
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == plain_components(prints)


def nodes(spark, values):
    return spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fingerprint long")


def test_links_like_all_pairs(spark):
    draw, values = random.Random(4), set()
    for _ in range(12):
        centre = draw.getrandbits(64)
        group = [centre]
        for _ in range(draw.choice([3, 60])):
            near = draw.choice(group)
            for b in draw.sample(range(64), draw.randint(0, 6)):
                near ^= 1 << b
            group.append(near)
        values |= set(group)
    values = sorted(values | {0, (1 << 64) - 1})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {r["node"]: r["root"] for r in connected_components(near_links(nodes(spark, values))).collect()}
    wanted = dict(plain_components(list(zip(signed, values))))
    groups = {}
    for s in signed:
        groups.setdefault(got.get(s, s), set()).add(s)
    plain = {}
    for s, r in wanted.items():
        plain.setdefault(r, set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_a_large_cell_passes_on_few_links():
    base = np.arange(256, dtype=np.uint64)  # bit patterns of one byte: all are joined through steps of up to 4 bits
    assert len(_joining(base, 4)) == 255


def test_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (600, 601)], "a long, b long")
    assert {(r["node"], r["root"]) for r in connected_components(links).collect()} == {(i, 0) for i in range(1, 201)} | {(601, 600)}


def test_whole_tables(documents, no_documents):
    rows = near_duplicates(documents).collect()
    assert len(rows) == documents.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["fingerprint"] == by[3]["fingerprint"] == "0" * 16 and by[3]["component_id"] == 2
    assert by[None]["component_id"] is None and sum(r["doc_id"] == 1 for r in rows) == 2
    kept = keep_one(documents)
    assert kept.columns == documents.columns
    assert sorted((r["doc_id"] or -1 for r in kept.collect())) == [-1, 1, 2, 4, 5, 6, 10]
    assert near_duplicates(no_documents).count() == keep_one(no_documents).count() == 0


def test_one_of_each_group_stays_whatever_the_ids(spark):
    river, tower = "the house is by the river and the mill", "seven grey towers stand over an old harbour wall"
    rows = [(None, river), (None, river), (None, tower), (7, "a b c"), (7, "quite another text than that"), (8, "a b c"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"] or -1, r["text"] or "") for r in keep_one(docs).collect()]
    assert sorted(kept) == [(-1, tower), (-1, river), (7, "a b c"), (7, "quite another text than that"), (9, "")]


def test_which_row_stays_does_not_depend_on_order(spark):
    rows = [(1, "a b c d e", "x"), (1, "A B c d e", "x"), (1, "a b c d e", "y"), (2, "a b c d e", "x"), (None, "q r s t", "x"), (None, "Q r s t", "x")]
    kept = set()
    for some in (rows, rows[::-1], rows[2:] + rows[:2]):
        for parts in (1, 3):
            docs = spark.createDataFrame(some, "doc_id long, text string, source string").repartition(parts)
            kept.add(tuple(sorted(map(str, map(tuple, keep_one(docs).collect())))))
    assert len(kept) == 1 and len(kept.pop()) == 2


def test_documents_like_all_pairs_on_a_larger_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    assert sorted((r["doc_id"], r["component_id"]) for r in near_duplicates(docs).collect()) == plain_components(prints)
