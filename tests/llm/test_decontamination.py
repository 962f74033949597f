import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from screenflow.llm.decontamination import (
    Automaton, benchmark_hits, contamination_digest, drop_contaminated, item_groups, item_parts, windows, words,
)
from screenflow.llm.queries import DECONTAMINATION_SQL

PATTERN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(text, items, size):
    w, hit, names = split(text), set(), set()
    for name, item in items:
        v = split(item)
        for i in range(max(1, len(v) - size + 1) if v else 0):
            window = v[i : i + size]
            for p in range(len(w) - len(window) + 1):
                if w[p : p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    names.add(name)
    return len(w), len(hit), names


LETTERS = st.lists(st.sampled_from(["a", "B", "é", "aa", "-", "\n", "x1"]), max_size=40).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(LETTERS, st.lists(LETTERS, max_size=4), st.integers(1, 4))
def test_same_as_looking_everywhere(text, items, size):
    items = [(str(i), t) for i, t in enumerate(items)]
    stretches, names = Automaton(items, size).scan(words(text))
    assert (len(words(text)), sum(e - s for s, e in stretches), names) == plain(text, items, size)


def test_words_are_those_of_the_pattern():
    for text in ["A-b_c É.é 日本 x y\x7fz", "K İ", "a\x80b"]:
        assert [w.decode() for w in words(text)] == split(text)


@pytest.fixture
def benchmark(spark):
    item = "One two three four five six seven eight nine ten eleven"
    rows = [(1, item), (1, item), (2, "Fluss und die"), (3, None), (4, ""), (None, "house is by")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_whole_tables(spark, documents, no_documents, benchmark):
    found = contamination_digest(documents, benchmark).collect()
    rows = {(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in found}
    assert (10, 9, 3, 1) in rows and (3, 0, 0, 0) in rows and (5, 40_000, 0, 0) in rows
    assert (1, 9, 3, 0) in rows and all(r["contaminated"] == (r["doc_id"] in (1, 10)) for r in found)  # an item without an id
    none = [r["items_sha256"] for r in found if r["n_items"] == 0]
    assert len(none) > 2 and set(none) == {hashlib.sha256(b"").hexdigest()}
    assert contamination_digest(no_documents, benchmark).count() == 0
    kept = drop_contaminated(documents, benchmark)
    assert kept.columns == documents.columns and kept.where("doc_id IN (1, 10)").count() == 0 and kept.count() == documents.count() - 3
    assert drop_contaminated(documents, spark.createDataFrame([], benchmark.schema)).count() == documents.count()
    text = "Ä: ONE, two; three four five six seven eight nine ten - eleven twelve; the house is by"
    found = benchmark_hits(spark.createDataFrame([(1, text)], "doc_id long, text string"), benchmark).first()["hits"]
    assert [text[h["start"] : h["end"]] for h in found] == ["ONE, two; three four five six seven eight nine ten - eleven", "house is by"]


def test_a_benchmark_in_groups(spark, documents, no_documents, benchmark):
    """Groups far smaller than the benchmark give what one automaton gives."""
    draw = random.Random(8)
    letters = ["a", "B", "é", "aa", "x1", "the", "house"]
    items = [(draw.choice([None, 1, 2, 3, 4]), " ".join(draw.choice(letters) for _ in range(draw.randint(0, 40)))) for _ in range(30)]
    more = benchmark.union(spark.createDataFrame(items, benchmark.schema))
    texts = [(i % 9 or None, " ".join(draw.choice(letters) for _ in range(draw.randint(0, 80)))) for i in range(40)]
    short = documents.where("text IS NULL OR length(text) < 1000")  # the plain version is slow
    docs = short.unionByName(spark.createDataFrame(texts * 2, "doc_id long, text string"), allowMissingColumns=True)
    assert len(list(item_groups(more, size=4, max_bytes=1_500))) > 2
    for run in (contamination_digest, benchmark_hits, drop_contaminated):
        one, many = (sorted(map(str, run(docs, more, size=4, max_bytes=m).collect())) for m in (1 << 20, 1_500))
        assert one == many
    assert contamination_digest(no_documents, more, size=4, max_bytes=1_500).count() == 0
    rows = contamination_digest(docs, more, size=4, max_bytes=1_500).collect()
    wanted = []
    for r in docs.select("doc_id", "text").collect():
        n, hit, names = plain(r["text"], [(i, t) for i, t in [(b["item_id"], b["text"]) for b in more.collect()]], 4)
        wanted.append((r["doc_id"], n, hit, len(names - {None})))
    assert sorted(map(str, wanted)) == sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"])) for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "bcd", "x" * 30]), max_size=40), st.integers(1, 5), st.integers(1, 60))
def test_parts_have_all_windows_of_an_item(item, size, most):
    item = [w.encode() for w in item]
    parts = item_parts(item, size, most)
    assert {w for p in parts for w in windows(words(p), size)} == set(windows(item, size))


def test_the_sql_twin_counts_items_and_documents_without_an_id(spark, benchmark, documents, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    short = documents.where("text IS NULL OR length(text) < 1000")
    connection = duckdb.connect()
    connection.register("documents", short.select("doc_id", "text").toArrow())
    connection.register("benchmark", benchmark.toArrow())
    theirs = sorted(map(str, connection.execute(DECONTAMINATION_SQL).fetchall()))
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert theirs == sorted(str(tuple(r[c] for c in names)) for r in contamination_digest(short, benchmark).collect())


def test_the_pipeline_drops_passages_of_items_without_an_id(spark, documents, benchmark, tmp_path):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.decontaminate(spark, documents, str(tmp_path))
    assert kept.where("doc_id IN (1, 10)").count() == 0 and kept.count() == documents.count() - 3
