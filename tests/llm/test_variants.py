import random
import re
import zlib
from collections import Counter

from screenflow.functions.ordering import global_rank
from screenflow.llm.variants import near_words, spelling_variants, word_counts

FOLDER = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_counts(rows, least_length=6, least_count=5, damage=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def are_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio=5):
    rows, forms, near = {}, {}, {w: [] for w in counts}
    words = sorted(counts)
    for i, a in enumerate(words):
        for b in words[:i]:
            if abs(len(a) - len(b)) < 2 and are_near(a, b):
                near[a].append(b)
                near[b].append(a)
    for w in words:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= ratio * counts[w]:
            forms[w] = best
    for w in words:
        root = w
        while root in forms:
            root = forms[root]
        rows[w] = (w, forms.get(w), root, counts[w], len(near[w]), counts[forms[w]] if w in forms else None)
    return sorted(rows.values(), key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=str)


def test_whole_table_like_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts = plain_counts([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["word"]: r["n"] for r in word_counts(docs).collect()} == counts
    wanted = plain_variants(counts)
    assert got(spelling_variants(docs)) == wanted and any(r[1] for r in wanted)


def test_near_words_like_all_pairs(spark):
    draw = random.Random(3)
    words = {"".join(draw.choice("abé") for _ in range(draw.randint(1, 6))) for _ in range(250)}
    words |= {"a" * k for k in range(1, 9)} | {"ab" * 40, "ab" * 39 + "b", "ab" * 39 + "ac"}  # runs; parts kept as digests
    counts = {w: draw.choice([5, 6, 30, 200]) for w in words}
    ranked = global_rank(spark.createDataFrame(list(counts.items()), "word string, n long"), ["word"])
    names = {r["rank"]: r["word"] for r in ranked.collect()}
    assert [names[k] for k in sorted(names)] == sorted(words)
    for rows_per_task in (1_000_000, 20):  # with and without split nodes
        found = {names[r["rank"]]: (r["n_near"], r["near_n"], names[r["near_rank"]]) for r in near_words(ranked, rows_per_task).collect()}
        for w in words:
            near = [v for v in words if are_near(v, w)]
            best = min(near, key=lambda v: (-counts[v], v), default=None)
            assert found.get(w) == ((len(near), counts[best], best) if near else None)


def test_forms_lead_to_a_root(spark):
    text = " ".join(["thousand"] * 500 + ["thousend"] * 60 + ["thowsend"] * 10 + ["Thousand"] * 5 + ["thousandé"] * 5)
    found = {r["word"]: r for r in spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), damage=1 << 40).collect()}
    assert found["thowsend"]["form"] == "thousend" and found["thowsend"]["root"] == "thousand" and found["thowsend"]["form_n"] == 60
    assert found["thousand"]["root"] == "thousand" and found["thousand"]["n"] == 505 and found["thousand"]["n_near"] == 2
    assert found["thousandé"]["form"] == "thousand"


def test_odd_tables(spark, documents, no_documents):
    longer = spark.createDataFrame([(8, "y" * 3_000 + " " + "y" * 2_999, "en", "a")], "doc_id long, text string, lang string, source string")
    one = documents.where("length(text) < 200000").unionByName(longer, allowMissingColumns=True)
    wanted = plain_variants(plain_counts([(r["doc_id"], r["text"]) for r in one.collect()], least_count=1), ratio=2)
    assert got(spelling_variants(one, least_count=1, ratio=2)) == wanted
    assert "y" * 3_000 in [r[0] for r in wanted] and "y" * 2_999 in [r[0] for r in wanted]
    assert spelling_variants(no_documents).count() == 0
    clashing = documents.withColumnsRenamed({"lang": "word", "source": "rank"})
    assert got(spelling_variants(clashing, least_count=2)) == plain_variants(plain_counts([(r[0], r[1]) for r in documents.collect()], least_count=2))
