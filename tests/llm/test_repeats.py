import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from screenflow.llm.repeats import phrases, repeat_digest, repeat_spans, window_ranks

FOLDER = "/root/testdata/sf0.001"


def plain_spans(texts, width):
    """Covered stretches of every text, window by window."""
    texts = [(t or "").encode() for t in texts]
    counts = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        spans = []
        for i in range(len(t) - width + 1):
            if counts[t[i : i + width]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + width
                else:
                    spans.append([i, i + width])
        out.append([tuple(x) for x in spans])
    return out


def plain_digest(rows, width=400):
    out = []
    for (doc_id, text), spans in zip(rows, plain_spans([t for _, t in rows], width)):
        data, at, kept = (text or "").encode(), 0, b""
        for a, b in spans:
            kept, at = kept + data[at:a], b
        out.append((doc_id, len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept + data[at:]).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in df.collect()), key=str)


def test_whole_table_like_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    wanted = plain_digest([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got(repeat_digest(docs)) == wanted and sum(r[2] > 0 for r in wanted) > 5


def edited(draw, letters, n):
    """Texts put together from parts of each other, with slips: all kinds of overlaps."""
    made = ["".join(draw.choice(letters) for _ in range(60))]
    for _ in range(n):
        parts = []
        for _ in range(draw.randint(0, 4)):
            source = draw.choice(made) or "-"
            a = draw.randrange(len(source))
            part = source[a : a + draw.randint(1, 70)]
            if draw.random() < 0.5:
                k = draw.randrange(len(part))
                part = part[:k] + draw.choice(letters) + part[k + draw.randint(0, 1) :]
            parts.append(part)
        made.append("".join(parts))
    return made


@pytest.mark.parametrize("letters, width, core, max_group", [("abcdefgh", 30, 8, 20_000), ("ab", 24, 8, 20_000), ("aé", 40, 12, 2), ("abcdefgh", 30, 8, 1)])
def test_mixed_texts_like_brute_force(spark, letters, width, core, max_group):
    texts = edited(random.Random(width), letters, 150) + ["a" * 200, "a" * 29, "ab" * 60, None, ""]
    texts += texts[:20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    rows = repeat_spans(docs, width=width, core=core, max_group=max_group).collect()
    found = {r["doc_id"]: [(x["start"], x["end"]) for x in r["repeats"]] for r in rows}
    wanted = plain_spans(texts, width)
    assert [found[i] for i in range(len(texts))] == wanted and sum(map(len, wanted)) > 20


def test_odd_tables(spark, documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.where("length(text) < 200000 OR text IS NULL").collect()]
    assert got(repeat_digest(documents.where("length(text) < 200000 OR text IS NULL"))) == plain_digest(rows)
    whole = {r["doc_id"]: r for r in repeat_digest(documents).collect()}
    assert whole[5]["n_removed"] == whole[5]["n_bytes"] == 200_000 and whole[6]["n_removed"] == 200_000 and whole[6]["n_spans"] == 1
    assert repeat_digest(no_documents).count() == 0
    clashing = documents.withColumnsRenamed({"lang": "u", "source": "repeats"})
    spans = repeat_spans(clashing)
    assert sorted(spans.columns) == sorted(clashing.columns) and spans.count() == documents.count()


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr("screenflow.llm.repeats._PIECE", 100)
    texts = edited(random.Random(1), "abcd", 100)
    from screenflow.llm.repeats import parsed

    whole = {(r[6], k) for r in parsed([t.encode() for t in texts], 30, 8) for k in range(r[7], r[8] + 1)}
    windows = {(hashlib.sha256(t.encode()).digest()[:16], i) for t in texts for i in range(len(t) - 29)}
    assert windows <= whole


def test_equal_windows_share_a_key():
    draw = random.Random(2)
    passage = bytes(draw.choice(b"abc ") for _ in range(900))
    places = []
    for before in (b"", b"x" * 7, bytes(draw.choice(b"abc ") for _ in range(500))):
        data = before + passage + before
        places.append({i - len(before): at - i for low, high, at in phrases(data).tolist() for i in range(low, high + 1)})
    for i in range(501):
        assert len({p[i] for p in places}) == 1 and 0 <= places[0][i] <= 400 - 64


def test_ranks_are_the_order_of_windows():
    draw = random.Random(3)
    data = bytes(draw.choice(b"ab\xff\x00") for _ in range(3_000)) * 2
    at = np.array(draw.sample(range(len(data) - 50), 500))
    for width in (9, 16, 50):
        ranks, strings = window_ranks(data, at, width), [data[i : i + width] for i in at]
        order = {s: k for k, s in enumerate(sorted(set(strings)))}
        assert ranks.tolist() == [order[s] for s in strings]


def test_bytes_decide_not_words(spark):
    """Passages of 51 words in two documents each: 400 bytes are removed, 399 are not, and a width of 399 finds both."""
    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))
    filler = lambda: " ".join(word(6) for _ in range(80))
    texts = []
    for size in (399, 400):
        for _ in range(10):
            passage = " ".join([word(size - 350), *(word(6) for _ in range(50))])
            texts += [f"{filler()}{mark}{passage}{mark}{filler()}" for mark in "|#"]
    texts += [filler() for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    removed = {r["doc_id"]: r["n_removed"] for r in repeat_digest(docs).collect()}
    assert [removed[i] for i in range(60)] == [0] * 20 + [400] * 20 + [0] * 20
    found = {r["doc_id"]: len(r["repeats"]) for r in repeat_spans(docs, width=399).collect()}
    assert [found[i] for i in range(60)] == [1] * 40 + [0] * 20
