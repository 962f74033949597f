import random
import re

import pytest

from screenflow.llm.licenses import NOTICES, PHRASES, block_size, license_digest, license_matches, needed, notice_words


def split(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(text, threshold=0.8):
    w, notices = split(text), notice_words()
    width, step = block_size(notices)
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    hits = []
    for s in range(0, len(w), step):
        block = set(w[s : s + width])
        for label, some in notices:
            both = len(block & set(some))
            if both >= needed(len(some), threshold):
                hits.append((label, s, both / len(some)))
    return len(w), places, hits


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    pool = sorted({w for _, some in notice_words() for w in some}) + ["foo", "bar", "É"] * 40
    made = [" ".join(draw.choices(pool, k=draw.randint(0, 200))) for _ in range(60)]
    for some in NOTICES.values():
        for n in some:
            words = n.split()
            for share in (0.7, 0.8, 0.9, 1.0):
                kept = [w for w in words if draw.random() < share]
                made.append(" ".join(["pad"] * draw.randint(0, 150) + kept + ["end"] * 30).upper())
    return made + ["MIT license mit License. General\nPublic-License", "\u212anown mit licen\u017fe", "mit", "", None]


def test_same_as_comparing_everything(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    digests = {r["doc_id"]: r for r in license_digest(docs).collect()}
    found = {r["doc_id"]: r["f"] for r in license_matches(docs, name="f").collect()}
    some = 0
    for i, t in enumerate(texts):
        n, places, hits = plain(t)
        assert found[i]["n_words"] == n
        assert sorted((p, x["label"]) for x in found[i]["phrases"] for p in x["places"]) == sorted(places)
        assert sorted((h["label"], h["start"], round(h["containment"], 9)) for h in found[i]["blocks"]) == sorted((a, b, round(c, 9)) for a, b, c in hits)
        starts = [p for p, _ in places]
        d = digests[i]
        assert (d["n_base"], d["first_word"], d["last_word"]) == (len(starts), min(starts, default=None), max(starts, default=None))
        assert d["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert d["labels"] == ",".join(sorted({x for _, x in places} | {h[0] for h in hits}))
        assert abs(d["score"] - (1.0 if places else max([h[2] for h in hits], default=0.0))) < 1e-9
        some += len(hits)
    assert some > 20


def test_whole_tables(documents, no_documents):
    rows = license_digest(documents).collect()
    assert len(rows) == documents.count() and {(r["labels"], r["score"]) for r in rows} == {("", 0.0)}
    assert max(r["n_words"] for r in rows) == 40_000
    assert license_digest(no_documents).count() == 0
    assert license_matches(documents).columns == [c for c in documents.columns if c != "licenses"] + ["licenses"]
