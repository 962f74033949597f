import random
import zlib
from collections import Counter

import numpy as np
import pytest

from screenflow.llm.language import Classifier, counted, fit_cutoffs, fit_profiles, keep_known, known, language_digest, most_frequent

FOLDER = "/root/testdata/sf0.01"


def plain_ngrams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for w in words:
        padded = f" {w} "
        out.update(w)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def key(gram):
    value = 0
    for c in gram:
        value = value << 21 | ord(c)
    return value


@pytest.mark.parametrize("text", ["", "a", "  A!b ", "Éa é, the end", "12 34", "日本 x", "ab\n\ncd ", "İx"])
def test_ngrams(text):
    keys, counts = counted(text)
    assert dict(zip(keys.tolist(), counts.tolist())) == {key(g): n for g, n in plain_ngrams(text).items()}


def test_long_texts_are_counted_whole(monkeypatch):
    text = "the house by the river " * 30
    whole = counted(text)
    monkeypatch.setattr("screenflow.llm.language._CHUNK", 50)
    parts = counted(text)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_profiles_count_every_taught_text(spark):
    docs = spark.createDataFrame([("x", "abab"), ("x", "abc"), ("y", "zz"), (None, "q"), ("y", None)], "lang string, text string")
    rows = fit_profiles(docs, size=4).collect()
    grams = plain_ngrams("abab abc")
    best = sorted(grams, key=lambda g: (-grams[g], key(g)))[:4]
    assert [r["ngram"] for r in sorted((r for r in rows if r["lang"] == "x"), key=lambda r: r["rank"])] == [key(g) for g in best]


def test_out_of_place_distance():
    rows = [("a", 0, 10), ("a", 1, 20), ("b", 0, 20), ("b", 1, 30)]
    model = Classifier(rows, 2)
    assert model.predict(None) == model.predict("12") == ("und", 0.0)
    assert Classifier([], 2).predict("abc") == ("und", 0.0)
    text = "xy"
    own = most_frequent(*counted(text), 2)
    same = Classifier([("a", i, int(k)) for i, k in enumerate(own)] + [("b", 1 - i, int(k)) for i, k in enumerate(own)], 2)
    assert same.predict(text) == ("a", 1.0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language_digest(docs).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(right) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_whole_tables(documents, no_documents):
    rows = {r["doc_id"]: r for r in language_digest(documents).collect()}
    assert rows[2]["lang_pred"] == rows[3]["lang_pred"] == rows[4]["lang_pred"] == "und"
    assert rows[1]["lang_pred"] == "en" and rows[10]["lang_pred"] == "de"
    assert language_digest(no_documents).count() == 0
    kept = keep_known(documents, 0.2)
    assert kept.columns == documents.columns and {r["doc_id"] for r in kept.collect()} >= {1, 10, 5}
    assert not {r["doc_id"] for r in kept.collect()} & {2, 3, 4} and {r["_lang"] for r in kept.collect()} == {"own"}


UNLEARNED = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Alla människor är födda fria och lika i värde och rättigheter. De har utrustats med förnuft och samvete och bör handla gentemot varandra i en anda av gemenskap.",
    "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.",
]


def test_noise_goes_and_clean_texts_stay_at_any_length(spark):
    draw = random.Random(5)

    def gibberish(n):
        return " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(n))

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    noise = [gibberish(n) for n in (5, 10, 50, 500, 3000) for _ in range(10)]
    noise += [" ".join(t.split()[:n]) for t in UNLEARNED for n in (10, 20, 40)]
    clean = [" ".join(r["text"].split()[:n]) for r in docs.orderBy("doc_id").take(20) for n in (5, 10, 50)]
    added = [(-1 - i, t, None) for i, t in enumerate(noise)] + [(-1001 - i, t, None) for i, t in enumerate(clean)]
    kept = {r["doc_id"] for r in keep_known(docs.union(spark.createDataFrame(added, docs.schema)), 0.2).select("doc_id").collect()}
    assert not [noise[-1 - i][:60] for i in kept if -1000 < i < 0]
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()} | {-1001 - i for i in range(len(clean))}


def test_few_taught_texts_leave_the_least_score(spark, documents):
    model = Classifier([("en", i, int(k)) for i, k in enumerate(most_frequent(*counted("the house is by the river"), 300))], 300)
    assert fit_cutoffs(documents.where("doc_id = 1"), model) == {}
    assert known(("en", 0.2, 50), {}, 0.2) and not known(("en", 0.19, 50), {}, 0.2) and not known(("und", 0.0, 0), {}, 0.0)
    assert not known(("en", 0.3, 50), {(None, 6): 0.4}, 0.2) and known(("en", 0.3, 50), {(None, 6): 0.4, ("en", 6): 0.25}, 0.2)


def top(counts, n=300):
    return [k for k, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]]


def test_predictions_like_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    learned = {}
    for i, text, lang in rows:
        if lang is not None and text is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            learned.setdefault(lang, Counter()).update({key(g): n for g, n in plain_ngrams(text).items()})
    places = {lang: {g: k for k, g in enumerate(top(c))} for lang, c in learned.items()}
    found = {r["doc_id"]: (r["lang_pred"], r["score"], r["held_out"]) for r in language_digest(docs).collect()}
    for i, text, _ in rows:
        own = top({key(g): n for g, n in plain_ngrams(text or "").items()})
        away = {lang: sum(abs(p[g] - k) if g in p else 300 for k, g in enumerate(own)) for lang, p in places.items()}
        best = min(sorted(away), key=away.get) if own else "und"
        score = 1 - away[best] / (300 * len(own)) if own else 0.0
        assert found[i] == (best, pytest.approx(score), zlib.crc32(str(i).encode()) % 4 == 2)
