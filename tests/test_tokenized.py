"""Tokens cut and looked up on Arrow batches, against the same in SQL expressions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from screenflow.functions import text as tx
from screenflow.functions import tokenized
from screenflow.functions.bits import token_bits
from screenflow.operators import ngrams, sequences


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(5)
    pieces = ["[C@@H]", "[", "]", "[a\nb]", "[]", "Br", "Cl", "Si", "Se", "B", "S", "@@", "@", "@@@", "%12", "%1", "%٣٤", "\n", "\r", "é", "é", "😀", " ", "ab ", "<UNK>", "0"]
    rows = [(i, "".join(draw.choices(pieces, k=draw.randint(0, 40)))) for i in range(300)]
    return spark.createDataFrame(rows + [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "x" * 5000)], "id long, text string").cache()


def test_tokens_bits_and_counts_like_expressions(texts):
    t = tx.tokens(F.col("text"))
    rows = tokenized.small_batches(texts).select(
        "id", "text", t.alias("tokens"), F.array_sort(F.array_distinct(t)).alias("each"), token_bits(t, 256, 2).alias("bits"),
        F.array_sort(tokenized.distinct_tokens(F.col("text"))).alias("found"), tokenized.token_count(F.col("text")).alias("n"),
        tokenized.run_bits(F.col("text"), 256, 2).alias("marked"),
    ).collect()
    for r in rows:
        assert r.each == r.found and r.bits == r.marked
        assert r.n == (None if r.text is None else len(r.tokens))
        assert r.text is None or list(tokenized.split(r.text)) == r.tokens


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_counts_of_contexts(spark, texts, order, monkeypatch):
    monkeypatch.setattr(tokenized, "ENTRIES", 50)
    wanted = Counter()
    for r in texts.where("text is not null").select(F.col("id") % 2, tx.tokens(F.col("text"))).collect():
        s = [tx.BOS, *r[1], tx.EOS]
        wanted.update((r[0], tuple(s[max(0, i - order) : i]), s[i]) for i in range(1, len(s)))
    found = tokenized.transition_counts(texts.withColumn("half", F.col("id") % 2), "text", order, ["half"]).collect()
    assert len(found) == len(wanted) and {(r.half, tuple(r.context), r.next): r["count"] for r in found} == wanted


def test_small_vocabularies_are_sent_and_large_ones_met(spark, texts, monkeypatch):
    """Both ways give the same rows, and a small vocabulary takes no join and one deal of the rows."""
    vocabulary = sequences.build_vocabulary(texts.where("id % 3 = 0"), "text")

    def both():
        coded = sequences.encode(texts, "text", vocabulary, "id", parts=3).drop("text")
        return sequences.decode(sequences.decode(coded, "ids", vocabulary, "id"), "ids", vocabulary, "id", "known", skip_unknown=True)

    sent = both()
    plan = sent._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Repartition") == 1
    monkeypatch.setattr(sequences, "HELD_ENTRIES", 3)
    met = both()
    assert "Join" in met._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, sent.collect())) == sorted(map(str, met.collect()))


def test_runs_beyond_the_alphabet_go_by_their_names(texts, monkeypatch):
    held = [r.text for r in texts.where("text is not null").collect()]
    found = []
    for most in (200, 9):
        monkeypatch.setattr(tokenized, "ALPHABET", most)
        marks = tokenized.RunBits(256, 2)
        found.append([marks.of(t).tolist() for t in held])
        assert len(marks.names) == 9 or most == 200 and len(marks.names) > 9
    assert found[0] == found[1]


def test_ids_and_back(spark, texts):
    vocabulary = sequences.build_vocabulary(texts.where("id % 3 = 0"), "text")
    number = {r.token: r.id for r in vocabulary.collect()}
    name = {i: t for t, i in number.items()}
    coded = sequences.encode(texts, "text", vocabulary, "id", parts=3)
    both = sequences.decode(sequences.decode(coded, "ids", vocabulary, "id"), "ids", vocabulary, "id", "known", skip_unknown=True)
    for r in both.join(texts.select("id", tx.tokens(F.col("text")).alias("t")), "id").collect():
        if r.text is None:
            assert r.ids is None and r.decoded is None
            continue
        assert r.ids == [tx.BOS_ID, *[number.get(t, tx.UNK_ID) for t in r.t], tx.EOS_ID]
        assert r.decoded == "".join(name[i] for i in r.ids[1:-1]) and r.known == "".join(t for t in r.t if t in number)


def test_padded_as_text(spark):
    df = spark.createDataFrame([(1, [1, 5, 2]), (2, []), (4, [7, 8, 9, 4, 2])], "id long, ids array<int>")
    as_text = {r.id: r.padded for r in sequences.pad_sequences(df, "ids", 5, separator=", ").collect()}
    arrays = {r.id: r.padded for r in sequences.pad_sequences(df, "ids", 5).collect()}
    assert as_text == {i: ", ".join(map(str, a)) for i, a in arrays.items()}
    with pytest.raises(Exception, match="sequence too long: 5"):
        sequences.pad_sequences(df, "ids", 4, separator=",").collect()


def test_a_model_is_fitted_once_for_all_lengths(spark, texts):
    """Scoring reads the model several times; the texts behind it are read for one of them."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    model = ngrams.fit_ngram(texts.mapInArrow(counted, texts.schema), "text", 2)
    ngrams.score_sequences(texts.withColumn("part", F.lit("all")), "text", model, "part").collect()
    assert seen.value == texts.count()
