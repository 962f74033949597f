import pytest
from pyspark.sql import functions as F

from screenflow.functions import text as tx
from screenflow.operators import ngrams, sequences

TEXTS = ["C[C@@H](N)C(=O)O", "ClCCBr", "c1ccc%10cc1%10", "[Si](C)Se@@@", "", "a\rb", "[[x]", "é𝄞%1"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")


def test_tokens(texts):
    found = {r.text: r.t for r in texts.select("text", tx.tokens(F.col("text")).alias("t")).collect()}
    assert found["C[C@@H](N)C(=O)O"] == ["C", "[C@@H]", "(", "N", ")", "C", "(", "=", "O", ")", "O"]
    assert found["ClCCBr"] == ["Cl", "C", "C", "Br"]
    assert found["c1ccc%10cc1%10"][5:6] == ["%10"]
    assert found["[Si](C)Se@@@"] == ["[Si]", "(", "C", ")", "Se", "@@", "@"]
    assert found["a\rb"] == ["a", "\r", "b"] and found["[[x]"] == ["[", "[x]"]
    assert found["é𝄞%1"] == ["é", "𝄞", "%", "1"] and found[""] == []


def test_strict_tokens(spark):
    df = spark.createDataFrame([("ab",), ("a\nb",), (None,)], "text string")
    good, bad = sequences.strict_split(df, "text")
    assert (good.count(), bad.count()) == (1, 2)
    with pytest.raises(Exception, match="do not reproduce"):
        df.select(tx.strict_tokens(F.col("text"))).collect()


def test_vocabulary_order(texts):
    rows = sorted(sequences.build_vocabulary(texts, "text").collect(), key=lambda r: r.id)
    assert [r.token for r in rows[:4]] == ["<PAD>", "<BOS>", "<EOS>", "<UNK>"]
    tokens = [r.token for r in rows[4:]]
    assert tokens == sorted(tokens) and [r.id for r in rows] == list(range(len(rows)))


def test_encoding_both_ways(texts):
    vocabulary = sequences.build_vocabulary(texts.where("id < 4"), "text")
    coded = sequences.encode(texts, "text", vocabulary, "id")
    ids = {r.id: r.ids for r in coded.collect()}
    assert ids[4] == [1, 2] and 3 in ids[7]
    back = {r.id: r.decoded for r in sequences.decode(coded, "ids", vocabulary, "id").collect()}
    assert all(back[i] == TEXTS[i] for i in range(5))
    known = {r.id: r.decoded for r in sequences.decode(coded, "ids", vocabulary, "id", skip_unknown=True).collect()}
    assert "<UNK>" in back[7] and known[7] == "1"
    whole = sequences.build_vocabulary(texts, "text")
    row = sequences.roundtrip_check(texts, "text", whole, "id").first()
    assert (row["n_texts"], row["n_same"], row["n_changed"]) == (8, 8, 0)


def test_a_missing_text_stays_missing(spark, texts):
    vocabulary = sequences.build_vocabulary(texts, "text")
    df = spark.createDataFrame([(1, None), (2, "C")], "id long, text string")
    assert {r.id: r.ids is None for r in sequences.encode(df, "text", vocabulary, "id").collect()} == {1: True, 2: False}


def test_padding_and_shifting(spark):
    df = spark.createDataFrame([([1, 5, 2],), ([1, 5, 6, 7, 2],)], "ids array<int>")
    rows = sequences.pad_sequences(df, "ids", 5).collect()
    assert [r.padded for r in rows] == [[1, 5, 2, 0, 0], [1, 5, 6, 7, 2]] and rows[0].sequence_length == 3
    with pytest.raises(Exception, match="too long"):
        sequences.pad_sequences(df, "ids", 4).collect()
    shifted = sequences.shift(df, "ids").first()
    assert (shifted.input_ids, shifted.target_ids) == ([1, 5], [5, 2])


def test_best_row_takes_the_earliest(spark):
    df = spark.createDataFrame([(1, 0.7), (2, 0.5), (3, 0.5), (4, None), (5, float("nan"))], "epoch int, loss double")
    assert sequences.best_row(df, "loss", "epoch").collect() == [(2, 0.5)]


def test_generated_texts(spark):
    df = spark.createDataFrame([(t,) for t in ["abab", "abba", "ab", "ba"] * 5], "text string")
    model = ngrams.fit_ngram(df, "text", 2)
    assert {r.next: r["count"] for r in model.where("length = 0").collect()} == {"a": 30, "b": 30, "<EOS>": 20}
    made = ngrams.sample_sequences(model, 50, 12, 2, seed=3).orderBy("id").collect()
    again = ngrams.sample_sequences(model.repartition(5), 50, 12, 2, seed=3).orderBy("id").collect()
    short = ngrams.sample_sequences(model, 50, 5, 2, seed=3).orderBy("id").collect()
    assert made == ngrams.sample_sequences(model, 50, 12, 2, seed=3, small=0).orderBy("id").collect()  # step by step, by joins
    assert made == again and len({r.generated for r in made}) > 3
    assert all(set(r.generated) <= {"a", "b"} and len(r.generated) <= 11 for r in made)
    assert [r.generated[:4] for r in made] == [r.generated for r in short]


def test_ids_are_those_of_the_vocabulary(spark):
    rows = [("<PAD>", 0), ("<BOS>", 1), ("<EOS>", 2), ("<UNK>", 3), ("a", 10), ("b", 20)]
    vocabulary = spark.createDataFrame(rows, "token string, id int")
    coded = sequences.encode(spark.createDataFrame([(1, "ab"), (2, "b")], "id long, text string"), "text", vocabulary, "id")
    assert {r.id: r.ids for r in coded.collect()} == {1: [1, 10, 20, 2], 2: [1, 20, 2]}
    assert {r.id: r.decoded for r in sequences.decode(coded, "ids", vocabulary, "id").collect()} == {1: "ab", 2: "b"}


def test_a_context_without_options_ends_the_text(spark):
    model = spark.createDataFrame([(1, ["<BOS>"], "a", 1)], "length int, context array<string>, next string, count long")
    made = ngrams.sample_sequences(model, 3, 9, 1).collect()
    assert sorted(r.generated for r in made) == ["a", "a", "a"]
