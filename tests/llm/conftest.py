import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def model_path():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with NULLs, empty and long texts, ties, repeated rows, and clashing column names."""
    rows = [
        (1, "The house is by the river and the mill.", "en", "a"),
        (1, "The house is by the river and the mill.", "en", "a"),
        (2, "", "en", None),
        (3, None, None, "b"),
        (None, "no id here", "en", "b"),
        (4, "12345 !!! ???", None, "c"),
        (5, "word " * 40_000, "en", "c"),
        (6, "x" * 200_000, None, "c"),
        (10, "Das Haus steht am Fluss und die Mühle auch.", "de", "a"),
    ]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    clashing = ["score", "fingerprint", "n_tokens", "shard", "spans", "hits", "licenses", "pii", "_lang", "_kept", "_fingerprint", "_contaminated"]
    return made.withColumns({c: F.lit("own") for c in clashing})


@pytest.fixture(scope="session")
def no_documents(spark, documents):
    return spark.createDataFrame([], documents.schema)
