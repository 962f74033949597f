"""From raw texts to a fitted sequence generator and its quality figures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenflow.operators import duplicates, ngrams, sequences
from screenflow.operators.quality import drop_missing, quarantine
from screenflow.operators.sampling import sample_exact, split_exact
from screenflow.session import materialize


@dataclass
class Corpus:
    rows: DataFrame
    vocabulary: DataFrame
    funnel: DataFrame


def prepare_corpus(
    df: DataFrame,
    row_id: str,
    text: str,
    valid: Column,
    n: int = 100_000,
    lo: int = 5,
    hi: int = 120,
    seed: int = 42,
) -> Corpus:
    """Clean, deduplicate, filter by length, sample n texts, split 90/5/5, build the vocabulary."""
    good, _ = quarantine(drop_missing(df, [text]), valid)
    unique = duplicates.dedup_first(good, text, row_id)
    fitting = duplicates.length_filter(unique, text, lo, hi)
    sample = materialize(sample_exact(fitting, n, row_id, seed))
    rows = split_exact(sample, row_id, {"train": 0.9, "validation": 0.05}, "holdout", seed)
    return Corpus(rows, sequences.build_vocabulary(sample, text), duplicates.prep_funnel(df, text, valid, lo, hi))


@dataclass
class Generated:
    model: DataFrame
    losses: DataFrame
    texts: DataFrame
    metrics: DataFrame
    novel: DataFrame


def generate_texts(
    corpus: DataFrame,
    text: str,
    n: int = 10_000,
    order: int = 2,
    max_length: int | None = None,
    temperature: float = 1.0,
    seed: int = 42,
    is_valid: Column | None = None,
) -> Generated:
    """Fit the generator on the training split, draw n texts, and measure them against that split.

    `is_valid` judges a generated text (column `text`); without it every non-empty text is valid.
    """
    train = duplicates.in_splits(corpus, ["train"])
    model = materialize(ngrams.fit_ngram(train, text, order))
    losses = ngrams.score_sequences(corpus, text, model, "split", order)
    if max_length is None:
        stats = sequences.token_length_stats(corpus, text)
        max_length = stats.first()["max_sequence_length"]
    drawn = ngrams.sample_sequences(model, n, max_length, order, temperature, seed)
    drawn = materialize(drawn.withColumnRenamed("generated", text))
    valid = F.length(text) > 0 if is_valid is None else is_valid
    return Generated(
        model,
        losses,
        drawn,
        duplicates.set_metrics(drawn, train, text, valid),
        duplicates.novel_rows(drawn, train, text, "id", valid),
    )
