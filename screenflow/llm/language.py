"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (1 to 3 characters, a blank on
each side of a word), most frequent first. A text gets the language from whose profile its own most
frequent n-grams lie least out of place; an n-gram missing from a profile counts the profile size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenflow.llm.arrow import append_columns, small_batches, unused

PROFILE = 300  # n-grams per profile
MAX_LANGUAGES = 1000  # learned languages; more is an error
UNKNOWN = "und"
BEGINNINGS = [1 << i for i in range(9)]  # words of a taught text that stand for short texts
QUANTILE = 0.01  # of the scores of taught texts with about as many n-grams
MARGIN = 0.1  # below that quantile a text is in none of the learned languages
LEAST_TEXTS = 20  # scores that a cut-off is taken from; with fewer, those of all languages are taken together
_BITS = 21  # a code point
_CHUNK = 1 << 17  # characters whose n-grams are counted at a time

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """Which code points are letters."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def ngrams(text: str) -> np.ndarray:
    """Keys of all n-grams of the words of a text, repeats included."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _is_letter()[points]
    points = np.where(letter, points, 32)
    # Words with one blank between them, and one at either end.
    kept = letter | np.r_[True, letter[:-1]]
    points = np.r_[32, points[kept], 32]
    if len(points) > 1 and points[1] == 32:
        points = points[1:]
    if len(points) > 1 and points[-2] == 32:
        points = points[:-1]
    if len(points) < 3:
        return np.zeros(0, np.int64)
    blank = points == 32
    pairs = points[:-1] << _BITS | points[1:]
    triples = (points[:-2] << 2 * _BITS | points[1:-1] << _BITS | points[2:])[~blank[1:-1]]
    return np.concatenate([points[~blank], pairs, triples])


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text in ascending order, and how often each occurs.

    Long texts are taken in parts cut at non-letters, so memory follows the part, not the text.
    """
    if len(text) <= _CHUNK:
        return np.unique(ngrams(text), return_counts=True)
    keys, counts, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while at < len(text):
        end = min(len(text), at + _CHUNK)
        while end < len(text) and text[end].isalpha():
            end += 1
        k, c = np.unique(ngrams(text[at:end]), return_counts=True)
        keys, back = np.unique(np.r_[keys, k], return_inverse=True)
        counts = np.bincount(back, weights=np.r_[counts, c], minlength=len(keys)).astype(np.int64)
        at = end
    return keys, counts


def most_frequent(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent n-grams, most frequent first, ties by key."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


def fit_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """`lang`, `rank` (from 0), `ngram`: the profile of each language, from all texts that bear it.

    Rows without text or language are left out. N-grams are counted within each task before counts
    of one n-gram meet, so a language that most rows bear is no heavier than others.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            held: dict[str, list[str]] = {}
            room = _CHUNK

            def flush():
                for name, parts in held.items():
                    keys, counts = counted(" ".join(parts))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(counts)],
                        names=["lang", "ngram", "n"],
                    )
                held.clear()

            for name, value in zip(langs, texts):
                part = value.as_py()
                held.setdefault(name, []).append(part)
                room -= len(part)
                if room < 0:
                    yield from flush()
                    room = _CHUNK
            yield from flush()

    small_batches(labelled)
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sums = rows.mapInArrow(count, "lang string, ngram long, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "ngram")
    ranked = sums.withColumn("rank", F.row_number().over(order) - 1)
    return ranked.where(F.col("rank") < size).select("lang", "rank", "ngram")


class Classifier:
    """The profiles as arrays: all their n-grams, sorted, and each one's rank per language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        place = {name: i for i, name in enumerate(self.langs)}
        self.keys = np.array(sorted({r[2] for r in rows}), np.int64)
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int64)
        for name, rank, key in rows:
            self.ranks[np.searchsorted(self.keys, key), place[name]] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and a score from 0 (nothing in place) to 1 (all in place)."""
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, int]:
        """The language, its score, and how many n-grams of the text were compared."""
        if not text or not self.langs:
            return UNKNOWN, 0.0, 0
        own = most_frequent(*counted(text), self.size)
        if not len(own):
            return UNKNOWN, 0.0, 0
        at = np.searchsorted(self.keys, own)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == own
        ranks = self.ranks[np.where(known, at, len(self.keys))]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None]))
        distance = away.sum(axis=0)
        best = int(np.argmin(distance))  # of equal distances the first language by name
        return self.langs[best], 1.0 - float(distance[best]) / (self.size * len(own)), len(own)


def classifier(profiles: DataFrame, size: int = PROFILE, max_languages: int = MAX_LANGUAGES) -> Classifier:
    """The profiles on the driver: at most `size` rows for each of at most `max_languages` languages."""
    rows = profiles.limit(size * max_languages + 1).collect()
    if len(rows) > size * max_languages:
        raise ValueError(f"more than {max_languages} languages")
    return Classifier([(r["lang"], r["rank"], r["ngram"]) for r in rows], size)


def with_language(docs: DataFrame, model: Classifier, text: str = "text", lang: str = "lang_pred", score: str = "score", drop: bool = False) -> DataFrame:
    """Add the predicted language and score of every whole text; `und` without any letter or for NULL."""

    def work(column):
        return [list(x) for x in zip(*[model.predict(t) for t in column.to_pylist()])] or [[], []]

    return append_columns(docs, text, {lang: T.StringType(), score: T.DoubleType()}, work, drop)


def beginnings(text: str) -> list[str]:
    """The first 1, 2, 4, ... words of a text, and the whole."""
    begun = text.split(None, BEGINNINGS[-1])
    return [" ".join(begun[:n]) for n in BEGINNINGS if n < len(begun)] + [text]


Cutoffs = dict[tuple[str | None, int], float]  # language (None: all), bits of the number of n-grams


def fit_cutoffs(taught: DataFrame, model: Classifier, text: str = "text") -> Cutoffs:
    """The least score of each language for texts of each size, from the scores of all taught texts.

    A size is the number of bits of the number of compared n-grams. Beginnings of the taught texts
    are scored like texts, so that short texts are measured against short ones.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.judge(part) for t in batch.column(0) for part in beginnings(t.as_py())]
            rows = [(lang, n.bit_length(), round(1000 * value)) for lang, value, n in found if n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())],
                names=["lang", "bits", "score"],
            )

    small_batches(taught)
    rows = taught.where(F.col(text).isNotNull()).select(text).mapInArrow(score, "lang string, bits int, score int")
    counts = rows.groupBy("lang", "bits", "score").agg(F.count(F.lit(1)).alias("n"))
    # At most 1,001 distinct scores for each language and size.
    low = counts.rollup("bits", "lang").agg(F.percentile("score", F.lit(QUANTILE), F.col("n")).alias("low"), F.sum("n").alias("n"))
    found = low.where(F.col("bits").isNotNull() & (F.col("n") >= LEAST_TEXTS)).collect()
    return {(r["lang"], r["bits"]): r["low"] / 1000 - MARGIN for r in found}


def known(judged: tuple[str, float, int], cutoffs: Cutoffs, least: float) -> bool:
    """Whether a text with this language, score and size is in a learned language."""
    lang, score, n = judged
    bits = n.bit_length()
    return lang != UNKNOWN and score >= max(least, cutoffs.get((lang, bits), cutoffs.get((None, bits), least)))


def held_out(id: str = "doc_id"):
    """Whether a document is kept out of learning: crc32 of its id as text, modulo 4, is 2 (NULL: as empty)."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def language_digest(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """Per document: whether it was held out of learning, its predicted language, and the score.

    Rows with a NULL language or text teach nothing; with no labelled row at all every text is `und`.
    Repeated rows teach and are predicted as often as they occur.
    """
    taught = docs.select(id, text, lang).where(~held_out(id))
    model = classifier(fit_profiles(taught, text, lang, size), size)
    rows = docs.select(id, text, held_out(id).alias("held_out"))
    return with_language(rows, model, text, drop=True)


def keep_known(docs: DataFrame, least: float, id: str = "doc_id", text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """Documents in one of the learned languages: with a letter and a score that its taught texts reach.

    The score a text needs goes by its language and size (`fit_cutoffs`) and is never below `least`;
    it is `least` where fewer than LEAST_TEXTS taught texts tell.
    """
    taught = docs.select(id, text, lang).where(~held_out(id))
    model = classifier(fit_profiles(taught, text, lang, size), size)
    cutoffs = fit_cutoffs(taught.where(F.col(lang).isNotNull()), model, text)
    mark = unused(docs, "_known")

    def work(column):
        return [[known(model.judge(t), cutoffs, least) for t in column.to_pylist()]]

    return append_columns(docs, text, {mark: T.BooleanType()}, work).where(F.col(mark)).select(*docs.columns)
