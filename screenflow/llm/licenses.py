"""License scans: an exact set-similarity join of text blocks with license notices.

A text is cut into overlapping blocks of words; a block matches a notice when it holds at least
`threshold` of the notice's distinct words. Words are ordered by their frequency in the whole
corpus, rarest first. A block that matches must share a word with the notice's prefix, its rarest
words (prefix filter), must have enough notice words at all (length filter), and from the first
shared word on enough words must be left on both sides (positional filter). What passes is counted
exactly, so no match is lost and none is wrong.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words, the phrases that mark a license by themselves, and notices.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"  # of a text with A-Z in lower case
RAW_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"  # of a text as it is
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the software",
    ],
    "apache": [
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ],
    "cc": [
        "this work is licensed under a creative commons attribution international license",
    ],
}

THRESHOLD = 0.8
MAX_NOTICE_WORDS = 10_000  # distinct words of all notices together: they are part of the plan


def notice_words(notices: dict[str, list[str]] = NOTICES) -> list[tuple[str, list[str]]]:
    """(label, distinct words) of each notice."""
    lower = str.maketrans(UPPER, LOWER)
    some = [(label, re.findall(WORD, n.translate(lower))) for label, texts in notices.items() for n in texts]
    found = [(label, list(dict.fromkeys(w))) for label, w in some if w]
    if sum(len(w) for _, w in found) > MAX_NOTICE_WORDS:
        raise ValueError(f"the notices have more than {MAX_NOTICE_WORDS} distinct words")
    return found


def block_size(notices: list[tuple[str, list[str]]]) -> tuple[int, int]:
    """Words per block and from one block to the next: twice the longest notice lies whole in some block."""
    longest = max(len(w) for _, w in notices)
    return 4 * longest, 2 * longest


def needed(size: int, threshold: float) -> int:
    """Words of a notice of `size` distinct words that a matching block must hold."""
    return max(1, math.ceil(threshold * size - 1e-9))


def word_order(docs: DataFrame, text: str, notices: list[tuple[str, list[str]]]) -> list[str]:
    """The notices' words, rarest in the corpus first. One count per notice word comes to the driver.

    Words in capitals are left out of the counts; the order steers only how much is compared.
    """
    vocabulary = sorted({w for _, some in notices for w in some})
    all_words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(RAW_WORD), F.lit(0))
    found = docs.select(F.explode(F.filter(all_words, lambda w: w.isin(vocabulary))).alias("w"))
    n = {r["w"]: r["count"] for r in found.groupBy("w").count().collect()}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def _places(words: Column, phrase: list[str]) -> Column:
    """Where the phrase's words stand one after the other: array of word numbers from 0."""

    def start(w: Column, i: Column) -> Column:
        here = w == phrase[0]
        for k, other in enumerate(phrase[1:], 1):
            here = here & (F.get(words, i + k) == other)
        return F.when(here, i)

    return F.array_compact(F.transform(words, start))


class _Join:
    """The notices as one literal table: word numbers in corpus order, prefix, and words needed."""

    def __init__(self, notices: list[tuple[str, list[str]]], order: list[str], threshold: float):
        place = {w: i for i, w in enumerate(order)}
        ranked = [(label, sorted(place[w] for w in some)) for label, some in notices]
        need = [needed(len(r), threshold) for _, r in ranked]
        self.least = min(need)
        self.prefix_words = sorted({order[x] for (_, r), n in zip(ranked, need) for x in r[: len(r) - n + 1]})
        self.width, self.step = block_size(notices)
        rows = [
            F.struct(F.lit(label).alias("label"), _numbers(r).alias("w"), _numbers(r[: len(r) - n + 1]).alias("prefix"), F.lit(n).alias("need"))
            for (label, r), n in zip(ranked, need)
        ]
        self.table = F.array(*rows)
        self.numbers = F.map_from_arrays(F.array(*[F.lit(w) for w in order]), _numbers(range(len(order))))

    def matches(self, words: Column) -> Column:
        """Array of (label, start, containment) of every block and notice that match."""
        return F.flatten(F.transform(F.array(words), lambda ws: F.flatten(F.transform(self._blocks(ws), self._of_block))))

    def _blocks(self, words: Column) -> Column:
        """Blocks with enough notice words (length filter): start, and their notice words in order."""
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - 1), F.lit(self.step))

        def block(start: Column) -> Column:
            codes = F.transform(F.slice(words, start + 1, F.lit(self.width)), lambda w: F.element_at(self.numbers, w))
            return F.struct(start.alias("start"), F.array_sort(F.array_distinct(F.array_compact(codes))).alias("w"))

        return F.filter(F.transform(starts, block), lambda b: F.size(b["w"]) >= self.least)

    def _of_block(self, block: Column) -> Column:
        def candidate(notice: Column) -> Column:
            """Prefix filter, then the positional filter from the rarest shared prefix word on."""
            shared = F.array_min(F.array_intersect(block["w"], notice["prefix"]))
            left = [F.size(x["w"]) - F.array_position(x["w"], shared) + 1 for x in (block, notice)]
            return shared.isNotNull() & (F.least(*left) >= notice["need"])

        def counted(notice: Column) -> Column:
            both = F.size(F.array_intersect(block["w"], notice["w"]))
            return F.struct(
                notice["label"].alias("label"), block["start"].alias("start"),
                (both / F.size(notice["w"])).alias("containment"), (both >= notice["need"]).alias("enough"),
            )

        found = F.filter(F.transform(F.filter(self.table, candidate), counted), lambda m: m["enough"])
        return F.transform(found, lambda m: m.dropFields("enough"))


def _numbers(values) -> Column:
    return F.array(*[F.lit(x) for x in values])


def license_matches(
    docs: DataFrame, text: str = "text", name: str = "licenses", notices: dict[str, list[str]] = NOTICES,
    phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD,
) -> DataFrame:
    """Add what a scan of every whole text finds, as one struct column.

    Fields: `n_words`; `phrases`, an array of (label, places); `blocks`, an array of (label, start,
    containment) of all blocks of words that hold enough of a notice. A NULL text counts as empty.
    Rows are independent: repeated rows give repeated results, and other columns pass through unless
    they bear the name of the new one. Nothing is shuffled but one count per notice word.
    """
    known = notice_words(notices)
    join = _Join(known, word_order(docs, text, known), threshold)
    split = {phrase: phrase.split(" ") for phrase in phrases}
    triggers = sorted({w[0] for w in split.values()} | set(join.prefix_words))
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    raw = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(RAW_WORD), F.lit(0))

    def of(words: Column) -> Column:
        # Only texts with a first word of a phrase or a prefix word of a notice can match at all.
        worth = F.exists(words, lambda w: F.lower(w).isin(triggers))
        lowered = F.when(worth, F.transform(words, lambda w: F.translate(w, UPPER, LOWER))).otherwise(F.array().cast("array<string>"))

        def found(low: Column) -> Column:
            places = [F.struct(F.lit(label).alias("label"), _places(low, split[phrase]).alias("places")) for phrase, label in phrases.items()]
            return F.struct(
                F.size(words).cast("long").alias("n_words"), F.array(*places).alias("phrases"), join.matches(low).alias("blocks")
            )

        return F.transform(F.array(lowered), found)[0]

    return docs.select(*kept, F.transform(F.array(raw), of)[0].alias(name))


def license_digest(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: words, places of license phrases, their labels, all labels, and a score.

    The score is 1 where a phrase stands, else the largest containment of a matching notice, else 0.
    NULL and empty texts have no words, no labels and score 0. Repeated rows are returned as often as
    they occur, an empty table gives no rows, and other columns than id and text are not read.
    """
    rows = license_matches(docs.select(id, text), text, "_found", threshold=threshold).select(id, "_found.*")
    places = F.flatten(F.col("phrases.places"))
    based = F.transform(F.filter("phrases", lambda p: F.size(p["places"]) > 0), lambda p: p["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        id,
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        joined(based).alias("base_labels"),
        joined(F.concat(based, F.col("blocks.label"))).alias("labels"),
        F.greatest(
            F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.lit(0.0)),
            F.coalesce(F.array_max(F.col("blocks.containment")), F.lit(0.0)),
        ).alias("score"),
    )
