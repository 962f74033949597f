"""The tokens of `functions/text.py` cut and looked up in Python, on Arrow batches.

In SQL expressions a text's tokens are objects of their own, and a map is searched entry by entry for
every token; here single characters are read off the text's code points.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from screenflow.functions import text as tx

# The tokens of more than one character; every other character but a line break is a token.
LONG = re.compile(r"(\[[^\[\]]+\]|Br|Cl|Si|Se|@@|%[0-9]{2})")
ROWS_PER_BATCH = 500  # whole texts: Spark's default of 10,000 rows can be gigabytes
ENTRIES = 500_000  # of a task's counts or remembered numbers at a time
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, with the session's rows per Arrow batch lowered to what whole texts allow."""
    conf = df.sparkSession.conf
    now = int(conf.get(_BATCH_CONF))
    if now <= 0 or now > ROWS_PER_BATCH:
        conf.set(_BATCH_CONF, str(ROWS_PER_BATCH))
    return df


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most `rows` rows in an Arrow batch of what is worked out inside, whose rows hold many packed rows each."""
    before = spark.conf.get(_BATCH_CONF)
    spark.conf.set(_BATCH_CONF, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_CONF, before)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows of every run of equal keys."""
    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
            if held and keys[lo] != at:
                yield int(at), pa.Table.from_batches(held)
                held = []
            at = keys[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield int(at), pa.Table.from_batches(held)


def split(text: str) -> Sequence[str]:
    """The tokens of a text: itself without line breaks, if all are single characters."""
    pieces = LONG.split(text)
    if len(pieces) == 1:
        return text.replace("\n", "")
    found: list[str] = []
    for k, piece in enumerate(pieces):
        if k % 2:
            found.append(piece)
        else:
            found.extend(piece.replace("\n", ""))
    return found


def token_count(text: Column) -> Column:
    """How many tokens a text has; NULL for NULL."""

    def count(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else len(split(t)) for t in texts.to_pylist()], pa.int32())

    return F.arrow_udf(count, "int")(text)


def distinct_tokens(text: Column) -> Column:
    """The tokens of a text, each once."""

    def find(texts: pa.Array) -> pa.Array:
        found = []
        for t in texts.to_pylist():
            pieces = [] if t is None else LONG.split(t)
            found.append(None if t is None else list({c for p in pieces[::2] for c in set(p)} - {"\n"} | set(pieces[1::2])))
        return pa.array(found, pa.list_(pa.string()))

    return F.arrow_udf(find, "array<string>")(text)


def token_ids(text: Column, entries: Column) -> Column:
    """The ids of a text's tokens with both ends, by the map `entries` from token to id; UNK for others."""

    def look_up(texts: pa.Array, tokens: pa.Array, numbers: pa.Array) -> pa.Array:
        found = []
        for t, names, values in zip(texts.to_pylist(), tokens.to_pylist(), numbers.to_pylist()):
            if t is None:
                found.append(None)
                continue
            known = dict(zip(names, values))
            codes = np.frombuffer(t.encode("utf-32-le"), "<u4")
            table = np.full(int(codes.max(initial=0)) + 1, tx.UNK_ID, np.int32)
            for name, value in known.items():
                if len(name) == 1 and ord(name) < len(table):
                    table[ord(name)] = value
            ids, kept = table[codes], codes != 10
            for m in LONG.finditer(t):
                kept[m.start() : m.end()] = False
                kept[m.start()] = True
                ids[m.start()] = known.get(m.group(), tx.UNK_ID)
            found.append(np.concatenate([[tx.BOS_ID], ids[kept], [tx.EOS_ID]]).astype(np.int32))
        return pa.array(found, pa.list_(pa.int32()))

    return F.arrow_udf(look_up, "array<int>")(text, F.map_keys(entries), F.map_values(entries))


def token_ids_by(text: Column, entries: dict[str, int]) -> Column:
    """As `token_ids`, by entries that every task holds."""

    def look_up(texts: pa.Array) -> pa.Array:
        single = {ord(t): i for t, i in entries.items() if len(t) == 1}
        table = np.full(max(single, default=0) + 2, tx.UNK_ID, np.int32)  # the last place stands for all codes beyond
        table[list(single)] = list(single.values())
        found = []
        for t in texts.to_pylist():
            if t is None:
                found.append(None)
                continue
            codes = np.frombuffer(t.encode("utf-32-le"), "<u4")
            ids, kept = table[np.minimum(codes, len(table) - 1)], codes != 10
            for m in LONG.finditer(t):
                kept[m.start() : m.end()] = False
                kept[m.start()] = True
                ids[m.start()] = entries.get(m.group(), tx.UNK_ID)
            found.append(np.concatenate([[tx.BOS_ID], ids[kept], [tx.EOS_ID]]).astype(np.int32))
        return pa.array(found, pa.list_(pa.int32()))

    return F.arrow_udf(look_up, "array<int>")(text)


def distinct_ids(ids: Column) -> Column:
    """The numbers of an array, each once."""

    def find(lists: pa.Array) -> pa.Array:
        found = [None if v is None else np.unique(v.drop_null().to_numpy(zero_copy_only=False)) for v in (x.values for x in lists)]
        return pa.array(found, pa.list_(pa.int32()))

    return F.arrow_udf(find, "array<int>")(ids)


def spelled(ids: Column, names: Column, tokens: Column, skip: list[int]) -> Column:
    """The text of `ids` up to the first EOS, without those in `skip`, by parallel arrays; of equal names the last holds."""

    def write(lists: pa.Array, keys: pa.Array, texts: pa.Array) -> pa.Array:
        found = []
        for x, names, tokens in zip(lists, keys.to_pylist(), texts.to_pylist()):
            if x.values is None:
                found.append(None)
                continue
            known = {i: t for i, t in zip(names, tokens) if t is not None and i not in skip}
            v = x.values.drop_null().to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(v == tx.EOS_ID)
            v = v[: ends[0]] if len(ends) else v
            found.append("".join([known.get(i, "") for i in v.tolist()]))
        return pa.array(found, pa.string())

    return F.arrow_udf(write, "string")(ids, names, tokens)


def spelled_by(ids: Column, entries: dict[int, str], skip: list[int]) -> Column:
    """As `spelled`, by entries that every task holds."""
    known = {i: t for i, t in entries.items() if i not in skip}

    def write(lists: pa.Array) -> pa.Array:
        found = []
        for x in lists:
            if x.values is None:
                found.append(None)
                continue
            v = x.values.drop_null().to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(v == tx.EOS_ID)
            found.append("".join(map(known.get, (v[: ends[0]] if len(ends) else v).tolist(), repeat(""))))
        return pa.array(found, pa.string())

    return F.arrow_udf(write, "string")(ids)


def run_bits(text: Column, n_bits: int, radius: int) -> Column:
    """`token_bits` of a text's tokens."""

    def mark(texts: pa.Array) -> pa.Array:
        marks = _MARKS.setdefault((n_bits, radius), RunBits(n_bits, radius))
        return pa.array([None if t is None else marks.of(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(mark, "array<int>")(text)


class RunBits:
    """The bits of runs of tokens. Tokens are numbered as they are met, and a run of numbers is looked up in a table.

    A worker has numbers for ALPHABET tokens and tables for runs of up to three; other texts and runs go by their names.
    """

    def __init__(self, n_bits: int, radius: int) -> None:
        self.n_bits, self.radius = n_bits, radius
        self.bits: dict[str, int] = {}
        self.names: list[str] = []
        self.number: dict[str, int] = {}
        self.of_character = np.full(0x110000, -1, np.int16)
        self.tables = [np.full(ALPHABET ** (k + 1), -1, np.int32) for k in range(radius + 1)] if radius <= 2 else []

    def of(self, text: str) -> np.ndarray:
        numbers = self.numbers(text) if self.tables else None
        if numbers is None:
            return np.array(sorted({self.bit(g) for g in self.runs(split(text))}), np.int32)
        marks, run = np.zeros(self.n_bits, bool), numbers
        for k, table in enumerate(self.tables):
            if k:
                run = run[:-1] * ALPHABET + numbers[k:]
            found = table[run]
            if len(found) and found.min() < 0:
                for new in np.unique(run[found < 0]).tolist():
                    rest, name = new, ""
                    for _ in range(k + 1):
                        rest, last = divmod(rest, ALPHABET)
                        name = self.names[last] + name
                    table[new] = self.bit(name)
                found = table[run]
            marks[found] = True
        return np.flatnonzero(marks).astype(np.int32)

    def numbers(self, text: str) -> np.ndarray | None:
        """The numbers of a text's tokens, or None if there are no more numbers."""
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        found, kept = self.of_character[codes].astype(np.int64), codes != 10
        for m in LONG.finditer(text):
            kept[m.start() : m.end()] = False
            kept[m.start()] = True
            found[m.start()] = self.number_of(m.group())
        unknown = kept & (found < 0)
        if unknown.any():
            for code in np.unique(codes[unknown]).tolist():
                self.of_character[code] = self.number_of(chr(code))
            single = unknown & (self.of_character[codes] >= 0)
            found[single] = self.of_character[codes[single]]
        found = found[kept]
        return None if len(found) and found.min() < 0 else found

    def number_of(self, token: str) -> int:
        """-1 if all numbers are taken."""
        if token not in self.number:
            if len(self.names) == ALPHABET:
                return -1
            self.number[token] = len(self.names)
            self.names.append(token)
        return self.number[token]

    def runs(self, tokens: Sequence[str]) -> set[str]:
        grams, run = set(tokens), tokens
        for k in range(1, self.radius + 1):
            run = list(map(add, run, tokens[k:]))
            grams.update(run)
        return grams

    def bit(self, name: str) -> int:
        if name not in self.bits:
            if len(self.bits) > ENTRIES:
                self.bits.clear()
            self.bits[name] = int(hashlib.md5(name.encode()).hexdigest()[:8], 16) % self.n_bits
        return self.bits[name]


ALPHABET = 200  # tokens with a number; 32 MB for the runs of three
_MARKS: dict[tuple[int, int], RunBits] = {}  # of a worker


def transition_counts(df: DataFrame, text: str, order: int, keep: list[str] | None = None) -> DataFrame:
    """(*keep, context, next, count): how often a token follows a context of at most `order` tokens, BOS and EOS included.

    Tasks count their texts before anything is shuffled.
    """
    rows = small_batches(df).where(F.col(text).isNotNull()).select(*(keep or []), F.col(text).alias("_text"))
    kept = [f for f in rows.schema.fields if f.name != "_text"]
    schema = T.StructType([*kept, *T.StructType.fromDDL("context array<string>, next string, count long").fields])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    first = max(order, 1)  # the place of the first token with a whole context

    def batch_of(counts: dict[tuple, Counter]) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in kinds]
        for group, counter in counts.items():
            for run, n in counter.items():
                for column, value in zip(columns, (*group, list(run[:-1]), run[-1], n)):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = {}
        for batch in batches:
            groups = zip(*[batch.column(f.name).to_pylist() for f in kept]) if kept else [()] * batch.num_rows
            for group, t in zip(groups, batch.column("_text").to_pylist()):
                counter = counts.setdefault(group, Counter())
                s = [tx.BOS, *split(t), tx.EOS]
                counter.update(tuple(s[: i + 1]) for i in range(1, min(first, len(s))))
                counter.update(zip(*[s[first - order + k :] for k in range(order + 1)]))
            if sum(map(len, counts.values())) > ENTRIES:
                yield batch_of(counts)
                counts = {}
        yield batch_of(counts)

    partial = rows.mapInArrow(count, schema)
    return partial.groupBy(*[f.name for f in kept], "context", "next").agg(F.sum("count").alias("count"))
