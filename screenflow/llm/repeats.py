"""Repeated strings of `width` bytes, by prefix-free parsing.

Triggers of a rolling hash (its smallest value in every stretch of positions) cut each text into
phrases; a phrase is kept with the `width` bytes that its last windows reach into. The distinct
phrases are the dictionary, their places in the texts the parse. Where a phrase occurs more than
once in the parse, so does every window in it. What is left are phrases that occur once but share
the bytes after their trigger with another one: of these a suffix array is built, to the depth of a
window, and the order of the corpus follows from it and from how often the parse has each phrase:
windows of equal rank that occur more than once in all are repeated.

Triggers depend on bytes inside a window only, so equal windows have the same trigger at the same
place and meet under its key. Copies inside a batch are settled there and cost one row in the
shuffle, so a passage in a third of all documents is spread over as many tasks as there are batches.
Keys of more than `max_group` distinct phrases go window by window, which needs no group at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenflow.functions.skew import salted_join
from screenflow.llm.arrow import append_columns, small_batches, unused
from screenflow.session import materialize, written

WIDTH = 400
HASHED = 8  # bytes under the rolling hash
CORE = 64  # bytes from the trigger on that make its key
MAX_GROUP = 20_000  # distinct phrases of one key that are ordered together
_PIECE = 1 << 20  # bytes parsed at a time
_SORTED = 1 << 20  # bytes of phrases ordered at a time, plus those of one key
_BITS = 24  # of a place inside a piece, below the hash
_MIX = np.uint64(0x9E3779B97F4A7C15)
_DONE, _PHRASE = 0, 1  # rows of the parse: windows known to repeat; a phrase, once per batch

PARSE = "kind int, route long, d1 long, d2 long, key long, weight int, u binary, low long, high long, at long"
_PARSE_NAMES = [c.split()[0] for c in PARSE.split(", ")]
_PARSE_KINDS = [pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.binary(), *[pa.int64()] * 3]
STARTS = "u binary, low long, high long"
_STARTS_KINDS = [pa.binary(), pa.int64(), pa.int64()]


def text_key(data: bytes) -> bytes:
    """What tells texts apart: the first half of their SHA-256."""
    return hashlib.sha256(data).digest()[:16]


def _text_key_column(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def _digest(data: bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def _smallest(values: np.ndarray, reach: int) -> np.ndarray:
    """The smallest of each `reach` values in a row."""
    done, out = 1, values
    while 2 * done <= reach:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = reach - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def phrases(data: bytes, width: int = WIDTH, core: int = CORE) -> np.ndarray:
    """Phrases of at most _PIECE + width bytes as rows (first window, last window, trigger)."""
    if len(data) < width:
        return np.zeros((0, 3), np.int64)
    words = np.ndarray(len(data) - HASHED + 1, "<u8", data, strides=(1,)).copy()
    words ^= words >> np.uint64(29)
    words *= _MIX
    words &= np.uint64((1 << 64) - (1 << _BITS))
    words |= np.arange(len(words), dtype=np.uint64)  # of equal hashes the first
    place = (_smallest(words, width - core + 1)[: len(data) - width + 1] & np.uint64((1 << _BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    return np.stack([first, last, place[first]], axis=1)


def _signed(data: bytes) -> int:
    return int.from_bytes(data, "big", signed=True)


def parsed(texts: list[bytes], width: int, core: int) -> list[tuple]:
    """The parse of a batch of texts: phrases, one row for all their copies in the batch, and copies' windows."""
    dictionary: dict[bytes, list] = {}
    for data in texts:
        u = text_key(data)
        for start in range(0, max(1, len(data) - width + 1), _PIECE):
            piece = data[start : start + _PIECE + width - 1]
            for low, high, at in phrases(piece, width, core).tolist():
                found = dictionary.setdefault(_digest(piece[low : high + width]), [_signed(_digest(piece[at : at + core], 8))])
                found.append((u, start + low, start + high, start + at))
    rows = []
    for d, (key, *places) in dictionary.items():
        d1, d2 = _signed(d[:8]), _signed(d[8:])
        rows.append((_PHRASE, d1, d1, d2, key, min(2, len(places)), *places[0]))
        if len(places) > 1:  # dealt out by text, not by digest: there may be very many
            rows += [(_DONE, _signed(u[:8]) ^ (low << 16), 0, 0, 0, 0, u, low, high, at) for u, low, high, at in places[1:]]
    return rows


def _out(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _parse(width: int, core: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, size = [], 0
            for value in batch.column(0):
                data = (value.as_py() or "").encode()
                texts.append(data)
                size += len(data)
                if size > 4 * _PIECE:  # very long texts go on alone
                    yield _out(parsed(texts, width, core), _PARSE_NAMES, _PARSE_KINDS)
                    texts, size = [], 0
            yield _out(parsed(texts, width, core), _PARSE_NAMES, _PARSE_KINDS)

    return work


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by digest: windows of phrases that occur twice, and every distinct phrase once."""
    now: tuple | None = None
    waiting: tuple | None = None  # the first row of a phrase, until it is known whether there is another
    for batch in batches:
        rows = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] == _DONE:
                rows.append(row)
                continue
            if row[2:4] != now:
                if waiting:
                    rows.append(waiting)
                now, waiting = row[2:4], row
                if row[5] > 1:
                    rows += [row, (_DONE, *row[1:])]
                    waiting = None
                continue
            if waiting:  # now it has company
                rows += [(*waiting[:5], 2, *waiting[6:]), (_DONE, *waiting[1:])]
                waiting = None
            rows.append((_DONE, *row[1:]))
        yield _out(rows, _PARSE_NAMES, _PARSE_KINDS)
    yield _out([waiting] if waiting else [], _PARSE_NAMES, _PARSE_KINDS)


def window_ranks(data: bytes, windows: np.ndarray, width: int) -> np.ndarray:
    """Rank of the window at each of these places: the order of the suffixes to the depth of a window.

    Ranks of strings of 8 bytes, then of two or three times as many and so on, from ranks of their parts.
    """
    room = data + bytes(2 * width)
    depth = min(8, 1 << (width.bit_length() - 1))
    ranks = np.unique(np.ndarray(len(room) - 8, f">u{depth}", room, strides=(1,)), return_inverse=True)[1].astype(np.int64)
    while depth < width:
        n = int(ranks.max(initial=0)) + 1
        three = n**3 < 2**63 and width > 2 * depth
        reach = min(width, (3 if three else 2) * depth)
        at = windows if reach == width else np.arange(len(ranks) - reach + depth)
        # The last part may overlap the one before it: strings equal so far first differ inside it.
        joined = ranks[at] * n + ranks[at + depth] if three else ranks[at]
        ranks = np.unique(joined * n + ranks[at + reach - depth], return_inverse=True)[1]
        depth = reach
        if reach == width:
            return ranks
    return np.unique(ranks[windows], return_inverse=True)[1]


def _repeated(rows: list[tuple], width: int) -> list[tuple]:
    """Windows (u, low, high) of phrases that occur once which occur in another phrase too."""
    counts = np.array([len(r[5]) - width + 1 for r in rows])
    starts = np.cumsum([0, *[len(r[5]) for r in rows[:-1]]])
    owner = np.repeat(np.arange(len(rows)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    ranks = window_ranks(b"".join(r[5] for r in rows), starts[owner] + inside, width)
    weight = np.array([r[1] for r in rows])[owner]
    hit = (np.bincount(ranks, weight)[ranks] > 1) & (weight == 1)
    where = np.flatnonzero(hit)
    if not len(where):
        return []
    breaks = np.flatnonzero((np.diff(where) > 1) | (np.diff(owner[where]) > 0))
    out = []
    for a, b in zip(np.r_[0, breaks + 1], np.r_[breaks, len(where) - 1]):
        _, _, u, low, _, _ = rows[owner[where[a]]]
        out.append((u, low + int(inside[where[a]]), low + int(inside[where[b]])))
    return out


CONTENTS = "key long, weight int, u binary, low long, high long, content binary, n long"


def _contents(width: int) -> Callable:
    """The bytes of wanted phrases."""
    names = [c.split()[0] for c in CONTENTS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                u, text, wanted = (batch.column(c)[i].as_py() for c in ("u", "_text", "wanted"))
                data = text.encode()
                for w in wanted:
                    rows.append((w["key"], w["weight"], u, w["low"], w["high"], data[w["low"] : w["high"] + width], w["n"]))
                    size += w["high"] - w["low"] + width
                    if size > _PIECE:
                        yield _out(rows, names, kinds)
                        rows, size = [], 0
            yield _out(rows, names, kinds)

    return work


def _ordered(width: int) -> Callable:
    """Phrases sorted by key: whole keys together, up to a size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, from_here = 0, 0  # bytes held; where the last key begins
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[-1][0]:
                    from_here = len(held)
                    if size > _SORTED:
                        yield _out(_repeated(held, width), ["u", "low", "high"], _STARTS_KINDS)
                        held, size, from_here = [], 0, 0
                held.append(row)
                size += len(row[5])
        yield _out(_repeated(held, width) if held else [], ["u", "low", "high"], _STARTS_KINDS)

    return work


WINDOWS = "d1 long, d2 long, weight int, u binary, low long"


def _window_rows(width: int) -> Callable:
    """Every window of phrases under crowded keys by itself."""
    names = [c.split()[0] for c in WINDOWS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, weight, u, low, high, content in zip(*(c.to_pylist() for c in batch.columns)):
                for o in range(high - low + 1):
                    d = _digest(content[o : o + width])
                    rows.append((_signed(d[:8]), _signed(d[8:]), weight, u, low + o))
                if len(rows) > 20_000:
                    yield _out(rows, names, kinds)
                    rows = []
            yield _out(rows, names, kinds)

    return work


def repeated_starts(
    docs: DataFrame, text: str = "text", width: int = WIDTH, core: int = CORE, max_group: int = MAX_GROUP
) -> DataFrame:
    """`u`, `low`, `high`: stretches of places where windows begin that occur more than once, by `text_key`.

    Texts are UTF-8 bytes; NULL texts are empty. Stretches of a text may meet, overlap or repeat.
    """
    if not HASHED <= core < width:
        raise ValueError(f"core must be at least {HASHED} and below width")
    small_batches(docs)
    texts = docs.select(F.coalesce(text, F.lit("")).alias("_text"))
    parse = texts.mapInArrow(_parse(width, core), PARSE)
    merged = parse.repartition("route").sortWithinPartitions("d1", "d2").mapInArrow(_merged, PARSE)
    merged = written(merged.select("kind", "key", "weight", "u", "low", "high"))
    done = merged.where(F.col("kind") == _DONE).select("u", "low", "high")
    distinct = merged.where(F.col("kind") == _PHRASE).select("key", "weight", "u", "low", "high")
    # A phrase under a key of its own has no window in common with another one, nor have phrases
    # under a key where all are known to repeat anything left to find.
    keys = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("least"))
    shared = keys.where("n > 1 AND least = 1").drop("least")
    open_phrases = salted_join(distinct, shared, ["key"], "n", ["u", "low"])
    wanted = open_phrases.groupBy("u").agg(F.collect_list(F.struct("key", "weight", "low", "high", "n")).alias("wanted"))
    once = texts.select(_text_key_column(F.col("_text")).alias("u"), "_text").groupBy("u").agg(F.first("_text").alias("_text"))
    having = written(once.join(wanted, "u").mapInArrow(_contents(width), CONTENTS))
    few, many = (having.where(c).drop("n") for c in (F.col("n") <= max_group, F.col("n") > max_group))
    ranked = few.repartition("key").sortWithinPartitions("key").mapInArrow(_ordered(width), STARTS)
    single = many.mapInArrow(_window_rows(width), WINDOWS)
    twice = single.groupBy("d1", "d2").agg(F.sum("weight").alias("n")).where("n > 1")
    crowded = salted_join(single.where("weight = 1"), twice, ["d1", "d2"], "n", ["u", "low"], "left_semi")
    return done.unionByName(ranked).unionByName(crowded.select("u", "low", F.col("low").alias("high")))


def repeat_spans(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    name: str = "repeats",
    width: int = WIDTH,
    core: int = CORE,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Add the stretches (start, end) of bytes that are covered by strings of `width` bytes found elsewhere too.

    Stretches are in order, apart from each other, end exclusive; all strings are judged on the texts as
    given, overlapping ones of one text included. NULL, empty and shorter texts have none; repeated
    rows cover each other whole. Other columns pass through unless they bear the new one's name.
    """
    starts = repeated_starts(docs, text, width, core, max_group)
    u, copies = unused(docs, "_u"), unused(docs, "_copies")
    keyed = docs.drop(name).withColumn(u, _text_key_column(F.col(text)))
    number = keyed.groupBy(u).agg(F.count(F.lit(1)).alias(copies))
    per_text = starts.groupBy(F.col("u").alias(u)).agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias(name))
    per_text = materialize(per_text.join(number, u))  # read twice
    joined = salted_join(keyed, per_text, [u], copies, [id], "left").drop(u, copies)
    return _with_stretches(joined, name, width)


def joined_stretches(starts: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the covered stretches; `starts` has sorted (low, high) of windows' beginnings per row."""
    sizes = np.diff(starts.offsets.to_numpy())
    flat = starts.flatten()
    low, high = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    row = np.repeat(np.arange(len(sizes)), np.where(starts.is_null().to_numpy(zero_copy_only=False), 0, sizes))
    far = int(high.max(initial=0)) + width + 1  # rows are laid end to end, so that one running maximum does
    reach = np.maximum.accumulate(row * far + high + width)
    new = np.r_[True, row[1:] * far + low[1:] > reach[:-1]] if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(row)][: len(first)] - 1
    return row[first], low[first], reach[last] - row[first] * far


def _with_stretches(joined: DataFrame, name: str, width: int) -> DataFrame:
    def work(column: pa.Array) -> list[list]:
        out: list[list[dict]] = [[] for _ in range(len(column))]
        for row, start, end in zip(*(x.tolist() for x in joined_stretches(column, width))):
            out[row].append({"start": start, "end": end})
        return [out]

    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return append_columns(joined, name, {name: spans}, work)


def repeat_digest(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document: bytes, bytes and stretches removed, and the digest of what is left (see `repeat_spans`)."""
    spans = repeat_spans(docs.select(id, text), id, text, "_spans", width)
    both = spans.select(id, F.struct(text, "_spans").alias("_both"))

    def work(column: pa.StructArray) -> list[list]:
        out: list[list] = [[], [], [], []]
        for given, found in zip(column.field(0).to_pylist(), column.field(1).to_pylist()):
            data = (given or "").encode()
            at, kept = 0, hashlib.sha256()
            for x in found:
                kept.update(data[at : x["start"]])
                at = x["end"]
            kept.update(data[at:])
            values = len(data), sum(x["end"] - x["start"] for x in found), len(found), kept.hexdigest()
            for column_values, v in zip(out, values):
                column_values.append(v)
        return out

    fields = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType()}
    return append_columns(both, "_both", fields, work, drop=True)
