"""Hard negatives through a secondary sort: scores arrive per anchor in falling order and are never held.

Pairs are keyed by (anchor, falling score, id); one shuffle deals them out by anchor and sorts them
inside the partitions (repartitionAndSortWithinPartitions, in DataFrame terms), and an iterator walks
down each anchor's scores: a positive opens its window of scores, a negative inside open windows is
passed on, a window that is full or lies above is closed. The iterator holds the open windows only.

Before the shuffle every task cuts its pairs down to those that can be in the result: first an
anchor's best positives, then, with the windows these open, the best negatives of each window. So
what is shuffled grows with anchors times tasks, not with anchors times rows. Anchors visit the rows
in blocks of bounded size; rows never move after they are dealt out once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenflow.session import materialize

ANCHORS_PER_BLOCK = 2048
BLOCK_BYTES = 16 << 20  # vectors of one block of anchors, as they are sent to the tasks
ROWS_PER_TASK = 65_536
_ROWS_AT_ONCE = 1024  # rows of a task compared with a block of anchors at a time
_SCALE = 256
_NONE = np.iinfo(np.int64).min
PAIRS = "anchor long, anchor_id long, score long, kind int, vec_id long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Rules:
    """Positives per anchor, negatives per positive, and a window's bounds in hundredths of the positive's score."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95


def usable(table: DataFrame, id: str, label: str, vector: str, shift_every: int, labels: int) -> DataFrame:
    """`uid`, `vec_id`, `label`, `vec`: rows that take part, told apart by `uid` even where ids repeat."""
    key = F.col(id).cast("long")
    value = F.col(label).cast("long")
    shifted = F.when(key % shift_every == 0, (value + 1) % labels).otherwise(value)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fits = F.col(label).isNotNull() & F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))
    return table.where(fits).select(
        F.monotonically_increasing_id().alias("uid"), key.alias("vec_id"), shifted.alias("label"), F.col(vector).alias("vec")
    )


def integers(flat: np.ndarray) -> np.ndarray:
    """floor(256 * x) as doubles, which hold these integers exactly."""
    with np.errstate(over="ignore"):
        return np.floor(_SCALE * flat.astype(np.float64))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of `a` and `b` (integer-valued doubles)."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.abs(a).max(initial=0.0)) * float(np.abs(b).max(initial=0.0)) * a.shape[1]
    if bound < 2**53:  # every partial sum is an integer that a double holds
        return (a @ b.T).astype(np.int64)
    if bound < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    if max(abs(x) for x in exact.flat) > np.iinfo(np.int64).max:
        raise OverflowError("an inner product does not fit a long")
    return exact.astype(np.int64)


class Best:
    """The best `k` rows of each anchor so far, by falling score, then id (NULL last)."""

    def __init__(self, k: int):
        self.k = k
        self.rows: tuple[np.ndarray, ...] = tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64, np.int64))

    def add(self, found: np.ndarray, anchors: np.ndarray, ids: np.ndarray, no_id: np.ndarray, uids: np.ndarray) -> None:
        """`found`: scores, anchors by rows, _NONE where a pair does not count."""
        least = np.int64(_NONE + 1)
        if found.shape[1] > self.k:
            least = np.maximum(np.partition(found, found.shape[1] - self.k, axis=1)[:, -self.k], least)[:, None]
        a, r = np.nonzero(found >= least)
        new = anchors[a], found[a, r], no_id[r], ids[r], uids[r]
        anchor, score, none, id, uid = (np.concatenate(x) for x in zip(self.rows, new))
        order = np.lexsort((uid, id, none, -score, anchor))
        starts = np.searchsorted(anchor[order], anchor[order], side="left")
        order = order[np.arange(len(order)) - starts < self.k]
        self.rows = anchor[order], score[order], none[order], id[order], uid[order]


def _by_length(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the vectors of each length, and those vectors as integers."""
    lengths = np.diff(lists.offsets.to_numpy())
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, integers(lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)).reshape(len(at), int(n))


class Anchors:
    """A block of anchors, sent to the tasks as plain arrays; vectors meet vectors of their length only."""

    def __init__(self, rows: list, rules: Rules):
        self.rules = rules
        self.uid = np.array([r["uid"] for r in rows], np.int64)
        self.id = np.array([r["vec_id"] for r in rows], np.int64)
        self.label = np.array([r["label"] for r in rows], np.int64)
        self.groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(r["vec"]) for r in rows}):
            at = [i for i, r in enumerate(rows) if len(r["vec"]) == n]
            self.groups[n] = np.array(at), integers(np.array([rows[i]["vec"] for i in at], np.float64)).reshape(len(at), n)
        # Windows of whole scores; without a positive an empty one.
        self.low = np.ones((len(rows), rules.positives), np.int64)
        self.high = np.zeros((len(rows), rules.positives), np.int64)

    def open_windows(self, positives: list) -> None:
        place = {int(u): i for i, u in enumerate(self.uid)}
        filled = np.zeros(len(self.uid), int)
        for p in positives:
            i, score = place[p["anchor"]], p["score"]
            self.low[i, filled[i]] = -(-self.rules.low * score // 100)
            self.high[i, filled[i]] = self.rules.high * score // 100
            filled[i] += 1

    def search(self, batches: Iterator[pa.RecordBatch], negatives: bool) -> Iterator[pa.RecordBatch]:
        """The pairs of one task's rows that can be in the result."""
        kept = [Best(self.rules.negatives) for _ in range(self.rules.positives)] if negatives else [Best(self.rules.positives)]
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS_AT_ONCE):
                part = batch.slice(lo, _ROWS_AT_ONCE)
                uids, ids, labels = (part.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("uid", "vec_id", "label"))
                no_id = part.column("vec_id").is_null().to_numpy(zero_copy_only=False)
                for at, vectors in _by_length(part.column("vec")):
                    if vectors.shape[1] not in self.groups:
                        continue
                    mine, own = self.groups[vectors.shape[1]]
                    every = scores(own, vectors)
                    same = self.label[mine][:, None] == labels[at][None, :]
                    about = mine, ids[at], no_id[at], uids[at]
                    if not negatives:
                        other = self.uid[mine][:, None] != uids[at][None, :]
                        kept[0].add(np.where(same & other, every, _NONE), *about)
                        continue
                    every = np.where(same, _NONE, every)
                    for k, best in enumerate(kept):
                        inside = (every >= self.low[mine, k][:, None]) & (every <= self.high[mine, k][:, None])
                        best.add(np.where(inside, every, _NONE), *about)
        anchor, score, none, id, uid = (np.concatenate(x) for x in zip(*(b.rows for b in kept)))
        once = np.unique(np.stack([anchor, uid]), axis=1, return_index=True)[1]  # a row inside several windows
        anchor, score, none, id = anchor[once], score[once], none[once], id[once]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(self.uid[anchor]),
                pa.array(self.id[anchor]),
                pa.array(score),
                pa.array(np.full(len(anchor), int(negatives), np.int32)),
                pa.array(id, mask=none),
            ],
            names=["anchor", "anchor_id", "score", "kind", "vec_id"],
        )


def _sorted_by_anchor(pairs: DataFrame) -> DataFrame:
    """One shuffle by anchor, sorted inside the partitions: positives before negatives of the same score."""
    order = ["anchor", F.desc("score"), "kind", F.col("vec_id").asc_nulls_last()]
    return pairs.repartition("anchor").sortWithinPartitions(*order)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], kinds[i]) for i in range(len(names))], names=names)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield out()
            held = []
    yield out()


def first_positives(pairs: Iterator[tuple], n: int) -> Iterator[tuple]:
    """The first n pairs of each anchor."""
    now, seen = None, 0
    for pair in pairs:
        if pair[0] != now:
            now, seen = pair[0], 0
        seen += 1
        if seen <= n:
            yield pair


def mined(pairs: Iterator[tuple], rules: Rules) -> Iterator[tuple]:
    """Walk down the scores of each anchor: positives open windows, negatives are passed on while these are open."""
    now, seen, windows = None, 0, []
    for anchor, anchor_id, score, kind, vec_id in pairs:
        if anchor != now:
            now, seen, windows = anchor, 0, []
        if kind == 0:
            seen += 1
            if seen <= rules.positives:
                windows.append([vec_id, score, 0])
            continue
        still = []
        for window in windows:
            positive_id, positive, taken = window
            if 100 * score < rules.low * positive:
                continue  # all that follows is lower still
            if 100 * score <= rules.high * positive:
                window[2] = taken = taken + 1
                yield anchor_id, positive_id, taken, vec_id, positive, score
            if taken < rules.negatives:
                still.append(window)
        windows = still


def hard_negatives(
    table: DataFrame,
    id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    every: int = 50,
    shift_every: int = 7,
    labels: int = 10,
    rules: Rules | None = None,
    anchors_per_block: int = ANCHORS_PER_BLOCK,
) -> DataFrame:
    """`anchor_id`, `positive_id`, `rank`, `negative_id` and both scores, for rows whose id `every` divides.

    Scores are inner products of floor(256 * component). Rows with a NULL label or vector, or a NULL
    or non-finite component, take no part; where `shift_every` divides the id, the label is first
    (label + 1) % `labels`. A NULL id is no anchor and comes last among equal scores. Rows with equal
    ids are rows of their own, also as anchors. Vectors meet vectors of their own length only. A
    score beyond a long ends the query. An empty table gives no rows; other columns are not read.
    """
    rules = rules or Rules()
    spark = table.sparkSession
    rows = usable(table, id, label, vector, shift_every, labels)
    n_rows = table.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // ROWS_PER_TASK))
    rows = materialize(rows.repartition(parts, "uid"))
    anchors = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    n_anchors, longest = anchors.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not n_anchors:
        return spark.createDataFrame([], RESULT)
    anchors = materialize(anchors)
    size = min(anchors_per_block, max(1, BLOCK_BYTES // (8 * max(1, longest))))
    blocks = -(-n_anchors // size)
    names = [c.split()[0] for c in PAIRS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    results = None
    for k in range(blocks):
        chosen = anchors.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == k).collect()  # one block: bounded above
        if not chosen:
            continue
        block = Anchors(chosen, rules)
        sent = spark.sparkContext.broadcast(block)
        found = rows.mapInArrow(lambda b, sent=sent: sent.value.search(b, False), PAIRS)
        few = _sorted_by_anchor(found).mapInArrow(
            lambda b: _batches(first_positives(_stream(b), rules.positives), names, kinds), PAIRS
        )
        positives = materialize(few)
        block.open_windows(positives.select("anchor", "score").collect())  # a few rows per anchor of the block
        opened = spark.sparkContext.broadcast(block)
        negatives = rows.mapInArrow(lambda b, opened=opened: opened.value.search(b, True), PAIRS)
        result_names = [c.split()[0] for c in RESULT.split(", ")]
        result_kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        one = _sorted_by_anchor(positives.unionByName(negatives)).mapInArrow(
            lambda b: _batches(mined(_stream(b), rules), result_names, result_kinds), RESULT
        )
        one = materialize(one) if blocks > 1 else one
        results = one if results is None else results.unionByName(one)
    return results
