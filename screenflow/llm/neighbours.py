"""Nearest vectors by inner product through multi-index hashing of learned binary codes.

Vectors get one more coordinate so that all rows have the same length; the largest inner product is
then the smallest distance. Rotations learned on a bounded sample turn them into 256-bit codes, cut
into 16 substrings, each with its own table. Two codes at most `radius` bits apart are near in at
least one substring (pigeonhole), so probing every table for near substrings retrieves every code
within the radius; these are then ranked by their exact inner products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenflow.session import materialize

SAMPLE = 4096  # rows the rotations and the radius are learned from
SAMPLE_QUERIES = 512
COVERED = 0.985  # share of the sample's true neighbours that lie within the radius
BITS, SUBSTRINGS = 256, 16
ITERATIONS = 12
ROWS_PER_TASK = 65_536
ROWS_PER_BLOCK = 8192  # of a task's rows that share tables
QUERIES_PER_BLOCK = 4096
BLOCK_BYTES = 16 << 20  # vectors of one block of queries, as they are sent to the tasks
_STEP = 256  # queries compared at a time
SEED = 7


@dataclass
class Codes:
    """What is learned: centre, length of the augmented rows, rotations, and search radius."""

    centre: np.ndarray
    norm2: float
    rotation: np.ndarray
    radius: int

    def augment(self, x: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.norm2 - np.einsum("ij,ij->i", x, x)))
        return np.c_[x, extra] - self.centre

    def encode(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Codes as 16-bit substrings, one row per vector."""
        bits = self.augment(x, query) @ self.rotation > 0
        return np.packbits(bits, axis=1).view(np.uint16)


def _learn_rotation(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Iterative quantisation: the rotation under which the signs fit the centred sample best."""
    rotation = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(ITERATIONS):
        u, _, v = np.linalg.svd(np.where(x @ rotation > 0, 1.0, -1.0).T @ x)
        rotation = (u @ v).T
    return rotation


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between two sets of codes."""
    wide_a, wide_b = (np.ascontiguousarray(x).view(np.uint64) for x in (a, b))
    out = np.zeros((len(a), len(b)), np.int16)
    for k in range(wide_a.shape[1]):
        out += np.bitwise_count(wide_a[:, k, None] ^ wide_b[None, :, k])
    return out


def learn(sample: np.ndarray, norm2: float, k: int, covered: float = COVERED) -> Codes:
    """Rotations from the sample; the radius that covers the true neighbours found inside it.

    A row's neighbours in a larger table are nearer than those in the sample, so the radius errs on
    the wide side.
    """
    rng = np.random.default_rng(SEED)
    codes = Codes(np.zeros(sample.shape[1] + 1), norm2, np.zeros((0, 0)), BITS)
    rows = codes.augment(sample, False)
    codes.centre = rows.mean(axis=0)
    centred = rows - codes.centre
    width = centred.shape[1]
    blocks = [_learn_rotation(centred, rng) for _ in range(-(-BITS // width))]
    codes.rotation = np.concatenate(blocks, axis=1)[:, :BITS]
    queries = sample[:SAMPLE_QUERIES]
    scores = queries @ sample.T
    np.fill_diagonal(scores, -np.inf)
    near = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    if near.size:
        away = _hamming(codes.encode(queries, True), codes.encode(sample, False))
        codes.radius = int(np.ceil(np.quantile(np.take_along_axis(away, near, axis=1), covered)))
    return codes


class Tables:
    """One table per substring over a block of rows."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.values, self.rows = zip(*[np.unique(codes[:, j], return_inverse=True) for j in range(SUBSTRINGS)])

    def within(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """For each query and row, whether their codes are at most `radius` bits apart.

        With radius = share * SUBSTRINGS + rest, one of the first rest + 1 substrings is within
        share bits or one of the others within share - 1.
        """
        share, rest = divmod(radius, SUBSTRINGS)
        met = np.zeros((len(queries), len(self.codes)), bool)
        for j in range(SUBSTRINGS):
            allowed = share if j <= rest else share - 1
            buckets = np.bitwise_count(queries[:, j, None] ^ self.values[j][None, :]) <= allowed
            met |= buckets[:, self.rows[j]]
        at = np.nonzero(met)
        wide_q, wide_r = (np.ascontiguousarray(x).view(np.uint64) for x in (queries, self.codes))
        for lo in range(0, len(at[0]), 1 << 20):
            q, r = at[0][lo : lo + (1 << 20)], at[1][lo : lo + (1 << 20)]
            met[q, r] = np.bitwise_count(wide_q[q] ^ wide_r[r]).sum(axis=1) <= radius
        return met


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), width)


def exact_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    total = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        total += query[j] * rows[:, j]
    return total


FOUND = "query long, query_id long, vec_id long, score double"


@dataclass
class Queries:
    """A block of queries of one length, sent to the tasks."""

    uid: np.ndarray
    id: np.ndarray
    vectors: np.ndarray
    codes: Codes
    k: int

    def search(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of a task's rows for each query, out of those within the radius."""
        width, wanted = self.vectors.shape[1], self.codes.encode(self.vectors, True)
        best: tuple[np.ndarray, ...] = tuple(np.zeros(0, t) for t in (np.int64, np.float64, bool, np.int64))
        for uids, ids, no_id, rows in _row_blocks(batches, width):
            tables = Tables(self.codes.encode(rows, False))
            for lo in range(0, len(wanted), _STEP):
                met = tables.within(wanted[lo : lo + _STEP], self.codes.radius)
                met &= self.uid[lo : lo + _STEP, None] != uids[None, :]
                parts = [best]
                for i in range(len(met)):
                    found = np.flatnonzero(met[i])
                    scores = exact_scores(self.vectors[lo + i], rows[found])
                    if len(found) > self.k:
                        enough = scores >= np.partition(scores, len(scores) - self.k)[-self.k]
                        found, scores = found[enough], scores[enough]
                    parts.append((np.full(len(found), lo + i), scores, no_id[found], ids[found]))
                best = self._cut(*(np.concatenate(x) for x in zip(*parts)))
        query, score, none, id = best
        yield pa.RecordBatch.from_arrays(
            [pa.array(self.uid[query]), pa.array(self.id[query]), pa.array(id, mask=none), pa.array(score)],
            names=["query", "query_id", "vec_id", "score"],
        )

    def _cut(self, query: np.ndarray, score: np.ndarray, none: np.ndarray, id: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((id, none, -score, query))
        first = np.searchsorted(query[order], query[order], side="left")
        order = order[np.arange(len(order)) - first < self.k]
        return query[order], score[order], none[order], id[order]


def _row_blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of one length as (uid, id, id is NULL, vectors), ROWS_PER_BLOCK or so at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        batch = batch.filter(pc.equal(pc.list_value_length(batch.column("vec")), width))
        if not batch.num_rows:
            continue
        ids = batch.column("vec_id")
        none = ids.is_null().to_numpy(zero_copy_only=False)
        held.append((batch.column("uid").to_numpy(), ids.fill_null(0).to_numpy(), none, _matrix(batch.column("vec"), width)))
        size += batch.num_rows
        if size >= ROWS_PER_BLOCK:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def usable(table: DataFrame, id: str, vector: str) -> DataFrame:
    """`uid`, `vec_id`, `vec` (doubles): every row that takes part, told apart by `uid` where ids repeat or are NULL.

    NULL, empty and zero vectors and those with NULL or non-finite components take no part.
    """
    numbers = F.transform(vector, lambda x: x.cast("double"))
    rows = table.select(F.monotonically_increasing_id().alias("uid"), F.col(id).cast("long").alias("vec_id"), numbers.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("vec").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda x: x != 0))


def _search(rows: DataFrame, queries: DataFrame, n_queries: int, width: int, codes: Codes, k: int) -> DataFrame:
    """The k best rows of every query, block of queries by block; rows stay where they are."""
    size = min(QUERIES_PER_BLOCK, max(1, BLOCK_BYTES // (8 * width)))
    blocks = -(-n_queries // size)
    context, found = rows.sparkSession.sparkContext, None
    for b in range(blocks):
        chosen = queries.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == b).collect()  # one block: bounded above
        if not chosen:
            continue
        uid, id, vec = (list(x) for x in zip(*((r["uid"], r["vec_id"], r["vec"]) for r in chosen)))
        block = Queries(np.array(uid, np.int64), np.array(id, np.int64), np.array(vec, np.float64), codes, k)
        sent = context.broadcast(block)
        some = rows.mapInArrow(lambda batches, sent=sent: sent.value.search(batches), FOUND)
        some = materialize(some) if blocks > 1 else some
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(
    table: DataFrame, k: int = 20, every: int = 20, id: str = "vec_id", vector: str = "embedding", covered: float = COVERED
) -> DataFrame:
    """The k nearest other rows by inner product of each row whose id is divisible by `every`.

    `query_id`, `rank` (from 1), `vec_id`, `score`; equal scores go to the smaller id, a NULL id last.
    Every row of `usable` is a candidate, with or without an id, and rows that share an id are rows
    (and queries) of their own. A query that has fewer than k rows within the radius is compared with
    all rows. Vectors meet vectors of their own length only, each length with codes of its own. An
    empty table gives no rows; other columns are not read.
    """
    spark = table.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // ROWS_PER_TASK))
    rows = materialize(usable(table, id, vector).repartition(parts, "uid"))
    asked = F.pmod("vec_id", F.lit(every)) == 0
    norm2 = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    facts = rows.groupBy(F.size("vec").alias("width")).agg(F.count("*").alias("n"), F.count_if(asked).alias("q"), F.max(norm2).alias("longest"))
    results = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for width, n_rows, n_queries, longest in sorted(facts.where("q > 0 AND n > 1").collect()):  # one row per length
        mine = rows.where(F.size("vec") == width)
        queries = mine.where(asked)
        sample = mine.orderBy(F.xxhash64("vec"), "vec_id").limit(SAMPLE).select("vec").collect()
        codes = learn(np.array([r[0] for r in sample], np.float64), longest, k, covered)
        found = materialize(_search(mine, queries, n_queries, width, codes, k))
        enough = found.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, n_rows - 1))
        short = materialize(queries.join(enough, F.col("uid") == F.col("query"), "left_anti"))
        n_short = short.count()
        if n_short:
            everything = Codes(codes.centre, codes.norm2, codes.rotation, BITS)
            again = _search(mine, short, n_short, width, everything, k)
            found = found.join(short.select(F.col("uid").alias("query")), "query", "left_anti").unionByName(again.select(found.columns))
        results = results.unionByName(found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    return results
