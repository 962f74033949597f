"""SimHash near-duplicates: fingerprints, links within a Hamming distance, connected components.

Fingerprints are embedded as popcounts of their 2-bit segments; the Manhattan distance of two
embeddings is never more than the Hamming distance. Of two fingerprints at most 4 bits apart, one
half differs in at most 2 bits, so in one half the embeddings lie within Manhattan distance 2 of
each other and share a grid cell within distance 1 of both. Each distinct fingerprint enters the
cells around it, fingerprints that meet in a cell are compared bit by bit, and a cell passes on the
links that join its members, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenflow.functions.components import connected_components
from screenflow.functions.skew import salted_join
from screenflow.llm.arrow import append_columns, unused
from screenflow.session import materialize

SHINGLE = 4
SEED = 42
MAX_DISTANCE = 4  # the grid is laid out for this distance
_HALF = 16  # segments of 2 bits per half
_SMALL = 16  # cells of up to so many fingerprints are compared together
_BUFFER = 200_000  # rows taken together, plus the rows of one cell
_BLOCK = 65_536  # shingles whose bits are counted at a time


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Unsigned XXH64 of each run of `size` words (fewer words: all of them), repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: max(0, len(words) - size)].tolist()]
    stops = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 without hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        block = hashes[i : i + _BLOCK].astype("<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", drop: bool = False) -> DataFrame:
    """Add the 64-bit fingerprint of every whole text as a signed long; 0 for NULL and wordless texts."""

    def work(column):
        values = np.array([fingerprint(shingle_hashes(t)) for t in column.to_pylist()], np.uint64)
        return [values.view(np.int64)]

    return append_columns(docs, text, {name: T.LongType()}, work, drop)


def _cells(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of each fingerprint (uint64): in each half, its own and those one step away."""
    low = np.uint64(0x5555555555555555)
    counts = (fingerprints & low) + ((fingerprints >> np.uint64(1)) & low)  # 2 bits per segment: 0, 1 or 2
    cells, owners = [], []
    index = np.arange(len(fingerprints))
    for half in (0, 1):
        own = ((counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64) | (half << 32)
        cells.append(own)
        owners.append(index)
        for segment in range(_HALF):
            step = np.int64(1 << (2 * segment))
            value = (own >> (2 * segment)) & 3
            for fits, cell in ((value < 2, own + step), (value > 0, own - step)):
                cells.append(cell[fits])
                owners.append(index[fits])
    return np.concatenate(cells), fingerprints[np.concatenate(owners)].view(np.int64)


def _joining(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join the members (uint64) of a cell as all links within `distance` would."""
    links, left = [], members
    while len(left):
        waiting, left = [left[0]], left[1:]
        while waiting and len(left):
            one = waiting.pop()
            near = np.bitwise_count(left ^ one) <= distance
            if near.any():
                found = left[near]
                left = left[~near]
                links += [(one, x) for x in found]
                waiting += list(found)
    return links


def _links(cells: np.ndarray, fingerprints: np.ndarray, distance: int) -> np.ndarray:
    """Links (a, b) within complete cells; `cells` is sorted."""
    bounds = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True])
    sizes = np.diff(bounds)
    pairs = []
    small = np.repeat((sizes > 1) & (sizes <= _SMALL), sizes)
    c, f = cells[small], fingerprints[small]
    for step in range(1, _SMALL):
        same = c[:-step] == c[step:]
        if not same.any():
            break
        near = same & (np.bitwise_count(f[:-step] ^ f[step:]) <= distance)
        pairs.append(np.stack([f[:-step][near], f[step:][near]], axis=1))
    for k in np.flatnonzero(sizes > _SMALL):
        found = _joining(fingerprints[bounds[k] : bounds[k + 1]], distance)
        pairs.append(np.array(found, np.uint64).reshape(-1, 2))
    if not pairs:
        return np.zeros((0, 2), np.uint64)
    return np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)


def near_links(nodes: DataFrame, fingerprint: str = "fingerprint", distance: int = MAX_DISTANCE) -> DataFrame:
    """Links `a`, `b` between distinct fingerprints that give the same components as all links do.

    `nodes` has each fingerprint once. A cell's members are handled in one task, 16 bytes each.
    """
    if distance > MAX_DISTANCE:
        raise ValueError(f"the grid finds links up to distance {MAX_DISTANCE}")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(values), 4096):
                cells, owners = _cells(values[i : i + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(owners)], names=["cell", "f"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(cells, values):
            found = _links(cells, values.view(np.uint64), distance).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        parts, rows = [], 0
        for batch in batches:
            parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows < _BUFFER or parts[-1][0][-1] == parts[0][0][0]:
                continue
            cells, values = (np.concatenate(x) for x in zip(*parts))
            last = np.searchsorted(cells, cells[-1])
            yield done(cells[:last], values[:last])
            parts, rows = [(cells[last:], values[last:])], len(cells) - last
        if rows:
            yield done(*(np.concatenate(x) for x in zip(*parts)))

    cells = nodes.select(fingerprint).mapInArrow(spread, "cell long, f long")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "a long, b long").distinct()


def component_roots(nodes: DataFrame, fingerprint: str = "fingerprint", distance: int = MAX_DISTANCE) -> DataFrame:
    """`node`, `root` for every fingerprint that has a link; the root is one of its component."""
    return connected_components(near_links(nodes, fingerprint, distance))


def _labelled(prints: DataFrame, id: str, distance: int) -> DataFrame:
    """One row per distinct fingerprint: `first`, its smallest id, `copies`, `root`, which tells its component, and `component_id`."""
    nodes = materialize(prints.groupBy("fingerprint").agg(F.min(id).alias("first"), F.count(F.lit(1)).alias("copies")))
    roots = component_roots(nodes, "fingerprint", distance)
    linked = materialize(
        nodes.join(roots, F.col("fingerprint") == F.col("node"), "left")
        .select("fingerprint", "first", "copies", F.coalesce("root", "fingerprint").alias("root"))
    )
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("_nodes"))
    return salted_join(linked, smallest, ["root"], "_nodes", ["fingerprint"]).drop("_nodes")


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", distance: int = MAX_DISTANCE
) -> DataFrame:
    """Per document: fingerprint (16 hex digits) and the smallest id in its component.

    Texts that are NULL or have no words have fingerprint zero and are linked like any other.
    Repeated rows are returned as often as they occur. A NULL id is no smallest id; the component
    of documents without any id is NULL.
    """
    prints = materialize(with_fingerprint(docs.select(id, text), text, drop=True))
    labels = _labelled(prints, id, distance).drop("first", "root")
    joined = salted_join(prints, labels, ["fingerprint"], "copies", [id])
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return joined.select(id, digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", distance: int = MAX_DISTANCE) -> DataFrame:
    """The documents, each near-duplicate group reduced to one: the smallest id, of its rows the smallest digest.

    Digests are those of the text, then of the whole row; of rows that are equal in all columns one
    stays. In a group without ids one document stays. Groups are told apart by their texts: an id
    that is the smallest of several groups stays in each of them. Which row stays does not depend on
    the order or partitioning of the table. Texts are shuffled once, to meet the choice.
    """
    names = ("_fingerprint", "_row", "_id", "_no_id")
    mark, row, key, no_key = (unused(docs, name) for name in names)
    comparable = [F.col(f.name) for f in docs.schema.fields if f.name.lower() != text.lower()]
    # A row by its text, then by all it has; the id without NULLs, so that it can be joined on.
    digest = F.concat(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), F.sha2(F.to_json(F.struct(F.col(text).isNull().alias("t"), *[c.alias(f"c{i}") for i, c in enumerate(comparable)])), 256))
    same_id = F.coalesce(F.col(id).cast("string"), F.lit(""))
    marked = with_fingerprint(docs, text, mark).withColumns({row: digest, key: same_id, no_key: F.col(id).isNull()})
    prints = materialize(marked.select(F.col(id).alias("id"), F.col(mark).alias("fingerprint"), F.col(row).alias("row")))
    kept = _labelled(prints, "id", distance).where(F.col("first").eqNullSafe(F.col("component_id")))
    one = kept.groupBy("root").agg(F.min("fingerprint").alias("fingerprint"), F.min("first").alias("wanted")).drop("root")
    # Rows under the chosen fingerprint and id: the smallest digest of each choice.
    rows = prints.withColumn("key", F.coalesce(F.col("id").cast("string"), F.lit(""))).groupBy("fingerprint", F.col("id").isNull().alias("no_key"), "key").agg(F.min("row").alias("row"))
    wanted = one.select("fingerprint", F.col("wanted").isNull().alias("no_key"), F.coalesce(F.col("wanted").cast("string"), F.lit("")).alias("key"))
    chosen = rows.join(wanted, ["fingerprint", "no_key", "key"]).toDF(mark, no_key, key, row)
    on = [mark, no_key, key, row]
    # The join leaves rows dealt out by what repeats are dropped on.
    return marked.join(chosen, on, "left_semi").dropDuplicates(on).select(*docs.columns)
