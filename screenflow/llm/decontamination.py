"""Benchmark decontamination: one automaton over the windows of all test items, texts scanned once.

Words are runs of ASCII letters (lower-cased), digits and characters outside ASCII. A window is 10
consecutive words of an item; a shorter item is one window. Windows and texts are normalised to
words with single blanks, so an occurrence of a window is one match of its string.

An automaton takes some 450 bytes per byte of test text, so a benchmark above MAX_BYTES is dealt into
groups of items with an automaton each. Texts are then scanned once per group, and what the groups
find in a text is united under the digest of that text.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from screenflow.functions.skew import salted_join
from screenflow.llm.arrow import append_columns, small_batches, unused
from screenflow.session import materialize

WINDOW = 10
MAX_BYTES = 512 << 10  # test text that one automaton holds (then some 230 MB)

_WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
# Upper case to lower case, what is in no word to a blank.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_AUTOMATA: dict[tuple[str, int], Automaton] = {}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def windows(item: list[bytes], size: int = WINDOW) -> list[bytes]:
    """The distinct windows of an item, as normalised strings with a blank on each side."""
    if not item:
        return []
    starts = range(max(1, len(item) - size + 1))
    return list({b" " + b" ".join(item[i : i + size]) + b" ": None for i in starts})


class Automaton:
    """Finds the windows of all items in a normalised text."""

    def __init__(self, items: list[tuple[str | None, str]], size: int):
        import ahocorasick

        self.owners: list[list[str | None]] = []
        place: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton()
        for name, text in items:
            for window in windows(words(text), size):
                k = place.setdefault(window, len(place))
                if k == len(self.owners):
                    self.owners.append([])
                    # One character per byte: the automaton reads characters.
                    self.automaton.add_word(window.decode("latin-1"), (k, len(window)))
                self.owners[k].append(name)
        self.any = bool(place)
        if self.any:
            self.automaton.make_automaton()

    def scan(self, document: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit stretches of words (start, end; apart and in order) and the ids of the items that occur."""
        if not (self.any and document):
            return [], set()
        text = " " + b" ".join(document).decode("latin-1") + " "
        found, kinds = [], set()
        for end, (k, length) in self.automaton.iter(text):
            found.append((end - length + 1, end))
            kinds.add(k)
        if not found:
            return [], set()
        stretches, at, before = [], 0, 0
        for start, end in joined(found):  # from blank to blank; stretches that touch are one
            before += text.count(" ", at, start)
            inside = text.count(" ", start, end)
            stretches.append((before, before + inside))
            at, before = end, before + inside
        return stretches, {name for k in kinds for name in self.owners[k] if name is not None}


def joined(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(stretches):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


Items = tuple[str, list[tuple[str | None, str]]]  # digest, (item id as text, text)


def _automaton(items: Items, size: int) -> Automaton:
    """The automaton of a group of items, built once per Python worker that scans with it."""
    key = (items[0], size)
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = Automaton(items[1], size)
    return _AUTOMATA[key]


def item_parts(item: list[bytes], size: int, most: int) -> list[str]:
    """The words of an item as texts of at most some `most` bytes that have all its windows between them."""
    parts, start = [], 0
    while True:
        end, room = start, most
        while end < len(item) and (room > 0 or end - start < size):
            room -= len(item[end]) + 1
            end += 1
        parts.append(b" ".join(item[start:end]).decode())
        if end >= len(item):
            return parts
        start = end - size + 1


def item_groups(
    benchmark: DataFrame, id: str = "item_id", text: str = "text", size: int = WINDOW, max_bytes: int = MAX_BYTES
) -> Iterator[Items]:
    """The items in groups of some `max_bytes` of text, one group on the driver at a time.

    NULL texts have no words. Items with a NULL id belong to the groups like any other; they hit, but
    no list of ids names them.
    """
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(id).cast("string").alias("name"), F.col(text).alias("item"))
    total = rows.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    groups = 1
    if total > max_bytes:
        # Halves, so that chance does not lift a group far above the bound; no item is larger than one.
        groups = -(-2 * total // max_bytes)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(n, p) for n, t in zip(*(c.to_pylist() for c in batch.columns)) for p in item_parts(words(t), size, max_bytes // 4)]
                columns = [pa.array([f[i] for f in found], pa.string()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["name", "item"])

        rows = materialize(rows.mapInArrow(cut, "name string, item string"))
    for k in range(groups):
        some = rows if groups == 1 else rows.where(F.pmod(F.xxhash64("name", "item"), F.lit(groups)) == k)
        items = sorted({(r[0], r[1]) for r in some.collect()}, key=lambda item: (item[0] is None, item[0] or "", item[1]))
        yield hashlib.sha256(repr(items).encode()).hexdigest(), items


HITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
def _offsets(text: str, stretches: list[tuple[int, int]]) -> list[dict]:
    """Word stretches as code point offsets in the text itself."""
    raw = text.encode()
    spans = [m.span() for m in _WORD_BYTES.finditer(raw.translate(_NORMAL))]
    out, at, chars = [], 0, 0
    for start, end in stretches:
        first, last = spans[start][0], spans[end - 1][1]
        begin = chars + len(raw[at:first].decode())
        at, chars = last, begin + len(raw[first:last].decode())
        out.append({"start": begin, "end": chars})
    return out


Answer = Callable[[str | None, list[tuple[int, int]], set[str]], tuple]


def _scanned(
    docs: DataFrame, benchmark: DataFrame, text: str, size: int, max_bytes: int, fields: dict[str, T.DataType], answer: Answer, drop: bool = False
) -> DataFrame:
    """Add `fields`: the answer for (text, hit stretches of words, ids of items) of every row."""
    groups = item_groups(benchmark, size=size, max_bytes=max_bytes)
    first, second = next(groups), next(groups, None)
    if second is not None:
        return _united(docs, itertools.chain([first, second], groups), text, size, fields, answer, drop)

    def work(column: pa.Array) -> list[list]:
        automaton = _automaton(first, size)
        rows = [answer(t, *automaton.scan(words(t))) for t in column.to_pylist()]
        return [list(c) for c in zip(*rows)] or [[] for _ in fields]

    return append_columns(docs, text, fields, work, drop)


def _united(
    docs: DataFrame, groups: Iterator[Items], text: str, size: int, fields: dict[str, T.DataType], answer: Answer, drop: bool
) -> DataFrame:
    """As `_scanned`, with a scan per group: texts with hits meet what each group found under their digest."""
    key, copies, both, found = (unused(docs, name) for name in ("_key", "_copies", "_both", "_found"))
    digest = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    texts = docs.select(digest.alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    small_batches(docs)
    schema = "key string, hits array<struct<start:bigint,end:bigint>>, items array<string>"
    kinds = [to_arrow_type(f.dataType) for f in T.StructType.fromDDL(schema).fields]

    def scan(items: Items) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                automaton, rows = _automaton(items, size), []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    stretches, names = automaton.scan(words(t))
                    if stretches:
                        rows.append((k, [{"start": a, "end": b} for a, b in stretches], sorted(names)))
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "hits", "items"])

        return run

    every = None
    for items in groups:
        part = materialize(texts.mapInArrow(scan(items), schema))
        every = part if every is None else every.unionByName(part)
    # Copies of a text have the same hits, so a text has one element per group.
    per_text = every.groupBy(F.col("key").alias(key)).agg(F.collect_set(F.struct("hits", "items")).alias(found), F.count(F.lit(1)).alias(copies))
    keyed = docs.withColumn(key, digest)
    id_like = [c for c, kind in docs.dtypes if not kind.startswith("map") and c != text] or [text]
    wide = salted_join(keyed, per_text, [key], copies, id_like, "left").drop(copies, key)
    wide = wide.withColumn(both, F.struct(F.col(text).alias("text"), F.col(found).alias("found"))).drop(found)

    def work(column: pa.StructArray) -> list[list]:
        rows = []
        for t, parts in zip(column.field(0).to_pylist(), column.field(1).to_pylist()):
            stretches = joined([(h["start"], h["end"]) for part in parts or () for h in part["hits"]])
            rows.append(answer(t, stretches, {name for part in parts or () for name in part["items"]}))
        return [list(c) for c in zip(*rows)] or [[] for _ in fields]

    out = append_columns(wide, both, fields, work, drop=True)
    return out.drop(text) if drop else out


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", name: str = "hits", size: int = WINDOW, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """Add where windows of test items occur: stretches (start, end) in code points of each text.

    Items with a NULL id hit like any other; items with a NULL or wordless text never do. NULL and
    empty texts have no hits. Rows are independent; other columns pass through unless they bear the
    name of the new one. An empty benchmark hits nothing, one of any size is taken in groups.
    """

    def answer(t, stretches, _):
        return (_offsets(t, stretches) if stretches else [],)

    return _scanned(docs, benchmark, text, size, max_bytes, {name: HITS}, answer)


def contamination_digest(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", size: int = WINDOW, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """Per document: words, words inside any occurrence of a window, and which items occur.

    Items with a NULL id hit, but are not among the items, which are counted by their distinct ids.
    NULL and empty texts have no words; repeated rows are returned as often as they occur; tables
    without rows give none, or no hits.
    """

    def answer(t, stretches, names):
        n_hit = sum(end - start for start, end in stretches)
        return len(words(t)), n_hit, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), n_hit > 0

    fields = {
        "n_words": T.LongType(), "n_hit": T.LongType(), "n_items": T.LongType(),
        "items_sha256": T.StringType(), "contaminated": T.BooleanType(),
    }
    return _scanned(docs.select(id, text), benchmark, text, size, max_bytes, fields, answer, drop=True)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = WINDOW, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """The documents without any window of a test item, with or without an id; their columns as they are."""
    mark = unused(docs, "_contaminated")
    marked = _scanned(docs, benchmark, text, size, max_bytes, {mark: T.BooleanType()}, lambda t, stretches, _: (bool(stretches),))
    return marked.where(~F.col(mark)).select(*docs.columns)
