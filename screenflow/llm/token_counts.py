"""Token counts by a deterministic machine whose transitions carry the change of the count.

A text is read in chunks. The map of a chunk from any entry state to its exit state and count is
held as (head, count, tail): what stands before the first segment start, the tokens of the whole
segments inside, and what stands from the last segment start on. Maps compose associatively, so a
scan over a balanced tree gives the count of the whole text, and only one chunk's characters are
alive at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from screenflow.llm.arrow import append_columns
from screenflow.llm.pieces import Memo, escaped, machine, next_segment, segments

CHUNK = 65_536  # characters
LIMIT = 4096

ChunkMap = tuple[str, int, str | None]  # tail None: no segment starts inside, the head is the whole chunk

_COUNTERS: dict[str, Counter] = {}


class Counter:
    """Counts tokens of texts as a model file's tokenizer gives them, without special tokens."""

    def __init__(self, path: str, chunk: int = CHUNK):
        self.machine, self.chunk = machine(path, True), chunk
        self.counts = Memo(self.machine.count)

    def _segments(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, segments(text)))

    def _open(self, text: str) -> int:
        """Tokens of a piece of text that begins where a segment begins."""
        return self._segments(text) if text else 0

    def chunk_map(self, text: str) -> ChunkMap:
        first = next_segment(text, 1)
        if first < 0:
            return text, 0, None
        last = max(text.rfind("▁"), first)
        while text[last - 1] == "▁":
            last -= 1
        return text[:first], self._segments(text[first:last]), text[last:]

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        if b[2] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self._open(a[2] + b[0]) + b[1], b[2]

    def count(self, text: str | None) -> int:
        """Tokens of the whole text; NULL and empty texts have none."""
        text = escaped(text or "")
        if len(text) <= self.chunk:
            return self._open(text)
        maps = [self.chunk_map(text[i : i + self.chunk]) for i in range(0, len(text), self.chunk)]
        while len(maps) > 1:
            paired = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])]
            maps = paired + maps[2 * len(paired) :]
        head, inside, tail = maps[0]
        return self._open(head) + inside + self._open(tail or "")


def counter(path: str) -> Counter:
    """The counter of a model file, built once per Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(
    docs: DataFrame, model_path: str, id: str = "doc_id", text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """Per document: bytes of the text in UTF-8, tokens, and whether they are more than `limit`.

    A NULL text counts as empty: 0 bytes, 0 tokens. Rows are independent; repeated rows give
    repeated results, and columns other than `id` and `text` are left out.
    """

    def work(column):
        count, columns = counter(model_path).count, [[], [], []]
        for t in column.to_pylist():
            n = count(t)
            columns[0].append(len((t or "").encode()))
            columns[1].append(n)
            columns[2].append(n > limit)
        return columns

    fields = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType()}
    return append_columns(docs.select(id, text), text, fields, work, drop=True)
