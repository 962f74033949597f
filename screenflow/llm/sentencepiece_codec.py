"""Exact encoding with a piece vocabulary of merge type, and decoding.

Per segment (a word with the blanks before it) a table holds the unique last token of each prefix;
the ids are read off it from the end. See `pieces.py` for the machine that fills the table.
"""

from __future__ import annotations

import hashlib
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from screenflow.llm.arrow import append_columns
from screenflow.llm.pieces import Memo, escaped, machine, segments

_CODECS: dict[str, Codec] = {}


class Codec:
    """Encoder and decoder of a model file."""

    def __init__(self, path: str):
        self.machine = machine(path, False)
        self.model = self.machine.vocabulary.model
        self.end = self.model.eos_id()
        self.decimal = list(map(str, range(self.model.vocab_size())))
        self.table = Memo(lambda segment: tuple(self.machine.ids(segment)))

    def encode(self, text: str | None) -> list[int]:
        """Ids of the whole text (NULL: empty) and the end id."""
        pieces = map(self.table.__getitem__, segments(escaped(text or "")))
        return [*chain.from_iterable(pieces), self.end]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


def codec(path: str) -> Codec:
    """The codec of a model file, built once per Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_pieces(docs: DataFrame, model_path: str, text: str = "text", name: str = "piece_ids") -> DataFrame:
    """Add the token ids of every whole text, with the end id last.

    A NULL or empty text has the end id alone. Rows are independent: repeated rows give repeated
    results; other columns pass through unless they bear the name of the new one.
    """

    def work(column):
        encode = codec(model_path).encode
        return [[encode(t) for t in column.to_pylist()]]

    return append_columns(docs, text, {name: T.ArrayType(T.IntegerType())}, work)


def encode_checked(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Add `piece_ids`, `n_tokens` and `exact`, whether decoding the ids gives the text back, in one pass.

    NULLs, repeats and other columns are treated as by `encode_pieces`.
    """

    def work(column):
        one, columns = codec(model_path), [[], [], []]
        for t in column.to_pylist():
            ids = one.encode(t)
            for c, v in zip(columns, (ids, len(ids), one.decode(ids) == (t or ""))):
                c.append(v)
        return columns

    fields = {"piece_ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "exact": T.BooleanType()}
    return append_columns(docs, text, fields, work)


def decode_pieces(rows: DataFrame, model_path: str, ids: str = "piece_ids", name: str = "text") -> DataFrame:
    """Add the text of every list of ids; the end id has none. NULL gives NULL."""

    def work(column):
        decode = codec(model_path).decode
        return [[None if x is None else decode(x) for x in column.to_pylist()]]

    return append_columns(rows, ids, {name: T.StringType()}, work)


def codec_digest(docs: DataFrame, model_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: number of ids, digests of the ids and of the text decoded from them.

    NULL texts count as empty, whose only id is the end. Repeated rows are returned as often as they
    occur, an empty table gives no rows, and other columns than id and text are not read.
    """

    def work(column):
        one, columns = codec(model_path), [[], [], []]
        decimal = one.decimal
        for t in column.to_pylist():
            ids = one.encode(t)
            columns[0].append(len(ids))
            columns[1].append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
            columns[2].append(hashlib.sha256(one.decode(ids).encode()).hexdigest())
        return columns

    fields = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    return append_columns(docs.select(id, text), text, fields, work, drop=True)
