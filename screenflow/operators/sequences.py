"""Vocabulary, encoding and decoding of token sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenflow.functions import text as tx
from screenflow.functions.ordering import global_rank
from screenflow.functions.skew import dealt_out, salted_join
from screenflow.functions.tokenized import distinct_ids, distinct_tokens, small_batches, spelled, spelled_by, token_ids, token_ids_by
from screenflow.operators.quality import describe
from screenflow.session import materialize

HELD_ENTRIES = 100_000  # of a vocabulary that every task holds


def token_frequency(df: DataFrame, text: str, parts: int | None = None) -> DataFrame:
    """Count and share of every token. `parts`: see `dealt_out`."""
    texts = dealt_out(df.select(text), parts)
    counts = texts.select(F.explode(tx.tokens(F.col(text))).alias("token")).groupBy("token").count()
    counts = materialize(counts)  # one row per token, read for the total too
    total = counts.agg(F.sum("count").alias("total")).scalar()
    return counts.withColumn("fraction", F.col("count") / total)


def build_vocabulary(df: DataFrame, text: str, parts: int | None = None) -> DataFrame:
    """(token, id): the special tokens 0 to 3, then all tokens of the texts in code-point order."""
    found = dealt_out(df.select(text), parts).select(F.explode(tx.tokens(F.col(text))).alias("token")).distinct()
    ranked = global_rank(found, ["token"], "id")
    numbered = ranked.select("token", (F.col("id") + (len(tx.SPECIALS) - 1)).cast("int").alias("id"))
    specials = df.sparkSession.createDataFrame(list(zip(tx.SPECIALS, range(len(tx.SPECIALS)))), "token string, id int")
    return specials.unionByName(numbered)


def token_length_stats(df: DataFrame, text: str) -> DataFrame:
    """Spread of the token counts, and the longest sequence with its two ends."""
    lengths = df.select(F.size(tx.tokens(F.col(text))).alias("n_tokens"))
    return describe(lengths, ["n_tokens"]).withColumns(
        {
            "max_token_length": F.col("max").cast("int"),
            "max_sequence_length": F.col("max").cast("int") + 2,
        }
    )


def encode(
    df: DataFrame, text: str, vocabulary: DataFrame, row_id: str, ids: str = "ids", parts: int | None = None
) -> DataFrame:
    """Add BOS + token ids + EOS; tokens outside the vocabulary become UNK. `row_id` is unique.

    A vocabulary of at most HELD_ENTRIES is sent to the tasks. With a larger one, rows meet their part of it as
    texts and are cut into tokens after that. `parts`: see `dealt_out`.
    """
    held = _held(vocabulary, "token", "id")
    if held is not None:
        return small_batches(dealt_out(df, parts)).withColumn(ids, token_ids_by(F.col(text), held))
    translated = _translate(df, distinct_tokens(F.col(text)), vocabulary.select("token", "id"), "token", "id", row_id, parts)
    return translated.withColumn(ids, token_ids(F.col(text), F.col("_map"))).drop("_map")


def _held(table: DataFrame, source: str, target: str) -> dict | None:
    """The table's entries, if they are few and every source has one."""
    rows = table.select(source, target).where(F.col(source).isNotNull()).limit(HELD_ENTRIES + 1).collect()
    found = {r[0]: r[1] for r in rows if r[1] is not None}
    return found if len(found) == len(rows) <= HELD_ENTRIES else None


def _translate(
    df: DataFrame, array: Column, table: DataFrame, source: str, target: str, row_id: str, parts: int | None = None
) -> DataFrame:
    """Add `_map`: the entries of a table for the elements, each once, of an array of the row.

    An element that many rows share is hot, so its rows are counted first and split in the join.
    """
    given = small_batches(dealt_out(df, parts))
    pairs = materialize(given.select(F.col(row_id).alias("_row"), F.explode(array).alias("_source")))
    counts = pairs.groupBy("_source").agg(F.count(F.lit(1)).alias("_n"))
    renamed = table.select(F.col(source).alias("_source"), F.col(target).alias("_target"))
    entries = salted_join(pairs, counts.join(renamed, "_source"), ["_source"], "_n", ["_row"])
    pair_list = F.collect_list(F.struct("_source", "_target"))  # at most one entry per element of the row's array
    maps = entries.groupBy("_row").agg(F.map_from_entries(pair_list).alias("_map"))
    empty = F.map_from_arrays(F.array(), F.array())
    # Adaptive execution sizes partitions by bytes, but the work to come is many times that.
    joined = dealt_out(df.join(maps, F.col(row_id) == F.col("_row"), "left").drop("_row"), parts)
    return joined.withColumn("_map", F.coalesce("_map", empty.cast(maps.schema["_map"].dataType)))


def decode(
    df: DataFrame,
    ids: str,
    vocabulary: DataFrame,
    row_id: str,
    out: str = "decoded",
    skip_unknown: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Text of an id sequence: up to the first EOS, without PAD and BOS (and UNK on request).

    The vocabulary is sent or met as in `encode`. `parts`: see `dealt_out`.
    """
    skip = [tx.PAD_ID, tx.BOS_ID] + ([tx.UNK_ID] if skip_unknown else [])
    held = _held(vocabulary, "id", "token")
    if held is not None:
        return small_batches(dealt_out(df, parts)).withColumn(out, spelled_by(F.col(ids), held, skip))
    translated = _translate(df, distinct_ids(F.col(ids)), vocabulary.select("id", "token"), "id", "token", row_id, parts)
    return translated.withColumn(out, spelled(F.col(ids), F.map_keys("_map"), F.map_values("_map"), skip)).drop("_map")


def pad_sequences(df: DataFrame, ids: str, length: int, out: str = "padded", separator: str | None = None) -> DataFrame:
    """Fill sequences up to one length and keep the true length; a longer one fails the job.

    With `separator` the padded sequence is a text of its ids, without an array of `length` numbers between.
    """
    padded = tx.pad(F.col(ids), length) if separator is None else tx.pad_text(F.col(ids), length, separator)
    return df.withColumns({"sequence_length": F.size(ids), out: padded})


def shift(df: DataFrame, ids: str) -> DataFrame:
    """Model input (all but the last id) and target (all but the first)."""
    return df.withColumns({"input_ids": tx.shift_input(F.col(ids)), "target_ids": tx.shift_target(F.col(ids))})


def roundtrip_check(df: DataFrame, text: str, vocabulary: DataFrame, row_id: str, parts: int | None = None) -> DataFrame:
    """How many texts come back unchanged from encoding and decoding.

    The entries that encode a text are those that decode its ids (and UNK, which has one token), so
    rows meet the vocabulary once.
    """
    table = vocabulary.select("token", "id")
    translated = _translate(df.select(row_id, text), distinct_tokens(F.col(text)), table, "token", "id", row_id, parts)
    unknown = table.where(F.col("id") == tx.UNK_ID).agg(F.max("token").alias("t")).scalar()
    with_ids = translated.withColumns({"ids": token_ids(F.col(text), F.col("_map")), "_unknown": unknown})
    names = F.concat(F.array(F.lit(tx.UNK_ID)), F.map_values("_map"))
    words = F.concat(F.array("_unknown"), F.map_keys("_map"))
    decoded = with_ids.withColumn("decoded", spelled(F.col("ids"), names, words, [tx.PAD_ID, tx.BOS_ID]))
    same = F.col("decoded") == F.col(text)
    return decoded.agg(
        F.count(text).alias("n_texts"), F.count_if(same).alias("n_same"), F.count_if(~same).alias("n_changed")
    )


def best_row(df: DataFrame, metric: str, order: str, by: list[str] | None = None) -> DataFrame:
    """The row with the smallest metric, the earliest of equals; one per `by` group. NULL and NaN lose."""
    columns = df.columns
    usable = df.where(F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double")))
    best = F.min_by(F.struct(*columns), F.struct(metric, order)).alias("_best")
    found = usable.groupBy(*(by or [])).agg(best).where("_best is not null")
    return found.select(*[F.col(f"_best.{c}").alias(c) for c in columns])


def strict_split(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose tokens reproduce the text (with `tokens`), and the others."""
    ok: Column = F.coalesce(tx.is_lossless(F.col(text)), F.lit(False))
    return df.where(ok).withColumn("tokens", tx.tokens(F.col(text))), df.where(~ok)
