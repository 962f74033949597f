"""A sequence generator as a table: which token follows which context, and how often."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenflow.functions import text as tx
from screenflow.functions.skew import dealt_out
from screenflow.functions.tokenized import transition_counts
from screenflow.session import materialize

SMALL_MODEL = 500_000  # (context, token) entries of a model that tasks may hold, some 100 MB


def _ending(context: Column, k: Column) -> Column:
    """The last k tokens, or all if there are fewer."""
    kept = F.least(k, F.size(context))
    return F.slice(context, F.size(context) - kept + 1, kept)


def fit_ngram(df: DataFrame, text: str, order: int = 2, parts: int | None = None) -> DataFrame:
    """Counts (length, context, next, count) for the full context and every shorter one.

    Texts are expanded once, for the full context; shorter contexts are its ends, so their counts
    are sums of the counted rows. `parts`: see `dealt_out`.
    """
    full = transition_counts(dealt_out(df, parts), text, order)
    endings = F.transform(
        F.sequence(F.lit(0), F.lit(order)),
        lambda k: F.struct(k.alias("length"), _ending(F.col("context"), k).alias("context")),
    )
    return (
        full.select(F.inline(endings), "next", "count")
        .groupBy("length", "context", "next")
        .agg(F.sum("count").alias("count"))
    )


def score_sequences(df: DataFrame, text: str, model: DataFrame, split: str, order: int = 2) -> DataFrame:
    """Mean negative log-likelihood per target token, by split.

    The probability of a token is (count + 1) / (context total + number of known tokens) in the
    longest context the model has seen, so an unseen context falls back to a shorter one. Equal
    (context, token) pairs are counted before anything is joined.
    """
    model = materialize(model)  # every length is looked up in it
    asked = transition_counts(df, text, order, [split]).withColumnRenamed("count", "n")
    totals = model.groupBy("length", "context").agg(F.sum("count").alias("total"))
    known = model.where("length = 0").agg(F.count(F.lit(1)).alias("known")).scalar()
    joined = asked
    for k in range(order, 0, -1):
        seen = totals.where(F.col("length") == k).select(
            F.col("context").alias(f"c{k}"), F.col("total").alias(f"total{k}")
        )
        hits = model.where(F.col("length") == k).select(
            F.col("context").alias(f"c{k}"), "next", F.col("count").alias(f"count{k}")
        )
        joined = joined.withColumn(f"c{k}", _ending(F.col("context"), F.lit(k))).join(seen, f"c{k}", "left")
        joined = joined.join(hits, [f"c{k}", "next"], "left")
    # The empty context is one row for everything: its total is a constant, not a join key.
    single = model.where("length = 0")
    joined = joined.join(single.select("next", F.col("count").alias("count0")), "next", "left")
    joined = joined.withColumn("total0", single.agg(F.sum("count").alias("total")).scalar())
    probability = F.lit(None).cast("double")
    for k in range(order + 1):
        smoothed = (F.coalesce(F.col(f"count{k}"), F.lit(0)) + 1) / (F.col(f"total{k}") + known)
        probability = F.when(F.col(f"total{k}").isNotNull(), smoothed).otherwise(probability)
    return (
        joined.withColumn("loss", -F.ln(probability) * F.col("n"))
        .groupBy(split)
        .agg(F.sum("n").alias("n_tokens"), (F.sum("loss") / F.sum("n")).alias("mean_loss"))
    )


def _choices(model: DataFrame, order: int, temperature: float) -> DataFrame:
    """Per full context the possible tokens and their running weights count^(1/T)."""
    usable = model.where((F.col("length") == order) & ~F.col("next").isin(tx.PAD, tx.BOS, tx.UNK))
    weight = F.pow(F.col("count").cast("double"), F.lit(1.0 / temperature))
    weighted = usable.select("context", "next", weight.alias("w"))
    return weighted.groupBy("context").agg(F.array_sort(F.collect_list(F.struct("next", "w"))).alias("options"))


def _uniform(seed: Column, step: Column) -> Column:
    digest = F.md5(F.concat_ws(":", seed, F.col("id").cast("string"), step.cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)


def _draw(uniforms: Callable[[int], float], options: dict, order: int, max_length: int) -> str:
    """One text, token by token; `options` has the running weights and the tokens of every context."""
    made: list[str] = []
    context = (tx.BOS,)
    for step in range(max_length - 1):
        offered = options.get(context)
        if offered is None:
            break
        weights, tokens = offered
        k = bisect_right(weights, uniforms(step) * weights[-1])
        if k == len(tokens) or tokens[k] == tx.EOS:
            break
        made.append(tokens[k])
        context = (*context, tokens[k])[-order:]
    return "".join(made)


def _drawn_in_tasks(choices: DataFrame, n: int, max_length: int, order: int, seed: int) -> DataFrame:
    """Whole texts drawn at a time, with the model in every task."""
    spark = choices.sparkSession
    options = {}
    for row in choices.collect():  # at most SMALL_MODEL entries
        options[tuple(row["context"])] = list(accumulate(o["w"] for o in row["options"])), [o["next"] for o in row["options"]]
    sent = spark.sparkContext.broadcast(options)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [
                _draw(lambda step, i=i: int(hashlib.md5(f"{seed}:{i}:{step}".encode()).hexdigest()[:12], 16) / 16**12, sent.value, order, max_length)
                for i in ids
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "generated"])

    parts = max(1, min(n, 8 * spark.sparkContext.defaultParallelism))
    return spark.range(0, n, 1, parts).mapInArrow(draw, "id long, generated string")


def sample_sequences(
    model: DataFrame, n: int, max_length: int, order: int = 2, temperature: float = 1.0, seed: int = 42, small: int = SMALL_MODEL
) -> DataFrame:
    """Draw n texts (id, generated) token by token from BOS.

    Drawing stops at EOS, at a context without options, or after max_length - 1 tokens; PAD, BOS and
    UNK are never drawn. Random numbers depend on (seed, id, step) alone, so the texts do not depend
    on the partitioning. A model of at most `small` entries goes to the tasks, which draw whole texts;
    with a larger one every step looks all open sequences up in it, with the same outcome.
    """
    choices = _choices(model, order, temperature)
    spark = choices.sparkSession
    choices = materialize(choices)
    if (choices.agg(F.sum(F.size("options"))).first()[0] or 0) <= small:
        return _drawn_in_tasks(choices, n, max_length, order, seed)
    state = spark.range(n).withColumns({"made": F.array().cast("array<string>"), "open": F.lit(True)})
    for step in range(max_length - 1):
        tail = F.concat(F.array(F.lit(tx.BOS)), F.col("made"))
        tail = F.slice(tail, F.greatest(F.size(tail) - order + 1, F.lit(1)), F.lit(order))
        # Closed sequences ask for nothing. Many sequences share a context: adaptive execution splits
        # them, or broadcasts a small model.
        offered = state.withColumn("context", F.when(F.col("open"), tail)).join(choices, "context", "left")
        total = F.aggregate("options", F.lit(0.0), lambda acc, o: acc + o["w"])
        target = _uniform(F.lit(str(seed)), F.lit(step)) * total
        walk = F.aggregate(
            "options",
            F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("string").alias("pick")),
            lambda acc, o: F.struct(
                (acc["sum"] + o["w"]).alias("sum"),
                F.coalesce(acc["pick"], F.when(acc["sum"] + o["w"] > target, o["next"])).alias("pick"),
            ),
            lambda acc: acc["pick"],
        )
        drawn = offered.withColumn("_token", walk)
        goes_on = F.coalesce(F.col("_token") != tx.EOS, F.lit(False))
        grown = F.when(goes_on, F.concat("made", F.array("_token"))).otherwise(F.col("made"))
        state = materialize(drawn.select("id", grown.alias("made"), goes_on.alias("open")))
        if state.where("open").isEmpty():
            break
    return state.select("id", F.array_join("made", "").alias("generated"))
