"""A diverse choice from a ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenflow.functions.bits import tanimoto
from screenflow.functions.literals import array_constant


def _similarity(a: frozenset[int], b: frozenset[int]) -> float:
    both = len(a & b)
    union = len(a) + len(b) - both
    return both / union if union else 0.0


def diverse_pick(
    ranked: DataFrame,
    rank: str,
    bits: str = "bits",
    n: int = 100,
    max_similarity: float = 0.65,
    first_window: int = 10_000,
) -> DataFrame:
    """Go down the ranking and accept rows not too similar to any accepted before; stop at n.

    `rank` numbers the rows 1, 2, 3 ... Rows are looked at in growing windows of ranks. Spark drops
    those too close to what is accepted so far; the head of the others, a small multiple of n, is
    settled among itself on the driver. Only the n accepted rows are kept there.
    """
    spark = ranked.sparkSession
    usable = ranked.where(F.col(bits).isNotNull())
    last_rank = usable.agg(F.max(rank).alias("r")).first()["r"] or 0
    accepted: list[tuple[int, frozenset[int], float]] = []
    head, low, window = 4 * n, 0, first_window
    while len(accepted) < n and low < last_rank:
        rows = usable.where((F.col(rank) > low) & (F.col(rank) <= low + window))
        if accepted:
            taken = array_constant([sorted(a[1]) for a in accepted], "array<array<int>>")
            close = F.exists(
                taken, lambda other: F.coalesce(tanimoto(F.col(bits), other), F.lit(0.0)) > max_similarity
            )
            rows = rows.where(~close)
        front = rows.select(rank, bits).orderBy(rank).limit(head).collect()
        for row in front:
            mine = frozenset(row[bits])
            nearest = max((_similarity(mine, a[1]) for a in accepted), default=0.0)
            if nearest <= max_similarity:
                accepted.append((row[rank], mine, nearest))
            if len(accepted) == n:
                break
        if len(front) < head:  # the window is done
            low, window = low + window, window * 4
        else:
            low = front[-1][rank]
    chosen = spark.createDataFrame(
        [(r, s, i + 1) for i, (r, _, s) in enumerate(accepted)],
        f"{rank} long, max_similarity_to_previous_selected double, diverse_rank int",
    )
    return ranked.join(F.broadcast(chosen), rank)  # n rows
