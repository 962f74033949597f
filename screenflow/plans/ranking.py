"""Screen, score, rank and diversify candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenflow.operators import screening
from screenflow.operators.diversity import diverse_pick
from screenflow.session import materialize


@dataclass
class Ranking:
    ranked: DataFrame
    front: DataFrame
    diverse: DataFrame
    summary: DataFrame


def rank_candidates(
    df: DataFrame,
    row_id: str,
    objectives: tuple[str, str],
    score: str,
    violations: str,
    inside: str | None,
    bits: str,
    min_score: float = screening.MIN_SCORE,
    max_violations: int = screening.MAX_VIOLATIONS,
    weights: tuple[float, float, float] = screening.WEIGHTS,
    n_diverse: int = 100,
    max_similarity: float = 0.65,
) -> Ranking:
    """Hard filter, percentile scores of two objectives, front, overall rank, diverse choice."""
    first, second = objectives
    kept = screening.require_candidates(
        screening.candidate_filter(df, score, violations, inside, min_score, max_violations)
    )
    scored = screening.percent_rank_avg(kept, first, "first_score", [row_id])
    scored = screening.percent_rank_avg(scored, second, "second_score", [row_id])
    scored = scored.withColumn("rule_score", screening.clipped_score(F.col(violations)))
    parts = dict(zip(("first_score", "second_score", "rule_score"), weights))
    scored = materialize(scored.withColumn("multiobjective_score", screening.weighted_score(parts)))
    marked = screening.pareto_front(scored, first, second, row_id)
    ranked = screening.overall_rank(marked, "pareto_front", "multiobjective_score", row_id)
    diverse = diverse_pick(ranked, "overall_rank", bits, n_diverse, max_similarity)
    summary = screening.ranking_summary(
        df.count(),
        ranked,
        "pareto_front",
        diverse.count(),
        {
            "min_score": float(min_score),
            "max_violations": max_violations,
            "weight_first": weights[0],
            "weight_second": weights[1],
            "weight_rules": weights[2],
            "diversity_limit": max_similarity,
        },
    )
    return Ranking(ranked, ranked.where("pareto_front"), diverse, summary)
