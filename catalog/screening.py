"""Rules, scores, fronts and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.common import Case, rounded, table, token_list
from screenflow.functions.bits import token_bits
from screenflow.functions.text import tokens
from screenflow.operators import screening
from screenflow.plans.ranking import rank_candidates
from screenflow.session import materialize

LIMITS = {"p_size": 25.0, "p_retailprice": 950.0}


def _parts(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")


def _screened(spark, sf) -> DataFrame:
    """Parts with rule flags, and whether they lie in the range of the development parts (sizes 5 to 45)."""
    parts = screening.rule_violations(_parts(spark, sf), LIMITS)
    return screening.inside_range(parts, parts.where("p_size between 5 and 45"), ["p_size", "p_retailprice"])


SCREENED = """v AS (SELECT p_partkey, p_name, p_size, p_retailprice, p_size > 25 AS p_size_violation,
  p_retailprice > 950 AS p_retailprice_violation,
  CAST(p_size > 25 AS INTEGER) + CAST(p_retailprice > 950 AS INTEGER) AS violations FROM part),
dev AS (SELECT MIN(p_size) AS a, MAX(p_size) AS b, MIN(p_retailprice) AS c, MAX(p_retailprice) AS d FROM part WHERE p_size BETWEEN 5 AND 45),
s AS (SELECT v.*, violations = 0 AS compliant, CAST(p_size < a OR p_size > b AS INTEGER) + CAST(p_retailprice < c OR p_retailprice > d AS INTEGER)
  AS n_outside FROM v, dev),
screened AS (SELECT *, n_outside = 0 AS inside FROM s)"""


def _kept(spark, sf) -> DataFrame:
    return screening.candidate_filter(_screened(spark, sf), "p_size", "violations", "inside", 10, 1)


KEPT = f"""{SCREENED}, kept AS (SELECT * FROM screened WHERE p_size >= 10 AND violations <= 1 AND inside)"""


def _scored(spark, sf) -> DataFrame:
    ranked = screening.percent_rank_avg(_kept(spark, sf), "p_retailprice", "price_score", ["p_partkey"])
    ranked = screening.percent_rank_avg(ranked, "p_size", "size_score", ["p_partkey"])
    ranked = ranked.withColumn("rule_score", screening.clipped_score(F.col("violations")))
    a, b, c = screening.WEIGHTS
    weights = {"price_score": a, "size_score": b, "rule_score": c}
    return ranked.withColumn("score", F.round(screening.weighted_score(weights), 9))


SCORED = f"""{KEPT}, ranks AS (SELECT *,
  (RANK() OVER (ORDER BY p_retailprice) + (COUNT(*) OVER (PARTITION BY p_retailprice) - 1) / 2) / COUNT(*) OVER () AS price_score,
  (RANK() OVER (ORDER BY p_size) + (COUNT(*) OVER (PARTITION BY p_size) - 1) / 2) / COUNT(*) OVER () AS size_score,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - violations / 4.0::DOUBLE)) AS rule_score FROM kept),
scored AS (SELECT *, ROUND(0.45::DOUBLE * price_score + 0.35::DOUBLE * size_score + 0.20::DOUBLE * rule_score, 9) AS score FROM ranks)"""

FRONT = f"""{SCORED}, ordered AS (SELECT *, MAX(p_size) OVER (ORDER BY p_retailprice DESC, p_size DESC, p_partkey
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM scored),
fronted AS (SELECT *, coalesce(p_size > best, true) AS pareto_front FROM ordered)"""


def _fronted(spark, sf) -> DataFrame:
    return screening.pareto_front(materialize(_scored(spark, sf)), "p_retailprice", "p_size", "p_partkey")


def _flagged(spark, sf) -> DataFrame:
    candidate = (F.col("p_size") >= 10) & (F.col("violations") <= 1) & F.col("inside")
    return _screened(spark, sf).withColumn("candidate", candidate)


def ranked(spark, sf) -> DataFrame:
    return screening.overall_rank(_fronted(spark, sf), "pareto_front", "score", "p_partkey")


def summarized(spark, sf) -> DataFrame:
    """The whole ranking: filter, score, front, rank, diverse choice by the tokens of the name."""
    parts = _screened(spark, sf).withColumn("bits", token_bits(tokens(F.col("p_name")), 2048, 2))
    result = rank_candidates(
        parts,
        row_id="p_partkey",
        objectives=("p_retailprice", "p_size"),
        score="p_size",
        violations="violations",
        inside="inside",
        bits="bits",
        min_score=10,
        n_diverse=100,
    )
    return result.summary


# Down the ranking one row per step, with the list of what is accepted so far.
SUMMARY = f"""WITH RECURSIVE {FRONT},
named AS (SELECT p_partkey, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM (SELECT p_partkey, {token_list("p_name")} AS t FROM part)),
near AS (SELECT p_partkey, x, x || lead(x, 1) OVER w AS x2, x || lead(x, 1) OVER w || lead(x, 2) OVER w AS x3
  FROM named WINDOW w AS (PARTITION BY p_partkey ORDER BY i)),
grams AS (SELECT p_partkey, x AS g FROM near UNION SELECT p_partkey, x2 FROM near WHERE x2 IS NOT NULL
  UNION SELECT p_partkey, x3 FROM near WHERE x3 IS NOT NULL),
masks AS (SELECT p_partkey, bitstring_agg(bit, 0, 2047) AS mask FROM
  (SELECT DISTINCT p_partkey, CAST(('0x' || substr(md5(g), 1, 8))::BIGINT % 2048 AS INTEGER) AS bit FROM grams) GROUP BY p_partkey),
ranked AS MATERIALIZED (SELECT mask, ROW_NUMBER() OVER (ORDER BY pareto_front DESC,
  0.45::DOUBLE * price_score + 0.35::DOUBLE * size_score + 0.20::DOUBLE * rule_score DESC, p_partkey) AS k FROM fronted JOIN masks USING (p_partkey)),
walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIT[]) AS taken
  UNION ALL SELECT r.k, CASE WHEN coalesce(list_max(list_transform(taken,
      lambda m: bit_count(m & mask) / CAST(bit_count(m | mask) AS DOUBLE))), 0.0::DOUBLE) <= 0.65::DOUBLE THEN list_append(taken, mask) ELSE taken END
  FROM walk w JOIN ranked r ON r.k = w.k + 1 WHERE len(taken) < 100)
SELECT (SELECT COUNT(*) FROM part) AS n_input, COUNT(*) AS n_after_filter, COUNT(*) FILTER (pareto_front) AS n_pareto,
  CAST((SELECT MAX(len(taken)) FROM walk) AS BIGINT) AS n_diverse_selected, 10.0::DOUBLE AS min_score, 1 AS max_violations,
  0.45::DOUBLE AS weight_first, 0.35::DOUBLE AS weight_second, 0.20::DOUBLE AS weight_rules, 0.65::DOUBLE AS diversity_limit FROM fronted"""

CASES: dict[str, Case] = {
    "rule_violations": (
        lambda spark, sf: screening.rule_violations(_parts(spark, sf), LIMITS).drop("p_name"),
        f"""WITH {SCREENED} SELECT p_partkey, p_size, p_retailprice, p_size_violation, p_retailprice_violation, violations,
compliant FROM screened""",
    ),
    "inside_range": (
        lambda spark, sf: _screened(spark, sf).select("p_partkey", "n_outside", "inside"),
        f"WITH {SCREENED} SELECT p_partkey, n_outside, inside FROM screened",
    ),
    "inside_range_lineitem": (
        lambda spark, sf: screening.inside_range(
            table(spark, sf, "lineitem"),
            table(spark, sf, "lineitem").where("l_discount between 0.02 and 0.08"),
            ["l_discount", "l_quantity"],
        ).groupBy("n_outside", "inside").agg(F.count(F.lit(1)).alias("n")),
        """WITH d AS (SELECT MIN(l_discount) AS a, MAX(l_discount) AS b, MIN(l_quantity) AS c, MAX(l_quantity) AS e FROM lineitem
WHERE l_discount BETWEEN 0.02::DOUBLE AND 0.08::DOUBLE),
o AS (SELECT CAST(l_discount < a OR l_discount > b AS INTEGER) + CAST(l_quantity < c OR l_quantity > e AS INTEGER) AS n_outside FROM lineitem, d)
SELECT n_outside, n_outside = 0 AS inside, COUNT(*) AS n FROM o GROUP BY ALL""",
    ),
    "power10": (
        lambda spark, sf: _parts(spark, sf).withColumn("l", F.col("p_size") / 10.0).select(
            "p_partkey", F.round(screening.power10("l"), 3).alias("power")
        ),
        "SELECT p_partkey, ROUND(pow(10.0::DOUBLE, p_size / 10.0::DOUBLE), 3) AS power FROM part",
    ),
    "candidate_filter": (
        lambda spark, sf: _kept(spark, sf).select("p_partkey", "p_size", "violations"),
        f"WITH {KEPT} SELECT p_partkey, p_size, violations FROM kept",
    ),
    "retained": (
        lambda spark, sf: rounded(
            screening.retained(_screened(spark, sf), "p_size", "violations", "inside", 10, 1), "fraction_kept"
        ),
        f"""WITH {KEPT} SELECT (SELECT COUNT(*) FROM part) AS n_input, COUNT(*) AS n_kept,
ROUND(COUNT(*) / (SELECT COUNT(*) FROM part), 6) AS fraction_kept FROM kept""",
    ),
    "percent_rank_avg": (
        lambda spark, sf: rounded(
            screening.percent_rank_avg(_parts(spark, sf), "p_retailprice", "share", ["p_partkey"]).select("p_partkey", "share"),
            "share",
            digits=9,
        ),
        """SELECT p_partkey, ROUND((RANK() OVER (ORDER BY p_retailprice) + (COUNT(*) OVER (PARTITION BY p_retailprice) - 1) / 2)
/ COUNT(*) OVER (), 9) AS share FROM part""",
    ),
    "percent_rank_lineitem": (
        lambda spark, sf: rounded(
            screening.percent_rank_avg(
                table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"),
                "l_quantity",
                "share",
                ["l_orderkey", "l_linenumber"],
            ),
            "share",
            digits=9,
        ),
        """SELECT l_orderkey, l_linenumber, l_quantity, ROUND((RANK() OVER (ORDER BY l_quantity)
+ (COUNT(*) OVER (PARTITION BY l_quantity) - 1) / 2) / COUNT(*) OVER (), 9) AS share FROM lineitem""",
    ),
    "clipped_score": (
        lambda spark, sf: _parts(spark, sf).select(
            "p_partkey", F.round(screening.clipped_score(F.col("p_size") / 10), 6).alias("score")
        ),
        """SELECT p_partkey, ROUND(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - p_size / 10 / 4.0::DOUBLE)), 6) AS score
FROM part""",
    ),
    "weighted_score": (
        lambda spark, sf: _scored(spark, sf).select("p_partkey", "score"),
        f"WITH {SCORED} SELECT p_partkey, score FROM scored",
    ),
    "pareto_front": (
        lambda spark, sf: _fronted(spark, sf).select("p_partkey", "p_retailprice", "p_size", "pareto_front"),
        f"WITH {FRONT} SELECT p_partkey, p_retailprice, p_size, pareto_front FROM fronted",
    ),
    "pareto_front_orders": (
        lambda spark, sf: screening.pareto_front(
            table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), "o_totalprice", "o_custkey", "o_orderkey"
        ),
        """SELECT o_orderkey, o_totalprice, o_custkey, coalesce(o_custkey > MAX(o_custkey) OVER (ORDER BY o_totalprice DESC,
o_custkey DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS pareto_front FROM orders""",
    ),
    "overall_rank": (
        lambda spark, sf: ranked(spark, sf).select("p_partkey", "pareto_front", "score", "overall_rank"),
        f"""WITH {FRONT} SELECT p_partkey, pareto_front, score,
ROW_NUMBER() OVER (ORDER BY pareto_front DESC, score DESC, p_partkey) AS overall_rank FROM fronted""",
    ),
    "rank_by": (
        lambda spark, sf: screening.rank_by(_parts(spark, sf).drop("p_name"), ["p_size", "p_retailprice"], "p_partkey", 100),
        """SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 100""",
    ),
    "screening_summary": (
        lambda spark, sf: rounded(
            screening.screening_summary(_flagged(spark, sf), "p_size", "p_retailprice", "compliant", "inside", "candidate"),
            "mean_score",
            "mean_prediction",
            "compliant_fraction",
            "inside_fraction",
            "candidate_fraction",
            "median_score",
            "median_prediction",
        ),
        f"""WITH {SCREENED}, f AS (SELECT *, p_size >= 10 AND violations <= 1 AND inside AS candidate FROM screened)
SELECT COUNT(*) AS n_rows, ROUND(AVG(p_size), 6) AS mean_score, ROUND(AVG(p_retailprice), 6) AS mean_prediction,
ROUND(AVG(CAST(compliant AS INTEGER)), 6) AS compliant_fraction, ROUND(AVG(CAST(inside AS INTEGER)), 6) AS inside_fraction,
COUNT(*) FILTER (candidate) AS candidate_count, ROUND(AVG(CAST(candidate AS INTEGER)), 6) AS candidate_fraction,
ROUND(quantile_cont(p_size, 0.5), 6) AS median_score, ROUND(quantile_cont(p_retailprice, 0.5), 6) AS median_prediction FROM f""",
    ),
    "ranking_summary": (summarized, SUMMARY),
}
