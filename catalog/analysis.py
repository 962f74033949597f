"""Error analysis and distribution comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.common import Case, rounded, table
from screenflow.operators import distributions, errors

PROPERTIES = ["l_quantity", "l_extendedprice", "l_tax"]
EDGES = [0.0, 0.02, 0.04, 0.06, 0.2, 0.3]
LABELS = ["<0.02", "0.02-0.03", "0.04-0.05", "0.06-0.19", ">=0.20"]


def _errors(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two guesses of an order's price: a constant, and the sum of its items."""
    orders = table(spark, sf, "orders")
    a = orders.select("o_orderkey", F.round(F.abs(F.col("o_totalprice") - 200000.0), 2).alias("error_mean"))
    sums = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_extendedprice").alias("items")
    )
    b = orders.join(sums, "o_orderkey").select(
        "o_orderkey", F.round(F.abs(F.col("o_totalprice") - F.col("items")), 2).alias("error_items")
    )
    return a, b


ERRORS = """sums AS (SELECT l_orderkey, SUM(l_extendedprice) AS items FROM lineitem GROUP BY l_orderkey),
e AS (SELECT o_orderkey, ROUND(abs(o_totalprice - 200000.0), 2) AS error_mean, ROUND(abs(o_totalprice - items), 2) AS error_items
  FROM orders JOIN sums ON l_orderkey = o_orderkey),
c AS (SELECT *, error_items - error_mean AS d, CASE WHEN error_items < error_mean THEN 'items'
  WHEN error_items > error_mean THEN 'mean' ELSE 'tie' END AS better_model FROM e)"""


def compared(spark, sf) -> DataFrame:
    return errors.compare_models(*_errors(spark, sf), ["o_orderkey"], "error_mean", "error_items", ("mean", "items"))


def _halves(spark, sf) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf, "lineitem")
    return items.where("l_returnflag = 'A'"), items.where("l_returnflag <> 'A'")


def _side(column: str) -> str:
    return f"CASE WHEN l_returnflag = 'A' THEN 'reference' ELSE 'generated' END AS source, {column} AS v"


SUMMARY = "\nUNION ALL ".join(
    f"""SELECT '{c}' AS property, source, COUNT(v) AS n, ROUND(AVG(v), 6) AS mean, ROUND(STDDEV_SAMP(v), 6) AS std,
ROUND(quantile_cont(v, 0.5), 6) AS median, MIN(v) AS min, MAX(v) AS max FROM (SELECT {_side(c)} FROM lineitem) GROUP BY source"""
    for c in PROPERTIES
)

KS = "\nUNION ALL ".join(
    f"""SELECT '{c}' AS property, ROUND(MAX(abs(ca / ta - cb / tb)), 9) AS ks_statistic, ROUND(MAX(ma), 6) AS mean_a,
ROUND(MAX(mb), 6) AS mean_b, ROUND(MAX(mb) - MAX(ma), 6) AS mean_difference FROM
(SELECT SUM(a) OVER (ORDER BY v) AS ca, SUM(b) OVER (ORDER BY v) AS cb FROM
  (SELECT v, COUNT(*) FILTER (source = 'reference') AS a, COUNT(*) FILTER (source = 'generated') AS b
   FROM (SELECT {_side(c)} FROM lineitem) GROUP BY v)),
(SELECT COUNT(v) FILTER (source = 'reference') AS ta, COUNT(v) FILTER (source = 'generated') AS tb,
  AVG(v) FILTER (source = 'reference') AS ma, AVG(v) FILTER (source = 'generated') AS mb FROM (SELECT {_side(c)} FROM lineitem))"""
    for c in PROPERTIES
)

# Twice the exact one-sided tail for the effective size, less what the series counts on both sides.
KS_P = "WITH d AS (" + "\nUNION ALL ".join(
    f"""SELECT '{c}' AS property, MAX(abs(ca / ta - cb / tb)) AS d, MAX(ma) AS mean_a, MAX(mb) AS mean_b,
sqrt(MAX(ta) * MAX(tb) / (MAX(ta) + MAX(tb))) AS s FROM
(SELECT SUM(a) OVER (ORDER BY v) AS ca, SUM(b) OVER (ORDER BY v) AS cb FROM
  (SELECT v, COUNT(*) FILTER (source = 'reference') AS a, COUNT(*) FILTER (source = 'generated') AS b
   FROM (SELECT {_side(c)} FROM lineitem) GROUP BY v)),
(SELECT CAST(COUNT(v) FILTER (source = 'reference') AS DOUBLE) AS ta, CAST(COUNT(v) FILTER (source = 'generated') AS DOUBLE) AS tb,
  AVG(v) FILTER (source = 'reference') AS ma, AVG(v) FILTER (source = 'generated') AS mb FROM (SELECT {_side(c)} FROM lineitem))"""
    for c in PROPERTIES
) + """), n AS (SELECT *, CAST(round(s * s) AS BIGINT) AS n FROM d),
x AS (SELECT *, sqrt(n) * d + 1 / (6 * sqrt(n)) AS x FROM n),
tails AS (
  SELECT property, d * SUM(exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + (j - 1) * ln(d + j / n) + (n - j) * ln(1 - d - j / n))) AS tail
  FROM (SELECT property, d, CAST(n AS DOUBLE) AS n, CAST(unnest(generate_series(0, CAST(floor(n * (1 - d)) AS BIGINT))) AS DOUBLE) AS j FROM x WHERE d > 0 AND d < 1)
  WHERE 1 - d - j / n > 0 GROUP BY property, d)
SELECT property, ROUND(d, 9) AS ks_statistic, ROUND(CASE WHEN d <= 0 OR x < 0.2::DOUBLE THEN 1.0::DOUBLE WHEN d >= 1 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE,
  2 * tail - (SELECT SUM(2 * CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * exp(-2 * k * k * x * x)) FROM range(2, 101) r(k)))) END, 8) AS p_value,
ROUND(mean_a, 6) AS mean_a, ROUND(mean_b, 6) AS mean_b, ROUND(mean_b - mean_a, 6) AS mean_difference FROM x LEFT JOIN (SELECT property, tail FROM tails) USING (property)"""

SPEARMAN = """WITH r AS (SELECT
  RANK() OVER (ORDER BY l_quantity) + (COUNT(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rx,
  RANK() OVER (ORDER BY l_extendedprice) + (COUNT(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS ry FROM lineitem)
SELECT COUNT(*) AS n, ROUND(corr(rx, ry), 8) AS rho FROM r"""

# Student's t by Simpson's rule over the angle whose tangent is t / sqrt(freedom).
SPEARMAN_P = """WITH r AS (SELECT
  RANK() OVER (ORDER BY l_quantity) + (COUNT(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rx,
  RANK() OVER (ORDER BY l_tax) + (COUNT(*) OVER (PARTITION BY l_tax) - 1) / 2 AS ry FROM lineitem),
c AS (SELECT COUNT(*) AS n, corr(rx, ry) AS rho, CAST(COUNT(*) - 2 AS DOUBLE) AS v, asin(abs(corr(rx, ry))) AS angle FROM r),
steps AS (SELECT SUM(CASE WHEN k IN (0, 20000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(cos(angle * k / 20000), v - 1)) * angle / 60000 AS area
  FROM c, range(20001) s(k) GROUP BY angle)
SELECT n, ROUND(rho, 8) AS rho,
  ROUND(1 - 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(pi()) * area, 8) AS p_value FROM c, steps"""

BINNED = f"""WITH b(k, bin, lo, hi) AS (VALUES {", ".join(f"({i}, '{n}', {EDGES[i]}::DOUBLE, {EDGES[i + 1]}::DOUBLE)" for i, n in enumerate(LABELS))})
SELECT bin, COUNT(l_discount) AS n, ROUND(AVG(l_discount), 6) AS mean_discount, ROUND(AVG(l_extendedprice), 6) AS mean_price
FROM b LEFT JOIN lineitem ON l_discount >= lo AND l_discount < hi GROUP BY bin"""

HISTOGRAM = """WITH m AS (SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi, (MAX(l_extendedprice) - MIN(l_extendedprice)) / 20 AS w FROM lineitem),
c AS (SELECT l_returnflag, CAST(least(floor((l_extendedprice - lo) / w), 19) AS INTEGER) AS bin, COUNT(*) AS n FROM lineitem, m GROUP BY ALL),
every AS (SELECT l_returnflag, CAST(b AS INTEGER) AS bin, total FROM (SELECT l_returnflag, COUNT(*) AS total FROM lineitem GROUP BY ALL), range(20) r(b))
SELECT e.l_returnflag, e.bin, coalesce(n, 0) AS n, ROUND(lo + e.bin * w, 4) AS bin_low, ROUND(lo + (e.bin + 1) * w, 4) AS bin_high,
ROUND(coalesce(n, 0) / (total * w), 12) AS density FROM every e LEFT JOIN c USING (l_returnflag, bin), m"""


def histogram(spark, sf) -> DataFrame:
    found = errors.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 20, density=True, by=["l_returnflag"])
    return rounded(rounded(found, "bin_low", "bin_high", digits=4), "density", digits=12)


def labelled(spark, sf) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return errors.label_rows(
        rows, ["p_size", "p_partkey"], [False, True], "%d: size %d, price %.2f", ["p_partkey", "p_size", "p_retailprice"]
    )


CASES: dict[str, Case] = {
    "compare_models": (
        lambda spark, sf: rounded(compared(spark, sf), "absolute_error_difference", digits=2),
        f"""WITH {ERRORS} SELECT o_orderkey, error_mean, error_items, ROUND(d, 2) AS absolute_error_difference, better_model FROM c""",
    ),
    "difference_stats": (
        lambda spark, sf: rounded(
            errors.difference_stats(compared(spark, sf)), "mean_difference", "median_difference", digits=4
        ),
        f"""WITH {ERRORS} SELECT better_model, COUNT(*) AS n, ROUND((SELECT AVG(d) FROM c), 4) AS mean_difference,
ROUND((SELECT quantile_cont(d, 0.5) FROM c), 4) AS median_difference FROM c GROUP BY better_model""",
    ),
    "spearman": (
        lambda spark, sf: rounded(
            errors.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", p_value=False), "rho", digits=8
        ),
        SPEARMAN,
    ),
    "spearman_p_value": (
        lambda spark, sf: rounded(errors.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_tax"), "rho", "p_value", digits=8),
        SPEARMAN_P,
    ),
    "bin_and_aggregate": (
        lambda spark, sf: rounded(
            errors.bin_and_aggregate(
                table(spark, sf, "lineitem"),
                "l_discount",
                EDGES,
                LABELS,
                [F.avg("l_discount").alias("mean_discount"), F.avg("l_extendedprice").alias("mean_price")],
            ),
            "mean_discount",
            "mean_price",
        ),
        BINNED,
    ),
    "axis_limits": (
        lambda spark, sf: errors.axis_limits(table(spark, sf, "lineitem"), "l_discount", "l_tax"),
        "SELECT least(MIN(l_discount), MIN(l_tax)) AS low, greatest(MAX(l_discount), MAX(l_tax)) AS high FROM lineitem",
    ),
    "histogram": (histogram, HISTOGRAM),
    "label_rows": (
        labelled,
        """SELECT p_partkey, p_size, p_retailprice, printf('%d: size %d, price %.2f', p_partkey, p_size, p_retailprice) AS label
FROM part ORDER BY p_size DESC, p_partkey LIMIT 20""",
    ),
    "property_summary": (
        lambda spark, sf: rounded(
            distributions.property_summary(*_halves(spark, sf), PROPERTIES), "mean", "std", "median"
        ),
        SUMMARY,
    ),
    "ks_two_sample": (
        lambda spark, sf: rounded(
            rounded(
                distributions.ks_two_sample(*_halves(spark, sf), PROPERTIES, p_value=False),
                "mean_a",
                "mean_b",
                "mean_difference",
            ),
            "ks_statistic",
            digits=9,
        ),
        KS,
    ),
    "ks_p_values": (
        lambda spark, sf: rounded(
            rounded(
                rounded(distributions.ks_two_sample(*_halves(spark, sf), PROPERTIES), "p_value", digits=8),
                "mean_a",
                "mean_b",
                "mean_difference",
            ),
            "ks_statistic",
            digits=9,
        ),
        KS_P,
    ),
}
