"""Splits by group."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import Case, lineitem_rows, rounded, table
from screenflow.operators import splits

# The largest group first, to the split with the most room left: one group per step.
GROUP_SPLIT = """WITH RECURSIVE g AS (SELECT l_partkey, COUNT(*) AS size FROM lineitem GROUP BY l_partkey),
ranked AS MATERIALIZED (SELECT l_partkey, size, ROW_NUMBER() OVER (ORDER BY size DESC, l_partkey) AS k FROM g),
t AS (SELECT CAST(floor(n * 0.8) AS BIGINT) AS a, CAST(floor(n * 0.1) AS BIGINT) AS b, n FROM (SELECT COUNT(*) AS n FROM lineitem)),
walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS l_partkey, CAST(NULL AS BIGINT) AS size, '' AS split,
    a AS ra, b AS rb, n - a - b AS rc FROM t
  UNION ALL SELECT k, l_partkey, size, split,
    ra - CASE WHEN split = 'train' THEN size ELSE 0 END, rb - CASE WHEN split = 'validation' THEN size ELSE 0 END,
    rc - CASE WHEN split = 'test' THEN size ELSE 0 END
  FROM (SELECT r.k, r.l_partkey, r.size, ra, rb, rc,
      CASE WHEN ra >= rb AND ra >= rc THEN 'train' WHEN rb >= rc THEN 'validation' ELSE 'test' END AS split
    FROM walk w JOIN ranked r ON r.k = w.k + 1))
SELECT l_partkey, size, split FROM walk WHERE k > 0"""


def assigned(spark, sf):
    """Rows per split and return flag once every row has the split of its part."""
    rows = lineitem_rows(spark, sf).select("l_partkey", "l_returnflag", "row_id", "l_extendedprice")
    placed = splits.assign_split(rows, "l_partkey", splits.group_split(rows, "l_partkey"), ["row_id"])
    return placed


def checked_counts(spark, sf):
    """Rows and parts per split, after the check that no part is in two splits."""
    checked = splits.leakage_check(assigned(spark, sf), "l_partkey")
    return checked.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("n_groups"))


CASES: dict[str, Case] = {
    "group_sizes": (
        lambda spark, sf: splits.group_sizes(table(spark, sf, "lineitem"), "l_partkey"),
        "SELECT l_partkey, COUNT(*) AS size FROM lineitem GROUP BY l_partkey",
    ),
    "largest_groups": (
        lambda spark, sf: splits.largest_groups(table(spark, sf, "lineitem"), "l_partkey"),
        "SELECT l_partkey, COUNT(*) AS size FROM lineitem GROUP BY l_partkey ORDER BY size DESC, l_partkey LIMIT 15",
    ),
    "group_split": (
        lambda spark, sf: splits.group_split(table(spark, sf, "lineitem"), "l_partkey"),
        GROUP_SPLIT,
    ),
    "assign_split": (
        lambda spark, sf: assigned(spark, sf).select("l_partkey", "row_id", "split"),
        f"""WITH s AS ({GROUP_SPLIT}) SELECT l.l_partkey, l_orderkey * 10 + l_linenumber AS row_id, split
FROM lineitem l JOIN s ON s.l_partkey = l.l_partkey""",
    ),
    "leakage_check": (
        checked_counts,
        f"""WITH s AS ({GROUP_SPLIT})
SELECT split, CAST(SUM(size) AS BIGINT) AS n, COUNT(*) AS n_groups FROM s GROUP BY split""",
    ),
    "leaking_groups": (
        lambda spark, sf: splits.leaking_groups(table(spark, sf, "orders"), "o_custkey", "o_orderstatus"),
        """SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(DISTINCT o_orderstatus) > 1""",
    ),
    "split_summary": (
        lambda spark, sf: rounded(
            splits.split_summary(table(spark, sf, "lineitem"), "l_returnflag", "l_partkey", "l_extendedprice", ["A", "N", "R"]),
            "fraction",
            "mean_label",
            "std_label",
        ),
        """SELECT l_returnflag, COUNT(*) AS n, ROUND(COUNT(*) / (SELECT COUNT(*) FROM lineitem), 6) AS fraction,
COUNT(DISTINCT l_partkey) AS n_groups, ROUND(AVG(l_extendedprice), 6) AS mean_label,
ROUND(STDDEV_SAMP(l_extendedprice), 6) AS std_label, MIN(l_extendedprice) AS min_label, MAX(l_extendedprice) AS max_label
FROM lineitem GROUP BY l_returnflag""",
    ),
    "group_report": (
        lambda spark, sf: rounded(
            splits.group_report(table(spark, sf, "lineitem"), "l_partkey", "l_returnflag", "l_extendedprice"), "mean_label"
        ),
        """SELECT l_partkey, l_returnflag, COUNT(*) AS n, ROUND(AVG(l_extendedprice), 6) AS mean_label
FROM lineitem GROUP BY l_partkey, l_returnflag""",
    ),
}
