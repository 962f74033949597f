"""Sources, quality, duplicates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.common import LINEITEM_ROWS, Case, documents, lineitem_rows, rounded, table, token_list
from screenflow.operators import duplicates as dup
from screenflow.operators import quality as q
from screenflow.operators import sampling
from screenflow.session import shared_folder
from screenflow.sources.tables import read_table, select_rename, write_by_split, write_table

KEYS = ["l_partkey", "l_suppkey"]
LIMIT = 0.03


def _labelled(spark, sf) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return documents.join(table(spark, sf, "labels"), "doc_id", "left")


LABELLED = "labelled AS (SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def _mixed(spark, sf) -> DataFrame:
    number = F.get_json_object("props", "$.k")
    mixed = F.when(F.col("event_type") == "error", F.col("props")).otherwise(number)
    return table(spark, sf, "events").select("event_id", mixed.alias("k"))


MIXED = """mixed AS (SELECT event_id, CASE WHEN event_type = 'error' THEN props
  ELSE regexp_extract(props, '([0-9]+)', 1) END AS k FROM events)"""


def _count_words(row: dict) -> dict | None:
    if "\n" not in row["text"]:
        return None
    if row["text"].count("\n") > 200:
        raise ValueError("too many lines")
    return {"n_blanks": row["text"].count(" "), "n_lines": row["text"].count("\n") + 1}


def enrich(spark, sf) -> DataFrame:
    rows = documents(spark, sf, "doc_id", "text")
    return q.enrich_rows(rows, _count_words, "n_blanks bigint, n_lines bigint").drop("text")


def _curation_args() -> dict:
    return {"keys": KEYS, "label": "l_discount", "max_range": LIMIT}


def curated(spark, sf) -> DataFrame:
    found = dup.curate_duplicates(
        lineitem_rows(spark, sf), id="id", text="l_returnflag", row_id="row_id", **_curation_args()
    )
    return rounded(found, "l_discount", "replicate_std", "replicate_range")


STATS = f"""{LINEITEM_ROWS},
stats AS (SELECT l_partkey, l_suppkey, COUNT(*) AS n, AVG(l_discount) AS m, STDDEV_SAMP(l_discount) AS s,
  MIN(l_discount) AS lo, MAX(l_discount) AS hi, MAX(l_discount) - MIN(l_discount) AS r FROM rows GROUP BY ALL),
decided AS (SELECT *, CASE WHEN n = 1 THEN 'keep_unique' WHEN coalesce(r <= {LIMIT}, false) THEN 'aggregate_duplicates'
  ELSE 'exclude_conflicting_duplicate' END AS action FROM stats)"""

CURATED = f"""WITH {STATS},
ids AS (SELECT l_partkey, l_suppkey, string_agg(id, '|' ORDER BY row_id, id, l_returnflag) AS ids,
  MIN(row_id) AS first_row FROM rows GROUP BY ALL),
seen AS (SELECT l_partkey, l_suppkey, l_returnflag, MIN(row_id) AS seen_at FROM rows GROUP BY ALL),
texts AS (SELECT l_partkey, l_suppkey, string_agg(l_returnflag, '|' ORDER BY seen_at, l_returnflag) AS texts FROM seen GROUP BY ALL)
SELECT d.l_partkey, d.l_suppkey, ids, texts, ROUND(m, 6) AS l_discount, n AS replicate_n,
  ROUND(CASE WHEN n > 1 THEN s END, 6) AS replicate_std, ROUND(r, 6) AS replicate_range,
  CASE WHEN n = 1 THEN 'unique_keep' ELSE 'duplicate_aggregated' END AS curation_action, first_row
FROM decided d JOIN ids USING (l_partkey, l_suppkey) JOIN texts USING (l_partkey, l_suppkey)
WHERE action <> 'exclude_conflicting_duplicate'"""


def _two_sources(spark, sf) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, sf, "documents").select("doc_id", "text", "source")
    return documents.where("source < 'src15'"), documents.where("source >= 'src15'")


def _has_break():
    return F.col("text").contains("\n")


TEXT_STRUCTURE = f"""WITH tok AS (SELECT doc_id, {token_list()} AS t FROM documents),
one AS (SELECT doc_id, unnest(t) AS x FROM tok),
charges AS (SELECT doc_id, SUM(CASE WHEN x LIKE '[%' AND length(x) > 1 AND regexp_matches(x, '(\\++|-+)([0-9]*)(:[0-9]+)?\\]$')
    THEN CASE WHEN regexp_extract(x, '(\\++|-+)([0-9]*)(?::[0-9]+)?\\]$', 2) = ''
              THEN length(regexp_extract(x, '(\\++|-+)([0-9]*)(?::[0-9]+)?\\]$', 1))
              ELSE coalesce(try_cast(regexp_extract(x, '(\\++|-+)([0-9]*)(?::[0-9]+)?\\]$', 2) AS INTEGER), 0) END
         * CASE WHEN regexp_extract(x, '(\\++|-+)([0-9]*)(?::[0-9]+)?\\]$', 1) LIKE '+%' THEN 1 ELSE -1 END ELSE 0 END) AS charge,
  COUNT(*) FILTER (x = '.') + 1 AS fragments,
  COUNT(*) FILTER ((regexp_matches(x, '^[A-Za-z]+$') AND x <> 'H')
    OR (x LIKE '[%' AND length(x) > 1 AND NOT (regexp_matches(x, '^\\[[0-9]*H') AND NOT regexp_matches(x, '^\\[[0-9]*H[a-z]')))) AS atoms,
  COUNT(*) FILTER (regexp_matches(x, '^(%[0-9][0-9]|[0-9])$')) AS closures
  FROM one GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(fragments, 1) AS INTEGER) AS fragment_count, CAST(coalesce(charge, 0) AS INTEGER) AS formal_charge,
  CAST(coalesce(atoms, 0) AS INTEGER) AS heavy_atom_count, CAST(floor(coalesce(closures, 0) / 2) AS INTEGER) AS ring_count,
  coalesce(fragments, 1) > 1 AS multi_fragment
FROM documents d LEFT JOIN charges USING (doc_id)"""

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

DESCRIBE = "\nUNION ALL ".join(
    f"""SELECT '{c}' AS variable, COUNT({c}) AS count, ROUND(AVG({c}), 6) AS mean, ROUND(STDDEV_SAMP({c}), 6) AS std,
 MIN({c}) AS min, ROUND(quantile_cont({c}, 0.25), 6) AS q25, ROUND(quantile_cont({c}, 0.5), 6) AS q50,
 ROUND(quantile_cont({c}, 0.75), 6) AS q75, MAX({c}) AS max FROM lineitem"""
    for c in NUMERIC
)

DUPLICATED = "copies AS (SELECT text, COUNT(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING COUNT(*) > 1)"

FUNNEL = """WITH one AS (SELECT text, contains(text, chr(10)) AS ok, length(text) AS len, COUNT(*) AS n
  FROM documents WHERE text IS NOT NULL GROUP BY ALL)
SELECT CAST(SUM(n) AS BIGINT) AS raw_rows, CAST(coalesce(SUM(n) FILTER (NOT ok), 0) AS BIGINT) AS invalid,
  CAST(coalesce(SUM(n - 1) FILTER (ok), 0) AS BIGINT) AS duplicates_removed,
  COUNT(*) FILTER (ok AND NOT len BETWEEN 200 AND 5000) AS length_filtered,
  COUNT(*) FILTER (ok AND len BETWEEN 200 AND 5000) AS final_rows,
  CAST(MIN(len) FILTER (ok AND len BETWEEN 200 AND 5000) AS INTEGER) AS minimum_length,
  CAST(MAX(len) FILTER (ok AND len BETWEEN 200 AND 5000) AS INTEGER) AS maximum_length,
  ROUND(AVG(len) FILTER (ok AND len BETWEEN 200 AND 5000), 6) AS mean_length FROM one"""

SET_METRICS = """WITH made AS (SELECT text, contains(text, chr(10)) AS ok FROM documents WHERE source < 'src15'),
u AS (SELECT DISTINCT text FROM made WHERE ok AND text IS NOT NULL),
c AS (SELECT (SELECT COUNT(*) FROM made) AS g, (SELECT COUNT(*) FROM made WHERE ok AND text IS NOT NULL) AS v,
  (SELECT COUNT(*) FROM u) AS d,
  (SELECT COUNT(*) FROM u WHERE text NOT IN (SELECT text FROM documents WHERE source >= 'src15' AND text IS NOT NULL)) AS n)
SELECT g AS n_generated, v AS n_valid, ROUND(CASE WHEN g > 0 THEN v / g ELSE 0.0 END, 6) AS validity, d AS n_unique_valid,
  ROUND(CASE WHEN v > 0 THEN d / v ELSE 0.0 END, 6) AS uniqueness, n AS n_novel,
  ROUND(CASE WHEN d > 0 THEN n / d ELSE 0.0 END, 6) AS novelty FROM c"""

def _with_day(orders: DataFrame) -> DataFrame:
    """The time of an order as text, so that no client's time zone matters."""
    return orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


def _written_and_read(spark: SparkSession, sf: str, fmt: str) -> DataFrame:
    """All orders written to the shared folder and read back."""
    orders = table(spark, sf, "orders")
    folder = f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}"
    write_table(orders, folder, fmt)
    return read_table(spark, folder, orders.schema, fmt, row_id=None)


def _by_split(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in one folder per language; one language read back from its own folder."""
    docs = table(spark, sf, "documents")
    folder = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    write_by_split(docs, folder, "lang")
    return read_table(spark, folder, fmt="parquet", row_id=None).where("lang = 'en'").select(*docs.columns)


ORDERS = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
o_orderpriority FROM orders"""
BY_SPLIT = "SELECT * FROM documents WHERE lang = 'en'"

CASES: dict[str, Case] = {
    "read_table": (
        lambda spark, sf: _with_day(read_table(spark, f"{sf}/orders.parquet", fmt="parquet", row_id=None)),
        ORDERS,
    ),
    "write_read_csv": (lambda spark, sf: _with_day(_written_and_read(spark, sf, "csv")), ORDERS),
    "write_read_json": (lambda spark, sf: _with_day(_written_and_read(spark, sf, "json")), ORDERS),
    "write_by_split": (_by_split, BY_SPLIT),
    "select_rename": (
        lambda spark, sf: select_rename(
            table(spark, sf, "lineitem"), {"L_PARTKEY": "part", "L_SUPPKEY": "supplier", "L_TAX": "tax"}, ignore_case=True
        ),
        "SELECT l_partkey AS part, l_suppkey AS supplier, l_tax AS tax FROM lineitem",
    ),
    "sample_exact": (
        lambda spark, sf: sampling.sample_exact(
            table(spark, sf, "documents").select("doc_id", "n_chars"), 100, "doc_id", seed=42
        ),
        """SELECT doc_id, n_chars FROM documents
ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id LIMIT 100""",
    ),
    "tagged_union": (
        lambda spark, sf: sampling.tagged_union(
            {
                "documents": table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"),
                "labels": table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality"),
            },
            tag="origin",
        ),
        """SELECT doc_id AS id, lang, CAST(NULL AS INTEGER) AS quality, 'documents' AS origin FROM documents
UNION ALL SELECT doc_id, NULL, quality, 'labels' FROM labels""",
    ),
    "missing_counts": (
        lambda spark, sf: q.missing_counts(_labelled(spark, sf)),
        f"WITH {LABELLED} "
        + " UNION ALL ".join(
            f"SELECT '{c}' AS variable, COUNT(*) - COUNT({c}) AS missing FROM labelled"
            for c in ("doc_id", "lang", "source", "quality", "toxic")
        ),
    ),
    "coerce_numeric": (
        lambda spark, sf: q.coerce_numeric(_mixed(spark, sf), "k"),
        f"WITH {MIXED} SELECT event_id, try_cast(k AS DOUBLE) AS k FROM mixed",
    ),
    "coercion_summary": (
        lambda spark, sf: q.coercion_summary(_mixed(spark, sf), "k"),
        f"""WITH {MIXED} SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (k IS NULL) AS n_missing,
COUNT(*) FILTER (k IS NOT NULL AND try_cast(k AS DOUBLE) IS NULL) AS n_not_numeric FROM mixed""",
    ),
    "enrich_rows": (
        enrich,
        """SELECT doc_id, CASE WHEN ok THEN b END AS n_blanks, CASE WHEN ok THEN l + 1 END AS n_lines, ok AS valid FROM (
SELECT doc_id, length(text) - length(replace(text, ' ', '')) AS b, length(text) - length(replace(text, chr(10), '')) AS l,
  (length(text) - length(replace(text, chr(10), ''))) BETWEEN 1 AND 200 AS ok FROM documents)""",
    ),
    "validity_summary": (
        lambda spark, sf: q.validity_summary(_labelled(spark, sf).withColumn("ok", F.col("quality") == 1), "ok"),
        f"""WITH {LABELLED} SELECT COUNT(*) FILTER (quality = 1) AS n_valid,
COUNT(*) FILTER (quality IS NULL OR quality <> 1) AS n_invalid FROM labelled""",
    ),
    "quarantine": (
        lambda spark, sf: sampling.tagged_union(
            dict(zip(("good", "bad"), q.quarantine(_labelled(spark, sf), F.col("quality") == 1))), tag="part"
        ),
        f"""WITH {LABELLED} SELECT doc_id, lang, source, quality, toxic,
CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS part FROM labelled""",
    ),
    "drop_missing": (
        lambda spark, sf: q.drop_missing(_labelled(spark, sf), ["quality", "toxic"]),
        f"WITH {LABELLED} SELECT * FROM labelled WHERE quality IS NOT NULL AND toxic IS NOT NULL",
    ),
    "value_counts": (
        lambda spark, sf: q.value_counts(table(spark, sf, "events"), "event_type"),
        "SELECT event_type, COUNT(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY event_type",
    ),
    "value_counts_with_missing": (
        lambda spark, sf: q.value_counts(_labelled(spark, sf), "quality", dropna=False, order="value"),
        f"WITH {LABELLED} SELECT quality, COUNT(*) AS count FROM labelled GROUP BY quality",
    ),
    "describe": (
        lambda spark, sf: rounded(
            q.describe(table(spark, sf, "lineitem"), NUMERIC), "mean", "std", "q25", "q50", "q75"
        ),
        DESCRIBE,
    ),
    "constant_columns": (
        lambda spark, sf: q.constant_columns(
            table(spark, sf, "lineitem").withColumns({"nothing": F.lit(None).cast("int"), "same": F.lit(7)}),
            ["l_quantity", "l_returnflag", "l_tax", "nothing", "same"],
        ),
        """WITH x AS (SELECT l_quantity, l_returnflag, l_tax, CAST(NULL AS INTEGER) AS nothing, 7 AS same FROM lineitem)
SELECT variable FROM (SELECT 'l_quantity' AS variable, COUNT(DISTINCT l_quantity) AS n FROM x
UNION ALL SELECT 'l_returnflag', COUNT(DISTINCT l_returnflag) FROM x UNION ALL SELECT 'l_tax', COUNT(DISTINCT l_tax) FROM x
UNION ALL SELECT 'nothing', COUNT(DISTINCT nothing) FROM x UNION ALL SELECT 'same', COUNT(DISTINCT same) FROM x) WHERE n <= 1""",
    ),
    "top_n": (
        lambda spark, sf: q.top_n(
            table(spark, sf, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"),
            ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"],
            10,
            [False, True, True, True],
        ),
        """SELECT l_extendedprice, l_orderkey, l_linenumber, l_partkey FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10""",
    ),
    "expect": (
        lambda spark, sf: q.expect(
            table(spark, sf, "orders"),
            never={"missing price": F.col("o_totalprice").isNull()},
            unique=["o_orderkey"],
            not_empty=True,
            values={"o_orderstatus": {"F", "O", "P"}},
        ).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")),
        "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus",
    ),
    "text_structure": (
        lambda spark, sf: q.text_structure(documents(spark, sf, "doc_id", "text"), "text").drop("text"),
        TEXT_STRUCTURE,
    ),
    "empty_group_stats": (
        lambda spark, sf: rounded(
            q.empty_group_stats(
                table(spark, sf, "documents").select(F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("g")), "g"
            ),
            "fraction_empty",
        ),
        """SELECT COUNT(*) FILTER (lang = 'en') AS n_empty,
ROUND(AVG(CASE WHEN lang = 'en' THEN 1 ELSE 0 END), 6) AS fraction_empty FROM documents""",
    ),
    "duplicate_rows": (
        lambda spark, sf: dup.duplicate_rows(
            table(spark, sf, "documents").select("doc_id", "text", "lang"), "text", "doc_id"
        ).select("doc_id", "lang", "n_copies", F.md5("text").alias("digest")),
        f"""WITH {DUPLICATED} SELECT doc_id, lang, n AS n_copies, md5(d.text) AS digest
FROM documents d JOIN copies c ON d.text = c.text""",
    ),
    "duplicate_summary": (
        lambda spark, sf: dup.duplicate_summary(table(spark, sf, "documents"), "text"),
        f"WITH {DUPLICATED} SELECT CAST(SUM(n) AS BIGINT) AS n_rows, COUNT(*) AS n_keys FROM copies",
    ),
    "duplicate_label_summary": (
        lambda spark, sf: rounded(
            dup.duplicate_label_summary(table(spark, sf, "lineitem"), KEYS, "l_discount"), "mean", "std", "range"
        ),
        """SELECT l_partkey, l_suppkey, COUNT(l_discount) AS count, ROUND(AVG(l_discount), 6) AS mean,
ROUND(STDDEV_SAMP(l_discount), 6) AS std, MIN(l_discount) AS minimum, MAX(l_discount) AS maximum,
ROUND(MAX(l_discount) - MIN(l_discount), 6) AS range FROM lineitem GROUP BY l_partkey, l_suppkey HAVING COUNT(*) > 1""",
    ),
    "curate_duplicates": (curated, CURATED),
    "merged_members": (
        lambda spark, sf: dup.merged_members(lineitem_rows(spark, sf), row_id="row_id", **_curation_args()).select(
            *KEYS, "row_id", "l_discount"
        ),
        f"""WITH {STATS} SELECT l_partkey, l_suppkey, row_id, l_discount FROM rows JOIN decided USING (l_partkey, l_suppkey)
WHERE action = 'aggregate_duplicates'""",
    ),
    "curation_log": (
        lambda spark, sf: rounded(dup.curation_log(table(spark, sf, "lineitem"), **_curation_args()), "label_range"),
        f"""WITH {STATS} SELECT l_partkey, l_suppkey, n AS n_source_records, lo AS label_min, hi AS label_max,
ROUND(r, 6) AS label_range, action FROM decided""",
    ),
    "conflict_rows": (
        lambda spark, sf: rounded(
            dup.conflict_rows(lineitem_rows(spark, sf), row_id="row_id", **_curation_args()).select(
                *KEYS, "id", "l_returnflag", "l_discount", "group_label_min", "group_label_max", "group_label_range"
            ),
            "group_label_range",
        ),
        f"""WITH {STATS} SELECT l_partkey, l_suppkey, id, l_returnflag, l_discount, lo AS group_label_min,
hi AS group_label_max, ROUND(r, 6) AS group_label_range FROM rows JOIN decided USING (l_partkey, l_suppkey)
WHERE action = 'exclude_conflicting_duplicate'""",
    ),
    "curation_summary": (
        lambda spark, sf: dup.curation_summary(table(spark, sf, "lineitem"), **_curation_args()),
        f"""WITH {STATS} SELECT CAST(SUM(n) AS BIGINT) AS n_source_rows, COUNT(*) AS n_keys,
COUNT(*) FILTER (action = 'keep_unique') AS n_unique, COUNT(*) FILTER (action = 'aggregate_duplicates') AS n_merged,
COUNT(*) FILTER (action = 'exclude_conflicting_duplicate') AS n_conflicting,
CAST(coalesce(SUM(n) FILTER (action = 'exclude_conflicting_duplicate'), 0) AS BIGINT) AS n_conflicting_rows FROM decided""",
    ),
    "dedup_first": (
        lambda spark, sf: dup.dedup_first(
            table(spark, sf, "documents").select("doc_id", "text", "lang"), "text", "doc_id"
        ).select("doc_id", "lang", F.md5("text").alias("digest")),
        """SELECT doc_id, lang, md5(text) AS digest FROM documents
WHERE doc_id IN (SELECT MIN(doc_id) FROM documents GROUP BY text)""",
    ),
    "dedup_summary": (
        lambda spark, sf: dup.dedup_summary(table(spark, sf, "documents"), "text"),
        """SELECT COUNT(*) AS n_rows, COUNT(DISTINCT text) AS n_kept, COUNT(*) - COUNT(DISTINCT text) AS n_removed
FROM documents""",
    ),
    "length_filter": (
        lambda spark, sf: dup.length_filter(table(spark, sf, "documents"), "text", 200, 5000).select("doc_id", "length"),
        "SELECT doc_id, CAST(length(text) AS INTEGER) AS length FROM documents WHERE length(text) BETWEEN 200 AND 5000",
    ),
    "prep_funnel": (
        lambda spark, sf: rounded(
            dup.prep_funnel(table(spark, sf, "documents"), "text", _has_break(), 200, 5000), "mean_length"
        ),
        FUNNEL,
    ),
    "set_metrics": (
        lambda spark, sf: rounded(
            dup.set_metrics(*_two_sources(spark, sf), "text", _has_break()), "validity", "uniqueness", "novelty"
        ),
        SET_METRICS,
    ),
    "mark_novel": (
        lambda spark, sf: dup.mark_novel(*_two_sources(spark, sf), "text", "doc_id").select("doc_id", "novel"),
        """SELECT doc_id, coalesce(text NOT IN (SELECT text FROM documents WHERE source >= 'src15' AND text IS NOT NULL), true)
AS novel FROM documents WHERE source < 'src15'""",
    ),
    "novel_rows": (
        lambda spark, sf: dup.novel_rows(*_two_sources(spark, sf), "text", "doc_id").select(
            "doc_id", F.md5("text").alias("digest")
        ),
        """SELECT MIN(doc_id) AS doc_id, md5(text) AS digest FROM documents WHERE source < 'src15'
AND text NOT IN (SELECT text FROM documents WHERE source >= 'src15' AND text IS NOT NULL) GROUP BY text""",
    ),
    "membership_filter": (
        lambda spark, sf: dup.membership_filter(
            table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"),
            table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey")),
            ["l_suppkey"],
        ),
        """SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem
WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""",
    ),
    "in_splits": (
        lambda spark, sf: dup.in_splits(
            table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), ["A", "R"], "l_returnflag"
        ),
        "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R')",
    ),
}
