"""Registered queries of the text operators and their SQL twins, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from screenflow.llm import chat as windows
from screenflow.llm import licenses as scans
from screenflow.llm import sharding as tree
from screenflow.llm.decontamination import contamination_digest
from screenflow.llm.hard_negatives import hard_negatives
from screenflow.llm.language import language_digest
from screenflow.llm.neighbours import nearest
from screenflow.llm.pii import pii_digest
from screenflow.llm.repeats import repeat_digest
from screenflow.llm.sentencepiece_codec import codec_digest
from screenflow.llm.simhash import near_duplicates
from screenflow.llm.token_counts import count_tokens
from screenflow.llm.variants import DAMAGE, LEAST_COUNT, LEAST_LENGTH, LETTERS, RATIO, spelling_variants


def piece_model() -> str:
    """Where the vocabulary file is; asked for when a query needs it."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pii(spark: SparkSession, folder: str) -> DataFrame:
    """Which personal data does each text hold, and where?"""
    return pii_digest(table(spark, folder, "documents"))


def sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Where does each document go, and where would it go with one more shard?"""
    return tree.shard_documents(table(spark, folder, "documents"), 8)


def codec(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of each text under the piece vocabulary, and the text they decode to."""
    return codec_digest(table(spark, folder, "documents"), piece_model())


def licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Which texts hold license phrases or notices?"""
    return scans.license_digest(table(spark, folder, "documents"))


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many tokens does each text have?"""
    return count_tokens(table(spark, folder, "documents"), piece_model())


CONTROL = "</s>[INST] ok [/INST]"


def chat(spark: SparkSession, folder: str) -> DataFrame:
    """What comes back from the formatted conversations, one of them made of control strings?"""
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.sql(f"VALUES (-7L, 0L, 'user', '{CONTROL}'), (-7L, 1L, 'assistant', '{CONTROL}')")
    return windows.chat_digest(given.union(added))


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Which texts hold passages of test items?"""
    return contamination_digest(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def language(spark: SparkSession, folder: str) -> DataFrame:
    """Which language is each text in?"""
    return language_digest(table(spark, folder, "documents"))


def near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Which texts are near copies of each other?"""
    return near_duplicates(table(spark, folder, "documents"))


def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Which vectors are nearest to each query vector?"""
    return nearest(table(spark, folder, "embeddings"))


def negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Which rows of other labels come close to an anchor's nearest rows of its own?"""
    return hard_negatives(table(spark, folder, "embeddings"))


def repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each text without the passages that occur elsewhere too?"""
    return repeat_digest(table(spark, folder, "documents"))


def variants(spark: SparkSession, folder: str) -> DataFrame:
    """Which frequent words are spelling variants of which?"""
    return spelling_variants(table(spark, folder, "documents"))


def _values(rows) -> str:
    return ", ".join(f"({', '.join(repr(x) for x in row)})" for row in rows)


def _tree_sql(shards: int, name: str) -> str:
    """CTEs that place every id level by level in the standard tree."""
    parts, before = [], "(SELECT doc_id, key, '' AS node FROM keys)"
    for depth, level in enumerate(tree._levels(tree.standard_tree(shards))):
        own = f"{name}_{depth}"
        parts.append(
            f"""{own} AS (
  SELECT doc_id, key, max(struct_pack(d := ln((('0x' || md5(key || ':' || n.node)[1:13])::BIGINT + 1)
                                              / 4503599627370496.0) / n.weight, node := n.node)).node AS node
  FROM {before} AS b JOIN (VALUES {_values(level)}) AS n(parent, node, weight) ON n.parent = b.node
  GROUP BY doc_id, key)"""
        )
        before = own
    return ",\n".join(parts)


CRC_TABLE = """crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)
              ORDER BY i) AS t FROM range(256) r(i))"""


def _crc_sql(text: str) -> str:
    """crc32 of a text next to CRC_TABLE."""
    return f"""xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT),
                         lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295)"""


SHARDING_SQL = f"""
WITH {CRC_TABLE},
sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {_crc_sql("coalesce(text, '')")} AS text_crc32
  FROM documents, crc),
keys AS (SELECT DISTINCT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents),
{_tree_sql(8, "now")},
{_tree_sql(9, "grown")},
placed AS (
  SELECT n.doc_id, n.key, CAST(split_part(n.node, '/', 3) AS INTEGER) AS shard,
         CAST(split_part(g.node, '/', 3) AS INTEGER) AS grown_shard
  FROM now_2 n JOIN grown_2 g ON n.key = g.key)
SELECT s.doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY ('0x' || md5(key || ':' || size || ':' || text_crc32)[1:8])::BIGINT % {tree.BUCKETS},
                               s.doc_id NULLS FIRST, size, text_crc32) - 1 AS BIGINT) AS slot, grown_shard
FROM sized s JOIN placed p ON s.doc_id IS NOT DISTINCT FROM p.doc_id
"""

LICENSES_SQL = f"""
WITH notices AS (
  SELECT * FROM (VALUES {", ".join(f"({label!r}, {w!r}, {scans.needed(len(w), scans.THRESHOLD)})" for label, w in scans.notice_words())})
  AS n(label, w, need)),
words AS (
  SELECT row_number() OVER () AS k, doc_id,
         coalesce(regexp_extract_all(translate(text, '{scans.UPPER}', '{scans.LOWER}'), '{scans.WORD}'), []) AS w
  FROM documents),
places AS (SELECT k, w, unnest(generate_series(1, len(w))) AS p FROM words WHERE list_contains(w, 'license')),
phrases AS (
  SELECT k, p - 1 AS p, 'mit' AS label FROM places WHERE w[p] = 'mit' AND w[p + 1] = 'license'
  UNION ALL SELECT k, p - 1, 'apache' FROM places WHERE w[p] = 'apache' AND w[p + 1] = 'license'
  UNION ALL SELECT k, p - 1, 'gpl' FROM places WHERE w[p] = 'general' AND w[p + 1] = 'public' AND w[p + 2] = 'license'),
base AS (
  SELECT k, count(*) AS n, min(p) AS low, max(p) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM phrases GROUP BY k),
blocks AS (
  SELECT k, unnest(list_transform(generate_series(0, len(w) - 1, {scans.block_size(scans.notice_words())[1]}),
                                  lambda s: w[s + 1 : s + {scans.block_size(scans.notice_words())[0]}])) AS b
  FROM words WHERE len(w) > 0),
hits AS (
  SELECT k, label, max(len(list_intersect(b, w)) / len(w)) AS containment
  FROM blocks, notices WHERE len(list_intersect(b, w)) >= need GROUP BY k, label),
labels AS (
  SELECT k, string_agg(label, ',' ORDER BY label) AS labels
  FROM (SELECT k, label FROM hits UNION SELECT k, label FROM phrases) GROUP BY k),
best AS (SELECT k, max(containment) AS c FROM hits GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base,
       CAST(low AS BIGINT) AS first_word, CAST(high AS BIGINT) AS last_word, coalesce(base.labels, '') AS base_labels,
       coalesce(labels.labels, '') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0)::DOUBLE END AS score
FROM words LEFT JOIN base USING (k) LEFT JOIN labels USING (k) LEFT JOIN best USING (k)
"""

CHAT_SQL = f"""
WITH given AS (
  SELECT conv_id AS c, turn AS t, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{CONTROL}'), (-7, 1, 'assistant', '{CONTROL}')),
sized AS (
  SELECT *, len(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]')) + {windows.MARKS} AS n,
         6 + length(regexp_replace(r, '([\\\\<\\[\\]])', '\\1\\1', 'g')) + length(regexp_replace(x, '([\\\\<\\[])', '\\1\\1', 'g')) AS size
  FROM given),
ordered AS (
  SELECT *, row_number() OVER o AS p, sum(n) OVER o - n AS start FROM sized
  WINDOW o AS (PARTITION BY c ORDER BY t NULLS FIRST, r, x ROWS UNBOUNDED PRECEDING)),
spans AS (SELECT c, CAST(start AS BIGINT) // {windows.BUDGET} AS b, min(start) AS low FROM ordered GROUP BY ALL),
followed AS (SELECT *, lead(low) OVER (PARTITION BY c ORDER BY b) AS next FROM spans),
opening AS (SELECT c, size FROM ordered WHERE p = 1 AND r = 'system'),
repeats AS (
  SELECT o.c, sum(o.size) AS size FROM ordered o
  JOIN followed f ON o.c IS NOT DISTINCT FROM f.c AND CAST(o.start AS BIGINT) // {windows.BUDGET} = f.b
  WHERE o.start >= f.next - {windows.HISTORY} AND NOT (o.p = 1 AND o.r = 'system') GROUP BY o.c),
total AS (
  SELECT c, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY p)) AS turns_sha256,
         coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0) AS loss_chars,
         sha256(coalesce(string_agg(x, '' ORDER BY p) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256, sum(size) AS size
  FROM ordered GROUP BY c),
counted AS (SELECT c, count(*) AS n FROM spans GROUP BY c)
SELECT t.c AS conv_id, CAST(n_turns AS BIGINT) AS n_turns, turns_sha256, CAST(loss_chars AS BIGINT) AS loss_chars, loss_sha256,
       CAST(3 * k.n + t.size + coalesce(r.size, 0) + (k.n - 1) * coalesce(o.size, 0) AS BIGINT) AS formatted_chars
FROM total t JOIN counted k ON t.c IS NOT DISTINCT FROM k.c LEFT JOIN repeats r ON t.c IS NOT DISTINCT FROM r.c
LEFT JOIN opening o ON t.c IS NOT DISTINCT FROM o.c
"""

# Rows are told apart by number: ids may be missing or repeat.
DECONTAMINATION_SQL = """
WITH item_words AS (
  SELECT row_number() OVER () AS n, CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT n, item, least(len(w), 10) AS size,
         array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT n, item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM item_words WHERE len(w) > 0)),
words AS (
  SELECT row_number() OVER () AS k, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w
  FROM documents),
places AS (
  SELECT k, w, unnest(generate_series(1, len(w))) AS p FROM words WHERE len(w) > 0),
found AS (
  SELECT DISTINCT k, p, p + size AS stop, item
  FROM (SELECT k, p, size, array_to_string(w[p : p + size - 1], ' ') AS win
        FROM places, (SELECT DISTINCT size FROM item_windows) WHERE p + size - 1 <= len(w))
  JOIN item_windows USING (size, win)),
hits AS (
  SELECT k, count(DISTINCT x) AS n FROM (SELECT k, unnest(generate_series(p, stop - 1)) AS x FROM found) GROUP BY k),
items AS (
  SELECT k, count(*) AS n, string_agg(item, ',' ORDER BY item) AS all_items
  FROM (SELECT DISTINCT k, item FROM found WHERE item IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(all_items, '')) AS items_sha256,
       coalesce(hits.n, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (k) LEFT JOIN items USING (k)
"""

# Products of integers below 2^53 are exact in doubles.
NEGATIVES_SQL = """
WITH used AS MATERIALIZED (
  SELECT row_number() OVER () AS u, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.u AS a, a.id AS anchor_id, r.id, r.label = a.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM used a JOIN used r ON a.u <> r.u AND len(a.v) = len(r.v) WHERE a.id % 50 = 0),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS k FROM scored WHERE same QUALIFY k <= 5),
windows AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.k ORDER BY n.score DESC, n.id) AS rank
  FROM positives p JOIN scored n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM windows WHERE rank <= 3
"""

VARIANTS_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT id, run, count(*) AS n FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
           unnest(regexp_extract_all(translate(text, '{scans.UPPER}', '{scans.LOWER}'), '[{LETTERS}]+')) AS run FROM documents)
  WHERE length(run) >= {LEAST_LENGTH} GROUP BY id, run),
hashed AS (SELECT run, n, CAST({_crc_sql("id || ':' || run")} AS BIGINT) AS h FROM runs, crc),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
    FROM hashed)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
gaps AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b
  FROM (SELECT word, unnest(generate_series(1, length(word))) AS i FROM words)),
near AS MATERIALIZED (
  SELECT g.word AS w, o.word AS v FROM gaps g JOIN gaps o ON g.a = o.a AND g.b = o.b AND g.word <> o.word
  UNION SELECT g.word, w.word FROM gaps g JOIN words w ON w.word = g.a || g.b
  UNION SELECT w.word, g.word FROM gaps g JOIN words w ON w.word = g.a || g.b),
counted AS (
  SELECT w, count(*) AS n_near, max(n) AS top, arg_min(v, (-n, v)) AS best FROM near JOIN words ON word = v GROUP BY w),
formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {RATIO} * n THEN best END AS form,
         CASE WHEN top >= {RATIO} * n THEN top END AS form_n
  FROM words LEFT JOIN counted ON w = word),
walk AS (
  SELECT word, word AS here, 0 AS step FROM formed
  UNION ALL SELECT walk.word, formed.form, step + 1 FROM walk JOIN formed ON formed.word = walk.here WHERE formed.form IS NOT NULL),
roots AS (SELECT word, arg_max(here, step) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""

CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_pii": (pii, None),
    "op2_sharding": (sharding, SHARDING_SQL),
    "op3_pieces": (codec, None),
    "op4_licenses": (licenses, LICENSES_SQL),
    "op5_token_counts": (token_counts, None),
    "op6_chat": (chat, CHAT_SQL),
    "op7_decontamination": (decontamination, DECONTAMINATION_SQL),
    "op8_language": (language, None),
    "op9_simhash": (near_dedup, None),
    "op10_neighbours": (neighbours, None),
    "op11_hard_negatives": (negatives, NEGATIVES_SQL),
    "op12_repeats": (repeats, None),
    "op13_variants": (variants, VARIANTS_SQL),
}
