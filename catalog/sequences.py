"""Tokens, vocabularies, encoded sequences, the n-gram generator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.common import LINES, Case, documents, lines, one_line, parts, rounded, table, token_list
from screenflow.functions import text as tx
from screenflow.functions.skew import dealt_out
from screenflow.functions.tokenized import small_batches, token_count
from screenflow.operators import ngrams, sequences
from screenflow.operators.sampling import split_exact
from screenflow.session import materialize

ORDER = 2


def _vocabulary(spark, sf) -> DataFrame:
    """From the benchmark texts, so that documents hold tokens it lacks."""
    return sequences.build_vocabulary(table(spark, sf, "benchmark").select(one_line().alias("text")), "text")


def _encoded(spark, sf) -> DataFrame:
    return sequences.encode(lines(spark, sf), "text", _vocabulary(spark, sf), "doc_id", parts=parts(spark))


def _joined(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


VOCABULARY = f"""{LINES},
bench AS (SELECT replace(text, chr(10), ' ') AS text FROM benchmark),
vocabulary AS (SELECT * FROM (VALUES ('<PAD>', 0), ('<BOS>', 1), ('<EOS>', 2), ('<UNK>', 3)) v(token, id)
  UNION ALL SELECT token, CAST(3 + ROW_NUMBER() OVER (ORDER BY token) AS INTEGER) FROM
  (SELECT DISTINCT unnest({token_list()}) AS token FROM bench)),
tok AS (SELECT doc_id, {token_list()} AS t FROM lines),
one AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM tok),
inner_ids AS (SELECT doc_id, list(coalesce(v.id, 3) ORDER BY i) AS ids FROM one LEFT JOIN vocabulary v USING (token) GROUP BY doc_id),
encoded AS (SELECT doc_id, text, list_concat(list_concat([1], coalesce(ids, CAST([] AS INTEGER[]))), [2]) AS ids
  FROM lines LEFT JOIN inner_ids USING (doc_id))"""

def padded(spark, sf) -> DataFrame:
    """Padded to the longest sequence of the texts."""
    encoded = materialize(_encoded(spark, sf).drop("text"))  # read for the longest and for all
    length = encoded.agg(F.max(F.size("ids")).alias("n")).first()["n"]
    found = sequences.pad_sequences(encoded, "ids", length, separator=",")
    return found.select("doc_id", "sequence_length", F.md5("padded").alias("digest"))


def decoded(spark, sf) -> DataFrame:
    vocabulary = _vocabulary(spark, sf)
    encoded = sequences.encode(lines(spark, sf), "text", vocabulary, "doc_id", parts=parts(spark)).drop("text")
    both = sequences.decode(encoded, "ids", vocabulary, "doc_id")  # dealt out by then
    both = sequences.decode(both, "ids", vocabulary, "doc_id", out="known_only", skip_unknown=True)
    return both.select("doc_id", F.md5("decoded").alias("decoded"), F.md5("known_only").alias("known_only"))


def shifted(spark, sf) -> DataFrame:
    found = sequences.shift(_encoded(spark, sf), "ids")
    return found.select("doc_id", F.md5(_joined("input_ids")).alias("input"), F.md5(_joined("target_ids")).alias("target"))


def _conversation_lines(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select("role", one_line().alias("text"))


def _transitions(name: str, source: str, keep: str = "") -> str:
    """Contexts of two tokens (fewer at the start, NULL as first) and the token that follows."""
    return f"""{name}_seq AS (SELECT {keep} list_concat(list_concat(['<BOS>'], {token_list()}), ['<EOS>']) AS s,
  row_number() OVER () AS seq FROM {source}),
{name}_one AS (SELECT {keep} seq, unnest(s) AS next, generate_subscripts(s, 1) AS i FROM {name}_seq),
{name}_lag AS (SELECT {keep} i, next, lag(next, 2) OVER w AS c2, lag(next, 1) OVER w AS c1
  FROM {name}_one WINDOW w AS (PARTITION BY seq ORDER BY i)),
{name} AS MATERIALIZED (SELECT {keep} coalesce(c2, '') AS c2, c1, next, COUNT(*) AS n FROM {name}_lag WHERE i > 1 GROUP BY ALL)"""


# The same counts for contexts of length 2, 1 and 0; a missing token is an empty text.
MODEL = f"""lines AS (SELECT replace(text, chr(10), ' ') AS text FROM documents),
{_transitions("counted", "lines")},
model AS MATERIALIZED (SELECT 2 AS length, c2, c1, next, n AS count FROM counted
  UNION ALL SELECT 1, '', c1, next, CAST(SUM(n) AS BIGINT) FROM counted GROUP BY c1, next
  UNION ALL SELECT 0, '', '', next, CAST(SUM(n) AS BIGINT) FROM counted GROUP BY next)"""

SCORE = f"""WITH {MODEL},
asked_lines AS (SELECT role, replace(text, chr(10), ' ') AS text FROM conversations),
{_transitions("asked", "asked_lines", "role,")},
totals AS MATERIALIZED (SELECT length, c2, c1, SUM(count) AS total FROM model GROUP BY ALL),
cases AS MATERIALIZED (SELECT role, c2, c1, next, n, c2 AS k2, c1 AS k1, 2 AS k FROM asked
  UNION ALL SELECT role, c2, c1, next, n, '', c1, 1 FROM asked
  UNION ALL SELECT role, c2, c1, next, n, '', '', 0 FROM asked),
tried AS (SELECT role, s.c2, s.c1, s.next, n, k,
    (coalesce(m.count, 0) + 1) / (t.total + (SELECT COUNT(*) FROM model WHERE length = 0)) AS p
  FROM cases s JOIN totals t ON t.length = k AND t.c2 = k2 AND t.c1 = k1
  LEFT JOIN model m ON m.length = k AND m.c2 = k2 AND m.c1 = k1 AND m.next = s.next),
chosen AS (SELECT role, n, arg_max(p, k) AS p FROM tried GROUP BY role, c2, c1, next, n)
SELECT role, CAST(SUM(n) AS BIGINT) AS n_tokens, ROUND(SUM(-ln(p) * n) / SUM(n), 6) AS mean_loss FROM chosen GROUP BY role"""


def fitted(spark, sf) -> DataFrame:
    model = ngrams.fit_ngram(lines(spark, sf), "text", ORDER, parts(spark))
    return model.select("length", F.array_join("context", "").alias("context"), "next", "count")


def scored(spark, sf) -> DataFrame:
    model = ngrams.fit_ngram(lines(spark, sf), "text", ORDER, parts(spark))
    return rounded(ngrams.score_sequences(_conversation_lines(spark, sf), "text", model, "role", ORDER), "mean_loss")


TEXTS = 10_000  # as many as are drawn from the trained generator


def sampled(spark, sf) -> DataFrame:
    """Texts up to the length of the longest document, from a generator fitted on all documents."""
    texts = lines(spark, sf)
    model = materialize(ngrams.fit_ngram(texts, "text", ORDER, parts(spark)))
    longest = small_batches(dealt_out(texts, parts(spark))).agg(F.max(token_count(F.col("text")))).first()[0] or 0
    return ngrams.sample_sequences(model, TEXTS, longest + 2, ORDER, temperature=1.0, seed=42)


def sampled_short(spark, sf) -> DataFrame:
    """The beginnings of 200 such texts."""
    model = ngrams.fit_ngram(lines(spark, sf), "text", ORDER, parts(spark))
    return ngrams.sample_sequences(model, 200, 60, ORDER, temperature=1.0, seed=42)


# One row per drawn token; the same md5 draws, and options in the order of their bytes.
SAMPLED = f"""WITH RECURSIVE {MODEL},
options AS MATERIALIZED (SELECT c2, c1, next, SUM(count) OVER (PARTITION BY c2, c1 ORDER BY next) AS upto,
  SUM(count) OVER (PARTITION BY c2, c1) AS total FROM model WHERE length = 2 AND next NOT IN ('<PAD>', '<BOS>', '<UNK>')),
walk AS (SELECT id, 0 AS step, '' AS c2, '<BOS>' AS c1, '' AS made, true AS going FROM range(200) r(id)
  UNION ALL SELECT id, step + 1, c1, pick, CASE WHEN pick = '<EOS>' THEN made ELSE made || pick END, pick <> '<EOS>'
  FROM (SELECT id, step, w.c1, made, MIN(next) AS pick FROM walk w JOIN options o ON o.c2 = w.c2 AND o.c1 = w.c1
    AND upto > ('0x' || md5('42:' || id || ':' || step)[1:12])::BIGINT / CAST(281474976710656 AS DOUBLE) * CAST(total AS DOUBLE)
    WHERE going AND step < 59 GROUP BY ALL))
SELECT id, arg_max(made, step) AS generated FROM walk GROUP BY id"""

TOKEN_LENGTHS = f"""WITH {LINES}, n AS (SELECT len({token_list()}) AS n FROM lines)
SELECT 'n_tokens' AS variable, COUNT(*) AS count, ROUND(AVG(n), 6) AS mean, ROUND(STDDEV_SAMP(n), 6) AS std,
CAST(MIN(n) AS DOUBLE) AS min, ROUND(quantile_cont(n, 0.25), 6) AS q25, ROUND(quantile_cont(n, 0.5), 6) AS q50,
ROUND(quantile_cont(n, 0.75), 6) AS q75, CAST(MAX(n) AS DOUBLE) AS max, CAST(MAX(n) AS INTEGER) AS max_token_length,
CAST(MAX(n) + 2 AS INTEGER) AS max_sequence_length FROM n"""

CASES: dict[str, Case] = {
    "tokenize": (
        lambda spark, sf: documents(spark, sf, "doc_id", "text").select("doc_id", tx.tokens(F.col("text")).alias("t")).select(
            "doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", "\n")).alias("digest")
        ),
        f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, chr(10))) AS digest
FROM (SELECT doc_id, {token_list()} AS t FROM documents)""",
    ),
    "tokenize_strict": (
        lambda spark, sf: sequences.strict_split(documents(spark, sf, "doc_id", "text"), "text")[0].select(
            "doc_id", F.size("tokens").alias("n_tokens")
        ),
        f"""SELECT doc_id, CAST(len({token_list()}) AS INTEGER) AS n_tokens FROM documents
WHERE array_to_string({token_list()}, '') = text""",
    ),
    "tokenize_strict_failures": (
        lambda spark, sf: sequences.strict_split(documents(spark, sf, "doc_id", "text"), "text")[1].select("doc_id"),
        f"SELECT doc_id FROM documents WHERE coalesce(array_to_string({token_list()}, '') <> text, true)",
    ),
    "token_frequency": (
        lambda spark, sf: rounded(sequences.token_frequency(lines(spark, sf), "text", parts(spark)), "fraction", digits=9),
        f"""WITH {LINES}, one AS (SELECT unnest({token_list()}) AS token FROM lines)
SELECT token, COUNT(*) AS count, ROUND(COUNT(*) / (SELECT COUNT(*) FROM one), 9) AS fraction FROM one GROUP BY token""",
    ),
    "build_vocabulary": (
        lambda spark, sf: sequences.build_vocabulary(lines(spark, sf), "text", parts(spark)),
        f"""WITH {LINES} SELECT * FROM (VALUES ('<PAD>', 0), ('<BOS>', 1), ('<EOS>', 2), ('<UNK>', 3)) v(token, id)
UNION ALL SELECT token, CAST(3 + ROW_NUMBER() OVER (ORDER BY token) AS INTEGER)
FROM (SELECT DISTINCT unnest({token_list()}) AS token FROM lines)""",
    ),
    "token_length_stats": (
        lambda spark, sf: rounded(
            sequences.token_length_stats(lines(spark, sf), "text"), "mean", "std", "q25", "q50", "q75"
        ),
        TOKEN_LENGTHS,
    ),
    "encode": (
        lambda spark, sf: _encoded(spark, sf).select("doc_id", _joined("ids")),
        f"WITH {VOCABULARY} SELECT doc_id, array_to_string(ids, ',') AS ids FROM encoded",
    ),
    "pad_sequences": (
        padded,
        f"""WITH {VOCABULARY}, top AS (SELECT MAX(len(ids)) AS n FROM encoded)
SELECT doc_id, CAST(len(ids) AS INTEGER) AS sequence_length,
md5(array_to_string(list_concat(ids, list_transform(range(n - len(ids)), lambda x: 0)), ',')) AS digest FROM encoded, top""",
    ),
    "decode": (
        decoded,
        f"""WITH {VOCABULARY},
names AS (SELECT doc_id, string_agg(CASE WHEN v.id IS NULL THEN '<UNK>' ELSE token END, '' ORDER BY i) AS decoded,
  string_agg(CASE WHEN v.id IS NULL THEN '' ELSE token END, '' ORDER BY i) AS known_only
  FROM one LEFT JOIN vocabulary v USING (token) GROUP BY doc_id)
SELECT doc_id, md5(coalesce(decoded, '')) AS decoded, md5(coalesce(known_only, '')) AS known_only
FROM lines LEFT JOIN names USING (doc_id)""",
    ),
    "shift": (
        shifted,
        f"""WITH {VOCABULARY} SELECT doc_id, md5(array_to_string(list_slice(ids, 1, len(ids) - 1), ',')) AS input,
md5(array_to_string(list_slice(ids, 2, len(ids)), ',')) AS target FROM encoded""",
    ),
    "roundtrip_check": (
        lambda spark, sf: sequences.roundtrip_check(lines(spark, sf), "text", _vocabulary(spark, sf), "doc_id", parts(spark)),
        f"""WITH {VOCABULARY}, missing AS (SELECT DISTINCT doc_id FROM one WHERE token NOT IN (SELECT token FROM vocabulary))
SELECT COUNT(*) AS n_texts, COUNT(*) FILTER (doc_id NOT IN (SELECT doc_id FROM missing)) AS n_same,
COUNT(*) FILTER (doc_id IN (SELECT doc_id FROM missing)) AS n_changed FROM lines""",
    ),
    "split_exact": (
        lambda spark, sf: split_exact(
            table(spark, sf, "documents").select("doc_id"), "doc_id", {"train": 0.9, "validation": 0.05}, "holdout"
        ),
        """WITH r AS (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS k,
COUNT(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN k <= floor(n * 0.9) THEN 'train' WHEN k <= floor(n * 0.9) + floor(n * 0.05) THEN 'validation'
ELSE 'holdout' END AS split FROM r""",
    ),
    "fit_ngram": (
        fitted,
        f"""WITH {MODEL} SELECT CAST(length AS INTEGER) AS length, c2 || c1 AS context, next, count FROM model""",
    ),
    "score_sequences": (scored, SCORE),
    "sample_sequences": (sampled, None),
    "sample_sequences_short": (sampled_short, SAMPLED),
    "best_row": (
        lambda spark, sf: sequences.best_row(
            table(spark, sf, "events").select("event_id", "event_type", "user_id", "value"), "value", "event_id", ["event_type"]
        ),
        """SELECT event_id, event_type, user_id, value FROM events QUALIFY
ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY value, event_id) = 1""",
    ),
}
