"""Spelling variants: words one inserted, deleted or replaced character apart, through trie nodes.

Every prefix of a word is a node of a forward trie, every suffix one of a reversed trie; both are
numbered. A word skips a place by the pair (node before it, node after it). Two words that skip to
the same pair differ in that place only; a word whose pair without a gap equals a skipping pair is
that word with one character less. So equal pairs of integers give exactly the near words: no
candidate is ever compared as text.

A pair is shared by at most one word per character of the alphabet, plus the one word it splits, so
its words fit one row. All work is on the vocabulary but the first count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenflow.functions.ordering import global_rank
from screenflow.functions.skew import ROWS_PER_TASK, salted_join
from screenflow.session import materialize

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMAGE = 199  # one in so many occurrences loses a character, as a slip would
LEAST_LENGTH, LEAST_COUNT = 6, 5
RATIO = 5  # a form is at least so many times as frequent
_PLAIN = 32  # code points of a prefix or suffix that are kept as they are; whole pieces before them as SHA-256


def word_counts(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    damage: int = DAMAGE,
) -> DataFrame:
    """`word`, `n`: letter runs with A-Z in lower case, those of enough code points and occurrences.

    Where `damage` divides h = crc32("id:run"), the run loses its code point h % length. NULL texts
    have no runs; a NULL id stands as an empty text. Repeated rows count as often as they occur.
    """
    lower = F.translate(F.col(text), UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"),
        # A shorter run stays too short, whether it loses a code point or not.
        F.explode(F.regexp_extract_all(lower, F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"),
    )
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    place = F.pmod(h, F.length("run")).cast("int")
    shorter = F.concat(F.expr("substring(run, 1, _place)"), F.expr("substring(run, _place + 2)"))
    words = runs.withColumns({"_h": h, "_place": place}).select(
        F.when(F.col("_h") % damage == 0, shorter).otherwise(F.col("run")).alias("word")
    )
    counted = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def _bound(value: Column, use) -> Column:
    """`use(value)` with the value worked out once per row, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pieces(word: Column) -> Column:
    """The word in pieces of _PLAIN code points (an empty last one included), so that no place is far to look up."""
    return F.transform(
        F.sequence(F.lit(0), F.floor(F.length(word) / _PLAIN).cast("int")),
        lambda k: F.call_function("substring", word, k * _PLAIN + 1, F.lit(_PLAIN)),
    )


def _prefix_keys(word: Column) -> Column:
    """A key for each prefix, shortest first: its last unfinished piece after a digest of all whole pieces before."""

    def keys(pieces: Column) -> Column:
        digests = F.aggregate(
            pieces, F.array(F.lit("")), lambda done, piece: F.concat(done, F.array(F.sha2(F.concat(F.element_at(done, -1), piece), 256)))
        )

        def per_piece(known: Column) -> Column:
            def of_piece(piece: Column, k: Column) -> Column:
                last = F.when(k == F.size(pieces) - 1, F.length(piece)).otherwise(F.lit(_PLAIN - 1))
                return F.transform(
                    F.sequence(F.lit(0), last), lambda i: F.concat(F.get(known, k), F.call_function("substring", piece, F.lit(1), i))
                )

            return F.flatten(F.transform(pieces, of_piece))

        return _bound(digests, per_piece)

    return _bound(_pieces(word), keys)


def _nodes_of_words(words: DataFrame, rows_per_task: int) -> DataFrame:
    """Add `pre` and `suf`: numbers of the trie nodes of all prefixes and of all suffixes, shortest first."""

    def ends(side: str, word: Column) -> Column:
        return F.transform(_prefix_keys(word), lambda k, i: F.struct(F.lit(side).alias("side"), i.alias("i"), k.alias("key")))

    both = F.concat(ends("<", F.col("word")), ends(">", F.reverse("word")))
    places = words.select("rank", F.explode(both).alias("x")).select("rank", "x.*")
    # Numbers depend on the order of rows, so they are written once.
    nodes = materialize(
        places.groupBy("side", "key").agg(F.count(F.lit(1)).alias("_n")).withColumn("node", F.monotonically_increasing_id())
    )
    # The shallow nodes (all words have the two roots) are split over tasks.
    named = salted_join(places, nodes, ["side", "key"], "_n", ["rank", "i"], rows_per_task=rows_per_task)

    def numbers(side: str) -> Column:
        mine = F.collect_list(F.when(F.col("side") == side, F.struct("i", "node")))
        return F.transform(F.array_sort(mine), lambda x: x["node"])

    per_word = named.groupBy("rank").agg(numbers("<").alias("pre"), numbers(">").alias("suf"))
    return words.join(per_word, "rank")


def _pairs(words: DataFrame) -> DataFrame:
    """`p`, `s` (nodes), `rank`, `n`, `skips`, `once`: the pairs of every word with and without a gap."""
    length = F.size("pre") - 1

    def pair(i: Column, gap: int, once: Column) -> Column:
        after = F.get("suf", length - gap - i)
        return F.struct(F.get("pre", i).alias("p"), after.alias("s"), F.lit(bool(gap)).alias("skips"), once.alias("once"))

    def gaps(pieces: Column) -> Column:
        def char(i: Column) -> Column:
            return F.call_function("substring", F.get(pieces, F.floor(i / _PLAIN).cast("int")), i % _PLAIN + 1, F.lit(1))

        # Of a run of equal characters any one may go with the same result: the first stands for all.
        return F.transform(F.sequence(F.lit(0), length - 1), lambda i: pair(i, 1, (i == 0) | (char(i) != char(i - 1))))

    splits = F.transform(F.sequence(F.lit(0), length), lambda i: pair(i, 0, F.lit(True)))
    every = F.concat(_bound(_pieces(F.col("word")), gaps), splits)
    return words.select("rank", "n", F.explode(every).alias("x")).select("rank", "n", "x.*")


def near_words(words: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """`rank`, `n_near`, `near_n`, `near_rank`: how many near words each word has, and the most frequent.

    `words` has `rank` (unique, in code-point order), `word` (distinct, not empty) and `n`. Words
    without a near word are left out; of equally frequent near words the smallest rank is named.
    """
    members = F.collect_list(F.struct("rank", "n", "skips", "once"))
    met = _pairs(_nodes_of_words(words, rows_per_task)).groupBy("p", "s").agg(members.alias("m")).where(F.size("m") > 1)

    def others(x: Column) -> Column:
        replaced = x["skips"] & F.col("y.skips") & (x["rank"] != F.col("y.rank"))
        longer = (x["skips"] != F.col("y.skips")) & x["once"] & F.col("y.once")
        return replaced | longer

    # Every member against the others of its pair: at most one word per character of the alphabet.
    each = met.select("m", F.explode("m").alias("y")).select(F.col("y.rank").alias("rank"), F.filter("m", others).alias("o"))
    found = each.where(F.size("o") > 0).select(
        "rank",
        F.size("o").cast("long").alias("k"),
        F.array_max(F.transform("o", lambda x: F.struct(x["n"].alias("n"), (-x["rank"]).alias("r")))).alias("best"),
    )
    best = found.groupBy("rank").agg(F.sum("k").alias("n_near"), F.max("best").alias("best"))
    return best.select("rank", "n_near", F.col("best.n").alias("near_n"), (-F.col("best.r")).alias("near_rank"))


def _last_forms(forms: DataFrame) -> DataFrame:
    """`rank`, `root`: forms (`rank`, `form`) followed to the end, twice as far in every round.

    A form is at least RATIO times as frequent as its word, so chains are short whatever the table.
    """
    state = materialize(forms.select("rank", F.col("form").alias("root")))
    while True:
        onward = state.select(F.col("rank").alias("root"), F.col("root").alias("_further"))
        state = materialize(
            state.join(onward, "root", "left").select("rank", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved"))
        )
        if not state.where("_moved").head(1):
            return state.drop("_moved")
        state = state.drop("_moved")


def spelling_variants(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    damage: int = DAMAGE,
    ratio: int = RATIO,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """`word`, `form`, `root`, `n`, `n_near`, `form_n` for every frequent word of all texts.

    The form is the most frequent near word (ties: smallest in code-point order) if it occurs at
    least `ratio` times as often; the root is where forms lead, the word itself if it has none.
    NULL and empty texts, and tables without any frequent word, add no rows; see `word_counts`.
    Other columns of the table are not read. A word and its nodes are one row, whatever its length.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1: forms of equal frequency would lead in circles")
    counted = word_counts(docs, id, text, least_length, least_count, damage)
    words = materialize(global_rank(counted, ["word"]))
    near = near_words(words, rows_per_task)
    known = materialize(words.join(near, "rank", "left"))
    form = F.when(F.col("near_n") >= ratio * F.col("n"), F.col("near_rank"))
    formed = known.withColumn("form", form)
    roots = _last_forms(formed.where("form IS NOT NULL").select("rank", "form"))
    names = words.select(F.col("rank").alias("_rank"), F.col("word").alias("_word"))
    out = formed.join(roots, "rank", "left")
    for number, name in (("form", "_form"), ("root", "_root")):
        out = out.join(names.withColumnsRenamed({"_rank": number, "_word": name}), number, "left")
    return out.select(
        "word",
        F.col("_form").alias("form"),
        F.coalesce("_root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("form").isNotNull(), F.col("near_n")).alias("form_n"),
    )
