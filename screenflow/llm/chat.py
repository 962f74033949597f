"""Chat formatting into budgeted windows with a loss mask, and reading the format back.

A window is `<s>` and turns `[role]text</s>`. In texts and roles the characters that begin a control
string are escaped (`\\0` backslash, `\\1` less-than, `\\2` bracket; in roles also `\\3` closing
bracket), so a control string inside a text never acts as one and unescaping gives the text back.

Prefix sums of turn tokens cut a conversation into spans of whole turns. A window holds the system
turn that opens the conversation, repeated; some turns just before the span, repeated as history up
to a token limit; and the turns of its span. The loss mask covers the assistant texts of the span
only, so each is learned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the format.
BEGIN, END = "<s>", "</s>"
OPEN, CLOSE = "[", "]"
ESCAPES = [("\\", "\\0"), ("<", "\\1"), ("[", "\\2")]
ROLE_ESCAPES = [*ESCAPES, ("]", "\\3")]

BUDGET = 1024  # tokens of new turns after which a span ends
HISTORY = 256  # tokens of repeated turns; at most BUDGET
MARKS = 4  # tokens counted for a turn's control strings


def _escape(text: Column, escapes: list[tuple[str, str]]) -> Column:
    for char, code in escapes:
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def _unescape(text: Column) -> Column:
    """Undo all escapes; the backslash comes last, so no code is made by undoing another."""
    for char, code in reversed(ROLE_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def word_tokens(text: Column) -> Column:
    """Tokens of a text: its runs of letters and digits, and all other visible characters."""
    return F.regexp_count(text, F.lit("[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]"))


def format_windows(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    budget: int = BUDGET, history: int = HISTORY, tokens=word_tokens,
) -> DataFrame:
    """`conv`, `window` (from 0 in order), `formatted`, `repeated` (leading turns that are repeats), `loss`.

    `loss` is an array of (start, end), code points of `formatted`. Turns go by `turn`, then role and
    text; NULL texts and roles count as empty; rows with a NULL conversation form one of their own.
    Repeated rows are turns of their own. A span ends when its tokens pass a multiple of `budget`,
    so a single long turn is never cut.
    """
    if not 0 <= history <= budget:
        raise ValueError("history must be between 0 and the budget")
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    rows = turns.select(F.col(conv).alias("c"), F.col(turn).alias("t"), by.alias("r"), said.alias("x"))
    rows = rows.withColumn("n", tokens(F.col("x")).cast("long") + MARKS)
    order = Window.partitionBy("c").orderBy("t", "r", "x")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    # Where each turn starts in tokens, which span that is, and whether it is the first of its span.
    placed = rows.withColumns({"p": F.row_number().over(order), "at": F.coalesce(F.sum("n").over(past), F.lit(0).cast("long"))})
    placed = placed.withColumn("b", F.floor(F.col("at") / budget))
    opening = F.when((F.col("p") == 1) & (F.col("r") == "system"), F.struct("r", "x"))
    placed = placed.withColumns(
        {"first": F.coalesce(F.lag("b").over(order) != F.col("b"), F.lit(True)), "sys": F.first(opening).over(order)}
    )
    # The next span's start: the nearest later turn that is first of its span.
    later = Window.partitionBy("c").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("next", F.last(F.when(F.col("first"), F.col("at")), ignorenulls=True).over(later))
    new = F.struct(F.col("b").alias("b"), F.lit(2).alias("kind"), "p", "r", "x")
    # With history <= budget a turn can be history of the next span only.
    is_system = F.col("sys").isNotNull() & (F.col("p") == 1)
    old = F.when((F.col("at") >= F.col("next") - history) & ~is_system, F.struct(F.floor(F.col("next") / budget).alias("b"), F.lit(1).alias("kind"), "p", "r", "x"))
    system = F.when(
        F.col("first") & (F.col("p") > 1) & F.col("sys").isNotNull(),
        F.struct(F.col("b").alias("b"), F.lit(0).alias("kind"), F.lit(1).alias("p"), F.col("sys.r").alias("r"), F.col("sys.x").alias("x")),
    )
    members = placed.select("c", F.explode(F.array_compact(F.array(new, old, system))).alias("m")).select("c", "m.*")
    # A window is bounded by budget and history: every turn has at least MARKS tokens.
    windows = members.groupBy("c", "b").agg(F.array_sort(F.collect_list(F.struct("kind", "p", "r", "x"))).alias("turns"))

    def written(m: Column) -> Column:
        mark = F.concat(F.lit(OPEN), _escape(m["r"], ROLE_ESCAPES), F.lit(CLOSE))
        return F.struct(mark.alias("mark"), _escape(m["x"], ESCAPES).alias("text"), ((m["kind"] == 2) & (m["r"] == "assistant")).alias("learn"))

    start = F.struct(F.lit(len(BEGIN)).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def advance(done: Column, w: Column) -> Column:
        begin = done["at"] + F.char_length(w["mark"])
        end = begin + F.char_length(w["text"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(w["learn"], F.concat(done["loss"], span)).otherwise(done["loss"]).alias("loss"))

    out = windows.select("c", "b", F.size(F.filter("turns", lambda m: m["kind"] < 2)).alias("repeated"), F.transform("turns", written).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda w: F.concat(w["mark"], w["text"], F.lit(END))), "")
    return out.select(
        F.col("c").alias(conv), F.col("b").alias("window"), F.concat(F.lit(BEGIN), whole).alias("formatted"), "repeated",
        F.aggregate("turns", start, advance)["loss"].alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Per window what the format says: `turns`, an array of (role, text) without repeats, and `learned`."""
    pieces = F.split(F.substr(F.col("formatted"), F.lit(len(BEGIN) + 1)), F.lit(END))
    new = F.slice(pieces, F.col("repeated") + 1, F.greatest(F.lit(0), F.size(pieces) - 1 - F.col("repeated")))

    def turn(piece: Column) -> Column:
        close = F.instr(piece, CLOSE)
        return F.struct(
            _unescape(F.substr(piece, F.lit(len(OPEN) + 1), close - len(OPEN) - 1)).alias("role"),
            _unescape(F.substr(piece, close + 1)).alias("text"),
        )

    learned = F.transform("loss", lambda s: _unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return windows.withColumns({"turns": F.transform(new, turn), "learned": learned})


def chat_digest(turns: DataFrame, conv: str = "conv_id", **columns) -> DataFrame:
    """Per conversation, read back from its windows: turns, their digest, learned text, and total length.

    The digests are over one string per conversation, so a conversation's text must fit one value.
    """
    windows = format_windows(turns, conv, **columns)
    read = read_windows(windows).select(
        F.col(conv), "window", F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("learned", "").alias("learned"), F.char_length("formatted").cast("long").alias("length"),
    )
    parts = F.array_sort(F.collect_list(F.struct("window", "said", "learned")))
    whole = read.groupBy(conv).agg(F.sum("n").alias("n_turns"), F.sum("length").alias("formatted_chars"), parts.alias("parts"))
    joined = whole.select(
        conv, "n_turns", "formatted_chars", F.array_join("parts.said", "").alias("said"), F.array_join("parts.learned", "").alias("learned")
    )
    return joined.select(
        conv,
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )
