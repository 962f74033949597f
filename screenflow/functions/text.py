"""Token and sequence columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token pattern and special tokens.
TOKEN_PATTERN = r"(\[[^\[\]]+\]|Br|Cl|Si|Se|@@?|%[0-9]{2}|[^\n])"
PAD, BOS, EOS, UNK = "<PAD>", "<BOS>", "<EOS>", "<UNK>"
SPECIALS = [PAD, BOS, EOS, UNK]
PAD_ID, BOS_ID, EOS_ID, UNK_ID = 0, 1, 2, 3

# Bracket content = isotope, element, chirality, hydrogens, charge, class.
HYDROGEN_GROUP = r"\[[0-9]*H(?![a-z])[^\[\]]*\]"
BRACKET_CHARGE = r"(\++|-+)([0-9]*)(?::[0-9]+)?\]$"


def tokens(text: Column) -> Column:
    """Split text into bracket groups, two-letter symbols, closures and single characters."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(1))


def is_lossless(text: Column) -> Column:
    """Whether the tokens put together give the text back (a line break is in no token)."""
    return F.array_join(tokens(text), "") == text


def strict_tokens(text: Column) -> Column:
    """Tokens, or an error that fails the job for a text they do not reproduce."""
    return F.when(is_lossless(text), tokens(text)).when(
        text.isNotNull(), F.raise_error(F.concat(F.lit("tokens do not reproduce: "), text))
    )


def length_with_ends(token_array: Column) -> Column:
    return F.size(token_array) + 2


def pad(ids: Column, length: int, pad_id: int = PAD_ID) -> Column:
    """Fill up on the right to `length`; a longer sequence fails the job."""
    too_long = F.raise_error(F.concat(F.lit("sequence too long: "), F.size(ids).cast("string")))
    room = F.lit(length) - F.size(ids)
    return F.when(room >= 0, F.concat(ids, F.array_repeat(F.lit(pad_id), F.greatest(room, F.lit(0))))).otherwise(
        too_long
    )


def pad_text(ids: Column, length: int, separator: str, pad_id: int = PAD_ID) -> Column:
    """`pad` as a text of numbers."""
    room = F.lit(length) - F.size(ids)
    fill = F.repeat(F.lit(f"{separator}{pad_id}"), F.greatest(room, F.lit(0)))
    text = F.concat(F.array_join(ids.cast("array<string>"), separator), fill)
    # Nothing stands before the first separator where there are no ids.
    text = F.when(F.size(ids) == 0, F.substr(text, F.lit(len(separator) + 1))).otherwise(text)
    too_long = F.raise_error(F.concat(F.lit("sequence too long: "), F.size(ids).cast("string")))
    return F.when(room >= 0, text).otherwise(too_long)


def shift_input(ids: Column) -> Column:
    """All but the last id."""
    return F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0)))


def shift_target(ids: Column) -> Column:
    """All but the first id."""
    return F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))


def content_ids(ids: Column, skip: list[int]) -> Column:
    """Ids before the first EOS, without those in `skip`."""
    end = F.array_position(ids, EOS_ID)
    before = F.when(end > 0, F.slice(ids, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(ids)
    return F.filter(before, lambda i: ~i.isin(skip))


def decode(ids: Column, names: Column, skip: list[int]) -> Column:
    """Text of an id sequence; `names` is the array of tokens in id order."""
    return F.array_join(F.transform(content_ids(ids, skip), lambda i: F.get(names, i)), "")


def _bracket_charge(token: Column) -> Column:
    """Formal charge written in a bracket token: signs repeated, or one sign and a number."""
    signs = F.regexp_extract(token, BRACKET_CHARGE, 1)
    number = F.regexp_extract(token, BRACKET_CHARGE, 2)
    size = F.when(number == "", F.length(signs)).otherwise(F.coalesce(number.try_cast("int"), F.lit(0)))
    return F.when(signs == "", F.lit(0)).when(signs.startswith("+"), size).otherwise(-size)


# Bracket groups are the only tokens that hold a bracket and more than one character, so what is
# counted outside them is counted on the text without them; a line break, which is in no token,
# keeps what stood on both sides apart. No array of all tokens is made.
BRACKET_GROUP = r"\[[^\[\]]+\]"
CHARGED_GROUP = r"\[[^\[\]]*[+-][0-9]*(?::[0-9]+)?\]"


def outside_brackets(text: Column) -> Column:
    """The text with a line break for every bracket group."""
    return F.regexp_replace(text, F.lit(BRACKET_GROUP), F.lit("\n"))


def fragment_count(outside: Column) -> Column:
    """Dots outside brackets, plus one."""
    return F.regexp_count(outside, F.lit("[.]")) + 1


def formal_charge(text: Column) -> Column:
    """Sum of the charges of the bracket groups that have one."""
    charges = F.transform(F.regexp_extract_all(text, F.lit(CHARGED_GROUP), F.lit(0)), _bracket_charge)
    return F.aggregate(charges, F.lit(0), lambda total, c: total + c)


def heavy_atom_count(text: Column, outside: Column) -> Column:
    """Atom tokens: letters, two-letter symbols and brackets other than hydrogen."""
    letters = F.length(outside) - F.length(F.regexp_replace(outside, F.lit("[A-Za-z]+"), F.lit("")))
    groups = F.regexp_count(text, F.lit(BRACKET_GROUP)) - F.regexp_count(text, F.lit(HYDROGEN_GROUP))
    return letters - F.regexp_count(outside, F.lit("H|Br|Cl|S[ie]")) + groups


def ring_count(outside: Column) -> Column:
    """Ring closures come in pairs of equal labels: a digit or %nn outside brackets."""
    closures = F.regexp_count(outside, F.lit("[0-9]")) - F.regexp_count(outside, F.lit("%[0-9]{2}"))
    return F.floor(closures / 2).cast("int")
