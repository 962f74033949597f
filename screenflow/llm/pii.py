"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Kinds `email`, `ip`, `card` and `phone` are always kept once their check holds. `iban` (mod 97) and
`ssn` are kept when their score, raised by nearby words, reaches the threshold.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenflow.llm.arrow import append_columns

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE_KINDS = KINDS[:4]
THRESHOLD = 0.5
BEFORE, AFTER = 48, 24  # code points searched for words around a span
RAISE = 0.3
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
CONTEXT = {
    "email": {"email", "mail", "contact", "write"},
    "ip": {"ip", "address", "host", "server"},
    "card": {"card", "credit", "debit", "visa", "mastercard", "payment"},
    "phone": {"phone", "call", "tel", "telephone", "mobile", "fax"},
    "iban": {"iban", "account", "bank", "transfer", "bic"},
    "ssn": {"ssn", "social", "security"},
}

SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits are taken whole, so that a long run is tried once and not once per digit.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[a-z]+")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 check of an account number without blanks."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: its local part is the run of characters before it."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        floor = domain.end() if domain else at + 1
        if domain:
            out.append((start, floor))
        at = text.find("@", floor)
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    def small(part: str) -> bool:
        part = part.lstrip("0")
        return len(part) <= 3 and int(part or "0") <= 255

    return [m.span() for m in _IP.finditer(text) if all(map(small, m.group().split(".")))]


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGITS.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGITS.sub("", m.group())) <= 15]


def _ibans(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _IBAN.finditer(text):
        code = m.group()
        while len(code.replace(" ", "")) >= 15:  # a capital word may follow the number
            if mod97(code.replace(" ", "")):
                out.append((m.start(), m.start() + len(code)))
                break
            cut = code.rfind(" ")
            if cut < 0:
                break
            code = code[:cut]
    return out


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = (text[max(0, start - BEFORE) : start] + " " + text[end : end + AFTER]).lower()
    return round(BASE_SCORE[kind] + RAISE * (not CONTEXT[kind].isdisjoint(_WORD.findall(near))), 2)


def find_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind; positions are code points."""
    found = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", *s) for s in _ips(text)]
        found += [("card", *s) for s in _cards(text)]
        found += [("phone", *s) for s in _phones(text)] if "+" in text else []
        found += [("iban", *s) for s in _ibans(text)]
        found += [("ssn", *m.span()) for m in _SSN.finditer(text)] if "-" in text else []
    scored = [(k, s, e, _score(k, text, s, e)) for k, s, e in found]
    kept = [x for x in scored if x[0] in BASE_KINDS or x[3] >= threshold]
    return sorted(kept, key=lambda x: (x[1], KINDS.index(x[0])))


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """Replace each span by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def detect_pii(docs: DataFrame, text: str = "text", name: str = "pii", threshold: float = THRESHOLD) -> DataFrame:
    """Add the spans of every whole text as an array of (kind, start, end, score).

    A NULL or empty text has none. Rows are handled one by one: repeated rows give repeated results,
    and other columns, NULL or not, pass through unless they bear the name of the new one.
    """

    names = ("kind", "start", "end", "score")

    def work(column):
        return [[[dict(zip(names, s)) for s in find_spans(t or "", threshold)] for t in column.to_pylist()]]

    return append_columns(docs, text, {name: SPANS}, work)


def pii_digest(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: spans per base kind, a digest of the base spans, and all spans as text.

    NULL texts count as empty; an empty text has nothing to find. Repeated rows are returned as often
    as they occur, an empty table gives no rows, and other columns than id and text are not read.
    """

    def work(column):
        columns = [[] for _ in range(6)]
        for t in column.to_pylist():
            spans = find_spans(t, threshold) if t else []
            for i, kind in enumerate(BASE_KINDS):
                columns[i].append(sum(s[0] == kind for s in spans))
            base = ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans if k in BASE_KINDS)
            columns[4].append(hashlib.sha256(base.encode()).hexdigest())
            columns[5].append(",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans))
        return columns

    fields = {f"n_{kind}": T.LongType() for kind in BASE_KINDS}
    fields |= {"base_sha256": T.StringType(), "spans": T.StringType()}
    return append_columns(docs.select(id, text), text, fields, work, drop=True)


def redact_pii(docs: DataFrame, text: str = "text", length: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Replace personal data in every text, keeping all columns; `length` names a column of text lengths.

    A NULL text stays NULL and keeps its length.
    """
    kinds = {text: T.StringType()}
    order = docs.columns

    def work(column):
        return [[redact(t, find_spans(t, threshold)) if t else t for t in column.to_pylist()]]

    out = append_columns(docs, text, kinds, work)
    if length is not None:
        kind = docs.schema[length].dataType
        out = out.withColumn(length, F.when(F.col(text).isNull(), F.col(length)).otherwise(F.char_length(text)).cast(kind))
    return out.select(*order)
