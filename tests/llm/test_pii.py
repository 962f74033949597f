import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from screenflow.llm.pii import detect_pii, find_spans, luhn, mod97, pii_digest, redact, redact_pii

CARD = "4539 1488 0343 6467"


def plain(text):
    """The four base kinds straight from their patterns."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    checks = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    }
    return sorted((m.start(), list(checks).index(k), k, m.end()) for k, (p, ok) in checks.items() for m in re.finditer(p, text) if ok(m.group()))


def base(text):
    return [(s, ["email", "ip", "card", "phone"].index(k), k, e) for k, s, e, _ in find_spans(text) if k not in ("iban", "ssn")]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1+@. -()Z9_0%é2", max_size=60))
def test_base_spans_are_the_patterns(text):
    assert base(text) == plain(text)


@pytest.mark.parametrize("text", ["a@b.c_d@e.f", "@@a@b.c@d.e", "1.2.3.4.5.6.7.8", "999.1.2.3.4", "0001.02.3.4", CARD, "12--34", "+1 (743) 555-3824 x", "9" * 5000])
def test_edges(text):
    assert base(text) == plain(text)


def test_checksums():
    assert luhn("4539148803436467") and not luhn("4539148803436468")
    assert mod97("GB82WEST12345698765432") and not mod97("GB82WEST12345698765431")


def test_method_spans_need_check_or_context():
    found = lambda text: [s[0] for s in find_spans(text)]
    assert found("to GB82 WEST 1234 5698 7654 32 AND THEN") == ["iban"]
    assert "iban" not in found("to GB82 WEST 1234 5698 7654 31")
    assert found("number 123-45-6789") == []
    assert found("social security 123-45-6789") == ["ssn"]
    low, high = find_spans("at 10.0.0.1 now")[0][3], find_spans("server at 10.0.0.1 now")[0][3]
    assert high > low


def test_redact_joins_overlaps():
    text = "é " + CARD + " and a.b@c.de"
    assert redact(text, find_spans(text)) == "é [CARD] and [EMAIL]"
    assert redact("0123456789", [("ip", 1, 4, 1.0), ("card", 3, 7, 1.0), ("ip", 7, 8, 1.0)]) == "0[IP][IP]89"


def test_whole_tables(spark, documents, no_documents):
    rows = pii_digest(documents).collect()
    assert len(rows) == documents.count() and {r["spans"] for r in rows} == {""}
    assert pii_digest(no_documents).count() == 0
    added = detect_pii(documents)
    assert added.columns == [c for c in documents.columns if c != "pii"] + ["pii"] and added.where("size(pii) > 0").count() == 0
    one = spark.createDataFrame([(1, "call +1 743 555 3824", 20), (2, None, 5)], "doc_id int, text string, n_chars long")
    assert sorted(map(tuple, redact_pii(one, length="n_chars").collect())) == [(1, "call [PHONE]", 12), (2, None, 5)]
