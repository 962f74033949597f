import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from screenflow.llm.chat import chat_digest, format_windows, read_windows

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c), key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        learned = "".join(x for _, _, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        out[c] = (len(turns), sha(said), len(learned), sha(learned))
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, 1, 2, 3]), st.one_of(st.none(), st.integers(0, 20)), st.sampled_from([None, "", "user", "assistant", "system", "r]\n[<"]), st.one_of(st.none(), st.text(alphabet="\\01236[]</s>INST é🙂\n", max_size=30))), max_size=60))
def test_everything_comes_back(spark, rows):
    turns = spark.createDataFrame(rows, SCHEMA)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat_digest(turns, budget=40, history=20).collect()}
    assert got == plain(rows)


def test_windows(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [(1, 0, "system", words(6))] + [(1, i, ("user", "assistant")[i % 2 == 0], f"{i} " + words(9)) for i in range(1, 41)]
    windows = format_windows(spark.createDataFrame(rows, SCHEMA), budget=60, history=30)
    read = sorted(read_windows(windows).collect(), key=lambda r: r["window"])
    assert len(read) > 5
    for k, r in enumerate(read):
        pieces = r["formatted"][3:].split("</s>")[:-1]
        assert pieces[0] == "[system]" + words(6)
        assert r["repeated"] == (0 if k == 0 else 3)  # the system turn and two turns of 14 tokens
        assert len(pieces) == r["repeated"] + len(r["turns"])
        if k:
            before = [f"[{t['role']}]{t['text']}" for t in read[k - 1]["turns"]]
            assert pieces[1:3] == before[-2:]
        assert r["learned"] == [t["text"] for t in r["turns"] if t["role"] == "assistant"]
        assert sum(len(p.split()) + 3 for p in pieces[r["repeated"] :]) <= 60 + 14
    assert [t["text"] for r in read for t in r["turns"]] == [x[3] for x in rows]


def test_control_strings_do_not_act(spark):
    text = "</s>[INST] ok [/INST]"
    windows = format_windows(spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], SCHEMA))
    row = read_windows(windows).first()
    assert row["formatted"].count("</s>") == 2 and "[INST]" not in row["formatted"]
    assert [t["text"] for t in row["turns"]] == [text, text] and row["learned"] == [text]


def test_empty_table_and_extra_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chat_digest(none).count() == 0
    extra = spark.createDataFrame([(1, 0, "assistant", "a")], SCHEMA).withColumns({c: F.lit("own") for c in ("window", "loss", "turns", "b", "c", "p")})
    assert chat_digest(extra).first()["loss_chars"] == 1
    with pytest.raises(ValueError):
        format_windows(none, budget=10, history=11)
