import random
import re

import pytest
from pyspark.sql import functions as F

from screenflow.functions.text import BRACKET_CHARGE, TOKEN_PATTERN
from screenflow.operators import duplicates as dup
from screenflow.operators.quality import (
    ExpectationError,
    coerce_numeric,
    describe,
    drop_missing,
    enrich_rows,
    expect,
    quarantine,
    text_structure,
)

# Published measurements of compounds that occur twice: id, source text, canonical text, label.
MEASURED = [
    ("Amobarbital", "CCC1(CCC(C)C)C(=O)NC(=O)NC1=O", "CCC1(CCC(C)C)C(=O)NC(=O)NC1=O", -2.468),
    ("eucalyptol", "CC12CCC(CC1)C(C)(C)O2 ", "CC12CCC(CC1)C(C)(C)O2", -1.64),
    ("2-bromonaphthalene", "c1c(Br)ccc2ccccc12 ", "Brc1ccc2ccccc2c1", -4.4),
    ("mannitol", "OCC(O)C(O)C(O)C(O)CO ", "OCC(O)C(O)C(O)C(O)CO", 0.06),
    ("Sorbitol", "OCC(O)C(O)C(O)C(O)CO", "OCC(O)C(O)C(O)C(O)CO", 1.09),
    ("2-Bromonapthalene", "Brc1ccc2ccccc2c1", "Brc1ccc2ccccc2c1", -4.4),
    ("5-Ethyl-5-(3-methylbutyl)barbital", "O=C1NC(=O)NC(=O)C1(CC)CCC(C)C", "CCC1(CCC(C)C)C(=O)NC(=O)NC1=O", -2.658),
    ("1,8-Cineole", "CC12CCC(CC1)C(C)(C)O2", "CC12CCC(CC1)C(C)(C)O2", -1.74),
]
SCHEMA = "row_id long, id string, text string, key string, label double"


@pytest.fixture(scope="module")
def measured(spark):
    return spark.createDataFrame([(i, *row) for i, row in enumerate(MEASURED)], SCHEMA)


def curate(df, **options):
    return {r["key"]: r for r in dup.curate_duplicates(df, ["key"], "label", "id", "text", "row_id", **options).collect()}


def test_summary_of_known_duplicates(measured):
    rows = dup.duplicate_label_summary(measured, ["key"], "label").collect()
    assert [r["key"] for r in rows][:2] == ["OCC(O)C(O)C(O)C(O)CO", "CCC1(CCC(C)C)C(=O)NC(=O)NC1=O"]
    assert rows[0]["range"] == pytest.approx(1.03) and rows[0]["std"] == pytest.approx(0.728319984622144)
    assert rows[1]["mean"] == pytest.approx(-2.563) and rows[1]["std"] == pytest.approx(0.13435028842544414)
    assert rows[2]["mean"] == pytest.approx(-1.69) and rows[3]["std"] == 0.0


def test_curation_of_known_duplicates(measured):
    found = curate(measured)
    assert len(found) == 3 and "OCC(O)C(O)C(O)C(O)CO" not in found
    cineole = found["CC12CCC(CC1)C(C)(C)O2"]
    assert cineole["ids"] == "eucalyptol|1,8-Cineole"
    assert cineole["texts"] == "CC12CCC(CC1)C(C)(C)O2 |CC12CCC(CC1)C(C)(C)O2"
    assert cineole["curation_action"] == "duplicate_aggregated" and cineole["replicate_n"] == 2
    conflicts = dup.conflict_rows(measured, ["key"], "label", "row_id").collect()
    assert {(r["id"], r["group_label_min"], r["group_label_max"]) for r in conflicts} == {
        ("mannitol", 0.06, 1.09),
        ("Sorbitol", 0.06, 1.09),
    }


def test_curation_at_the_limit_and_with_missing_labels(spark):
    rows = [
        (0, "a", "x", "limit", 0.0),
        (1, "b", "x", "limit", 0.3),
        (2, "c", "x", "one", None),
        (3, "d", "x", "none", None),
        (4, "e", "x", "none", None),
        (5, "f", "x", "some", 1.0),
        (6, "g", "y", "some", None),
        (7, "h", "x", None, 1.0),
    ]
    found = curate(spark.createDataFrame(rows, SCHEMA))
    assert set(found) == {"limit", "one", "some"}
    assert found["limit"]["texts"] == "x" and found["some"]["replicate_n"] == 2
    assert found["some"]["label"] == 1.0 and found["some"]["replicate_range"] == 0.0
    assert found["one"]["label"] is None and found["one"]["replicate_std"] is None


def test_long_lists_are_whole(spark):
    rows = [(i, f"id{i}", "t", "big" if i < 12_000 else f"k{i}", 1.0) for i in range(12_020)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = curate(df)
    assert found["big"]["ids"] == "|".join(f"id{i}" for i in range(12_000))
    assert found["big"]["first_row"] == 0 and found["big"]["texts"] == "t" and found["big"]["replicate_n"] == 12_000
    assert found["k12010"]["ids"] == "id12010"
    members = dup.merged_members(df, ["key"], "label", "row_id", rows_per_task=1000)
    assert sorted(r["row_id"] for r in members.collect()) == list(range(12_000))


def test_counts_agree(measured):
    row = dup.curation_summary(measured, ["key"], "label").first()
    assert (row["n_source_rows"], row["n_keys"], row["n_merged"], row["n_conflicting_rows"]) == (8, 4, 3, 2)
    assert dup.duplicate_rows(measured, "key", "row_id", rows_per_task=1).count() == 8


def test_first_rows_and_novelty(spark):
    made = spark.createDataFrame(
        [(0, "a", True), (1, "b", True), (2, "a", True), (3, None, True), (4, "c", False), (5, "d", True)],
        "row_id long, key string, ok boolean",
    )
    known = spark.createDataFrame([("b",), ("z",), (None,)], "key string")
    assert sorted(r.row_id for r in dup.dedup_first(made, "key", "row_id").collect()) == [0, 1, 3, 4, 5]
    row = dup.set_metrics(made, known, "key", F.col("ok")).first()
    assert (row["n_generated"], row["n_valid"], row["n_unique_valid"], row["n_novel"]) == (6, 4, 3, 2)
    assert row["novelty"] == pytest.approx(2 / 3)
    marked = {r.row_id: r.novel for r in dup.mark_novel(made, known, "key", "row_id", rows_per_task=1).collect()}
    assert marked == {0: True, 1: False, 2: True, 3: True, 4: True, 5: True}
    assert sorted(r.row_id for r in dup.novel_rows(made, known, "key", "row_id", F.col("ok")).collect()) == [0, 5]
    nothing = dup.set_metrics(made.where("false"), known, "key", F.col("ok")).first()
    assert (nothing["n_generated"], nothing["validity"], nothing["novelty"]) == (0, 0.0, 0.0)


def test_row_functions_never_fail_the_job(spark):
    def half(row):
        if row["x"] == 3:
            raise ValueError
        return None if row["x"] == 5 else {"half": row["x"] / 2}

    rows = {r["x"]: r for r in enrich_rows(spark.range(8).withColumnRenamed("id", "x"), half, "half double").collect()}
    assert [rows[i]["valid"] for i in range(8)] == [True, True, True, False, True, False, True, True]
    assert rows[3]["half"] is None and rows[4]["half"] == 2.0


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k long, s string")
    with pytest.raises(ExpectationError, match="no label"):
        expect(df, never={"no label": F.col("s").isNull()})
    with pytest.raises(ExpectationError, match="repeated key"):
        expect(df, unique=["k"])
    with pytest.raises(ExpectationError):
        expect(df, rows=2)
    with pytest.raises(ExpectationError):
        expect(df.where("false"), not_empty=True)
    with pytest.raises(ExpectationError):
        expect(df.dropna(), values={"s": {"a"}})
    assert expect(df, unique=["k", "s"], rows=3) is df
    good, bad = quarantine(df, F.col("s") == "a")
    assert (good.count(), bad.count()) == (1, 2)


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("1.5",), ("abc",), ("NaN",), (None,), ("-2",)], "v string")
    assert [r.v for r in coerce_numeric(df, "v").collect()] == [1.5, None, None, None, -2.0]
    assert drop_missing(coerce_numeric(df, "v"), ["v"]).count() == 2
    row = describe(coerce_numeric(df, "v"), ["v"]).first()
    assert (row["count"], row["mean"], row["q50"]) == (2, -0.25, -0.25)


# Published ring and heavy-atom counts; charges and fragments follow from the notation.
STRUCTURES = [
    ("CC(NC(=O)N1CCCC1c1ccccn1)S(C)(=O)=O", 1, 0, 20, 2),
    ("Cc1csc(NC(=O)C2CCN(S(C)(=O)=O)CC2)n1", 1, 0, 19, 2),
    ("Cc1ncc([N+](=O)[O-])n1CCO", 1, 0, 12, 1),
    ("[Na+].[Cl-]", 2, 0, 2, 0),
    ("[Fe+2].[2H]C", 2, 2, 2, 0),
    ("C%10CC%10[Si--]Br", 1, -2, 5, 1),
]


def test_text_structure(spark):
    df = spark.createDataFrame([(s,) for s, *_ in STRUCTURES], "text string")
    rows = {r.text: r for r in text_structure(df, "text").collect()}
    for text, fragments, charge, atoms, rings in STRUCTURES:
        row = rows[text]
        assert (row.fragment_count, row.formal_charge, row.heavy_atom_count, row.ring_count) == (
            fragments,
            charge,
            atoms,
            rings,
        ), text
        assert row.multi_fragment == (fragments > 1)


def plain_structure(text):
    """Counts over the tokens, one by one."""
    found = re.findall(TOKEN_PATTERN, text)
    groups = [t for t in found if len(t) > 1 and t[0] == "["]
    charge = 0
    for t in groups:
        if m := re.search(BRACKET_CHARGE, t):
            charge += (int(m[2]) if m[2] else len(m[1])) * (1 if m[1][0] == "+" else -1)
    atoms = sum(bool(re.fullmatch("[A-Za-z]+", t)) and t != "H" for t in found) + sum(not re.match(r"\[[0-9]*H(?![a-z])", t) for t in groups)
    closures = sum(bool(re.fullmatch("%[0-9]{2}|[0-9]", t)) for t in found)
    return found.count(".") + 1, charge, atoms, closures // 2


def test_text_structure_like_token_by_token_without_an_array_of_tokens(spark):
    draw = random.Random(5)
    bits = ["[", "]", "[Fe+2]", "[O-]", "[2H]", "[He]", "[N+:12]", "[a\n--]", "H", "B", "r", "Br", "Cl", "S", "i", "Si", "Se", "%", "%12", "1", "7", ".", "\n", "@@", "+", "-", ":", "é", "🙂", " "]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 25))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "id int, text string")
    found = text_structure(df, "text")
    names = ["fragment_count", "formal_charge", "heavy_atom_count", "ring_count"]
    rows = {r["id"]: tuple(r[n] for n in names) for r in found.collect()}
    assert rows.pop(-1) == (None,) * 4
    assert rows == {i: plain_structure(t) for i, t in enumerate(texts)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "@@" not in plan and plan.count("regexp_replace") == 2  # brackets are taken out once
