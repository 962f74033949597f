import random

from pyspark.sql import functions as F

from screenflow.operators.screening import inside_range, rule_violations
from screenflow.plans.corpus import generate_texts, prepare_corpus
from screenflow.plans.property_model import build_property_model
from screenflow.plans.ranking import rank_candidates


def test_texts_to_generator(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("CNO()=c1") for _ in range(rng.randrange(3, 30))) for _ in range(300)]
    rows = [(i, w) for i, w in enumerate(words + words[:40])] + [(900, None), (901, "x\ny" * 9)]
    df = spark.createDataFrame(rows, "id long, text string")
    corpus = prepare_corpus(df, "id", "text", ~F.col("text").contains("\n"), n=200)
    sizes = {r["split"]: r["count"] for r in corpus.rows.groupBy("split").count().collect()}
    assert sizes == {"train": 180, "validation": 10, "holdout": 10}
    funnel = corpus.funnel.first()
    assert (funnel["raw_rows"], funnel["invalid"], funnel["duplicates_removed"]) == (341, 1, 340 - len(set(words)))
    made = generate_texts(corpus.rows, "text", n=100, order=2, max_length=40)
    metrics = made.metrics.first()
    assert metrics["n_generated"] == 100 and metrics["n_novel"] == made.novel.count() > 0
    losses = {r["split"]: r["mean_loss"] for r in made.losses.collect()}
    assert losses["train"] < losses["holdout"]


def test_measurements_to_model(spark):
    rng = random.Random(2)
    features, measured = [], []
    for k in range(120):
        a, b = rng.random() * 10, rng.random()
        features.append((f"k{k}", a, b, sorted({k // 4 * 3 + j for j in range(6)} | {200 + k})))
        for _ in range(rng.choice([1, 1, 2, 3])):
            measured.append((len(measured), f"k{k}", f"id{len(measured)}", "t", 2 * a + rng.random() * 0.1))
    measured.append((len(measured), "bad", "x", "t", 0.0))
    measured.append((len(measured), "bad", "y", "t", 9.0))
    result = build_property_model(
        spark.createDataFrame(measured, "row_id long, key string, id string, text string, label double"),
        spark.createDataFrame(features, "key string, desc_a double, desc_b double, bits array<int>"),
        "key", "label", "id", "text", "row_id", "bits", trees=10, max_depth=6,
    )
    assert result.curated.count() == 120
    summary = {r["split"]: r["n"] for r in result.split_summary.collect()}
    assert sum(summary.values()) == 120 and summary["train"] == 96
    metrics = result.test_metrics.first()
    assert metrics["r2"] > 0.7 and metrics["n"] == summary["test"]


def test_ranking(spark):
    rng = random.Random(3)
    rows = [(i, rng.random(), rng.random() * 5, rng.random() * 600, sorted(rng.sample(range(60), 6))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, score double, logs double, mw double, bits array<int>")
    screened = inside_range(rule_violations(df, {"mw": 500.0}), df.where("id < 150"), ["mw", "logs"])
    result = rank_candidates(
        screened, "id", ("score", "logs"), "score", "violations", "inside", "bits", n_diverse=10, max_similarity=0.3
    )
    ranked = result.ranked.orderBy("overall_rank").collect()
    assert [r.overall_rank for r in ranked] == list(range(1, len(ranked) + 1))
    fronts = [r.pareto_front for r in ranked]
    assert fronts == sorted(fronts, reverse=True) and all(r.score >= 0.5 for r in ranked)
    row = result.summary.first()
    assert row["n_input"] == 200 and row["n_after_filter"] == len(ranked)
    assert row["n_diverse_selected"] == result.diverse.count() <= 10
