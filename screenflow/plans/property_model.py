"""From repeated measurements to a tested property model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenflow.operators import clustering, duplicates, models, splits
from screenflow.operators.quality import expect
from screenflow.session import materialize


@dataclass
class PropertyModel:
    curated: DataFrame
    manifest: DataFrame
    split_summary: DataFrame
    comparison: DataFrame
    model: RandomForestRegressionModel
    test_predictions: DataFrame
    test_metrics: DataFrame


def build_property_model(
    measurements: DataFrame,
    features: DataFrame,
    key: str,
    label: str,
    id: str,
    text: str,
    row_id: str,
    bits: str,
    max_range: float = 0.30,
    max_distance: float = 0.60,
    feature_sets: tuple[str, ...] = ("descriptors",),
    **forest,
) -> PropertyModel:
    """Curate duplicates, cluster by fingerprint, split whole clusters, compare, fit, test.

    `features` has one row per key, with descriptor columns (`desc_...`) and the fingerprint
    `bits`. The final model learns from training and validation rows and is tested once.
    """
    curated = duplicates.curate_duplicates(measurements, [key], label, id, text, row_id, max_range)
    curated = materialize(expect(curated, never={"no label": F.col(label).isNull()}, unique=[key]))
    rows = materialize(models.join_one_to_one(curated, features, [key], rows=curated.count()))
    clusters = materialize(clustering.cluster_fingerprints(rows, key, bits, max_distance))
    assignment = splits.group_split(clusters, "cluster_id", tie="cluster_id")
    manifest = materialize(splits.assign_split(clusters, "cluster_id", assignment, [key]))
    manifest = splits.leakage_check(manifest, "cluster_id")
    data = models.join_one_to_one(rows, manifest, [key], rows=rows.count())
    vectors = {}
    for name in feature_sets:
        data = models.assemble_features(data, [], [key], models.feature_columns(data, name), f"vector_{name}")
        vectors[name] = f"vector_{name}"
    data = materialize(data)
    train, validation = duplicates.in_splits(data, ["train"]), duplicates.in_splits(data, ["validation"])
    comparison = models.compare_representations(train, validation, label, vectors, **forest)
    best = vectors[comparison.first()["representation"]]
    development = duplicates.in_splits(data, ["train", "validation"])
    model = models.fit_forest(development, label, best, **forest)
    test = model.transform(duplicates.in_splits(data, ["test"]))
    return PropertyModel(
        curated,
        manifest,
        splits.split_summary(data, "split", "cluster_id", label),
        comparison,
        model,
        models.prediction_table(test, [key], label, "prediction"),
        models.regression_metrics(test, label, "prediction"),
    )
