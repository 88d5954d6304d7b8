"""Trained models: anomaly forest, classifier, clustering, and where they are kept.

A stored model is a folder below a shared path: ``config`` (one JSON row
with the features and an anomaly forest), ``levels`` (the dictionary of categories)
and a classifier's ``forest``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehold.operators.density import DensityModel
from tracehold.operators.features import LEVEL_SCHEMA, FeatureModel, fit_features, level_table, text_of
from tracehold.operators.forest import SEED, IsolationForest, grow_forest
from tracehold.operators.quantiles import exact_quantile
from tracehold.operators.text_density import TextDensity, counted_terms
from tracehold.session import stage


@dataclass
class AnomalyModel:
    features: FeatureModel
    forest: IsolationForest
    config: dict

    def values(self, df: DataFrame) -> DataFrame:
        """Rows with their numbers, codes and term weights as the array ``_x``."""
        return self.features.coded(df, "_x")

    def transform(self, df: DataFrame) -> DataFrame:
        """Rows with ``anomaly_score`` and ``anomaly`` (-1 anomaly, 1 normal)."""
        scored = self.values(df).withColumn("anomaly_score", self.forest.score(df.sparkSession, F.col("_x")))
        flag = F.when(F.col("anomaly_score") < F.lit(self.forest.offset), -1).otherwise(1)
        return scored.withColumn("anomaly", flag).drop("_x")


def train_anomaly_model(
    df: DataFrame,
    row_id: str,
    numeric: list[str],
    categorical: list[str] | None = None,
    text: list[str] | None = None,
    contamination: float = 0.05,
    trained_at: str = "",
) -> AnomalyModel:
    """Fit features and forest; the cut is the contamination quantile of the training scores."""
    features = fit_features(df, numeric, categorical, text)
    model = AnomalyModel(
        features,
        IsolationForest([], pd.DataFrame(), 0),
        {
            "model_type": "isolation_forest",
            "numeric_fields": numeric,
            "categorical_fields": categorical or [],
            "text_fields": text or [],
            "contamination": contamination,
            "training_date": trained_at,
            "training_rows": df.count(),
        },
    )
    rows = stage(model.values(df).select(row_id, "_x"), "features")
    model.forest = grow_forest(rows, "_x", features.fields(), coded=features.code_places())
    scores = stage(rows.select(model.forest.score(df.sparkSession, F.col("_x")).alias("s")), "scores")
    model.forest.offset = exact_quantile(scores, "s", contamination)
    return model


def score_summary(scored: DataFrame) -> DataFrame:
    """Rows, anomalies and their percentage."""
    anomalies = F.count_if(F.col("anomaly") == -1)
    return scored.agg(
        F.count("*").alias("total_records"),
        anomalies.alias("anomaly_count"),
        (anomalies * 100.0 / F.count("*")).alias("anomaly_percentage"),
    )


@dataclass
class Classifier:
    features: FeatureModel
    model: RandomForestClassificationModel
    config: dict

    def transform(self, df: DataFrame, columns: bool = True) -> DataFrame:
        """Rows with ``predicted_class`` and one ``prob_<class>`` column per class.

        ``columns=False`` gives the array ``probabilities`` in the order of the classes
        instead, for labels with too many classes for columns.
        """
        classes = self.config["classes"]
        scored = self.model.transform(self.features.transform(df, "_features"))
        # One constant, not one expression a class.
        names = F.from_json(F.lit(json.dumps(classes)), "array<string>")
        probability = vector_to_array("probability")
        each = [probability[i].alias(f"prob_{c}") for i, c in enumerate(classes)] if columns else [probability.alias("probabilities")]
        return scored.select(*df.columns, F.get(names, F.col("prediction").cast("int")).alias("predicted_class"), *each)

    def importances(self) -> dict[str, float]:
        """Importance of the features that any tree cuts."""
        found = self.model.featureImportances.toArray()
        places = [int(i) for i in found.nonzero()[0]]
        names = self.features.names(SparkSession.active(), places)
        return {names[i]: float(found[i]) for i in places}


def train_classifier(
    df: DataFrame,
    label: str,
    numeric: list[str] | None = None,
    categorical: list[str] | None = None,
    text: list[str] | None = None,
    trees: int = 100,
    trained_at: str = "",
    level_share: float = 1e-4,
) -> Classifier:
    """Random forest over the features; rows without a label are left out.

    Any number of levels and classes: both are coded by joins with their
    dictionaries.  The learner holds a number per row and column, so levels held by
    less than ``level_share`` of the rows share one column (0: every level has its
    own); below ``1 / level_share`` rows none does.
    """
    labelled = df.where(F.col(label).isNotNull())
    features = fit_features(labelled, numeric, categorical, text, level_share)
    dictionary = df.sparkSession.read.schema(LEVEL_SCHEMA).parquet(level_table(labelled, [label]))
    # One name per class, as many as the leaves of the model hold numbers for.
    counts = dictionary.orderBy("code").select("level", "n").toPandas()
    coded = dictionary.select(F.col("level").alias("_name"), F.col("code").cast("double").alias("_label"))
    named = features.transform(labelled.withColumn("_name", F.col(label).cast("string")), "_features")
    rows = named.select("_features", "_name").join(coded, "_name").select("_features", "_label")
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="_label", numTrees=trees, seed=SEED, maxMemoryInMB=512
    )
    config = {
        "model_type": "random_forest",
        "label_field": label,
        "classes": list(counts["level"]),
        "class_distribution": {c: int(n) for c, n in zip(counts["level"], counts["n"])},
        "training_rows": int(counts["n"].sum()),
        "training_date": trained_at,
    }
    # Without the stated number of classes the learner stops at a hundred.
    nominal = {"ml_attr": {"type": "nominal", "num_vals": max(len(counts), 2)}}
    training = stage(rows, "training").select("_features", F.col("_label").alias("_label", metadata=nominal))
    return Classifier(features, forest.fit(training), config)


def cluster_events(
    df: DataFrame,
    row_id: str,
    numeric: list[str] | None = None,
    categorical: list[str] | None = None,
    text: list[str] | None = None,
    eps: float = 0.5,
    min_samples: int = 5,
) -> DataFrame:
    """Rows with their ``cluster`` (-1 for outliers) over standardized, one-hot and TF-IDF features.

    Without text fields the grid of :class:`DensityModel` is used, with them the
    inverted index of :class:`TextDensity`; both give the clusters of plain DBSCAN.
    """
    if text:
        return text_density(df, row_id, numeric, categorical, text, eps, min_samples).clusters()
    numeric, categorical = list(numeric or []), list(categorical or [])
    features = fit_features(df, numeric=numeric)
    xs = [c.alias(f"x{i}") for i, c in enumerate(features.columns())]
    cats = [F.array(*[level_or_none(df, name) for name in categorical]).alias("cats")] if categorical else []
    points = stage(df.select(row_id, *xs, *cats), "points")
    return DensityModel(points, row_id, len(numeric), eps, min_samples, bool(categorical)).clusters()


def level_or_none(df: DataFrame, name: str) -> Column:
    """A row's level; the dropped first level is all zeros, like a missing value."""
    value = F.col(name).cast("string")
    first = df.agg(F.min(value).alias("v")).scalar()
    return F.when(value.isNull() | (value == first), "").otherwise(value)


def text_density(
    df: DataFrame,
    row_id: str,
    numeric: list[str] | None,
    categorical: list[str] | None,
    text: list[str],
    eps: float = 0.5,
    min_samples: int = 5,
) -> TextDensity:
    """The clustering run behind :func:`cluster_events` with text fields; null texts have no terms."""
    numbers = fit_features(df, numeric=numeric).columns() if numeric else []
    terms = fit_features(df, text=text).terms
    rows = df.select(
        row_id,
        F.array(*numbers).cast("array<double>").alias("xs"),
        F.array(*[level_or_none(df, name) for name in categorical or []]).cast("array<string>").alias("cats"),
        F.lower(text_of(text)).alias("_text"),
    )
    points = stage(counted_terms(rows, list(terms)), "points")
    return TextDensity(points, row_id, eps, min_samples, list(terms.values()))


def cluster_stats(df: DataFrame, clusters: DataFrame, row_id: str, numeric: list[str]) -> DataFrame:
    """Size, share and numeric statistics per cluster; cluster -1 holds the outliers.

    Both sides have a row for every row of the table, so neither is broadcast, however small its files.
    """
    rows = df.join(clusters.hint("merge"), row_id)
    total = clusters.agg(F.count("*").alias("n")).scalar()
    stats = [
        a
        for f in numeric
        for a in (
            F.avg(f).alias(f"{f}_mean"),
            F.stddev_samp(f).alias(f"{f}_std"),
            F.min(f).alias(f"{f}_min"),
            F.max(f).alias(f"{f}_max"),
        )
    ]
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("size"), *stats)
    return sizes.withColumn("percentage", F.col("size") * 100.0 / total)


def cluster_categories(df: DataFrame, clusters: DataFrame, row_id: str, field: str) -> DataFrame:
    """Value counts of a categorical field per cluster."""
    return df.join(clusters.hint("merge"), row_id).groupBy("cluster", F.col(field).alias("value")).agg(F.count("*").alias("n"))


def save_model(spark: SparkSession, model: AnomalyModel | Classifier, path: str, name: str) -> None:
    """Write a model's folder below ``path``, replacing one of the same name."""
    config = json.dumps({"name": name, **model.config})
    features = model.features
    if features.levels:
        # Staged first: the model may have been loaded from this very folder.
        levels = stage(spark.read.schema(LEVEL_SCHEMA).parquet(features.levels), "levels")
        levels.write.mode("overwrite").parquet(f"{path}/levels/{name}")
        features = replace(features, levels=f"{path}/levels/{name}")
    body = [(name, config, features.to_json(), model.forest.to_json() if isinstance(model, AnomalyModel) else "")]
    table = spark.createDataFrame(body, "name string, config string, features string, forest string")
    table.coalesce(1).write.mode("overwrite").json(f"{path}/config/name={name}")
    if isinstance(model, Classifier):
        model.model.write().overwrite().save(f"{path}/forest/{name}")


def _configs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, config string, features string, forest string").json(f"{path}/config")


def load_model(spark: SparkSession, path: str, name: str) -> AnomalyModel | Classifier:
    row = _configs(spark, path).where(F.col("name") == name).first()
    if row is None:
        raise FileNotFoundError(f"no model {name!r} below {path}")
    config, features = json.loads(row["config"]), FeatureModel.from_json(row["features"])
    if features.levels:
        features.levels = f"{path}/levels/{name}"
    if config["model_type"] == "isolation_forest":
        return AnomalyModel(features, IsolationForest.from_json(row["forest"]), config)
    return Classifier(features, RandomForestClassificationModel.load(f"{path}/forest/{name}"), config)


def list_models(spark: SparkSession, path: str) -> DataFrame:
    """Name, type and training date of the stored models."""
    config = F.col("config")
    return _configs(spark, path).select(
        "name",
        F.coalesce(F.get_json_object(config, "$.model_type"), F.lit("unknown")).alias("type"),
        F.coalesce(F.get_json_object(config, "$.training_date"), F.lit("unknown")).alias("training_date"),
        F.get_json_object(config, "$.training_rows").cast("long").alias("training_rows"),
    )
