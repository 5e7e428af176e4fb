"""Hazard severity by a decision tree over four features."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import CountVectorizer, IDF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.text import content_terms

CLASSES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
FEATURES = ["nfpa_health", "nfpa_flammability", "nfpa_instability", "ghs_count"]

# Baseline rows, features then label.
BASELINE = [
    (0, 0, 0, 0, 0),
    (1, 1, 0, 1, 0),
    (2, 2, 0, 2, 1),
    (2, 3, 1, 3, 1),
    (3, 3, 1, 4, 2),
    (3, 4, 2, 5, 2),
    (4, 4, 3, 7, 3),
    (4, 2, 4, 8, 3),
]


def baseline(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BASELINE, ", ".join(f"{c} int" for c in [*FEATURES, "label"]))


def fit(rows: DataFrame, seed: int = 42):
    """Tree over rows with ``FEATURES`` and label, classes weighted to balance."""
    n, k = F.lit(float(rows.count())), float(rows.select("label").distinct().count())
    sizes = rows.groupBy("label").agg(F.count("*").alias("_n"))
    weighted = rows.join(F.broadcast(sizes), "label").withColumn("weight", n / (F.lit(k) * F.col("_n")))  # one row a class
    tree = DecisionTreeClassifier(featuresCol="features", labelCol="label", weightCol="weight", seed=seed, maxDepth=10, minInstancesPerNode=1)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), tree]).fit(weighted)


def predict(model, rows: DataFrame) -> DataFrame:
    """Rows with severity and confidence, the predicted class's probability."""
    out = model.transform(rows)
    names = F.array(*[F.lit(c) for c in CLASSES])
    at = F.col("prediction").cast("int")
    return out.select(*rows.columns, F.get(names, at).alias("severity"), F.get(vector_to_array("probability"), at).alias("confidence"))


def fit_text(rows: DataFrame, *, vocabulary: int = 1 << 18, seed: int = 42):
    """Severity from TF-IDF features of rows (text, label): terms, weights, tree."""
    terms = rows.withColumn("terms", content_terms(F.col("text")))
    return Pipeline(stages=[
        CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=vocabulary), IDF(inputCol="tf", outputCol="features"),
        DecisionTreeClassifier(featuresCol="features", labelCol="label", seed=seed)]).fit(terms)
