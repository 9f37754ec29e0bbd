"""Training and scoring of event classifiers with Spark ML, one fold at a time."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators import metrics, sampling
from sluice.operators.metrics import corrected


def matrix(rows: DataFrame, label: str, negative_rate: float, keys=("station_code", "ts")) -> DataFrame:
    """All positives and a hashed share of the negatives; unknown labels drop."""
    known = rows.where(F.col(label).isNotNull()).withColumn("label", F.col(label).cast("double"))
    return sampling.thinned_negatives(known, F.col("label") == 1, keys, negative_rate)


def _flagged(rows: DataFrame, features: list[str]) -> DataFrame:
    """A missing value is information: a flag per feature beside the imputed value."""
    return rows.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in features} | {c: F.col(c).cast("double") for c in features})


def train_classifier(rows: DataFrame, features: list[str], iterations: int = 20, depth: int = 4, seed: int = 0) -> PipelineModel:
    filled = [f"{c}_filled" for c in features]
    stages = [
        Imputer(inputCols=features, outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled + [f"{c}_missing" for c in features], outputCol="features"),
        GBTClassifier(maxIter=iterations, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features"),
    ]
    return Pipeline(stages=stages).fit(_flagged(rows, features))


def score(model: PipelineModel, rows: DataFrame, features: list[str], negative_rate: float) -> DataFrame:
    """Probabilities for the full population, corrected for the thinning of the training negatives."""
    raw = model.transform(_flagged(rows, features)).withColumn("score", vector_to_array("probability")[1])
    return raw.withColumn("prob", corrected(F.col("score"), negative_rate)).drop("features", "rawPrediction", "probability", "prediction", *(f"{c}_{x}" for c in features for x in ("filled", "missing")))


def run_fold(train: DataFrame, val: DataFrame, test: DataFrame, features: list[str], label: str, negative_rate: float, **fit) -> tuple[PipelineModel, float, DataFrame]:
    """Train, choose the threshold on validation, freeze it, and report on the untouched test rows."""
    model = train_classifier(matrix(train, label, negative_rate), features, **fit)
    judged = lambda x: score(model, x.where(F.col(label).isNotNull()), features, negative_rate).withColumn("y", F.col(label).cast("int"))
    best = metrics.best_threshold(judged(val)).first()
    threshold = float(best["threshold"]) if best else 0.5
    tested = judged(test).withColumn("pred", (F.col("score") >= threshold).cast("int"))
    return model, threshold, metrics.binary_metrics(tested)


def isotonic(rows: DataFrame, y: str = "y", prob: str = "prob") -> DataFrame:
    """``calibrated`` beside ``prob``, by the monotone fit; values outside the fitted range are clipped."""
    data = rows.withColumns({"label": F.col(y).cast("double"), "feature": F.col(prob)})
    made = VectorAssembler(inputCols=["feature"], outputCol="features").transform(data)
    fit = IsotonicRegression(labelCol="label", featuresCol="features").fit(made)
    return fit.transform(made).withColumnRenamed("prediction", "calibrated").drop("label", "feature", "features")
