"""Classifiers on feature vectors: scaling, fitting, cross-validation, prediction."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {
    "logistic": lambda: LogisticRegression(maxIter=50, featuresCol="scaled"),
    "forest": lambda: RandomForestClassifier(numTrees=100, maxDepth=8, seed=42, featuresCol="scaled"),
    "boosted": lambda: GBTClassifier(maxIter=40, maxDepth=4, seed=42, featuresCol="scaled"),
    "svm": lambda: LinearSVC(maxIter=50, featuresCol="scaled"),
}
GRIDS = {"logistic": {"regParam": [0.0, 0.01, 0.1]}, "forest": {"maxDepth": [5, 8]}, "boosted": {"maxDepth": [3, 5]}, "svm": {"regParam": [0.0, 0.01, 0.1]}}


def pipeline(names: list[str], kind: str = "logistic") -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="raw_features"), StandardScaler(inputCol="raw_features", outputCol="scaled", withMean=True, withStd=True), KINDS[kind]()])


def fit(features: DataFrame, names: list[str], kind: str = "logistic") -> PipelineModel:
    """``features`` has a 0/1 ``label`` beside the named columns."""
    return pipeline(names, kind).fit(features)


def tune(features: DataFrame, names: list[str], kind: str = "logistic", folds: int = 5, parallelism: int = 2) -> CrossValidatorModel:
    """The best of a small grid by cross-validated area under the curve."""
    p = pipeline(names, kind)
    grid = ParamGridBuilder()
    for param, values in GRIDS[kind].items():
        grid = grid.addGrid(p.getStages()[-1].getParam(param), values)
    return CrossValidator(estimator=p, estimatorParamMaps=grid.build(), evaluator=BinaryClassificationEvaluator(), numFolds=folds, parallelism=parallelism, seed=42).fit(features)


def predict(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Adds ``p`` (of label 1), ``said`` and ``certainty``."""
    out = model.transform(features)
    p = vector_to_array("probability")[1] if "probability" in out.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    out = out.withColumn("p", p)
    return out.drop("raw_features", "scaled", "rawPrediction", "probability", "prediction").withColumns({"said": (F.col("p") >= 0.5).cast("int"), "certainty": F.abs(F.col("p") - 0.5) * 2})
