"""A buggy / clean classifier as a Spark ML pipeline, and what is done with its scores."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from defectloom.functions.bind import bind
from defectloom.functions.scores import add_log_weights, argmax, softmax
from defectloom.functions.text import label_text
from defectloom.operators.metrics import class_weights
from defectloom.operators.tokens import TOKEN

N_FEATURES = 1 << 14
ITERATIONS = 20


def pipeline(n_features: int = N_FEATURES, iterations: int = ITERATIONS) -> Pipeline:
    return Pipeline(
        stages=[
            RegexTokenizer(
                inputCol="code", outputCol="tokens", pattern=TOKEN, gaps=False, toLowercase=False
            ),
            HashingTF(inputCol="tokens", outputCol="tf", numFeatures=n_features),
            IDF(inputCol="tf", outputCol="features"),
            LogisticRegression(
                featuresCol="features",
                labelCol="is_buggy",
                weightCol="weight",
                probabilityCol="probability",
                maxIter=iterations,
                regParam=0.01,
            ),
        ]
    )


def with_class_weights(train: DataFrame) -> DataFrame:
    """Balanced weights, so the rarer class counts as much as the other one."""
    by_label = class_weights(train).agg(
        F.map_from_entries(F.collect_list(F.struct("label", "weight")))
    ).scalar()
    return train.withColumn("weight", F.element_at(by_label, F.col("is_buggy")))


def fit(train: DataFrame, **params) -> PipelineModel:
    return pipeline(**params).fit(with_class_weights(train).select("code", "is_buggy", "weight"))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``yhat``, ``score`` and ``label`` for each row of ``df``, whose columns stay."""
    scored = model.transform(df).withColumn("_p", vector_to_array("probability"))
    return scored.select(
        *df.columns,
        argmax(F.col("_p")).alias("yhat"),
        F.array_max("_p").alias("score"),
    ).withColumn("label", label_text("yhat"))


def score_logits(logits, class_prior=None) -> Column:
    """Struct of probabilities, class, confidence and label text; optional class weights."""
    shifted = logits if class_prior is None else add_log_weights(logits, class_prior)

    def outcome(p):
        yhat = argmax(p)
        return F.struct(
            p.alias("probabilities"),
            yhat.alias("yhat"),
            F.array_max(p).alias("score"),
            label_text(yhat).alias("label"),
        )

    return bind(softmax(shifted), outcome)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def describe(model: PipelineModel) -> dict:
    """Name, task and sizes of a fitted model."""
    classifier = model.stages[-1]
    return {
        "model_name": "defectloom classifier",
        "task": "sequence-classification",
        "classes": classifier.numClasses,
        "features": classifier.numFeatures,
    }
