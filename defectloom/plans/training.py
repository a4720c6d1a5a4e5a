"""Enlarge, train, evaluate."""

from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from defectloom.operators import counts_model
from defectloom.operators.augment import augment
from defectloom.operators.metrics import attach_predictions, evaluation_report
from defectloom.operators.model import describe, fit, predict, save
from defectloom.operators.tokens import encode, vocabulary
from defectloom.operators.variants import generate_variants, merge, shuffle_rows
from defectloom.sources.reports import model_card, save_text
from defectloom.workspace import work_dir


@dataclass(frozen=True)
class TrainSettings:
    """Settings of one training run; the values are the defaults of the job."""

    seed: int = 42
    n_variants: int = 3
    max_length: int = 512
    vocab_size: int | None = None
    n_features: int = 1 << 14
    iterations: int = 20
    # "logistic" or "counts", the closed form of ``counts_model``.
    classifier: str = "logistic"


def of_split(rows: DataFrame, split: str) -> DataFrame:
    return rows.where(F.col("split") == split).drop("split")


def enlarged_train(
    rows: DataFrame, settings: TrainSettings, path: str, mutator: str = "patterns"
) -> DataFrame:
    """The train split with its synthetic defects, in a seeded random order.

    The merged table is written to ``path`` first: mutants are made once, and the order is
    found from the ids alone.
    """
    train = of_split(rows, "train")
    synthetic = generate_variants(train, settings.n_variants, settings.seed, mutator)
    merge(train, synthetic).write.mode("overwrite").parquet(path)
    return shuffle_rows(rows.sparkSession.read.parquet(path), settings.seed)


def encoded_rows(rows: DataFrame, settings: TrainSettings) -> DataFrame:
    """Model inputs of the train split: augmented, cut into tokens, as windows of ids with label."""
    train = of_split(rows, "train")
    path = f"{work_dir(rows.sparkSession)}/vocabulary"
    vocabulary(train, "code", settings.vocab_size).write.parquet(path)
    vocab = rows.sparkSession.read.parquet(path)
    augmented = train.select("id", "is_buggy", augment(F.col("code"), settings.seed).alias("code"))
    encoded = encode(augmented, vocab, "code", settings.max_length)
    return encoded.withColumnRenamed("is_buggy", "labels")


def train(rows: DataFrame, settings: TrainSettings) -> PipelineModel | DataFrame:
    """Fit on the train split as it is."""
    return fit_rows(of_split(rows, "train"), settings)


def fit_rows(rows: DataFrame, settings: TrainSettings) -> PipelineModel | DataFrame:
    if settings.classifier == "logistic":
        return fit(rows, n_features=settings.n_features, iterations=settings.iterations)
    # Written, so that it is fitted once however often it is used.
    path = f"{work_dir(rows.sparkSession)}/counts"
    counts_model.fit(rows, settings.n_features).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def score_table(model: PipelineModel | DataFrame, rows: DataFrame) -> DataFrame:
    """Predictions for the test split and the held-out rows, keyed by ``id``."""
    chosen = rows.where(F.col("split").isin("test", "eval")).select("id", "code")
    by = counts_model.predict if isinstance(model, DataFrame) else predict
    return by(model, chosen).drop("code")


def evaluate(model: PipelineModel | DataFrame, rows: DataFrame) -> DataFrame:
    facts = rows.select("id", "split", "project", "is_buggy")
    return evaluation_report(attach_predictions(facts, score_table(model, rows)))


def run(rows: DataFrame, settings: TrainSettings, out: str) -> DataFrame:
    """Enlarge, train, evaluate; writes training table, model, report and card below ``out``.

    ``rows`` is the written split table. Returns the written evaluation report.
    """
    spark = rows.sparkSession
    model = fit_rows(enlarged_train(rows, settings, f"{out}/train"), settings)
    counted = isinstance(model, DataFrame)
    if counted:
        model.write.mode("overwrite").parquet(f"{out}/model")
    else:
        save(model, f"{out}/model")
    evaluate(model, rows).write.mode("overwrite").json(f"{out}/evaluation")
    report = spark.read.json(f"{out}/evaluation")
    test = report.where("section = 'test'").drop("section", "name")
    about = counts_model.describe(model) if counted else describe(model)
    card = model_card(test, about, asdict(settings), datetime.now().isoformat())
    save_text(card, f"{out}/model_card")
    return report
