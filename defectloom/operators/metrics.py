"""Classification metrics.

All of them start from the counts per (group, truth, prediction): one shuffle of a few rows
per group and map task, so a project that holds most of the table costs no more than others.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from defectloom.functions.text import safe_ratio
from defectloom.operators.positions import with_position


def confusion(preds: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rows per truth and prediction, with the summed confidence."""
    return preds.groupBy(*by, "is_buggy", "yhat").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("score").alias("score_sum"),
        F.count("score").alias("score_n"),
    )


def label_metrics(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 per label found in truth or prediction.

    The summed confidence goes with the true label, so that it counts once.
    """
    n, none = F.col("n"), F.lit(0).cast("long")
    hit = F.col("is_buggy") == F.col("yhat")
    as_truth = F.struct(
        F.col("is_buggy").alias("label"),
        F.when(hit, n).otherwise(none).alias("tp"),
        none.alias("fp"),
        F.when(hit, none).otherwise(n).alias("fn"),
        F.col("score_sum"),
        F.col("score_n"),
    )
    as_guess = F.struct(
        F.col("yhat").alias("label"),
        none.alias("tp"),
        F.when(hit, none).otherwise(n).alias("fp"),
        none.alias("fn"),
        F.lit(None).cast("double").alias("score_sum"),
        none.alias("score_n"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        counts.select(*by, F.inline(F.array(as_truth, as_guess)))
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "score_sum", "score_n")])
        .withColumns(
            {
                "precision": safe_ratio(tp, tp + fp),
                "recall": safe_ratio(tp, tp + fn),
                "f1": safe_ratio(2 * tp, 2 * tp + fp + fn),
            }
        )
    )


def class_metrics(counts: DataFrame) -> DataFrame:
    """One row with precision, recall and F1 of both classes; 0 for an absent class."""
    per_label = label_metrics(counts)
    return per_label.agg(
        *[
            F.coalesce(F.max(F.when(F.col("label") == label, F.col(metric))), F.lit(0.0)).alias(
                f"{metric}_{name}"
            )
            for label, name in ((0, "clean"), (1, "buggy"))
            for metric in ("precision", "recall", "f1")
        ]
    )


def summary_metrics(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Accuracy, macro scores, mean confidence and class counts per group.

    The macro mean runs over the labels present in truth or prediction of the group.
    """
    truth = F.col("tp") + F.col("fn")
    return label_metrics(counts, by).groupBy(*by).agg(
        F.sum(truth).alias("samples"),
        safe_ratio(F.sum("tp"), F.sum(truth)).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        F.try_divide(F.sum("score_sum"), F.sum("score_n")).alias("avg_confidence"),
        F.coalesce(F.sum(F.when(F.col("label") == 1, truth)), F.lit(0)).alias("buggy_samples"),
        F.coalesce(F.sum(F.when(F.col("label") == 0, truth)), F.lit(0)).alias("clean_samples"),
    )


def split_and_overall_metrics(preds: DataFrame) -> DataFrame:
    """Metrics per split plus one row over all splits, from one scan of the predictions."""
    scope = F.explode(F.array(F.col("split"), F.lit("all"))).alias("scope")
    counts = confusion(preds, ["split"]).select(
        scope, "is_buggy", "yhat", "n", "score_sum", "score_n"
    )
    return summary_metrics(counts, ["scope"])


def project_ranking(project_metrics: DataFrame) -> DataFrame:
    """Projects by macro F1, best first, ties in name order."""
    keyed = project_metrics.withColumn("neg_f1", -F.col("f1_macro"))
    return with_position(keyed, ["neg_f1", "project"]).select(
        (F.col("pos") + 1).alias("place"), "project", "f1_macro", "samples"
    )


def class_weights(df: DataFrame) -> DataFrame:
    """n / (classes * n of the class), by label; the totals come from the few label rows."""
    counts = df.groupBy(F.col("is_buggy").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    totals = W.partitionBy()
    return counts.select(
        "label",
        "n",
        (F.sum("n").over(totals) / (F.count(F.lit(1)).over(totals) * F.col("n"))).alias("weight"),
    )


def attach_predictions(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions joined to their samples by ``id``."""
    return samples.join(predictions, "id")


def evaluation_report(preds: DataFrame, test_split: str = "test", held_out: str = "eval") -> DataFrame:
    """Test, per-project and held-out metrics in one table: a row per scope."""
    counts = confusion(preds.where(F.col("split").isin(test_split, held_out)), ["split", "project"])
    scopes = F.when(
        F.col("split") == test_split,
        F.array(
            F.struct(F.lit("test").alias("section"), F.lit("").alias("name")),
            F.struct(F.lit("project").alias("section"), F.col("project").alias("name")),
        ),
    ).otherwise(F.array(F.struct(F.lit("held_out").alias("section"), F.lit("").alias("name"))))
    rows = counts.select(F.inline(scopes), "is_buggy", "yhat", "n", "score_sum", "score_n")
    return summary_metrics(rows, ["section", "name"])
