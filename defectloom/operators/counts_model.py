"""A buggy / clean classifier in closed form, fitted by one aggregation.

The model is a table with one row per hashed token: in how many clean and buggy texts of the train
split it stands, and its weight, the log ratio of the two smoothed shares in steps of ``1 / UNIT``.
Weights are integers, so the sum over a text's distinct tokens is exact in any order. Both classes
count alike, however rare one of them is. Fitting shuffles one row per task and hashed token; the
table has ``n_features`` rows at any size of the data, and every task gets it as one list.

Null code has no tokens, like an empty text: margin 0, class 0 with a score of 0.5. Null labels
are not counted. Hashed tokens that no train text has weigh nothing.
"""

from pyspark.sql import Column, DataFrame, functions as F

from defectloom.functions.text import label_text
from defectloom.operators.tokens import tokenise

N_FEATURES = 1 << 14
UNIT = 1 << 20


def buckets(code, n: Column) -> Column:
    """The distinct hashed tokens of a text."""

    def bucket(token):
        return (F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("bigint") % n).cast("int")

    found = F.array_distinct(F.transform(F.array_distinct(tokenise(code)), bucket))
    return F.coalesce(found, F.array().cast("array<int>"))


def fit(train: DataFrame, n_features: int = N_FEATURES) -> DataFrame:
    """``bucket, n_clean, n_buggy, weight`` from ``code`` and ``is_buggy``."""
    sums = [
        F.count(F.when(F.col("is_buggy") == label, 1)).alias(name) for label, name in ((0, "n_clean"), (1, "n_buggy"))
    ]
    texts = train.agg(F.struct(*sums)).scalar()
    tokens = train.select("is_buggy", F.explode(buckets("code", F.lit(n_features))).alias("bucket"))
    seen = tokens.groupBy("bucket").agg(*sums)
    every = train.sparkSession.range(n_features).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(seen, "bucket", "left").select(
        "bucket", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_clean", "n_buggy")]
    )

    def share(name):
        return (F.col(name) + 1) / (texts[name] + 2)

    weight = F.round(UNIT * (F.log(share("n_buggy")) - F.log(share("n_clean")))).cast("bigint")
    unseen = F.col("n_clean") + F.col("n_buggy") == 0
    return counts.withColumn("weight", F.when(unseen, 0).otherwise(weight))


def predict(model: DataFrame, df: DataFrame) -> DataFrame:
    """``yhat``, ``score`` and ``label`` for each row of ``df``, whose columns stay."""
    listed = F.sort_array(F.collect_list(F.struct("bucket", "weight")))
    weights = model.agg(F.transform(listed, lambda e: e["weight"])).scalar()
    rows = df.withColumn("_weights", weights)
    found = buckets("code", F.size("_weights"))
    total = F.aggregate(found, F.lit(0).cast("bigint"), lambda s, b: s + F.get(F.col("_weights"), b))
    rows = rows.withColumn("_margin", total / UNIT)
    buggy = 1 / (1 + F.exp(-F.col("_margin")))
    return rows.select(
        *df.columns,
        (F.col("_margin") > 0).cast("int").alias("yhat"),
        F.greatest(buggy, 1 - buggy).alias("score"),
    ).withColumn("label", label_text("yhat"))


def describe(model: DataFrame) -> dict:
    """Name, task and sizes of a fitted model."""
    return {
        "model_name": "defectloom token counts",
        "task": "sequence-classification",
        "classes": 2,
        "features": model.count(),
    }
