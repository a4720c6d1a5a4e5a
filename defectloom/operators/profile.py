"""Counts, ratios and length profiles of labelled tables."""

from pyspark.sql import DataFrame, functions as F

from defectloom.functions.text import balance_band, length_band, safe_ratio
from defectloom.schema import SPLITS


def _label_counts():
    return (
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col("is_buggy") == 1).alias("buggy"),
        F.count_if(F.col("is_buggy") == 0).alias("clean"),
    )


def split_statistics(df: DataFrame) -> DataFrame:
    """Samples, labels, projects and mean code length per split."""
    return (
        df.groupBy("split")
        .agg(
            *_label_counts(),
            F.countDistinct("project").alias("projects"),
            F.avg(F.length("code")).alias("avg_length"),
        )
        .withColumn("buggy_ratio", safe_ratio(F.col("buggy"), F.col("samples")))
    )


def with_all_splits(stats: DataFrame) -> DataFrame:
    """A row for every split: zero counts and no mean for one without rows."""
    names = stats.sparkSession.createDataFrame([(name,) for name in SPLITS], "split string")
    counts = ["samples", "buggy", "clean", "projects", "buggy_ratio"]
    return names.join(stats, "split", "left").fillna(0, counts)


def length_profile(df: DataFrame) -> DataFrame:
    """Mean, interpolated median, shortest and longest code per split.

    The table is reduced to a histogram of lengths first, so the median holds one entry per
    distinct length and a split of any size is spread over all tasks.
    """
    histogram = df.groupBy("split", F.length("code").alias("length")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_buggy") == 1).alias("n_buggy")
    )
    return histogram.groupBy("split").agg(
        F.sum("n").alias("samples"),
        (F.sum(F.col("length") * F.col("n")) / F.sum("n")).alias("avg_length"),
        F.percentile("length", 0.5, F.col("n")).alias("median_length"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        safe_ratio(F.sum("n_buggy"), F.sum("n")).alias("buggy_ratio"),
    )


def wide_statistics(df: DataFrame) -> DataFrame:
    """Statistics and length profile per split in one row, from one histogram of the table."""
    n = F.col("n")
    histogram = df.groupBy("split", "project", "is_buggy", F.length("code").alias("length")).agg(
        F.count(F.lit(1)).alias("n")
    )
    buggy = F.sum(F.when(F.col("is_buggy") == 1, n).otherwise(0))
    return histogram.groupBy("split").agg(
        F.sum(n).alias("samples"),
        buggy.alias("buggy"),
        F.sum(F.when(F.col("is_buggy") == 0, n).otherwise(0)).alias("clean"),
        F.countDistinct("project").alias("projects"),
        (F.sum(F.col("length") * n) / F.sum(n)).alias("avg_length"),
        safe_ratio(buggy, F.sum(n)).alias("buggy_ratio"),
        F.percentile("length", 0.5, n).alias("median_length"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
    )


def length_bands(stats: DataFrame) -> DataFrame:
    return stats.select("split", length_band(F.col("avg_length")).alias("band"))


def balance_bands(stats: DataFrame) -> DataFrame:
    return stats.select("split", balance_band(F.col("buggy_ratio")).alias("band"))


def overall_totals(stats: DataFrame) -> DataFrame:
    """Sums over the splits used for training; the held-out set stays out."""
    return (
        stats.where(F.col("split") != "eval")
        .agg(*[F.sum(name).alias(name) for name in ("samples", "buggy", "clean")])
        .withColumn("buggy_ratio", safe_ratio(F.col("buggy"), F.col("samples")))
    )


def extraction_summary(df: DataFrame) -> DataFrame:
    samples, buggy, clean = _label_counts()
    defect_file = F.when(F.col("is_buggy") == 1, F.col("path"))
    return df.agg(
        samples,
        buggy,
        clean,
        F.countDistinct("project").alias("projects"),
        F.countDistinct(defect_file).alias("defect_files"),
    ).withColumn("pairs", F.expr("samples div 2"))


def project_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("project").agg(F.count(F.lit(1)).alias("samples"))


def variant_summary(clean: DataFrame, variants: DataFrame) -> DataFrame:
    """Clean rows in, variants out, variants per clean row."""
    both = clean.select(F.lit(1).alias("is_clean")).unionAll(
        variants.select(F.lit(0).alias("is_clean"))
    )
    return both.agg(
        F.count_if(F.col("is_clean") == 1).alias("clean_samples"),
        F.count_if(F.col("is_clean") == 0).alias("variants"),
    ).withColumn("per_sample", safe_ratio(F.col("variants"), F.col("clean_samples")))


def merge_summary(merged: DataFrame) -> DataFrame:
    """Sizes and label balance after a merge; ``merged`` carries an ``origin`` column."""
    samples, buggy, clean = _label_counts()
    return merged.agg(
        F.count_if(F.col("origin") == "train").alias("original"),
        F.count_if(F.col("origin") == "synthetic").alias("synthetic"),
        samples,
        buggy,
        clean,
    ).withColumn("buggy_percent", safe_ratio(F.col("buggy") * 100, F.col("samples")))
