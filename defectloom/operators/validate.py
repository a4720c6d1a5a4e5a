"""Checks on the sample table. Each returns the findings as rows."""

from pyspark.sql import DataFrame, functions as F

from defectloom.schema import MAX_CHARS, SAMPLE


def schema_report(df: DataFrame) -> DataFrame:
    """Expected and actual type of every required column, with its number of nulls."""
    actual = {field.name: field.dataType.simpleString() for field in df.schema}
    present = [f.name for f in SAMPLE if f.name in actual]
    counts = df.agg(
        *[F.count_if(F.col(name).isNull()).alias(name) for name in present],
        F.count(F.lit(1)).alias("_rows"),
    )
    entries = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("expected"),
            F.lit(actual.get(f.name)).alias("actual"),
            F.lit(actual.get(f.name) == f.dataType.simpleString()).alias("ok"),
            (F.col(f.name) if f.name in actual else F.col("_rows")).alias("nulls"),
        )
        for f in SAMPLE
    ]
    return counts.select(F.inline(F.array(*entries)))


def domain_violations(df: DataFrame, sources: list[str]) -> DataFrame:
    """Rows with a label other than 0 / 1 or a source that is not allowed."""
    label, source = F.col("is_buggy"), F.col("source")
    checks = F.array(
        F.when(
            label.isNull() | ~label.isin(0, 1),
            F.struct(F.lit("is_buggy").alias("column"), label.cast("string").alias("value")),
        ),
        F.when(
            source.isNull() | ~source.isin(*sources),
            F.struct(F.lit("source").alias("column"), source.alias("value")),
        ),
    )
    found = F.explode(F.filter(checks, lambda c: c.isNotNull()))
    return df.select("id", found.alias("v")).select("id", "v.column", "v.value")


def length_report(df: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    too_long = F.length("code") > max_chars
    return df.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(too_long).alias("too_long"),
        F.max(F.length("code")).alias("longest"),
    )


def prediction_violations(preds: DataFrame) -> DataFrame:
    """Predictions with a score outside [0, 1] or a label other than buggy / clean."""
    bad = ~F.col("score").between(0, 1) | ~F.col("label").isin("buggy", "clean")
    return preds.where(F.coalesce(bad, F.lit(True)))


def leakage_report(df: DataFrame) -> DataFrame:
    """Number of projects and of projects found in more than one split."""
    per_project = df.groupBy("project").agg(F.countDistinct("split").alias("n_splits"))
    return per_project.agg(
        F.count(F.lit(1)).alias("projects"),
        F.count_if(F.col("n_splits") > 1).alias("leaking"),
    )
