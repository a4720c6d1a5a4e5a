"""The sample table on disk."""

from pyspark.sql import DataFrame, SparkSession

from defectloom.schema import SAMPLE
from defectloom.sources.layout import path_exists


def load_samples(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``, or an empty one of the same type when nothing is there."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], SAMPLE)
    return spark.read.schema(SAMPLE).parquet(path)


def save_samples(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_splits(df: DataFrame, path: str) -> None:
    """One folder per split, so that reading one split skips the others."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(f"split = '{split}'").drop("split")
