"""Checks of the input folders before a scan."""

from pyspark.sql import SparkSession


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on whatever file system its scheme names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def require_dirs(spark: SparkSession, root: str, names: list[str]) -> None:
    missing = [name for name in names if not path_exists(spark, f"{root}/{name}")]
    if missing:
        raise FileNotFoundError(f"missing below {root}: {', '.join(missing)}")
