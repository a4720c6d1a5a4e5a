"""Verification logs: one line per checked bug."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from defectloom.functions.text import trim_both


# Fixed value: the log of a project lies in its folder and carries its name.
LOG_PATH = r"/projects/([^/]+)/\1-pass\.txt\z"


def scan_verify_logs(spark: SparkSession, root: str) -> DataFrame:
    """``project, line`` of all project logs."""
    project = F.regexp_extract("_metadata.file_path", LOG_PATH, 1).alias("project")
    logs = spark.read.text(f"{root}/projects/*", pathGlobFilter="*-pass.txt")
    return logs.select(project, F.col("value").alias("line")).where("project != ''")


def verified_ids(lines: DataFrame) -> DataFrame:
    """Distinct ``project, bug`` of the lines that are not empty and do not start ``PASS:``.

    The bug is the text before ``(``, after the last ``/`` and before the first blank.
    """
    line = trim_both("line", r" \t")
    name = F.substring_index(F.substring_index(line, "(", 1), "/", -1)
    return (
        lines.where((line != "") & ~F.startswith(line, F.lit("PASS:")))
        .select("project", F.substring_index(name, " ", 1).alias("bug"))
        .where("bug != ''")
        .distinct()
    )
