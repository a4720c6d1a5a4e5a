"""Tables that a job writes to the shared folder and reads back, and the code that tasks import.

Writing cuts the lineage: a lost executor costs the tasks of one step, not the steps before it.
"""

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StructType

import defectloom
from defectloom.workspace import work_dir


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that tasks can import it."""
    context = spark.sparkContext
    folder = os.path.dirname(os.path.abspath(defectloom.__file__))
    if getattr(context, "_defectloom_sent", False) or not os.path.isdir(folder):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="defectloom-"), "defectloom_package.zip")
    with zipfile.ZipFile(path, "w") as package:
        for base, _, names in os.walk(folder):
            for name in names:
                if name.endswith(".py"):
                    whole = os.path.join(base, name)
                    package.write(whole, os.path.relpath(whole, os.path.dirname(folder)))
    context.addPyFile(path)
    context._defectloom_sent = True


def keep(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a written table below the session's shared folder."""
    path = f"{work_dir(df.sparkSession)}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, **own: str) -> DataFrame:
    """Each row whole in ``row``, with some of its columns beside it under names of ours.

    So no name of the caller's can clash with a working column; ``select("row.*")`` unpacks.
    """
    row = F.struct(*[F.col(f"`{n}`") for n in df.columns]).alias("row")
    return df.select(row, *[F.col(f"`{n}`").alias(name) for name, n in own.items()])


def row_marks(df: DataFrame) -> list[Column]:
    """Two hashes of a packed row of ``df``, which together name it: equal rows have equal marks.

    The hash skips nulls, so rows that hold some are marked by their places as well.
    """
    row = F.col("row")
    holds, places = F.lit(False), []
    for field in df.schema.fields:
        own = row.getField(field.name)
        if isinstance(field.dataType, (ArrayType, StructType)):
            # Nulls may lie deeper here.
            text = F.to_json(F.struct(own.alias("v")), {"ignoreNullFields": "false"})
            holds = holds | F.contains(text, F.lit("null"))
            places.append(text)
        else:
            holds = holds | own.isNull()
            places.append(F.when(own.isNull(), "1").otherwise("0"))
    nulls = F.when(holds, F.concat(*places))
    return [F.xxhash64("row", nulls).alias("_h"), F.xxhash64(F.lit(1), "row", nulls).alias("_g")]
