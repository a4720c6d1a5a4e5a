"""JSON lines of the form ``[input, expected]``."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from defectloom.operators.filters import is_graph_program


def scan_test_cases(spark: SparkSession, folder: str) -> DataFrame:
    """``program, value``: the lines of one ``<program>.json`` file per program.

    Programs on graphs have no such file; one that turns up is left out.
    """
    program = F.regexp_replace("_metadata.file_name", r"\.json\z", "").alias("program")
    lines = spark.read.text(folder, pathGlobFilter="*.json").select(program, "value")
    return lines.where(~is_graph_program("program") & (F.trim("value") != ""))


def normalise_test_cases(lines: DataFrame) -> DataFrame:
    """``input`` and ``expected`` as JSON text; an input that is no list becomes a list of one."""
    case = F.try_parse_json("value")
    given = F.try_variant_get(case, "$[0]", "variant")
    wanted = F.try_variant_get(case, "$[1]", "variant")
    text = F.to_json(given)
    is_list = F.startswith(F.schema_of_variant(given), F.lit("ARRAY"))
    keep = [name for name in lines.columns if name != "value"]
    return lines.select(
        *keep,
        F.when(is_list, text).otherwise(F.concat(F.lit("["), text, F.lit("]"))).alias("input"),
        F.to_json(wanted).alias("expected"),
    )
