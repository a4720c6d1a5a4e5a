"""Defect / fix pairs and the labelled rows made from them."""

from pyspark.sql import Column, DataFrame, functions as F

from defectloom.functions.text import function_name, strip


def join_pairs(defects: DataFrame, fixes: DataFrame, key: str = "stem") -> DataFrame:
    """Inner join of ``(key, path, code)`` tables; both sides hold a key once."""
    buggy = defects.select(key, F.col("path").alias("buggy_path"), F.col("code").alias("buggy_code"))
    fixed = fixes.select(key, F.col("path").alias("fixed_path"), F.col("code").alias("fixed_code"))
    return buggy.join(fixed, key)


def usable_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with code on both sides that differ in more than outer white space."""
    return pairs.where(
        (F.length("buggy_code") > 0)
        & (F.length("fixed_code") > 0)
        & (strip("buggy_code") != strip("fixed_code"))
    )


def unpaired(defects: DataFrame, fixes: DataFrame, key: str = "stem") -> DataFrame:
    """Defects without a fix."""
    return defects.join(fixes.select(key), key, "left_anti")


def pair_rows(
    pairs: DataFrame,
    source: Column,
    project: Column,
    pair_id: Column,
    name_functions: bool = True,
) -> DataFrame:
    """One row per side that has code: label 1 for the defect, 0 for the fix.

    ``pairs`` holds ``buggy_path, buggy_code, fixed_path, fixed_code``; a missing or empty
    side gives no row.
    """
    sides = F.array(
        F.struct(
            F.lit("_buggy").alias("mark"),
            F.col("buggy_path").alias("path"),
            F.col("buggy_code").alias("code"),
            F.lit(1).alias("is_buggy"),
        ),
        F.struct(
            F.lit("_fixed").alias("mark"),
            F.col("fixed_path").alias("path"),
            F.col("fixed_code").alias("code"),
            F.lit(0).alias("is_buggy"),
        ),
    )
    rows = pairs.select(
        source.alias("source"),
        project.alias("project"),
        pair_id.alias("pair_id"),
        F.explode(F.filter(sides, lambda s: F.length(s["code"]) > 0)).alias("side"),
    )
    name = function_name(F.col("side.code")) if name_functions else F.lit("module")
    return rows.select(
        F.concat("pair_id", "side.mark").alias("id"),
        "source",
        "project",
        "side.path",
        name.alias("func_name"),
        "side.code",
        "side.is_buggy",
        "pair_id",
    )


def project_pair_id(project, bug) -> Column:
    return F.concat_ws("_", project, bug)
