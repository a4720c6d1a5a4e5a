"""A tree of bugs by project: ``projects/<project>/bugs/<number>/`` with metadata and patch."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from defectloom.functions.text import parse_kv, patch_code, truncate_lines, unix_newlines
from defectloom.operators.pairs import pair_rows, project_pair_id
from defectloom.sources.layout import require_dirs

# File names and the place of a bug in the tree.
INFO, PATCH = "bug.info", "bug_patch.txt"
BUG_PATH = r"/projects/([^/]+)/bugs/([0-9]+)/[^/]+\z"


def scan_bug_tree(spark: SparkSession, root: str) -> DataFrame:
    """``project, bug, info, patch``, one row per numbered folder that has metadata.

    One scan reads both files of a bug; a file that is not UTF-8 counts as missing.
    """
    require_dirs(spark, root, ["projects"])
    texts = spark.read.text(
        f"{root}/projects/*/bugs/*", wholetext=True, pathGlobFilter="bug[._]*"
    ).where(F.is_valid_utf8("value"))
    files = texts.select(
        F.regexp_extract("_metadata.file_path", BUG_PATH, 1).alias("project"),
        F.regexp_extract("_metadata.file_path", BUG_PATH, 2).alias("bug"),
        F.col("_metadata.file_name").alias("file"),
        unix_newlines("value").alias("text"),
    )

    def text_of(name):
        return F.max(F.when(F.col("file") == name, F.col("text")))

    return (
        files.where((F.col("bug") != "") & F.col("file").isin(INFO, PATCH))
        .groupBy("project", "bug")
        .agg(text_of(INFO).alias("info"), text_of(PATCH).alias("patch"))
        .where("info IS NOT NULL")
    )


def bug_tree_samples(
    tree: DataFrame,
    source: str,
    sides: str = "split",
    max_chars: int | None = None,
    hunks: str = "all",
) -> DataFrame:
    """Labelled rows from the patches.

    ``split`` takes the lines before and after the change, ``same`` the merged text for both
    labels. The code is cut only when ``max_chars`` is given. ``hunks="last"`` keeps what is below
    the last header of a patch alone.
    """
    if sides not in ("split", "same"):
        raise ValueError(f"unknown sides: {sides}")
    marks = ("- ", "+ ") if sides == "split" else ("+- ", "+- ")
    before, after = (patch_code("patch", keep, hunks) for keep in marks)
    if max_chars is not None:
        before, after = truncate_lines(before, max_chars), truncate_lines(after, max_chars)
    path = F.coalesce(parse_kv("info")["test_file"], F.lit("unknown"))
    pairs = tree.select(
        "project",
        "bug",
        path.alias("buggy_path"),
        path.alias("fixed_path"),
        before.alias("buggy_code"),
        after.alias("fixed_code"),
    )
    return pair_rows(
        pairs,
        F.lit(source),
        F.col("project"),
        project_pair_id("project", "bug"),
        name_functions=False,
    )
