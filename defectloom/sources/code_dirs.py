"""Two folders of Python files, defects and fixes, matched by file name."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from defectloom.functions.text import truncate_lines, unix_newlines
from defectloom.operators.pairs import join_pairs, pair_rows, usable_pairs
from defectloom.sources.layout import require_dirs

# The folder names.
DEFECT_DIR = "python_programs"
FIX_DIR = "correct_python_programs"


def scan_code_dir(
    spark: SparkSession, root: str, folder: str, max_chars: int | None = None
) -> DataFrame:
    """``stem, path, code`` of the ``*.py`` files right below the folder.

    Files that are not UTF-8 are left out. The code is cut, at a line end, only when ``max_chars``
    is given.
    """
    code = unix_newlines("value")
    if max_chars is not None:
        code = truncate_lines(code, max_chars)
    files = spark.read.text(f"{root}/{folder}", wholetext=True, pathGlobFilter="*.py").where(
        F.is_valid_utf8("value")
    )
    return files.select(
        F.regexp_replace("_metadata.file_name", r"\.py\z", "").alias("stem"),
        F.concat(F.lit(f"{folder}/"), "_metadata.file_name").alias("path"),
        code.alias("code"),
    )


def code_dir_samples(
    spark: SparkSession, root: str, source: str, max_chars: int | None = None
) -> DataFrame:
    """Labelled rows of all usable pairs; ``source`` also names the project."""
    require_dirs(spark, root, [DEFECT_DIR, FIX_DIR])
    defects = scan_code_dir(spark, root, DEFECT_DIR, max_chars)
    fixes = scan_code_dir(spark, root, FIX_DIR, max_chars)
    pairs = usable_pairs(join_pairs(defects, fixes))
    name = F.lit(source)
    return pair_rows(pairs, name, name, F.concat_ws("_", name, "stem"))
