"""The sample table: one labelled code snippet per row."""

from pyspark.sql import types as T

SAMPLE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("func_name", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("is_buggy", T.IntegerType()),
        T.StructField("pair_id", T.StringType()),
    ]
)

# The split names, in report order, and the length limit of a snippet.
SPLITS = ("train", "val", "test", "eval")
MAX_CHARS = 4000
