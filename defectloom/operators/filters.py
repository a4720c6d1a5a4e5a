"""Row rules: labels, request limits, batch limits, program lists."""

from pyspark.sql import Column, DataFrame, functions as F

from defectloom.functions.text import is_blank

# Request and batch limits.
MAX_REQUEST_CHARS = 10000
MAX_BATCH = 100

# Programs whose inputs are graphs or linked nodes.
GRAPH_PROGRAMS = (
    "breadth_first_search",
    "depth_first_search",
    "detect_cycle",
    "minimum_spanning_tree",
    "reverse_linked_list",
    "shortest_path_length",
    "shortest_path_lengths",
    "shortest_paths",
    "topological_ordering",
)


def clean_only(df: DataFrame) -> DataFrame:
    return df.where("is_buggy = 0")


def buggy_only(df: DataFrame) -> DataFrame:
    return df.where("is_buggy = 1")


def request_verdict(code, max_chars: int = MAX_REQUEST_CHARS) -> Column:
    """Why a request is turned away, null when it is accepted."""
    code = F.col(code) if isinstance(code, str) else code
    return (
        F.when(code.isNull() | (F.length(code) < 1), "empty")
        .when(F.length(code) > max_chars, "too long")
        .when(is_blank(code), "blank")
    )


def batch_sizes(df: DataFrame, batch: str, max_batch: int = MAX_BATCH) -> DataFrame:
    """Size of each batch and whether it is allowed."""
    return (
        df.groupBy(batch)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("accepted", F.col("n").between(1, max_batch))
    )


def batch_verdicts(df: DataFrame, batch: str, max_batch: int = MAX_BATCH) -> DataFrame:
    """All rows, with the reason why their batch is turned away or null.

    Batches are counted on the map side first, and only the oversized ones are joined back; a
    missing batch name is a batch.
    """
    large = batch_sizes(df, batch, max_batch).where(~F.col("accepted"))
    large = large.select(F.col(batch).alias("_batch"), F.lit("batch too large").alias("reason"))
    return df.join(large, F.col(batch).eqNullSafe(F.col("_batch")), "left").drop("_batch")


def accepted_batches(df: DataFrame, batch: str, max_batch: int = MAX_BATCH) -> DataFrame:
    """Rows of the batches within the limit; ``batch_verdicts`` has the others with a reason."""
    return batch_verdicts(df, batch, max_batch).where("reason IS NULL").drop("reason")


def is_graph_program(program) -> Column:
    program = F.col(program) if isinstance(program, str) else program
    return program.isin(*GRAPH_PROGRAMS)
