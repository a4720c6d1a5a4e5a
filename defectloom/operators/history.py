"""Choices made from the metric history of training runs: (run_id, step, f1).

A score that is not a number never wins and counts as no gain, like a missing one. Rows without
a step have no place in a run and are left out. A missing run_id is a run of its own.
"""

from pyspark.sql import DataFrame, functions as F

from defectloom.operators.positions import with_position
from defectloom.workspace import work_dir

BLOCK, JOINED = 4096, 64


def _scores(history: DataFrame) -> DataFrame:
    known = F.when(~F.isnan("f1"), F.col("f1"))
    return history.where("step IS NOT NULL").select(
        "run_id", F.col("step").cast("long").alias("step"), known.cast("double").alias("f1")
    )


def best_step(history: DataFrame) -> DataFrame:
    """Step with the highest F1 of each run, the earliest on ties; null for a run without scores."""
    scored = F.when(F.col("f1").isNotNull(), F.struct("f1", (-F.col("step")).alias("neg_step")))
    return _scores(history).groupBy("run_id").agg(F.max(scored).alias("b")).select(
        "run_id", (-F.col("b.neg_step")).alias("step"), F.col("b.f1").alias("f1")
    )


def early_stop(
    history: DataFrame, patience: int = 3, threshold: float = 0.001, block: int = BLOCK
) -> DataFrame:
    """Where each run stops: the first step with ``patience`` steps in a row that do not beat
    the best F1 by more than ``threshold``; null when the run goes to its end.

    A best score is beaten within ``patience`` steps or never, so a run enters a block of steps with
    its best among the block's first ``patience`` ones. Each block is followed once from each of them,
    all blocks at a time; then neighbouring blocks are joined, ``JOINED`` at a time, until a run is one
    block. The rounds grow with the logarithm of the longest run, and every list is bounded.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    spark = history.sparkSession
    base = work_dir(spark)
    block = max(block, patience)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    rows = with_position(kept(_scores(history), "scores"), ["step"], ["run_id"])
    own = F.floor(F.col("pos") / block)
    # The steps that decide on a block's last best score stand in the next block.
    shared = (F.col("pos") % block < patience) & (own > 0)
    rows = rows.withColumn("block", F.explode(F.when(shared, F.array(own - 1, own)).otherwise(F.array(own))))
    listed = rows.groupBy("run_id", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "step", "f1"))).alias("rows"))
    # Without a best score at a run's start, else with the one at each of the first steps.
    entries = F.when(F.col("block") == 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(patience - 1)))
    start, end = F.col("block") * block, (F.col("block") + 1) * block

    def follow(entry):
        first = F.struct(
            F.lit(None).cast("double").alias("best"), F.lit(0).alias("wait"),
            F.lit(None).cast("long").alias("stopped"), F.lit(None).cast("int").alias("enters"),
        )

        def advance(state, row):
            over = state["stopped"].isNotNull() | state["enters"].isNotNull() | (row["pos"] < start + entry)
            better = row["f1"].isNotNull() & (state["best"].isNull() | (row["f1"] > state["best"] + threshold))
            leaves = better & (row["pos"] >= end)
            wait = F.when(better, 0).otherwise(state["wait"] + 1)
            moved = F.struct(
                F.when(better, row["f1"]).otherwise(state["best"]).alias("best"),
                wait.alias("wait"),
                F.when(wait >= patience, row["step"]).alias("stopped"),
                F.when(leaves, (row["pos"] - end).cast("int")).alias("enters"),
            )
            return F.when(over, state).otherwise(moved)

        def outcome(state):
            return F.struct(state["enters"].alias("enters"), state["stopped"].alias("stopped"), state["best"].alias("best"))

        return F.aggregate("rows", first, advance, outcome)

    blocks = kept(listed.select("run_id", "block", F.transform(entries, follow).alias("ways")), "blocks")
    level = 0
    while blocks.where("block > 0").take(1):
        level += 1
        blocks = kept(_neighbours_joined(blocks), f"blocks{level}")
    way = F.get("ways", F.lit(0))
    return blocks.select("run_id", way["stopped"].alias("stop_step"), way["best"].alias("best_f1"))


def _neighbours_joined(blocks: DataFrame) -> DataFrame:
    """Each ``JOINED`` blocks of a run as one: where a way leaves a block, the next one's takes over."""
    above = F.floor(F.col("block") / JOINED).alias("above")
    listed = blocks.groupBy("run_id", above).agg(F.sort_array(F.collect_list(F.struct("block", "ways"))).alias("parts"))

    def after(ways, part):
        return F.transform(ways, lambda w: F.when(w["enters"].isNotNull(), F.get(part["ways"], w["enters"])).otherwise(w))

    rest = F.slice("parts", F.lit(2), F.size("parts"))
    joined = F.aggregate(rest, F.get("parts", F.lit(0))["ways"], after)
    return listed.select("run_id", F.col("above").alias("block"), joined.alias("ways"))
