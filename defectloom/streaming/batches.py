"""The batch limit in a stream: rows wait in state until their batch is complete or too large.

A batch is complete when the watermark has passed the last arrival of its rows. Up to that moment
its rows, no more than the limit, are held in keyed state; then they are released. As soon as one
row more arrives, all that are held are turned away, and so is each later row when it comes: state
keeps only that mark. So state is bounded per batch, however large a batch is, and rows of a huge
batch pass through their task piece by piece.

A row that comes after the watermark has passed it is late and dropped by Spark: ``lateness`` says
how long to wait. Before any row came the watermark is the start of 1970. A missing batch name is a batch. Rows without an id only move the watermark, as
a source does that has nothing more to send. Repeated rows count each time.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from defectloom.operators.filters import MAX_BATCH, MAX_REQUEST_CHARS, request_verdict

TOO_LARGE = "batch too large"
ROWS = "id bigint, batch string, code string, reason string"
STATE = "large boolean, last bigint, held string"


def hold_batches(
    requests: DataFrame, batch: str, arrived: str, lateness: str = "1 hour", max_batch: int = MAX_BATCH
) -> DataFrame:
    """``id, batch, code, reason`` of a stream's rows, each once its batch is decided."""

    def decide(key, chunks: Iterator[pd.DataFrame], state: GroupState):
        large, last, held = state.get if state.exists else (False, 0, "[]")
        held = json.loads(held)

        def out(rows, reason):
            ids, codes = ([r[k] for r in rows] for k in (0, 1))
            return pd.DataFrame({"id": ids, "batch": key[0], "code": codes, "reason": reason}, dtype=object)

        if state.hasTimedOut:
            state.remove()
            if held:
                yield out(held, None)
            return
        heard = state.exists
        for chunk in chunks:
            chunk = chunk[chunk["_row"]]
            if chunk.empty:
                continue
            heard, last = True, max(last, int(chunk["_at"].max()))
            rows = [(int(i), c) for i, c in zip(chunk["id"], chunk["code"])]
            if not large and len(held) + len(rows) <= max_batch:
                held += rows
            else:
                large, held, rows = True, [], held + rows
                yield out(rows, TOO_LARGE)
        if not heard:
            return
        state.update((large, last, json.dumps(held)))
        # The mark of a large batch goes when the batch is over as well.
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)

    # A filter on the id would be pushed below the watermark, and a null would make ids floats.
    rows = requests.select(
        F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().alias("_row"), F.col(batch).alias("batch"),
        "code", F.col(arrived).alias("_arrived"), F.unix_millis(F.col(arrived)).alias("_at"),
    )
    rows = rows.withWatermark("_arrived", lateness)
    return rows.groupBy("batch").applyInPandasWithState(
        decide, ROWS, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def start_batches(
    requests: DataFrame,
    batch: str,
    arrived: str,
    out: str,
    checkpoint: str,
    lateness: str = "1 hour",
    max_batch: int = MAX_BATCH,
    max_chars: int = MAX_REQUEST_CHARS,
) -> StreamingQuery:
    """Decide what has arrived and stop; a later start goes on from the checkpoint.

    Rows of accepted batches are checked one by one as well. The file sink keeps accepted and
    rejected rows apart (``status``), so that a scoring stream reads the accepted ones alone.
    """
    decided = hold_batches(requests, batch, arrived, lateness, max_batch)
    decided = decided.withColumn("reason", F.coalesce("reason", request_verdict("code", max_chars)))
    status = F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")
    return (
        decided.withColumn("status", status)
        .writeStream.format("parquet")
        .partitionBy("status")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
