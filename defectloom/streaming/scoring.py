"""Continuous scoring of code that arrives as files."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from defectloom.functions.text import preview
from defectloom.operators.filters import MAX_REQUEST_CHARS, batch_verdicts, request_verdict
from defectloom.operators.model import predict
from defectloom.operators.positions import with_position


def score_requests(
    requests: DataFrame, model: PipelineModel, max_chars: int = MAX_REQUEST_CHARS
) -> DataFrame:
    """``id, status, reason, label, score``; turned-away rows keep their reason and no score.

    Stateless, so it serves batch and streaming tables alike.
    """
    checked = requests.select(
        "id", "code", request_verdict("code", max_chars).alias("reason")
    )
    # The model sees accepted rows only.
    scored = predict(model, checked.where("reason IS NULL"))
    accepted = scored.select("id", F.lit("accepted").alias("status"), "reason", "label", "score")
    rejected = checked.where("reason IS NOT NULL").select(
        "id",
        F.lit("rejected").alias("status"),
        "reason",
        F.lit(None).cast("string").alias("label"),
        F.lit(None).cast("double").alias("score"),
    )
    return accepted.unionByName(rejected)


def batch_replies(
    requests: DataFrame, model: PipelineModel, batch: str, max_chars: int = MAX_REQUEST_CHARS
) -> DataFrame:
    """One reply per request of ``id, code`` and a batch name: ``slot``, preview, label, score.

    Rows of an oversized batch, and requests that are turned away, have a reason instead. Slots
    count the ids of a batch from 0. An empty table gives no replies.
    """
    checked = batch_verdicts(requests, batch).withColumn(
        "reason", F.coalesce("reason", request_verdict("code", max_chars))
    )
    scored = predict(model, checked.where("reason IS NULL").select("id", batch, "code"))
    scored = scored.select("id", batch, preview("code").alias("preview"), F.lit(None).cast("string").alias("reason"), "label", "score")
    refused = checked.where("reason IS NOT NULL").select(
        "id", batch, preview("code").alias("preview"), "reason",
        F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("score"),
    )
    # The keys alone are numbered.
    slots = with_position(requests.select(F.col("id").alias("_id"), batch), ["_id"], [batch], into="slot")
    return scored.unionByName(refused).join(slots.drop(batch), F.col("id") == F.col("_id")).drop("_id")


def start_scoring(
    requests: DataFrame, model: PipelineModel, out: str, checkpoint: str
) -> StreamingQuery:
    """Score what has arrived and stop; a later start goes on from the checkpoint.

    The file sink writes each input once, and keeps rejected rows apart in a folder of their
    own (``status=rejected``).
    """
    return (
        score_requests(requests, model)
        .writeStream.format("parquet")
        .partitionBy("status")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
