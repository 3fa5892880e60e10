"""Continuous intake: deliveries in, review jobs out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from reviewlake.operators.intake import review_jobs


def start_intake(
    deliveries: DataFrame, secret: bytes, out_path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append the jobs of a delivery stream; the checkpoint makes it exactly once."""
    writer = (
        review_jobs(deliveries, secret)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
