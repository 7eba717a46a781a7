"""Structured Streaming of documents through the detectors.

Detectors are stateless across documents, so a stream needs neither watermark nor state: each
micro-batch is a table of new documents. Findings of a batch are written under its batch id, which
makes a repeated batch overwrite itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import detectors


def stream_findings(docs: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Write the variant rows of a stream of (doc_id, text) to path/batch=<id> as Parquet; runs over what is there and stops."""

    def each(batch: DataFrame, batch_id: int) -> None:
        known = batch.dropDuplicates(["doc_id"])
        detectors.all_variants(known, **options).withColumn("n", F.col("n").cast("long")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
