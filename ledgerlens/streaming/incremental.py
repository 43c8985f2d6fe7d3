"""Incremental matching of a stream of A rows against a static reference table B.

The reference app has no streaming; this is the same J1-J4 matcher applied
per micro-batch through ``foreachBatch``, so new A rows arriving as files
(or any streaming source) are matched and appended to a sink with
exactly-once file output per batch id. The B build side is the static
DataFrame; Spark re-reads it per batch (cache it when it fits).
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.match import match
from ..session import ensure_checkpoint_dir


def match_stream(stream: DataFrame, b: DataFrame, key_a: str, key_b: str, out_path: str, extract=(),
                 threshold: float = 80, b_order=None, checkpoint: str | None = None,
                 trigger_available_now: bool = True, query_name: str | None = None) -> StreamingQuery:
    """Start a streaming query that matches every micro-batch of ``stream`` against ``b`` and appends the rows
    (partitioned by category) under ``out_path/batch_id=<id>``; rewriting a batch id overwrites only that batch,
    so a replay after failure does not duplicate rows. Without a name the stream is known by its output path, so a restart goes on
    where it stopped (on a cluster, where the checkpoint folder is kept)."""
    spark = stream.sparkSession
    base = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{query_name or md5(out_path.encode()).hexdigest()}"

    def run(batch: DataFrame, batch_id: int) -> None:
        res = match(batch, b, key_a, key_b, extract=extract, threshold=threshold, b_order=b_order)
        res.write.mode("overwrite").partitionBy("category").parquet(f"{out_path}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", base)
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(availableNow=True) if trigger_available_now else w.trigger(processingTime="10 seconds")
    return w.start()
