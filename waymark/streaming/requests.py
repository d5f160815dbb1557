"""A stream of requests against the static index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from waymark.operators.search import search_batch


def answer_stream(index: DataFrame, requests: DataFrame, out: str, checkpoint: str, count: int = 10) -> DataStreamWriter:
    """Writes (qid, id, priority, rank) of a stream requests(qid, name, language) to Parquet.

    Requests do not depend on each other, so each micro-batch is a batch search; a batch that is
    run again overwrites its own folder, which makes the sink idempotent.
    """

    def answer(batch: DataFrame, epoch: int) -> None:
        search_batch(index, batch, count).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(answer)
