"""Indexing of a stream: each micro-batch becomes a component of a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestack.plans.engine import SearchEngine


def indexed(stream: DataFrame, engine: SearchEngine, collection: str, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Indexes a stream (url, content), with content, metadata and one step of compaction per batch. A batch that is run
    again is found to be there."""

    def each(batch: DataFrame, epoch: int) -> None:
        engine.index_docs(collection, batch, component=f"{name}-{epoch:012d}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unique_pages(stream: DataFrame, body: str = "content") -> DataFrame:
    """A stream's pages, one per body."""
    return stream.withColumn("md5", F.md5(body)).dropDuplicates(["md5"])
