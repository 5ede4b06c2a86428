"""The stored index kept up to date by a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import index


def maintain(docs: DataFrame, stop: list[str], path: str, checkpoint: str, stemmed: bool = False) -> StreamingQuery:
    """Adds each batch's n-grams as a segment, each batch once, and merges full levels. Runs until the input is used up."""
    return docs.writeStream.foreachBatch(lambda batch, number: index.add(batch, stop, path, stemmed=stemmed, batch=number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The whole index: the segments' postings, summed."""
    return index.current(spark, path)
