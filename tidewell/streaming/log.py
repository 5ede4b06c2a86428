"""Log records as JSON lines, in batch and appended by a stream."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def line(**fields: Column) -> Column:
    """A JSON object of the fields that have a value; false and empty text count as none."""
    kept = {n: F.when(c.cast("string").isin("false", ""), None).otherwise(c).alias(n) for n, c in fields.items()}
    return F.to_json(F.struct(*kept.values()))


def append(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the column `line` of a stream of records to text files; each record once, also after a restart. Runs until the input is used up."""
    return records.select("line").writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
