"""Values by key in folders of a hash of the key: a point get reads one folder, and a get without a key reads all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids


def put(rows: DataFrame, key: str, path: str, folders: int = 64) -> None:
    """Replaces the store by the rows that have a key; of rows with one key any may be the one that is kept."""
    own = rows.filter(F.col(key).isNotNull()).withColumn("folder", ids.modulo(ids.key_id(F.col(key)), folders).cast("int"))
    own.dropDuplicates([key]).repartition("folder").sortWithinPartitions("folder", key).write.mode("overwrite").partitionBy("folder").parquet(path)


def get(spark: SparkSession, path: str, key: str, value: object = None, folders: int = 64) -> DataFrame:
    """The row of a key, or with no key all rows; a key that isn't there has no row."""
    rows = spark.read.parquet(path)
    if value is not None:
        folder = spark.range(1).select(ids.modulo(ids.key_id(F.lit(value)), folders)).first()[0]
        rows = rows.filter((F.col("folder") == folder) & (F.col(key) == F.lit(value)))
    return rows.drop("folder")
