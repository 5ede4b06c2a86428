"""Records in one folder of JSON lines for each owner, with the keys that were written and how many each owner has."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write(records: DataFrame, key: str, owner: Column, path: str) -> None:
    """records/owner=<owner>: the records that have a key, as JSON lines; keys: the sorted keys; counts: how many each owner has. What was there is replaced."""
    rows = records.filter(F.col(key).isNotNull()).withColumn("owner", owner)
    rows.write.mode("overwrite").partitionBy("owner").json(f"{path}/records")
    back = records.sparkSession.read.schema(rows.schema).json(f"{path}/records")
    back.select(key).sort(key).write.mode("overwrite").json(f"{path}/keys")
    back.groupBy("owner").count().write.mode("overwrite").json(f"{path}/counts")
