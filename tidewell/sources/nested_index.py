"""The collapsed index as files: nested records with their positions, the map from position to key, and readable vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordered
from .tables import dropped, kept


def write(records: DataFrame, key: str, vector: str, path: str) -> None:
    """path/records: Parquet, nested as they are, without the vector; path/ids: JSON lines of position and key; path/vectors: JSON lines of key and numbers.

    Positions follow the order of keys, from 0 without gaps; records of null key are left out. What was there is replaced.
    """
    placed = kept(ordered.numbered(records.filter(F.col(key).isNotNull()), key, name="position"))
    placed.drop(vector).write.mode("overwrite").parquet(f"{path}/records")
    placed.select("position", key).write.mode("overwrite").json(f"{path}/ids")
    placed.select(key, F.col(vector).alias("vector")).write.mode("overwrite").json(f"{path}/vectors")
    dropped(placed)
