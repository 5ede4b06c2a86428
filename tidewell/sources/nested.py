"""Records nested in JSON files, one array of parents a file."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, schema: str, nested: str = "results", parent: str = "srcdb") -> DataFrame:
    """One row per nested record of multi-line JSON, under its parent's key where it has none of its own; parents without records have no rows."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.col(parent).alias("__parent"), F.inline(nested))
    own = F.coalesce(F.nullif(F.col(parent), F.lit("")), F.col("__parent")) if parent in rows.columns else F.col("__parent")
    return rows.withColumn(parent, own).drop("__parent")
