"""Line files: plain values, JSON objects, and listings that a service gives term by term."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import remote


def values(spark: SparkSession, path: str) -> DataFrame:
    """value: one a line, blank lines left out."""
    return spark.read.text(path).filter(F.trim("value") != "")


def objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each line's JSON object; blank lines are left out, and a line that is none has null fields."""
    return spark.read.schema(schema).json(path)


def listing(terms: DataFrame, term: str, fetch: Callable[[str], str], record: str, passes: int = 2) -> tuple[DataFrame, DataFrame]:
    """(records with the term they are listed under; term and error of listings that failed in every pass).

    `fetch` gives a term's listing, a JSON object with `results`; `record` is the type of one of these.
    """
    found = remote.fetched(terms, term, fetch, passes)
    rows = found.filter("error is null").select(F.col("key").alias(term), F.inline(F.from_json("value", f"results array<{record}>")["results"]))
    return rows, found.filter("error is not null").select(F.col("key").alias(term), "error")
