"""Details fetched from a service key by key, in Spark's tasks."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut


def fetched(keys: DataFrame, key: str, fetch: Callable[[str], str], passes: int = 2) -> DataFrame:
    """key, value and error of every row: what failed in one pass is tried in the next, and what fails in the last keeps its error. Null keys are errors at once."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k in batch["key"]:
                try:
                    rows.append((k, fetch(k), None) if k is not None else (k, None, "no key"))
                except Exception as e:  # whatever the service raises is the row's error
                    rows.append((k, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["key", "value", "error"], dtype=object)

    done, left = None, keys.select(F.col(key).cast("string").alias("key"))
    for n in range(passes):
        tried = cut(left.mapInPandas(work, "key string, value string, error string"))
        final = tried if n == passes - 1 else tried.filter("error is null or key is null")
        done = final if done is None else done.unionByName(final)
        left = tried.filter("error is not null and key is not null").select("key")
    return done


def looked_up(rows: DataFrame, key: str, fetch: Callable[[str], str], field: str, default: str = "", passes: int = 2) -> DataFrame:
    """The rows with `field`: what the service says of their key, each distinct key asked for once; `default` where it says nothing, fails, or the key is null."""
    found = fetched(rows.select(key).filter(F.col(key).isNotNull()).distinct(), key, fetch, passes).filter("error is null")
    said = found.select(F.col("key").alias("__key"), F.col("value").alias("__value"))
    joined = rows.join(said, F.col(key).cast("string") == F.col("__key"), "left")
    return joined.select(*rows.columns, F.coalesce("__value", F.lit(default)).alias(field))
