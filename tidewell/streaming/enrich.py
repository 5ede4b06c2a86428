"""Values fetched for keys in batches, to be stopped and run again at any point: every key once, retries kept as state, failures put aside.

Each step writes its folders (done, dead, pending) and then a manifest that makes them valid; a step that was stopped is
written anew. A key waits in `pending` with its number of tries and the time from which it may be tried again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import manifest
from ..sources.tables import dropped, kept

DONE, DEAD, PENDING = "key string, value string", "key string, error string, tries int", "key string, tries int, due double, error string"


class Throttled(Exception):
    """The service asks to come back later."""


def state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(done: key and value; dead: key, error and tries; pending: key, tries, due and error) as of the last whole step."""
    _, now = manifest.current(spark, path)
    step = now.get("step", -1)

    def read(name: str, kind: str, where: str) -> DataFrame:
        if step < 0:
            return spark.createDataFrame([], kind)
        return spark.read.schema(f"{kind}, step int").parquet(f"{path}/{name}").filter(where).drop("step")

    return read("done", DONE, f"step <= {step}"), read("dead", DEAD, f"step <= {step}"), read("pending", PENDING, f"step = {step}")


def step(keys: DataFrame, fetch: Callable[[list[str]], list[str]], path: str, batch: int | None = None, size: int = 200, concurrency: int = 1, tries: int = 6, wait: float = 5.0, clock: Callable[[], float] = time.time) -> bool:
    """One step: new keys of `keys` (column key) and pending ones that are due are fetched; false if the stream's `batch` had been done before.

    `fetch` gives the values of at most `size` keys; `concurrency` tasks call it at once. If it raises Throttled, its keys are
    tried again after `wait` seconds, and twice as long each further time, `tries` times in all; other errors, and the
    last, put them aside as dead. Null keys and repeats are left out; keys that are done, dead or pending aren't new.
    """
    spark = keys.sparkSession
    version, now = manifest.current(spark, path)
    if batch is not None and batch <= now.get("batch", -1):
        return False
    number, moment = now.get("step", -1) + 1, clock()
    done, dead, pending = state(spark, path)
    known = done.select("key").unionByName(dead.select("key")).unionByName(pending.select("key"))
    new = keys.select(F.col("key").cast("string").alias("key")).filter("key is not null").distinct().join(known, "key", "left_anti")
    due = pending.filter(F.col("due") <= moment)
    todo = new.withColumn("tries", F.lit(0)).unionByName(due.select("key", "tries"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for at in range(0, len(part), size):
                some = part.iloc[at : at + size]
                values, error, again = [None] * len(some), None, False
                try:
                    values = list(fetch(some["key"].tolist()))
                except Throttled as e:
                    error, again = str(e) or "throttled", True
                except Exception as e:  # whatever the service raises is these keys' error
                    error = str(e) or type(e).__name__
                yield pd.DataFrame({"key": some["key"], "tries": some["tries"] + 1, "value": pd.Series(values, index=some.index, dtype=object), "error": error, "again": again})

    found = kept(todo.repartition(concurrency).mapInPandas(work, "key string, tries int, value string, error string, again boolean"))
    retry = F.col("again") & (F.col("tries") < tries)
    later = found.filter(retry).select("key", "tries", (F.lit(moment) + F.lit(wait) * F.pow(F.lit(2.0), F.col("tries") - 1)).alias("due"), "error")
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}/step={number}")
    put(found.filter("error is null").select("key", "value"), "done")
    put(found.filter(F.col("error").isNotNull() & ~retry).select("key", "error", "tries"), "dead")
    put(pending.filter(F.col("due") > moment).unionByName(later), "pending")
    manifest.commit(spark, path, version + 1, {"step": number, "batch": batch if batch is not None else now.get("batch", -1)})
    if number >= 2:
        manifest.delete(spark, f"{path}/pending/step={number - 2}")
    dropped(found)
    return True


def enrich(stream: DataFrame, fetch: Callable[[list[str]], list[str]], path: str, checkpoint: str, **options) -> StreamingQuery:
    """Fetches for every key of a stream (column key), a step for each of its batches; runs until the input is used up."""
    return stream.writeStream.foreachBatch(lambda keys, batch: step(keys, fetch, path, batch, **options) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(spark: SparkSession, fetch: Callable[[list[str]], list[str]], path: str, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time, **options) -> None:
    """Steps over what is pending until nothing is, waiting for the next that is due."""
    none = spark.createDataFrame([], "key string")
    while (due := state(spark, path)[2].agg(F.min("due")).first()[0]) is not None:
        if due > clock():
            sleep(due - clock())
        step(none, fetch, path, clock=clock, **options)
