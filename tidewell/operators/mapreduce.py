"""Map and reduce with Python functions: mapped in tasks, folded before and after one shuffle by key."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a task folds before it sends them.
HELD = 200_000


def run(rows: DataFrame, key: str, value: str, mapper: Callable[[Any, Any], Iterable[tuple[str, Any]]], fold: Callable[[Any, Any], Any], kind: str) -> DataFrame:
    """key and value (of Spark type `kind`): the mapper's pairs of every row, values of one key folded two by two.

    The fold must not care about order or grouping. Values of a key are folded as they come, in each task before the
    shuffle and behind it, so no task holds them all, and a key of all rows sends one value a task. Rows of null key or
    value aren't mapped; pairs of null key are dropped.
    """
    schema = f"key string, value {kind}"

    def folded(pairs: Iterator[tuple[str, Any]], most: int) -> Iterator[pd.DataFrame]:
        held: dict[str, Any] = {}
        for k, v in pairs:
            if k is not None:
                held[k] = fold(held[k], v) if k in held else v
            if len(held) >= most:
                yield frame(held)
                held = {}
        if held:
            yield frame(held)

    def frame(held: dict) -> pd.DataFrame:
        return pd.DataFrame({"key": list(held), "value": pd.Series(list(held.values()), dtype=object)})

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from folded((p for b in batches for k, v in zip(b["k"], b["v"], strict=True) for p in mapper(k, v)), HELD)

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of one key follow each other."""
        now, total, done = None, None, {}
        for b in batches:
            for k, v in zip(b["key"], b["value"], strict=True):
                if k == now:
                    total = fold(total, v)
                    continue
                if now is not None:
                    done[now] = total
                now, total = k, v
            if len(done) >= 10_000:
                yield frame(done)
                done = {}
        if now is not None:
            done[now] = total
        if done:
            yield frame(done)

    sent = rows.select(F.col(key).alias("k"), F.col(value).alias("v")).filter("k is not null and v is not null").mapInPandas(mapped, schema)
    return sent.repartition("key").sortWithinPartitions("key").mapInPandas(reduced, schema)
