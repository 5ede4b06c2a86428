"""Operators over request logs: windows anchored at a key's first event, recency, latency summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import dropped, kept
from . import ordered


#: A key of more rows has its windows found by pointers; the rows of any other are walked through in one task.
WALKED = 200_000


def anchored(rows: DataFrame, key: str, width_us: int, walked: int = WALKED) -> DataFrame:
    """The rows with start (the ts at which their window opened) and used (how many rows of the window come before).

    rows: `key`, ts, id (unique), and others. Per key and in the order of ts and id, a window opens with the first row, and
    again with the first row at least `width_us` microseconds after the last opening. Rows of null key or ts are left out.

    Keys of up to `walked` rows are walked through, each in one task. The rows of larger ones are put in a total order over
    all tasks; each points to the first row that could open the next window, and pointers are doubled until those that
    lead from each key's first row are known: a number of rounds in the logarithm of the windows of one key.
    """
    rows = rows.filter(F.col(key).isNotNull() & F.col("ts").isNotNull())
    hot = kept(rows.groupBy(key).count().filter(F.col("count") > walked).select(key))
    if hot.isEmpty():
        return _walked(rows, key, width_us)
    return _walked(rows.join(hot, key, "left_anti"), key, width_us).unionByName(_pointed(rows.join(hot, key, "left_semi"), key, width_us))


def _walked(rows: DataFrame, key: str, width_us: int) -> DataFrame:
    width, columns = pd.Timedelta(microseconds=width_us), rows.columns

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come key by key, in order; what is kept is the key's window and how many rows it has."""
        now, start, n, first = None, None, 0, True
        for part in batches:
            starts, used = [], []
            for k, t in zip(part[key], part["ts"], strict=True):
                if first or k != now or t >= start + width:
                    now, start, n, first = k, t, 0, False
                starts.append(start)
                used.append(n)
                n += 1
            yield part.assign(start=pd.Series(starts, index=part.index, dtype=part["ts"].dtype), used=used)

    kinds = rows.dtypes
    schema = ", ".join(f"`{n}` {t}" for n, t in [*kinds, ("start", dict(kinds)["ts"]), ("used", "long")])
    return rows.repartition(key).sortWithinPartitions(key, "ts", "id").select(*columns).mapInPandas(walk, schema)


def _pointed(rows: DataFrame, key: str, width_us: int) -> DataFrame:
    placed = ordered.counted(ordered.ordered(rows, key, "ts", "id"), "place")
    placed = ordered.previous(placed, "before", key)
    width = F.expr(f"make_dt_interval(0, 0, 0, CAST({width_us} AS DECIMAL(20, 0)) / 1000000)")
    # A row and, at the end of the window it may open, a question: how many rows come before the answer is the place of the next.
    both = placed.select(key, F.explode(F.array(F.struct(F.col("ts").alias("t"), F.lit(1).alias("row")), F.struct((F.col("ts") + width).alias("t"), F.lit(0).alias("row")))).alias("x"), "place")
    both = ordered.counted(ordered.ordered(both.select(key, "x.*", "place"), key, "t", "row", "place"), "next", F.col("row") == 1)
    to = placed.select(F.col("place").alias("next"), F.col(key).alias("k"))
    steps = both.filter("row = 0").select(key, "place", "next").join(to, "next").filter(F.col(key) == F.col("k")).select("place", "next")
    heads = placed.filter(F.col("before").isNull() | (F.col(f"before.{key}") != F.col(key))).select("place")
    # Only rows that something points to, and heads, can open windows.
    nodes = steps.select(F.col("next").alias("place")).distinct().unionByName(heads).distinct()
    jumps, opened = kept(steps.join(nodes, "place", "left_semi")), kept(heads)
    while not jumps.isEmpty():
        last = jumps, opened
        found = opened.join(jumps, "place").select(F.col("next").alias("place"))
        opened = kept(opened.unionByName(found).distinct())
        jumps = kept(jumps.join(jumps.select(F.col("place").alias("next"), F.col("next").alias("after")), "next").select("place", F.col("after").alias("next")))
        dropped(*last)
    opened = opened.withColumn("opens", F.lit(True))
    marked = ordered.latest(placed.join(opened, "place", "left"), "window", F.col("opens"), "ts", "place")
    return marked.select(*rows.columns, F.col("window.ts").alias("start"), (F.col("place") - F.col("window.place")).alias("used"))


def rate_limited(events: DataFrame, limit: int, hours: int, walked: int = WALKED) -> DataFrame:
    """user_id, event_id, window_start and allowed: at most `limit` events in a window that opens with a key's first event after the last window ended.

    Events without user or time are left out.
    """
    own = events.select("user_id", "ts", F.col("event_id").alias("id"))
    found = anchored(own, "user_id", hours * 3_600_000_000, walked)
    return found.select("user_id", F.col("id").alias("event_id"), F.col("start").alias("window_start"), (F.col("used") < limit).alias("allowed"))


def cached(accesses: DataFrame, capacity: int = 100, minutes: int = 30, walked: int = WALKED, block: int = 1 << 16) -> DataFrame:
    """key, id, distance and outcome of every access (key, ts, id) to a cache of `capacity` entries, least recently used out first, that expire `minutes` after they were put.

    An access that finds nothing puts its key; one that finds its entry refreshes its place in the order but not its expiry.
    An expired entry keeps its place until its key is asked for. So the cache holds the keys last asked for, and
    distance (distinct other keys since the last access of this one; null for the first) tells by itself who is still
    there: n - 1 accesses lie between, less those whose own last access lies between too. Outcome: `new`, `evicted` (distance of
    capacity or more), `expired` or `hit`. Accesses without key or time are left out.
    """
    own = accesses.select("key", "ts", "id").filter("key is not null and ts is not null")
    at = kept(ordered.numbered(own, "ts", "id", name="i"))
    by_key = ordered.previous(ordered.ordered(at, "key", "i"), "last", "key", "i")
    by_key = kept(by_key.select("key", "ts", "id", "i", F.when(F.col("last.key") == F.col("key"), F.col("last.i")).alias("p")))
    # An access within (p, i) repeats a key of that stretch if its own last access comes after p: then p < its p < it < i.
    repeats = ordered.greater_before(by_key, "i", "p", block)
    known = by_key.join(repeats, "i", "left").withColumn("distance", F.col("i") - F.col("p") - 1 - F.col("n"))
    known = known.withColumn("puts", F.col("p").isNull() | (F.col("distance") >= capacity))
    # From one certain put of a key to the next, entries expire in windows.
    spans = ordered.latest(ordered.ordered(known, "key", "i"), "put", F.col("puts"), "i").select("key", "ts", F.col("i").alias("id"), F.col("put.i").alias("span"), F.col("id").alias("event"), "p", "distance", "puts")
    found = anchored(spans, "span", minutes * 60_000_000 + 1, walked)
    outcome = F.when(F.col("p").isNull(), "new").when(F.col("puts"), "evicted").when(F.col("used") == 0, "expired").otherwise("hit")
    return found.select("key", F.col("event").alias("id"), "distance", outcome.alias("outcome"))


def recency(events: DataFrame) -> DataFrame:
    """Microseconds since the same user's event of the same type before, and whether that is at most 30 minutes; a cache's outcomes are those of `cached`.

    Events are put in a total order over all tasks, so a user and type with most of them is spread.
    """
    own = events.select("user_id", "event_type", "ts", "event_id")
    found = ordered.previous(ordered.ordered(own, "user_id", "event_type", "ts", "event_id"), "last", "user_id", "event_type", "ts")
    same = F.col("last").isNotNull() & F.col("last.user_id").eqNullSafe(F.col("user_id")) & F.col("last.event_type").eqNullSafe(F.col("event_type"))
    gap = found.select("event_id", F.when(same, F.expr("timestampdiff(MICROSECOND, last.ts, ts)")).alias("gap_us"))
    return gap.withColumn("hit", F.coalesce(F.col("gap_us") <= 1_800_000_000, F.lit(False)))


def latency(events: DataFrame, bins: int = 4096) -> DataFrame:
    """Count, mean, least, greatest and lower nearest-rank percentiles of value by type, exactly.

    Equal values are counted before the shuffle. Values fall into bins between a type's extremes; running sums over the
    bins tell which bin holds a rank, and only the values of that bin are put in order. No task sees all rows of a type.
    """
    rows = events.filter("value is not null").select("event_type", "value")
    summary = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("least"), F.max("value").alias("greatest"))
    span = F.nullif(F.col("greatest") - F.col("least"), F.lit(0.0))
    place = F.floor(F.nanvl(F.coalesce((F.col("value") - F.col("least")) / span * (bins - 1), F.lit(0.0)), F.lit(0.0))).cast("int")
    values = rows.groupBy("event_type", "value").agg(F.count("*").alias("c"))
    values = values.withColumnRenamed("event_type", "type").join(summary, F.col("type").eqNullSafe(F.col("event_type"))).select("event_type", place.alias("bin"), "value", "c", "n")
    running = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    counts = values.groupBy("event_type", "bin", "n").agg(F.sum("c").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(running(["event_type"], "bin")), F.lit(0)))
    ranks = F.array(*(F.struct(F.lit(p).alias("p"), (F.floor((F.col("n") - 1) * p) + 1).alias("rank")) for p in (0.5, 0.95, 0.99)))
    wanted = counts.select("event_type", "bin", "before", "c", F.explode(ranks).alias("x")).filter((F.col("x.rank") > F.col("before")) & (F.col("x.rank") <= F.col("before") + F.col("c")))
    wanted = wanted.groupBy(F.col("event_type").alias("type"), F.col("bin").alias("place"), "before").agg(F.collect_list("x").alias("x"))  # three at most
    inside = values.join(wanted, F.col("type").eqNullSafe(F.col("event_type")) & (F.col("bin") == F.col("place")))
    inside = inside.withColumn("upto", F.col("before") + F.coalesce(F.sum("c").over(running(["event_type", "bin"], "value")), F.lit(0)))
    hit = inside.select("event_type", "value", "c", "upto", F.explode("x").alias("x")).filter((F.col("x.rank") > F.col("upto")) & (F.col("x.rank") <= F.col("upto") + F.col("c")))
    at = lambda p: F.max(F.when(F.col("x.p") == p, F.col("value"))).alias(f"p{int(p * 100)}")
    found = hit.groupBy(F.col("event_type").alias("type")).agg(at(0.5), at(0.95), at(0.99))
    return summary.join(found, F.col("type").eqNullSafe(F.col("event_type"))).drop("type")
