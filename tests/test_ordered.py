"""Total orders, windows that open with a first event, and cache outcomes, against plain versions."""

import random
from collections import Counter, OrderedDict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import ordered, requests


@pytest.fixture(scope="module")
def accesses():
    """One key in three has a third of all rows; ties in time; keys and times may be missing."""
    rng = random.Random(8)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice([1, 1, 1, rng.randrange(2, 30), rng.randrange(2, 30), None]), start + timedelta(minutes=rng.randrange(4000)) if rng.random() > 0.02 else None, k) for k in range(1500)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "key long, ts timestamp, id long").withColumn("start", F.lit("clash")).repartition(7)


def told(rows):
    return sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[2]))


def test_places_counts_and_carried_values(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(5), k) for k in range(500)]
    docs = ordered.ordered(spark.createDataFrame(rows, "g int, k int").repartition(6), "g", "k", parts=9)
    assert docs.select(ordered.PART).distinct().count() > 5
    found = ordered.counted(ordered.counted(docs, "place"), "odd", F.col("k") % 2 == 1)
    found = ordered.latest(ordered.previous(found, "before", "g", "k"), "seventh", F.col("k") % 7 == 0, "k")
    odd, before, seventh = 0, None, None
    for place, (r, (g, k)) in enumerate(zip(found.sort("place").collect(), sorted(rows), strict=True)):
        seventh = (k,) if k % 7 == 0 else seventh
        assert (r.g, r.k, r.place, r.odd, r.before, r.seventh) == (g, k, place, odd, before, seventh)
        odd, before = odd + k % 2, (g, k)
    assert ordered.numbered(docs.limit(0), "k").count() == 0


def test_greater_before(spark):
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 300):
        x = rng.permutation(n)
        assert ordered.inversions(x).tolist() == [int((x[:i] > x[i]).sum()) for i in range(n)]
    x = rng.permutation(400)
    rows = spark.createDataFrame([(i, int(v) if i % 3 else None) for i, v in enumerate(x)], "p long, v long")
    want = {i: sum(x[j] > x[i] for j in range(i) if j % 3) for i in range(400) if i % 3}
    for block, most in ((1 << 16, 1024), (7, 5)):
        assert {r.p: r.n for r in ordered.greater_before(rows, "p", "v", block, most).collect()} == want


def test_windows_of_large_keys_are_those_of_small_ones(spark, accesses):
    want, opened = {}, {}
    for k, t, i in told(accesses):
        if k not in opened or t >= opened[k][0] + timedelta(hours=3):
            opened[k] = [t, 0]
        want[i] = (k, *opened[k])
        opened[k][1] += 1
    for walked in (10**9, 100):  # none, and the first key by pointers; below all keys
        found = requests.anchored(frame(spark, accesses).drop("start"), "key", 3 * 3_600_000_000, walked)
        assert {r.id: (r.key, r.start, r.used) for r in found.collect()} == want
    limited = requests.rate_limited(frame(spark, accesses).select(F.col("key").alias("user_id"), "ts", F.col("id").alias("event_id")), 2, 3, walked=0)
    assert {r.event_id: (r.window_start, r.allowed) for r in limited.collect()} == {i: (s, n < 2) for i, (_, s, n) in want.items()}


def test_no_task_holds_a_large_key(spark, accesses):
    """The key of a third of all rows lies in several partitions of the order."""
    placed = ordered.ordered(frame(spark, accesses).filter("key is not null and ts is not null"), "key", "ts", "id", parts=6)
    assert placed.filter("key = 1").select(ordered.PART).distinct().count() >= 3


def test_cache_outcomes(spark, accesses):
    for capacity, minutes, walked, block in ((5, 30, 10**9, 1 << 16), (12, 200, 300, 50)):
        cache, want, order = OrderedDict(), {}, []
        for k, t, i in told(accesses):
            seen = [j for j, x in enumerate(order) if x == k]
            distance = len(set(order[seen[-1] + 1 :])) if seen else None
            if k in cache and t <= cache[k]:
                outcome = "hit"
                cache.move_to_end(k)
            else:
                outcome = "expired" if k in cache else "evicted" if seen else "new"
                cache.pop(k, None)
                if len(cache) >= capacity:
                    cache.popitem(last=False)
                cache[k] = t + timedelta(minutes=minutes)
            order.append(k)
            want[i] = (k, distance, outcome)
        assert len(Counter(o for *_, o in want.values())) == 4
        found = requests.cached(frame(spark, accesses), capacity, minutes, walked, block)
        assert {r.id: (r.key, r.distance, r.outcome) for r in found.collect()} == want
    assert requests.cached(frame(spark, accesses).limit(0)).count() == 0
