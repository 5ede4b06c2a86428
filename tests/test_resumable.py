"""The limiter on a stream, enrichment that is stopped and run again, listings as a data source, and the nested index."""

import json
import threading
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.operators import requests
from tidewell.sources import listing, manifest, nested_index
from tidewell.streaming import enrich, limits

CALLS: list = []


def test_stream_limits_as_the_batch_does_across_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", limits.STORE)
    start = datetime(2024, 1, 1)
    times = [0, 1, 2, 3, 20, 23, 24, 25, 49, 50, 47, 60]  # one comes late, within the hour's grace of its file
    rows = [(u, k * 10 + u, start + timedelta(hours=h, minutes=u)) for u in (1, 2) for k, h in enumerate(times)] + [(None, 900, start), (1, 901, None)]
    rows.sort(key=lambda r: (r[2] or start, r[1]))
    schema = "user_id long, event_id long, ts timestamp"
    want = {(r.user_id, r.event_id, r.window_start, r.allowed) for r in requests.rate_limited(spark.createDataFrame(rows, schema), 2, 24).collect()}
    cut = len(rows) // 2
    for n, part in enumerate((rows[:cut][::-1], rows[cut:], [(99, 999, start + timedelta(days=30))], [(99, 998, start + timedelta(days=31))])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = limits.limited(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 2, 24, "1 hour")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        assert q.exception() is None, n
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).filter("user_id < 99").select("user_id", "event_id", "window_start", "allowed").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def keys(spark, names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def test_enrichment_resumes(spark, tmp_path):
    path, log = str(tmp_path / "out"), str(tmp_path / "calls")

    def fetch(some):
        with open(log, "a") as f:
            f.write(json.dumps(some) + "\n")
        if some[0].startswith("busy"):
            raise enrich.Throttled("later")
        if some[0].startswith("bad"):
            raise ValueError("no such key")
        return [k.upper() for k in some]

    now = [0.0]
    go = dict(size=2, tries=3, wait=5.0, clock=lambda: now[0])
    assert enrich.step(keys(spark, ["a", "b", None, "a", "c"]), fetch, path, 0, **go)
    assert not enrich.step(keys(spark, ["never"]), fetch, path, 0, **go)  # the stream's batch again: nothing twice
    enrich.step(keys(spark, ["b", "busy1", "bad1"]), fetch, path, 1, **(go | {"size": 1}))
    done, dead, pending = enrich.state(spark, path)
    assert Counter(map(tuple, done.collect())) == {("a", "A"): 1, ("b", "B"): 1, ("c", "C"): 1}
    assert [tuple(r) for r in dead.collect()] == [("bad1", "no such key", 1)]
    assert [tuple(r) for r in pending.collect()] == [("busy1", 1, 5.0, "later")]
    waits = []
    enrich.drain(spark, fetch, path, sleep=lambda s: (waits.append(s), now.__setitem__(0, now[0] + s)), **go)
    assert waits == [5.0, 10.0]
    done, dead, pending = enrich.state(spark, path)
    assert Counter(map(tuple, dead.collect())) == {("bad1", "no such key", 1): 1, ("busy1", "later", 3): 1} and pending.count() == 0
    # Killed between its folders and its manifest: the step is written anew.
    done.limit(1).write.mode("overwrite").parquet(f"{path}/done/step=4")
    assert enrich.state(spark, path)[0].count() == 3
    enrich.step(keys(spark, ["a", "d"]), fetch, path, 2, **go)
    assert sorted(r.key for r in enrich.state(spark, path)[0].collect()) == ["a", "b", "c", "d"]
    asked = Counter(k for line in open(log) for k in json.loads(line))
    assert asked == {"a": 1, "b": 1, "c": 1, "d": 1, "bad1": 1, "busy1": 3}


def test_enrichment_of_a_stream_that_is_stopped(spark, tmp_path):
    path = str(tmp_path / "out")
    for n in range(3):
        keys(spark, [f"k{n}", f"k{n + 1}"]).coalesce(1).write.mode("append").text(str(tmp_path / "in"))
    stopped = threading.Event()

    def run(fail):
        stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")).withColumnRenamed("value", "key")

        def fetch(some):
            return [k + "!" for k in some]

        original = manifest.commit
        if fail:
            manifest.commit = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("stopped")) if a[2] == 1 else original(*a, **k)
        try:
            enrich.enrich(stream, fetch, path, str(tmp_path / "cp"), size=10).awaitTermination(120)
        except Exception:
            stopped.set()
        finally:
            manifest.commit = original

    run(True)
    assert stopped.is_set() and enrich.state(spark, path)[0].count() == 2
    run(False)
    assert Counter(r.key for r in enrich.state(spark, path)[0].collect()) == {f"k{n}": 1 for n in range(4)}


def test_manifests_are_whole_or_not_there(spark, tmp_path):
    path = str(tmp_path)
    assert manifest.current(spark, path) == (-1, {})
    for version in range(25):
        manifest.commit(spark, path, version, {"n": version})
    with pytest.raises(FileExistsError):
        manifest.commit(spark, path, 24, {"n": "other"})
    assert manifest.current(spark, path) == (24, {"n": 24})


def test_listings_as_a_data_source(spark, tmp_path):
    rows = [(f"20{t}", f"C{k}", k / 4, [k, k + 1]) for t in range(10, 15) for k in range(t)]
    schema = "term string, code string, price double, seats array<int>"
    spark.createDataFrame(rows, schema).write.partitionBy("term").json(str(tmp_path / "in"))
    listing.register(spark)
    read = lambda: spark.read.format("term_listing").schema(schema).option("path", str(tmp_path / "in")).load()
    as_rows = lambda df: Counter((r.term, r.code, r.price, tuple(r.seats)) for r in df.collect())
    want = Counter((t, c, p, tuple(s)) for t, c, p, s in rows)
    assert as_rows(read()) == want and read().rdd.getNumPartitions() == 5
    one = read().filter("term = '2011'")
    assert one.rdd.getNumPartitions() == 1 and as_rows(one) == Counter({r: n for r, n in want.items() if r[0] == "2011"})
    # Terms that come later are read by the stream alone, each once.
    stream = lambda: spark.readStream.format("term_listing").schema(schema).option("path", str(tmp_path / "in")).load()
    for _ in range(2):
        q = stream().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        spark.createDataFrame([("2020", "new", 1.0, [1])], schema).write.mode("append").partitionBy("term").json(str(tmp_path / "in"))
    assert as_rows(spark.read.schema(schema).parquet(str(tmp_path / "out"))) == want + Counter({("2020", "new", 1.0, (1,)): 1})


def flaky(term):
    """Fails at its first call in a process for each term; one term always."""
    CALLS.append(term)
    if CALLS.count(term) == 1 or term == "never":
        raise ConnectionError("no answer")
    return json.dumps({"results": [{"code": term + "1"}, {"code": term + "2", "title": "t", "term": "own"}]})


def test_failed_terms_are_asked_again(spark):
    listing.register(spark)
    load = lambda terms: spark.read.format("term_listing").option("service", "tests.test_resumable:flaky").option("terms", terms).load()
    assert Counter(map(tuple, load("a,b").collect())) == {("a", "a1", None): 1, ("own", "a2", "t"): 1, ("b", "b1", None): 1, ("own", "b2", "t"): 1}
    with pytest.raises(Exception, match="no answer"):
        load("never").collect()


def test_nested_index(spark, tmp_path):
    rows = [("b", [(1, "x")], [0.5, 1.0]), ("a", [], [0.0]), (None, [], [2.0]), ("c", [(2, "y"), (3, "z")], None)]
    records = spark.createDataFrame(rows, "code string, sections array<struct<n:int,s:string>>, vector array<double>")
    nested_index.write(records, "code", "vector", str(tmp_path / "i"))
    assert sorted(map(tuple, spark.read.schema("position long, code string").json(str(tmp_path / "i/ids")).collect())) == [(0, "a"), (1, "b"), (2, "c")]
    back = spark.read.parquet(str(tmp_path / "i/records"))
    assert {r.code: (r.position, len(r.sections)) for r in back.collect()} == {"a": (0, 0), "b": (1, 1), "c": (2, 2)}
    assert spark.read.json(str(tmp_path / "i/vectors")).filter("code = 'b'").select(F.element_at("vector", 1)).first()[0] == 0.5
