"""The stored index: segments, merges, lookups by folder, literal texts, and lists in order of frequency."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tidewell.operators import index, retrieval
from tidewell.sources import manifest

STOP = ["the", "of"]


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["loser", "closer", "losing", "ring", "thing", "other", "ab", "the", "of", "License"]
    return [(k, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for k in range(n)] + [(n, None), (n + 1, "")]


def rows(df):
    return Counter(map(tuple, df.select("term", "doc_id", "freq").collect()))


def test_segments_merge_and_count_once(spark, tmp_path):
    path, docs = str(tmp_path), texts(60)
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    for k in range(5):
        assert index.add(frame(docs[k * 10 : k * 10 + 12]), STOP, path, batch=k)
        levels = Counter(s["level"] for s in manifest.current(spark, path)[1]["segments"])
        assert all(n < index.FAN for n in levels.values())
    assert levels == {1: 1, 0: 1}
    assert not index.add(frame(docs), STOP, path, batch=4)
    again = Counter()
    for k in range(5):
        again += rows(retrieval.postings(frame(docs[k * 10 : k * 10 + 12]), STOP))
    want = Counter()
    for (term, doc, freq), n in again.items():
        want[term, doc] += freq * n
    assert {(t, d): f for t, d, f in rows(index.current(spark, path))} == want
    # A run that was stopped before its manifest leaves nothing that is read.
    index._write(retrieval.postings(frame([(99, "left over")]), STOP).withColumn("word", F.lit("left")), f"{path}/stopped")
    assert {(t, d): f for t, d, f in rows(index.current(spark, path))} == want


def test_lookups_read_few_folders(spark, tmp_path):
    path, docs = str(tmp_path), texts(80, 2)
    for part in (docs[:50], docs[50:]):
        index.add(spark.createDataFrame(part, "doc_id long, text string"), STOP, path)
    whole = rows(index.current(spark, path))
    pick = lambda test: Counter({r: n for r, n in whole.items() if test(r[0])})
    assert whole == rows(retrieval.postings(spark.createDataFrame(docs, "doc_id long, text string"), STOP))
    assert rows(index.terms(spark, path, ["loser", "loser ring", "nowhere"])) == pick(lambda t: t in ("loser", "loser ring"))
    for phrase in ("Loser the ring", "ab", "the"):
        words = index.asked(spark, phrase, STOP)
        found = index.containing(spark, path, words)
        assert rows(found) == pick(lambda t: bool(words) and f" {' '.join(words)} " in f" {t} "), phrase  # noqa: B023
        if words:
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [isnotnull(folder" in plan or "folder#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    for text in ("oser", "ng th", "ab", " ring", "g thing o", "zzz", " "):
        assert rows(index.literal(spark, path, text)) == pick(lambda t: bool(text.strip()) and text in t), text  # noqa: B023
    chosen, index.CHOSEN = index.CHOSEN, 0
    assert rows(index.literal(spark, path, "ing")) == pick(lambda t: "ing" in t)
    index.CHOSEN = chosen


def test_stemmed_lookups(spark, tmp_path):
    path = str(tmp_path)
    index.add(spark.createDataFrame([(1, "Licensing the licenses"), (2, "a licensed ring"), (3, "lice")], "doc_id long, text string"), STOP, path, stemmed=True)
    assert {r.doc_id for r in index.containing(spark, path, index.asked(spark, "the license", STOP, stemmed=True)).collect()} == {1, 2}


def test_lists_in_order_of_frequency(spark):
    rng = random.Random(3)
    own = [(t, d, rng.randint(1, 5)) for t, n in (("hot", 57), ("cold", 3), ("even", 20)) for d in range(n)]
    frame = spark.createDataFrame(own, "term string, doc_id long, freq long").repartition(5)
    want = set()
    for term in ("hot", "cold", "even"):
        some = sorted((-f, d) for t, d, f in own if t == term)
        for b in range(0, len(some), 10):
            part = some[b : b + 10]
            want.add((term, b // 10, len(part), -sum(f for f, _ in part), " ".join(f"{d}:{-f}" for f, d in part)))
    for hot in (10**6, 30):
        assert set(map(tuple, index.ranked(frame, 10, hot).collect())) == want


def test_stored_index_is_smaller_than_its_n_grams(spark, tmp_path):
    """N-grams are counted from the texts, so what is stored has a row for each word of a text at most."""
    rng = random.Random(4)
    docs = [(k if k % 9 else None, " ".join(f"{a}{b}" for a, b in zip(rng.choices("abcdefgh", k=40), rng.choices("ijklmnop", k=40), strict=True))) for k in range(50)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    index.add(frame, STOP, str(tmp_path))
    (segment,) = manifest.current(spark, str(tmp_path))[1]["segments"]
    assert spark.read.parquet(f"{tmp_path}/{segment['name']}/postings").count() <= 50 * 40
    whole = rows(retrieval.postings(frame, STOP))
    assert any(doc is None for _, doc, _ in whole)
    listed = index.LISTED
    for index.LISTED in (listed, 0):  # texts of listed documents, and all texts
        assert rows(index.containing(spark, str(tmp_path), ["ai"])) == Counter({r: n for r, n in whole.items() if " ai " in f" {r[0]} "})
        assert rows(index.literal(spark, str(tmp_path), "i b")) == Counter({r: n for r, n in whole.items() if "i b" in r[0]})
    index.LISTED = listed
