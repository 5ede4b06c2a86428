"""What a task holds doesn't grow with the tables."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tidewell.functions import markup
from tidewell.operators import counting, index, matching, retrieval, search


def test_postings_by_block_move_texts_and_no_n_grams(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(k * 7, " ".join(rng.choices(["aa", "bb", "cc", "dd"], k=30))) for k in range(40)] + [(None, "aa bb"), (0, "aa bb")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(retrieval, "TASK_BYTES", 500)
    found = retrieval.postings(frame, ["dd"], 2, block=100)
    merged = retrieval.merged(found)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(block") == 1 and plan.count("Exchange ") == 1, plan
    assert found.rdd.getNumPartitions() > 4  # as many as the texts ask for
    plain = retrieval.postings(frame, ["dd"], 2)
    assert Counter(map(tuple, found.select("term", "doc_id", "freq").collect())) == Counter(map(tuple, plain.collect()))
    lists = lambda i: Counter(map(tuple, index.ranked(i, 10, 20).collect()))
    assert lists(found) == lists(plain)


def test_uncommon_words_of_repeated_and_null_keys(spark):
    rng = random.Random(7)
    for keys in (range(30), [rng.choice([None, *range(12)]) for _ in range(30)]):
        docs = [(k, rng.choices("abcdefgh", [9, 7, 5, 3, 1, 1, 1, 1], k=rng.randint(0, 6))) for k in keys]
        freq = Counter(w for _, words in docs for w in words)
        df = {w: len({k for k, words in docs if w in words and k is not None}) for w in freq}
        frame = spark.createDataFrame(docs, "k long, w array<string>")
        found = counting.uncommon(frame, "k", "w", 3, 10)
        assert dict(map(tuple, found.collect())) == {w: n for w, n in freq.items() if 10 * df[w] <= 3 * len(docs)}


def test_phrases_meet_texts_without_python(spark):
    rows = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "b a"), (3, None)], "id long, text string")
    phrases = spark.createDataFrame([("X", "a b"), ("Y", "b c d"), ("Y", "a"), ("Z", "a b d")], "code string, phrase string")
    for size in (1 << 20, 0):
        found = matching.matched(rows, "text", phrases, size)
        assert "InArrow" not in found._jdf.queryExecution().executedPlan().toString()
        assert Counter((r.id, r.code) for r in found.collect()) == {(1, "X"): 2, (1, "Y"): 2, (2, "Y"): 1}


def test_search_scores_a_bounded_number_at_once(monkeypatch):
    class One:
        value = (np.random.default_rng(1).random((300, 4)), np.array([(q, -1, -1, 5) for q in range(300)]), [], [])

    sizes = []
    rounded = np.round
    monkeypatch.setattr(search, "CELLS", 3000)
    monkeypatch.setattr(np, "round", lambda x, n: sizes.append(x.size) or rounded(x, n))
    vectors = np.random.default_rng(2).random((1000, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(list(vectors))], names=["key", "vector"])
    out = pa.Table.from_batches(search._ranked(One, None, "key")(iter([batch])))
    assert max(sizes) <= 3000
    scores = rounded(vectors @ One.value[0].T, 12)
    want = {(q, int(k)) for q in range(300) for k in np.lexsort((np.arange(1000), -scores[:, q]))[:5]}
    assert set(zip(out["job"].to_pylist(), out["key"].to_pylist(), strict=True)) == want and out.num_rows == 1500


def test_pages_are_answered_few_at_once(spark, monkeypatch):
    monkeypatch.setattr(markup, "PAGES", 2)
    pages = spark.createDataFrame([(k, "https://h.example/a", f'<a href="p{k}">x</a>' * k) for k in range(7)] + [(7, None, "<a href=x>"), (8, "u", None)], "page_id long, url string, html string")
    found = markup.links(pages)
    assert Counter(r.page_id for r in found.collect()) == {k: k for k in range(1, 7)}
    assert "text string" not in found._jdf.queryExecution().analyzed().toString() and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
