"""Toxicity, near duplicates and the pipeline against plain versions."""

import itertools
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tidewell.llm import bpe, common, components, decontam, jaccard, queries, secrets, toxicity

from .conftest import documents
from .test_text_ops import by_row


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    field = toxicity.Field(np.zeros(1), 0.0, rng.normal(size=(2, 2)), np.zeros(4))
    bounds = np.array([0, 3, 3, 8, 9])
    e = rng.normal(size=9)
    got = field.marginals(e, bounds)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        mass, total = np.zeros(b - a), 0.0
        for states in itertools.product((0, 1), repeat=int(b - a)):
            w = np.exp(sum(e[a + i] * s for i, s in enumerate(states)) + sum(field.transition[x, y] for x, y in itertools.pairwise(states)))
            mass, total = mass + w * np.array(states), total + w
        assert np.allclose(got[a:b], mass / total)
    segments, used = np.zeros((2, 5)), np.zeros((2, 5), bool)
    segments[0, :3], used[0, :3], segments[1], used[1] = e[:3], True, e[3:8], True
    p, _ = toxicity.expectations(segments, field.transition, used)
    assert np.allclose(p[0, :3], got[:3]) and np.allclose(p[1], got[3:8])


def test_op7_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op7_toxic_spans(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = found.join(labels, "doc_id").filter("held_out").collect()
    true = sum(r.toxic and r.predicted for r in rows)
    # Of these 144 toxic documents ten were made junk of and show nothing that clean ones don't (see README).
    assert true / sum(r.predicted for r in rows) >= 0.9 and true / sum(r.toxic for r in rows) >= 0.89
    texts = dict(documents(spark, sf))
    words = Counter(texts[r.doc_id][a:b].lower() for r in rows if r.toxic and r.offsets for a, b in (map(int, x.split(":")) for x in r.offsets.split(",")))
    assert {"stupid", "idiot", "loser", "worthless"} <= {w for w, n in words.items() if n > 10}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows) and found.count() == 10_000


def test_toxic_spans(spark, edge, edge_rows, none):
    texts = [f"all fine words here é you {k % 9} creature" for k in range(300)] + [f"é you vile vile creature {k % 9}" for k in range(60)]
    field = toxicity.fit(texts, np.array([0] * 300 + [1] * 60), 1 / 6)
    scores, spans = toxicity.scored(pa.array(["é you VILE, vile thing", "fine", "", "🙂🙂 vile", "VILE VILE"]), field)
    said = lambda own: [(s["start"], s["end"]) for s in own]
    assert scores[0] >= 0.7 > max(scores[1:3]) and [said(x) for x in spans] == [[(6, 16)], [], [], [(3, 7)], [(0, 9)]]
    rows = [(1, None), (2, ""), (3, "vile"), (3, "vile"), (None, "vile"), (4, "x" * 300_000 + " vile")]
    found = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()
    assert Counter((r.doc_id, tuple((s.start, s.end) for s in r.spans)) for r in found) == Counter([(1, ()), (2, ()), (3, ((0, 4),)), (3, ((0, 4),)), (None, ((0, 4),)), (4, ((300_001, 300_005),))])
    scored = toxicity.score_documents(edge, field)
    assert Counter(r.doc_id for r in scored.collect()) == Counter(i for i, _ in edge_rows)


def test_segments_keep_a_share_for_clean_ones():
    labels, bounds = np.zeros(32 * 100, np.int8), np.array([0, 32 * 100])
    labels[: 32 * 80 : 32] = 1
    starts, stops = toxicity.segments(labels, bounds, 40, 0.25)
    assert len(starts) == 40 and sum(labels[a:b].any() for a, b in zip(starts, stops, strict=True)) == 30 and (stops - starts == 32).all()
    assert len(toxicity.segments(labels, bounds, 1000, 0.25)[0]) == 100 and len(toxicity.segments(labels[:0], np.array([0, 0]), 5, 0.5)[0]) == 0


def test_fit_of_nothing(spark, none):
    scores = toxicity.score_documents
    field = toxicity.fit([], np.zeros(0), 0.5)
    assert scores(none, field).count() == 0
    assert toxicity.score_documents(none, field).count() == 0 and toxicity.drop_toxic(none, field).count() == 0
    assert toxicity.fit([], np.zeros(0), 0.5).score(np.zeros(0), np.array([0, 0])).tolist() == pytest.approx([0.5])


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def grouped(rows):
    sets = [shingles(t) for _, t in rows]
    forest = jaccard.Forest(len(rows))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            forest.union(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[forest.find(k)] = min(i, least.get(forest.find(k), i))
    return Counter((i, len(sets[k]), least.get(forest.find(k))) for k, (i, _) in enumerate(rows))


def near_rows(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    out = []
    for _ in range(n):
        base = rng.choices(words, k=rng.randint(3, 90))
        for _ in range(rng.choice((1, 1, 1, 2, 6, 25))):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append((len(out), " ".join(own + rng.choices(words, k=rng.randint(0, 4)))))
    return out


def test_op10(spark, sf, edge, edge_rows, none):
    columns = ("doc_id", "n_shingles", "component_id")
    assert by_row(queries.op10_jaccard_join(spark, sf), *columns) == grouped(documents(spark, sf))
    assert by_row(jaccard.near_duplicates(edge), *columns) == grouped(edge_rows)
    rows = near_rows(60, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for cells, tile in ((8, 256), (0.05, 4)):  # the smaller sketch lets nearly all shingles through
        assert by_row(jaccard.near_duplicates(docs, cells=cells, tile=tile), *columns) == grouped(rows)
    # Hashes of sets of three bits alone: nearly all are equal, and sets are told apart all the same.
    assert by_row(jaccard.near_duplicates(docs, tile=4, bits=3), *columns) == grouped(rows)
    assert jaccard.near_duplicates(none).count() == 0


def test_near_duplicate_rows_go_by_id_and_text(spark):
    rng = random.Random(9)
    clean = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60)) for _ in range(9)]
    near = lambda k: clean[k] + " more words"
    kept = [(1, clean[0]), (2, clean[1]), (2, clean[2]), (None, clean[3]), (None, clean[4]), (4, clean[5]), (5, clean[6]), (None, None), (None, None), (None, ""), (None, " \t"), (6, None), (6, ""), (7, clean[7]), (8, clean[8])]
    gone = [(2, near(0)), (None, clean[0]), (None, near(3)), (4, near(5)), (4, clean[5]), (5, clean[6]), (6, ""), (9, clean[8]), (None, clean[8])]
    rows = [(i, t, k) for k, (i, t) in enumerate(kept + gone)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3), None).collect()
    either = {k: min(clean[k], near(k), key=lambda t: key[t]) for key in [{r.text: r.k for r in spark.createDataFrame([(t,) for j in (3, 5) for t in (clean[j], near(j))], "text string").selectExpr("text", "xxhash64(text) k").collect()}] for k in (3, 5)}
    want = Counter((i, either[3] if t == clean[3] else either[5] if t == clean[5] else t) for i, t in kept)
    assert Counter((r.doc_id, r.text) for r in got) == want


def test_written_tables_can_be_dropped(spark):
    one = common.written(spark.range(5))
    assert one.count() == 5
    folder = one.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    common.forget(one, spark.range(3))
    assert not os.path.exists(folder)


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(5, 5), (1, 2), (1, 2)]
    forest = jaccard.Forest(200)
    for a, b in edges:
        forest.union(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: forest.find(x) for x in nodes}


def test_pipeline(spark, edge, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    field = toxicity.trained(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = dict(zip(rows, toxicity.scored(pa.array([r.text for r in rows.values()]), field)[0], strict=True))
    kept = [(i, r.text) for i, r in rows.items() if scores[i] < 0.7]
    kept = [(i, rows[i].text) for i, _, c in grouped(kept) if i == c]
    bench = [decontam.item_words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    phrases = {tuple(w[k : k + 10]) for w in bench for k in range(max(1, len(w) - 9))}
    own, want = bpe.codec(bpe.vocabulary()), {}
    for i, text in kept:
        words = decontam.item_words(text)
        runs = decontam.merged([(k, k + 10) for k in range(len(words) - 9) if tuple(words[k : k + 10]) in phrases])
        text, out, done = decontam.remove_spans(text, runs), [], 0
        for _, a, b, _ in secrets.scan(text):
            out += [text[done:a], "[SECRET]"] if a >= done else []
            done = max(done, b)
        want[i] = own.encode("".join(out) + text[done:])
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert {k: bytes(v) for k, v in got.items()} == want and 0 < len(want) < len(rows)
    edge.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == edge.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 5
