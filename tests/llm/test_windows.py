"""Benchmark decontamination and substring dedup against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tidewell.llm import common, decontam, fmindex, queries, sketch, substrings, windows

from .conftest import documents
from .test_text_ops import by_row


def test_slices_keep_rows_and_bound_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (0, 5, 50, 3, 3, 3, 40, 1)]), pa.array(range(8))], names=["text", "n"])
    got = list(common.slices(iter([batch.slice(0, 3), batch.slice(3)]), limit=12))
    assert [n for b in got for n in b.column("n").to_pylist()] == list(range(8))
    assert all(sum(map(len, b.column("text").to_pylist())) <= 12 or b.num_rows == 1 for b in got), [b.column("text").to_pylist() for b in got]


def test_spans_and_hashes():
    texts = ["", "One two  one", "é東 a", "x", " ", "b"]
    data, offsets = common.text_bytes(pa.array(["skip", *texts]).slice(1))
    starts, ends, bounds = windows.spans(data, offsets, windows.NOT_BLANK)
    words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert words == [w for t in texts for w in t.split()] and bounds.tolist() == [0, 0, 3, 5, 6, 6, 7]
    h = windows.word_hashes(data, starts, ends)
    assert len(set(h.tolist())) == len(set(words)) == len(words)
    two = windows.run_hashes(np.tile(h, 2), 2, windows.MULTIPLIERS[0])
    assert (two[:6] == two[7:13]).all() and len(set(two[:7].tolist())) == 7


def test_fm_index():
    rng = np.random.default_rng(0)
    for _ in range(30):
        codes = rng.integers(1, rng.integers(2, 9), rng.integers(1, 200))
        plain = [*codes.tolist(), 0]
        assert fmindex.suffix_array(np.array(plain)).tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
        index = fmindex.Index(codes)
        for m in (1, 2, 4):
            pats = rng.integers(1, codes.max() + 1, (20, m))
            for p, a, b in zip(pats.tolist(), *index.search(pats, np.full(20, m)), strict=True):
                assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(codes)) if plain[i : i + m] == p]


def decontaminated(rows, bench, n=10):
    phrases = defaultdict(set)
    for item, text in bench:
        words = decontam.item_words(text)
        for i in range(max(1, len(words) - n + 1) if words else 0):
            phrases[tuple(words[i : i + n])].add("" if item is None else str(item))
    sizes = {len(p) for p in phrases}
    for doc_id, text in rows:
        words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        words = [w.encode() for w in words]
        hit, items = set(), set()
        for k in sizes:
            for i in range(len(words) - k + 1):
                if found := phrases.get(tuple(words[i : i + k])):
                    hit |= set(range(i, i + k))
                    items |= found
        yield doc_id, len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_op3(spark, edge, edge_rows, none, monkeypatch):
    sf = "/root/testdata/sf0.01"
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    found = queries.op3_benchmark_index(spark, sf)
    assert by_row(found, *COLUMNS) == Counter(decontaminated(documents(spark, sf), bench)) and found.filter("contaminated").count() > 3
    texts = dict(edge_rows)
    own = [(1, texts[4][-150:].upper()), (2, "two three"), (2, "One"), (3, None), (4, "!!"), (None, "東京"), (10, texts[5]), (10, texts[5]), (11, "absent words here")]
    items = spark.createDataFrame(own, "item_id long, text string")
    want = Counter(decontaminated(edge_rows, own))
    for block, long in ((100_000, 500_000), (7, 1000)):
        monkeypatch.setattr(decontam, "LONG_WORDS", long)
        assert by_row(decontam.digest(decontam.find_benchmark(edge, items, block=block)), *COLUMNS) == want
    assert decontam.find_benchmark(none, items).count() == 0
    assert {tuple(r) for r in decontam.digest(decontam.find_benchmark(edge, items.limit(0))).select("n_hit", "contaminated").collect()} == {(0, False)}


def test_removal(spark, edge, edge_rows):
    items = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    got = decontam.remove_benchmark(edge, items).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, "one " if t == "one two three" else t) for i, t in edge_rows)
    assert {r.key for r in got} == {"clash"} and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_removal_when_a_long_text_follows_a_small_remainder(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_BYTES", 64)
    monkeypatch.setattr(decontam, "BLOCK", 1)  # a pass for each item
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        rows = [(k, ("long words " * 20 if k in (3, 9) else "") + f"a{k} one two three b") for k in range(12)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        items = spark.createDataFrame([(1, "one two"), (2, "three")], "item_id long, text string")
        got = decontam.remove_benchmark(docs, items).collect()
    finally:
        spark.conf.set(name, before)
    assert Counter(map(tuple, got)) == Counter((k, t.replace("one two three", "")) for k, t in rows)


def deduped(rows, n=20):
    """Rows by (doc_id, text); equal rows are one document."""
    docs = sorted(set(rows), key=lambda r: (-1 if r[0] is None else r[0]))
    words = {r: re.findall("[^\\x20\\x09-\\x0D]+", r[1] or "") for r in docs}
    seen, gone = set(), defaultdict(set)
    for r in docs:
        for i in range(len(words[r]) - n + 1):
            k = tuple(words[r][i : i + n])
            gone[r] |= set(range(i, i + n)) if k in seen else set()
            seen.add(k)
    for r in rows:
        yield r[0], len(words[r]), len(gone[r]), hashlib.sha256(" ".join(w for i, w in enumerate(words[r]) if i not in gone[r]).encode()).hexdigest()


def test_op9(spark, edge, edge_rows, none, monkeypatch):
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    sf = "/root/testdata/sf0.01"
    found = queries.op9_substring_dedup(spark, sf)
    assert by_row(found, *columns) == Counter(deduped(documents(spark, sf))) and found.filter("n_removed > 0").count() > 20
    want = Counter(deduped(edge_rows))
    for cells in (8, 0.05):  # the smaller sketch lets nearly all windows through
        assert by_row(substrings.digest(substrings.dedup(edge, cells=cells)), *columns) == want
    assert by_row(substrings.digest(substrings.dedup(edge.repartition(5))), *columns) == want
    assert substrings.dedup(none).count() == 0


def test_sketch_loses_no_repeat(spark):
    rows = spark.range(0, 40_000, 1, 6).selectExpr("id as doc_id", "id as key", "cast(id % 30000 as string) as text")
    hashes = lambda part: windows.mixed(np.array(part.column("text").to_pylist()).astype(np.uint64) + np.uint64(1))
    groups = common.grouped(rows, 20_000)
    for cells, most, full in ((8, 0.05, 1), (0.5, 0.95, 1), (8, 0.05, 10**9)):  # the last in two steps
        passed, powers = Counter(), {}
        for r in groups.join(sketch.told(groups, hashes, 40_000, 1000, cells, full=full), "group", "left").collect():
            own = hashes(common.ungrouped(pa.scalar(bytes(r.data), pa.binary())))
            known, power = sketch.repeated(own, r.told and [{"places": bytes(t.places), "powers": bytes(t.powers)} for t in r.told])
            passed.update(own[sketch.among(own, known)].tolist())
            for h, p in zip(known.tolist(), power.tolist(), strict=True):
                assert powers.setdefault(h, p) == p >= 1  # equal hashes, equal answers
        may = np.array([passed[h] for h in windows.mixed(np.arange(1, 30_001, dtype=np.uint64)).tolist()])
        assert (may[:10_000] == 2).all() and (may[10_000:] > 0).mean() < most


def test_sketch_rows_stay_full_however_many_buckets(spark):
    """Bytes an entry where a task holds 2,000 entries for 100 buckets: in one step 20 a row, in two about 200, as if it held ten times as many."""
    rows = spark.range(0, 100_000, 1, 4).selectExpr("id as doc_id", "id as key", "cast(id as string) as text")
    hashes = lambda part: windows.mixed(np.array(part.column("text").to_pylist()).astype(np.uint64) + np.uint64(1))
    groups = common.grouped(rows, 5000)
    size = lambda held, full: sketch.entries(groups, hashes, 100, held, full).selectExpr("sum(length(groups) + length(sizes) + length(places) + length(prints) + length(counts) + 16)").first()[0] / 100_000
    one, two, ample = size(2000, 1), size(2000, 256), size(20_000, 1)
    print("bytes an entry in one step, in two, and with ten times the room:", one, two, ample)
    assert two < 1.25 * ample and one > 1.4 * two, (one, two, ample)


def test_groups_keep_rows(spark, edge, edge_rows, none):
    rows = common.id_text(edge).withColumn("key", common.text_key())
    for limit in (100, 1 << 20):
        groups = common.grouped(rows, limit).collect()
        assert len({g.group for g in groups}) == len(groups)
        parts = [common.ungrouped(pa.scalar(bytes(g.data), pa.binary())) for g in groups]
        assert Counter(x for p in parts for x in zip(p.column("doc_id").to_pylist(), p.column("text").to_pylist(), strict=True)) == Counter((i, t or "") for i, t in edge_rows)
    assert common.grouped(common.id_text(none).withColumn("key", common.text_key()), 100).count() == 0


def test_anchors_count_every_repeat():
    rng = np.random.default_rng(4)
    for _ in range(60):
        bounds = np.cumsum([0, *rng.integers(0, 40, 5)])
        words = windows.mixed(rng.integers(0, rng.integers(1, 4), bounds[-1]).astype(np.uint64))
        n = int(rng.integers(2, 9))
        counted, least = substrings.anchors(words, bounds, n)
        first = windows.run_starts(bounds, n)
        assert len(least) == len(first)
        times, seen = Counter(counted.tolist()), Counter(tuple(words[i : i + n].tolist()) for i in first)
        assert all(times[a] >= seen[tuple(words[i : i + n].tolist())] for a, i in zip(least.tolist(), first, strict=True))
