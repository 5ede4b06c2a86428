"""Byte-level dedup against a plain version, and suffix arrays against sorting."""

import hashlib
from collections import Counter

import numpy as np

from tidewell.llm import bytededup, queries, suffixes

from .conftest import documents
from .test_text_ops import by_row


def test_suffix_arrays(monkeypatch):
    rng = np.random.default_rng(0)
    codes = np.append(rng.integers(1, 3, 20_000), 0)
    want = suffixes.suffix_array(codes)
    monkeypatch.setattr(suffixes, "SINGLY", 1 << 40)  # no doubling at any level
    assert (suffixes.suffix_array(codes) == want).all()
    for k in range(300):
        codes = rng.integers(1, rng.integers(2, 6), rng.integers(1, 90))
        codes = np.append(np.repeat(codes, rng.integers(1, 8, len(codes))) if k % 4 == 0 else codes, 0)
        plain = codes.tolist()
        assert suffixes.suffix_array(codes).tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])


def deduped(rows, n):
    docs = {(i, t): (t or "").encode() for i, t in rows}
    seen, gone = Counter(), {}
    for raw in docs.values():
        seen.update(raw[i : i + n] for i in range(len(raw) - n + 1))
    for key, raw in docs.items():
        mark = np.zeros(len(raw) + 1, np.int32)
        for i in range(len(raw) - n + 1):
            if seen[raw[i : i + n]] > 1:
                mark[i] += 1
                mark[i + n] -= 1
        gone[key] = np.cumsum(mark[:-1]) > 0
    for i, t in rows:
        raw, out = docs[i, t], gone[i, t]
        spans = int(np.count_nonzero(np.diff(out.astype(np.int8), prepend=0) == 1))
        yield i, len(raw), int(out.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~out].tobytes()).hexdigest()


def test_op6(spark, sf, edge, edge_rows, none, monkeypatch):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    found = queries.op6_suffix_dedup(spark, sf)
    assert by_row(found, *columns) == Counter(deduped(documents(spark, sf), 200)) and found.filter("n_removed > 0").count() > 10
    for n, cells in ((200, 8), (100, 0.05)):
        assert by_row(bytededup.digest(bytededup.dedup(edge, n, cells=cells)), *columns) == Counter(deduped(edge_rows, n))
    monkeypatch.setattr(bytededup, "SLICE_BYTES", 2000)  # groups of few texts
    found = bytededup.dedup(edge.repartition(3), 64, hot=1, longest=40, held_bytes=2000)
    assert by_row(bytededup.digest(found), *columns) == Counter(deduped(edge_rows, 64))
    assert bytededup.dedup(none).count() == 0


def test_repeats_in_shards_of_few_pieces():
    rng = np.random.default_rng(3)
    base = rng.integers(97, 100, 400).astype(np.uint8).tobytes()
    pieces = sorted({base[a : a + 60] for a in rng.integers(0, 340, 20)})
    found = bytededup.repeats(pieces, [[np.array([[k, 0, k, 5]])] for k in range(len(pieces))], 30)
    got = {(r, at) for rid, first, last in found for r, a, b in zip(rid.tolist(), first.tolist(), last.tolist(), strict=True) for at in range(a, b)}
    times = Counter(p[i : i + 30] for p in pieces for i in range(31))
    assert got == {(k, 5 + j) for k, p in enumerate(pieces) for i in range(31) if times[p[i : i + 30]] > 1 for j in range(i, i + 30)}


def test_a_very_long_run_is_sorted_in_linear_time():
    import time

    seconds = []
    for n in (50_000, 200_000):
        start = time.process_time()
        sa = suffixes.suffix_array(np.append(np.full(n, 7), 0))
        seconds.append(time.process_time() - start)
        assert sa.tolist() == list(range(n, -1, -1))
    assert seconds[1] < 10 * seconds[0] + 0.5, seconds


def test_common_prefixes_in_text_order():
    rng = np.random.default_rng(6)
    for _ in range(60):
        data = rng.integers(0, 3, rng.integers(1, 120)).astype(np.uint8)
        sa = suffixes.suffix_array(np.append(data.astype(np.int64) + 1, 0))
        sa = sa[sa < len(data)]
        for own in (sa, sa[:: 2]):
            want = np.zeros(len(data), int)
            for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True):
                while want[b] < 20 and max(a, b) + want[b] < len(data) and data[a + want[b]] == data[b + want[b]]:
                    want[b] += 1
            assert suffixes.common_prefixes(data, own, 20).tolist() == want.tolist()
