"""Periodic runs in the words of documents, and texts with runs collapsed to their first period.

Each task reads its documents once; nothing is shuffled. Windows of words that occur twice in a document are found for a
whole batch at once: a run of at least `LEAST` words and three periods lies within consecutive words that such windows
cover, so only these stretches are sorted (lyndon.py). A stretch that holds a run holds all of it, and what lies outside
all stretches can't be in one: no run is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, lyndon, windows

#: Words and periods of a run at least.
LEAST, TIMES = 24, 3
#: A run of n words and period q has n - q >= 16 words that occur again q words on.
WINDOW = LEAST - LEAST // TIMES
#: Bytes of text handled at once (a longer text alone).
SLICE_BYTES = 4 << 20
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("text", pa.string())])


def rewritten(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place, for one document in ten whose tail repeats itself; None for the others, and for those without id or words."""
    if doc_id is None or not n:
        return None
    g, tenth = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if tenth:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def stretches(words: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int]]]:
    """Of each text (words between two bounds) the maximal stretches covered by windows of WINDOW words that occur at least twice in it."""
    starts = windows.run_starts(bounds, WINDOW)
    out: list[list[tuple[int, int]]] = [[] for _ in bounds[1:]]
    if not len(starts):
        return out
    text = np.searchsorted(bounds, starts, "right") - 1
    hashes = windows.run_hashes(windows.mixed(words.astype(np.uint64)), WINDOW, windows.MULTIPLIERS[0])[starts] ^ windows.mixed(text.astype(np.uint64) + np.uint64(1))
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    first = starts[twice]
    if not len(first):
        return out
    begins = np.concatenate([[True], (first[1:] > first[:-1] + WINDOW) | (text[twice][1:] != text[twice][:-1])])
    heads = np.flatnonzero(begins)
    lasts = first[np.append(heads[1:], len(first)) - 1] + WINDOW
    for t, s, e in zip(text[twice][heads].tolist(), first[heads].tolist(), lasts.tolist(), strict=True):
        out[t].append((s, e))
    return out


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = True) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start, then period) and text: the words that stay, joined by a blank.

    Words are maximal stretches without blank and 09 to 0D. A word goes if a run contains it after the run's first period.
    `planted`: one document in ten, by its id, has its tail rewritten as a repeated piece first; rows without id have not.
    A null or empty text has no words and no runs; repeated rows give repeated results; other columns aren't read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, limit=SLICE_BYTES):
            ids, data, count = part.column("doc_id").to_pylist(), part.column("text"), 0
            names: dict[bytes, int] = {}
            texts, numbers, bounds = [], [], [0]
            for doc_id, text in zip(ids, data, strict=True):
                own = text.as_buffer().to_pybytes().split()  # at blank and 09 to 0D
                texts.append(own)
                number = np.fromiter((names.setdefault(w, len(names)) for w in own), np.int64, len(own))
                place = rewritten(doc_id, len(own)) if planted else None
                if place is not None:
                    number, texts[-1] = number[place], [own[x] for x in place.tolist()]
                numbers.append(number)
                count += len(own)
                bounds.append(count)
            words = np.concatenate(numbers)
            found, kept = [], []
            for own, base, pieces in zip(texts, bounds, stretches(words, np.array(bounds)), strict=False):
                runs = [(s - base + at, n, p) for s, e in pieces for at, n, p in lyndon.runs(words[s:e], LEAST, TIMES)]
                found.append(runs)
                if runs:
                    depth = np.zeros(len(own) + 1, np.int64)
                    for at, n, p in runs:
                        depth[at + p] += 1
                        depth[at + n] -= 1
                    own = [own[x] for x in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
                kept.append(b" ".join(own).decode())
            structs = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found]
            yield common.batch(_OUT, doc_id=part.column("doc_id"), n_words=np.diff(bounds), runs=structs, text=kept)

    rows = common.id_text(docs, id_col, text_col)
    return rows.mapInArrow(work, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")


def digest(found: DataFrame) -> DataFrame:
    """One row a document: how many runs, the one of greatest exponent (ties: smallest start, then period), and hashes of all runs and of the words that stay."""
    better = lambda r, b: b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"])
    runs = F.col("runs")
    best = F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda b, r: F.when(better(r, b), r).otherwise(b))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("text"), 256).alias("collapsed_sha256"), "n_words")
    milli = F.expr("(1000 * b.length) div b.period")
    return rows.select("doc_id", "n_runs", F.col("b.start").alias("start"), F.col("b.length").alias("length"), F.col("b.period").alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
