"""Substring dedup on windows of words: count-min prefilter, then exact grouping of what may repeat.

1. Texts are written once in groups. Every partition sketches its windows by their anchors (see `anchors`); the
   merged sketches, which lie in buckets of anchors, overestimate each window's count.
2. Windows that the sketch calls unique are unique. The others are grouped exactly on a 96-bit hash, in
   buckets that Spark shuffles, packed. Before the shuffle each task keeps only its own first of equal windows: a later one of the same
   task is removed whatever the others hold, so a hot passage sends one row a task.
3. Removed windows come back to their group of texts by a join, and covered words are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, sketch, windows

WINDOW = 20
SLICE_BYTES = 2 << 20
#: Windows that a task holds before it sends, and windows of the input for each bucket of hashes.
HELD, BUCKET = 700_000, 400_000
LEAST = np.iinfo(np.int64).min


def hashed(part: pa.RecordBatch, n: int, whole: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes to count and each window's anchor; if whole, also its first word, two hashes, its text and the place there."""
    data, offsets = common.text_bytes(part.column("text"))
    starts, ends, bounds = windows.spans(data, offsets, windows.NOT_BLANK)
    words = windows.word_hashes(data, starts, ends)
    counted, least = anchors(words, bounds, n)
    if not whole:
        return counted, least
    first = windows.run_starts(bounds, n)
    h1 = windows.run_hashes(words, n, windows.MULTIPLIERS[0])[first]
    h2 = windows.run_hashes(windows.word_hashes(data, starts, ends, windows.MULTIPLIERS[1]), n, windows.MULTIPLIERS[1])[first]
    doc = np.repeat(np.arange(len(bounds) - 1), np.maximum(np.diff(bounds) - n + 1, 0))
    return counted, least, first, h1, h2, doc, first - bounds[doc]


def sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each n consecutive values, by doubling."""
    reach = 1
    while 2 * reach <= n:
        x, reach = pick(x[:-reach], x[reach:]), 2 * reach
    return pick(x[: len(x) - (n - reach)], x[n - reach :]) if n > reach else x


def anchors(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes to count, anchor of each window): a window's anchor is the least hash of its runs of about half its words.

    Equal windows have equal anchors, and every place that gives some window its anchor is counted, so a window occurs
    at most as often as its anchor is counted; there are several times fewer anchors than windows.
    """
    k = n // 2 + 1
    first = windows.run_starts(bounds, n)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    runs = windows.run_hashes(words, k, windows.MULTIPLIERS[0])
    least = sliding(runs, n - k + 1, np.minimum)
    of_valid = np.zeros(len(runs) + n - k, np.uint64)  # 0 where no window of one text begins, shifted so that a place looks back
    of_valid[first + n - k] = least[first]
    return runs[sliding(of_valid, n - k + 1, np.maximum) == runs], least[first]


#: What travels for a bucket of hashes: texts (id, tag, number of the row, number of windows), then per window its first word and hash; no hash: already known as removed.
PACKED = ("ids", "tags", "rids", "counts", "places", "h1", "h2")
PACKED_SQL = "bucket int, " + ", ".join(f"{c} binary" for c in PACKED)
GONE_SQL = "group long, texts binary, places binary"


def pack(bucket: np.ndarray, doc: np.ndarray, place: np.ndarray, h1: np.ndarray | None, h2: np.ndarray | None, ids: np.ndarray, tags: np.ndarray, rids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each bucket; within it by text and place."""
    order = np.lexsort((place, doc, bucket))
    bucket, doc, place = bucket[order], doc[order], place[order]
    heads = np.flatnonzero(np.diff(bucket, prepend=-1))
    out: list[tuple] = []
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(bucket)], strict=True):
        first = a + np.flatnonzero(np.diff(doc[a:b], prepend=-1))
        own = doc[first]
        some = order[a:b]
        out.append((int(bucket[a]), ids[own].tobytes(), tags[own].astype("<i4").tobytes(), rids[own].tobytes(), common.planes(np.diff(np.append(first, b))), common.planes(place[a:b]), b"" if h1 is None else h1[some].tobytes(), b"" if h2 is None else h2[some].tobytes()))
    for at in range(0, len(out), 4000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 4000], strict=True), [pa.int32(), *[pa.binary()] * 7], strict=True)], names=["bucket", *PACKED])


def unpack(ids: bytes, tags: bytes, rids: bytes, counts: bytes, places: bytes, h1: bytes, h2: bytes) -> tuple[np.ndarray, ...]:
    """doc_id, tag, number of the row, place and hashes of every window of a row."""
    n = common.unplanes(counts)
    return np.repeat(np.frombuffer(ids, "<i8"), n), np.repeat(np.frombuffer(tags, "<i4"), n), np.repeat(np.frombuffer(rids, "<i8"), n), common.unplanes(places), np.frombuffer(h1, "<u8"), np.frombuffer(h2, "<u4")


def returned(rids: np.ndarray, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each group of texts: places of the texts there, and values (32 bits) for each."""
    order = np.lexsort((values[0], rids))
    rids, values = rids[order], [v[order] for v in values]
    heads = np.flatnonzero(np.diff(rids >> common.PLACE_BITS, prepend=-1))
    ends = np.append(heads[1:], len(rids))
    names = ["group", "texts", *(("places", "ends")[: len(values)])]
    for at in range(0, len(heads), 1000):
        some = list(zip(heads[at : at + 1000].tolist(), ends[at : at + 1000].tolist(), strict=True))
        texts = [common.planes(rids[a:b] & ((1 << common.PLACE_BITS) - 1)) for a, b in some]
        yield pa.RecordBatch.from_arrays([pa.array(rids[heads[at : at + 1000]] >> common.PLACE_BITS), pa.array(texts, pa.binary()), *(pa.array([common.planes(v[a:b]) for a, b in some], pa.binary()) for v in values)], names=names)


def own_numbers(group: int, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (null: the least), tags (31 bits of the text's hash) and row numbers of a group."""
    ids = np.asarray(part.column("doc_id").fill_null(LEAST))
    return ids, (np.asarray(part.column("key")) & 0x7FFFFFFF).astype(np.int64), (group << common.PLACE_BITS) + np.arange(part.num_rows)


def removed_windows(groups: DataFrame, n: int, total: int, cells: float = sketch.CELLS) -> DataFrame:
    """group and gone: texts (places in the group) and first words of the windows that start earlier elsewhere."""
    expected = total // 6
    buckets = max(64, expected // BUCKET)
    told = sketch.told(groups, lambda part: hashed(part, n)[0], expected // max(1, n // 4), cells=cells)

    def send(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, tags, rids = (np.concatenate(x) for x in zip(*(x[0] for x in held), strict=True))
        h1, h2, doc, place = (np.concatenate(x) for x in zip(*(x[1] for x in held), strict=True))
        by_id = np.lexsort((tags, ids))
        rank = np.empty(len(ids), np.int64)
        new = np.ones(len(ids), bool)
        new[1:] = (ids[by_id][1:] != ids[by_id][:-1]) | (tags[by_id][1:] != tags[by_id][:-1])
        rank[by_id] = np.cumsum(new) - 1  # repeats of a row share a rank
        at = (rank[doc] << 32) | place
        order = np.lexsort((at, h1))
        h1, h2, doc, place, at = h1[order], h2[order], doc[order], place[order], at[order]
        later = np.zeros(len(h1), bool)
        later[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        begins = np.flatnonzero(~later)
        head = np.repeat(begins, np.diff(np.append(begins, len(h1))))
        later &= at != at[head]
        first = np.flatnonzero(~later)  # a repeat of the first's row goes with it
        yield from pack((h1[first] % np.uint64(buckets)).astype(np.int64), doc[first], place[first], h1[first], h2[first], ids, tags, rids)
        gone = np.flatnonzero(later)
        if len(gone):
            run = rids[doc[gone]] >> 8  # texts that follow each other travel together
            yield from pack((windows.mixed(run.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), doc[gone], place[gone], None, None, ids, tags, rids)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, 0
        for group, part, answers in common.parts_of(batches, "told"):
            counted, least, first, h1, h2, doc, at = hashed(part, n, True)
            on = np.flatnonzero(sketch.among(least, sketch.repeated(counted, answers)[0]))
            held.append((own_numbers(group, part), (h1[on], (h2[on] >> np.uint64(32)).astype("<u4"), doc[on] + texts, at[on])))
            texts, size = texts + part.num_rows, size + len(on)
            if size >= HELD:
                yield from send(held)
                held, size, texts = [], 0, 0
        if size:
            yield from send(held)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of equal windows of a bucket all but the earliest are removed."""
        removed, size = [], 0
        for _, rows in common.by_key(batches, "bucket", PACKED):
            own = [unpack(*row) for row in rows]
            removed += [x[2:4] for x in own if not len(x[4])]
            own = [x for x in own if len(x[4])]
            size += sum(len(x[0]) for x in own)
            if own:
                doc_id, tag, rid, place, h1, h2 = (np.concatenate(x) for x in zip(*own, strict=True))
                order = np.lexsort((place, tag, doc_id, h2, h1))
                doc_id, tag, rid, place, h1, h2 = doc_id[order], tag[order], rid[order], place[order], h1[order], h2[order]
                same = np.zeros(len(h1), bool)
                same[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
                begins = np.flatnonzero(~same)
                head = np.repeat(begins, np.diff(np.append(begins, len(h1))))
                # Equal id, tag and place: a repeat of the row itself, not another start.
                on = same & ((doc_id != doc_id[head]) | (tag != tag[head]) | (place != place[head]))
                removed.append((rid[on], place[on]))
            if size > 2 * HELD:
                yield from returned(*(np.concatenate(x) for x in zip(*removed, strict=True)))
                removed, size = [], 0
        if removed:
            yield from returned(*(np.concatenate(x) for x in zip(*removed, strict=True)))

    asked = groups.join(told, "group").mapInArrow(candidates, PACKED_SQL)
    found = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(group, GONE_SQL)
    return found.groupBy("group").agg(F.collect_list(F.struct("texts", "places")).alias("gone"))


def covered(bounds: np.ndarray, gone: list[dict] | None, n: int) -> np.ndarray:
    """Which words of a group lie in removed windows."""
    step = np.zeros(bounds[-1] + 1, np.int32)
    for x in gone or ():
        first = bounds[common.unplanes(x["texts"])] + common.unplanes(x["places"])
        np.add.at(step, first, 1)
        np.add.at(step, first + n, -1)
    return np.cumsum(step[:-1]) > 0


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", cells: float = sketch.CELLS) -> DataFrame:
    """doc_id, n_words, n_removed and kept (kept words joined by one blank) of every row.

    "Earlier" is a smaller doc_id, then an earlier start; a null id counts as smallest. Of rows with one id but other
    texts, the one whose text hash is smaller counts as earlier. Repeated rows (equal id and text) are one document, so they don't
    remove each other, and each stays. Null, empty and short texts keep all their words.
    """
    rows = common.id_text(docs, id_col, text_col).withColumn("key", common.text_key())
    groups = common.grouped(rows, SLICE_BYTES)
    removed = removed_windows(groups, window, sketch.text_bytes(rows), cells)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, gone in common.parts_of(batches, "gone"):
            data, offsets = common.text_bytes(part.column("text"))
            starts, ends, bounds = windows.spans(data, offsets, windows.NOT_BLANK)
            keep, raw, out = ~covered(bounds, gone, window), data.tobytes(), []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                on = np.flatnonzero(keep[a:b]) + a
                out.append(b" ".join([raw[s:e] for s, e in zip(starts[on].tolist(), ends[on].tolist(), strict=True)]))
            sums = np.concatenate([[0], np.cumsum(~keep)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(sums[bounds[1:]] - sums[bounds[:-1]]), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return groups.join(removed, "group", "left").mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept string")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


