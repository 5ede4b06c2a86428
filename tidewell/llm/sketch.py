"""Count-min sketches of 64-bit hashes, made per partition, merged by Spark bucket by bucket, and asked where they lie.

Every partition reduces the hashes of its groups of texts to (hash, count) and sends them, packed, to buckets of
hashes. A bucket merges what all partitions sent into the rows of a count-min sketch and answers each group for its
own hashes: which of them are counted at least twice, and about how often. A count is never less than the true one,
so no repeat is lost, and equal hashes get equal answers. Buckets grow in number with the input and not in size; no
sketch is broadcast or brought to the driver. A hash that all texts have is one entry for each group.

A packed row is worth its overhead from some hundred entries on. Where there are more buckets than a task can fill rows
for, entries go to ranges of buckets first, and there, gathered from many tasks, to their buckets: two shuffles of full
rows in place of one of nearly empty ones, whatever the number of buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, windows

#: An entry is told by 32 bits of its hash, besides its bucket. Rows of a sketch, cells of a row for each entry, entries of a bucket (expected), and entries that a task holds before it sends.
DEPTH, CELLS, BUCKET, HELD = 2, 8, 1_000_000, 1_500_000
#: Entries of a row on average, below which buckets are dealt in two steps.
FULL = 256
_SENT = ("groups", "sizes", "places", "prints", "counts")
_SQL = "bucket int, " + ", ".join(f"{c} binary" for c in (*_SENT, "keys"))


def estimates(prints: np.ndarray, counts: np.ndarray, cells: float = CELLS) -> np.ndarray:
    """Of each entry the least of its cells' sums: its hash's count, or more."""
    bits = max(4, int(cells * len(prints) - 1).bit_length())
    out = None
    for row in range(DEPTH):
        cell = (prints * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[row]) >> np.uint64(64 - bits)).astype(np.int64)
        sums = np.bincount(cell, weights=counts, minlength=1 << bits)[cell]
        out = sums if out is None else np.minimum(out, sums)
    return out.astype(np.int64)


def steps(places: np.ndarray, heads: np.ndarray = np.zeros(1, np.int64)) -> bytes:
    """Places that ascend from each head on, by their differences."""
    out = np.diff(places, prepend=0)
    out[heads] = places[heads]
    return common.planes(out)


def unsteps(data: bytes, heads: np.ndarray = np.zeros(1, np.int64)) -> np.ndarray:
    out = common.unplanes(data)
    sums = np.cumsum(out)
    before = sums[heads] - out[heads]
    return sums - np.repeat(before, np.diff(np.append(heads, len(out))))


def packed(group: np.ndarray, place: np.ndarray, prints: np.ndarray, counts: np.ndarray, key: np.ndarray, to: np.ndarray, names: int, keyed: bool) -> Iterator[pa.RecordBatch]:
    """Entries as rows, one for each of the `names` places they go to (`to`); a group's entries lie together and in order. With their buckets, if they have further to go."""
    order = np.argsort(to, kind="stable")
    bounds = np.searchsorted(to[order], np.arange(names + 1))
    rows = []
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        some = order[bounds[b] : bounds[b + 1]]
        mine = group[some]
        heads = np.flatnonzero(np.concatenate([[True], (mine[1:] != mine[:-1]) | (place[some][1:] <= place[some][:-1])]))
        sizes = np.diff(np.append(heads, len(some)))
        rows.append((b, mine[heads].tobytes(), common.planes(sizes), steps(place[some], heads), prints[some].astype("<u4").tobytes(), common.planes(counts[some]), common.planes(key[some]) if keyed else b""))
    for at in range(0, len(rows), 500):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 500], strict=True), [pa.int32(), *[pa.binary()] * 6], strict=True)], names=["bucket", *_SENT, "keys"])


def unpacked(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, place, print, count) of a row's entries."""
    sizes = common.unplanes(row[1])
    return np.repeat(np.frombuffer(row[0], "<i8"), sizes), unsteps(row[2], np.cumsum(sizes) - sizes), np.frombuffer(row[3], "<u4"), common.unplanes(row[4])


def entries(groups: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], buckets: int, held: int = HELD, full: int = FULL) -> DataFrame:
    """The groups' entries as rows of a bucket each, dealt by bucket, in one step or two."""
    fan = 1 if held >= full * buckets else int(np.ceil(np.sqrt(buckets)))  # buckets of a range

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            group, hash_, counts = (np.concatenate(x) for x in zip(*((np.full(len(own), g), own, n) for g, own, n in parts), strict=True))
            place = windows.ragged(np.array([len(own) for _, own, _ in parts]))
            mixed = windows.mixed(hash_ ^ np.uint64(0x5851F42D4C957F2D))
            key = (mixed % np.uint64(buckets)).astype(np.int64)
            to = (key // fan).astype(np.uint16 if buckets <= fan << 16 else np.uint32)
            yield from packed(group, place, (mixed >> np.uint64(32)).astype("<u4"), counts, key, to, -(-buckets // fan), fan > 1)

        for group, part in common.parts_of(batches):
            own, counts = np.unique(hashes(part), return_counts=True)
            if len(own):
                parts.append((group, own, counts))
                size += len(own)
            if size >= held:
                yield from sent()
                parts, size = [], 0
        if size:
            yield from sent()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of a range of buckets, gathered from many tasks, on to their buckets."""
        for range_, rows in common.in_runs(batches, "bucket", (*_SENT, "keys"), lambda row: len(row[3]) // 4, held):
            group, place, prints, counts = (np.concatenate(x) for x in zip(*map(unpacked, rows), strict=True))
            key = np.concatenate([common.unplanes(r[5]) for r in rows])
            for part in packed(group, place, prints, counts, key, (key - range_ * fan).astype(np.uint16), fan, False):
                yield part.set_column(0, "bucket", pa.array(np.asarray(part.column("bucket")) + range_ * fan, pa.int32()))

    sent_ = groups.mapInArrow(partial, _SQL).repartition("bucket").sortWithinPartitions("bucket")
    return sent_ if fan == 1 else sent_.mapInArrow(dealt, _SQL).repartition("bucket").sortWithinPartitions("bucket")


def told(groups: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], expected: int, bucket: int = BUCKET, cells: float = CELLS, held: int = HELD, full: int = FULL) -> DataFrame:
    """group, told: for each group, where in its distinct hashes, ascending, those lie that are counted at least twice, and the power of two of their counts.

    `hashes` gives a group's hashes, as often as they count; groups of which no hash repeats have no row.
    """

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in common.by_key(batches, "bucket", _SENT):
            group, place, prints, counts = (np.concatenate(x) for x in zip(*map(unpacked, rows), strict=True))
            counts = estimates(windows.mixed(prints.astype(np.uint64)), counts, cells)
            on = np.flatnonzero(counts >= 2)
            on = on[np.lexsort((place[on], group[on]))]
            group, place, power = group[on], place[on], np.ceil(np.log2(np.maximum(counts[on], 2))).astype(np.uint8)
            heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(on) else on
            ends = np.append(heads[1:], len(on))
            for k in range(0, len(heads), 1000):
                some = list(zip(heads[k : k + 1000].tolist(), ends[k : k + 1000].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(group[heads[k : k + 1000]]), pa.array([steps(place[a:b]) for a, b in some], pa.binary()), pa.array([power[a:b].tobytes() for a, b in some], pa.binary())], names=["group", "places", "powers"])

    found = entries(groups, hashes, int(max(64, expected // bucket)), held, full).mapInArrow(answered, "group long, places binary, powers binary")
    return found.groupBy("group").agg(F.collect_list(F.struct("places", "powers")).alias("told"))


def repeated(hashes: np.ndarray, answers: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """(those of a group's hashes that may repeat, distinct and ascending; the powers of two of their counts)."""
    own = np.unique(hashes)
    if not answers:
        return own[:0], np.zeros(0, np.uint8)
    place = np.concatenate([unsteps(a["places"]) for a in answers])
    power = np.concatenate([np.frombuffer(a["powers"], np.uint8) for a in answers])
    order = np.argsort(place)
    return own[place[order]], power[order]


def among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the hashes are known (distinct and ascending)."""
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """All bytes of text, by which the number of buckets is chosen."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
