"""Exact byte-level dedup: suffix arrays of shards, dealt so that equal windows meet.

A window of n bytes has an anchor, the least hash of its short runs of bytes, so equal windows have equal
anchors. A sketch of all anchors tells windows whose anchor occurs once: these are unique. Runs of the
other windows travel as segments to the shard of their anchor; windows of a very frequent anchor are dealt by a
second anchor of theirs too, so that no shard gets them all. A segment that a task meets more than once is a repeat
at once, and is sent once. A shard's distinct segments are sorted as suffixes (induced sorting); windows that share
n bytes with a neighbour in that order, or whose whole segment came more than once, are repeats. The covered bytes
go back to their group of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, sketch, substrings, suffixes, windows

WINDOW, RUN = 200, 32
SLICE_BYTES, SHARD_BYTES, HELD_BYTES, LONGEST = 1 << 20, 4 << 20, 24 << 20, 2000
#: Anchors counted at least 2**HOT times are dealt by a second anchor too.
HOT = 12
#: What travels: distinct segments with their keys, and how often and where each was found (id, tag, row number, first byte);
#: not at all: it came more than once, and its texts know. Rows without segments bring back such runs.
_COLUMNS = ("keys", "lengths", "text", "counts", "ids", "tags", "rids", "starts")
PACKED_SQL = "bucket int, " + ", ".join(f"{c} binary" for c in _COLUMNS)
GONE_SQL = "group long, texts binary, places binary, ends binary"


def anchors(data: np.ndarray, offsets: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes to count, first byte of each window, its anchor); as for windows of words."""
    first = windows.run_starts(offsets, n)
    if not len(first):
        return np.zeros(0, np.uint64), first, np.zeros(0, np.uint64)
    runs = windows.run_hashes(data.astype(np.uint64) + np.uint64(1), k, windows.MULTIPLIERS[0])
    least = substrings.sliding(runs, n - k + 1, np.minimum)
    of_valid = np.zeros(len(runs) + n - k, np.uint64)
    of_valid[first + n - k] = least[first]
    return runs[substrings.sliding(of_valid, n - k + 1, np.maximum) == runs], first, least[first]


def segments(data: np.ndarray, offsets: np.ndarray, answers: list[dict] | None, n: int, k: int, hot_power: int = HOT, longest: int = LONGEST) -> tuple[np.ndarray, ...]:
    """(text, first byte, end, key) of runs of windows of one key that may repeat."""
    counted, first, least = anchors(data, offsets, n, k)
    known, powers = sketch.repeated(counted, answers)
    may = sketch.among(least, known)
    first, least = first[may], least[may]
    if not len(first):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    hot = powers[np.searchsorted(known, least)] >= hot_power
    if hot.any():
        runs = windows.run_hashes(data.astype(np.uint64) + np.uint64(1), k, windows.MULTIPLIERS[1])
        second = substrings.sliding(runs, n - k + 1, np.minimum)[first]
        least = np.where(hot, windows.mixed(least ^ (second * np.uint64(3))), least)
    new = np.ones(len(first), bool)
    new[1:] = (least[1:] != least[:-1]) | (first[1:] != first[:-1] + 1)
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(first)))
    pieces = -(-sizes // longest)
    heads = np.repeat(heads, pieces) + windows.ragged(pieces) * longest
    last = np.append(heads[1:], len(first)) - 1
    return np.searchsorted(offsets, first[heads], "right") - 1, first[heads], first[last] + n, least[heads]


def removed_bytes(groups: DataFrame, n: int, k: int, total: int, cells: float, hot: int, longest: int, held_bytes: int) -> DataFrame:
    """group and gone: texts (places in the group), first bytes and ends of runs of bytes that repeat elsewhere; runs may overlap."""
    buckets = int(max(64, total // SHARD_BYTES))
    told = sketch.told(groups, lambda part: anchors(*common.text_bytes(part.column("text")), n, k)[0], 2 * total // (n - k), cells=cells)

    def send(held: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        """A row for each bucket of its distinct segments; what came more than once here goes back to all its texts."""
        by: dict[int, list] = {}
        local = []
        for piece, (key, found) in held.items():
            if len(found) > 1 and len({(i, t, at) for i, t, _, at in found}) > 1:
                local += [(r, at, at + len(piece)) for _, _, r, at in found]
                found = []
            by.setdefault(key % buckets, []).append((key, piece, found))
        squeeze = zstandard.ZstdCompressor(level=3)
        packed = lambda bucket, row: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((bucket, *row), [pa.int32(), *[pa.binary()] * 8], strict=True)], names=["bucket", *_COLUMNS])
        for bucket, own in by.items():
            found = np.array([o for x in own for o in x[2]], np.int64).reshape(-1, 4)
            sizes, counts = np.array([len(x[1]) for x in own], "<u4"), np.array([len(x[2]) for x in own], "<u4")
            text = squeeze.compress(b"".join(x[1] for x in own))
            yield packed(bucket, (np.array([x[0] for x in own], "<u8").tobytes(), sizes.tobytes(), text, counts.tobytes(), *(squeeze.compress(np.ascontiguousarray(found[:, c]).tobytes()) for c in range(4))))
        for at in range(0, len(local), 100_000):
            own = local[at : at + 100_000]
            yield packed((own[0][0] >> common.PLACE_BITS) % buckets, (b"", *(squeeze.compress(np.array(c, "<i8").tobytes()) for c in zip(*own, strict=True)), *[b""] * 4))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for group, part, answers in common.parts_of(batches, "told"):
            ids, tags, rids = substrings.own_numbers(group, part)
            data, offsets = common.text_bytes(part.column("text"))
            doc, a, b, key = segments(data, offsets, answers, n, k, hot, longest)
            raw = data.tobytes()
            for s, e, h, *own in zip(a.tolist(), b.tolist(), key.tolist(), ids[doc].tolist(), tags[doc].tolist(), rids[doc].tolist(), (a - offsets[doc]).tolist(), strict=True):
                piece = raw[s:e]
                if (known := held.get(piece)) is None:
                    held[piece] = known = (h, [])
                    size += e - s + 200
                known[1].append(own)
                size += 150
            if size >= 2 * held_bytes:
                yield from send(held)
                held, size = {}, 0
        if held:
            yield from send(held)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in common.by_key(batches, "bucket", _COLUMNS):
            yield from back(rows)

    def back(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Repeated runs of a bucket's texts, by group of texts."""
        expand = zstandard.ZstdDecompressor()
        numbers = lambda c: np.frombuffer(expand.decompress(c), "<i8")
        known: dict[bytes, list] = {}
        found = []
        for keys, lengths, text, counts, *own in rows:
            if not keys:
                found.append(tuple(map(numbers, (lengths, text, counts))))
                continue
            text, at, o = expand.decompress(text), 0, 0
            own = np.stack(list(map(numbers, own)), 1)
            for h, size, c in zip(np.frombuffer(keys, "<u8").tolist(), np.frombuffer(lengths, "<u4").tolist(), np.frombuffer(counts, "<u4").tolist(), strict=True):
                known.setdefault(text[at : at + size], [h, []])[1].append(own[o : o + c])
                at, o = at + size, o + c
        pieces = sorted(known, key=lambda p: known[p][0])  # segments of one key stay together
        at = 0
        while at < len(pieces):
            stop, size = at, 0
            while stop < len(pieces) and (size < SHARD_BYTES or known[pieces[stop]][0] == known[pieces[stop - 1]][0]):
                size += len(pieces[stop]) + 1
                stop += 1
            found += repeats(pieces[at:stop], [known[p][1] for p in pieces[at:stop]], n)
            at = stop
        if found:
            yield from substrings.returned(*(np.concatenate(x) for x in zip(*found, strict=True)))

    asked = groups.join(told, "group").mapInArrow(dealt, PACKED_SQL)
    found = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(shard, GONE_SQL)
    return found.groupBy("group").agg(F.collect_list(F.struct("texts", "places", "ends")).alias("gone"))


def repeats(pieces: list[bytes], occurrences: list[list[np.ndarray]], n: int) -> list[tuple[np.ndarray, ...]]:
    """(row number, first byte, end) of repeated runs in a shard: the pieces are distinct, each with its occurrences (id, tag, row number, first byte); an empty one says that it came more than once."""
    text = b"\0".join(pieces)
    data = np.frombuffer(text, np.uint8)
    sizes = np.array([len(p) for p in pieces])
    starts = np.cumsum(sizes + 1) - sizes - 1
    codes = data.astype(np.int64) + 2
    codes[starts[1:] - 1] = 1
    valid = np.zeros(len(data) + 1, np.int32)
    np.add.at(valid, starts, 1)
    np.add.at(valid, starts + sizes - n + 1, -1)
    again = suffixes.repeated(data, suffixes.suffix_array(np.append(codes, 0)), np.cumsum(valid[:-1]) > 0, n)
    # Runs of repeated windows of each piece; a piece that came more than once repeats as a whole.
    on = np.flatnonzero(again)
    piece = np.searchsorted(starts, on, "right") - 1
    opens = np.ones(len(on), bool)
    opens[1:] = (on[1:] > on[:-1] + n) | (piece[1:] != piece[:-1])
    a = np.flatnonzero(opens)
    b = np.append(a[1:], len(on))[: len(a)] - 1
    bounds = np.searchsorted(piece[a], np.arange(len(pieces) + 1))
    first, last = on[a] - starts[piece[a]], on[b] + n - starts[piece[b]]
    out = []
    for k, own in enumerate(occurrences):
        found = np.concatenate(own)
        if not len(found):
            continue
        if len(own) > 1 and (min(map(len, own)) == 0 or len(np.unique(found[:, [0, 1, 3]], axis=0)) > 1):
            out.append((found[:, 2], found[:, 3], found[:, 3] + sizes[k]))
        else:
            for r in range(bounds[k], bounds[k + 1]):
                out.append((found[:, 2], found[:, 3] + first[r], found[:, 3] + last[r]))
    return out


def dedup(docs: DataFrame, window: int = WINDOW, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", cells: float = sketch.CELLS, hot: int = HOT, longest: int = LONGEST, held_bytes: int = HELD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_spans, n_removed and kept (bytes) of every row: every byte in a string of `window` bytes that also starts elsewhere goes.

    Null and empty texts have no bytes; texts shorter than the window keep all. Repeated rows (equal id and text) are one
    document: they don't remove each other, and each stays. A null id is a value of its own.
    """
    rows = common.id_text(docs, id_col, text_col).withColumn("key", common.text_key())
    groups = common.grouped(rows, SLICE_BYTES)
    gone = removed_bytes(groups, window, run, sketch.text_bytes(rows), cells, hot, longest, held_bytes)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, own in common.parts_of(batches, "gone"):
            data, offsets = common.text_bytes(part.column("text"))
            step = np.zeros(len(data) + 1, np.int32)
            for x in own or ():
                base = offsets[common.unplanes(x["texts"])]
                np.add.at(step, base + common.unplanes(x["places"]), 1)
                np.add.at(step, base + common.unplanes(x["ends"]), -1)
            out = np.cumsum(step[:-1]) > 0
            opens = out.copy()
            opens[1:] &= ~out[:-1]
            heads = offsets[:-1][np.diff(offsets) > 0]
            opens[heads] = out[heads]  # runs don't go on from text to text
            sums, spans = np.concatenate([[0], np.cumsum(out)]), np.concatenate([[0], np.cumsum(opens)])
            per = lambda x: pa.array(x[offsets[1:]] - x[offsets[:-1]])
            rest, ends = data[~out].tobytes(), np.concatenate([[0], np.cumsum(~out)])[offsets].tolist()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), per(sums), per(spans), pa.array([rest[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return groups.join(gone, "group", "left").mapInArrow(kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
