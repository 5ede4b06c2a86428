"""Benchmark decontamination by an FM-index of every shard of the corpus.

Each shard (a run of texts of bounded size) gets an index over its words: the words' codes are sorted
as suffixes, and a wavelet tree over the last column answers ranks. Benchmark phrases are searched
backward, occurrences located by sampled suffix positions, compared word by word with the text, and
merged into removal spans. Phrases come in broadcast blocks of bounded size. One block (the usual case) is one
pass over the texts, and nothing is shuffled or written. Where there are several, shards are written once with their
indexes; each block is one pass over these that writes hits alone and is dropped before the next is made, so driver and
executors hold one block at a time; at last each shard gets its hits by a join.
"""

from __future__ import annotations

import itertools
import pickle
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, windows
from .fmindex import Index

WINDOW = 10
#: Phrases in a block, bytes of text of a shard, and words of a part of a longer text.
BLOCK, SHARD_BYTES, LONG_WORDS = 250_000, 2 << 20, 500_000
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
HIT_SQL = "array<struct<first:int,last:int>>"
FOUND_SQL = f"doc_id long, text string, n_words long, hits {HIT_SQL}, items array<string>"


def item_words(text: str | None) -> list[bytes]:
    """A to Z lower-cased, then runs of digits, letters a to z and all beyond ASCII."""
    return WORDS.findall(bytes(windows.LOWER[np.frombuffer((text or "").encode(), np.uint8)]))


class Block:
    """Distinct phrases: their words, joined by blanks and end to end, their hashed words, and the items of each."""

    def __init__(self, phrases: dict[bytes, set[str]]):
        own = sorted(phrases)
        self.items = [sorted(phrases[p]) for p in own]
        self.ends = np.cumsum([len(p) for p in own], dtype=np.int64) if own else np.zeros(0, np.int64)
        self.text = b"".join(own)
        offsets = np.concatenate([[0], self.ends])
        data = np.frombuffer(self.text, np.uint8)
        starts, ends, bounds = windows.spans(data, offsets, windows.NOT_BLANK) if own else (np.zeros(0, np.int64), np.zeros(0, np.int64), offsets)
        self.sizes = np.diff(bounds)
        self.hashes = np.zeros((len(own), max(self.sizes, default=1)), np.uint64)
        words = windows.word_hashes(data, starts, ends)
        at = np.repeat(np.arange(len(own)), self.sizes)
        # At the right end, as search reads from behind.
        self.hashes[at, self.hashes.shape[1] - np.repeat(self.sizes, self.sizes) + windows.ragged(self.sizes)] = words

    def __len__(self) -> int:
        return len(self.sizes)

    def phrase(self, p: int) -> bytes:
        return self.text[self.ends[p - 1] if p else 0 : self.ends[p]]


def blocks(bench: DataFrame, id_col: str, text_col: str, window: int, size: int) -> Iterator[Block]:
    """The benchmark's phrases, row by row from Spark, so many at a time."""
    phrases: dict[bytes, set[str]] = defaultdict(set)
    rows = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))
    for item, text in rows.toLocalIterator():
        words = item_words(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            phrases[b" ".join(words[i : i + window])].add(item)
        if len(phrases) >= size:
            yield Block(phrases)
            phrases = defaultdict(set)
    if phrases:
        yield Block(phrases)


class Shard:
    """The words of a run of texts, coded, and where each lies among the codes; code 1 closes each text, so that no phrase crosses texts."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, index: Index | None = None):
        self.data, self.starts, self.ends = data, starts, ends
        self.known, codes = np.unique(windows.word_hashes(data, starts, ends), return_inverse=True)
        self.moved = np.arange(len(codes)) + np.searchsorted(bounds[1:], np.arange(len(codes)), "right")
        self.codes, self.closings, self.index = codes, len(bounds) - 1, index

    def indexed(self) -> Index | None:
        if self.index is None and len(self.codes):
            closed = np.ones(len(self.codes) + self.closings, np.int64)
            closed[self.moved] = self.codes + 2
            self.index = Index(closed)
        return self.index


def search(shard: Shard, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of every occurrence in a shard of lower-cased bytes; words are counted over the shard."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(shard.codes) or not len(block):
        return nothing
    known = shard.known
    place = np.minimum(np.searchsorted(known, block.hashes), len(known) - 1)
    used = np.arange(block.hashes.shape[1]) >= block.hashes.shape[1] - block.sizes[:, None]
    sought = np.flatnonzero(((known[place] == block.hashes) | ~used).all(1))
    if not len(sought):
        return nothing
    index = shard.indexed()
    low, high = index.search(place[sought] + 2, block.sizes[sought])
    counts = np.maximum(high - low, 0)
    at = index.locate(np.repeat(low, counts) + windows.ragged(counts))
    first, phrase = np.searchsorted(shard.moved, at), np.repeat(sought, counts)
    starts, ends, data = shard.starts, shard.ends, shard.data
    same = [block.phrase(p) == b" ".join(WORDS.findall(data[starts[f] : ends[f + block.sizes[p] - 1]].tobytes())) for f, p in zip(first.tolist(), phrase.tolist(), strict=True)]
    same = np.array(same, bool)
    return first[same], phrase[same]


def parts(data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Shards: (first text, word number of its first word, bytes, starts, ends, bounds). One long text alone is cut into parts that overlap by a window less one word."""
    starts, ends, bounds = windows.spans(data, offsets, windows.ALPHANUMERIC)
    if len(bounds) > 2 or len(starts) <= LONG_WORDS:
        yield 0, 0, data, starts, ends, bounds
        return
    for at in range(0, len(starts), LONG_WORDS):
        stop = min(len(starts), at + LONG_WORDS + window - 1)
        base = starts[at]
        yield 0, at, data[base : ends[stop - 1]], starts[at:stop] - base, ends[at:stop] - base, np.array([0, stop - at])


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs [first, last) that overlap or touch, put together."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def find_benchmark(docs: DataFrame, bench: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, text, n_words, hits (runs [first, last) of words inside an occurrence) and items (ids as strings, sorted) of every row.

    Null or empty texts have no words. Items without words match nothing; an item of fewer words than the window is one
    phrase; a null item id counts as the empty string; repeated items count once. Repeated rows stay; a null id stays null.
    """
    found = common.id_text(docs, id_col, text_col).select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.expr(f"cast(array() as {HIT_SQL})").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"))
    return _passes(found, FOUND_SQL, blocks(bench, item_col, item_text, window, block), window)


def _passes(found: DataFrame, schema: str, own: Iterator[Block], window: int) -> DataFrame:
    """The hits of all blocks added to rows of `found` (an empty block, if there is none, counts the words)."""
    context = found.sparkSession.sparkContext
    now = next(own, None) or Block({})
    more = next(own, None)
    if more is None:
        return found.mapInArrow(_pass(context.broadcast(now), window), schema)
    shards, hits = common.written(found.mapInArrow(_sharded(window), "shard long, rows binary, indexes binary"), common.FILE_GROUPS), []
    for block in itertools.chain([now, more], own):
        one = context.broadcast(block)
        hits.append(common.written(shards.mapInArrow(_hits(one, window), "shard long, row int, first int, last int, items array<string>")))
        one.destroy()
    all_ = hits[0]
    for more_hits in hits[1:]:
        all_ = all_.unionByName(more_hits)
    of_shard = common.written(all_.groupBy("shard").agg(F.collect_list(F.struct("row", "first", "last", "items")).alias("found")))
    common.forget(*hits)
    return shards.drop("indexes").join(of_shard, "shard", "left").mapInArrow(_with_hits(), schema)


def _shards(part: pa.RecordBatch, window: int, indexes: list[Index | None] | None = None) -> Iterator[tuple[int, np.ndarray, Shard]]:
    """(word number of the first word, bounds, shard) of a run of texts."""
    data, offsets = common.text_bytes(part.column(part.schema.get_field_index("text")))
    for n, (_, base, own, starts, ends, bounds) in enumerate(parts(windows.LOWER[data], offsets, window)):
        yield base, bounds, Shard(own, starts, ends, bounds, indexes[n] if indexes else None)


def _found(part: pa.RecordBatch, shards: Iterator[tuple[int, np.ndarray, Shard]], block: Block) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """(words of each text; (text, first word, one beyond the last, phrase) of each occurrence)."""
    n_words, out = np.zeros(part.num_rows, np.int64), []
    for base, bounds, shard in shards:
        if len(bounds) == part.num_rows + 1:
            n_words = np.maximum(n_words, np.diff(bounds) + base)
        first, phrase = search(shard, block)
        doc = np.searchsorted(bounds, first, "right") - 1
        begin = first - bounds[doc] + base
        out += [(d, a, a + int(block.sizes[p]), p) for d, a, p in zip(doc.tolist(), begin.tolist(), phrase.tolist(), strict=True)]
    return n_words, out


def _told(part: pa.RecordBatch, n_words: np.ndarray, hits: list[tuple[int, int, int, list[str]]]) -> pa.RecordBatch:
    """The rows with their words counted and their hits (row, first, last, items); further columns go through."""
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    items: dict[int, set[str]] = defaultdict(set)
    for d, a, b, names in hits:
        runs[d].append((a, b))
        items[d].update(names)
    hit = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    spans = pa.array([[{"first": a, "last": b} for a, b in merged(runs[d])] if d in runs else [] for d in range(part.num_rows)], hit)
    names = pa.array([sorted(items[d]) if d in items else [] for d in range(part.num_rows)], pa.list_(pa.string()))
    rest = [c for c in part.schema.names if c not in ("doc_id", "text", "n_words", "hits", "items")]
    return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(n_words), spans, names, *map(part.column, rest)], names=["doc_id", "text", "n_words", "hits", "items", *rest])


def _pass(one, window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = one.value
        for part in common.slices(batches, limit=SHARD_BYTES):
            n_words, found = _found(part, _shards(part, window), block)
            yield _told(part, n_words, [(d, a, b, block.items[p]) for d, a, b, p in found])

    return work


def _sharded(window: int):
    """Each shard's rows, with their words counted, and its indexes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, base, none = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 29, Block({})
        for n, part in enumerate(common.slices(batches, limit=SHARD_BYTES)):
            own = list(_shards(part, window))
            indexes = squeeze.compress(pickle.dumps([shard.indexed() for _, _, shard in own], protocol=5))
            rows, sink = _told(part, _found(part, iter(own), none)[0], []), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([indexes], pa.binary())], names=["shard", "rows", "indexes"])

    return work


def _hits(one, window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = one.value
        for batch in batches:
            for number, rows, indexes in zip(batch.column("shard").to_pylist(), batch.column("rows"), batch.column("indexes"), strict=True):
                part = common.ungrouped(rows)
                own = pickle.loads(zstandard.ZstdDecompressor().decompress(indexes.as_py()))
                found = _found(part, _shards(part, window, own), block)[1]
                if found:
                    d, a, b, p = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(d), pa.int64()), pa.array(d, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array([block.items[x] for x in p], pa.list_(pa.string()))], names=["shard", "row", "first", "last", "items"])

    return work


def _with_hits():
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, found in zip(batch.column("rows"), batch.column("found").to_pylist(), strict=True):
                part = common.ungrouped(rows)
                yield _told(part, np.asarray(part.column("n_words")), [(h["row"], h["first"], h["last"], h["items"]) for h in found or []])

    return work


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def remove_spans(text: str, hits: list[tuple[int, int]]) -> str:
    """The text without its hit words, each run cut from its first word's start to its last word's end."""
    raw = text.encode()
    starts, ends, _ = windows.spans(windows.LOWER[np.frombuffer(raw, np.uint8)], np.array([0, len(raw)]), windows.ALPHANUMERIC)
    kept, at = [], 0
    for a, b in hits:
        kept.append(raw[at : starts[a]])
        at = ends[b - 1]
    return (b"".join(kept) + raw[at:]).decode()


def remove_benchmark(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs`, all columns, with removal spans cut from `text` and n_chars, if there, set anew.

    Each text is indexed once; a row's other columns go through as they are.
    """
    common.small_batches(docs.sparkSession)
    fields, names = docs.schema, docs.columns
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    rest = F.struct(*(F.col(f"`{c}`") for c in names))
    found = find_benchmark_with(docs, rest, bench, window)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            columns = list(part.column("row").flatten())
            texts = columns[at].to_pylist()
            for k, hits in enumerate(part.column("hits").to_pylist()):
                if hits:
                    texts[k] = remove_spans(texts[k], [(h["first"], h["last"]) for h in hits])
            columns[at] = pa.array(texts, columns[at].type)
            if count is not None:
                columns[count] = pa.array([None if t is None else len(t) for t in texts], columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.mapInArrow(work, fields)


def find_benchmark_with(docs: DataFrame, rest, bench: DataFrame, window: int) -> DataFrame:
    """As find_benchmark for one block after the other, with each row's own columns in `row`."""
    kind = docs.select(rest.alias("row")).schema["row"].dataType.simpleString()
    found = docs.select(F.lit(0).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr(f"cast(array() as {HIT_SQL})").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"), rest.alias("row"))
    return _passes(found, f"{FOUND_SQL}, row {kind}", blocks(bench, "item_id", "text", window, BLOCK), window)
