"""Media columns in a deduplicated chunk store.

A payload is stored as a WAV file of 8-bit mono samples. A rolling gear hash over the payload cuts it into chunks of
some hundred bytes; the file's header, which tells its length and so is other for most near copies, is kept in the
file's list. Texts are handled in batches: a batch sends its distinct chunks, packed and compressed, to buckets of
their digests (128 bits of SHA-256). Where a bucket's chunks meet, each digest is kept once, and the store is written: a
table of chunks (digests and bytes), of what each batch asks for, and of the batches' ordered lists, in files by bucket.

Files are read back from that table: Spark joins what batches ask for with the chunks, bucket by bucket and without
dealing either side again, and the lists put the chunks together; length and SHA-256 of each whole file are verified, and
the features computed from the samples read back.

Bytes move in two shuffles: by digest, and back by batch. Payloads, cuts and digests are computed once.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, sketch

#: The payload's unit of padding, and the chunk sizes: cuts come at least LEAST and at most MOST bytes apart, about 2**BITS on average.
UNIT, PAD, LEAST, BITS, MOST, WINDOW = 192, 32, 64, 8, 4096, 32
RATE, HEADER, DIGEST, LEVEL = 8000, 44, 16, 9
#: Bytes of text of a batch, and of a bucket (expected).
BATCH_BYTES, BUCKET_BYTES = 32 << 20, 16 << 20


def gear_table(seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """256 fixed 32-bit values by a rule (splitmix64)."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = gear_table()


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the hash of the last 32 bytes: h = 2 h + GEAR[byte] modulo 2**32, by doubling."""
    h, reach = GEAR[data], 1
    while reach < WINDOW:
        h = h.copy()
        h[reach:] += h[:-reach].copy() << np.uint32(reach)
        reach *= 2
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks; content alone decides, apart from the least and the most size."""
    n = len(data)
    if n <= LEAST:
        return [n]
    h = gear(np.frombuffer(data, np.uint8))
    marks = np.flatnonzero((h >> np.uint32(32 - BITS)) == 0) + 1
    out, at = [], 0
    while n - at > LEAST:
        k = np.searchsorted(marks, at + LEAST)
        end = min(int(marks[k]) if k < len(marks) else n, at + MOST, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def header(n: int) -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n)


def wav(payload: bytes) -> bytes:
    return header(len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The payload of a stored file; raises ValueError if the file isn't whole."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or struct.unpack_from("<I", media, 40)[0] != len(media) - HEADER:
        raise ValueError("not a whole 8-bit WAV file")
    return media[HEADER:]


def feature(payload: bytes) -> str:
    """Of the samples: mean and deviation about the middle (128), crossings of it, and the energy of eight equal parts."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    parts = (x * x).reshape(8, -1).mean(1)
    crossed = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"mean={x.mean():.4f};std={x.std():.4f};crossings={crossed};energy=" + ",".join(f"{e:.2f}" for e in parts)


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + bytes([PAD]) * (UNIT - len(raw) % UNIT if len(raw) % UNIT or not raw else 0)


def described(n_bytes: int, media: bytes, digest: bytes) -> tuple:
    """What is read back, after the check that the file is the one that was stored."""
    own = hashlib.sha256(media).digest()
    if own != digest:
        raise ValueError("stored chunks don't make up the file")
    payload = samples(media)
    return n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), own.hex(), feature(payload)


DESCRIBED = pa.struct([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
DESCRIBED_SQL = "said struct<n_bytes:long,payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,feature:string>"
#: The list of a batch: its rows, the file of each, and of each file its header, digest, text bytes and chunks.
_FILES = pa.schema([("doc_ids", pa.list_(pa.int64())), ("file", pa.list_(pa.int32())), ("n_bytes", pa.list_(pa.int64())), ("headers", pa.binary()), ("whole", pa.binary()), ("n_chunks", pa.list_(pa.int32())), ("chunks", pa.list_(pa.int32()))])
#: What travels: places of chunks among a batch's distinct ones, their lengths and bytes (digests follow from these); or the list of a batch.
_SENT = ("batch", "places", "lengths", "bytes", "files")
_SENT_SQL = "bucket int, batch long, places binary, lengths binary, bytes binary, files binary"
_BACK_SQL = "batch long, places binary, lengths binary, bytes binary, files binary"
#: The store's rows, by kind: `chunks` (digests, lengths and bytes of a bucket's chunks), `asked` (which batch wants which: places in its list, slots in the bucket), `lists` (files of a batch).
_STORE = ("kind", "bucket", "batch", "places", "slots", "digests", "lengths", "bytes")
_STORE_SQL = "kind string, bucket int, batch long, places binary, slots binary, digests binary, lengths binary, bytes binary"
#: Files of the store at most; a file has several buckets beyond that.
MOST_FILES = 4096


def chunked(rows: DataFrame, buckets: int) -> DataFrame:
    """Of each batch its list, and its distinct chunks bucket by bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        base = TaskContext.get().partitionId() << 29
        packed = lambda *row: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.int64(), *[pa.binary()] * 4], strict=True)], names=["bucket", *_SENT])
        for n, part in enumerate(common.slices(batches, limit=BATCH_BYTES)):
            number: dict[bytes, int] = {}
            pieces: list[bytes] = []
            known: dict[str, int] = {}
            file, n_bytes, headers, wholes, n_chunks, chunks = [], [], [], [], [], []
            for text in part.column("text").to_pylist():
                if text not in known:
                    known[text] = len(known)
                    size, payload = payload_of(text)
                    n_bytes.append(size)
                    headers.append(header(len(payload)))
                    wholes.append(hashlib.sha256(headers[-1] + payload).digest())
                    at, ends = 0, cuts(payload)
                    for end in ends:
                        digest = hashlib.sha256(payload[at:end]).digest()[:DIGEST]
                        if (k := number.get(digest)) is None:
                            number[digest] = k = len(pieces)
                            pieces.append(payload[at:end])
                        chunks.append(k)
                        at = end
                    n_chunks.append(len(ends))
                file.append(known[text])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _FILES, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                row = [part.column("doc_id").to_pylist(), file, n_bytes, b"".join(headers), b"".join(wholes), n_chunks, chunks]
                out.write_batch(pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _FILES, strict=True)], schema=_FILES))
            yield packed((base + n) % buckets, base + n, b"", b"", b"", sink.getvalue().to_pybytes())
            digests = np.frombuffer(b"".join(number), np.uint8).reshape(-1, DIGEST)
            bucket = np.ascontiguousarray(digests[:, :8]).view("<u8").ravel() % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                own = order[bounds[b] : bounds[b + 1]]
                some = [pieces[k] for k in own.tolist()]
                yield packed(b, base + n, sketch.steps(own), common.planes(np.array(list(map(len, some)))), squeeze.compress(b"".join(some)), b"")

    return rows.mapInArrow(work, _SENT_SQL)


def cut_at(data: bytes, lengths: bytes) -> list[bytes]:
    """The chunks that packed bytes hold."""
    ends = np.cumsum(common.unplanes(lengths)).tolist()
    raw = zstandard.ZstdDecompressor().decompress(data)
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digests_of(data: bytes) -> list[bytes]:
    return [data[k : k + DIGEST] for k in range(0, len(data), DIGEST)]


def _deduplicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's chunks, each once, and what each batch asks of them; lists go through."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
    row = lambda *values: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=list(_STORE))
    for bucket, own in common.by_key(batches, "bucket", _SENT):
        slot: dict[bytes, int] = {}
        pieces: list[bytes] = []
        for batch, places, lengths, data, files in own:
            if files:
                yield row("lists", bucket, batch, b"", b"", b"", b"", files)
                continue
            slots = []
            for piece in cut_at(data, lengths):
                digest = hashlib.sha256(piece).digest()[:DIGEST]
                if (k := slot.get(digest)) is None:
                    slot[digest] = k = len(pieces)
                    pieces.append(piece)
                slots.append(k)
            yield row("asked", bucket, batch, places, common.planes(np.array(slots)), b"", b"", b"")
        if pieces:
            yield row("chunks", bucket, None, b"", b"", b"".join(slot), common.planes(np.array(list(map(len, pieces)))), squeeze.compress(b"".join(pieces)))


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the store of all texts' media to the shared folder, as a table in files by bucket, and gives its rows (columns as in _STORE)."""
    spark, rows = docs.sparkSession, common.id_text(docs, id_col, text_col)
    buckets = int(max(64, sketch.text_bytes(rows) // BUCKET_BYTES))
    files = min(buckets, MOST_FILES)
    name = f"chunks_{uuid.uuid4().hex}"
    met = chunked(rows, buckets).repartition(files, "bucket").sortWithinPartitions("bucket").mapInArrow(_deduplicated, _STORE_SQL)
    with common.shuffles_dropped(spark):
        met.write.option("compression", "zstd").option("path", f"{common.shared_folder(spark)}/{name}").partitionBy("kind").bucketBy(files, "bucket").saveAsTable(name)
    return spark.table(name)


def chunk_store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The store's chunks: each distinct one once (digest, bytes)."""
    return chunks_of(stored(docs, id_col, text_col))


def chunks_of(store: DataFrame) -> DataFrame:
    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for digests, lengths, data in zip(*(part.column(c).to_pylist() for c in ("digests", "lengths", "bytes")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(digests_of(digests), pa.binary()), pa.array(cut_at(data, lengths), pa.binary())], names=["digest", "bytes"])

    return store.filter("kind = 'chunks'").select("digests", "lengths", "bytes").mapInArrow(single, "digest binary, bytes binary")


def _answered(chunks: pa.Table, asked: pa.Table) -> pa.Table:
    """What each batch asks of a bucket, from the bucket's chunks."""
    squeeze, out = zstandard.ZstdCompressor(level=LEVEL), []
    pieces = [p for data, lengths in zip(chunks["bytes"].to_pylist(), chunks["lengths"].to_pylist(), strict=True) for p in cut_at(data, lengths)]
    for batch, places, slots in zip(asked["batch"].to_pylist(), asked["places"].to_pylist(), asked["slots"].to_pylist(), strict=True):
        own = [pieces[k] for k in common.unplanes(slots).tolist()]
        out.append((batch, places, common.planes(np.array(list(map(len, own)))), squeeze.compress(b"".join(own)), b""))
    columns = list(zip(*out, strict=True)) or [()] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *[pa.binary()] * 4], strict=True)], names=["batch", "places", "lengths", "bytes", "files"])


def read_back(store: DataFrame) -> DataFrame:
    """doc_id, n_chunks and what is said of its file, of every row that was stored, from the stored chunks alone."""
    of = lambda kind, *columns: store.filter(F.col("kind") == kind).select("bucket", *columns)
    joined = of("chunks", "lengths", "bytes").groupBy("bucket").cogroup(of("asked", "batch", "places", "slots").groupBy("bucket")).applyInArrow(_answered, _BACK_SQL)
    empty = F.lit(b"")
    lists = of("lists", "batch", "bytes").select("batch", empty.alias("places"), empty.alias("lengths"), empty.alias("bytes"), F.col("bytes").alias("files"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in common.by_key(batches, "batch", ("places", "lengths", "bytes", "files")):
            pieces: dict[int, bytes] = {}
            for places, lengths, data, files in own:
                if files:
                    listed = pa.ipc.open_stream(files).read_next_batch().to_pylist()[0]
                else:
                    pieces.update(zip(sketch.unsteps(places).tolist(), cut_at(data, lengths), strict=True))
            said, at = [], 0
            for k, (n, count) in enumerate(zip(listed["n_bytes"], listed["n_chunks"], strict=True)):
                media = listed["headers"][k * HEADER : (k + 1) * HEADER] + b"".join([pieces[c] for c in listed["chunks"][at : at + count]])
                said.append(dict(zip((f.name for f in DESCRIBED), described(n, media, listed["whole"][k * 32 : (k + 1) * 32]), strict=True)))
                at += count
            for k in range(0, len(listed["file"]), 1000):
                files = listed["file"][k : k + 1000]
                yield pa.RecordBatch.from_arrays([pa.array(listed["doc_ids"][k : k + 1000], pa.int64()), pa.array([listed["n_chunks"][f] for f in files], pa.int32()), pa.array([said[f] for f in files], DESCRIBED)], names=["doc_id", "n_chunks", "said"])

    back = joined.unionByName(lists).repartition("batch").sortWithinPartitions("batch")
    return back.mapInArrow(read, f"doc_id long, n_chunks int, {DESCRIBED_SQL}")


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as media in the chunk store and reads it back: one row per row of `docs`.

    A null or empty text is one unit of padding. Repeated rows stay, each with its result; equal texts have
    equal values whatever their ids. A null id stays null. The store stays in the shared folder, as the result reads it.
    """
    return read_back(stored(docs, id_col, text_col)).select("doc_id", "said.*", "n_chunks")
