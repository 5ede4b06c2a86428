"""Byte-level BPE: overlapping chunks are pre-tokenised in parallel, stitched, encoded piece by piece, and decoded.

A text of at most `chunk` characters is one chunk. A longer one is cut into chunks that overlap by
`overlap` characters and go to different tasks, so that no task encodes a very long text alone. The scan of a chunk may start inside a piece; from the first boundary that it
shares with the scan before it, both agree, so the text is cut there. Where the overlap holds no
shared boundary, the rest of that text stays one segment: rare, and exact all the same.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CHUNK, OVERLAP = 16_384, 1_024
#: Pieces whose ids a task keeps; beyond it starts anew.
CACHE = 100_000
#: Chunks of a text that go to Spark at once.
CHUNKS = 64
ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
ENCODED_SQL = "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@functools.cache
def pattern():
    """The split pattern, with white space by its Unicode property as the encoder's own regex engine has it."""
    import public_tokenizers
    import regex

    space = public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    return regex.compile(space)


class Codec:
    """Ids of pieces and bytes of ids for one rank file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern().pattern.replace("White_Space", "White_Space"), mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.known: dict[str, bytes] = {}
        self.raw: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.raw[rank] = token

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, pieces = self.known, pattern().findall(text)
        if new := set(pieces).difference(known):
            if len(known) + len(new) > CACHE:
                known.clear()
                new = set(pieces)
            for piece in new:
                known[piece] = np.array(self.core.encode_single_piece(piece.encode()), "<u4").tobytes()
        return b"".join([known[p] for p in pieces])

    def decode(self, ids: bytes) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in np.frombuffer(ids, "<u4").tolist()])


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def boundaries(text: str) -> list[int]:
    """Starts and ends of the pieces; the last piece's end isn't sure, since the text may go on, and is left out."""
    return [0, *(m.end() for m in pattern().finditer(text))][:-1] if text else []


def _described(schema: pa.Schema, doc_ids, ids: list[bytes], path: str) -> pa.RecordBatch:
    own = codec(path)
    return common.batch(
        schema, doc_id=doc_ids, n_tokens=[len(x) // 4 for x in ids], ids=ids, ids_sha256=[hashlib.sha256(x).hexdigest() for x in ids], decoded_sha256=[hashlib.sha256(own.decode(x)).hexdigest() for x in ids]
    )


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), ids_sha256 and decoded_sha256 of every row.

    A null or empty text has no ids. Repeated rows stay, each with its result. A null id stays null.
    """
    path = path or vocabulary()
    rows = common.id_text(docs, id_col, text_col)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, limit=common.SLICE_BYTES // 8):
            own = codec(path)
            yield _described(ENCODED, part.column("doc_id"), [own.encode(t) for t in part.column("text").to_pylist()], path)

    short = rows.filter(F.length("text") <= chunk).mapInArrow(whole, ENCODED_SQL)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chunks of each long text, with the boundaries of their pieces where they overlap the chunk before and the one behind."""
        for part in batches:
            for doc_id, key, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "key", "text")), strict=True):
                starts = range(0, len(text), chunk)
                for at in range(0, len(starts), CHUNKS):
                    own = [text[k : k + chunk + overlap] for k in starts[at : at + CHUNKS]]
                    bounds = list(map(boundaries, own))
                    columns = ([doc_id] * len(own), [key] * len(own), list(range(at, at + len(own))), own, [[b for b in x if b < overlap] for x in bounds], [[b - chunk for b in x if b >= chunk] for x in bounds])
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "key", "i", "text", "head", "tail"])

    # One row for each chunk of each distinct long text of an id, with the number of its repeats.
    long = rows.filter(F.length("text") > chunk).withColumn("key", common.text_key()).select("doc_id", "key", "text")
    chunks = long.mapInArrow(scanned, "doc_id long, key long, i int, text string, head array<int>, tail array<int>")
    chunks = chunks.groupBy("doc_id", "key", "i").agg(*(F.first(c).alias(c) for c in ("text", "head", "tail")), F.count("*").alias("repeats"))
    by_text = Window.partitionBy("doc_id", "key").orderBy("i")
    shared = F.when(F.col("i") == 0, 0).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(by_text), F.col("head"))))
    cut = chunks.withColumn("cut", shared).withColumn("cut", F.when(F.min(F.col("cut").isNotNull()).over(by_text), F.col("cut")))
    nxt = F.lead("cut").over(by_text)
    last = F.lead("i").over(by_text).isNull()
    # A chunk whose own cut is known holds [cut, next cut); where the next isn't known, it and all that follow are put together.
    own = F.when(last, F.expr("substring(text, cut + 1)")).when(nxt.isNotNull(), F.substring("text", F.col("cut") + 1, F.lit(chunk) + nxt - F.col("cut"))).otherwise(F.expr(f"substring(text, cut + 1, {chunk} - cut)"))
    after = F.when(last, F.col("text")).otherwise(F.substring("text", F.lit(1), F.lit(chunk)))
    segment = F.max(F.when(F.col("cut").isNotNull(), F.col("i"))).over(by_text)
    parts = cut.select("doc_id", "key", "i", "repeats", segment.alias("segment"), F.when(F.col("cut").isNotNull(), own).otherwise(after).alias("text"))
    segments = parts.groupBy("doc_id", "key", "segment").agg(F.max("repeats").alias("repeats"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "").alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ids = [codec(path).encode(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "key", "segment", "repeats")), pa.array(ids, pa.binary())], names=["doc_id", "key", "segment", "repeats", "ids"])

    coded = segments.mapInArrow(encoded, "doc_id long, key long, segment int, repeats long, ids binary")
    texts = coded.groupBy("doc_id", "key").agg(F.max("repeats").cast("int").alias("repeats"), F.array_sort(F.collect_list(F.struct("segment", "ids"))).alias("parts"))
    texts = texts.select("doc_id", F.explode(F.array_repeat(F.expr("transform(parts, x -> x.ids)"), F.col("repeats"))).alias("parts"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield _described(ENCODED, part.column("doc_id"), [b"".join(x) for x in part.column("parts").to_pylist()], path)

    return short.unionByName(texts.mapInArrow(described, ENCODED_SQL))
