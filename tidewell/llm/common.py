"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import small_batches

#: Bytes of text that one kernel call handles at most (a longer text is handled alone).
SLICE_BYTES = 8 << 20
#: Rows of a group of texts at most, as a power of two: a row's number is its group's, then its place there.
PLACE_BITS = 12
#: Groups in a file at most.
FILE_GROUPS = 64
#: Where written tables lie.
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone; a null text becomes empty. Other columns, whatever their names, are not read."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def release() -> None:
    """Gives memory that a worker no longer uses back: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The same rows in runs of about `limit` bytes of text, and `rows` rows at most: small batches are put together, large ones cut."""
    held: list[pa.RecordBatch] = []
    size = count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(lengths(batch.column(batch.schema.get_field_index(text))))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, min(int(np.searchsorted(ends, base + limit - size, "right")), start + rows - count))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - base
            count += stop - start
            start, base = stop, int(ends[stop - 1])
            if size >= limit or count >= rows or start < batch.num_rows:
                yield joined(held)
                held, size, count = [], 0, 0
    if held:
        yield joined(held)
        held = []
    release()


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def lengths(array: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each value of a string or binary array without nulls."""
    import pyarrow.compute as pc

    return np.asarray(pc.binary_length(array).fill_null(0)).astype(np.int64)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array without nulls, end to end, and the n + 1 offsets of its values."""
    kind = pa.binary() if pa.types.is_string(array.type) else pa.large_binary()
    raw = array.cast(kind) if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else array
    wide = pa.types.is_large_binary(raw.type)
    offsets = np.frombuffer(raw.buffers()[1], np.int64 if wide else np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = raw.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in schema)], schema=schema)


def text_key(text="text"):
    """A 64-bit hash of the text, which with doc_id tells rows apart; rows equal in both are repeats and share their result."""
    return F.xxhash64(F.col(text))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def grouped(rows: DataFrame, limit: int) -> DataFrame:
    """Rows (doc_id, key, text) in groups of about `limit` bytes of text: group (a number of its own) and data (an Arrow stream).

    Groups are written once and read from there, so that a group means the same rows in each later pass.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("text", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 29
        for n, part in enumerate(slices(batches, limit=limit, rows=1 << PLACE_BITS)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part.cast(schema))
            yield pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["group", "data"])

    return written(rows.select("doc_id", "key", "text").mapInArrow(work, "group long, data binary"), FILE_GROUPS)


def ungrouped(data: pa.Scalar) -> pa.RecordBatch:
    """The rows of a group."""
    with pa.ipc.open_stream(data.as_buffer()) as rows:
        return rows.read_next_batch()


def parts_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """(group, its rows, further columns) of groups."""
    for batch in batches:
        for group, data, *more in zip(batch.column("group").to_pylist(), batch.column("data"), *(batch.column(c).to_pylist() for c in columns), strict=True):
            yield group, ungrouped(data), *more
    release()


def by_key(batches: Iterator[pa.RecordBatch], key: str, columns: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """(key, its rows) of batches in which rows of one key follow each other."""
    now, own = None, []
    for batch in batches:
        for value, *row in zip(batch.column(key).to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True):
            if value != now:
                if own:
                    yield now, own
                now, own = value, []
            own.append(tuple(row))
    if own:
        yield now, own
    release()


def in_runs(batches: Iterator[pa.RecordBatch], key: str, columns: tuple[str, ...], weight: Callable[[tuple], int], most: int) -> Iterator[tuple[int, list[tuple]]]:
    """As by_key, but a key's rows come in several lists of about `most` by weight."""
    now, own, size = None, [], 0
    for batch in batches:
        for value, *row in zip(batch.column(key).to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True):
            if own and (value != now or size >= most):
                yield now, own
                own, size = [], 0
            now = value
            own.append(tuple(row))
            size += weight(own[-1])
    if own:
        yield now, own
    release()


def planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32, their bytes apart, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unplanes(data: bytes) -> np.ndarray:
    apart = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(apart.T).view("<u4").ravel().astype(np.int64)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """While a table is written: what is shuffled for it is deleted once it is there, as nothing will read it again."""
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        yield
    finally:
        spark.conf.set(clean, before)


def written(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """The same rows, read from a compressed table in the shared folder: cuts the lineage, and survives lost executors. A file's rows are read in batches, so large rows ask for few in a file."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more. Tables that a result still reads stay until the folder is cleared."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
