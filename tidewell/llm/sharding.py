"""Hilbert-curve sharding: metadata dimensions are quantised, rows sorted by curve index, and runs cut.

The order is curve cell, then a spread of the id, then id and size: total up to rows that are equal in
all of these. Ranks come from counts of (cell, spread) groups, so no task sorts more than one group:
counts are summed by Spark, and their running sums taken over at most 4,096 cells on one task and over the groups
of each cell. A cell has as many groups as its rows ask for, GROUP a group on average; rows are numbered within their group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from . import common

#: Bits of each of the four dimensions, and rows of a group on average.
BITS, DIMENSIONS, GROUP = 3, 4, 100_000


def hilbert_index(x: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points x[n, d] with coordinates of so many bits (Skilling's transform)."""
    x = x.astype(np.int64).copy()
    n, d = x.shape
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work, from the highest bit down
        p = q - 1
        for i in range(d):
            on = (x[:, i] & q) != 0
            swap = (x[:, 0] ^ x[:, i]) & p
            x[:, 0] = np.where(on, x[:, 0] ^ p, x[:, 0] ^ swap)
            if i:
                x[:, i] = np.where(on, x[:, i], x[:, i] ^ swap)
        q >>= 1
    for i in range(1, d):  # Gray encoding
        x[:, i] ^= x[:, i - 1]
    t, q = np.zeros(n, np.int64), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[:, d - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    out = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[:, i] >> b) & 1)
    return out


@pandas_udf(IntegerType())
def curve(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.stack([s.to_numpy() for s in (a, b, c, d)], 1), BITS).astype(np.int32))


def dimensions(source: Column, lang: Column, size: Column, doc_id: Column, low: int | None, high: int | None) -> list[Column]:
    """Quantised to BITS bits: source and language by hash, size by its power of two, id linearly between its least and greatest."""
    top = (1 << BITS) - 1
    name = lambda c: F.pmod(F.crc32(F.coalesce(c, F.lit("")).cast("binary")), F.lit(top + 1)).cast("int")
    power = F.least(F.greatest(F.floor(F.log2(size)) - 6, F.lit(0)), F.lit(top)).cast("int")
    span = max(1, (high or 0) - (low or 0) + 1)
    place = F.least(F.floor((F.coalesce(doc_id, F.lit(low or 0)) - (low or 0)) * float(top + 1) / span), F.lit(top)).cast("int")
    return [name(source), name(lang), power, place]


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, cell, rank, shard and slot of every row; shards differ by one row at most.

    Null text: size 1 and the checksum of no bytes. A null id, source or language is a value of its own. Repeated rows
    get consecutive ranks. Empty input: no rows.
    """
    return _placed(docs, shards, id_col, text_col, source_col, lang_col, []).drop("row")


def _placed(docs: DataFrame, shards: int, id_col: str, text_col: str, source_col: str, lang_col: str, columns: list[str]) -> DataFrame:
    """As `shard`, with the given columns of each row in the struct `row`, so that nothing is joined back by id.

    What is placed is written once (without columns: ids, sizes and checksums alone), so the input is read twice: for
    the extremes of the ids, and for the curve.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    low, high = docs.select(F.min(F.col(id_col).cast("long")), F.max(F.col(id_col).cast("long"))).first()
    own = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in columns))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), own.alias("row"))
    cell = curve(*dimensions(F.col("source"), F.col("lang"), F.col("size"), F.col("doc_id"), low, high))
    placed = common.written(rows.select("doc_id", "size", "text_crc32", cell.alias("cell"), "row"))
    total = placed.count()
    cells = placed.groupBy("cell").agg(F.count("*").alias("rows"))  # at most 2 ** (BITS * DIMENSIONS) of them
    spreads = F.broadcast(cells.select("cell", F.ceil(F.col("rows") / GROUP).alias("spreads")))
    placed = placed.join(spreads, "cell").withColumn("spread", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("spreads"))).drop("spreads")
    groups = placed.groupBy("cell", "spread").count()
    cells = cells.select("cell", F.coalesce(F.sum("rows").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("cell_base"))
    within = F.coalesce(F.sum("count").over(Window.partitionBy("cell").orderBy("spread").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = groups.withColumn("base", within).join(cells, "cell").select("cell", "spread", (F.col("base") + F.col("cell_base")).alias("base"))
    number = F.row_number().over(Window.partitionBy("cell", "spread").orderBy("doc_id", "text_crc32", "size"))
    ranked = placed.withColumn("number", number).join(bases, ["cell", "spread"])
    ranked = ranked.select("doc_id", "size", "text_crc32", "cell", (F.col("base") + F.col("number") - 1).alias("rank"), "row")
    ranked = ranked.withColumn("shard", F.expr(f"(rank * {shards}) div {max(total, 1)}").cast("int"))
    return ranked.withColumn("slot", F.col("rank") - F.expr(f"(shard * {total} + {shards - 1}) div {shards}"))


def fresh(name: str, taken: list[str]) -> str:
    """The name, with underscores in front until no column has it, in any case."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


def write_shards(docs: DataFrame, path: str, shards: int = 8, rows_per_file: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> str:
    """Writes every row of `docs`, all columns, to a folder per shard, in curve order and in files of so many rows, so that readers prune files by any of the dimensions.

    Returns the name of the folders' column: `shard`, with underscores in front if `docs` has such a column. Null ids,
    repeated ids and repeated rows are rows like others. Empty input: no files.
    """
    names = docs.columns
    placed = _placed(docs, shards, id_col, text_col, source_col, lang_col, names)
    folder = fresh("shard", names)
    own = placed.repartitionByRange("shard", "rank").sortWithinPartitions("shard", "rank")
    own = own.select(*(F.col("row").getField(c).alias(c) for c in names), F.col("shard").alias(folder))
    own.write.partitionBy(folder).option("maxRecordsPerFile", rows_per_file).parquet(path)
    return folder


def manifest(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "n_chars"), folder: str = "shard") -> DataFrame:
    """Per file of written shards: its shard, rows, and the least and greatest of each column, as a reader prunes by them."""
    files = spark.read.parquet(path).withColumn("__file", F.col("_metadata.file_name"))
    bounds = [f(F.col(f"`{c}`")).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return files.groupBy(F.col(folder).alias("shard"), F.col("__file").alias("file")).agg(F.count("*").alias("rows"), *bounds)
