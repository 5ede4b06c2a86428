"""Total orders without a single task: places, running counts and carried values over range partitions.

Rows are dealt by ranges of the order's columns and written once, sorted. What a row needs of the rows before it is then
taken within its partition, and from one summary a partition of all partitions before; only these summaries, as many as
there are partitions, pass through the driver. A key with a third of all rows is cut wherever a range ends.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept

#: Columns of an ordered table: partition and row within it.
PART, ROW = "__part", "__row"


def ordered(rows: DataFrame, *by: str | Column, parts: int | None = None) -> DataFrame:
    """The rows, written in the order of `by` (which should end in something unique, so that no range is large), each with its partition and its row there."""
    dealt = rows.drop(PART, ROW).repartitionByRange(*([parts] if parts else []), *by).sortWithinPartitions(*by)
    at = kept(dealt.withColumn("__at", F.monotonically_increasing_id()))
    return at.select("*", F.shiftright("__at", 33).alias(PART), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)).alias(ROW)).drop("__at")


def _before() -> Window:
    return Window.partitionBy(PART).orderBy(ROW)


def _carried(rows: DataFrame, summary: list[Column], fold, start, kind: str) -> DataFrame:
    """part and carry: what the partitions before each one leave, folded in their order; a row a partition passes through the driver."""
    state, out = start, []
    for part, *own in rows.groupBy(PART).agg(*summary).sort(PART).collect():
        out.append((part, state))
        state = fold(state, *own)
    return F.broadcast(rows.sparkSession.createDataFrame(out, f"{PART} long, carry {kind}"))


def counted(rows: DataFrame, name: str, flag: Column | None = None) -> DataFrame:
    """With `name`: how many rows (of those the flag is true for) come before, in the whole order."""
    own = F.lit(1).cast("long") if flag is None else F.when(flag, 1).otherwise(0).cast("long")
    carry = _carried(rows, [F.sum(own).alias("n")], lambda state, n: state + n, 0, "long")
    local = F.col(ROW) if flag is None else F.coalesce(F.sum(own).over(_before().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn(name, local).join(carry, PART).withColumn(name, F.col(name) + F.col("carry")).drop("carry")


def previous(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """With `name`: a struct of the columns of the row before, in the whole order; null for the first."""
    value = F.struct(*columns)
    kind = rows.select(value.alias("v")).schema["v"].dataType.simpleString()
    carry = _carried(rows, [F.max_by(value, ROW).alias("v")], lambda state, v: v, None, kind)
    return rows.withColumn(name, F.lag(value).over(_before())).join(carry, PART).withColumn(name, F.coalesce(name, "carry")).drop("carry")


def latest(rows: DataFrame, name: str, mark: Column, *columns: str) -> DataFrame:
    """With `name`: a struct of the columns of the last marked row up to and with this one; null before the first."""
    value = F.when(mark, F.struct(*columns))
    kind = rows.select(value.alias("v")).schema["v"].dataType.simpleString()
    carry = _carried(rows, [F.max_by(value, F.when(mark, F.col(ROW))).alias("v")], lambda state, v: state if v is None else v, None, kind)
    filled = F.last(value, ignorenulls=True).over(_before().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, filled).join(carry, PART).withColumn(name, F.coalesce(name, "carry")).drop("carry")


def numbered(rows: DataFrame, *by: str | Column, name: str = "place") -> DataFrame:
    """The rows with their place in the order, from 0 without gaps."""
    return counted(ordered(rows, *by), name).drop(PART, ROW)


def inversions(x: np.ndarray) -> np.ndarray:
    """Of each of distinct numbers, how many before it are greater; bit by bit of their ranks, from the highest."""
    n = len(x)
    out, rank, order = np.zeros(n, np.int64), np.empty(n, np.int64), np.arange(n)
    rank[np.argsort(x)] = order
    for bit in reversed(range(max(n - 1, 0).bit_length())):
        now = rank[order]
        one, head = (now >> bit) & 1, np.diff(now >> (bit + 1), prepend=-1) != 0
        ones = np.cumsum(one)
        before = (ones - one)[head][np.cumsum(head) - 1]  # those of smaller prefixes
        out[order] += np.where(one == 0, ones - before, 0)
        order = order[np.argsort(now >> bit, kind="stable")]
    return out


def greater_before(rows: DataFrame, place: str, value: str, block: int = 1 << 16, most: int = 1024) -> DataFrame:
    """place and n: how many rows of smaller place have a greater value; rows of null value are left out.

    Places and values are distinct numbers from 0 on. Both are cut into blocks of `block` numbers, or more, so that there are
    at most `most` blocks. Pairs in one block of places are counted where the block is; pairs in one block of values but
    not of places, there; the rest are sums over the grid of blocks, of `most` times `most` cells. No task holds more than a block.
    """
    own = rows.filter(F.col(value).isNotNull()).select(F.col(place).alias("p"), F.col(value).alias("v"))
    top = rows.agg(F.max(F.greatest(place, value))).first()[0]
    block = max(block, -(-((top or 0) + 1) // most))
    own = own.select("p", "v", F.floor(F.col("p") / block).alias("pb"), F.floor(F.col("v") / block).alias("vb"))

    def near(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("p")
        return pd.DataFrame({"p": part["p"], "n": inversions(part["v"].to_numpy())})

    def far(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("p")
        values, blocks = part["v"].to_numpy(), part["pb"].to_numpy()
        n = inversions(values)
        heads = np.flatnonzero(np.diff(blocks, prepend=-1))
        for a, b in zip(heads, [*heads[1:], len(blocks)], strict=True):
            n[a:b] -= inversions(values[a:b])
        return pd.DataFrame({"p": part["p"], "n": n})

    # The grid, with a row for each block of places and of values that there is, empty ones too.
    grid = own.groupBy("pb", "vb").agg(F.count("*").alias("c"))
    last = (top or 0) // block
    full = grid.select("vb").distinct().select("vb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("pb")).join(grid, ["pb", "vb"], "left")
    earlier = F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy("vb").orderBy("pb").rowsBetween(Window.unboundedPreceding, -1))
    greater = F.sum("earlier").over(Window.partitionBy("pb").orderBy(F.desc("vb")).rowsBetween(Window.unboundedPreceding, -1))
    apart = full.withColumn("earlier", earlier).withColumn("n", F.coalesce(greater, F.lit(0))).select("pb", "vb", "n")
    parts = (own.groupBy("pb").applyInPandas(near, "p long, n long"), own.groupBy("vb").applyInPandas(far, "p long, n long"), own.join(apart, ["pb", "vb"]).select("p", "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(F.col("p").alias(place)).agg(F.sum("n").alias("n"))
