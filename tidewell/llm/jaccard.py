"""Near duplicates by Jaccard similarity of word shingles: an exact n-gram join in size-banded tiles.

1. Sketches of all shingles, which lie in buckets of shingles, say which may occur in more than one document, and
   about how often. Two documents of similarity t share at least t of either's shingles, so a document with fewer
   than t of its shingles repeated has no partner.
2. Equal sets become one class. Classes that share a shingle of their prefixes (rare shingles first) are
   candidates; stars over the shingles' classes, and their connected components, give clusters that hold every link.
3. Clusters are cut into tiles by size band (linked sizes are in one band or in neighbouring ones) and salt. A small
   cluster is one unit. Of a large one, first each tile is compared within itself and with a few pivots that all its
   band's tiles get; this connects nearly all that are near, with rows in proportion to the classes. Then pairs of
   tiles are compared, except where both hold classes of the cluster's greatest component alone.
   In a unit bitmap signatures bound each pair's overlap from above, pairs that may reach t are
   intersected exactly as sorted arrays, and pairs already connected are skipped. A unit sends a spanning forest.
4. Connected components of these links are the near-duplicate groups.

No step holds all pairs of a group as rows, and none caps partners.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, sketch, windows
from .components import components

WORDS, PERCENT = 5, 75
#: Classes of a tile and bytes of their sets, about; bits of a signature; bytes of text that a kernel call takes.
TILE, TILE_BYTES, SIGNATURE_BITS, SLICE_BYTES = 256, 8 << 20, 1024, 2 << 20
#: Pivots of a band of a large cluster.
PIVOTS = 4


def shingle_sets(part: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's runs of n words (of fewer: the whole sequence), ascending, and their bounds."""
    data, offsets = common.text_bytes(part.column("text"))
    data = windows.LOWER[data]
    starts, ends, bounds = windows.spans(data, offsets, windows.NOT_BLANK)
    words = windows.word_hashes(data, starts, ends)
    counts = np.diff(bounds)
    first = windows.run_starts(bounds, n)
    hashes = [windows.run_hashes(words, n, windows.MULTIPLIERS[0])[first]]
    doc = [np.repeat(np.arange(len(counts)), np.maximum(counts - n + 1, 0))]
    for k in range(1, n):
        few = np.flatnonzero(counts == k)
        if len(few):
            hashes.append(windows.mixed(windows.run_hashes(words, k, windows.MULTIPLIERS[1])[bounds[few]] + np.uint64(k)))
            doc.append(few)
    h, d = np.concatenate(hashes), np.concatenate(doc)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return h[new], np.searchsorted(d[new], np.arange(len(counts) + 1))


def least_overlap(n: np.ndarray | int, percent: int):
    """Shingles that a set of n must share with a partner at least."""
    return -(-n * percent // 100)


def signatures(sets: list[np.ndarray], bits: int = SIGNATURE_BITS) -> np.ndarray:
    """A bitmap of each set, a bit for each hash modulo the size."""
    out = np.zeros((len(sets), bits), bool)
    for k, s in enumerate(sets):
        out[k, (s >> np.uint64(20)).astype(np.int64) & (bits - 1)] = True
    return np.packbits(out, axis=1).view("<u8")


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def unit_links(sizes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, roots: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of one unit; left: which side a class is on, 2 if all pairs count; roots: classes of one root are connected already.

    sizes count whole sets; `sets` hold the shingles that may be shared.
    """
    n = len(sets)
    marks, lengths = signatures(sets), np.array([len(s) for s in sets])
    forest, out = Forest(n), []
    _, first, own = np.unique(roots, return_index=True, return_inverse=True)
    for k, r in enumerate(own.tolist()):
        forest.union(int(first[r]), k)
    for a in range(n - 1):
        b = np.arange(a + 1, n)
        b = b[((left[a] == 2) | (left[b] != left[a])) & (own[b] != own[a])]
        low, high = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
        b = b[low * 100 >= high * percent]
        if not len(b):
            continue
        most = (lengths[a] + lengths[b] - np.bitwise_count(marks[b] ^ marks[a]).sum(1, dtype=np.int64)) // 2
        b = b[(100 + percent) * most >= percent * (sizes[a] + sizes[b])]
        for c in b.tolist():
            if forest.find(a) == forest.find(c):
                continue
            small, large = (sets[a], sets[c]) if lengths[a] <= lengths[c] else (sets[c], sets[a])
            at = np.searchsorted(large, small)
            shared = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
            if 100 * shared >= percent * (int(sizes[a]) + int(sizes[c]) - shared):
                forest.union(a, c)
                out.append((a, c))
    return out


def document_sets(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, cells: float) -> DataFrame:
    """doc_id, key (the hash of the text), n_shingles, s1 and s2 (128 bits that stand for the set) and, for documents that may have a partner, `shared`: the hashes that may occur elsewhere, and `powers`: of their counts. Written."""
    rows = common.id_text(docs, id_col, text_col).withColumn("key", common.text_key())
    groups = common.grouped(rows, SLICE_BYTES)
    told = sketch.told(groups, lambda part: shingle_sets(part, n)[0], sketch.text_bytes(rows) // 6, cells=cells)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, answers in common.parts_of(batches, "told"):
            h, bounds = shingle_sets(part, n)
            known, powers = sketch.repeated(h, answers)
            may = sketch.among(h, known)
            power = np.zeros(len(h), np.uint8)
            power[may] = powers[np.searchsorted(known, h[may])]
            count = np.concatenate([[0], np.cumsum(may)])
            size = np.diff(bounds)
            keep = (count[bounds[1:]] - count[bounds[:-1]] >= least_overlap(size, percent)) & (size > 0)
            sums = []
            for m in windows.MULTIPLIERS:
                x = np.concatenate([[np.uint64(0)], np.cumsum(windows.mixed(h * np.uint64(m)))])
                sums.append(windows.mixed(x[bounds[1:]] - x[bounds[:-1]] + size.astype(np.uint64)).view(np.int64))
            of = lambda x: pa.array([x[a:b][may[a:b]].tobytes() if k else None for a, b, k in zip(bounds[:-1].tolist(), bounds[1:].tolist(), keep.tolist(), strict=True)], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(size), *map(pa.array, sums), of(h), of(power)], names=["doc_id", "key", "n_shingles", "s1", "s2", "shared", "powers"])

    sets = common.written(groups.join(told, "group", "left").mapInArrow(work, "doc_id long, key long, n_shingles long, s1 long, s2 long, shared binary, powers binary"))
    common.forget(groups)
    return sets


def candidate_clusters(rows: DataFrame, percent: int) -> DataFrame:
    """class and cluster of all classes that share a prefix shingle with another, directly or over others."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out, own = [], []
            for cls, size, data, powers in zip(*(part.column(c).to_pylist() for c in ("class", "n_shingles", "shared", "powers")), strict=True):
                h = np.frombuffer(data, "<u8")
                # Shingles found nowhere else come first in the order and can't be shared; then rare ones.
                k = size - least_overlap(size, percent) + 1 - (size - len(h))
                some = h[np.lexsort((h, np.frombuffer(powers, np.uint8)))][: max(k, 0)]
                out.append(some)
                own.append(np.full(len(some), cls))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(own).astype(np.int64))], names=["shingle", "class"])

    own = rows.select("class", "n_shingles", "shared", "powers").mapInArrow(prefixes, "shingle long, class long")
    stars = own.groupBy("shingle").agg(F.min("class").alias("a"), F.max("class").alias("z")).filter("a != z").select("shingle", "a")
    return components(own.join(stars, "shingle").filter("class != a").select("a", F.col("class").alias("b"))).select(F.col("node").alias("class"), F.col("root").alias("cluster"))


def _compared(units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: a spanning forest of the links of each unit (cluster, low, high); units: also class, left, root."""
    keys = ("cluster", "low", "high")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []

        def done():
            classes_, left, root, size, data = zip(*own, strict=True)
            found = unit_links(np.array(size), [np.frombuffer(x, "<u8") for x in data], np.array(left), np.array(root), percent)
            return pa.RecordBatch.from_arrays([pa.array([classes_[a] for a, _ in found], pa.int64()), pa.array([classes_[b] for _, b in found], pa.int64())], names=["a", "b"])

        for part in batches:
            for row in zip(*(part.column(c).to_pylist() for c in (*keys, "class", "left", "root", "n_shingles", "shared")), strict=True):
                if row[:3] != now:
                    if len(own) > 1:
                        yield done()
                    now, own = row[:3], []
                own.append(row[3:])
        if len(own) > 1:
            yield done()

    dealt = sets.join(units, "class").select(*keys, "class", "left", "root", "n_shingles", "shared")
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(linked, "a long, b long")


def links(rows: DataFrame, percent: int, tile: int = TILE) -> DataFrame:
    """a, b: links between classes that connect all that are linked, over others or directly; rows (class, n_shingles, shared, powers) may repeat a class."""
    clusters = common.written(candidate_clusters(rows, percent))
    width = math.log(100 / percent)
    small = rows.groupBy("class").agg(F.first("n_shingles").alias("n"), F.first(F.octet_length("shared")).alias("bytes"))
    sizes = clusters.join(small, "class").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / width + 1e-9).cast("long"))
    tiles = F.ceil(F.greatest(F.count("*") / tile, F.sum("bytes") / TILE_BYTES)).cast("int").alias("tiles")
    whole = sizes.groupBy("cluster").agg(((F.count("*") <= tile) & (F.sum("bytes") <= TILE_BYTES)).alias("small"))
    sizes = common.written(sizes.join(whole, "cluster"))
    sets = rows.groupBy("class").agg(F.first("n_shingles").alias("n_shingles"), F.first("shared").alias("shared"))
    none = F.lit(-1).cast("long")
    one = sizes.filter("small").select("cluster", none.alias("low"), none.alias("high"), "class")
    large = sizes.filter("not small")
    # Each tile with itself and with pivots: the classes of least hash of its own band and the next.
    bands = large.groupBy("cluster", "band").agg(tiles, *(F.min(F.struct(F.xxhash64("class", F.lit(k)).alias("h"), "class"))["class"].alias(f"p{k}") for k in range(PIVOTS)))
    own = large.join(bands.select("cluster", "band", "tiles"), ["cluster", "band"]).select("cluster", F.col("band").alias("low"), F.pmod(F.xxhash64("class"), F.col("tiles")).cast("long").alias("high"), "class")
    pivots = bands.select("cluster", F.explode(F.array(F.col("band") - 1, F.col("band"))).alias("band"), F.array(*(f"p{k}" for k in range(PIVOTS))).alias("p"))
    pivots = pivots.join(bands.select("cluster", "band", "tiles"), ["cluster", "band"]).select("cluster", F.col("band").alias("low"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles").cast("long") - 1)).alias("high"), "p")
    pivots = pivots.select("cluster", "low", "high", F.explode("p").alias("class"))
    units = one.unionByName(own.unionByName(pivots).dropDuplicates(["cluster", "low", "high", "class"]))
    found = common.written(_compared(units.select("*", F.lit(2).alias("left"), F.col("class").alias("root")), sets, percent))
    if large.isEmpty():
        return found
    # Pairs of tiles across components; what is connected already goes on as stars, which settle at once.
    joined = common.written(components(found))
    state = large.join(joined.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    parts = state.groupBy("cluster", "root").count().groupBy("cluster").agg(F.max(F.struct("count", "root"))["root"].alias("main"), F.count("*").alias("parts"))
    state = state.join(parts.filter("parts > 1"), "cluster").withColumn("rest", (F.col("root") != F.col("main")).cast("long"))
    state = common.written(state.select("cluster", "class", "band", "rest", "root", "bytes"))
    counts = state.groupBy("cluster", "band", "rest").agg(tiles)
    near = counts.select("cluster", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.struct("band", "rest", "tiles").alias("other"))
    near = counts.join(near, ["cluster", "band"]).filter((F.col("rest") == 1) | (F.col("other.rest") == 1))
    near = near.groupBy("cluster", "band", "rest", "tiles").agg(F.collect_list("other").alias("others"))  # six at most
    code = lambda band, rest, salt: (band * 2 + rest) * (1 << 32) + salt
    salted = state.join(near, ["cluster", "band", "rest"]).withColumn("me", code(F.col("band"), F.col("rest"), F.pmod(F.xxhash64("class"), F.col("tiles")).cast("long")))
    others = F.flatten(F.transform("others", lambda o: F.transform(F.sequence(F.lit(0), o["tiles"] - 1), lambda s: code(o["band"], o["rest"], s.cast("long")))))
    pairs = salted.select("cluster", "class", "root", "me", F.explode(others).alias("it"))
    left = F.when(F.col("me") == F.col("it"), 2).when(F.col("me") < F.col("it"), 0).otherwise(1)
    units = pairs.select("cluster", F.least("me", "it").alias("low"), F.greatest("me", "it").alias("high"), "class", left.alias("left"), "root")
    return joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_compared(units, sets, percent))


def classed(may: DataFrame, bits: int = 63) -> DataFrame:
    """With `class`, one number for each pair (s1, s2): a hash of it, even; pairs whose hashes are equal get odd numbers of their own instead."""
    mask = ((1 << bits) - 1) << 1
    may = may.withColumn("class", F.xxhash64("s1", "s2").bitwiseAND(F.lit(mask if mask < 1 << 63 else mask - (1 << 64))))
    pair = F.struct("s1", "s2")
    met = common.written(may.groupBy("class").agg(F.min(pair).alias("least"), F.max(pair).alias("most")).filter("least != most").select("class"))
    if met.isEmpty():
        common.forget(met)
        return may
    # Few but for a tiny `bits`: about the square of the classes by 2**64. Spark broadcasts them if their files are small enough.
    apart = may.join(met, "class", "left_semi").select(F.col("s1").alias("t1"), F.col("s2").alias("t2")).distinct()
    apart = common.written(apart.withColumn("own", F.monotonically_increasing_id() * 2 + 1))
    found = may.join(apart, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")), "left")
    return found.withColumn("class", F.coalesce("own", "class")).drop("own", "t1", "t2")


def _classes(sets: DataFrame, percent: int, tile: int, bits: int = 63) -> tuple[DataFrame, DataFrame]:
    """(documents that may have a partner, with their class; node and root of the classes that have one)."""
    may = classed(sets.filter(F.col("shared").isNotNull()), bits)
    return may, components(links(may.select("class", "n_shingles", "shared", "powers"), percent, tile))


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", cells: float = sketch.CELLS, tile: int = TILE, bits: int = 63) -> DataFrame:
    """doc_id, n_shingles and component_id (least id reachable by links) of every row.

    Two documents link when 100 * intersection >= percent * union of their shingle sets. A document of fewer than n words
    has its whole sequence as its one shingle; a null, empty or blank text has none and links with nothing. Repeated rows
    stay and share their component. A null id counts only where its component has no other; then component_id is null.
    """
    sets = document_sets(docs, n, percent, id_col, text_col, cells)
    may, roots = _classes(sets, percent, tile, bits)
    named = may.groupBy("class").agg(F.min("doc_id").alias("least")).join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
    groups = named.groupBy("root").agg(F.min("least").alias("component"))
    of_class = named.join(groups, "root").select("class", "component")
    grouped = may.select("doc_id", "n_shingles", "class").join(of_class, "class").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return grouped.unionByName(sets.filter(F.col("shared").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def repeats(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, cells: float = sketch.CELLS, tile: int = TILE) -> DataFrame:
    """doc_id and key (the hash of the text, a null one as empty) of the documents that aren't the first of their component: least id, null last, then least key.

    A document is a pair of id and text, so rows of one id with unlike texts are judged each by its own text. Links are those of near_duplicates.
    """
    sets = document_sets(docs, n, percent, "doc_id", "text", cells)
    may, roots = _classes(sets, percent, tile)
    own = may.select("class", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key").alias("document"))
    named = own.groupBy("class").agg(F.min("document").alias("least")).join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
    of_class = named.join(named.groupBy("root").agg(F.min("least").alias("first")), "root").select("class", "first")
    return own.join(of_class, "class").filter("document != first").select("document.doc_id", "document.key").distinct()
