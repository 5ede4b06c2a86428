"""A stored index of n-grams: segments that are added, merged level by level, and looked up by folders.

A segment holds `texts` (doc_id, words), the words of each text once; by the hash of a word in 64 folders and sorted, `postings`
(word, doc_id), a row for each word of a text; and `grams` (gram, word), the three-letter pieces of every word between
blanks. N-grams themselves are not stored, as they are many times the texts: a lookup takes the texts that its words lead to, and
counts their n-grams. A manifest names the segments that count. When `FAN` segments are on one level, they are
merged into one of the next, so that there are at most FAN - 1 on each, as many levels as the logarithm of what was added.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stem
from ..functions import text as T
from ..sources import manifest
from ..sources.tables import dropped, kept
from . import ordered, retrieval

FOLDERS, FAN, GRAM = 64, 4, 3
#: Words of a lookup whose folders are chosen on the driver; for more, the words are joined.
CHOSEN = 1000
#: Documents of a lookup that are sent to all tasks; for more, all texts are read.
LISTED = 500_000
#: Columns of a segment's tables.
KINDS = {"texts": "doc_id long, words array<string>", "postings": "word string, doc_id long, folder int", "grams": "gram string, word string, folder int"}


def _folder(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(FOLDERS)).cast("int")


def _put(rows: DataFrame, path: str, *by: str) -> None:
    """Each task writes its own rows, sorted within folders: nothing is shuffled, and what a sort spills goes with its task."""
    own = rows.withColumn("folder", _folder(F.col(by[0])))
    own.sortWithinPartitions("folder", *by).write.mode("overwrite").option("compression", "zstd").partitionBy("folder").parquet(path)


def _write(postings: DataFrame, path: str) -> None:
    """postings: word and doc_id; read from a table."""
    _put(postings.select("word", "doc_id"), f"{path}/postings", "word", "doc_id")
    words = postings.sparkSession.read.schema(KINDS["postings"]).parquet(f"{path}/postings").select("word").distinct()
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - GRAM + 1), lambda i: F.substr(padded, i, F.lit(GRAM))))
    _put(words.select(F.explode(grams).alias("gram"), "word"), f"{path}/grams", "gram", "word")


def add(docs: DataFrame, stop: list[str], path: str, most: int = 3, stemmed: bool = False, batch: int | None = None) -> bool:
    """Adds the documents' n-grams as a segment, and merges levels that are full; false if the stream's `batch` was added before.

    A segment counts once the manifest names it: what a stopped run leaves is never read. Words may be stemmed; lookups must then be too.
    """
    spark = docs.sparkSession
    version, now = manifest.current(spark, path)
    if batch is not None and batch <= now.get("batch", -1):
        return False
    name = uuid.uuid4().hex
    words = retrieval.words(docs, stop, stemmed).withColumn("doc_id", F.col("doc_id").cast("long"))
    words.write.option("compression", "zstd").parquet(f"{path}/{name}/texts")
    _write(_read(spark, path, name, "texts").select(F.explode(F.array_distinct("words")).alias("word"), "doc_id"), f"{path}/{name}")
    segments = [*now.get("segments", []), {"name": name, "level": 0, "most": most}]
    now = {"segments": segments, "batch": batch if batch is not None else now.get("batch", -1), "gone": []}
    manifest.commit(spark, path, version + 1, now)
    merge(spark, path)
    return True


def merge(spark: SparkSession, path: str, fan: int = FAN) -> None:
    """Merges full levels, from the lowest. What a merge replaces stays for readers until the next one is done."""
    while True:
        version, now = manifest.current(spark, path)
        # Segments of n-grams up to one length are merged with each other.
        kind = lambda s: (s["level"], s["most"])
        levels = sorted({kind(s) for s in now.get("segments", [])})
        full = next((n for n in levels if sum(kind(s) == n for s in now["segments"]) >= fan), None)
        if full is None:
            return
        own = [s["name"] for s in now["segments"] if kind(s) == full]
        name, (level, most) = uuid.uuid4().hex, full
        both = lambda table: reduce(DataFrame.unionByName, (_read(spark, path, n, table) for n in own))
        both("texts").write.option("compression", "zstd").parquet(f"{path}/{name}/texts")
        _write(both("postings"), f"{path}/{name}")
        segments = [s for s in now["segments"] if kind(s) != full] + [{"name": name, "level": level + 1, "most": most}]
        manifest.commit(spark, path, version + 1, {"segments": segments, "batch": now["batch"], "gone": own})
        for old in now["gone"]:
            manifest.delete(spark, f"{path}/{old}")


def _read(spark: SparkSession, path: str, name: str, kind: str) -> DataFrame:
    return spark.read.schema(KINDS[kind]).parquet(f"{path}/{name}/{kind}")


def _all(spark: SparkSession, path: str, kind: str, narrowed: Callable[[DataFrame], DataFrame] = lambda s: s) -> DataFrame:
    segments = manifest.current(spark, path)[1].get("segments", [])
    return reduce(DataFrame.unionByName, (narrowed(_read(spark, path, s["name"], kind)) for s in segments)) if segments else narrowed(spark.createDataFrame([], KINDS[kind]))


def _counted(spark: SparkSession, path: str, said: Callable[[Column], Column], texts: Callable[[DataFrame], DataFrame] = lambda s: s) -> DataFrame:
    """term, doc_id, freq of the n-grams for which `said` is true, of the texts that `texts` leaves."""
    segments = manifest.current(spark, path)[1].get("segments", [])
    parts = [retrieval.grams(texts(_read(spark, path, s["name"], "texts")), s["most"]) for s in segments]
    rows = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "doc_id long, term string")
    return rows.filter(said(F.col("term"))).groupBy("term", "doc_id").agg(F.count("*").alias("freq"))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The whole index: term, doc_id, freq."""
    return _counted(spark, path, lambda term: F.lit(True))


def _led_to(postings: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The texts of these postings' documents; a null id is one too."""
    ids = postings.select(F.col("doc_id").alias("led_to")).distinct()
    if ids.limit(LISTED + 1).count() > LISTED:
        return lambda texts: texts
    return lambda texts: texts.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("led_to")), "left_semi")


def _in_folders(column: str, values: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Rows of these values, from their folders alone."""

    def narrowed(rows: DataFrame) -> DataFrame:
        some = rows.sparkSession.createDataFrame([(v,) for v in values], "v string").select(_folder(F.col("v"))).distinct()
        return rows.filter(F.col("folder").isin([r[0] for r in some.collect()]) & F.col(column).isin(values))

    return narrowed


def asked(spark: SparkSession, phrase: str, stop: list[str], stemmed: bool = False) -> list[str]:
    """The words of a phrase as the index has them."""
    words = T.without(T.tokens(F.lit(phrase)), stop)
    return spark.range(1).select(stem.stems(words) if stemmed else words).first()[0]


def terms(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The postings of these terms: of each, one word's folder."""
    first = list(dict.fromkeys(n.split(" ")[0] for n in names))
    led = _led_to(_all(spark, path, "postings", _in_folders("word", first)))
    return _counted(spark, path, lambda term: term.isin(names), led)


def containing(spark: SparkSession, path: str, phrase: list[str]) -> DataFrame:
    """The postings of all terms that hold the phrase's words in a row: from the folder of its longest word. None for an empty phrase."""
    if not phrase:
        return _counted(spark, path, lambda term: F.lit(False))
    word, said = max(phrase, key=len), f" {' '.join(phrase)} "
    led = _led_to(_all(spark, path, "postings", _in_folders("word", [word])))
    return _counted(spark, path, lambda term: F.concat(F.lit(" "), term, F.lit(" ")).contains(said), led)


def words_with(spark: SparkSession, path: str, piece: str) -> DataFrame:
    """The index's words that hold the piece between blanks (` a` begins with a, `a ` ends with it): by three-letter pieces, then verified; a shorter one by all words."""
    grams = list(dict.fromkeys(piece[i : i + GRAM] for i in range(len(piece) - GRAM + 1)))
    rows = _all(spark, path, "grams", _in_folders("gram", grams) if grams else lambda s: s.filter(F.col("gram").startswith(" ")))
    found = rows.select("gram", "word").distinct()
    if grams:
        found = found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams))
    return found.select("word").distinct().filter(F.concat(F.lit(" "), "word", F.lit(" ")).contains(piece))


def literal(spark: SparkSession, path: str, text: str) -> DataFrame:
    """The postings of all terms that hold the text anywhere, within words too. None for an empty or blank text.

    The text's pieces between blanks are looked up among the words, the longest alone: terms hold its words, and are then compared as a whole.
    """
    pieces = text.split(" ")
    best = max(range(len(pieces)), key=lambda k: len(pieces[k]))
    if not pieces[best]:
        return _counted(spark, path, lambda term: F.lit(False))
    piece = (" " if best > 0 else "") + pieces[best] + (" " if best < len(pieces) - 1 else "")
    words = kept(words_with(spark, path, piece))
    few = [r[0] for r in words.limit(CHOSEN + 1).collect()]
    narrowed = _in_folders("word", few) if len(few) <= CHOSEN else lambda s: s.join(words, "word", "left_semi")
    led = _led_to(_all(spark, path, "postings", narrowed))
    holds = lambda texts: led(texts).filter(F.array_join("words", " ").contains(text))
    found = _counted(spark, path, lambda term: term.contains(text), holds)
    if len(few) <= CHOSEN:
        dropped(words)
    return found


def ranked(index: DataFrame, block: int = 1000, hot: int = 1_000_000) -> DataFrame:
    """term, block, df, freq and postings: all postings of a term, most frequent first, then by id, in blocks of `block`.

    The list of a term is in one order as a whole, yet no row holds more than a block. Terms of more than `hot` postings are
    put in order over all tasks (ordered.py), the others where they meet.
    """
    at = F.col("block") if "block" in index.columns else F.floor(F.col("doc_id") / block).alias("block")
    met = index.groupBy("term", at).agg(F.collect_list(F.struct((-F.col("freq")).alias("f"), "doc_id")).alias("own"))
    # Written once, as it is read for the counts, for the lists and for the hot terms. Numbers apart take half the room of pairs.
    met = kept(met.select("term", F.transform("own", lambda x: x["f"]).alias("f"), F.transform("own", lambda x: x["doc_id"]).alias("d")))
    many = kept(met.groupBy("term").agg(F.sum(F.size("d")).alias("count")).filter(F.col("count") > hot).select("term"))
    pairs = lambda f, d: F.zip_with(f, d, lambda x, y: F.struct(x.alias("f"), y.alias("doc_id")))
    own = F.flatten(F.transform(F.collect_list(F.struct("f", "d")), lambda x: pairs(x["f"], x["d"])))
    few = met.join(F.broadcast(many), "term", "left_anti").groupBy("term").agg(F.array_sort(own).alias("own"))
    cut = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.size("own") - 1) / block)), lambda b: F.struct(b.alias("block"), F.slice("own", (b * block + 1).cast("int"), block).alias("own")))
    rows = few.select("term", F.inline(cut))
    if not many.isEmpty():
        hot_rows = met.join(F.broadcast(many), "term", "left_semi").select("term", F.inline(pairs(F.col("f"), F.col("d")))).select("term", "doc_id", (-F.col("f")).alias("freq"))
        placed = ordered.counted(ordered.ordered(hot_rows, "term", F.desc("freq"), "doc_id"), "place")
        placed = ordered.previous(placed, "before", "term")
        placed = ordered.latest(placed, "first", F.col("before").isNull() | (F.col("before.term") != F.col("term")), "place")
        placed = placed.withColumn("block", F.floor((F.col("place") - F.col("first.place")) / block))
        rows = rows.unionByName(placed.groupBy("term", "block").agg(F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("f"), "doc_id"))).alias("own")))
    said = F.array_join(F.transform("own", lambda x: F.concat_ws(":", x["doc_id"], -x["f"])), " ")
    return rows.select("term", "block", F.size("own").cast("long").alias("df"), F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s - x["f"]).alias("freq"), said.alias("postings"))


#: Where an application has stored the index of a table, by the table's files and how it was made.
_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, docs: DataFrame, stop: list[str], new_folder: Callable[[SparkSession], str], stemmed: bool = False) -> str:
    """The folder of the index of `docs` (a table read from files): made once an application, and again when the files change."""
    jvm = spark.sparkContext._jvm
    sizes = []
    for name in sorted(docs.inputFiles()):
        place = jvm.org.apache.hadoop.fs.Path(name)
        status = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place)
        sizes.append((name, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, tuple(sizes), tuple(stop), stemmed)
    if key not in _STORED:
        path = new_folder(spark)
        add(docs, stop, path, stemmed=stemmed)
        _STORED[key] = path
    return _STORED[key]
