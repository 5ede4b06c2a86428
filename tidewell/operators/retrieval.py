"""Exact vector search, filters over nested sections, staged retrieval, and postings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stem
from ..functions import text as T
from ..functions.filters import Filter, all_of
from ..sources.tables import cut

#: Query vectors of one pass, and rows that they are multiplied with at once.
QUERIES, ROWS = 1024, 1000
#: Bytes of text whose n-grams of one length a task counts, about.
TASK_BYTES = 8 << 20
#: Digits by which scores differ: engines add in different orders.
DIGITS = 12


def inner_product(vector: Column, query: list[float]) -> Column:
    q = F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def top_k(vectors: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The k best by inner product (told apart by twelve digits, shown with six), ties by id; `where` is applied before scoring. Each partition keeps k rows."""
    rows = vectors if where is None else vectors.filter(where)
    scored = rows.select("vec_id", "label", F.round(inner_product(F.col("embedding"), query), DIGITS).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(k).withColumn("score", F.round("score", 6))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None, block: int = QUERIES) -> DataFrame:
    """query_id, vec_id, label, score: the k best rows for every query row, as top_k has them. Rows without a vector, on either side, have no score.

    Queries come from Spark a block at a time; each block is one pass over the rows and is written before the next, so
    driver and executors hold one block. Each task keeps k rows a query, and a grouped top k merges them.
    """
    rows = (vectors if where is None else vectors.filter(where)).select("vec_id", "label", "embedding").filter("embedding is not null")
    context, out, own = vectors.sparkSession.sparkContext, [], []

    def done() -> None:
        one = context.broadcast(([i for i, _ in own], np.array([v for _, v in own], np.float64)))
        out.append(cut(_best(rows, one, k)))
        one.destroy()
        own.clear()

    for row in queries.filter("embedding is not null").select("vec_id", "embedding").toLocalIterator():
        own.append((row[0], np.array(row[1], np.float32)))
        if len(own) == block:
            done()
    if own or not out:
        done()
    return reduce(DataFrame.unionByName, out)


def _best(rows: DataFrame, one, k: int) -> DataFrame:
    types = dict(rows.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = one.value
        n = len(ids)
        floor = np.full(n, -np.inf)  # the score of each query's k-th row so far
        q, score, kept = np.zeros(0, np.int64), np.zeros(0), None
        for batch in batches if n else ():
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                flat = np.asarray(part.column("embedding").flatten()).astype(np.float64)
                scores = np.round(flat.reshape(part.num_rows, -1) @ matrix.T, DIGITS)
                row, asked = np.nonzero(scores >= floor)
                if not len(row):
                    continue
                found = pa.Table.from_batches([part.select(["vec_id", "label"])]).take(pa.array(row))
                kept = found if kept is None else pa.concat_tables([kept, found])
                q, score = np.concatenate([q, asked]), np.concatenate([score, scores[row, asked]])
                # Null ids come first, as Spark sorts them.
                order = np.lexsort((np.asarray(kept["vec_id"].fill_null(0)), np.asarray(kept["vec_id"].is_valid()), -score, q))
                q, score = q[order], score[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                best = place < k
                kept, q, score, last = kept.take(pa.array(order[best])), q[best], score[best], (place == k - 1)[best]
                floor[q[last]] = score[last]
        if kept is not None:
            for part in kept.append_column("q", pa.array(q)).append_column("query_id", pa.array([ids[x] for x in q], pa.int64())).append_column("score", pa.array(score)).combine_chunks().to_batches(max_chunksize=10_000):
                yield part.select(["q", "query_id", "vec_id", "label", "score"])

    found = rows.mapInArrow(work, f"q long, query_id long, vec_id {types['vec_id']}, label {types['label']}, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).filter(F.col("place") <= k).select("query_id", "vec_id", "label", F.round("score", 6).alias("score"))


def kinds_of(records: DataFrame):
    """The fields of a section."""
    return records.schema["sections"].dataType.elementType


def pruned(records: DataFrame, filters: list[Filter]) -> DataFrame:
    """Records with only the sections that satisfy all filters at once; records left without go. No filters: unchanged. A filter on `code_prefix` asks the record's `code`."""
    if not filters:
        return records
    code = F.col("code") if "code" in records.columns else None
    return records.withColumn("sections", F.filter("sections", all_of(filters, kinds_of(records), code))).filter(F.size("sections") > 0)


def staged(records: DataFrame, stages: list[Column], order: list[Column], key: str, k: int) -> DataFrame:
    """Best k over stages of priority: a key counts in the first stage it meets; within a stage by `order`."""
    stage = F.coalesce(*(F.when(s, F.lit(i)) for i, s in enumerate(stages)))
    return records.withColumn("stage", stage).filter("stage is not null").orderBy("stage", *order, key).limit(k)


def words(docs: DataFrame, stop: list[str], stemmed: bool = False) -> DataFrame:
    """doc_id (and block, if there is one) and words of each text, but for stop words; words may be stemmed."""
    own = T.without(T.tokens(F.coalesce("text", F.lit(""))), stop)
    return docs.select("doc_id", *(["block"] if "block" in docs.columns else []), (stem.stems(own) if stemmed else own).alias("words"))


def grams(rows: DataFrame, most: int) -> DataFrame:
    """The rows with term, a row for each n-gram of `words`, n up to `most`, in place of the words."""
    other = [c for c in rows.columns if c != "words"]
    rows = rows.withColumn("w1", F.col("words"))
    for n in range(2, most + 1):  # each length once, as a column of its own
        rows = rows.withColumn(f"w{n}", T.longer(F.col(f"w{n - 1}"), F.col("words"), n))
    return rows.select(*other, F.explode(F.concat(*(f"w{n}" for n in range(1, most + 1)))).alias("term"))


def postings(docs: DataFrame, stop: list[str], most: int = 3, stemmed: bool = False, block: int | None = None) -> DataFrame:
    """term, doc_id, freq of all n-grams of the texts' words, n up to `most`; words may be stemmed first.

    N-grams move once, by term; they are counted where a term's meet, which the index by term needs anyway. With `block`, texts
    move in their place, by block of so many consecutive ids (a column `block` then), and no n-gram moves: all that is grouped
    by block is grouped where its texts are. Tasks grow in number with the texts, not in size.
    """
    if block is None:
        terms = grams(words(docs.select("doc_id", "text"), stop, stemmed), most)
        return terms.repartition("term").groupBy("term", "doc_id").agg(F.count("*").alias("freq"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = docs.select("doc_id", "text", F.floor(F.col("doc_id") / block).alias("block")).repartition(size * most // TASK_BYTES + 1, "block")
    return grams(words(rows, stop, stemmed), most).groupBy("term", "block", "doc_id").agg(F.count("*").alias("freq"))


def folded(*indexes: DataFrame) -> DataFrame:
    """Several indexes as one: frequencies of the same term and document add up."""
    return reduce(DataFrame.unionByName, indexes).groupBy("term", "doc_id").agg(F.sum("freq").alias("freq"))


def _block(index: DataFrame, block: int) -> Column:
    return F.col("block") if "block" in index.columns else F.floor(F.col("doc_id") / block).alias("block")


def merged(index: DataFrame, block: int = 1000) -> DataFrame:
    """All postings of each term (most frequent first, then by id), in blocks of so many consecutive ids, with the block's documents and occurrences: no row grows with the corpus."""
    own = F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("f"), "doc_id")))
    said = F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["doc_id"], -x["f"])), " ")
    return index.groupBy("term", _block(index, block)).agg(F.count("*").alias("df"), F.sum("freq").alias("freq"), said.alias("postings"))


def stored(index: DataFrame, path: str, folders: int = 64) -> None:
    """Writes postings sorted by term into folders by the term's hash, so that a lookup reads one folder, and of it few row groups."""
    own = index.withColumn("folder", _folder(F.col("term"), folders))
    own.repartition(folders, "folder").sortWithinPartitions("folder", "term").write.partitionBy("folder").parquet(path)


def looked_up(stored_index: DataFrame, terms: list[str], folders: int = 64) -> DataFrame:
    """The postings of these terms, from their folders alone."""
    found = stored_index.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string").select(_folder(F.col("term"), folders)).distinct()
    return stored_index.filter(F.col("folder").isin([r[0] for r in found.collect()]) & F.col("term").isin(terms)).drop("folder")


def _folder(term: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


def printed(index: DataFrame, block: int = 1000) -> DataFrame:
    """Lines `term | id freq id freq ...`, most frequent first; a line holds the postings of `block` consecutive ids, so none grows with the corpus."""
    own = F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("f"), "doc_id")))
    line = F.concat(F.col("term"), F.lit(" | "), F.array_join(F.transform(own, lambda x: F.concat_ws(" ", x["doc_id"], -x["f"])), " "))
    return index.groupBy("term", _block(index, block)).agg(line.alias("line"))


def parsed(lines: DataFrame) -> DataFrame:
    """term, doc_id, freq of printed lines."""
    pairs = F.regexp_extract_all(F.regexp_extract("line", r" \| (.*)$", 1), F.lit(r"(-?\d+ \d+)"), 1)
    rows = lines.select(F.regexp_extract("line", r"^(.*?) \| ", 1).alias("term"), F.explode(pairs).alias("p")).withColumn("p", F.split("p", " "))
    return rows.select("term", F.col("p")[0].cast("long").alias("doc_id"), F.col("p")[1].cast("long").alias("freq"))


def latest(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Per key and field the value of the latest row in which it is neither null nor empty: partial aggregation, no sort."""
    pick = [F.max(F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), F.struct(*order, f)))[f].alias(f) for f in fields]
    return rows.groupBy(key).agg(*pick)


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """lines (distinct rows of `a`), other (rows of one side alone, of the side that has more) and their ratio; null for an empty `a`."""
    both = a.distinct().select(F.struct(*a.columns).alias("x"), F.lit(True).alias("in_a")).join(b.distinct().select(F.struct(*b.columns).alias("y"), F.lit(True).alias("in_b")), F.col("x").eqNullSafe(F.col("y")), "full")
    counts = both.agg(F.count("in_a").alias("lines"), F.greatest(F.count_if(F.col("in_b").isNull()), F.count_if(F.col("in_a").isNull())).alias("other"))
    return counts.withColumn("ratio", F.round(F.try_divide("other", "lines"), 6))
