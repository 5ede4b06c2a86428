"""Words counted over all texts, and by how many documents have them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def uncommon(docs: DataFrame, key: str, words: str, part: int, of: int) -> DataFrame:
    """term and freq: all words but those that more than `part` in `of` rows' documents have.

    A document is a key; rows without one are texts, but not documents. Texts are read once: a row sends its words and its
    distinct words, which tasks add up before they move, so what moves is the vocabulary. Only words of keys that have
    several rows move with their key.
    """
    total = docs.count()
    repeated = docs.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").select(F.col(key).alias("__key"))
    marked = docs.withColumn("__once", F.col(key).isNotNull().cast("long"))
    more = None
    if not repeated.isEmpty():
        of_several = docs.join(repeated, F.col(key) == F.col("__key"), "left_semi")
        more = of_several.select(key, F.explode(words).alias("term")).distinct().groupBy("term").agg(F.count("*").alias("df"))
        marked = docs.join(repeated, F.col(key) == F.col("__key"), "left").withColumn("__once", (F.col(key).isNotNull() & F.col("__key").isNull()).cast("long"))
    every = F.transform(words, lambda t: F.struct(t.alias("term"), F.lit(1).cast("long").alias("freq"), F.lit(0).cast("long").alias("df")))
    once = F.transform(F.array_distinct(words), lambda t: F.struct(t.alias("term"), F.lit(0).cast("long").alias("freq"), F.col("__once").alias("df")))
    counts = marked.select(F.inline(F.concat(every, once))).groupBy("term").agg(F.sum("freq").alias("freq"), F.sum("df").alias("df"))
    if more is not None:
        counts = counts.join(more.withColumnRenamed("df", "more"), "term", "left").withColumn("df", F.col("df") + F.coalesce("more", F.lit(0)))
    return counts.filter(of * F.col("df") <= part * total).select("term", "freq")
