"""Many phrases in many texts: the words of a text that may begin a phrase are joined with a table of phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import kept

#: Bytes of phrases that are sent to all tasks at most; more are joined by a shuffle.
BLOCK_BYTES = 8 << 20
#: Words by which texts and phrases meet; longer phrases are then compared as a whole.
HEAD = 2


def listed(words: DataFrame, column: str, most: int = 100_000) -> list[str]:
    """A small table's distinct values as a list, for use in expressions; ValueError if it has more than `most`."""
    found = [r[0] for r in words.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} values of {column}: join the table instead")
    return sorted(found)


def matched(rows: DataFrame, text: str | Column, phrases: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows' columns and code: a row for each distinct code of which a phrase is in the text, as whole words.

    phrases: code and phrase. Text and phrases are compared as functions.text.normalised has them; blank phrases and null codes
    match nothing. Rows are written once, numbered; of a row only its distinct heads (as many words as heads of phrases have)
    and its number meet the phrases, and no task holds them all, unless they are at most `block_bytes`.
    """
    own = phrases.select("code", F.coalesce(T.normalised(F.col("phrase")), F.lit("")).alias("phrase")).filter("phrase != '' and code is not null").distinct()
    words = F.split("phrase", " ")
    own = kept(own.select("code", F.array_join(F.slice(words, 1, HEAD), " ").alias("__head"), F.when(F.size(words) > HEAD, F.col("phrase")).alias("__phrase"), F.least(F.size(words), F.lit(HEAD)).alias("n")))
    lengths, size, longer = own.agg(F.collect_set("n"), F.sum(F.octet_length("code") + F.octet_length("__head") + F.coalesce(F.octet_length("__phrase"), F.lit(0))), F.count("__phrase")).first()
    if not lengths:
        return rows.limit(0).withColumn("code", F.lit(None).cast("string"))
    own = own.drop("n")
    said = T.normalised(F.col(text) if isinstance(text, str) else text)
    told = kept(rows.withColumn("__said", F.coalesce(said, F.lit(""))).withColumn("__row", F.monotonically_increasing_id()))
    heads = F.concat(*(T.ngrams(F.split("__said", " "), n) for n in sorted(lengths)))
    met = told.select("__row", F.explode(F.array_distinct(heads)).alias("__head")).join(F.broadcast(own) if size <= block_bytes else own, "__head")
    out = told.join(met.select("__row", "code", "__phrase").distinct(), "__row")
    if longer:
        held = F.concat(F.lit(" "), "__said", F.lit(" ")).contains(F.concat(F.lit(" "), "__phrase", F.lit(" ")))
        out = out.filter(F.col("__phrase").isNull() | held).dropDuplicates(["__row", "code"])
    return out.select(*rows.columns, "code")
