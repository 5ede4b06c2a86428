"""From raw documents to token ids: toxic documents out, one of each near-duplicate group kept, benchmark passages and secrets cut, texts encoded.

Every stage reads what the one before has written, whole. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, common, decontam, jaccard, secrets, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.7 or more go."""
    return toxicity.drop_toxic(docs, toxicity.trained(docs, common.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least id stays, once; a null id stays only if its group has no other.

    A document is its id and its text: rows of one id with unlike texts are apart. Texts without words are in no group; of
    their rows only repeats of one id go.
    """
    gone = jaccard.repeats(docs).select(F.col("doc_id").alias("gone"), F.col("key").alias("gone_key"))
    own, key = docs.columns, "__text"
    same = F.col("doc_id").eqNullSafe(F.col("gone")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("gone_key"))
    kept = docs.join(gone, same, "left_anti")
    apart = F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike("[^ \\t-\\r]")
    once = kept.filter(~apart).withColumn(key, F.xxhash64("text")).dropDuplicates(["doc_id", key]).select(*own)
    return once.unionByName(docs.filter(apart))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark passages are cut; documents stay."""
    return decontam.remove_benchmark(docs, common.table(spark, sf_dir, "benchmark"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; documents stay."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded bytes."""
    return bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("secrets", secret_spans), ("encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the field's scores or the encoding; tests hold the rows against plain versions.
ORACLE_SQL = None
ORACLE_SQL_BY_NAME: dict[str, str] = {}
QUERIES = {"pipeline": run}
