"""Batch search: a table of queries, each with its vector and filters, against all records at once.

Of every query: the best records of all; and, if it has filters, the best of those with a section that satisfies them.
A filter on the code prefix leads: its stages (the prefix alone, then with the next filters) are searched one by one
and merged in that order. What is found gets its record back, with the sections that satisfy all filters (`best`);
if there are none, with those that satisfy the leading filter (`partial`); and the best of all (`any`).

Filters are data, not part of the plan: the distinct conditions of a block of queries are evaluated once on each batch of
sections and combined for each distinct list of filters, so a thousand lists cost no more planning than one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import filters as FL
from ..sources.tables import cut, kept, sliced, small_batches
from .retrieval import DIGITS, QUERIES, kinds_of


#: Scores that a task makes at once: rows of a slice times jobs of a block.
CELLS = 1 << 18
#: Rows of a slice whose sections are pruned at once.
ROWS = 500


def parsed(text: str | None, fields: set[str]) -> list[FL.Filter]:
    """The valid filters of a JSON list of {field, op, value}; what isn't a list has none."""
    try:
        return FL.valid(json.loads(text or "[]"), fields)
    except ValueError:
        return []


def fields_of(records: DataFrame) -> set[str]:
    return {*kinds_of(records).names, "code_prefix"}


def search(records: DataFrame, queries: DataFrame, priority: tuple[str, ...], key: str = "code", k: int = 40, block: int = QUERIES) -> DataFrame:
    """query_id, list, place (from 1), key, score and sections of every result of every query (query_id, vector, filters: JSON).

    records: key, code, vector, sections; those without a vector aren't found. Queries without a vector find nothing.
    Records are written once, whatever they are made of. Queries come a block at a time, and each block's results are written
    before the next, so that driver and tasks hold one block; a block is one pass over the records. Ties go by key.
    """
    small_batches(records.sparkSession)
    columns = [*dict.fromkeys([key, "code", "vector", "sections"])]
    records = kept(records.filter("vector is not null").select(*columns))
    fields, out, own = fields_of(records), [], []
    for row in queries.filter("vector is not null").select("query_id", "vector", "filters").toLocalIterator():
        own.append((row[0], np.array(row[1], np.float64), parsed(row[2], fields)))
        if len(own) == block:
            out.append(cut(_block(records, own, priority, key, k)))
            own = []
    if own or not out:
        out.append(cut(_block(records, own, priority, key, k)))
    return reduce(DataFrame.unionByName, out)


class Sets:
    """Distinct lists of filters, each a list of numbers of distinct conditions; -1 stands for no filter."""

    def __init__(self):
        self.conditions: dict[str, tuple[int, FL.Filter]] = {}
        self.lists: dict[tuple[int, ...], int] = {}

    def number(self, filters: list[FL.Filter]) -> int:
        if not filters:
            return -1
        name = lambda f: json.dumps([f.field, f.op, f.value])
        own = tuple(sorted({self.conditions.setdefault(name(f), (len(self.conditions), f))[0] for f in filters}))
        return self.lists.setdefault(own, len(self.lists))

    def plain(self) -> tuple[list[FL.Filter], list[list[int]]]:
        return [f for _, f in self.conditions.values()], [list(x) for x in self.lists]


class Sections:
    """The sections of a batch, end to end, with the masks of all conditions."""

    def __init__(self, batch: pa.RecordBatch, conditions: list[FL.Filter], kinds: T.StructType):
        column = batch.column(batch.schema.get_field_index("sections"))
        self.lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
        self.flat, self.parent = pc.list_flatten(column), np.repeat(np.arange(batch.num_rows), self.lengths)
        codes = [c or "" for c in batch.column(batch.schema.get_field_index("code")).to_pylist()]
        prefixes = np.array([re.split(r"[ \t\n\x0b\f\r]+", c)[0].upper() for c in codes], dtype=object)[self.parent] if codes else np.zeros(0, object)
        self.masks = np.array([FL.mask(f, self.flat, kinds, prefixes) for f in conditions]).reshape(len(conditions), len(self.flat))

    def all_of(self, numbers: list[int]) -> np.ndarray:
        return self.masks[numbers].all(0)


def _block(records: DataFrame, queries: list[tuple], priority: tuple[str, ...], key: str, k: int) -> DataFrame:
    sets, jobs, wanted = Sets(), [], []  # (query, stage, number of the filter list, rows); (query, its id, list of all filters, of the leading one)
    for q, (_, _, fs) in enumerate(queries):
        jobs.append((q, -1, -1, k))
        staged = FL.stages(fs, priority)
        for stage, own in enumerate(staged or ([fs] if fs else [])):
            jobs.append((q, stage, sets.number(own), FL.fetch_size(k, own)))
        wanted.append((q, queries[q][0], sets.number(fs), sets.number(staged[0]) if staged else -1))
    context, kinds = records.sparkSession.sparkContext, kinds_of(records)
    one = context.broadcast((np.array([v for _, v, _ in queries], np.float64), np.array(jobs, np.int64).reshape(-1, 4), *sets.plain()))
    kind = dict(records.dtypes)[key]
    found = records.mapInArrow(_ranked(one, kinds, key), f"job int, {key} {kind}, score double")
    # Each task kept a job's best; now over all tasks, and a query's stages in order.
    told = records.sparkSession.createDataFrame([(n, *(int(x) for x in j)) for n, j in enumerate(jobs)], "job int, q long, stage int, filter_list int, most int")
    place = lambda by, *order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    hits = found.join(F.broadcast(told), "job")  # as many rows as the block has jobs
    hits = hits.withColumn("r", place(["job"], F.desc("score"), key)).filter(F.col("r") <= F.col("most"))
    hits = kept(hits.select("q", "stage", key, "score", "r"))  # at most a few hundred a query
    none = F.lit(-1)
    asked = F.broadcast(records.sparkSession.createDataFrame([tuple(w) for w in wanted], f"q long, query_id {_kind(queries)}, all_list int, lead_list int"))
    any_ = hits.filter("stage = -1").select("q", key, "score", F.col("r").alias("place")).join(asked, "q")
    plain = F.when(F.col("all_list") == -1, F.array(F.lit("any"), F.lit("best"))).otherwise(F.array(F.lit("any")))
    any_ = any_.select("q", "query_id", F.explode(plain).alias("list"), key, "score", "place", none.alias("all_list"), none.alias("lead_list"), F.lit(True).alias("plain"))
    merged = hits.filter("stage >= 0").groupBy("q", key).agg(F.min("stage").alias("stage"), F.first("score").alias("score"))
    merged = merged.withColumn("place", place(["q"], "stage", F.desc("score"), key)).filter(F.col("place") <= k).drop("stage").join(asked, "q")
    merged = merged.select("q", "query_id", F.lit("best").alias("list"), key, "score", "place", "all_list", "lead_list", F.lit(False).alias("plain"))
    # Of the records only those that were found get their sections, once for all queries.
    rows = any_.unionByName(merged).join(records.drop("vector"), key)
    whole = rows.schema["sections"].dataType.simpleString()
    columns = ["q", "query_id", "list", key, "score", "place", "lead_list", "plain"]
    full = rows.mapInArrow(_pruned(one, kinds, columns), ", ".join(f"{c} {t}" for c, t in rows.select(columns).dtypes) + f", whole {whole}, part {whole}")
    full = cut(full)
    best = full.filter((F.size("whole") > 0) | F.col("plain"))
    partial = full.filter((F.col("lead_list") >= 0) & (F.size("part") > 0)).join(best.filter("list = 'best'").select("q").distinct(), "q", "left_anti")
    out = best.select(*columns, F.col("whole").alias("sections")).unionByName(partial.select("q", "query_id", F.lit("partial").alias("list"), key, "score", "place", "lead_list", "plain", F.col("part").alias("sections")))
    out = out.withColumn("place", place(["q", "list"], "place"))
    return out.select("query_id", "list", F.col("place").cast("long").alias("place"), key, F.round("score", 6).alias("score"), "sections")


def _kind(queries: list[tuple]) -> str:
    return "string" if queries and isinstance(queries[0][0], str) else "long"


def _ranked(one, kinds: T.StructType, key: str):
    """The best rows of each job in a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, jobs, conditions, lists = one.value
        if not len(jobs):
            return
        floor, most = np.full(len(jobs), -np.inf), jobs[:, 3]
        job, score, kept_, limit = np.zeros(0, np.int64), np.zeros(0), None, CELLS

        def best() -> None:
            """Leaves each job's best, and tells what a score must reach from now on."""
            nonlocal job, score, kept_, limit
            by_key = np.empty(len(kept_), np.int64)
            by_key[np.asarray(pc.sort_indices(kept_, null_placement="at_start"))] = np.arange(len(kept_))
            order = np.lexsort((by_key, -score, job))
            job, score = job[order], score[order]
            place = np.arange(len(job)) - np.searchsorted(job, job)
            stays = place < most[job]
            last = place[stays] == most[job[stays]] - 1
            kept_, job, score = kept_.take(pa.array(order[stays])), job[stays], score[stays]
            floor[job[last]] = score[last]
            limit = max(CELLS, 2 * len(job))

        for batch in sliced(batches, max(1, CELLS // len(jobs))):
            vectors = np.asarray(batch.column("vector").flatten()).astype(np.float64).reshape(batch.num_rows, -1)
            passes = np.zeros((batch.num_rows, len(lists) + 1), bool)
            passes[:, -1] = True  # list -1: no filter
            if lists:
                sections = Sections(batch, conditions, kinds)
                for n, numbers in enumerate(lists):
                    passes[sections.parent[sections.all_of(numbers)], n] = True
            scores = np.round(vectors @ matrix.T, DIGITS)[:, jobs[:, 0]]
            row, asked = np.nonzero(passes[:, jobs[:, 2]] & (scores >= floor))
            if not len(row):
                continue
            keys = batch.column(key).take(pa.array(row))
            kept_ = keys if kept_ is None else pa.concat_arrays([kept_, keys])
            job, score = np.concatenate([job, asked]), np.concatenate([score, scores[row, asked]])
            if len(job) > limit:
                best()
        if kept_ is not None:
            best()
        if kept_ is not None:
            for at in range(0, len(job), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(job[at : at + 10_000], pa.int32()), kept_.slice(at, 10_000), pa.array(score[at : at + 10_000])], names=["job", key, "score"])

    return work


def _pruned(one, kinds: T.StructType, columns: list[str]):
    """Each row's sections that satisfy all its filters (`whole`), and those that satisfy its leading one (`part`); all of them where it has none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, conditions, lists = one.value
        for batch in sliced(batches, ROWS):
            sections, out = Sections(batch, conditions, kinds), []
            for name in ("all_list", "lead_list"):
                own = np.asarray(batch.column(batch.schema.get_field_index(name)))[sections.parent]
                stays = own < 0
                for n in np.unique(own[~stays]).tolist():
                    some = own == n
                    stays[some] = sections.all_of(lists[n])[some]
                counts = np.bincount(sections.parent[stays], minlength=batch.num_rows)
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), sections.flat.filter(pa.array(stays))))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), *out], names=[*columns, "whole", "part"])

    return work


def contexts(results: DataFrame, queries: DataFrame, record, priority: tuple[str, ...], key: str = "code", most: int = 40, others: int = 10) -> DataFrame:
    """query_id, unmatched (what a query without full matches asked beyond its leading filter) and context: a JSON object of its lists of records.

    `record` makes the column that describes a row of `results`. A list holds at most `most` records, that of any match `others`.
    """
    listed = lambda name: F.array_sort(F.collect_list(F.when((F.col("list") == name) & (F.col("place") <= (others if name == "any" else most)), F.struct("place", F.col(key).alias("key"), record.alias("record")))))
    rows = results.groupBy("query_id").agg(*(F.transform(listed(n), lambda x: x["record"]).alias(n) for n in ("best", "partial", "any")))
    fields = fields_of(results)

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = ["; ".join(FL.described(f) for f in _beyond(parsed(t, fields), priority)) for t in part.column("filters").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("query_id"), pa.array(texts, pa.string())], names=["query_id", "asked"])

    asked = queries.select("query_id", "filters").mapInArrow(said, f"query_id {dict(queries.dtypes)['query_id']}, asked string")
    rows = rows.join(asked, "query_id").withColumn("unmatched", F.when((F.size("best") == 0) & (F.size("partial") > 0), F.col("asked")).otherwise(F.lit("")))
    return rows.select("query_id", "unmatched", F.to_json(F.struct("unmatched", "best", "partial", "any")).alias("context"))


def _beyond(fs: list[FL.Filter], priority: tuple[str, ...]) -> list[FL.Filter]:
    """The filters other than the leading one (by field and op)."""
    lead = FL.first(fs, priority[0])
    return [f for f in fs if lead and (f.field, f.op) != (lead.field, lead.op)]
