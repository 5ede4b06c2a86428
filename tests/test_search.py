"""Filters as data: masks are what predicates say, and a thousand different lists are one pass."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from tidewell.functions import filters as FL
from tidewell.operators import retrieval, search

KIND = "array<struct<n:int,x:double,s:string,b:boolean,tags:array<string>,nums:array<int>>>"
VALUES = [None, 0, 1, 2.5, "2", "a", "b", " 1 ", "", True, False, "nan", [], ["a"], ["a", "b"], [1, 2], ["a", 1], "1_0", [None]]


def section(rng):
    return tuple(rng.choice([None, *some]) for some in ((0, 1, 2), (0.0, 1.0, 2.5), ("a", "b", ""), (True, False), ([], ["a"], ["a", "b", None]), ([1], [2, 1])))


def records(spark, rng, n):
    codes = ["CS 1", "cs 2", "MA 1", " x", "", None]
    return spark.createDataFrame([(k, rng.choice(codes), [rng.random(), rng.random()], [section(rng) for _ in range(rng.randint(0, 4))]) for k in range(n)], f"key long, code string, vector array<double>, sections {KIND}")


def filter_(rng):
    return FL.Filter(rng.choice(["n", "x", "s", "b", "tags", "nums", "code_prefix"]), rng.choice(FL.OPS), rng.choice([*VALUES, "cs", "CS", ["cs", "ma"]]))


def test_masks_are_what_predicates_say(spark):
    rng = random.Random(3)
    rows = records(spark, rng, 60)
    asked = [filter_(rng) for _ in range(120)]
    kinds = retrieval.kinds_of(rows)
    want = rows.select(*(F.transform("sections", FL.predicate(f, kinds, F.col("code"))).alias(f"f{k}") for k, f in enumerate(asked))).collect()
    batch = rows.select("code", "sections").toArrow().combine_chunks().to_batches()[0]
    sections = search.Sections(batch, asked, kinds)
    for k, f in enumerate(asked):
        assert sections.masks[k].tolist() == [x for r in want for x in r[k]], f


def test_a_thousand_lists_of_filters(spark):
    rng = random.Random(5)
    rows = records(spark, rng, 80)
    some_filters = [filter_(rng) for _ in range(60)]
    lists = [rng.sample(some_filters, rng.choice([0, 1, 2, 3, 3, 4])) for _ in range(1000)]
    assert len({tuple(sorted(some_filters.index(f) for f in fs)) for fs in lists}) > 600
    said = lambda fs: json.dumps([{"field": f.field, "op": f.op, "value": f.value} for f in fs] + [{"field": "unknown", "op": "eq", "value": 1}, "no filter"])
    queries = spark.createDataFrame([(q, [rng.random(), rng.random()], said(fs)) for q, fs in enumerate(lists)], "query_id long, vector array<double>, filters string")
    found = search.search(rows, queries, ("code_prefix", "n"), "key", 5, block=700)
    got: dict = {}
    for r in found.collect():
        got.setdefault((r.query_id, r.list), []).append((r.place, r.key, r.score, len(r.sections)))
    own = {r.key: r for r in rows.collect()}
    vectors = {r.query_id: np.array(r.vector) for r in queries.collect()}
    kinds = retrieval.kinds_of(rows)
    distinct = sorted({(f.field, f.op, json.dumps(f.value)) for fs in lists for f in fs})
    masks = rows.select("key", *(F.transform("sections", FL.predicate(FL.Filter(a, b, json.loads(c)), kinds, F.col("code"))).alias(f"f{k}") for k, (a, b, c) in enumerate(distinct))).collect()
    mask = {(r.key, d): r[k + 1] for r in masks for k, d in enumerate(distinct)}
    some = lambda key, fs: [all(x) for x in zip(*(mask[key, (f.field, f.op, json.dumps(f.value))] for f in fs), strict=True)] if fs else [True] * len(own[key].sections)
    for q, fs in enumerate(lists):
        score = {k: round(float(np.array(r.vector) @ vectors[q]), 12) for k, r in own.items()}
        order = sorted(own, key=lambda k: (-score[k], k))  # noqa: B023
        tell = lambda keys, fs: [(p + 1, k, round(score[k], 6), sum(some(k, fs))) for p, k in enumerate(keys)]  # noqa: B023, E731
        assert sorted(got.get((q, "any"), [])) == tell(order[:5], [])
        staged = FL.stages(fs, ("code_prefix", "n"))
        if not fs:
            want = order[:5]
        else:
            want = []
            for stage in staged or [fs]:
                some_ = [k for k in order if any(some(k, stage))][: FL.fetch_size(5, stage)]
                want += [k for k in some_ if k not in want]
            want = want[:5]
        best = [k for k in want if not fs or any(some(k, fs))]
        assert sorted(got.get((q, "best"), [])) == tell(best, fs), fs
        partial = [k for k in want if staged and not best and any(some(k, staged[0]))]
        assert sorted(got.get((q, "partial"), [])) == tell(partial, staged[0] if staged else []), fs
