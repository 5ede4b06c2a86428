"""Filter interactions, URL rules and periodic runs against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import interaction, lyndon, periodic, queries, urls

from .conftest import documents

rows_of = lambda df: Counter(map(tuple, df.collect()))


def plain_audit(docs, labels):
    """docs: (doc_id, text, lang)."""
    texts, out = {}, {}
    for i, t, _ in docs:
        if i is not None:
            texts[t or ""] = min(i, texts.get(t or "", i))
    for i, t, lang in docs:
        text = t or ""
        w = re.findall(r"[^ \t-\r]+", text)
        fails = {c for c, f in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), re.search(r"[#$%&*|]", text), i is not None and texts[text] < i), strict=True) if f}
        good, toxic = (any(x[k] == 1 for x in labels if x[0] == i and i is not None) for k in (1, 2))
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, c in enumerate(order, 1):
                own = out.setdefault((lang or "", order, step), [0] * 6)
                now = c in fails and not gone
                for k, x in enumerate((not gone and c not in fails, now, gone and c in fails, fails == {c}, now and good, now and toxic)):
                    own[k] += x
                gone |= now
    shares = Counter()
    for (part, order, step), own in out.items():
        shares[part, order[step - 1]] += own[1]
    return Counter((*k, *own, shares[k[0], k[1][k[2] - 1]]) for k, own in out.items())


def test_filter_interactions(spark, edge, none):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["Abc", "def", "x|y", "GHI", "jkl%"] + [f"w{k}" for k in range(spread)], k=n)) for n, spread in ((199, 400), (200, 400), (250, 5), (400, 900), (30, 30))] + ["", None, "a" * 5000]
    docs = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice(["en", "de", None])) for _ in range(120)]
    labels = [(k, rng.choice([0, 1, None]), rng.randint(0, 1)) for k in [None, *range(0, 30, 2), 4, 4]]
    got = interaction.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("n", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert rows_of(got) == plain_audit(docs, labels)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert rows_of(interaction.audit(edge, lab)) == plain_audit([(r.doc_id, r.text, r.lang) for r in edge.collect()], labels)
    assert interaction.audit(none, lab).count() == 0
    assert interaction.audit(edge, lab.limit(0)).count() == 600


def test_a_text_of_many_rows_is_counted_before_it_moves(spark):
    """One text in 3,000 of 4,000 rows: no task of the audit reads more than a row for each id."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "same").otherwise(F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    cells = {(r["mask"], r.n) for r in interaction.cells(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()}
    assert cells == {(1, 1001), (17, 2999)}


@pytest.mark.parametrize("name", ["op11_filter_interactions", "op12_url_rules"])
def test_queries_match_sql(spark, sf, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.select(*want.columns)) == Counter(want.fetchall())


URLS = [None, "", "x", "://", "http://", "http://A.Org", "http://a.org/", "HTTP://Org/x?y#z", "http://notorg/", "http://example.org/es/1", "http://x.example.org/es", "http://Example.ORG/en/17", "http://example.org/en/2", "http://a.com/fr/1?q=http://b.org/", "http://a.com/de/", "http://a.com/DE/", "http://a.com?x/de/", "//a.com/fr/", "http://a.net/de/5.html", "a://b://c.org/", "http://com/fr/\n", "http://ünï.org/ü", "http://a.com#/fr/"]


def test_listed_rules(spark):
    def plain(url):
        at = (url or "").find("://")
        rest = "" if at < 0 else url[at + 3 :]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *(max(fits)[1:] if fits else (None, None))

    pages = spark.createDataFrame([(k, u, "clash", "clash") for k, u in enumerate(URLS + URLS[-3:])], "page_id long, url string, host string, tokens string")
    got = {(r.page_id, r.host, r.path, r.rule): (r.verdict, r.mined) for r in urls.judged(pages).collect()}
    assert len(got) == len(URLS) + 3
    for k, u in enumerate(URLS):
        host, path, rule, verdict = plain(u)
        said, mined = got[k, host, path, rule]
        assert said in ("allow", "block") and (rule is None or (said == verdict and mined is None)), u
    assert urls.judged(pages.limit(0)).count() == 0
    # Nothing is listed: everything is allowed.
    assert {r.verdict for r in urls.judged(pages, rules=(("block", "nowhere.example", "/"),)).collect()} == {"allow"}


def test_mined_rules_stay_jvm_side_and_bounded(spark):
    rng = random.Random(2)
    rows = [(k, f"http://{rng.choice(['a', 'b', 'c'])}.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['fr', 'de', 'en'])}/{rng.randint(1, 99)}") for k in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    found = urls.judged(pages)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert {r.verdict for r in found.filter("host like '%.net' and path like '/fr/%'").collect()} == {"allow"}
    rows = pages.select("url", *(c.alias(n) for c, n in zip(urls.parts(F.col("url")), ("host", "path"), strict=True)))
    rule, said = urls.listed(F.col("host"), F.col("path"))
    mined = urls.mined(rows.select(urls.tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), said.alias("verdict")).filter("verdict is not null"))
    kept = [(frozenset(r.tokens), r.verdict, r.confidence) for r in mined.collect()]
    assert kept and all(c >= urls.CONFIDENCE for _, _, c in kept)
    assert not any(a < b and v == w and c >= d for a, v, c in kept for b, w, d in kept)


def plain_lyndon(w):
    return [next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w)) - i for i in range(len(w))]


def plain_runs(w, least=24, times=3):
    n, out = len(w), set()
    for p in range(1, n // times + 1):
        s = 0
        while s < n - p:
            e = s
            while e < n - p and w[e] == w[e + p]:
                e += 1
            length = e - s + p
            if e > s and length >= max(least, times * p) and not any(all(w[k] == w[k + q] for k in range(s, s + length - q)) for q in range(1, p)):
                out.add((s, length, p))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_lyndon_arrays_and_runs():
    rng = random.Random(1)
    for _ in range(3000):
        n, k = rng.randint(0, 50), rng.randint(1, 4)
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.4:
            p = rng.randint(1, max(1, n // 3))
            w = [w[i % p] for i in range(n)]
        ranks = {c: i for i, c in enumerate(sorted(set(w)))}
        assert lyndon.lyndon_array([ranks[c] for c in w]) == plain_lyndon(w)
        for least in (3, 24):
            assert lyndon.runs(np.array(w, np.int64), least, 3) == plain_runs(w, least)


def plain_collapse(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), n)


def test_periodic_runs(spark, sf, none):
    got = queries.op13_periodic_runs(spark, sf)
    short = [(i, t) for i, t in documents(spark, sf) if len((t or "").split()) < 1500]
    assert len(short) > 100
    want = Counter(plain_collapse(i, t) for i, t in short)
    ids = {i for i, _ in short}
    assert Counter(tuple(r) for r in got.collect() if r.doc_id in ids) == want
    assert any(r[1] for r in want) and got.count() == len(documents(spark, sf))
    assert periodic.digest(periodic.find_runs(none)).count() == 0


def test_runs_of_edge_rows(spark, edge, edge_rows):
    rng = random.Random(4)
    some = [" ".join(rng.choices("ab", k=200)), "x " * 23, "x " * 24, "x\x0b" * 24, "x\xa0" * 30, " ".join((["p", "q", "r"] * 8 + ["s"]) * 4), " ".join(f"w{k % 40}" for k in range(130)), "ä b c " * 30 + "d " * 100 + "ä b c " * 30]
    rows = [(i, t) for i, t in edge_rows if len(t or "") < 20_000] + [(i, t) for i in [None, -3, *range(100, 160)] for t in some]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, runs string, n_words string")
    got = periodic.digest(periodic.find_runs(docs))
    assert Counter(map(tuple, got.collect())) == Counter(plain_collapse(i, t) for i, t in rows)
    assert periodic.find_runs(edge).count() == len(edge_rows)


def test_stretches_lose_no_run():
    rng = random.Random(6)
    for _ in range(60):
        w = []
        while len(w) < 600:
            p = rng.randint(1, 60)
            piece = [rng.randrange(1000) for _ in range(p)]
            w += [rng.randrange(1000) for _ in range(rng.randint(0, 50))] + [piece[k % p] for k in range(rng.randint(1, 5 * p))]
        own = np.array(w)
        got = [(s + at, n, p) for s, e in periodic.stretches(own, np.array([0, len(w)]))[0] for at, n, p in lyndon.runs(own[s:e])]
        assert sorted(got, key=lambda r: (r[0], r[2])) == lyndon.runs(own)
