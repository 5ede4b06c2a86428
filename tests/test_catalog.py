"""Every query of the catalogue against its SQL, and the parts that SQL doesn't cover."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.functions import answers, filters, html, stem
from tidewell.functions import text as T
from tidewell.jobs import catalog, records  # noqa: F401
from tidewell.operators import crawl, requests, retrieval
from tidewell.functions import ids
from tidewell.operators import mapreduce, search
from tidewell.sources import lines, nested, remote, sharded, store, tsv
from tidewell.streaming import index, log
from tidewell.streaming.counts import tumbling

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, sf, oracle, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), oracle.sql(catalog.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert len(want)
    assert sorted(got.columns) == columns
    rows = lambda d: Counter(map(repr, d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got.astype({c: want[c].dtype for c in columns})) == rows(want)


def test_rate_limit_windows_open_with_the_first_event(spark):
    rows = [(1, k, f"2024-01-01 {h:02d}:00:00") for k, h in enumerate((5, 6, 7, 8))] + [(1, 9, "2024-01-02 05:00:00"), (1, 10, "2024-01-02 04:59:59"), (2, 11, "2024-01-01 00:00:00")]
    events = spark.createDataFrame(rows, "user_id long, event_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.event_id: r.allowed for r in requests.rate_limited(events, 3, 24).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 10: False, 9: True, 11: True}


def test_stream_counts_as_the_batch_does(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert Counter(spark.table("counts").collect()) == Counter(tumbling(events).collect())


def test_neighbours_of_all_queries_in_blocks(spark):
    vectors = [(k, [float(k % 7), float(k % 3 - 1)], k % 2) for k in range(90)] + [(90, None, 1), (None, [9.0, 9.0], 0)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(5)
    asked = [v for v in vectors if v[0] is not None and v[0] % 9 == 0 and v[1]]
    want = Counter()
    for i, q, _ in asked:
        scored = [(-sum(a * b for a, b in zip(v, q, strict=True)), n is not None, n or 0, n, label) for n, v, label in vectors if v and label == 0]
        want.update((i, n, label, -s) for s, _, _, n, label in sorted(scored, key=lambda x: x[:3])[:4])
    for block in (3, 5, 1024):
        got = retrieval.neighbours(rows, rows.filter("vec_id % 9 = 0"), 4, F.col("label") == 0, block)
        assert Counter(map(tuple, got.collect())) == want and len({i for i, *_ in want}) == len(asked) == 10
    assert retrieval.neighbours(rows, rows.limit(0), 4).count() == 0


def test_filters(spark):
    rows = spark.createDataFrame([(1, [(3.0, ["a", "b"]), (None, None)]), (2, [])], "id int, sections array<struct<x:double,tags:array<string>>>")
    kept = lambda *f: [(r.id, len(r.sections)) for r in retrieval.pruned(rows, list(f)).collect()]
    one = filters.Filter
    assert kept(one("x", "ne", 5.0)) == [(1, 1)] and kept(one("x", "gte", 3.0), one("tags", "includes_all", ["a", "b"])) == [(1, 1)]
    assert kept(one("tags", "includes_all", [])) == [(1, 1)] and kept(one("tags", "includes_any", [])) == [] and kept() == [(1, 2), (2, 0)]
    assert filters.valid([{"field": "x", "op": "eq", "value": None}, {"field": "y", "op": "eq", "value": 1}, {"field": "x", "op": "like", "value": 1}, {"field": "x", "op": "eq"}, 3], {"x"}) == [one("x", "eq", None)]
    assert filters.valid("x", {"x"}) == []


def test_text(spark):
    row = spark.range(1).select(T.week_days(F.lit("TBA")).alias("a"), T.week_days(F.lit("TuThF 9")).alias("b"), T.term_name(F.lit("202615")).alias("c"), T.ngrams(F.array(F.lit("x")), 2).alias("d"), T.normalised(F.lit(" A&B,  c ")).alias("e")).first()
    assert tuple(row) == ([], ["Tu", "Th", "F"], "Winter 2026", [], "a and b c")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20 and set(entry.oracle_sql()) <= set(entry.queries())


def test_stems():
    # Examples of the paper.
    pairs = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit radically radic vietnamization vietnam triplicate triplic hopefulness hope goodness good revival reviv adoption adopt effective effect probate probat rate rate cease ceas controll control roll roll is is generalizations gener oscillators oscil"
    words = pairs.split()
    assert [stem.stem(w) for w in words[::2]] == words[1::2]


def test_stemmed_terms_keep_all_words(spark, sf):
    rows = catalog.stemmed_terms(spark, sf).collect()
    words = [w for r in spark.read.parquet(f"{sf}/documents.parquet").select(T.without(T.tokens(F.coalesce("text", F.lit(""))), catalog.STOP).alias("w")).collect() for w in r.w]
    of = {w: stem.stem(w) for w in set(words)}
    terms, freq = Counter(of.values()), Counter(of[w] for w in words)
    assert {r.stem: (r.terms, r.freq) for r in rows} == {s: (terms[s], freq[s]) for s in terms}


def test_reach(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "b"), ("x", "y"), ("c", None), (None, "z")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",), (None,)], "node string")
    assert Counter(map(tuple, crawl.reached(edges, seeds).collect())) == Counter([("a", 0), ("b", 1), ("c", 2)])
    assert crawl.reached(edges, seeds.limit(0)).count() == 0


CODE = r"\*\*([A-Z]{2,5}\s+\d{4}[A-Z]?)[\s:]"


def test_filters_by_type(spark):
    """Every op on every type of field, with values of that type and of others."""
    kind = "id int, code string, sections array<struct<i:int,x:double,s:string,b:boolean,a:array<string>,n:array<int>,o:string>>"
    rows = spark.createDataFrame([(1, " MATH 10", [(1, 1.5, "m", True, ["p", "q"], [3], None)]), (2, "Econ 5", [(None, None, None, None, None, None, None)]), (3, None, [(2, 0.0, "", False, [], [], None)])], kind)
    one = filters.Filter

    def kept(*f):
        return [r.id for r in retrieval.pruned(rows, [one(*x) for x in f]).orderBy("id").collect()]

    cases = [
        (("i", "eq", 1), [1]), (("i", "eq", "1"), []), (("i", "eq", True), []), (("i", "ne", "1"), [1, 3]), (("i", "ne", 1), [3]), (("x", "eq", 1.5), [1]), (("s", "eq", "m"), [1]), (("s", "eq", ""), [3]), (("s", "eq", None), []), (("s", "ne", None), [1, 3]),
        (("b", "eq", True), [1]), (("b", "eq", 1), []), (("b", "ne", True), [3]), (("a", "eq", ["p", "q"]), []), (("a", "ne", ["p", "q"]), [1, 3]), (("o", "ne", "x"), []), (("gone", "ne", 1), []),
        (("i", "lt", 2), [1]), (("i", "lt", "2"), [1]), (("i", "lte", " 1.0 "), [1]), (("x", "gt", ""), [1]), (("x", "gte", None), [1, 3]), (("i", "gt", "abc"), []), (("i", "gt", "nan"), []), (("s", "lt", "z"), []), (("s", "gte", 0), []), (("b", "gte", 0), []), (("i", "gt", [0]), []), (("x", "gte", True), [1]),
        (("a", "includes_all", ["p"]), [1]), (("a", "includes_all", ["p", "z"]), []), (("a", "includes_all", []), [1, 3]), (("a", "includes_any", ["z", "q"]), [1]), (("a", "includes_any", []), []), (("a", "includes_any", "p"), []), (("i", "includes_any", [1]), []), (("s", "includes_all", []), []), (("n", "includes_any", [3]), [1]), (("n", "includes_any", ["3"]), []), (("n", "includes_all", [3, "3"]), []),
        (("code_prefix", "eq", "econ"), [2]), (("code_prefix", "ne", "ECON"), []), (("code_prefix", "includes_any", ["econ", "x"]), [2]), (("code_prefix", "includes_all", ["econ", "x"]), [2]), (("code_prefix", "includes_any", []), []), (("code_prefix", "includes_any", "ECON"), []), (("code_prefix", "lt", "Z"), []),
    ]
    got = [(f, kept(f)) for f, _ in cases]
    assert got == cases, [(g, w) for g, w in zip(got, cases, strict=True) if g != w]
    assert [len(x) for x in filters.stages([one("b", "eq", 1), one("code_prefix", "eq", "A"), one("a", "eq", 2)], ("code_prefix", "a", "b", "c"))] == [1, 2, 3]
    assert filters.stages([one("a", "eq", 2)], ("code_prefix", "a")) == [] and filters.stages([one("code_prefix", "eq", "A"), one("b", "eq", 1)], ("code_prefix", "a", "b")) == [[one("code_prefix", "eq", "A")]]


def test_rewritten_filters_run(spark):
    rows = spark.createDataFrame([(1, "MATH 1", [(1,)]), (2, "ECON 1", [(1,)])], "id int, code string, sections array<struct<x:int>>")
    own = filters.by_code([filters.Filter("programs", "eq", "math")], {"MATH"})
    assert [r.id for r in retrieval.pruned(rows, own).collect()] == [1]
    assert [r.id for r in retrieval.pruned(rows, filters.with_named([], ["econ"])).collect()] == [2]


def test_search_in_blocks(spark):
    kind = "code string, vector array<float>, sections array<struct<x:int>>"
    rows = [(f"{'AB'[k % 2]} {k}", [float(k % 5), float(k % 3)], [(k % 4,)] if k % 7 else []) for k in range(60)] + [("A none", None, [(1,)])]
    records = spark.createDataFrame(rows, kind).repartition(4)
    asked = [(q, [1.0, -float(q)], f) for q, f in enumerate(["[]", '[{"field": "x", "op": "eq", "value": 1}]', '[{"field": "code_prefix", "op": "eq", "value": "a"}, {"field": "x", "op": "eq", "value": 9}]', "no JSON", None])] + [(9, None, "[]")]
    queries = spark.createDataFrame(asked, "query_id long, vector array<float>, filters string")
    want = Counter()
    for q, v, f in asked[:5]:
        score = lambda r: round(sum(a * b for a, b in zip(r[1], v, strict=True)), 6)  # noqa: B023, E731
        order = sorted((r for r in rows if r[1]), key=lambda r: (-score(r), r[0]))
        want.update((q, "any", n, r[0], score(r), len(r[2])) for n, r in enumerate(order[:6], 1))
        if q == 1:
            best = [(r, 1) for r in order if (1,) in r[2]]
        elif q == 2:
            best = [(r, len(r[2])) for r in order if r[0][0] == "A" and r[2]]
        else:
            best = [(r, len(r[2])) for r in order]
        want.update((q, "partial" if q == 2 else "best", n, r[0], score(r), s) for n, (r, s) in enumerate(best[:6], 1))
    for block in (2, 100):
        found = search.search(records, queries, ("code_prefix", "x"), k=6, block=block)
        assert Counter((r.query_id, r.list, r.place, r.code, r.score, len(r.sections)) for r in found.collect()) == want
    notes = {r.query_id: r.unmatched for r in search.contexts(found, queries, F.struct("code"), ("code_prefix", "x")).collect()}
    assert notes == {0: "", 1: "", 2: "x eq 9", 3: "", 4: ""}
    assert search.search(records, queries.limit(0), ("code_prefix",)).count() == 0 and search.search(records.limit(0), queries, ("code_prefix",)).count() == 0


def test_stored_index(spark, sf, tmp_path):
    docs = spark.createDataFrame([(1, "Née caresses Straße"), (2, "caress the nee"), (3, None)], "doc_id long, text string")
    index_ = retrieval.postings(docs, ["the"], 2, stemmed=True)
    retrieval.stored(index_, str(tmp_path / "i"), 4)
    got = retrieval.looked_up(spark.read.parquet(str(tmp_path / "i")), ["caress", "nee caress", "nowhere"], 4)
    assert Counter(map(tuple, got.collect())) == Counter([("caress", 1, 1), ("caress", 2, 1), ("nee caress", 1, 1)])
    assert {r.term for r in index_.collect()} >= {"strass", "caress nee"}


def test_sharded_sink(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"v{k}") for k in range(20)] + [(None, "x")], "k long, v string")
    for _ in range(2):  # the second run replaces the first
        sharded.write(rows, "k", ids.modulo(ids.key_id(F.col("k")), 3), str(tmp_path / "s"))
    read = lambda name: spark.read.json(str(tmp_path / "s" / name)).collect()
    records, counts = read("records"), {r.owner: r["count"] for r in read("counts")}
    assert [r.k for r in read("keys")] == list(range(20)) and Counter(r.owner for r in records) == counts and sum(counts.values()) == 20


def test_log_is_appended_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, True, "a"), (2, False, ""), (3, None, None)], "t long, f boolean, e string")
    lines = rows.select(log.line(t=F.col("t"), f=F.col("f"), e=F.col("e")).alias("line"))
    assert [r.line for r in lines.collect()] == ['{"t":1,"f":true,"e":"a"}', '{"t":2}', '{"t":3}']
    for k in (1, 2):
        lines.coalesce(1).write.mode("append").text(str(tmp_path / "in"))
        stream = spark.readStream.schema("value string").text(str(tmp_path / "in")).withColumnRenamed("value", "line")
        log.append(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        assert spark.read.text(str(tmp_path / "out")).count() == 3 * k


def test_answers(spark):
    rows = [('x\nCITED: ["A 1", "B 2"]',), ("**ECON 1234: a** **ECON 1234 b** **MATH 0100A: c** CITED: [oops]",), ("none",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(answers.cited(F.col("t"), "CITED", CODE).alias("c"), answers.cleaned(F.col("t"), "CITED").alias("x"), answers.sanitised(F.concat(F.lit("q cited : [1] "), "t"), "CITED").alias("s")).collect()
    assert [r.c for r in got] == [["A 1", "B 2"], ["ECON 1234", "MATH 0100A"], [], None]
    assert [r.x for r in got][:3] == ["x", "**ECON 1234: a** **ECON 1234 b** **MATH 0100A: c**", "none"] and got[2].s == "q  none"


def test_html(spark):
    urls = [("http://h/a/b?x=1", "c"), ("http://h", "c"), ("http://h/a/", "/c"), ("http://h/a#u", "#v"), ("http://h/a", "https://o/p")]
    got = spark.createDataFrame(urls, "u string, h string").select(html.resolved(F.col("u"), F.col("h"))).collect()
    assert [r[0] for r in got] == ["http://h/a/c", "http://h/c", "http://h/c", "http://h/a#v", "https://o/p"]
    row = spark.range(1).select(html.shortened(F.lit("<p><a href=x>long text</a>"), 15).alias("a"), html.shortened(F.lit("<p>ab<a hr"), 8).alias("b"), html.shortened(F.lit("ab"), 2).alias("c"), html.without_links(F.lit("<a x>t</a><abbr>")).alias("d")).first()
    assert tuple(row) == ("<p><a href=x>lo</a>...", "<p>ab...", "ab", "t<abbr>")


def test_tsv(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\tb\u2028c"), (2, None), (3, 'say "x"')], "k int, v string")
    tsv.write(rows, ["v", "k"], str(tmp_path / "out"))
    back = spark.read.option("sep", "\t").option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert back.columns == ["v", "k"] and Counter(map(tuple, back.collect())) == Counter([("a\tbc", "1"), ("Unknown", "2"), ('say "x"', "3")])


def test_streamed_index(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        index.maintain(stream, catalog.STOP, str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination(120)
    assert Counter(index.current(spark, str(tmp_path / "index")).collect()) == Counter(retrieval.postings(docs, catalog.STOP).collect())


def test_filter_rules():
    one = filters.Filter
    own = [one("programs", "includes_any", ["math", "Nope", "MATH"]), one("days", "eq", "M")]
    assert filters.by_code(own, {"MATH"}) == [one("code_prefix", "includes_any", ["MATH"]), own[1]] and filters.by_code(own, {"X"}) == own
    assert filters.with_named(own, ["ECON"])[-1] == one("code_prefix", "includes_any", ["ECON"]) and filters.with_named(own, []) == own
    assert filters.described(own[0]) == "programs includes_any math, Nope, MATH" and filters.fetch_size(40, own) == 200 and filters.first(own, "x") is None
    assert filters.with_named([one("code_prefix", "eq", "A")], ["B"]) == [one("code_prefix", "eq", "A")]


def test_latency_with_odd_values(spark):
    inf = float("inf")
    values = [("a", 1.0), ("a", 1.0), ("a", 5.0), ("b", inf), ("b", -inf), ("b", 2.0), ("c", float("nan")), ("c", 0.0), (None, 3.0), ("d", None)]
    rows = spark.createDataFrame(values, "event_type string, value double")
    got = {r.event_type: (r.n, r.p50) for r in requests.latency(rows).collect()}
    assert got == {"a": (3, 1.0), "b": (3, 2.0), "c": (2, 0.0), None: (1, 3.0)}


def test_filters_on_persons_and_terms():
    own = [filters.Filter("instr", "includes_any", ["A", "B"]), filters.Filter("x", "eq", 1), filters.Filter("instr", "eq", None)]
    assert filters.without(own, "instr") == ([own[1]], ["A", "B"]) and filters.without([], "instr") == ([], [])
    assert filters.in_term([own[1]], "Fall", 2026) == [own[1], filters.Filter("season", "eq", "Fall"), filters.Filter("year", "eq", 2026)]


def test_nested_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"srcdb": "1",\n "results": [{"crn": "a", "srcdb": ""}, {"crn": "b", "srcdb": "9"}]},\n {"srcdb": "2"}, {"srcdb": "3", "results": []}]')
    rows = nested.scan(spark, str(tmp_path / "a.json"), "srcdb string, results array<struct<crn:string,srcdb:string>>")
    assert sorted(map(tuple, rows.select("crn", "srcdb").collect())) == [("a", "1"), ("b", "9")]


def test_fetch_tries_failures_again(spark, tmp_path):
    folder = str(tmp_path)

    def fetch(k):
        import pathlib

        mark = pathlib.Path(folder) / k
        if k == "bad" or not mark.exists():
            mark.touch()
            raise ValueError(f"no {k}")
        return k.upper()

    keys = spark.createDataFrame([("a",), ("bad",), (None,)], "k string")
    got = Counter(map(tuple, remote.fetched(keys, "k", fetch).collect()))
    assert got == Counter([("a", "A", None), ("bad", None, "no bad"), (None, None, "no key")])
    assert remote.fetched(keys.limit(0), "k", fetch).count() == 0


def test_mapper_and_fold(spark, monkeypatch):
    rows = spark.createDataFrame([(f"k{k % 7}", k) for k in range(500)] + [(None, 1), ("k", None)], "k string, v long").repartition(5)
    got = mapreduce.run(rows, "k", "v", lambda k, v: [(k, v), ("all", 1), (None, 2)], lambda a, b: a + b, "long")
    assert {r.key: r.value for r in got.collect()} == {f"k{j}": sum(range(j, 500, 7)) for j in range(7)} | {"all": 500}
    longest = mapreduce.run(rows, "k", "k", lambda k, v: [("x", v)], max, "string")
    assert [tuple(r) for r in longest.collect()] == [("x", "k6")] and mapreduce.run(rows.limit(0), "k", "v", lambda k, v: [(k, v)], max, "long").count() == 0


def test_line_files(spark, tmp_path):
    (tmp_path / "v.txt").write_text("a\n\n  \nb c\n")
    (tmp_path / "o.jsonl").write_text('{"k": "1:a", "v": [0.5]}\n\n{"k": "2:b"}\n')
    assert [r.value for r in lines.values(spark, str(tmp_path / "v.txt")).collect()] == ["a", "b c"]
    assert [tuple(r) for r in lines.objects(spark, str(tmp_path / "o.jsonl"), "k string, v array<double>").collect()] == [("1:a", [0.5]), ("2:b", None)]


def test_listings(spark):
    def fetch(term):
        if term == "bad":
            raise ValueError("no such term")
        return '{"results": [{"crn": "1", "code": "A 1"}, {"crn": "2", "code": null}]}' if term == "2026" else '{"results": []}'

    terms = spark.createDataFrame([("2026",), ("2025",), ("bad",)], "srcdb string")
    rows, failed = lines.listing(terms, "srcdb", fetch, "struct<crn:string,code:string>")
    assert Counter(map(tuple, rows.collect())) == Counter([("2026", "1", "A 1"), ("2026", "2", None)]) and [tuple(r) for r in failed.collect()] == [("bad", "no such term")]


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{k}", k) for k in range(30)] + [(None, 0), ("k1", 1)], "k string, v long")
    store.put(rows, "k", str(tmp_path / "s"), 4)
    assert [tuple(r) for r in store.get(spark, str(tmp_path / "s"), "k", "k7", 4).collect()] == [("k7", 7)]
    assert store.get(spark, str(tmp_path / "s"), "k", "absent", 4).count() == 0 and store.get(spark, str(tmp_path / "s"), "k").count() == 30
