"""All registered queries but those of the training-data subpackage, each with the SQL that checks it."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers, html, ids, stem
from ..functions import text as T
from ..functions.filters import Filter, in_term, without
from ..operators import crawl, index, mapreduce, ordered, requests, retrieval, search
from ..sources import listing, tsv
from ..sources.tables import catalogue, new_folder, table
from ..streaming import enrich, log
from ..streaming.counts import tumbling

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NODES = [hashlib.sha256(f'{{"ip":"10.0.0.{i}","port":{8000 + i}}}'.encode()).hexdigest() for i in range(1, 6)]
STOP = ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "as", "was", "by", "are", "this", "de", "la", "le", "der", "die", "und"]
ALIASES = [("CSCI", "computer science"), ("MATH", "mathematics"), ("ECON", "economics"), ("THE", "the"), ("DER", "der"), ("QUE", "que")]
RAW = "round(list_sum(list_transform(range(1, 65), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE))), 12)"
CODE = "o_orderpriority || ' ' || CAST(o_orderkey AS VARCHAR)"
PLAIN = "replace(replace(replace(strip_accents(lower(coalesce(text, ''))), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')"
TOKENS = f"list_filter(regexp_split_to_array({PLAIN}, '[^a-z]+'), lambda t: t <> '')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _top_sql(k: int, where: str = "true") -> str:
    rows = f"SELECT e.vec_id, e.label, {RAW} AS raw FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {where}"
    return f"SELECT vec_id, label, round(raw, 6) AS score FROM ({rows}) ORDER BY raw DESC, vec_id LIMIT {k}"


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


@query(_top_sql(20))
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact inner-product top 20 for the vector of record 0."""
    return retrieval.top_k(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 20)


@query(_top_sql(40, "e.label IN (1, 3, 5)"))
def vector_top_k_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, F2, K6: filtered before scoring."""
    return retrieval.top_k(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 40, F.col("label").isin(1, 3, 5))


def _neighbours_sql(k: int, where: str = "true") -> str:
    ranked = f"SELECT q.vec_id AS query_id, e.vec_id, e.label, {RAW} AS raw, row_number() OVER (PARTITION BY q.vec_id ORDER BY raw DESC, e.vec_id) AS r FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND {where}"
    return f"SELECT query_id, vec_id, label, round(raw, 6) AS score FROM ({ranked}) WHERE r <= {k}"


@query(_neighbours_sql(20))
def vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, J8, H10, K8 for every record whose id is divisible by 20, not for record 0 alone as `flagship`."""
    rows = table(spark, sf_dir, "embeddings")
    return retrieval.neighbours(rows, rows.filter("vec_id % 20 = 0"), 20)


@query(_neighbours_sql(40, "e.label IN (1, 3, 5)"))
def vector_neighbours_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, F2, K6 for every record whose id is divisible by 20, not for record 0 alone as `vector_top_k_filtered`."""
    rows = table(spark, sf_dir, "embeddings")
    return retrieval.neighbours(rows, rows.filter("vec_id % 20 = 0"), 40, F.col("label").isin(1, 3, 5))


@query("WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM embeddings) SELECT vec_id, round(norm, 6) AS norm, round(embedding[1] / nullif(norm, 0), 6) AS first, round(embedding[64] / nullif(norm, 0), 6) AS last FROM n")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths, and vectors of length one (null for one of length 0)."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.transform("embedding", lambda x: x.cast("double") / F.nullif(F.col("n"), F.lit(0.0)))
    return table(spark, sf_dir, "embeddings").withColumn("n", norm).select("vec_id", F.round("n", 6).alias("norm"), F.round(unit[0], 6).alias("first"), F.round(unit[63], 6).alias("last"))


@query(f"SELECT o_orderkey, {CODE} AS code, count(l_orderkey) AS n_sections, round(coalesce(sum(l_extendedprice), 0), 2) AS price, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '') AS flags FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def collapsed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order and its lines as one nested record."""
    price = F.aggregate("sections", F.lit(0.0), lambda s, x: s + x["l_extendedprice"])
    flags = F.array_join(F.array_sort(F.array_distinct(F.transform("sections", lambda s: s["l_returnflag"]))), ",")
    return catalogue(spark, sf_dir).select("o_orderkey", "code", F.size("sections").cast("long").alias("n_sections"), F.round(price, 2).alias("price"), flags.alias("flags"))


@query(f"SELECT o_orderkey, {CODE} AS code, count(*) AS kept, max(l_quantity) AS most FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 30 AND l_discount < 0.04 AND l_returnflag <> 'N' GROUP BY ALL")
def nested_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All filters hold for one section; other sections are pruned."""
    filters = [Filter("l_quantity", "gt", 30.0), Filter("l_discount", "lt", 0.04), Filter("l_returnflag", "ne", "N")]
    rows = retrieval.pruned(catalogue(spark, sf_dir), filters)
    return rows.select("o_orderkey", "code", F.size("sections").cast("long").alias("kept"), F.array_max(F.transform("sections", lambda s: s["l_quantity"])).alias("most"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 200000 THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS stage, o_totalprice FROM orders WHERE upper(split_part({CODE}, ' ', 1)) IN ('1-URGENT', '2-HIGH') ORDER BY stage, o_totalprice DESC, o_orderkey LIMIT 40")
def staged_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority stages after a prefix filter."""
    code = F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string"))
    rows = table(spark, sf_dir, "orders").filter(T.code_prefix(code).isin("1-URGENT", "2-HIGH"))
    status = F.col("o_orderstatus") == "O"
    return retrieval.staged(rows, [status & (F.col("o_totalprice") > 200000), status, F.lit(True)], [F.desc("o_totalprice")], "o_orderkey", 40).select("o_orderkey", "stage", "o_totalprice")


@query("SELECT c_custkey, arg_max(nullif(o_orderstatus, 'P'), (o_orderdate, o_orderkey)) FILTER (o_orderstatus <> 'P') AS o_orderstatus, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice, coalesce(max(strftime(o_orderdate, '%Y%m')), '999999') AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def latest_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per field the latest value that is neither null nor empty, and the latest term, or 999999 without one."""
    status = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
    orders = table(spark, sf_dir, "orders").withColumns({"o_orderstatus": status, "latest": F.date_format("o_orderdate", "yyyyMM")})
    found = retrieval.latest(orders, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_totalprice", "latest"])
    joined = table(spark, sf_dir, "customer").join(found, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "o_orderstatus", "o_totalprice", F.coalesce("latest", F.lit("999999")).alias("latest"))


_STOPPED = f"list_filter({TOKENS}, lambda t: t NOT IN ({', '.join(repr(s) for s in STOP)}))"
_GRAMS = f"""w AS (SELECT doc_id, {_STOPPED} AS w FROM documents),
g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda p: w[p] || ' ' || w[p + 1]), list_transform(range(1, greatest(len(w) - 1, 1)), lambda p: w[p] || ' ' || w[p + 1] || ' ' || w[p + 2]))) AS term FROM w),
i AS (SELECT term, doc_id, count(*) AS freq FROM g GROUP BY ALL)"""


@query(f"WITH {_GRAMS} SELECT term, CAST(floor(doc_id / 1000) AS BIGINT) AS block, count(*) AS df, CAST(sum(freq) AS BIGINT) AS freq, string_agg(doc_id || ':' || freq, ' ' ORDER BY i.freq DESC, doc_id) AS postings FROM i GROUP BY term, floor(doc_id / 1000)")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All n-gram postings of all texts, a row for each term and thousand ids."""
    return retrieval.merged(retrieval.postings(table(spark, sf_dir, "documents"), STOP, block=1000))


def _index(spark: SparkSession, sf_dir: str, stemmed: bool = False) -> str:
    """Where the index of all documents lies; made by the first lookup of an application."""
    return index.stored(spark, table(spark, sf_dir, "documents"), STOP, new_folder, stemmed)


@query(f"WITH {_GRAMS} SELECT term, doc_id, freq FROM i WHERE contains(' ' || term || ' ', ' loser ') OR contains(' ' || term || ' ', ' license ')")
def phrase_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """postings of n-grams that hold a phrase at word boundaries, from the stored index."""
    path = _index(spark, sf_dir)
    found = [index.containing(spark, path, index.asked(spark, phrase, STOP)) for phrase in ("a Loser", "LICENSE")]
    return found[0].unionByName(found[1]).distinct()  # a term may hold both


@query(f"WITH {_GRAMS} SELECT term, doc_id, freq FROM i WHERE contains(term, 'oser') OR contains(term, 'ing th')")
def phrase_lookup_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """postings of n-grams that hold a text anywhere, from the stored index by three-letter pieces of its words."""
    path = _index(spark, sf_dir)
    return index.literal(spark, path, "oser").unionByName(index.literal(spark, path, "ing th")).distinct()


@query()
def stemmed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As phrase_lookup, in an index of stems: the phrase is stemmed as the texts are."""
    path = _index(spark, sf_dir, stemmed=True)
    return index.containing(spark, path, index.asked(spark, "the licensing", STOP, stemmed=True))


@query(f"WITH w AS (SELECT doc_id, {_STOPPED} AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS term FROM w), i AS (SELECT term, doc_id, count(*) AS freq FROM u GROUP BY ALL), r AS (SELECT *, (row_number() OVER (PARTITION BY term ORDER BY freq DESC, doc_id) - 1) // 1000 AS block FROM i) SELECT term, CAST(block AS BIGINT) AS block, count(*) AS df, CAST(sum(freq) AS BIGINT) AS freq, string_agg(doc_id || ':' || freq, ' ' ORDER BY r.freq DESC, doc_id) AS postings FROM r GROUP BY term, block")
def ranked_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word's postings in order of frequency as a whole, in rows of a thousand."""
    return index.ranked(retrieval.postings(table(spark, sf_dir, "documents"), STOP, 1, block=1000))


@query("SELECT page_id, url, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS n_links, coalesce(list_extract(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1), '') AS first_link, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and text of pages."""
    found = T.links(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.size(found).cast("long").alias("n_links"), F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("")).alias("first_link"), T.plain(F.col("html")).alias("body"))


_KID = "sha256('\"' || CAST(o_orderkey AS VARCHAR) || '\"')"
_MOD = "list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(range(0, 8), lambda i: CAST(CAST('0x' || substr(kid, CAST(i * 8 + 1 AS BIGINT), 8) AS UBIGINT) AS HUGEINT))), lambda a, x: (a * 4294967296 + x) % 5)"
_LIST = "[" + ", ".join(f"'{n}'" for n in sorted(NODES)) + "]"


@query(f"WITH k AS (SELECT o_orderkey, {_KID} AS kid FROM orders) SELECT o_orderkey, substr(kid, 1, 5) AS sid, CAST({_MOD} AS BIGINT) AS by_modulo, coalesce(list_min(list_filter({_LIST}, lambda n: n > kid)), list_min({_LIST})) AS by_ring, list_extract(list_sort(list_transform({_LIST}, lambda n: sha256('\"' || kid || n || '\"') || n), 'DESC'), 1)[65:] AS by_rendezvous FROM k")
def key_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of keys among five nodes."""
    kid = F.col("kid")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", ids.key_id(F.col("o_orderkey")).alias("kid"))
    return rows.select("o_orderkey", F.substring(kid, 1, 5).alias("sid"), ids.modulo(kid, 5).alias("by_modulo"), ids.ring(kid, NODES).alias("by_ring"), ids.rendezvous(kid, NODES).alias("by_rendezvous"))


@query("SELECT c_custkey, c_name, coalesce(max(o_orderstatus), '') AS status, count(o_orderkey) AS matched FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'P' GROUP BY ALL")
def enriched_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join to a side aggregated first."""
    side = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.max("o_orderstatus").alias("status"), F.count("*").alias("matched"))
    return table(spark, sf_dir, "customer").join(side, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("status", F.lit("")).alias("status"), F.coalesce("matched", F.lit(0)).alias("matched"))


@query("SELECT conv_id, turn, role FROM conversations ANTI JOIN labels ON doc_id = conv_id")
def still_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose id isn't among the labelled documents."""
    return table(spark, sf_dir, "conversations").join(table(spark, sf_dir, "labels"), F.col("conv_id") == F.col("doc_id"), "left_anti").select("conv_id", "turn", "role")


@query("WITH n AS (SELECT s_suppkey AS key, s_name AS name, s_acctbal AS value FROM supplier) SELECT c_custkey AS key, c_name AS name, c_acctbal AS value FROM customer ANTI JOIN n ON key = c_custkey UNION ALL SELECT * FROM n")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replace rows of equal key, append the others."""
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("value"))
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("value"))
    return old.join(new, "key", "left_anti").unionByName(new)


@query("SELECT p_brand, p_type, count(*) AS n, round(avg(p_retailprice), 2) AS price, CAST(min(p_size) AS INTEGER) AS least FROM part GROUP BY ALL")
def map_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: values by key, combined before the shuffle."""
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 2).alias("price"), F.min("p_size").alias("least"))


@query("SELECT DISTINCT n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def distinct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct codes, hydrated."""
    keys = table(spark, sf_dir, "customer").select("c_nationkey").distinct()
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return keys.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


_ALIASES = "(VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in ALIASES) + ") a(code, alias)"


@query(f"SELECT conv_id, turn, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM conversations, {_ALIASES} WHERE contains(' ' || trim(regexp_replace(replace(lower(text), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || alias || ' ') GROUP BY conv_id, turn")
def alias_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short list of aliases found as whole words; `phrase_codes` takes them from a table."""
    padded = F.concat(F.lit(" "), T.normalised(F.col("text")), F.lit(" "))
    found = F.array_compact(F.array(*(F.when(padded.contains(f" {a} "), F.lit(c)) for c, a in ALIASES)))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(found).alias("code")).groupBy("conv_id", "turn")
    return rows.agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


@query("SELECT o_orderkey, CASE month(o_orderdate) // 4 WHEN 0 THEN 'Spring' WHEN 1 THEN 'Summer' WHEN 2 THEN 'Fall' ELSE 'Winter' END || ' ' || year(o_orderdate) AS term, CASE o_orderkey % 4 WHEN 0 THEN 'M,W,F' WHEN 1 THEN 'Tu,Th' WHEN 2 THEN '' ELSE 'Th,T' END AS days FROM orders")
def term_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1, H2, H3: names of terms and days of meeting patterns."""
    part = F.floor(F.month("o_orderdate") / 4)
    code = F.concat(F.year("o_orderdate").cast("string"), F.when(part == 0, "20").when(part == 1, "00").when(part == 2, "10").otherwise("15"))
    meets = F.element_at(F.array(*map(F.lit, ("MWF 9", "TuTh 1:00", "TBA", "TTh 2"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.term_name(code).alias("term"), F.array_join(T.week_days(meets), ",").alias("days"))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS greatest, max(value) FILTER (r = floor((n - 1) * 0.5) + 1) AS p50, max(value) FILTER (r = floor((n - 1) * 0.95) + 1) AS p95, max(value) FILTER (r = floor((n - 1) * 0.99) + 1) AS p99 FROM r GROUP BY event_type")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12, A13, A14."""
    return requests.latency(table(spark, sf_dir, "events"))


_OPENS = "e.ts >= r.start + INTERVAL 24 HOUR"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, ts AS start, 1 AS used, true AS allowed FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN {_OPENS} THEN e.ts ELSE r.start END, CASE WHEN {_OPENS} THEN 1 WHEN r.used < 3 THEN r.used + 1 ELSE r.used END, {_OPENS} OR r.used < 3 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, start AS window_start, allowed FROM r""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows from each user's first event; streaming/limits.py keeps the same on a stream."""
    return requests.rate_limited(table(spark, sf_dir, "events"), 3, 24)


@query("WITH g AS (SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) AS gap_us FROM events) SELECT event_id, gap_us, coalesce(gap_us <= 1800000000, false) AS hit FROM g")
def cache_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6."""
    return requests.recency(table(spark, sf_dir, "events"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
p AS (SELECT *, lag(i) OVER (PARTITION BY user_id ORDER BY i) AS p, row_number() OVER (PARTITION BY user_id ORDER BY i) AS n FROM e),
d AS (SELECT p.event_id, p.user_id, p.ts, p.n, count(DISTINCT x.user_id) AS distance FROM p LEFT JOIN e x ON x.i > p.p AND x.i < p.i GROUP BY ALL),
r AS (SELECT event_id, user_id, n, CAST(NULL AS BIGINT) AS distance, ts AS put, 'new' AS outcome FROM d WHERE n = 1 UNION ALL
SELECT d.event_id, d.user_id, d.n, d.distance, CASE WHEN d.distance >= 100 OR d.ts > r.put + INTERVAL 30 MINUTE THEN d.ts ELSE r.put END, CASE WHEN d.distance >= 100 THEN 'evicted' WHEN d.ts > r.put + INTERVAL 30 MINUTE THEN 'expired' ELSE 'hit' END FROM r JOIN d ON d.user_id = r.user_id AND d.n = r.n + 1)
SELECT event_id, user_id, distance, outcome FROM r""")
def cache_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache of 100 users' results, each for 30 minutes from its put, says to every event."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))
    return requests.cached(events).select(F.col("id").alias("event_id"), F.col("key").alias("user_id"), "distance", "outcome")


def _measured(keys: list[str]) -> list[str]:
    """Stands for a service: a text's length; it has no answer to texts of one letter pair."""
    if any("qu" in k for k in keys):
        raise ValueError("no answer")
    return [str(len(k)) for k in keys]


@query("SELECT s_name AS key, CASE WHEN contains(s_name, 'qu') THEN NULL ELSE CAST(length(s_name) AS VARCHAR) END AS value, CASE WHEN contains(s_name, 'qu') THEN 'no answer' END AS error FROM (SELECT DISTINCT s_name FROM supplier UNION SELECT DISTINCT o_orderpriority || ' qu' FROM orders)")
def enriched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values fetched for distinct keys in resumable steps, with the keys that have none."""
    keys = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("key")).unionByName(table(spark, sf_dir, "orders").select(F.concat("o_orderpriority", F.lit(" qu")).alias("key")))
    path = new_folder(spark)
    enrich.step(keys, _measured, path, size=1, concurrency=8)
    done, dead, _ = enrich.state(spark, path)
    return done.select("key", "value", F.lit(None).cast("string").alias("error")).unionByName(dead.select("key", F.lit(None).cast("string").alias("value"), "error"))


@query(f"SELECT CAST(year(o_orderdate) AS VARCHAR) AS term, {CODE} AS code, o_totalprice AS price FROM orders WHERE year(o_orderdate) IN (1995, 1996)")
def listed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings by term, read through a data source of which only the terms asked for are read."""
    path, code = new_folder(spark), F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("term"), code.alias("code"), F.col("o_totalprice").alias("price"))
    rows.write.partitionBy("term").json(path)
    listing.register(spark)
    return spark.read.format("term_listing").schema("term string, code string, price double").option("path", path).load().filter(F.col("term").isin("1995", "1996"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY code) - 1 AS BIGINT) AS position, code, n_sections FROM (SELECT {CODE} AS code, count(l_orderkey) AS n_sections FROM orders JOIN embeddings ON vec_id = o_orderkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY code)")
def id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of each record of the index in the order of codes, without gaps."""
    return ordered.numbered(_records(spark, sf_dir), "code", name="position").select("position", "code", F.size("sections").cast("long").alias("n_sections"))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows; the same plan runs on a stream."""
    return tumbling(table(spark, sf_dir, "events"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS said FROM events WHERE length(event_type) BETWEEN 1 AND 500")
def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON fields and ISO times of log records."""
    return table(spark, sf_dir, "events").filter(F.length("event_type").between(1, 500)).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("said"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn, role) AS roles, max(length(text)) AS longest FROM conversations GROUP BY conv_id")
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered roles of each conversation."""
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), roles.alias("roles"), F.max(F.length("text")).cast("long").alias("longest"))


@query("SELECT c_custkey, c_mktsegment, c_acctbal, r FROM (SELECT c_custkey, c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 10")
def best_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best ten of each group; Spark keeps ten a partition before the shuffle."""
    r = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", r.cast("long").alias("r")).filter("r <= 10")


@query()
def stemmed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts by stem; words are counted first, so each distinct word is stemmed once."""
    words = T.without(T.tokens(F.coalesce("text", F.lit(""))), STOP)
    terms = table(spark, sf_dir, "documents").select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("freq"))
    return stem.stemmed(terms).groupBy("stem").agg(F.count("*").alias("terms"), F.sum("freq").alias("freq"), F.min("term").alias("first_term"))


_PARTS = "SELECT regexp_extract(url, '^https?://[^/]+(/[^/?#]+)', 1) AS part, url, html FROM pages"


@query(f"WITH RECURSIVE p AS ({_PARTS}), e AS (SELECT url AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS dst FROM p UNION SELECT part, url FROM p WHERE part <> ''), r(node) AS (SELECT url FROM pages WHERE page_id = 0 UNION SELECT dst FROM r JOIN e ON src = node) SELECT node FROM r")
def crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What links lead to from page 0: a page leads to its links, a link to the pages below its path."""
    pages = table(spark, sf_dir, "pages")
    part = F.regexp_extract("url", "^https?://[^/]+(/[^/?#]+)", 1)
    links = pages.select(F.col("url").alias("src"), F.explode(T.links(F.col("html"))).alias("dst"))
    below = pages.select(part.alias("src"), F.col("url").alias("dst")).filter("src <> ''")
    return crawl.reached(links.unionByName(below), pages.filter("page_id = 0").select(F.col("url").alias("node"))).select("node")


_PLAIN = lambda x: f"trim(regexp_replace(regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
_CUT = "regexp_replace(substr(html, 1, 400), '</?\\w[^>]*\\z', '')"


@query(f"""WITH f AS (SELECT *, {_PLAIN("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} AS title, {_CUT} AS cut, list_extract(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS link FROM pages)
SELECT page_id, replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS title, {_PLAIN("regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)")} AS heading,
array_to_string(string_split({_PLAIN("regexp_extract(html, '(?is)<div class=.ad.>(.*?)</div>', 1)")}, ' ')[1:2], ' ') AS ad,
CASE WHEN length(html) <= 400 THEN html ELSE cut || CASE WHEN len(regexp_extract_all(cut, '(?i)<a[\\s>]')) > len(regexp_extract_all(cut, '(?i)</a>')) THEN '</a>' ELSE '' END || '...' END AS teaser,
CASE WHEN link LIKE '/%' THEN regexp_extract(url, '^https?://[^/]+') || link ELSE link END AS first_link, length(regexp_replace(html, '(?i)</?a(\\s[^>]*)?>', '', 'g')) AS n_unlinked FROM f""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields, a teaser and a resolved link of each page."""
    h, link = F.col("html"), F.try_element_at(T.links(F.col("html")), F.lit(1))
    ad = html.first_words(html.element(h, "div", "ad"), 2)
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", html.escaped(html.element(h, "title")).alias("title"), html.element(h, "h1").alias("heading"), ad.alias("ad"), html.shortened(h, 400).alias("teaser"), html.resolved(F.col("url"), link).alias("first_link"), F.length(html.without_links(h)).cast("long").alias("n_unlinked"))


_ROLE = "upper(substr(role, 1, 4)) || ' ' || lpad(CAST(conv_id % 10000 AS VARCHAR), 4, '0')"


@query(f"SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND turn % 3 <> 0 THEN {_ROLE} || ',X 1' ELSE {_ROLE} END AS codes, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY ALL")
def cited_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of answers made of the turns: a list behind the marker, a broken list every third turn, else bold codes."""
    code = F.concat_ws(" ", F.upper(F.substring("role", 1, 4)), F.lpad((F.col("conv_id") % 10000).cast("string"), 4, "0"))
    listed = F.concat(F.lit('\nCITED: ["'), code, F.when(F.col("turn") % 3 != 0, F.lit('", "X 1"]')).otherwise(F.lit('", ]')))
    answer = F.concat("text", F.lit(" **"), code, F.lit(": title**"), F.when(F.col("role") == "assistant", listed).otherwise(F.lit("")))
    rows = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", "role", F.array_join(answers.cited(answer, "CITED", r"\*\*([A-Z]{2,5}\s+\d{4}[A-Z]?)[\s:]"), ",").alias("codes"))
    return rows.groupBy("conv_id", "turn", "role", "codes").agg(F.count("*").alias("n"))


@query("SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, coalesce(lang, 'Unknown') AS lang, coalesce(CAST(quality AS VARCHAR), 'Unknown') AS quality, coalesce(replace(replace(text, chr(8232), ''), chr(8233), ''), 'Unknown') AS text FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def tsv_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as the tab-separated sink writes them."""
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return tsv.fields(joined, ["doc_id", "lang", "quality", "text"])


_UNIGRAMS = f"u AS (SELECT doc_id, unnest({_STOPPED}) AS term FROM documents), i AS (SELECT term, doc_id, count(*) AS freq FROM u GROUP BY ALL)"


@query(f"WITH {_UNIGRAMS} SELECT term, CAST(floor(doc_id / 1000) AS BIGINT) AS block, term || ' | ' || string_agg(doc_id || ' ' || freq, ' ' ORDER BY freq DESC, doc_id) AS line FROM i GROUP BY term, floor(doc_id / 1000)")
def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14 (writing), A7: postings as lines of text, a line for each thousand ids."""
    return retrieval.printed(retrieval.postings(table(spark, sf_dir, "documents"), STOP, 1, block=1000))


@query(f"WITH {_UNIGRAMS} SELECT term, doc_id, freq FROM i")
def index_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13, S14 (reading): postings read back from their lines."""
    return retrieval.parsed(index_lines(spark, sf_dir))


@query(f"WITH a AS (SELECT doc_id, text FROM documents UNION ALL SELECT conv_id, text FROM conversations), u AS (SELECT doc_id, unnest({_STOPPED}) AS term FROM a) SELECT term, doc_id, count(*) AS freq FROM u GROUP BY ALL")
def merged_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two indexes as one; frequencies of equal (term, id) add up."""
    talks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "text")
    return retrieval.folded(*(retrieval.postings(d, STOP, 1) for d in (table(spark, sf_dir, "documents"), talks)))


@query("SELECT year(o_orderdate) AS y, seasons.s AS season, count(*) FILTER (CASE month(o_orderdate) // 4 WHEN 0 THEN '20' WHEN 1 THEN '00' WHEN 2 THEN '10' ELSE '15' END = seasons.s) AS n FROM orders, (VALUES ('00'), ('10'), ('15'), ('20')) seasons(s) GROUP BY ALL")
def term_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every year with every term code (two short lists), and how many orders each has."""
    part = F.floor(F.month("o_orderdate") / 4)
    counts = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y"), F.when(part == 0, "20").when(part == 1, "00").when(part == 2, "10").otherwise("15").alias("season")).agg(F.count("*").alias("n"))
    grid = counts.select("y").distinct().select("y", F.explode(F.array(*map(F.lit, ("00", "10", "15", "20")))).alias("season"))
    return grid.join(counts, ["y", "season"], "left").select("y", "season", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT event_id, key, CAST(json_extract(props, '$.' || key) AS BIGINT) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def unpivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object's fields as rows of key and value."""
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")))


_SPACED = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query(f"""WITH r AS (SELECT *, {_SPACED("coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '')")} AS reworded, [role, 'the'] AS tokens FROM conversations WHERE text IS NOT NULL),
s AS (SELECT *, {_SPACED("array_to_string(list_filter(tokens, lambda t: NOT contains(' ' || lower(reworded) || ' ', ' ' || t || ' ')), ' ') || ' ' || reworded")} AS said FROM r)
SELECT conv_id, turn, role, CASE WHEN said = '' THEN {_SPACED("text")} ELSE said END AS said, lower({_SPACED("text")}) AS cache_key FROM s""")
def covered_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7, H8: each turn reworded as the turn before (the first as nothing), with words that must not get lost."""
    rows = table(spark, sf_dir, "conversations").filter("text is not null")
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")), F.lit(""))
    return rows.withColumn("reworded", before).select("conv_id", "turn", "role", T.covered(F.col("text"), F.col("reworded"), F.array(F.col("role"), F.lit("the"))).alias("said"), T.cache_key(F.col("text")).alias("cache_key"))


@query("SELECT o_orderkey, count(*) AS kept FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 20 AND month(l_shipdate) // 4 = 2 AND year(l_shipdate) = 1996 GROUP BY o_orderkey")
def sections_of_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a parser asks for, without its filter on a person, and with a user's term."""
    asked, _ = without([Filter("l_quantity", "gt", 20.0), Filter("instr", "eq", "Smith")], "instr")
    part = lambda s: F.floor(F.month(s["l_shipdate"]) / 4)
    season = lambda s: F.when(part(s) == 0, "Spring").when(part(s) == 1, "Summer").when(part(s) == 2, "Fall").otherwise("Winter")
    terms = F.transform("sections", lambda s: s.withField("season", season(s)).withField("year", F.year(s["l_shipdate"])))
    rows = retrieval.pruned(catalogue(spark, sf_dir).withColumn("sections", terms), in_term(asked, "Fall", 1996))
    return rows.select("o_orderkey", F.size("sections").cast("long").alias("kept"))


@query("SELECT o_orderkey || ':' || o_custkey AS key, trim(coalesce(o_orderstatus, '') || '. ' || coalesce(o_orderpriority, '')) AS text, coalesce(nullif(replace(o_orderstatus, 'F', ''), ''), nullif(o_orderpriority, ''), '') AS instr FROM orders WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL")
def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite key, the text and a field with a fallback of each record that has both parts of its key."""
    text = F.concat(F.coalesce("o_orderstatus", F.lit("")), F.lit(". "), F.coalesce("o_orderpriority", F.lit("")))
    instr = T.first_filled(F.replace("o_orderstatus", F.lit("F"), F.lit("")), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").dropna(subset=["o_orderkey", "o_custkey"]).select(F.concat_ws(":", "o_orderkey", "o_custkey").alias("key"), F.trim(text).alias("text"), instr.alias("instr"))


@query(f"WITH w AS (SELECT role, unnest({TOKENS}) AS t FROM conversations WHERE text IS NOT NULL) SELECT t AS key, count(*) AS value FROM w WHERE len(t) > 2 GROUP BY t")
def mapped_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words counted by a mapper and a fold in Python."""
    texts = table(spark, sf_dir, "conversations").select("role", T.tokens(F.col("text")).alias("words"))
    return mapreduce.run(texts, "role", "words", lambda role, words: ((w, 1) for w in words if len(w) > 2), lambda a, b: a + b, "long")


#: Filters of the queries, by the number of a query: none; on sections; on the code alone; on both; on both, of which one can't be met; on all of a list; on any of one.
ASKED = ("[]", '[{"field": "l_quantity", "op": "gt", "value": "30"}, {"field": "l_discount", "op": "lt", "value": 0.02}]', '[{"field": "code_prefix", "op": "includes_any", "value": ["1-urgent", "2-HIGH", "X"]}]', '[{"field": "l_quantity", "op": "gte", "value": 45}, {"field": "code_prefix", "op": "eq", "value": "3-medium"}, {"field": "l_returnflag", "op": "eq", "value": "R"}]', '[{"field": "code_prefix", "op": "eq", "value": "5-LOW"}, {"field": "l_returnflag", "op": "eq", "value": 7}]', '[{"field": "flags", "op": "includes_all", "value": ["R", "F"]}, {"field": "nowhere", "op": "eq", "value": 1}]', '[{"field": "code_prefix", "op": "eq", "value": "2-high"}, {"field": "flags", "op": "includes_any", "value": ["A", "X"]}]')
PRIORITY = ("code_prefix", "l_returnflag", "l_quantity")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for every vector whose id is divisible by 20, with filters by turns."""
    which = (F.col("vec_id") / 20).cast("long") % len(ASKED)
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.element_at(F.array(*map(F.lit, ASKED)), (which + 1).cast("int")).alias("filters"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("o_orderkey"), F.col("embedding").alias("vector"))
    flags = F.transform("sections", lambda s: s.withField("flags", F.array(s["l_returnflag"], s["l_linestatus"])))
    return catalogue(spark, sf_dir).join(vectors, "o_orderkey").select("o_orderkey", "code", "vector", flags.alias("sections"))


_SEARCH = f"""rec AS (SELECT o_orderkey, {CODE} AS code, upper(split_part({CODE}, ' ', 1)) AS pre, embedding FROM orders JOIN embeddings ON vec_id = o_orderkey),
c AS (SELECT o_orderkey, count(l_orderkey) AS n, count(*) FILTER (l_quantity > 30 AND l_discount < 0.02) AS n1, count(*) FILTER (l_quantity >= 45 AND l_returnflag = 'R') AS n3, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS n5, count(*) FILTER (l_returnflag = 'A') AS n6 FROM rec LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey),
p AS (SELECT q.vec_id AS query_id, (q.vec_id // 20) % 7 AS t, e.o_orderkey, e.code, e.pre, {RAW} AS raw, n, n1, n3, n5, n6 FROM embeddings q, rec e JOIN c ON c.o_orderkey = e.o_orderkey WHERE q.vec_id % 20 = 0),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, o_orderkey) AS r FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, o_orderkey) AS r FROM p WHERE (t = 1 AND n1 > 0) OR (t = 2 AND n > 0 AND pre IN ('1-URGENT', '2-HIGH')) OR (t = 3 AND n > 0 AND pre = '3-MEDIUM') OR (t = 4 AND n > 0 AND pre = '5-LOW') OR (t = 5 AND n5 > 0) OR (t = 6 AND n > 0 AND pre = '2-HIGH')),
l AS (SELECT query_id, 'any' AS list, r, o_orderkey, code, raw, n AS n_sections FROM a WHERE r <= 40 UNION ALL SELECT query_id, 'best', r, o_orderkey, code, raw, n FROM a WHERE r <= 40 AND t = 0
UNION ALL SELECT query_id, 'best', r, o_orderkey, code, raw, CASE t WHEN 1 THEN n1 WHEN 2 THEN n WHEN 5 THEN n5 WHEN 6 THEN n6 ELSE n3 END FROM f WHERE r <= 40 AND (t IN (1, 2, 5) OR (t = 3 AND n3 > 0) OR (t = 6 AND n6 > 0))),
w AS (SELECT * FROM l UNION ALL SELECT query_id, 'partial', r, o_orderkey, code, raw, n FROM f WHERE r <= 40 AND t IN (3, 4, 6) AND query_id NOT IN (SELECT query_id FROM l WHERE list = 'best')),
x AS (SELECT query_id, list, row_number() OVER (PARTITION BY query_id, list ORDER BY r) AS place, o_orderkey, code, round(raw, 6) AS score, n_sections FROM w)"""


@query(f"WITH {_SEARCH} SELECT query_id, list, place, o_orderkey, score, n_sections FROM x")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of queries with filters against all records: best, partial and any matches."""
    rows = search.search(_records(spark, sf_dir), _asked(spark, sf_dir), PRIORITY, "o_orderkey")
    return rows.select("query_id", "list", "place", "o_orderkey", "score", F.size("sections").cast("long").alias("n_sections"))


@query(f"""WITH {_SEARCH} SELECT q.vec_id AS query_id, CASE WHEN count(o_orderkey) FILTER (list = 'best') > 0 OR count(o_orderkey) FILTER (list = 'partial') = 0 THEN '' WHEN (q.vec_id // 20) % 7 = 3 THEN 'l_quantity gte 45; l_returnflag eq R' WHEN (q.vec_id // 20) % 7 = 6 THEN 'flags includes_any A, X' ELSE 'l_returnflag eq 7' END AS unmatched,
coalesce(string_agg(code, ',' ORDER BY place) FILTER (list = 'best'), '') AS best, coalesce(string_agg(code, ',' ORDER BY place) FILTER (list = 'partial'), '') AS partial, coalesce(string_agg(code, ',' ORDER BY place) FILTER (list = 'any' AND place <= 10), '') AS other
FROM embeddings q JOIN x ON x.query_id = q.vec_id GROUP BY q.vec_id""")
def search_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's lists as one JSON object, and the filters that a query without full matches could not have."""
    records, asked = _records(spark, sf_dir), _asked(spark, sf_dir)
    results = search.search(records, asked, PRIORITY, "o_orderkey").join(records.select("o_orderkey", "code"), "o_orderkey")
    found = search.contexts(results, asked, F.struct("code", F.size("sections").alias("sections")), PRIORITY, "o_orderkey")
    codes = lambda name: F.array_join(F.transform(F.from_json("context", f"{name} array<struct<code:string>>")[name], lambda r: r["code"]), ",")
    return found.select("query_id", "unmatched", codes("best").alias("best"), codes("partial").alias("partial"), codes("any").alias("other"))


_TERM = "CASE month(l_shipdate) // 4 WHEN 0 THEN 'Spring' WHEN 1 THEN 'Summer' WHEN 2 THEN 'Fall' ELSE 'Winter' END || ' ' || year(l_shipdate)"
_FIRST = lambda x, n: f"(SELECT l_orderkey, string_agg(v, ',' ORDER BY f) AS v FROM (SELECT l_orderkey, {x} AS v, min(o) AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(o)) AS r FROM s GROUP BY l_orderkey, v) WHERE r <= {n} GROUP BY l_orderkey)"


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus, l_shipdate) AS o FROM lineitem)
SELECT o_orderkey, {CODE} AS code, coalesce(a.v, '') AS terms, coalesce(b.v, '') AS meets, (SELECT max_by(nullif(l_discount, 0), (l_shipdate, -o)) FILTER (nullif(l_discount, 0) IS NOT NULL) FROM s WHERE s.l_orderkey = o_orderkey) AS discount,
(SELECT max_by(l_quantity, (l_shipdate, -o)) FROM s WHERE s.l_orderkey = o_orderkey) AS quantity FROM orders LEFT JOIN {_FIRST(_TERM, 5)} a ON a.l_orderkey = o_orderkey LEFT JOIN {_FIRST("l_returnflag", 2)} b ON b.l_orderkey = o_orderkey""")
def record_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5: a record's first distinct terms and patterns, and of each field the latest value there is."""
    part = lambda s: F.floor(F.month(s["l_shipdate"]) / 4)
    season = lambda s: F.when(part(s) == 0, "Spring").when(part(s) == 1, "Summer").when(part(s) == 2, "Fall").otherwise("Winter")
    firsts = lambda f, n: F.array_join(F.slice(F.array_distinct(F.transform("sections", f)), 1, n), ",")
    # Latest first; of sections of one date the earlier one. A value of 0 counts as missing.
    newest = F.array_sort(F.transform("sections", lambda s, i: F.struct((-F.unix_micros(s["l_shipdate"].cast("timestamp"))).alias("t"), i.alias("i"), F.nullif(s["l_discount"], F.lit(0.0)).alias("d"), s["l_quantity"].alias("q"))))
    latest = lambda f: F.try_element_at(F.filter(F.transform(newest, lambda s: s[f]), lambda v: v.isNotNull()), F.lit(1))
    return catalogue(spark, sf_dir).select("o_orderkey", "code", firsts(lambda s: F.concat_ws(" ", season(s), F.year(s["l_shipdate"])), 5).alias("terms"), firsts(lambda s: s["l_returnflag"], 2).alias("meets"), latest("d").alias("discount"), latest("q").alias("quantity"))


@query("SELECT o_custkey AS code, arg_min(o_orderpriority, vec_id) AS title, arg_min(vec_id, vec_id) AS vector_of, count(*) AS n_sections, string_agg(DISTINCT coalesce(nullif(o_orderstatus, 'P'), 'TBA'), ',' ORDER BY coalesce(nullif(o_orderstatus, 'P'), 'TBA')) AS meets FROM embeddings JOIN orders ON vec_id = o_orderkey GROUP BY o_custkey")
def first_seen_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records collapsed by code, with title and vector of the first row seen, and a default for missing patterns."""
    rows = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "orders"), F.col("vec_id") == F.col("o_orderkey"))
    meets = F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("TBA"))
    return rows.groupBy(F.col("o_custkey").alias("code")).agg(F.min_by("o_orderpriority", "vec_id").alias("title"), F.min("vec_id").alias("vector_of"), F.count("*").alias("n_sections"), F.array_join(F.array_sort(F.collect_set(meets)), ",").alias("meets"))


@query("SELECT count(*) AS total, count(o_orderkey) AS seen, count(*) - count(o_orderkey) AS skipped, (SELECT count(*) FROM orders ANTI JOIN embeddings ON vec_id = o_orderkey) AS without FROM embeddings LEFT JOIN orders ON vec_id = o_orderkey")
def join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors find their record and how many are skipped; records without a vector."""
    both = table(spark, sf_dir, "embeddings").select("vec_id").join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("vec_id") == F.col("o_orderkey"), "full")
    count = lambda c: F.count_if(c)
    has, found = F.col("vec_id").isNotNull(), F.col("o_orderkey").isNotNull()
    return both.agg(count(has).alias("total"), count(has & found).alias("seen"), count(has & ~found).alias("skipped"), count(~has).alias("without"))


@query(f"WITH k AS (SELECT o_orderkey, {_KID} AS kid FROM orders SEMI JOIN embeddings ON vec_id = o_orderkey) SELECT CAST({_MOD} AS BIGINT) AS owner, count(*) AS records, min(o_orderkey) AS least, max(o_orderkey) AS greatest FROM k GROUP BY owner")
def sharded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a vector by the owner of their key, as the sharded sink (sources/sharded.py) writes and counts them."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "embeddings"), F.col("vec_id") == F.col("o_orderkey"), "left_semi")
    owner = ids.modulo(ids.key_id(F.col("o_orderkey")), 5).alias("owner")
    return rows.groupBy(owner).agg(F.count("*").alias("records"), F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("greatest"))


@query("SELECT string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS codes, string_agg(DISTINCT CAST(year(o_orderdate) AS VARCHAR), ',' ORDER BY CAST(year(o_orderdate) AS VARCHAR)) AS terms FROM orders WHERE year(o_orderdate) IN (1995, 1996) AND o_orderpriority <> ''")
def current_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct codes of given terms, sorted, and the terms."""
    rows = table(spark, sf_dir, "orders").filter(F.year("o_orderdate").isin(1995, 1996) & (F.col("o_orderpriority") != ""))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return rows.agg(listed("o_orderpriority").alias("codes"), listed(F.year("o_orderdate").cast("string")).alias("terms"))


@query("WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem), n AS (SELECT (SELECT count(*) FROM a) AS lines, greatest((SELECT count(*) FROM (FROM a EXCEPT FROM b)), (SELECT count(*) FROM (FROM b EXCEPT FROM a))) AS other) SELECT lines, other, round(other / lines, 6) AS ratio FROM n")
def line_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two sets of lines differ: the greater of both differences, against the first."""
    return retrieval.set_difference(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")), table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d")))


@query("""SELECT event_id, '{"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","ip":"' || user_id || '","query":"' || event_type || '"' || CASE WHEN user_id % 2 = 0 THEN ',"fallOnly":true' ELSE '' END || CASE WHEN k % 3 <> 0 THEN ',"time_ms":' || k ELSE '' END || '}' AS line FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records as JSON lines, keys without a value left out; streaming/log.py appends them."""
    k = F.get_json_object("props", "$.k").cast("long")
    line = log.line(ts=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), ip=F.col("user_id").cast("string"), query=F.col("event_type"), fallOnly=F.col("user_id") % 2 == 0, time_ms=F.when(k % 3 != 0, k))
    return table(spark, sf_dir, "events").select("event_id", line.alias("line"))


@query("SELECT page_id, coalesce(nullif(regexp_replace(url, '[^a-zA-Z0-9]', '', 'g'), ''), sha256(url)) AS name, sha256(regexp_replace(url, '[a-zA-Z0-9]', '', 'g')) AS other FROM pages")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys as names of files: letters and digits, or a hash where none is left."""
    rest = F.regexp_replace("url", "[a-zA-Z0-9]", "")
    return table(spark, sf_dir, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"), T.safe_name(rest).alias("other"))


@query(f"WITH f AS ({_top_sql(40, 'e.label IN (1, 3, 5)')}), u AS ({_top_sql(20)}), b AS (SELECT 1 AS list, * FROM f UNION ALL SELECT 2, * FROM u) SELECT vec_id, count(*) AS times, CAST(max(list) AS INTEGER) AS list, arg_max(score, list) AS score FROM b GROUP BY vec_id")
def shown_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered and unfiltered results as one bag, and by code, where the later list wins."""
    lists = (vector_top_k_filtered(spark, sf_dir).withColumn("list", F.lit(1)), flagship(spark, sf_dir).withColumn("list", F.lit(2)))
    return lists[0].unionByName(lists[1]).groupBy("vec_id").agg(F.count("*").alias("times"), F.max("list").alias("list"), F.max_by("score", "list").alias("score"))
