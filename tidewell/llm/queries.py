"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bytededup, decontam, interaction, jaccard, media, periodic, secrets, sharding, substrings, tokens, toxicity, urls
from .common import table


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")


def op2_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_column(table(spark, sf_dir, "documents"))


def op3_benchmark_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytededup.digest(bytededup.dedup(table(spark, sf_dir, "documents")))


def op7_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))
    offsets = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), offsets.alias("offsets"))


def op8_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents")).drop("ids")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.dedup(table(spark, sf_dir, "documents")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.find_runs(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_hilbert_shards, op2_chunked_media, op3_benchmark_index, op4_token_counts, op5_secret_scan, op6_suffix_dedup, op7_toxic_spans, op8_bpe_roundtrip, op9_substring_dedup, op10_jaccard_join, op11_filter_interactions, op12_url_rules, op13_periodic_runs)}
ORACLE_SQL: dict[str, str] = {}

#: A to Z lower-cased, then words; windows of up to ten words joined by blanks (no word holds one).
ORACLE_SQL["op3_benchmark_index"] = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
bp AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS k FROM bp),
sizes AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n),
dw AS (SELECT rid, n, p, array_to_string(w[p : p + n - 1], ' ') AS k FROM dp),
occ AS (SELECT rid, item, n, p FROM dw JOIN bw USING (n, k)),
hit AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM occ) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM occ GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""

#: Windows of 20 words joined by a blank; a window goes if its words start earlier too.
ORACLE_SQL["op9_substring_dedup"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, p, array_to_string(w[p : p + 19], ' ') AS k FROM p),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM k) WHERE n > 1),
c AS (SELECT doc_id, list(DISTINCT q) AS gone FROM (SELECT doc_id, unnest(range(p, p + 20)) AS q FROM r) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""

#: Pairs of distinct shingle sets that share a shingle, counted; then everything reachable over links.
ORACLE_SQL["op10_jaccard_join"] = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p : p + 4], ' ')) END)) AS sh FROM d),
c AS (SELECT sh, min(doc_id) AS id, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
x AS (SELECT id, n, unnest(sh) AS g FROM c),
p AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT id AS a, id AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS id, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id FROM s LEFT JOIN c ON s.sh = c.sh LEFT JOIN m ON m.id = c.id
"""

#: Rows alike in part, failed filters and labels, counted; each count meets every order and step.
ORACLE_SQL["op11_filter_interactions"] = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS w FROM documents),
m AS (SELECT *, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN m.doc_id > least THEN 'E' ELSE '' END AS fails FROM m LEFT JOIN l ON l.doc_id = m.doc_id),
c AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
s AS (SELECT o, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o),
j AS (SELECT c.*, o, step, substr(o, step, 1) AS letter, contains(fails, substr(o, step, 1)) AS hit, length(translate(substr(o, 1, step - 1), fails, '')) < step - 1 AS gone FROM c, s),
r AS (SELECT part, o AS filter_order, step, letter, CAST(coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (gone AND hit), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = letter), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(n) FILTER (NOT gone AND hit AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (NOT gone AND hit AND toxic), 0) AS BIGINT) AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
"""

_RULES = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
_LISTED = lambda own: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{own(v, h, p)}'" for v, h, p in _RULES) + " END"
_TOKEN = lambda name, column, pattern: f"'{name}=' || nullif(regexp_extract({column}, '{pattern}', 1), '')"

#: Every set of tokens of every labelled url, counted by verdict, in place of FP-growth.
ORACLE_SQL["op12_url_rules"] = f"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
t AS (SELECT *, {_LISTED(lambda v, h, p: h + p)} AS rule, {_LISTED(lambda v, h, p: v)} AS said, list_sort(list_filter([{_TOKEN("tld", "host", "([^.:]+)(?::[0-9]*)?$")}, {_TOKEN("site", "host", "([^.]+[.][^.:]+)(?::[0-9]*)?$")}, {_TOKEN("sub", "host", "^([^.]+)[.][^.]+[.][^.]")}, {_TOKEN("dir", "path", "^/([^/]+)/")}, {_TOKEN("num", "path", "/([0-9])[^/]*/?$")}, {_TOKEN("type", "path", "[.]([A-Za-z0-9]+)$")}, {_TOKEN("key", "url", "[?]([^=&#]+)")}, {_TOKEN("part", "url", "(#)")}], lambda x: x IS NOT NULL)) AS w FROM u),
sets AS (SELECT rid, said, list_filter(w, lambda x, i: (m >> (i - 1)) & 1 = 1) AS s FROM (SELECT rid, said, w, unnest(range(1, 1 << len(w))) AS m FROM t)),
n AS (SELECT count(*) AS n, count(*) FILTER (said = 'allow') AS allow, count(*) FILTER (said = 'block') AS block FROM t WHERE said IS NOT NULL),
k AS (SELECT s, count(*) AS freq, count(*) FILTER (said = 'allow') AS allow, count(*) FILTER (said = 'block') AS block FROM sets WHERE said IS NOT NULL GROUP BY s),
v AS (SELECT s, 'allow' AS verdict, CAST(k.allow AS DOUBLE) / freq AS c, CAST(k.allow AS DOUBLE) / n AS p, k.allow AS b, CAST(n.allow AS DOUBLE) / n AS share FROM k, n UNION ALL SELECT s, 'block', CAST(k.block AS DOUBLE) / freq, CAST(k.block AS DOUBLE) / n, k.block, CAST(n.block AS DOUBLE) / n FROM k, n),
r AS (SELECT s, verdict, c, p FROM v, n WHERE b >= greatest({urls.LEAST}, ceil({urls.SUPPORT} * n)) AND c >= {urls.CONFIDENCE} AND round(c / share, 9) > 1),
q AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.verdict = r.verdict AND x.c >= r.c AND len(x.s) < len(r.s) AND list_has_all(r.s, x.s))),
best AS (SELECT rid, arg_min(struct_pack(v := verdict, m := array_to_string(q.s, ' ')), (-c, -p, array_to_string(q.s, ' '))) AS x FROM sets JOIN q USING (s) WHERE said IS NULL GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(said, x.v, (SELECT CASE WHEN block > allow THEN 'block' ELSE 'allow' END FROM n)) AS verdict, x.m AS mined FROM t LEFT JOIN best USING (rid)
"""
