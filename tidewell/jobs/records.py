"""Further queries: pages read by a parser, phrases from tables, records as contexts and cards, and what is counted on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cards, html, ids, markup
from ..functions import text as T
from ..operators import counting, matching, merging
from ..sources import remote
from ..sources.tables import catalogue, kept, table
from .catalog import _TERM, CODE, TOKENS, query

_NORMAL = lambda x: f"trim(regexp_replace(replace(lower({x}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


@query("SELECT page_id, CAST(i - 1 AS INTEGER) AS position, regexp_extract(url, '^https?://[^/]+') || '/' || replace(url_encode(substr(h[i], 2)), '%2C', ',') AS link FROM (SELECT page_id, url, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS h FROM pages))")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page, resolved as a browser does, by a parser."""
    return markup.links(table(spark, sf_dir, "pages"))


@query()
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of pages by blocks, headings in capitals, links with their targets."""
    return markup.pages_read(table(spark, sf_dir, "pages")).select("page_id", "text", F.size("links").alias("n_links"))


@query(f"""WITH w AS (SELECT source AS code, string_split({_NORMAL("text")}, ' ') AS w FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
a AS (SELECT DISTINCT code, w[1] || ' ' || w[2] AS alias FROM w WHERE len(w) > 1 AND w[1] <> '')
SELECT conv_id, turn, code, count(*) AS n FROM (SELECT DISTINCT conv_id, turn, role, text, code FROM conversations, a WHERE contains(' ' || {_NORMAL("text")} || ' ', ' ' || alias || ' ')) GROUP BY ALL""")
def phrase_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources whose texts begin with two words that a turn holds: a table of phrases, found in one pass."""
    words = F.split(T.normalised(F.col("text")), " ")
    phrases = table(spark, sf_dir, "documents").filter("text is not null and source is not null").select(F.col("source").alias("code"), words.alias("w"))
    phrases = phrases.filter((F.size("w") > 1) & (F.col("w")[0] != "")).select("code", F.concat_ws(" ", F.col("w")[0], F.col("w")[1]).alias("phrase"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").distinct()
    return matching.matched(turns, "text", phrases).groupBy("conv_id", "turn", "code").agg(F.count("*").alias("n"))


@query(f"WITH u AS (SELECT doc_id, lang, unnest({TOKENS}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents), s AS (SELECT term FROM u, n GROUP BY term, n HAVING 10 * count(DISTINCT doc_id) > 3 * n) SELECT term, count(*) AS freq FROM u ANTI JOIN s USING (term) GROUP BY term")
def stopped_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """words of all texts but those of a table of stop words: here words that more than three documents in ten have."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    return counting.uncommon(docs, "doc_id", "w", 3, 10)


@query("""WITH s AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS found FROM orders WHERE o_orderstatus <> 'P' AND o_orderstatus <> '' GROUP BY o_custkey)
SELECT c_custkey, coalesce(found, c_mktsegment) AS label, (SELECT count(*) FROM customer) AS total, (SELECT count(*) FROM customer SEMI JOIN s ON o_custkey = c_custkey) AS matched, (SELECT count(*) FROM customer ANTI JOIN s ON o_custkey = c_custkey) AS unmatched FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def filled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field from the last row of the other side, or else one's own; matched and unmatched come with the write."""
    side = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("label"), "o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("label"))
    filled, counts = merging.filled(rows, side, "c_custkey", "label", ["o_orderdate", "o_orderkey"])
    out = kept(filled)
    return out.withColumns({n: F.lit(v).cast("long") for n, v in counts.get.items()})


@query("SELECT s_suppkey, s_name, CASE WHEN s_nationkey IS NULL OR s_nationkey % 5 = 0 THEN '' ELSE 'nation ' || s_nationkey END AS details FROM supplier")
def detailed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details that a service gives for each distinct key, empty where it fails."""

    def service(key: str) -> str:
        if int(key) % 5 == 0:
            raise LookupError(key)
        return f"nation {key}"

    return remote.looked_up(table(spark, sf_dir, "supplier"), "s_nationkey", service, "details", passes=1).select("s_suppkey", "s_name", "details")


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the text of the document of their number as description; sections with a term, patterns (TBA among them), people (some none), and what is rated."""
    part = lambda s: F.floor(F.month(s["l_shipdate"]) / 4)
    season = lambda s: F.when(part(s) == 0, "Spring").when(part(s) == 1, "Summer").when(part(s) == 2, "Fall").otherwise("Winter")
    section = lambda s: F.struct(
        F.concat_ws(" ", season(s), F.year(s["l_shipdate"])).alias("term"), F.when(s["l_returnflag"] == "N", "TBA").otherwise(s["l_returnflag"]).alias("meets"), F.when(s["l_linestatus"] == "O", "").otherwise(s["l_linestatus"]).alias("instr"),
        F.date_format(s["l_shipdate"], "yyyyMMdd").alias("order"), F.nullif(s["l_discount"], F.lit(0.0)).alias("discount"), s["l_quantity"].alias("quantity"),
    )
    texts = table(spark, sf_dir, "documents").groupBy(F.col("doc_id").alias("o_orderkey")).agg(F.max("text").alias("description"))
    return catalogue(spark, sf_dir).select("o_orderkey", "code", F.transform("sections", section).alias("sections")).join(texts, "o_orderkey", "left")


_OWN = f"""s AS (SELECT *, {_TERM} AS term, CASE WHEN l_returnflag = 'N' THEN 'TBA' ELSE l_returnflag END AS meets, CASE WHEN l_linestatus = 'O' THEN '' ELSE l_linestatus END AS instr, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus, l_shipdate) AS o FROM lineitem),
t AS (SELECT doc_id, max(text) AS text FROM documents GROUP BY doc_id)"""
_SOME = lambda x, n, sep=",": f"(SELECT l_orderkey, string_agg(v, '{sep}' ORDER BY f) AS v FROM (SELECT l_orderkey, {x} AS v, min(o) AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(o)) AS r FROM s WHERE {x} NOT IN ('', 'TBA') GROUP BY l_orderkey, v) WHERE r <= {n} GROUP BY l_orderkey)"


@query(f"""WITH {_OWN} SELECT o_orderkey, {CODE} AS code, substr(coalesce(t.text, ''), 1, 400) AS description, coalesce(a.v, '') AS semesters, coalesce(b.v, '') AS meets, coalesce(c.v, '') AS instructors, x.d AS discount, x.q AS quantity FROM orders LEFT JOIN t ON t.doc_id = o_orderkey
LEFT JOIN {_SOME("term", 5)} a ON a.l_orderkey = o_orderkey LEFT JOIN {_SOME("meets", 3)} b ON b.l_orderkey = o_orderkey LEFT JOIN {_SOME("instr", 3)} c ON c.l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey, max_by(nullif(l_discount, 0), (strftime(l_shipdate, '%Y%m%d'), -o)) FILTER (nullif(l_discount, 0) IS NOT NULL) AS d, max_by(l_quantity, (strftime(l_shipdate, '%Y%m%d'), -o)) FILTER (l_quantity IS NOT NULL) AS q FROM s GROUP BY l_orderkey) x ON x.l_orderkey = o_orderkey""")
def context_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as a model's context has them."""
    c = F.col("c")
    rows = _described(spark, sf_dir).select("o_orderkey", cards.context(F.col("code"), F.lit(""), F.col("description"), F.col("sections"), ["discount"], {"quantity": "quantity"}).alias("c"))
    lists = [F.array_join(c[n], ",").alias(n) for n in ("semesters", "meets", "instructors")]
    return rows.select("o_orderkey", c["code"].alias("code"), c["description"].alias("description"), *lists, c["discount"].alias("discount"), c["enrollment"]["quantity"].alias("quantity"))


_CUT = "regexp_replace(substr(coalesce(t.text, ''), 1, 250), '</?\\w[^>]*\\z', '')"


@query(f"""WITH {_OWN} SELECT o_orderkey, CASE WHEN length(coalesce(t.text, '')) <= 250 THEN coalesce(t.text, '') ELSE {_CUT} || CASE WHEN len(regexp_extract_all({_CUT}, '(?i)<a[\\s>]')) > len(regexp_extract_all({_CUT}, '(?i)</a>')) THEN '</a>' ELSE '' END || '...' END AS description, coalesce(a.v, '') AS semesters, coalesce(b.v, 'TBA') AS meets, coalesce(c.v, '') AS instructors FROM orders LEFT JOIN t ON t.doc_id = o_orderkey
LEFT JOIN {_SOME("term", 4, ", ")} a ON a.l_orderkey = o_orderkey LEFT JOIN {_SOME("meets", 3, " / ")} b ON b.l_orderkey = o_orderkey LEFT JOIN {_SOME("instr", 3, ", ")} c ON c.l_orderkey = o_orderkey""")
def display_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as a page shows them."""
    rows = _described(spark, sf_dir)
    return rows.select("o_orderkey", cards.card(F.col("description"), F.col("sections")).alias("c")).select("o_orderkey", "c.*")


_LINK = lambda code: f"'<a href=\"https://records.example/?keyword=' || replace({code}, ' ', '%20') || '&srcdb=999999\" target=\"_blank\">' || {code} || '</a>'"
_WHO = "upper(substr(role, 1, 4)) || ' ' || lpad(CAST(conv_id % 10000 AS VARCHAR), 4, '0')"


@query(f"""WITH a AS (SELECT *, {_WHO} AS code FROM conversations WHERE text IS NOT NULL), e AS (SELECT *, replace(replace(replace(replace(regexp_replace(text, '\\s+', ' ', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS t FROM a)
SELECT conv_id, turn, role, '<p><strong>' || {_LINK("code")} || '</strong> is one &amp; all</p>' || CASE WHEN trim(t) = '' THEN '' ELSE '<p>' || trim(t) || '</p>' END AS html, '<a target="_blank" href="https://records.example/?keyword=' || code || '">x</a>' AS link, count(*) AS n FROM e WHERE NOT contains(t, '**') AND NOT contains(t, code) GROUP BY ALL""")
def answer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as HTML, with their codes as links; and descriptions' links led elsewhere."""
    base, code = "https://records.example/", F.concat_ws(" ", F.upper(F.substring("role", 1, 4)), F.lpad((F.col("conv_id") % 10000).cast("string"), 4, "0"))
    rows = table(spark, sf_dir, "conversations").filter("text is not null").withColumn("code", code).filter(~F.col("text").contains("**") & ~F.col("text").contains(F.col("code")))
    said = F.concat(F.lit("**"), F.col("code"), F.lit("** is one & all\n\n"), F.regexp_replace("text", r"\s+", " "), F.lit("\n\n"))
    page = html.answer_html(said, F.array("code"), base, F.lit(None).cast("string"))
    link = html.relinked(F.concat(F.lit('<a href="/search/?p='), F.col("code"), F.lit('">x</a>')), base)
    return rows.groupBy("conv_id", "turn", "role", page.alias("html"), link.alias("link")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, lower(printf('%X', o_orderkey)) AS number FROM orders")
def id_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written in hex, in either case, with a mark or zeros in front, as one number."""
    written = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("0x00"), F.hex("o_orderkey"))).otherwise(F.lower(F.hex("o_orderkey")))
    return table(spark, sf_dir, "orders").select("o_orderkey", ids.number(written).alias("number"))


@query("SELECT vec_id, CASE WHEN label % 3 = 0 THEN 0.0 ELSE round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) END AS total FROM embeddings")
def neutral_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that say nothing but have filters get a vector of zeros."""
    said = F.when(F.col("label") % 3 != 0, "something")
    vector = cards.query_vector(said, F.array(F.lit("a filter")), F.col("embedding"), 64)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("WITH k AS (SELECT list(DISTINCT n_name) AS known FROM nation JOIN supplier ON s_nationkey = n_nationkey) SELECT c_custkey, array_to_string(list_sort(list_intersect([n_name, upper(c_mktsegment), r_name], known)), ',') AS codes FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, k")
def known_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes that a query names, as far as they are known."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    known = matching.listed(nations.join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi"), "n_name")
    named = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    codes = F.array_intersect(F.array("n_name", F.upper("c_mktsegment"), "r_name"), F.array(*map(F.lit, known)))
    return named.select("c_custkey", F.array_join(F.array_sort(codes), ",").alias("codes"))


@query("""WITH s AS (SELECT *, CASE month(o_orderdate) // 4 WHEN 0 THEN 'Spring' WHEN 1 THEN 'Summer' WHEN 2 THEN 'Fall' ELSE 'Winter' END AS season FROM orders)
SELECT o_orderkey AS crn, season, CAST(year(o_orderdate) AS INTEGER) AS year, season || ' ' || year(o_orderdate) AS semester, CASE WHEN o_orderstatus = 'F' OR o_orderstatus IS NULL THEN '' ELSE o_orderstatus END AS instr, CASE o_orderkey % 4 WHEN 0 THEN 'MWF 9' WHEN 1 THEN 'TuTh 1:00' WHEN 2 THEN 'TBA' ELSE 'TTh 2' END AS meets,
CASE o_orderkey % 4 WHEN 0 THEN 'M,W,F' WHEN 1 THEN 'Tu,Th' WHEN 2 THEN '' ELSE 'Th,T' END AS days, '[]' AS times, strftime(o_orderdate, '%Y-%m-%d') AS start_date, '' AS end_date, 'N' AS permreq, CASE WHEN o_totalprice > 150000 THEN o_totalprice END AS rating FROM s""")
def section_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with the defaults and derived fields of the index, and optional fields only where there are some."""
    part = F.floor(F.month("o_orderdate") / 4)
    code = F.concat(F.year("o_orderdate").cast("string"), F.when(part == 0, "20").when(part == 1, "00").when(part == 2, "10").otherwise("15"))
    meets = F.get(F.array(F.lit("MWF 9"), F.lit("TuTh 1:00"), F.lit(None), F.lit("TTh 2")), (F.col("o_orderkey") % 4).cast("int"))
    fields = {"crn": F.col("o_orderkey"), "srcdb": code, "instr": F.nullif("o_orderstatus", F.lit("F")), "meets": meets, "start_date": F.date_format("o_orderdate", "yyyy-MM-dd"), "end_date": F.lit("")}
    made = cards.section(fields, {"rating": F.when(F.col("o_totalprice") > 150000, F.col("o_totalprice"))})
    s = table(spark, sf_dir, "orders").select(made.alias("s")).select("s.*")
    return s.select("crn", "season", "year", "semester", "instr", "meets", F.array_join("days", ",").alias("days"), F.col("meetingTimes").alias("times"), "start_date", "end_date", "permreq", "rating")
