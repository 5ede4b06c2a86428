"""Verdicts on URLs: by a list of rules on hosts and paths, and beyond it by association rules mined from the URLs that the list covers.

All of it is DataFrame functions and Spark's FP-growth. A URL is described by at most eight tokens, so the frequent sets of
tokens are fewer than 2**9 / `support`, whatever the input; their rules, pruned by support, confidence and by shorter rules
that say as much, are an inverted index: an array of buckets by the hash of each rule's rarest token. It is one scalar
subquery, so that each row looks its tokens up where it is, without a shuffle.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Least share and number of the labelled URLs that a rule covers rightly, least share of its URLs that have its verdict, and buckets of the index.
SUPPORT, LEAST, CONFIDENCE, BUCKETS = 0.01, 10, 0.8, 1024
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path; both empty for null and for what has no `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _UPPER.lower()), F.regexp_extract(url, pattern, 2)


def listed(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null where none fits. A rule fits its host and all below it, on paths that begin as its own. The list is compiled into one expression."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, said).otherwise(verdict)
    return text, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """At most eight tokens, sorted: last label of the host, last two, a label before them, first folder, first digit of the last segment, file type, first query key, fragment."""
    found = (
        ("tld", host, r"([^.:]+)(?::[0-9]*)?$"), ("site", host, r"([^.]+\.[^.:]+)(?::[0-9]*)?$"), ("sub", host, r"^([^.]+)\.[^.]+\.[^.]"), ("dir", path, r"^/([^/]+)/"),
        ("num", path, r"/([0-9])[^/]*/?$"), ("type", path, r"\.([A-Za-z0-9]+)$"), ("key", F.coalesce(url, F.lit("")), r"[?]([^=&#]+)"), ("part", F.coalesce(url, F.lit("")), r"(#)"),
    )
    named = lambda name, value: F.when(value != "", F.concat(F.lit(f"{name}="), value))
    return F.array_sort(F.array_compact(F.array(*(named(n, F.regexp_extract(c, p, 1)) for n, c, p in found))))


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """tokens, verdict, confidence, support and lead (its rarest token) of the rules that hold in `labelled` (tokens, verdict).

    A rule covers at least `support` of all rows and `least` rows, has `confidence` or more, says more than the verdict's own share (lift above
    1), and no rule on fewer of its tokens has the same verdict with at least its confidence. Tokens hold no blank at the front,
    so a verdict's item can't be taken for one. Without rows there are no rules.
    """
    verdicts = ("allow", "block")
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(" "), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    # Mined once: what follows reads the written sets.
    sets = common.written(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    total = labelled.count()
    alone = sets.filter(F.size("items") == 1).select(F.col("items")[0].alias("item"), F.col("freq").alias("item_freq"))
    named = F.array(*(F.lit(f" {v}") for v in verdicts))
    both = sets.filter(F.arrays_overlap("items", named) & (F.size("items") > 1) & (F.col("freq") >= least))
    both = both.select(F.array_except("items", named).alias("tokens"), F.element_at(F.array_intersect("items", named), 1).alias("item"), F.col("freq").alias("both"))
    rules = both.join(sets.select(F.col("items").alias("tokens"), "freq"), "tokens").join(alone, "item")
    rules = rules.withColumns({"confidence": F.col("both") / F.col("freq"), "support": F.col("both") / F.lit(max(total, 1)), "verdict": F.substring("item", 2, 9)})
    rules = rules.filter((F.col("confidence") >= confidence) & (F.round(F.col("confidence") / (F.col("item_freq") / F.lit(max(total, 1))), 9) > 1)).drop("item", "item_freq", "both", "freq")
    # Every shorter rule of a rule: at most 254 subsets of its tokens.
    subsets = F.aggregate("tokens", F.array(F.array().cast("array<string>")), lambda some, t: F.concat(some, F.transform(some, lambda s: F.concat(s, F.array(t)))))
    shorter = rules.select("verdict", F.col("tokens").alias("whole"), F.col("confidence").alias("most"), F.explode(subsets).alias("tokens")).filter((F.size("tokens") > 0) & (F.size("tokens") < F.size("whole")))
    known = shorter.join(rules.select("tokens", "verdict", "confidence"), ["tokens", "verdict"]).filter("confidence >= most").select(F.col("whole").alias("tokens"), "verdict").distinct()
    rules = rules.join(known, ["tokens", "verdict"], "left_anti")
    lead = rules.select("tokens", "verdict", F.explode("tokens").alias("item")).join(alone, "item").groupBy("tokens", "verdict").agg(F.min(F.struct("item_freq", "item"))["item"].alias("lead"))
    return common.written(rules.join(lead, ["tokens", "verdict"]))


def index(rules: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: an array of buckets, each the rules whose lead hashes to it."""
    rule = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.array_join("tokens", " ").alias("text"), "verdict", "tokens")
    own = rules.groupBy(_bucket(F.col("lead"), buckets).alias("b")).agg(F.collect_list(rule).alias("rules"))
    by_bucket = F.map_from_entries(F.collect_list(F.struct("b", "rules")))
    kind = own.schema["rules"].dataType
    return own.agg(by_bucket.alias("m")).select(F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.array().cast(kind))))


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def judged(pages: DataFrame, rules: tuple = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, buckets: int = BUCKETS) -> DataFrame:
    """page_id, host, path, rule (the listed one, else null), verdict, and mined: the tokens of the mined rule that decided, else null.

    Listed rules come first. Other URLs take the verdict of the mined rule of greatest confidence (ties: support, then text) whose
    tokens they have all of, and the commoner listed verdict (`allow` at ties) if there is none. Null urls have no host, path
    or tokens. A page is judged by its url alone: repeated rows get equal verdicts; other columns aren't read.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, said = listed(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    labelled = rows.filter("said is not null").select("tokens", F.col("said").alias("verdict"))
    found = mined(labelled, support, confidence)
    usual = labelled.agg(F.when(F.count_if(F.col("verdict") == "block") > F.count_if(F.col("verdict") == "allow"), "block").otherwise("allow").alias("v"))
    place = F.col("index")
    rows = rows.withColumn("index", index(found, buckets).scalar())
    candidates = F.flatten(F.transform("tokens", lambda t: F.element_at(place, _bucket(t, buckets) + 1)))
    best = F.array_min(F.filter(candidates, lambda r: F.size(F.array_except(r["tokens"], F.col("tokens"))) == 0))
    rows = rows.withColumn("best", F.when(F.col("said").isNull(), best))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", "best.verdict", usual.scalar()).alias("verdict"), F.col("best.text").alias("mined"))
