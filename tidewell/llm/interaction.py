"""How filters of documents act on one another: what each removes, step by step, under every order of the filters.

A document is reduced to a mask of the filters it fails, and only counts of equal masks go on. Each mask cell is folded
across the array of all orders, which gives a struct of weighted counts for each order and step; those of all cells of a
part are added place by place.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_BLANK = " \t\n\x0b\f\r"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failed(text: Column) -> Column:
    """Bits 0 to 3: fewer than 200 words; fewer than half of the words distinct; over 3 percent of A to Z; any of # $ % & * |. Words end at blank and 09 to 0D."""
    bare = F.btrim(text, F.lit(_BLANK))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))
    n, capitals = F.size(words), F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    tests = (n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike("[#$%&*|]"))
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic and n: how many documents are alike in all of these.

    Bit 4 of a mask: a row of smaller doc_id has the same text (by length and SHA-256). Rows equal in id, text and part are
    counted first, so neither a text nor an id of many rows is gathered; then the least id of each text, with its rows, is
    found by partial aggregation. A null id is neither smaller than another nor has it labels; such rows meet by text.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failed(text).alias("bits"))
    rows = rows.groupBy("doc_id", "part", "digest", "bits").agg(F.count("*").alias("n"))
    label = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # Rows without an id are dealt by text; the second condition keeps them from any label.
    rows = rows.withColumn("dealt", F.coalesce("doc_id", F.xxhash64("digest")))
    label = label.withColumn("again", F.col("labelled"))
    joined = rows.join(label, (F.col("dealt") == F.col("labelled")) & (F.col("doc_id") == F.col("again")), "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    # Of one text, part and pair of labels: rows, rows without an id, and the least id with its rows (ids are distinct here).
    alike = joined.select("part", "digest", "bits", "doc_id", "n", flag("good"), flag("toxic")).groupBy("digest", "part", "bits", "good", "toxic")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    alike = alike.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), least.alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))  # a row for each part and pair of labels at most
    alike = alike.withColumn("unique", F.col("unnamed") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    split = F.explode(F.array(F.struct(F.col("bits").alias("mask"), F.col("unique").alias("n")), F.struct((F.col("bits") + 16).alias("mask"), (F.col("n") - F.col("unique")).alias("n")))).alias("x")
    found = alike.select("part", "good", "toxic", split).filter("x.n > 0")
    return found.groupBy("part", F.col("x.mask").alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def folded(mask: Column, n: Column, good: Column, toxic: Column, orders: Column) -> Column:
    """For each order, and in it each step, one cell's share of the counts: an array of 5 structs an order, end to end."""
    zero = F.lit(0).cast("long")
    bits = F.create_map(*(x for i, c in enumerate(FILTERS) for x in (F.lit(c), F.lit(1 << i))))

    def step(order: Column, state: Column, k: Column) -> Column:
        own = F.element_at(bits, F.substr(order, k, F.lit(1)))
        fails = mask.bitwiseAND(own) != 0
        now = fails & ~state["gone"]
        when = lambda c: F.when(c, n).otherwise(zero)
        counts = F.struct(when(~state["gone"] & ~fails).alias("kept"), when(now).alias("removed"), when(fails & state["gone"]).alias("redundant"), when(mask == own).alias("unique_fails"), when(now & good).alias("good_lost"), when(now & toxic).alias("toxic_lost"))
        return F.struct((state["gone"] | fails).alias("gone"), F.concat(state["steps"], F.array(counts)).alias("steps"))

    start = F.struct(F.lit(False).alias("gone"), F.array().cast(f"array<struct<{', '.join(f'{c}: bigint' for c in _COUNTS)}>>").alias("steps"))
    steps = F.sequence(F.lit(1), F.lit(len(FILTERS)))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(steps, start, lambda state, k: step(order, state, k), lambda state: state["steps"])))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part (lang; null: empty), order of the five filters and step: counts of documents, and the filter's removals over all orders.

    kept: neither this filter nor one before fails; removed: fails here first; redundant: fails, but is gone already;
    unique_fails: fails this filter alone; good_lost and toxic_lost: of the removed, those labelled quality 1 and toxic 1.
    Of several label rows of one id any that says 1 counts. A null text is an empty one; no documents, no rows; other columns aren't read.
    """
    orders = F.split(F.lit(",".join(ORDERS)), ",")
    found = cells(docs, labels).select("part", F.posexplode(folded(F.col("mask"), F.col("n"), F.col("good"), F.col("toxic"), orders)).alias("place", "x"))
    sums = found.groupBy("part", "place").agg(*(F.sum(f"x.{c}").alias(c) for c in _COUNTS))
    order = F.element_at(orders, (F.col("place") / len(FILTERS)).cast("int") + 1)
    step = F.col("place") % len(FILTERS) + 1
    sums = sums.select("part", order.alias("filter_order"), step.cast("int").alias("step"), *_COUNTS)
    letter = F.substr("filter_order", "step", F.lit(1))
    return sums.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))
