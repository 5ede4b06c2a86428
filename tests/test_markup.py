"""Pages read by a parser, phrases from tables, counts on the way, and small functions of records."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewell.functions import cards, html, ids, markup
from tidewell.operators import matching, merging
from tidewell.sources import remote

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="UTF-8"><title>Home</title><style>body {color: #333;}</style></head><body>
  <div class="container"> <h1>Welcome to the simple <i>links</i></h1>
    <p>Check out <a href="level_2a/index.html">Some stuff</a>.</p>
    <p>Check out <a href="level_2b/index.html">Some more stuff</a>.</p></div>
  <div class="footer"><p>&copy; 2023 Us. All rights   reserved.</p></div></body></html>"""


def test_text_of_a_page():
    want = "WELCOME TO THE SIMPLE LINKS\n\nCheck out Some stuff [level_2a/index.html].\n\nCheck out Some more stuff [level_2b/index.html].\n\n© 2023 Us. All rights reserved."
    assert markup.to_text(PAGE) == want
    for page, text in (
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>Hello <b>world</b></p><p>Nested <span>text</span> here</p>", "Hello world\n\nNested text here"),
        ("<script>var x = '<p>';</script>a<br>b<br/>c", "a\nb\nc"), ("<ul><li>one<li>two</ul><ol><li>x</li><li>y</li></ol>", " * one\n * two\n\n 1. x\n 2. y"), ("<div>a</div>\n <div> b </div>", "a\nb"),
        ("<a href='#top'>up</a> <a>none</a> <a href=x>x</a>", "up none x [x]"), ("<pre>a\n  b</pre>c", "a\n  b\n\nc"), ("<h2>a <a href='B'>b</a></h2>", "A B [B]"), ("<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>", "1 2\n3"), ("<p>unclosed <b>bold", "unclosed bold"), ("a<!-- no -->b < c", "ab < c"),
    ):
        assert markup.to_text(page) == text, page


def test_links_are_resolved():
    base = markup.base_of("https://h.example/a/index.html")
    assert base == "https://h.example/a/" and markup.base_of("https://h.example/path") == "https://h.example/path/"
    for href, want in (
        ("p.html", "https://h.example/a/p.html"), ("/r/p.html", "https://h.example/r/p.html"), ("https://O.example", "https://o.example/"), ("#s", "https://h.example/a/#s"), ("../b/./c", "https://h.example/b/c"), ("//o.example/x", "https://o.example/x"), ("mailto:a@b.example", "mailto:a@b.example"),
        ("?q=1 2", "https://h.example/a/?q=1%202"), ("", "https://h.example/a/"), (" x\n y ", "https://h.example/a/x%20y"), ("http://h:80/ä?ö#ü", "http://h/%C3%A4?%C3%B6#%C3%BC"), ("https://h:8443", "https://h:8443/"), ("http://[bad", None), ("http://a b/", None), ("http://h:x/", None), ("a\\b", "https://h.example/a/a/b"), ("../../../up", "https://h.example/up"),
    ):
        assert markup.absolute(base, href) == want, href


def test_pages_read(spark):
    rows = [(1, "https://h.example/a", PAGE, "clash"), (2, None, PAGE, ""), (3, "https://h.example/a", None, ""), (None, "x", "", "")] * 2
    found = markup.pages_read(spark.createDataFrame(rows, "page_id long, url string, html string, links string"))
    got = Counter((r.page_id, r.text[:7], tuple(r.links)) for r in found.collect())
    assert got == {(1, "WELCOME", ("https://h.example/a/level_2a/index.html", "https://h.example/a/level_2b/index.html")): 2, (2, "WELCOME", ()): 2, (3, "", ()): 2, (None, "", ()): 2}
    assert markup.links(spark.createDataFrame(rows, "page_id long, url string, html string, links string")).count() == 4


def test_thousands_of_phrases_in_one_pass(spark):
    rng = random.Random(1)
    words = ["w" + str(k) for k in range(60)]
    phrases = [(f"C{k % 700}", " ".join(rng.choices(words, k=rng.randint(1, 3)))) for k in range(3000)] + [("X", "  "), (None, "w1"), ("AND", "w1 & w2")]
    texts = [(k, " ".join(rng.choices(words, k=rng.randint(0, 30))).replace("w3 ", "W3-")) for k in range(60)] + [(60, None), (61, ""), (62, "w1 & w2"), (63, "xw1")]
    normal = lambda t: " ".join(re.findall("[a-z0-9]+", (t or "").lower().replace("&", " and ")))
    want = Counter({(i, t, c): 1 for i, t in texts for c, p in phrases if c and normal(p) and f" {normal(p)} " in f" {normal(t)} "})
    rows, table = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(phrases, "code string, phrase string")
    for block in (1 << 20, 5000):  # one automaton, and several
        assert Counter(map(tuple, matching.matched(rows, "text", table, block).collect())) == want
    assert matching.matched(rows, "text", table.limit(0)).count() == 0
    assert matching.listed(table, "code", 10_000)[:1] == ["AND"]
    with pytest.raises(ValueError, match="more than 5"):
        matching.listed(table, "code", 5)


def test_fields_filled_and_counted_in_one_pass(spark):
    rows = spark.createDataFrame([(1, "own"), (2, None), (3, "own"), (None, "own"), (1, "own")], "k int, d string")
    side = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (1, "", 3), (2, "two", 1), (3, None, 1), (None, "null", 1)], "k int, d string, o int")
    found, counts = merging.filled(rows, side, "k", "d", ["o"])
    assert Counter(map(tuple, found.collect())) == {(1, "new"): 2, (2, "two"): 1, (3, "own"): 1, (None, "own"): 1}
    assert counts.get == {"total": 5, "matched": 3, "unmatched": 2}
    fetched = remote.looked_up(rows, "k", lambda k: {"1": "one"}[k], "said", "none")
    assert Counter((r.k, r.said) for r in fetched.collect()) == {(1, "one"): 2, (2, "none"): 1, (3, "none"): 1, (None, "none"): 1}


def test_contexts_cards_and_ids(spark):
    sections = [("t1", "TBA", "a", "2", None, 5), ("t1", "MWF", "", "1", "x", None), ("t2", None, "b", "3", "", 7), ("t3", "TuTh", None, None, "z", None)]
    kind = "array<struct<term:string,meets:string,instr:string,order:string,rate:string,n:int>>"
    rows = spark.createDataFrame([("C 1", "d" * 500, sections), ("C 2", None, [])], f"code string, description string, sections {kind}")
    made = rows.select(cards.context(F.col("code"), F.lit("T"), F.col("description"), F.col("sections"), ["rate"], {"n": "count"}).alias("c"), cards.card(F.col("description"), F.col("sections")).alias("k")).collect()
    c, k = made[0].c, made[0].k
    assert (len(c.description), c.semesters, c.meets, c.instructors, c.rate, c.enrollment["count"]) == (400, ["t1", "t2", "t3"], ["MWF", "TuTh"], ["a", "b"], "x", 7)
    assert (len(k.description), k.semesters, k.meets, k.instructors) == (253, "t1, t2, t3", "MWF / TuTh", "a, b")
    assert tuple(made[1].c) == ("C 2", "T", "", [], [], [], None, None) and tuple(made[1].k) == ("", "", "TBA", "")
    one = lambda c: spark.range(1).select(c).first()[0]
    for text, number in (("0x00FF", "ff"), ("10", "10"), ("0", "0"), ("000", "0"), ("xyz", None), ("", None), ("f" * 64, "f" * 64)):
        assert one(ids.number(F.lit(text))) == number
    page = one(html.answer_html(F.lit("Take **C 1** & <b>C 1</b>\n\n\n\nC 10 \n\n "), F.array(F.lit("C 1")), "https://r.example/", F.lit("202410")))
    link = '<a href="https://r.example/?keyword=C%201&srcdb=202410" target="_blank">C 1</a>'
    assert page == f"<p>Take <strong>{link}</strong> &amp; &lt;b&gt;{link}&lt;/b&gt;</p><p>C 10</p>"
    assert one(html.relinked(F.lit('<a href="/search/?p=C 1">x</a>'), "https://r.example/")) == '<a target="_blank" href="https://r.example/?keyword=C 1">x</a>'
