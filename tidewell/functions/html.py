"""Fields of HTML fragments, links resolved against a page, and shortened or escaped markup, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import plain


def element(html: Column, tag: str, css: str | None = None) -> Column:
    """Text of the first element of this tag (and class); empty if there is none."""
    attributes = "[^>]*" if css is None else f'[^>]*class="{css}"[^>]*'
    return plain(F.regexp_extract(html, f"(?is)<{tag}(?:\\s{attributes})?>(.*?)</{tag}>" if css is None else f"(?is)<{tag}\\s{attributes}>(.*?)</{tag}>", 1))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, n), " ")


def without_links(html: Column) -> Column:
    """Anchors go, what they enclose stays."""
    return F.regexp_replace(html, r"(?i)</?a(?:\s[^>]*)?>", "")


def resolved(url: Column, href: Column) -> Column:
    """An absolute link: as it is, from the page's origin, as a fragment of the page, or from the page's folder."""
    origin = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    bare = F.regexp_replace(url, r"[?#].*", "")
    folder = F.when(bare.rlike(r"^https?://[^/]+$"), F.concat(bare, F.lit("/"))).otherwise(F.regexp_replace(bare, r"[^/]*$", ""))
    return F.when(href.rlike("^https?://"), href).when(href.startswith("/"), F.concat(origin, href)).when(href.startswith("#"), F.concat(F.regexp_replace(url, "#.*", ""), href)).otherwise(F.concat(folder, href))


def shortened(html: Column, n: int) -> Column:
    """The first n characters and `...`, without a tag cut in two, an open anchor closed; shorter markup stays."""
    cut = F.regexp_replace(F.substring(html, 1, n), r"</?\w[^>]*\z", "")
    opened = F.regexp_count(cut, F.lit(r"(?i)<a[\s>]")) > F.regexp_count(cut, F.lit("(?i)</a>"))
    return F.when(F.length(html) <= n, html).otherwise(F.concat(cut, F.when(opened, F.lit("</a>")).otherwise(F.lit("")), F.lit("...")))


def escaped(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def uri_component(text: Column) -> Column:
    """Percent-encoded but for letters, digits and - _ . ! ~ * ' ( )."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def record_link(base: str, code: Column, term: Column) -> Column:
    """The address at which a service shows a record: keyword and term as parameters; 999999 for no term."""
    return F.concat(F.lit(base), F.lit("?keyword="), uri_component(code), F.lit("&srcdb="), F.coalesce(term, F.lit("999999")))


def relinked(html: Column, base: str) -> Column:
    """Links to a search for a code lead to the service, and all links open apart."""
    own = F.regexp_replace(html, r'href="/search/\?p=([^"]+)"', f'href="{base}?keyword=$1"')
    return F.replace(own, F.lit("<a "), F.lit('<a target="_blank" '))


def answer_html(text: Column, codes: Column, base: str, term: Column) -> Column:
    """An answer as HTML: escaped, **bold** marked, the cited codes (an array) as links, paragraphs by blank lines."""
    out = F.regexp_replace(escaped(text), r"\*\*([^*]+)\*\*", "<strong>$1</strong>")
    link = lambda code: F.concat(F.lit('<a href="'), record_link(base, code, term), F.lit('" target="_blank">'), code, F.lit("</a>"))
    sign = lambda code: F.concat(F.lit(r"\b\Q"), code, F.lit(r"\E\b"))
    plain_ = lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    out = F.aggregate(codes, out, lambda said, code: F.regexp_replace(said, sign(code), plain_(link(code))))
    parts = F.filter(F.transform(F.split(out, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), "")
