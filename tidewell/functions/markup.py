"""HTML read by a tokenising parser, in Arrow batches: text by blocks, and absolute links."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import sliced, small_batches

#: Pages that a task reads and answers at once.
PAGES = 50
# Lines that a block is set apart by (2: a blank line between), elements without text, and what ends an open one.
APART = {**dict.fromkeys(("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "pre", "blockquote", "table", "dl", "hr"), 2), **dict.fromkeys(("address", "article", "aside", "body", "caption", "dd", "div", "dt", "fieldset", "figcaption", "figure", "footer", "form", "header", "html", "li", "main", "nav", "section", "tbody", "tfoot", "thead", "tr"), 1)}
SILENT = {"head", "script", "style", "template", "noscript", "title"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CELLS = {"td", "th"}


class Reader(HTMLParser):
    """Collects a page's text and the values of its anchors' href."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.apart, self.blank, self.silent, self.upper, self.kept, self.lists = 0, False, 0, 0, 0, []
        self.anchors: list[str | None] = []
        self.hrefs: list[str] = []

    def say(self, text: str) -> None:
        if not text:
            return
        if self.apart and self.out:
            self.out.append("\n" * self.apart)
        elif self.blank and self.out:
            self.out.append(" ")
        self.apart, self.blank = 0, False
        self.out.append(text)

    def part(self, lines: int) -> None:
        self.apart, self.blank = max(self.apart, lines), False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = dict(attrs)
        if tag == "a":
            self.anchors.append(named.get("href"))
            if named.get("href") is not None:
                self.hrefs.append(named["href"])
        if tag in SILENT:
            self.silent += 1
        if self.silent:
            return
        if tag in APART:
            self.part(APART[tag])
        if tag == "br":
            self.apart, self.blank = self.apart + 1, False
        elif tag == "hr":
            self.say("-" * 40)
            self.part(2)
        elif tag == "img" and (named.get("alt") or named.get("src")):
            self.say(" ".join(x for x in (named.get("alt"), f"[{named['src']}]" if named.get("src") else None) if x))
        elif tag in CELLS:
            self.blank = True
        elif tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
        elif tag == "li":
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
            self.say(f" {self.lists[-1]}. " if self.lists and self.lists[-1] is not None else " * ")
        self.upper += tag in HEADINGS
        self.kept += tag == "pre"

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
            return
        if tag == "a" and self.anchors:
            href = self.anchors.pop()
            if href and href[0] != "#" and not self.silent:
                self.blank = True
                self.say(f"[{href}]")
        if self.silent:
            return
        if tag in APART:
            self.part(APART[tag])
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        self.upper = max(0, self.upper - (tag in HEADINGS))
        self.kept = max(0, self.kept - (tag == "pre"))

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        data = data.upper() if self.upper else data
        if self.kept:
            self.say(data)
            return
        words = re.split(r"[ \t\n\f\r]+", data)
        text = " ".join(w for w in words if w)
        if words[0] == "":
            self.blank = True
        if text:
            self.say(text)
            self.blank = words[-1] == ""


def read(html: str | None) -> Reader:
    reader = Reader()
    reader.feed(html or "")
    reader.close()
    return reader


def to_text(html: str | None) -> str:
    """Lines of a page's blocks: headings in capitals, links as `text [href]`, list items marked; nothing of head, scripts and styles."""
    return "".join(read(html).out)


def base_of(url: str) -> str:
    """What a page's links are resolved against: the url without a last `index.html`, or with a slash behind it."""
    return url[: -len("index.html")] if url.endswith("index.html") else url + "/"


def absolute(base: str, href: str) -> str | None:
    """The link as an absolute URL in its usual form; null for one that can't be read."""
    href = re.sub(r"[\t\n\r]", "", href.strip("".join(map(chr, range(33)))))
    try:
        if re.match(r"(?i)https?:|[^:/?#]*(?:[/?#\\]|$)", href):
            head, mark, tail = re.match(r"([^?#]*)([?#]?)(.*)", href, re.S).groups()
            href = head.replace("\\", "/") + mark + tail
        found = urlsplit(urljoin(base, href))
        if not found.scheme:
            return None
        if found.scheme not in ("http", "https"):
            return urlunsplit(found)
        host, port = found.hostname, found.port
        if not host or re.search(r"[\s<>^|%]", host):
            return None
        if ":" in host:
            host = f"[{host}]"
        elif not host.isascii():
            host = host.encode("idna").decode()
        user = f"{found.username or ''}{':' + found.password if found.password else ''}@" if found.username or found.password else ""
        place = user + host + (f":{port}" if port and port != {"http": 80, "https": 443}[found.scheme] else "")
        path = quote(found.path or "/", safe="/%:@!$&'()*+,;=~-._[]|\\^")
        out = f"{found.scheme}://{place}{path}"
        out += "?" + quote(found.query, safe="/%:@!$&()*+,;=~-._?[]{}|\\^`") if found.query or re.search(r"^[^#]*\?", href) else ""
        return out + ("#" + quote(found.fragment, safe="/%:@!$&'()*+,;=~-._?[]{}|\\^#") if found.fragment or "#" in href else "")
    except (ValueError, UnicodeError):
        return None


def _texts(pages: DataFrame, key: str, url: str, html: str) -> tuple[DataFrame, str]:
    small_batches(pages.sparkSession)
    return pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")), dict(pages.dtypes)[key]


def _links(where: str | None, page: Reader) -> list[str]:
    return [u for h in page.hrefs if (u := absolute(base_of(where), h)) is not None] if where is not None else []


def pages_read(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, text and links (absolute, in order, repeats kept) of every page. A null page has neither text nor links, and a null url no links."""
    own, kind = _texts(pages, key, url, html)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, PAGES):
            texts, links = [], []
            for where, page in zip(part.column("url"), part.column("html"), strict=True):
                found = read(page.as_py())
                texts.append("".join(found.out))
                links.append(_links(where.as_py(), found))
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(texts, pa.string()), pa.array(links, pa.list_(pa.string()))], names=[key, "text", "links"])

    return own.mapInArrow(work, f"`{key}` {kind}, text string, links array<string>")


def links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, position (from 0) and link: a row for each link."""
    own, kind = _texts(pages, key, url, html)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, PAGES):
            found = [_links(where.as_py(), read(page.as_py())) for where, page in zip(part.column("url"), part.column("html"), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found, pa.list_(pa.string()))], names=[key, "links"])

    return own.mapInArrow(work, f"`{key}` {kind}, links array<string>").select(key, F.posexplode("links").alias("position", "link"))
