"""Fetched pages: visible text and same-site links.

Parsing markup is the one step here with no Column expression; it is two small parsers behind Arrow
functions. Everything after it (keys, filters, first of each page, numbering) stays in Spark, on
the page's own row, so nothing is shuffled."""

from __future__ import annotations

import sys
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vernissage import vocab
from vernissage.functions.urls import host, netloc, path, scheme, site_key, url_key

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Plain values, so that the functions below carry them to the workers.
_LINK_TEXT_CHARS = vocab.LINK_TEXT_CHARS
_INVISIBLE = ("script", "style", "noscript", "template", "svg")
_HEAD_ONLY = ("head", "title", "meta", "link", "base", "script", "style", "html", "noscript")
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Text(HTMLParser):
    """The text a reader sees, in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.open: list[str] = []
        self.hidden: list[int] = []  # how many elements were open when each began
        self.head = False

    def handle_starttag(self, tag, attrs):
        if tag == "head":
            self.head = True
        elif tag not in _HEAD_ONLY:
            self.head = False
        if tag in _INVISIBLE:
            self.hidden.append(len(self.open))
        if tag not in _VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag == "head":
            self.head = False
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            # A hidden region ends with its own element or with one around it.
            while self.hidden and self.hidden[-1] >= len(self.open):
                self.hidden.pop()

    def handle_data(self, data):
        if not self.hidden and not self.head:
            self.parts.append(data)


class _Links(HTMLParser):
    """Anchors in document order with their text and the landmark they stand in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.base: str | None = None
        self.found: list[dict] = []
        self.open: list[tuple[str, str | None]] = []
        self.anchor: dict | None = None

    @staticmethod
    def _landmark(tag: str, role: str) -> str | None:
        if tag in ("nav", "header") or role in ("navigation", "banner"):
            return "nav"
        return "footer" if tag == "footer" or role == "contentinfo" else None

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        if tag == "base" and self.base is None and "href" in given:
            self.base = given["href"]
        if tag == "img" and self.anchor is not None and not self.anchor["alt"]:
            self.anchor["alt"] = given.get("alt", "")
        if tag == "a":
            region = next((mark for _, mark in reversed(self.open) if mark), "main")
            self.anchor = {"href": given.get("href", "").strip(), "text": [], "region": region,
                           "label": given.get("aria-label", ""), "title": given.get("title", ""), "alt": ""}
            self.found.append(self.anchor)
        elif tag not in _VOID:
            self.open.append((tag, self._landmark(tag, given.get("role", "").lower())))

    def handle_endtag(self, tag):
        if tag == "a":
            self.anchor = None
        elif any(tag == name for name, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.anchor is not None:
            self.anchor["text"].append(data)


def _text(markup: str) -> str:
    parser = _Text()
    parser.feed(markup)
    parser.close()
    return " ".join("".join(parser.parts).split())


def _absolute(base: str, href: str) -> str | None:
    try:
        return urldefrag(urljoin(base, href)).url
    except ValueError:
        return None


def _anchors(markup: str, page_url: str) -> list[dict]:
    parser = _Links()
    parser.feed(markup)
    parser.close()
    base = urljoin(page_url, parser.base) if parser.base is not None else page_url
    links = []
    for a in parser.found:
        url = _absolute(base, a["href"]) if a["href"] and not a["href"].startswith("#") else None
        if url:
            words = ("".join(a["text"]), a["label"], a["title"], a["alt"])
            text = next((" ".join(w.split()) for w in words if w.strip()), "")
            links.append({"url": url, "text": text, "region": a["region"]})
    return links


@F.arrow_udf(T.StringType())
def _html_text(markup: pa.Array) -> pa.Array:
    return pa.array([None if m is None else _text(m) for m in markup.to_pylist()], pa.string())


_LINK = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("url", "text", "region")]))
_ARROW_LINK = pa.list_(pa.struct([(c, pa.string()) for c in ("url", "text", "region")]))


@F.arrow_udf(_LINK)
def _html_links(markup: pa.Array, url: pa.Array) -> pa.Array:
    return pa.array([
        [] if m is None or u is None else _anchors(m, u)
        for m, u in zip(markup.to_pylist(), url.to_pylist(), strict=True)], _ARROW_LINK)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def page_text(markup: Column, max_chars: int | None = None) -> Column:
    """All visible text, white space collapsed. The whole text, unless a cap is asked for."""
    text = _html_text(markup)
    return text if max_chars is None else F.substring(text, 1, max_chars)


def page_links(pages: DataFrame, *, exclude: str | None = None, limit: int | None = None,
               text_chars: int | None = None) -> DataFrame:
    """Pages (page_id, url, html) to (page_id, number, url, text, region): the same-site links in
    document order, one per page identity, numbered from 1; the first `limit` a page, and texts cut to
    `text_chars`, where those are given. `exclude` names an array column of URLs left out before
    numbering."""
    site = site_key(F.col("url"))
    suffixes = "(" + "|".join(s.replace(".", r"\.") for s in vocab.NON_PAGE_SUFFIXES) + ")$"
    usable = F.filter("_links", lambda x: (
        scheme(x["url"]).isin("http", "https") & (host(netloc(x["url"])) == site)
        & ~F.lower(path(x["url"])).rlike(suffixes)))
    keyed = pages.withColumn("_links", _html_links(F.col("html"), F.col("url"))).withColumn(
        "_links", usable).withColumn("_keys", F.transform("_links", lambda x: url_key(x["url"])))
    out = F.array().cast("array<string>")
    if exclude is not None:
        out = F.coalesce(F.transform(exclude, url_key), out)
    # Of each identity the first place: a sort of the page's links, not a search for each.
    placed = F.array_sort(F.transform("_keys", lambda k, i: F.struct(k.alias("key"), i.alias("at"))))
    firsts = F.filter(placed, lambda x, i: (i == 0) | (F.try_element_at(placed, i)["key"] != x["key"]))
    rows = keyed.select("page_id", "_links", out.alias("_out"), F.array_sort(F.transform(
        firsts, lambda x: F.struct(x["at"].alias("at"), x["key"].alias("key")))).alias("_first"))
    chosen = F.filter("_first", lambda x: ~F.array_contains("_out", x["key"]))
    if limit is not None:
        chosen = F.slice(chosen, 1, limit)
    named = rows.select("page_id", F.posexplode(F.transform(chosen, lambda x: F.get("_links", x["at"]))).alias("n", "link")).select(
        "page_id", (F.col("n") + 1).cast("long").alias("number"), "link.*")
    return named if text_chars is None else named.withColumn("text", F.substring("text", 1, text_chars))


def ingest_pages(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Fetched pages (page_id, url, html) to page_id, url, text, words, status, content_hash: ok from
    fifty words, thin below; only an ok page keeps its text and hash."""
    from vernissage.plans.crawl import word_count

    read = pages.select("page_id", "url", page_text(F.col("html"), max_chars).alias("text"))
    words = word_count(F.col("text"))
    ok = words >= vocab.THIN_WORDS
    return read.select(
        "page_id", "url", F.when(ok, F.col("text")).alias("text"), words.cast("long").alias("words"),
        F.when(ok, "ok").otherwise("thin").alias("status"),
        F.when(ok, F.sha2(F.col("text"), 256)).alias("content_hash"))
