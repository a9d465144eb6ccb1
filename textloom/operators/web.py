"""Pages, links and collected payloads as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import html as hp
from textloom.functions.batches import stretches
from textloom.functions.text import quote_url, unescape_entities

# Hosts and file types that are never collected.
BLOCKED_DOMAINS = [
    "facebook.com", "twitter.com", "instagram.com", "reddit.com",
    "pinterest.com", "tumblr.com", "linkedin.com", "youtube.com",
    "amazon.com", "ebay.com", "aliexpress.com", "walmart.com",
]
BLOCKED_EXTENSIONS = [".pdf", ".jpg", ".png", ".gif", ".mp4", ".zip", ".exe"]

# Addresses built from collected identifiers.
WIKIPEDIA_PAGE = "https://en.wikipedia.org/wiki/"
PUBMED_PAGE = "https://pubmed.ncbi.nlm.nih.gov/"


def _text_of(html: Column, reader) -> Column:
    @F.arrow_udf("string")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            for start, n in stretches(pages):
                yield pa.array([None if p is None else reader(p) for p in pages.slice(start, n).to_pylist()], pa.string())

    return read(html)


def html_to_text(html: Column) -> Column:
    return _text_of(html, hp.visible_text)


def book_text(html: Column) -> Column:
    """Body of a book page, cut to the collection limit of 10 000 characters."""
    return F.substring(_text_of(html, hp.book_body), 1, 10_000)


def html_title(html: Column) -> Column:
    return unescape_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def web_doc_id(url: Column, topic: str) -> Column:
    return F.md5(F.concat_ws("_", url, F.lit(topic)))


def generate_id(value: Column) -> Column:
    return F.md5(value.cast("string"))


def valid_web_doc(content: Column) -> Column:
    return F.length(content) >= 100


def valid_book(content: Column) -> Column:
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return (F.length(content) >= 200) & (breaks >= 3)


def valid_topic(topic: Column) -> Column:
    return F.coalesce((F.length(topic) >= 2) & topic.rlike(r"(?U)\A[a-zA-Z0-9\s\-_]+\z"), F.lit(False))


def scrape_to_documents(pages: DataFrame, topic: str) -> DataFrame:
    """Pages (url, html) as validated document rows."""
    metadata = F.create_map(
        F.lit("url"), F.col("url"), F.lit("topic"), F.lit(topic), F.lit("title"), html_title(F.col("html"))
    )
    docs = pages.select(
        web_doc_id(F.col("url"), topic).alias("id"),
        html_to_text(F.col("html")).alias("content"),
        metadata.alias("metadata"),
        F.lit("web").alias("source"),
    )
    return docs.filter(valid_web_doc(F.col("content")))


def book_documents(pages: DataFrame) -> DataFrame:
    return pages.select(F.md5("url").alias("id"), book_text(F.col("html")).alias("content"), F.lit("book").alias("source"))


def book_record_document(title: Column, authors: Column, subjects: Column, description: Column) -> tuple[Column, Column]:
    """(id, content) of a catalogue record. The id hashes the title and the quoted author list."""
    content = F.concat(
        F.lit("Title: "), title, F.lit("\nAuthor: "), F.array_join(authors, ", "), F.lit("\nSubject: "),
        F.array_join(subjects, ", "), F.lit("\nDescription: "),
        F.coalesce(description, F.lit("No description available")),
    )
    quoted = F.array_join(F.transform(authors, lambda a: F.concat(F.lit("'"), a, F.lit("'"))), ", ")
    return F.md5(F.concat(title, F.lit("_["), quoted, F.lit("]"))), content


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href) of every anchor with a target, in order; entities are decoded."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(page_id, pos, href) for page_id, html in zip(pdf["page_id"], pdf["html"]) for pos, href in enumerate(hp.hrefs(html or ""))]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "href"])

    return pages.select("page_id", "html").mapInPandas(read, "page_id bigint, pos int, href string")


def anchor_rows(pages: DataFrame) -> DataFrame:
    """(page_id, pos, class, href, in_result) of every anchor."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (page_id, pos, *anchor)
                for page_id, html in zip(pdf["page_id"], pdf["html"])
                for pos, anchor in enumerate(hp.anchors(html or ""))
            ]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "class", "href", "in_result"])

    return pages.select("page_id", "html").mapInPandas(
        read, "page_id bigint, pos int, class string, href string, in_result boolean"
    )


def extract_result_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, engine, url): result links by the marks of each engine's page."""
    href = F.col("href")
    classes = F.split("class", r"\s+")
    unwrapped = F.regexp_extract(href, r"^/url\?q=([^&]*)", 1)
    google = F.when(unwrapped.startswith("http") & ~F.contains(unwrapped, F.lit("google.com")), unwrapped)
    ad = F.when(F.array_contains(classes, "tilk") & href.startswith("http"), href)
    heading = F.when(F.col("in_result") & href.startswith("http"), href)
    absolute = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href)
    duck = F.when(F.array_contains(classes, "result__a") & absolute.startswith("http"), absolute)
    found = F.array(
        F.struct(F.lit("google").alias("engine"), google.alias("url")),
        F.struct(F.lit("bing").alias("engine"), F.coalesce(ad, heading).alias("url")),
        F.struct(F.lit("duckduckgo").alias("engine"), duck.alias("url")),
    )
    return anchor_rows(pages).select("page_id", "pos", F.inline(found)).filter("url IS NOT NULL")


def parse_search_payload(payloads: DataFrame, payload: str) -> DataFrame:
    """Adds ``engine`` and ``url`` rows from Wikipedia, PubMed and custom-search replies."""
    reply = F.from_json(
        payload,
        "query struct<search: array<struct<title: string>>>, esearchresult struct<idlist: array<string>>, "
        "items array<struct<link: string>>",
    )
    rows = payloads.withColumn("_r", reply)

    def urls(engine: str, values: Column, make) -> Column:
        item = F.transform(values, lambda v: F.struct(F.lit(engine).alias("engine"), make(v).alias("url")))
        return F.coalesce(item, F.array().cast("array<struct<engine: string, url: string>>"))

    everything = F.concat(
        urls("wikipedia", F.col("_r.query.search.title"),
             lambda t: F.concat(F.lit(WIKIPEDIA_PAGE), quote_url(F.replace(t, F.lit(" "), F.lit("_"))))),
        urls("pubmed", F.col("_r.esearchresult.idlist"), lambda i: F.concat(F.lit(PUBMED_PAGE), i, F.lit("/"))),
        urls("custom", F.col("_r.items.link"), lambda link: link),
    )
    return rows.select(*payloads.columns, F.inline(everything))


def parse_atom_ids(feed: Column) -> Column:
    """Ids of the entries of an Atom feed."""
    return F.xpath(feed, F.lit("feed/entry/id/text()"))


def related_terms(topic: Column, payload: Column) -> Column:
    """The topic and the second to fifth suggestion of an opensearch reply."""
    suggestions = F.from_json(F.get_json_object(payload, "$[1]"), "array<string>")
    empty = F.array().cast("array<string>")
    return F.concat(F.array(topic), F.coalesce(F.slice(suggestions, 2, 4), empty))


def fallback_urls(topic: Column) -> Column:
    """Four addresses to try when no engine answers, in order."""
    underscored = F.replace(topic, F.lit(" "), F.lit("_"))
    dashed = F.replace(topic, F.lit(" "), F.lit("-"))
    quoted = quote_url(topic)
    return F.array(
        F.concat(F.lit(WIKIPEDIA_PAGE), underscored),
        F.concat(F.lit("https://www.britannica.com/topic/"), dashed),
        F.concat(F.lit("https://arxiv.org/search/?query="), quoted, F.lit("&searchtype=all")),
        F.concat(F.lit("https://scholar.google.com/scholar?q="), quoted),
    )


def union_engines(lists: DataFrame) -> DataFrame:
    """(url, engine, pos): first occurrence of every url over all engines' lists.

    ``lists`` has (engine, pos, url); a minimum per url is combined before the shuffle.
    """
    first = lists.groupBy("url").agg(F.min(F.struct("engine", "pos")).alias("first"))
    return first.select("url", F.col("first.engine").alias("engine"), F.col("first.pos").alias("pos"))


def distinct_urls_limit(urls: DataFrame, n: int) -> DataFrame:
    """First ``n`` distinct urls by their first position."""
    return urls.groupBy("url").agg(F.min("pos").alias("pos")).orderBy("pos", "url").limit(n)


def allowed_url(url: Column) -> Column:
    """http(s) address whose host has no blocked domain in it and whose end is no blocked file type."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    blocked = host.rlike("|".join(d.replace(".", r"\.") for d in BLOCKED_DOMAINS))
    file_type = F.lower(url).rlike("(" + "|".join(e.replace(".", r"\.") for e in BLOCKED_EXTENSIONS) + r")\z")
    return F.coalesce(url.startswith("http") & ~F.coalesce(blocked, F.lit(False)) & ~file_type, F.lit(False))


def url_relevance(url: Column, topic: str) -> Column:
    """True when the topic or one of its words occurs in the url."""
    low = F.lower(url)
    hit = F.contains(low, F.lit(topic.lower()))
    for word in topic.lower().split():
        hit = hit | F.contains(low, F.lit(word))
    return hit
