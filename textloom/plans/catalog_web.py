"""Named queries: web pages and collected payloads."""

from pyspark.sql import functions as F

from textloom.operators import web
from textloom.plans.registry import query, table
from textloom.plans.sqltext import in_list
from textloom.session import spread

TOPIC = "the reation"


def pages(spark, sf):
    return table(spark, sf, "pages")


@query("html_to_text")
def html_to_text(spark, sf):
    return spread(pages(spark, sf)).select("page_id", web.html_to_text(F.col("html")).alias("content"))


TITLE = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
for _entity, _char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")]:
    TITLE = f"replace({TITLE}, '{_entity}', '{_char}')"


@query("html_title", f"SELECT page_id, {TITLE} AS title FROM pages")
def html_title(spark, sf):
    return pages(spark, sf).select("page_id", web.html_title(F.col("html")).alias("title"))


@query("web_doc_id", f"SELECT page_id, md5(url || '_' || '{TOPIC}') AS id FROM pages")
def web_doc_id(spark, sf):
    return pages(spark, sf).select("page_id", web.web_doc_id(F.col("url"), TOPIC).alias("id"))


@query("generate_id", "SELECT doc_id, md5(text) AS id, md5(CAST(n_chars AS VARCHAR)) AS number_id FROM documents")
def generate_id(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", web.generate_id(F.col("text")).alias("id"), web.generate_id(F.col("n_chars")).alias("number_id"))


@query("validate_web_doc", "SELECT doc_id FROM documents WHERE length(text) >= 100")
def validate_web_doc(spark, sf):
    return table(spark, sf, "documents").filter(web.valid_web_doc(F.col("text"))).select("doc_id")


@query("scrape_to_documents")
def scrape_to_documents(spark, sf):
    docs = web.scrape_to_documents(spread(pages(spark, sf)), TOPIC)
    return docs.select("id", "content", F.col("metadata")["url"].alias("url"), F.col("metadata")["title"].alias("title"), "source")


LINKS = """
  h AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1) AS hrefs FROM pages),
  links AS (SELECT page_id, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS pos FROM h)"""


@query("extract_links", f"WITH {LINKS} SELECT page_id, pos, href FROM links")
def extract_links(spark, sf):
    return web.extract_links(pages(spark, sf))


@query(
    "extract_result_links",
    """SELECT page_id, 1 AS pos, 'google' AS engine, regexp_extract(url, '^[^&]*') AS url FROM pages
       UNION ALL SELECT page_id, 2, 'bing', url FROM pages
       UNION ALL SELECT page_id, 4, 'bing', url || '/more' FROM pages
       UNION ALL SELECT page_id, 6, 'duckduckgo', 'https:' || regexp_replace(url, '^https?:', '') FROM pages""",
)
def extract_result_links(spark, sf):
    """Each page's address is put into result lists as the engines mark them up, among other links."""
    escaped = F.replace("url", F.lit("&"), F.lit("&amp;"))
    html = F.concat(
        F.lit('<html><body><a href="/url?q=http://maps.google.com/x&amp;sa=U">maps</a><a href="/url?q='),
        F.regexp_extract("url", "^[^&]*", 0), F.lit('&amp;sa=U">one</a><a class="ad tilk" href="'), escaped,
        F.lit('">two</a><a class="tilk" href="/local">local</a><ul><li class="b_algo"><h2><a href="'), escaped,
        F.lit('/more">three</a></h2><p><a href="http://example.com/cached">cached</a></p></li></ul>'
              '<a rel="nofollow" class="result__a" href="'),
        F.regexp_replace(escaped, "^https?:", ""), F.lit('">four</a><a href="http://example.com">five</a></body></html>'),
    )
    return web.extract_result_links(spread(pages(spark, sf)).select("page_id", html.alias("html")))


QUOTED = "replace(url_encode(replace({}, ' ', '_')), '%2F', '/')"


@query(
    "parse_search_payload",
    f"""SELECT page_id, 'wikipedia' AS engine, '{web.WIKIPEDIA_PAGE}' || {QUOTED.format(TITLE)} AS url FROM pages
        UNION ALL SELECT page_id, 'wikipedia', '{web.WIKIPEDIA_PAGE}' || {QUOTED.format('url')} FROM pages
        UNION ALL SELECT page_id, 'pubmed', '{web.PUBMED_PAGE}' || page_id || '/' FROM pages
        UNION ALL SELECT page_id, 'custom', url FROM pages""",
)
def parse_search_payload(spark, sf):
    """Replies in the three engines' shapes are built from the pages, then parsed."""
    title = web.html_title(F.col("html"))
    hits = F.array(F.struct(title.alias("title")), F.struct(F.col("url").alias("title")))
    wikipedia = F.to_json(F.struct(F.struct(hits.alias("search")).alias("query")))
    pubmed = F.to_json(F.struct(F.struct(F.array(F.col("page_id").cast("string")).alias("idlist")).alias("esearchresult")))
    custom = F.to_json(F.struct(F.array(F.struct(F.col("url").alias("link"))).alias("items")))
    replies = pages(spark, sf).select("page_id", F.explode(F.array(wikipedia, pubmed, custom)).alias("payload"))
    return web.parse_search_payload(replies, "payload").select("page_id", "engine", "url")


@query("parse_atom_ids", "SELECT page_id, url AS id FROM pages UNION ALL SELECT page_id, url || '/v2' FROM pages")
def parse_atom_ids(spark, sf):
    escaped = F.replace("url", F.lit("&"), F.lit("&amp;"))
    feed = F.concat(
        F.lit("<feed><id>feed</id><entry><id>"), escaped, F.lit("</id><title>a</title></entry><entry><id>"), escaped,
        F.lit("/v2</id></entry></feed>"),
    )
    return pages(spark, sf).select("page_id", F.explode(web.parse_atom_ids(feed)).alias("id"))


@query(
    "related_terms",
    """SELECT p_partkey, p_name AS term FROM part UNION ALL SELECT p_partkey, p_brand FROM part
       UNION ALL SELECT p_partkey, p_type FROM part UNION ALL SELECT p_partkey, CAST(p_size AS VARCHAR) FROM part
       UNION ALL SELECT p_partkey, p_name || ' ' || p_brand FROM part""",
)
def related_terms(spark, sf):
    suggestions = F.array(
        "p_name", "p_brand", "p_type", F.col("p_size").cast("string"), F.concat_ws(" ", "p_name", "p_brand"), F.lit("sixth")
    )
    reply = F.concat(F.lit('["'), "p_name", F.lit('", '), F.to_json(suggestions), F.lit("]"))
    terms = web.related_terms(F.col("p_name"), reply)
    return table(spark, sf, "part").select("p_partkey", F.explode(terms).alias("term"))


@query(
    "fallback_urls",
    f"""SELECT p_partkey, 0 AS pos, '{web.WIKIPEDIA_PAGE}' || replace(p_name, ' ', '_') AS url FROM part
        UNION ALL SELECT p_partkey, 1, 'https://www.britannica.com/topic/' || replace(p_name, ' ', '-') FROM part
        UNION ALL SELECT p_partkey, 2, 'https://arxiv.org/search/?query=' || url_encode(p_name) || '&searchtype=all' FROM part
        UNION ALL SELECT p_partkey, 3, 'https://scholar.google.com/scholar?q=' || url_encode(p_name) FROM part""",
)
def fallback_urls(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.posexplode(web.fallback_urls(F.col("p_name"))).alias("pos", "url"))


ENGINE_LISTS = r"""
  lists AS (SELECT 0 AS engine, page_id * 1000 AS pos, url FROM pages
            UNION ALL SELECT 1, page_id * 1000, regexp_replace(url, '[?#].*$', '') FROM pages
            UNION ALL SELECT 2, page_id * 1000 + pos, href FROM links)"""


def engine_lists(spark, sf):
    """(engine, pos, url): page addresses, bare addresses, and links, as three engines' lists."""
    p = pages(spark, sf)
    pos = F.col("page_id") * 1000
    own = p.select(F.lit(0).alias("engine"), pos.alias("pos"), "url")
    bare = p.select(F.lit(1).alias("engine"), pos.alias("pos"), F.regexp_replace("url", "[?#].*$", "").alias("url"))
    links = web.extract_links(p).select(F.lit(2).alias("engine"), (pos + F.col("pos")).alias("pos"), F.col("href").alias("url"))
    return own.unionByName(bare).unionByName(links)


@query(
    "union_engines",
    f"""WITH {LINKS}, {ENGINE_LISTS}
        SELECT url, engine, pos FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY engine, pos) AS rn FROM lists) WHERE rn = 1""",
)
def union_engines(spark, sf):
    return web.union_engines(engine_lists(spark, sf))


@query(
    "distinct_urls_limit",
    f"WITH {LINKS}, {ENGINE_LISTS} SELECT url, min(pos) AS pos FROM lists GROUP BY url ORDER BY pos, url LIMIT 50",
)
def distinct_urls_limit(spark, sf):
    return web.distinct_urls_limit(engine_lists(spark, sf), 50)


CANDIDATES = f"""{LINKS}, {ENGINE_LISTS},
  c AS (SELECT DISTINCT url FROM lists
        UNION ALL SELECT DISTINCT 'https://www.my' || list_extract([{in_list(web.BLOCKED_DOMAINS)}], CAST(engine + pos % 10 + 1 AS BIGINT)) || '/' || md5(url) FROM lists
        UNION ALL SELECT DISTINCT url || list_extract([{in_list(web.BLOCKED_EXTENSIONS)}], CAST(engine + 1 AS BIGINT)) FROM lists)"""


def candidate_urls(spark, sf):
    """Every collected address, plus variants on blocked hosts and with blocked file types."""
    lists = engine_lists(spark, sf)
    domain = F.element_at(F.array(*map(F.lit, web.BLOCKED_DOMAINS)), (F.col("engine") + F.col("pos") % 10 + 1).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, web.BLOCKED_EXTENSIONS)), F.col("engine") + 1)
    blocked = lists.select(F.concat(F.lit("https://www.my"), domain, F.lit("/"), F.md5("url")).alias("url")).distinct()
    files = lists.select(F.concat("url", ending).alias("url")).distinct()
    return lists.select("url").distinct().unionByName(blocked).unionByName(files)


@query(
    "filter_urls",
    rf"""WITH {CANDIDATES} SELECT url FROM c WHERE starts_with(url, 'http')
         AND NOT regexp_matches(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '{"|".join(d.replace(".", "[.]") for d in web.BLOCKED_DOMAINS)}')
         AND NOT regexp_matches(lower(url), '({"|".join(e.replace(".", "[.]") for e in web.BLOCKED_EXTENSIONS)})$')""",
)
def filter_urls(spark, sf):
    return candidate_urls(spark, sf).filter(web.allowed_url(F.col("url")))


@query(
    "url_topic_relevance",
    f"""WITH {LINKS}, {ENGINE_LISTS}, u AS (SELECT url, min(pos) AS pos FROM lists GROUP BY url)
        SELECT url, pos, contains(lower(url), '{TOPIC}') OR {" OR ".join(f"contains(lower(url), '{w}')" for w in TOPIC.split())} AS relevant
        FROM u ORDER BY relevant DESC, pos, url""",
)
def url_topic_relevance(spark, sf):
    urls = engine_lists(spark, sf).groupBy("url").agg(F.min("pos").alias("pos"))
    return urls.withColumn("relevant", web.url_relevance(F.col("url"), TOPIC)).orderBy(F.desc("relevant"), "pos", "url")


@query("book_text")
def book_text(spark, sf):
    return web.book_documents(spread(pages(spark, sf)))


@query(
    "book_record_to_document",
    """SELECT p_partkey, md5(p_name || '_[''' || p_brand || ''', ''' || p_type || ''']') AS id,
              'Title: ' || p_name || chr(10) || 'Author: ' || p_brand || ', ' || p_type || chr(10) || 'Subject: ' || p_type || chr(10)
              || 'Description: ' || CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE 'No description available' END AS content
       FROM part""",
)
def book_record_to_document(spark, sf):
    description = F.when(F.col("p_size") > 25, F.col("p_size").cast("string"))
    key, content = web.book_record_document(
        F.col("p_name"), F.array("p_brand", "p_type"), F.array("p_type"), description
    )
    return table(spark, sf, "part").select("p_partkey", key.alias("id"), content.alias("content"))


@query("validate_book", "SELECT doc_id FROM documents WHERE length(text) >= 200 AND length(text) - length(replace(text, chr(10), '')) >= 3")
def validate_book(spark, sf):
    return table(spark, sf, "documents").filter(web.valid_book(F.col("text"))).select("doc_id")


@query(
    "validate_topic",
    r"""SELECT p_partkey, length(topic) >= 2 AND regexp_full_match(topic, '[a-zA-Z0-9\s\-_]+') AS valid
        FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name ELSE p_brand END AS topic FROM part)""",
)
def validate_topic(spark, sf):
    topic = F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", web.valid_topic(topic).alias("valid"))
