"""Scans over files' contents that Spark writes from the tables: each source's documents as feeds and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import text as X
from sievewright.plans import common as C
from sievewright.plans.common import table
from sievewright.sources import feeds as S


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", F.regexp_replace(C.title(F.col("text")), "[<>&\\n]", "").alias("t"))


def feed_items(spark, d):
    """A feed per document, RSS or Atom by language, and the item read back from it."""
    rss = F.concat(F.lit('<rss version="2.0"><channel><title>c</title><item><title>'), "t", F.lit("</title><link>https://x.example/"), "doc_id", F.lit("</link><content:encoded>"), "source", F.lit("</content:encoded><pubDate>Mon, 06 Oct 2025 08:00:00 GMT</pubDate></item></channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>'), "t", F.lit('</title><link rel="self" href="https://x.example/self"/><link href="https://x.example/'), "doc_id", F.lit('"/><summary>'), "source", F.lit("</summary><updated>2025-10-06T08:00:00Z</updated></entry></feed>"))
    rows = _docs(spark, d).select("doc_id", F.when(F.length("t") % 2 == 0, rss).otherwise(atom).alias("xml"))
    return S.feed_items(rows).select("doc_id", "title", "link", "description", "pub_date")


_T = f"regexp_replace({C.sql_title('text')}, '[<>&\\n]', '', 'g')"
FEED_SQL = f"""
SELECT doc_id, nullif(trim({_T}), '') AS title, 'https://x.example/' || doc_id AS link, source AS description, CASE WHEN length({_T}) % 2 = 0 THEN 'Mon, 06 Oct 2025 08:00:00 GMT' ELSE '2025-10-06T08:00:00Z' END AS pub_date FROM documents
"""


def sitemap_items(spark, d):
    """Pages as news sitemaps, one per page; rows without a title go."""
    page = F.concat(F.lit("<urlset><url><loc>"), F.regexp_replace("url", "&", "&amp;"), F.lit("</loc><lastmod>2025-01-0"), (F.length("url") % 9 + 1).cast("string"), F.lit("</lastmod><news:news><news:title>"), F.when(F.length("url") % 5 == 0, "").otherwise("titel"), F.lit("</news:title></news:news></url></urlset>"))
    rows = S.news_items(table(spark, d, "pages").select("page_id", page.alias("xml")))
    return rows.select("page_id", "loc", "title", "pub_date")


MAP_SQL = "SELECT page_id, url AS loc, 'titel' AS title, '2025-01-0' || (length(url) % 9 + 1) AS pub_date FROM pages WHERE length(url) % 5 <> 0"


def search_items(spark, d):
    """Orders as search answers of their customer."""
    body = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("/o/"), F.col("o_orderkey").cast("string")).alias("raw")).alias("url"), F.struct(F.col("o_orderpriority").alias("raw")).alias("sort_date"))).alias("rawResults")).alias("rawResponse")))
    return S.search_results(table(spark, d, "orders").select("o_orderkey", body.alias("body")), "https://www.example.org").select("o_orderkey", "loc", "lastmod")


SEARCH_SQL = "SELECT o_orderkey, 'https://www.example.org/o/' || o_orderkey AS loc, o_orderpriority AS lastmod FROM orders"


def front_matter(spark, d):
    text = F.concat(F.lit('---\ntitle: "'), F.regexp_replace("t", '"', '\\\\"'), F.lit('"\ncategory: "'), "source", F.lit('"\n---\n'))
    rows = _docs(spark, d).select("doc_id", text.alias("value"))
    f = S.article_fields(F.col("value"))
    return rows.select("doc_id", *[c.alias(n) for n, c in f.items()]).where("title IS NOT NULL")


FRONT_SQL = f"SELECT doc_id, nullif({_T}, '') AS title, source AS category, NULL::VARCHAR AS source_url FROM documents WHERE {_T} <> ''"


def _proposals(spark, d):
    return table(spark, d, "customer").select(F.concat(F.lit("auto/"), "c_mktsegment").alias("headRefName"), F.when(F.col("c_acctbal") > 5000, "x").alias("mergedAt"), F.when(F.col("c_nationkey") > 12, "OPEN").alias("state"), F.concat(F.lit("<!-- bron: https://a.example/"), "c_custkey", F.lit(" --> en <!-- bron: https://b.example/"), "c_custkey", F.lit(" -->")).alias("body"))


def proposals(spark, d):
    """Customers as proposals whose bodies mark two URLs; those unmerged."""
    return S.proposal_urls(_proposals(spark, d), "auto/B", "bron")


PROPOSAL_SQL = "SELECT unnest(['https://a.example/' || c_custkey, 'https://b.example/' || c_custkey]) AS url FROM customer WHERE c_mktsegment LIKE 'B%' AND NOT coalesce(c_acctbal > 5000, false)"


def taken_urls(spark, d):
    """URLs that are taken: of articles that show, and of open proposals."""
    shown = S.visible(table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 4 > 0, F.col("c_nationkey") % 4 == 1).alias("hidden"))).select(F.concat(F.lit("https://c.example/"), "c_custkey").alias("url"))
    return S.union_all(shown, S.proposal_urls(_proposals(spark, d), "auto/B", "bron", open_only=True)).distinct()


TAKEN_SQL = """
SELECT 'https://c.example/' || c_custkey AS url FROM customer WHERE c_nationkey % 4 <> 1
UNION SELECT unnest(['https://a.example/' || c_custkey, 'https://b.example/' || c_custkey]) FROM customer WHERE c_mktsegment LIKE 'B%'
"""


def paged_items(spark, d):
    """Documents joined to landed pages by URL key, without losing those that have none."""
    pages = table(spark, d, "pages").groupBy(X.url_key(F.col("url")).alias("url_key")).agg(F.min("page_id").alias("page_id"))
    items = table(spark, d, "pages").select(F.col("page_id").alias("item"), X.url_key(F.when(F.length("html") % 3 == 0, F.concat("url", F.lit("/x"))).otherwise(F.col("url"))).alias("url_key"))
    return S.with_pages(items, pages, required=False).select("item", "page_id")


def _paged_sql() -> str:
    from sievewright.plans.text import URL_KEY_SQL, URL_PARTS_SQL

    keyed = lambda src: f"SELECT page_id, {URL_KEY_SQL} AS url_key FROM ({src})"
    other = URL_PARTS_SQL.replace("FROM pages", "FROM (SELECT page_id, html, CASE WHEN length(html) % 3 = 0 THEN url || '/x' ELSE url END AS url FROM pages)")
    return f"WITH p AS (SELECT url_key, min(page_id) AS page_id FROM ({keyed(URL_PARTS_SQL)}) GROUP BY url_key), i AS ({keyed(other)}) SELECT i.page_id AS item, p.page_id FROM i LEFT JOIN p USING (url_key)"


QUERIES = {"scan_feed_items": feed_items, "scan_sitemap_items": sitemap_items, "scan_search_items": search_items, "scan_front_matter": front_matter, "scan_proposals": proposals, "scan_paged_items": paged_items, "scan_taken_urls": taken_urls}
SQL = {"scan_feed_items": FEED_SQL, "scan_sitemap_items": MAP_SQL, "scan_search_items": SEARCH_SQL, "scan_front_matter": FRONT_SQL, "scan_proposals": PROPOSAL_SQL, "scan_paged_items": _paged_sql(), "scan_taken_urls": TAKEN_SQL}
