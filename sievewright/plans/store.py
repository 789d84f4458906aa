"""The record store over pages, documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import text as X
from sievewright.operators import store as S
from sievewright.plans import common as C
from sievewright.plans.common import table
from sievewright.plans.text import URL_KEY_SQL, URL_PARTS_SQL
from sievewright.sources import pages as P


def _pages(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url", X.url_key(F.col("url")).alias("url_key"), P.page_title(F.col("html")).alias("title"))
    plain = F.col("url").startswith("http://")
    return rows.where(plain), rows.where(~plain)


def new_pages(spark, d):
    """Secure pages whose key no plain page has."""
    known, rows = _pages(spark, d)
    return S.new_rows(rows, S.known_urls(known)).select("page_id", "url_key")


_P = f"p AS (SELECT page_id, url, {URL_KEY_SQL} AS url_key, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&quot;', '\"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g')), '') AS title FROM ({URL_PARTS_SQL}))"
NEW_SQL = f"WITH {_P} SELECT page_id, url_key FROM p WHERE url NOT LIKE 'http://%' AND url_key NOT IN (SELECT url_key FROM p WHERE url LIKE 'http://%')"


def upserted(spark, d):
    """The store of plain pages after secure pages of the same key replaced theirs."""
    old, new = (S.first_per_key(x, "url_key", "page_id") for x in _pages(spark, d))
    out = S.upsert(old.select("url_key", F.col("page_id").alias("id"), "url", "title"), new.select("url_key", F.col("page_id").alias("id"), "url", "title"))
    return out.select("url_key", "id", "url", "title", "change")


UPSERT_SQL = f"""
WITH {_P}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS r FROM p WHERE url LIKE 'http://%') WHERE r = 1),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS r FROM p WHERE url NOT LIKE 'http://%') WHERE r = 1)
SELECT coalesce(o.url_key, n.url_key) AS url_key, coalesce(o.page_id, n.page_id) AS id, coalesce(n.url, o.url) AS url, CASE WHEN n.url_key IS NULL THEN o.title ELSE n.title END AS title,
       CASE WHEN n.url_key IS NULL THEN 'kept' WHEN o.url_key IS NULL THEN 'added' ELSE 'replaced' END AS change
FROM o FULL JOIN n ON o.url_key = n.url_key
"""


def _records(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", F.lit("kandidaat").alias("status"), F.lit(None).cast("string").alias("reason"))


def patched(spark, d):
    """Every document's status after the labels' outcome was patched in."""
    run = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 0, "failed").otherwise("created").alias("outcome"), F.lit("giftig").alias("reason"))
    return S.patch(_records(spark, d), S.status_changes(run).withColumnRenamed("id", "doc_id"), "doc_id", ("status", "reason"))


PATCH_SQL = """
SELECT doc_id, source, CASE WHEN toxic = 1 THEN 'afgewezen' WHEN quality = 0 OR quality IS NULL THEN 'kandidaat' ELSE 'verwerkt' END AS status, CASE WHEN toxic = 1 THEN 'giftig' END AS reason
FROM documents LEFT JOIN labels USING (doc_id)
"""


def record_ids(spark, d):
    """Ids from a date and the first two words; labelled documents hold theirs already."""
    rows = table(spark, d, "documents").select("doc_id", S.record_base(C.title(F.col("text"), 2), F.lit("2024-05-01").cast("date")).alias("base"))
    held = rows.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select(F.col("base").alias("id")).distinct()
    return S.unique_ids(rows.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti"), "base", "doc_id", held).select("doc_id", "id")


IDS_SQL = f"""
WITH b AS (SELECT doc_id, '2024-05-01-' || CASE WHEN s = '' THEN 'bron' ELSE s END AS base, doc_id IN (SELECT doc_id FROM labels) AS held
           FROM (SELECT doc_id, regexp_replace(regexp_replace({C.sql_fold(C.sql_title('text', 2))}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[:80] AS s FROM documents)),
n AS (SELECT doc_id, base, row_number() OVER (PARTITION BY base ORDER BY doc_id) + CASE WHEN base IN (SELECT base FROM b WHERE held) THEN 1 ELSE 0 END AS k FROM b WHERE NOT held)
SELECT doc_id, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS id FROM n
"""


def source_result(spark, d):
    """The run's result as one JSON row."""
    docs = table(spark, d, "documents").select("source", F.lit(1).alias("fetched"), (F.length("text") >= 400).cast("int").alias("relevant"), (F.length("text") >= 1000).cast("int").alias("recorded"), (F.length("text") < 10).alias("failed"))
    return S.run_result(docs)


RESULT_SQL = """
WITH p AS (SELECT source, count(*)::BIGINT AS fetched, count(*) FILTER (length(text) >= 400)::BIGINT AS relevant, count(*) FILTER (length(text) >= 1000)::BIGINT AS recorded, bool_or(length(text) < 10) AS failed FROM documents GROUP BY source)
SELECT to_json({'fetched': sum(fetched)::BIGINT, 'relevant': sum(relevant)::BIGINT, 'recorded': sum(recorded)::BIGINT, 'sources': list({'source': source, 'fetched': fetched, 'relevant': relevant, 'recorded': recorded} ORDER BY source),
  'failed': coalesce(list(source ORDER BY source) FILTER (failed), [])})::VARCHAR AS result FROM p
"""


def excluded_ids(spark, d):
    """Documents with an article, and those whose source has an open proposal."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("url_key"))
    created = table(spark, d, "labels").where("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("id"))
    return S.exclusions(created, docs, table(spark, d, "documents").where("lang = 'es' AND length(text) > 8000").select(F.col("source").alias("url_key")))


EXCLUDED_SQL = """
SELECT doc_id AS id FROM labels WHERE quality = 1 AND toxic = 0
UNION SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents WHERE lang = 'es' AND length(text) > 8000)
"""


def linked(spark, d):
    """Documents and the part that names them, by slug or else by key."""
    docs = table(spark, d, "documents").select("doc_id", X.slug(C.title(F.col("text"), 1)).alias("article_slug"), F.col("source").alias("url_key"))
    articles = table(spark, d, "documents").select(X.slug(C.title(F.col("text"), 1)).alias("slug"), F.col("lang").alias("url_key")).groupBy("slug").agg(F.min("url_key").alias("url_key")).where("slug < 'e'")
    articles = articles.union(table(spark, d, "documents").groupBy("source").agg(F.min(F.concat(F.lit("~"), "source")).alias("slug")).select("slug", F.col("source").alias("url_key")).where("url_key < 'src3'"))
    return S.link(docs, articles).select("doc_id", "article")


_SLUG1 = f"regexp_replace(regexp_replace({C.sql_fold(C.sql_title('text', 1))}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[:80]"
LINK_SQL = f"""
WITH t AS (SELECT doc_id, source, {_SLUG1} AS s FROM documents)
SELECT doc_id, CASE WHEN s < 'e' THEN s WHEN source < 'src3' THEN '~' || source END AS article FROM t
"""

QUERIES = {"store_new_pages": new_pages, "store_upsert": upserted, "store_patch": patched, "store_record_ids": record_ids, "store_run_result": source_result, "store_exclusions": excluded_ids, "store_links": linked}
SQL = {"store_new_pages": NEW_SQL, "store_upsert": UPSERT_SQL, "store_patch": PATCH_SQL, "store_record_ids": IDS_SQL, "store_run_result": RESULT_SQL, "store_exclusions": EXCLUDED_SQL, "store_links": LINK_SQL}
