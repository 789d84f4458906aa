"""Audits and run summaries over documents, labels, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import text as X
from sievewright.operators import audit as A
from sievewright.plans.common import table
from sievewright.sources import pages as P


def checks(spark, d):
    docs = table(spark, d, "documents")
    own = A.broken(docs, {"no source": F.col("source").isNull(), "percent or euro": F.col("text").rlike("[€%]"), "ellipsis": F.col("text").endswith("…") | F.col("text").endswith("..."), "length": F.length("text") != F.col("n_chars")})
    return own.unionByName(A.unmatched("labels", docs, table(spark, d, "labels"), "doc_id"))


CHECKS_SQL = """
SELECT 'no source' AS "check", count(*) FILTER (source IS NULL) AS n FROM documents
UNION ALL SELECT 'percent or euro', count(*) FILTER (regexp_matches(text, '[€%]')) FROM documents
UNION ALL SELECT 'ellipsis', count(*) FILTER (text LIKE '%…' OR text LIKE '%...') FROM documents
UNION ALL SELECT 'length', count(*) FILTER (length(text) <> n_chars) FROM documents
UNION ALL SELECT 'labels: missing', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'labels: extra', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
"""


def dead_links(spark, d):
    """Links of pages' menus to words that are no page's first title word."""
    pages = table(spark, d, "pages")
    visible = pages.select(F.lower(F.element_at(F.split(P.page_title(F.col("html")), " "), 1)).alias("slug")).distinct()
    return A.dead_links(pages.select(F.col("page_id").alias("id"), F.lower("html").alias("body")), "body", visible, 'href="/')


LINKS_SQL = """
WITH v AS (SELECT DISTINCT lower(split_part(nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1), '&nbsp;', ' '), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g')), ''), ' ', 1)) AS slug FROM pages),
l AS (SELECT DISTINCT page_id AS id, unnest(regexp_extract_all(lower(html), 'href="/([a-z0-9-]+)', 1)) AS slug FROM pages)
SELECT id, slug FROM l WHERE slug NOT IN (SELECT slug FROM v WHERE slug IS NOT NULL)
"""


def duplicates(spark, d):
    """Rows per repeated URL key, how many are duplicates, and whether the key is ambiguous."""
    rows = table(spark, d, "pages").groupBy(X.url_key(F.col("url")).alias("url_key")).agg(F.count("*").alias("n"), F.count_distinct("html").alias("texts"))
    return rows.select("url_key", "n", (F.col("n") - 1).alias("duplicates"), (F.col("texts") > 1).alias("ambiguous")).where("n > 1")


def _duplicates_sql() -> str:
    from sievewright.plans.text import URL_KEY_SQL, URL_PARTS_SQL

    return f"SELECT url_key, count(*) AS n, count(*) - 1 AS duplicates, count(DISTINCT html) > 1 AS ambiguous FROM (SELECT {URL_KEY_SQL} AS url_key, html FROM ({URL_PARTS_SQL})) GROUP BY url_key HAVING count(*) > 1"


def summary(spark, d):
    """Per source: documents fetched, relevant by length, labelled, rejected, and their characters."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.groupBy("source").agg(F.count("*").alias("fetched"), F.count_if(F.length("text") >= 400).alias("relevant"), F.count("quality").alias("recorded"), F.count_if(F.col("quality") == 0).alias("rejected"), F.sum(F.length("text")).alias("chars"), F.sum(X.token_estimate(F.col("text"))).alias("tokens"))


SUMMARY_SQL = """
SELECT source, count(*) AS fetched, count(*) FILTER (length(text) >= 400) AS relevant, count(quality) AS recorded, count(*) FILTER (quality = 0) AS rejected,
       sum(length(text))::BIGINT AS chars, sum(ceil(length(text) / 4))::BIGINT AS tokens FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
"""


def context_growth(spark, d):
    """The largest growth of a conversation's tokens by its last two turns; over 600 breaks the rule."""
    from pyspark.sql import Window

    rows = table(spark, d, "conversations").withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))).where("r <= 2")
    per = rows.groupBy("conv_id").agg(F.sum(X.token_estimate(F.col("text"))).alias("extra"))
    return per.agg(F.max("extra").alias("largest"), F.count_if(F.col("extra") > 600).alias("over"))


GROWTH_SQL = """
WITH e AS (SELECT conv_id, sum(ceil(length(text) / 4))::BIGINT AS extra FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2 GROUP BY conv_id)
SELECT max(extra) AS largest, count(*) FILTER (extra > 600) AS over FROM e
"""

QUERIES = {"audit_checks": checks, "audit_dead_links": dead_links, "audit_duplicates": duplicates, "source_summary": summary, "context_growth": context_growth}
SQL = {"audit_checks": CHECKS_SQL, "audit_dead_links": LINKS_SQL, "audit_duplicates": _duplicates_sql(), "source_summary": SUMMARY_SQL, "context_growth": GROWTH_SQL}
