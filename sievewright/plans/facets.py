"""Parts as articles: brand is category, type is source, size gives audiences."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.operators import facets as L
from sievewright.plans.common import table


def articles(spark, d):
    who = F.array(F.when(F.col("p_size") > 25, "groot").otherwise("klein"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"), F.col("p_brand").alias("category"), F.col("p_type").alias("source"), who.alias("audiences"), F.col("p_retailprice").alias("published"), "p_size")


def search(spark, d):
    rows = articles(spark, d)
    return L.shown(L.search(rows, category=L.valid(rows, "category", "Brand#14"), source=L.valid(rows, "source", "none such"), audience="groot"), 9).select("id", "title", "for_audience")


SEARCH_SQL = "SELECT p_partkey AS id, p_name AS title, p_size > 25 AS for_audience FROM part WHERE p_brand = 'Brand#14' ORDER BY p_size > 25 DESC, p_partkey LIMIT 9"


def facet_counts(spark, d):
    return L.counts(L.search(articles(spark, d), words=" 1", audience="klein", fields=("title", "category", "source")))


COUNTS_SQL = "SELECT count(*) AS matches, count(*) FILTER (p_size <= 25) AS for_audience, least(count(*), 9) AS visible FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), '1')"


def facet_values(spark, d):
    rows = articles(spark, d)
    return rows.select(F.lit("category").alias("facet"), F.col("category").alias("value")).union(rows.select(F.lit("source"), "source")).distinct().orderBy("facet", "value")


VALUES_SQL = "SELECT DISTINCT 'category' AS facet, p_brand AS value FROM part UNION SELECT 'source', p_type FROM part"


def related(spark, d):
    return L.related(articles(spark, d)).withColumn("place", F.col("place").cast("long"))


RELATED_SQL = """
WITH b AS (SELECT p_partkey AS other, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part)
SELECT id, other, place FROM (SELECT p_partkey AS id, other, row_number() OVER (PARTITION BY p_partkey ORDER BY r) AS place FROM part JOIN b USING (p_brand) WHERE p_partkey <> other AND r <= 4) WHERE place <= 3
"""


def details(spark, d):
    rows = articles(spark, d).select("id", "ord", F.concat(F.lit("u"), F.col("p_size").cast("string")).alias("url"), F.when(F.col("p_size") < 10, F.concat(F.lit("u"), (F.col("p_size") + 60).cast("string"))).when(F.col("p_size") < 20, F.concat(F.lit("u"), (F.col("p_size") + 1).cast("string"))).alias("superseded_by"), F.when(F.col("p_size") == 50, "historisch").alias("status"), F.col("title").alias("body"), F.col("category").alias("summary"))
    return L.details(rows).select("id", "successor", F.coalesce("outdated", F.lit(False)).alias("outdated"), "long_body")


DETAILS_SQL = """
WITH a AS (SELECT p_partkey AS id, 'u' || p_size AS url, CASE WHEN p_size < 10 THEN 'u' || (p_size + 60) WHEN p_size < 20 THEN 'u' || (p_size + 1) END AS sup, p_size, p_name, p_brand FROM part), n AS (SELECT url, min(id) AS successor FROM a GROUP BY url)
SELECT a.id, n.successor, a.sup IS NOT NULL OR p_size = 50 AS outdated, length(p_name) > 1.3 * length(p_brand) AS long_body FROM a LEFT JOIN n ON a.sup = n.url
"""

QUERIES = {"facet_search": search, "facet_counts": facet_counts, "facet_values": facet_values, "related_rows": related, "article_details": details}
SQL = {"facet_search": SEARCH_SQL, "facet_counts": COUNTS_SQL, "facet_values": VALUES_SQL, "related_rows": RELATED_SQL, "article_details": DETAILS_SQL}
