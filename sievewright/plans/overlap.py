"""Overlapping and yearly titles among documents: unlabelled ones against labelled ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.operators import overlap as O
from sievewright.plans import common as C
from sievewright.plans.common import table


def sides(spark, d, dated: bool = False):
    text = C.title(F.col("text"))
    if dated:
        text = F.concat(text, F.lit(" "), (2020 + F.length("text") % 5).cast("string"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), text.alias("title"), F.when(F.col("source") != "src1", F.col("source")).alias("category"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return docs.join(labels, "id", "left_anti"), docs.join(labels, "id", "left_semi")


def title_overlap(spark, d):
    return O.best_overlap(*sides(spark, d))


def yearly_titles(spark, d):
    return O.newer_year(*sides(spark, d, dated=True)).withColumn("year", F.col("year").cast("long")).withColumn("source_year", F.col("source_year").cast("long"))


_T = f"t AS (SELECT doc_id AS id, {C.sql_title('text')} AS title, length(text) AS n, CASE WHEN source <> 'src1' THEN source END AS category, doc_id IN (SELECT doc_id FROM labels) AS lab FROM documents)"
OVERLAP_SQL = f"""
WITH {_T}, w AS (SELECT *, list_sort(list_distinct({C.sql_significant('title')})) AS ws FROM t),
p AS (SELECT a.id, b.id AS match, len(list_intersect(a.ws, b.ws)) / len(list_distinct(a.ws || b.ws)) AS score
      FROM w a JOIN w b ON NOT a.lab AND b.lab AND len(a.ws) > 0 AND len(b.ws) > 0 AND (a.category IS NULL OR b.category IS NULL OR a.category = b.category))
SELECT id, match, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, match) AS r FROM p WHERE score >= 0.4) WHERE r = 1
"""
YEARLY_SQL = f"""
WITH {_T}, w AS (SELECT id, lab, 2020 + n % 5 AS y, list_distinct(list_filter({C.sql_significant('title')}, lambda w: NOT regexp_full_match(w, '\\d+'))) AS ws FROM t),
p AS (SELECT a.id, b.id AS match, b.y AS year, a.y AS source_year FROM w a JOIN w b ON NOT a.lab AND b.lab AND b.y >= a.y AND len(a.ws) >= 2 AND len(list_intersect(a.ws, b.ws)) >= 0.75 * len(a.ws))
SELECT id, match, year::BIGINT AS year, source_year::BIGINT AS source_year FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY match) AS r FROM p) WHERE r = 1
"""

QUERIES = {"title_overlap": title_overlap, "yearly_titles": yearly_titles}
SQL = {"title_overlap": OVERLAP_SQL, "yearly_titles": YEARLY_SQL}
