"""Orders as deadlines, their priority as tax type."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.operators import calendar as K
from sievewright.plans.common import table

TODAY = "1997-05-15"


def deadlines(spark, d):
    day = F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("tax_type"), F.array("o_orderstatus", F.lit("allen")).alias("audiences"), day.alias("deadline"))


_D = "d AS (SELECT o_orderkey AS id, o_orderpriority AS tax_type, o_orderstatus AS s, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE END AS deadline FROM orders)"


def labels(spark, d):
    days = K.days_until(F.col("deadline"), F.lit(TODAY).cast("date"))
    return deadlines(spark, d).where("deadline IS NOT NULL").select("id", days.cast("long").alias("days"), K.label(days).alias("label"), K.urgency(days).alias("urgency"), (days >= 0).alias("upcoming"))


LABELS_SQL = f"""
WITH {_D}, x AS (SELECT id, deadline - DATE '{TODAY}' AS n FROM d WHERE deadline IS NOT NULL)
SELECT id, n::BIGINT AS days, CASE WHEN n = 0 THEN 'vandaag' WHEN n < 0 THEN 'verstreken' WHEN n = 1 THEN 'nog 1 dag' ELSE 'nog ' || n || ' dagen' END AS label,
       CASE WHEN n < 0 THEN 'verstreken' WHEN n <= 7 THEN 'week' WHEN n <= 30 THEN 'maand' ELSE 'later' END AS urgency, n >= 0 AS upcoming FROM x
"""


def next_per_type(spark, d):
    return K.next_deadline(K.filtered(deadlines(spark, d), audience="F"), F.lit(TODAY).cast("date"), "tax_type").withColumn("deadline", F.col("deadline").cast("string"))


NEXT_SQL = f"WITH {_D} SELECT tax_type, arg_min(id, (deadline, id)) AS id, min(deadline)::VARCHAR AS deadline FROM d WHERE s = 'F' AND deadline >= DATE '{TODAY}' GROUP BY tax_type"


def month_groups(spark, d):
    out = K.months(deadlines(spark, d))
    return out.select(F.col("month").cast("string").alias("month"), "label", "n", F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).alias("ids_md5"))


MONTHS_SQL = f"""
WITH {_D}, m AS (SELECT date_trunc('month', deadline)::DATE AS m, count(*) AS n, md5(string_agg(id::VARCHAR, ',' ORDER BY deadline NULLS LAST, id)) AS h FROM d GROUP BY ALL)
SELECT m::VARCHAR AS month, CASE WHEN m IS NOT NULL THEN ['Januari', 'Februari', 'Maart', 'April', 'Mei', 'Juni', 'Juli', 'Augustus', 'September', 'Oktober', 'November', 'December'][month(m)] || ' ' || year(m) END AS label, n, h AS ids_md5 FROM m
"""


def month_view(spark, d):
    """The month closest to one without rows, and its rows in order."""
    rows = deadlines(spark, d).where("deadline IS NOT NULL")
    pick = K.closest_month(K.months(rows), F.lit("2030-01-01").cast("date"))
    return K.ordered(rows.join(F.broadcast(pick), F.trunc("deadline", "MM") == F.col("month"))).select("id", "tax_type", F.col("deadline").cast("string").alias("deadline"))


VIEW_SQL = f"WITH {_D} SELECT id, tax_type, deadline::VARCHAR AS deadline FROM d WHERE date_trunc('month', deadline) = (SELECT max(date_trunc('month', deadline)) FROM d)"


def period_rows(spark, d):
    """Quarters in which orders fell, as deadlines."""
    rows = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).distinct()
    out = K.periods(rows, 3, "btw").unionByName(K.periods(rows, 1, "loon"))
    return out.select(F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), "tax_type", "period", F.col("deadline").cast("string").alias("deadline"))


PERIODS_SQL = """
WITH p AS (SELECT DISTINCT year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders), q AS (SELECT *, (make_date(y, m, 1) + INTERVAL 2 MONTH - INTERVAL 1 DAY)::DATE::VARCHAR AS d FROM p)
SELECT y AS year, m AS month, 'btw' AS tax_type, (m + 2) // 3 || 'e kwartaal ' || y AS period, d AS deadline FROM q WHERE m % 3 = 0
UNION ALL SELECT y, m, 'loon', ['Januari', 'Februari', 'Maart', 'April', 'Mei', 'Juni', 'Juli', 'Augustus', 'September', 'Oktober', 'November', 'December'][m] || ' ' || y, d FROM q
"""

def types(spark, d):
    """The tax types that occur, in the order a site lists them."""
    return K.types_in_order(deadlines(spark, d), ("3-MEDIUM", "9-NONE", "1-URGENT")).select("tax_type", F.col("place").cast("long").alias("place"))


TYPES_SQL = f"WITH {_D} SELECT tax_type, row_number() OVER (ORDER BY CASE tax_type WHEN '3-MEDIUM' THEN 1 WHEN '9-NONE' THEN 2 WHEN '1-URGENT' THEN 3 ELSE 4 END, tax_type) AS place FROM (SELECT DISTINCT tax_type FROM d)"


def in_month(spark, d):
    """What is due in one month, in order."""
    rows = K.ordered(K.in_month(deadlines(spark, d), F.lit("1996-02-10").cast("date")))
    return rows.select("id", "tax_type", F.col("deadline").cast("string").alias("deadline"))


IN_MONTH_SQL = f"WITH {_D} SELECT id, tax_type, deadline::VARCHAR AS deadline FROM d WHERE date_trunc('month', deadline) = DATE '1996-02-01'"

QUERIES = {"deadline_labels": labels, "deadline_next": next_per_type, "deadline_months": month_groups, "deadline_month_view": month_view, "deadline_periods": period_rows, "deadline_types": types, "deadline_in_month": in_month}
SQL = {"deadline_labels": LABELS_SQL, "deadline_next": NEXT_SQL, "deadline_months": MONTHS_SQL, "deadline_month_view": VIEW_SQL, "deadline_periods": PERIODS_SQL, "deadline_types": TYPES_SQL, "deadline_in_month": IN_MONTH_SQL}
