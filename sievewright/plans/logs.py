"""Events as log lines and error answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.operators import logs as E
from sievewright.plans.common import table


def _messages(spark, d):
    """Each event as an error message whose status code comes from its props."""
    k = F.get_json_object("props", "$.k").cast("long")
    code = F.when(k % 4 == 0, 429).when(k % 4 == 1, 503).when(k % 4 == 2, 404).otherwise(200)
    tail = F.when(k % 3 == 0, " tokens per day (TPD)").when(k % 3 == 1, " timeout").otherwise("")
    return table(spark, d, "events").select("event_id", "event_type", k.alias("k"), code.alias("code"), F.concat(F.lit("provider API "), code.cast("string"), tail).alias("message"))


def error_counts(spark, d):
    rows = _messages(spark, d)
    return rows.groupBy("event_type", E.category(F.col("message")).alias("category"), E.retry(E.status(F.col("message"))).alias("retry")).agg(F.count("*").alias("n"))


_M = """m AS (SELECT event_id, event_type, user_id, value, k, CASE k % 4 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 404 ELSE 200 END AS code FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events))"""
COUNTS_SQL = f"""
WITH {_M}, c AS (SELECT event_type, CASE WHEN code = 429 AND k % 3 = 0 THEN 'provider_daily_limit' WHEN code = 429 THEN 'rate_limited' WHEN code = 503 THEN 'server_error' WHEN code = 404 THEN 'client_error' WHEN k % 3 = 1 THEN 'timeout' ELSE 'unknown' END AS category, code >= 500 AS retry FROM m)
SELECT event_type, category, retry, count(*) AS n FROM c GROUP BY ALL
"""


def error_lines(spark, d):
    """Each event as an error answer, described in one redacted line."""
    rows = _messages(spark, d)
    body = F.when(F.col("k") % 2 == 0, F.to_json(F.struct(F.struct(F.col("event_type").alias("type"), F.col("k").cast("string").alias("code"), F.lit("fout met Bearer abcdefgh123").alias("message")).alias("error")))).otherwise("geen json")
    return rows.select("event_id", E.described(F.col("code"), body, F.col("event_id").cast("string")).alias("line"))


LINES_SQL = f"""
WITH {_M}
SELECT event_id, 'HTTP ' || code || CASE WHEN k % 2 = 0 THEN ' type=' || event_type || ' code=' || k || ' melding: fout met Bearer [VERWIJDERD]' ELSE ' antwoord: geen json' END || ' request-id=' || event_id AS line FROM m
"""


def decisions(spark, d):
    """Key-value lines made of the events, back to columns, counted per decision and reason."""
    rows = table(spark, d, "events").select(F.concat(F.lit("decision="), "event_type", F.lit(" reason=r"), (F.col("user_id") % 5).cast("string"), F.lit(" x-ratelimit-remaining-tokens="), F.round("value").cast("long").cast("string"), F.lit(" retry-after=n")).alias("line"))
    m, numbers = E.fields(F.col("line")), E.limits(F.col("line"))
    return rows.groupBy(m["decision"].alias("decision"), m["reason"].alias("reason")).agg(F.count("*").alias("n"), F.sum(numbers["remaining_tokens"]).cast("long").alias("remaining"), F.count(numbers["retry_after"]).alias("waits"))


DECISIONS_SQL = "SELECT event_type AS decision, 'r' || (user_id % 5) AS reason, count(*) AS n, sum(round(value))::BIGINT AS remaining, 0::BIGINT AS waits FROM events GROUP BY ALL"

QUERIES = {"error_counts": error_counts, "error_lines": error_lines, "decision_counts": decisions}
SQL = {"error_counts": COUNTS_SQL, "error_lines": LINES_SQL, "decision_counts": DECISIONS_SQL}
