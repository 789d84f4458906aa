"""Events as hits: user is key, value is weight."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import text as X
from sievewright.operators import limits as L
from sievewright.operators.tables import shared_path
from sievewright.plans.common import table
from sievewright.streaming import limits as S

DAY = L.Limit(86400, 3)


def hits(spark, d):
    return _hits(table(spark, d, "events"))


def _hits(rows):
    return rows.select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("w"), (F.col("event_type") != "error").alias("ok"))


def usage(spark, d):
    out = L.usage(hits(spark, d).withColumn("w", F.round(F.col("w") * 100).cast("long")), L.Limit(86400, 0))
    return out.select("id", "key", "used")


USAGE_SQL = """
SELECT event_id AS id, user_id AS key, (sum(w) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)
       - coalesce(sum(w) OVER (PARTITION BY user_id, t ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0))::BIGINT AS used
FROM (SELECT *, round(value * 100)::BIGINT AS w, epoch_us(ts) AS t FROM events)
"""


def admitted(spark, d):
    return L.replay(hits(spark, d), DAY)


ADMITTED_SQL = """
WITH RECURSIVE h AS (SELECT event_id AS id, user_id AS key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (
  SELECT id, key, t, n, true AS admitted, [t] AS held FROM h WHERE n = 1
  UNION ALL
  SELECT id, key, t, n, len(inside) < 3, CASE WHEN len(inside) < 3 THEN list_append(inside, t) ELSE inside END
  FROM (SELECT h.*, list_filter(r.held, lambda x: h.t - x < 86400000000) AS inside FROM r JOIN h ON h.key = r.key AND h.n = r.n + 1)
)
SELECT id, key, admitted FROM r
"""

#: Limits that bind on the events: successes of a lane in a day, of a client in five days, weight of a lane in two hours.
THREE = (L.Limit(86400, 9), L.Limit(5 * 86400, 2), L.Limit(7200, 60_000))


def laned(rows):
    """Hits of the hour of day as a lane, in whole cents, so that sums are exact."""
    return rows.select("id", F.hour("ts").cast("long").alias("lane"), "key", "ts", F.round(F.col("w") * 100).cast("long").alias("w"), "ok")


def three_limits(spark, d):
    return L.combined(laned(hits(spark, d)), *THREE)


THREE_SQL = """
WITH RECURSIVE h AS (
  SELECT event_id AS id, user_id AS key, epoch_us(ts) AS t, round(value * 100)::BIGINT AS w, event_type <> 'error' AS ok, hour(ts) AS lane,
         row_number() OVER (PARTITION BY hour(ts) ORDER BY ts, event_id) AS n FROM events
), r AS (
  SELECT NULL::BIGINT AS id, NULL::BIGINT AS key, lane, 0 AS n, '' AS decision, 0::BIGINT AS used, []::STRUCT(k BIGINT, t BIGINT)[] AS done, []::STRUCT(t BIGINT, w BIGINT)[] AS held FROM (SELECT DISTINCT lane FROM h)
  UNION ALL
  SELECT id, key, lane, n, decision, (mine + (decision = 'toegelaten')::INT)::BIGINT,
         CASE WHEN decision = 'toegelaten' THEN list_append(done, {'k': key, 't': t}) ELSE done END, CASE WHEN decision IN ('toegelaten', 'mislukt') THEN list_append(held, {'t': t, 'w': w}) ELSE held END
  FROM (
    SELECT *, CASE WHEN recent >= 9 THEN 'algemene limiet' WHEN mine >= 2 THEN 'eigen limiet' WHEN weight + w > 60000 THEN 'tokenlimiet' WHEN ok THEN 'toegelaten' ELSE 'mislukt' END AS decision
    FROM (
      SELECT *, len(list_filter(done, lambda x: x.k = key)) AS mine, len(list_filter(done, lambda x: this_t - x.t < 86400000000)) AS recent, coalesce(list_sum(list_transform(held, lambda x: x.w)), 0) AS weight
      FROM (SELECT h.*, h.t AS this_t, list_filter(r.done, lambda x: h.t - x.t < 432000000000) AS done, list_filter(r.held, lambda x: h.t - x.t < 7200000000) AS held FROM r JOIN h ON h.lane = r.lane AND h.n = r.n + 1)
    )
  )
)
SELECT id, key, decision, used FROM r WHERE n > 0
"""


def _stream(spark, d):
    """The events table as a file stream, all files one batch: files need not be in order of time, and what comes behind the watermark is lost."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")


def admitted_stream(spark, d):
    """The limiter over the events as a stream, run to its end."""
    path = shared_path(spark, "stream")
    S.to_completion(S.limited(_hits(_stream(spark, d)), DAY), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out")


def three_limits_stream(spark, d):
    """The three limits over the events as a stream, reserved before and settled after, run to its end."""
    path = shared_path(spark, "stream")
    S.to_completion(S.three_limits(laned(_hits(_stream(spark, d))), *THREE), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out")


def usage_stream(spark, d):
    """Usage per key and sliding window over the events as a stream, run to its end."""
    path = shared_path(spark, "stream")
    rows = _hits(_stream(spark, d)).withColumn("w", F.round(F.col("w") * 100).cast("long"))
    S.complete_into(S.windowed_usage(rows, "2 hours", "1 hour"), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out").select("key", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "used", "n")


USAGE_STREAM_SQL = """
WITH e AS (SELECT user_id AS key, round(value * 100)::BIGINT AS w, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events)
SELECT key, strftime(s, '%Y-%m-%d %H:%M:%S') AS start, sum(w)::BIGINT AS used, count(*) AS n FROM e GROUP BY ALL
"""


def ingest_stream(spark, d):
    """Pages as a stream into a store of distinct URL keys."""
    path = shared_path(spark, "stream")
    schema = spark.read.parquet(f"{d}/pages.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/pages.parquet*").select(F.col("page_id").alias("id"), X.url_key(F.col("url")).alias("url_key"))
    S.daily_ingest(rows, f"{path}/store", f"{path}/state")
    return spark.read.parquet(f"{path}/store/*").select("id", "url_key")


def _ingest_sql() -> str:
    from sievewright.plans.text import URL_KEY_SQL, URL_PARTS_SQL

    return f"SELECT min(page_id) AS id, url_key FROM (SELECT page_id, {URL_KEY_SQL} AS url_key FROM ({URL_PARTS_SQL})) GROUP BY url_key"


QUERIES = {"limit_usage": usage, "limit_admitted": admitted, "limit_three": three_limits, "limit_admitted_stream": admitted_stream, "limit_three_stream": three_limits_stream, "limit_usage_stream": usage_stream, "ingest_stream": ingest_stream}
SQL = {"limit_usage": USAGE_SQL, "limit_admitted": ADMITTED_SQL, "limit_admitted_stream": ADMITTED_SQL, "limit_three": THREE_SQL, "limit_three_stream": THREE_SQL, "limit_usage_stream": USAGE_STREAM_SQL, "ingest_stream": _ingest_sql()}
