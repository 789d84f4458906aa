"""Selection over documents, parts and events: ingest with reasons and budgets, topics, highlights."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import rules as R
from sievewright.functions import text as X
from sievewright.functions.rules import SAMPLE
from sievewright.operators import chains as H
from sievewright.operators import classify as K
from sievewright.operators import overlap as O
from sievewright.operators import select as S
from sievewright.operators import store as T
from sievewright.operators.tables import shared_path, written
from sievewright.plans import common as C
from sievewright.plans.classify import SQL as CLASSIFY_SQL
from sievewright.plans.common import table
from sievewright.sources import feeds as G

NOW = "2024-02-15 00:00:00"
BUDGET, CAP = 45, 10
YEARLESS = r"regexp_replace(title, '\b20[0-9]{2}\b', ' ', 'g')"


def items(spark, d):
    """Documents as feed items: title, link, description and date come from the text."""
    t = F.col("text")
    day = F.date_sub(F.lit(NOW).cast("date"), F.length(t) % 120)
    link = F.concat(F.lit("https://"), "source", F.lit(".example/"), X.slug(C.title(t)))
    return table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("pos"), "source", "text", C.title(t).alias("title"), t.alias("description"), link.alias("link"), F.when(F.length(t) % 50 != 0, day).alias("day"))


def ingested(spark, d):
    """Each item with its first reason against it, or whether it was recorded within caps and budget."""
    rows = K.relevance(items(spark, d).withColumn("url_key", X.url_key(F.col("link"))), SAMPLE)
    # texts stay behind; of a description it is only asked whether it has 20 characters
    rows = written(rows.select("doc_id", "source", "pos", "url_key", "title", "link", F.substring("description", 1, 20).alias("description"), "day", "relevant"), "read")
    labelled = table(spark, d, "labels").select("doc_id")
    known = T.known_urls(rows.join(labelled, "doc_id", "left_semi"), url="link").withColumn("known", F.lit(True))
    rows = rows.join(known, "url_key", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    reason = S.rejection(F.col("title"), F.col("link"), F.col("description"), F.col("known"), F.col("relevant"), F.col("day").isNotNull())
    # read three times from here on: as duplicates, for the ranges and for the counts
    rows = written(rows.withColumn("reason", reason).select("doc_id", "source", "pos", "url_key", "title", "reason"), "judged")
    # a duplicate within the run counts only behind an earlier item of the same key that can be recorded
    first = T.first_per_key(rows.where("reason IS NULL"), "url_key", "pos").select("doc_id", F.lit(True).alias("first"))
    rows = rows.join(first, "doc_id", "left").withColumn("reason", F.when(F.col("reason").isNull() & F.col("first").isNull(), "dubbel").otherwise(F.col("reason")))
    rank = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    return S.budgeted(rows, "source", "pos", F.col("reason").isNull(), F.lit(CAP), rank, BUDGET).withColumn("reason", F.when(~F.col("evaluated"), "niet beoordeeld").otherwise(F.col("reason")))


def ingest(spark, d):
    return ingested(spark, d).select("doc_id", "source", "recorded", "reason")


def ingest_reasons(spark, d):
    return S.funnel(ingested(spark, d), "source").select("source", "reason", "n", "titles", "line")


_INGEST = f"""
rel AS ({CLASSIFY_SQL['relevance']}),
i AS (SELECT doc_id, source, text, {C.sql_title('text')} AS title, 'https://' || source || '.example/' || regexp_replace(regexp_replace({C.sql_fold(C.sql_title('text'))}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[:80] AS link FROM documents),
k AS (SELECT *, regexp_replace(link, '/+$', '') AS url_key FROM i),
a AS (SELECT k.*, CASE WHEN trim(title) = '' THEN 'ontbrekende velden' WHEN url_key IN (SELECT url_key FROM k WHERE doc_id IN (SELECT doc_id FROM labels)) THEN 'dubbel'
        WHEN length(text) < 20 THEN 'korte omschrijving' WHEN NOT rel.relevant THEN 'niet relevant' WHEN length(text) % 50 = 0 THEN 'geen datum' END AS r0 FROM k JOIN rel USING (doc_id)),
b AS (SELECT *, CASE WHEN r0 IS NULL AND row_number() OVER (PARTITION BY url_key, r0 IS NULL ORDER BY doc_id) > 1 THEN 'dubbel' ELSE r0 END AS r1, regexp_extract(source, '[0-9]+')::INT AS rank FROM a),
w AS (SELECT source, min(rank) AS rank, least(count(*) FILTER (r1 IS NULL), {CAP}) AS want FROM b GROUP BY source),
l AS (SELECT source, least({CAP}, greatest(0, {BUDGET} - coalesce(sum(want) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS lim FROM w),
e AS (SELECT b.*, coalesce(count(*) FILTER (r1 IS NULL) OVER (PARTITION BY b.source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < lim AS ev FROM b JOIN l ON b.source = l.source),
f AS (SELECT doc_id, source, title, r1 IS NULL AND ev AS recorded, CASE WHEN NOT ev THEN 'niet beoordeeld' ELSE r1 END AS reason FROM e)"""
INGEST_SQL = f"WITH {_INGEST} SELECT doc_id, source, recorded, reason FROM f"
REASONS_SQL = f"""
WITH {_INGEST}, c AS (SELECT source, reason, count(*) AS n FROM f WHERE reason IS NOT NULL GROUP BY ALL),
t AS (SELECT source, reason, string_agg(title, ' | ' ORDER BY doc_id) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY source, reason ORDER BY doc_id) AS r FROM f WHERE reason IS NOT NULL) WHERE r <= 5 GROUP BY ALL)
SELECT source, reason, n, titles, string_agg(reason || ': ' || n, ', ') OVER (PARTITION BY source ORDER BY reason ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS line FROM c JOIN t USING (source, reason)
"""


LAW = "(?i)license|wet"


def _weighed(rows, special):
    """Records without their texts: what the rules ask of a text is read off in one pass and written.

    ``strength`` decides on longer texts of special categories alone and is made from those.
    """
    out = S.evidence(rows, F.lit(NOW).cast("timestamp"), LAW).withColumn("asked", F.when(special & ~F.col("short"), F.col("text")))
    return written(K.tiered(out, SAMPLE, text="asked").withColumn("important", F.length("text") % 7 == 0).drop("text", "asked"), "records")


def _chosen(rows):
    """Judged records with their choice; they are written, as each step of it reads them."""
    rows = written(rows.select("id", "title", "category", "tier", "reason", "important", "published"), "candidates")
    picked = S.pick_topics(rows.where("tier IS NOT NULL"))
    return rows.join(picked.select("id", "choice"), "id", "left").select("id", "tier", "reason", F.coalesce("choice", F.lit("rejected")).alias("choice"))


def topics(spark, d):
    """Unlabelled documents as candidates: eligible or not, then the two to write about."""
    special = F.col("category") == "src2"
    rows = _weighed(items(spark, d).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), "title", F.col("source").alias("category"), "text", F.col("day").cast("timestamp").alias("published")), special)
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    mine, theirs = rows.join(labels, "id", "left_anti"), rows.join(labels, "id", "left_semi")
    hits = O.best_overlap(mine, theirs).select("id", "score")
    yearly = O.newer_year(mine, theirs).select("id", F.lit(True).alias("yearly"))
    tier, reason = S.candidate(F.col("score").isNotNull(), F.col("yearly").isNotNull(), F.col("published"), F.lit(NOW).cast("timestamp"), special)
    return _chosen(mine.join(hits, "id", "left").join(yearly, "id", "left").withColumns({"tier": tier, "reason": reason}))


def _topics_sql() -> str:
    from sievewright.plans.overlap import OVERLAP_SQL

    words = f"list_distinct({C.sql_significant('title')})"
    jac = "len(list_intersect(c.ws, x.ws)) / len(list_distinct(c.ws || x.ws)) >= 0.4 AND c.category = x.category"
    # the source src1 has its category here, so the pairs are asked for anew
    over = OVERLAP_SQL.replace("CASE WHEN source <> 'src1' THEN source END", "source")
    subject = f"list_distinct(list_filter({C.sql_significant(YEARLESS)}, lambda w: NOT regexp_full_match(w, '[0-9]+')))"
    lead = rf"'(?i)\b(?:per|vanaf|met ingang van|ingaat op|in werking op)\s+(?:(\d{{1,2}})\s+({'|'.join(R.MONTHS)})\s+)?(20\d{{2}})\b'"
    dates = f"list_zip(regexp_extract_all(text, {lead}, 1), regexp_extract_all(text, {lead}, 2), regexp_extract_all(text, {lead}, 3))"
    month, days = f"CASE WHEN x[2] = '' THEN 1 ELSE list_position([{C.quoted(R.MONTHS)}], lower(x[2])) END", "CASE WHEN x[1] = '' THEN 0 ELSE x[1]::INT - 1 END"
    future = f"(law AND contains(text, '20') AND len(list_filter({dates}, lambda x: make_date(x[3]::INT, ({month})::INT, 1) + ({days})::INT > DATE '2024-02-15')) > 0)"
    return f"""
WITH o AS ({over}), ti AS ({CLASSIFY_SQL['tiers']}),
yt AS (SELECT id, lab, y, {subject} AS ts FROM (SELECT doc_id AS id, title, doc_id IN (SELECT doc_id FROM labels) AS lab, list_max(list_transform(regexp_extract_all(title, '\\b20[0-9]{{2}}\\b'), lambda y: y::INT)) AS y FROM (SELECT doc_id, {C.sql_title('text')} AS title FROM documents)) WHERE y IS NOT NULL),
yr AS (SELECT DISTINCT m.id FROM yt m JOIN yt a ON NOT m.lab AND a.lab AND a.y >= m.y AND len(m.ts) >= 2 AND len(list_intersect(m.ts, a.ts)) >= 0.75 * len(m.ts)),
i AS (SELECT doc_id AS id, text, source AS category, {C.sql_title('text')} AS title, CASE WHEN length(text) % 50 <> 0 THEN DATE '2024-02-15' - (length(text) % 120)::INT END AS day FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
l AS (SELECT i.*, ti.tier AS kt, o.id IS NOT NULL AS hit, i.id IN (SELECT id FROM yr) AS yearly, regexp_matches(text, '(?i)license|wet') AS law, DATE '2024-02-15' - day AS age FROM i JOIN ti ON ti.doc_id = i.id LEFT JOIN o ON o.id = i.id),
s AS (SELECT *, {future} AS future FROM l),
r AS (SELECT *, CASE WHEN length(text) < 600 THEN 'te weinig brontekst' WHEN hit THEN 'onderwerp al behandeld' WHEN yearly THEN 'jaargebonden onderwerp al behandeld' WHEN category = 'src2' AND law AND future THEN 'aangekondigde wijziging'
   WHEN category = 'src2' AND kt = 'hoog' THEN 'blijvend relevante uitleg' WHEN category = 'src2' THEN 'geen sterk signaal'
   WHEN day IS NULL THEN 'geen publicatiedatum' WHEN age < -1 THEN 'publicatiedatum in de toekomst' WHEN age <= 14 THEN 'actueel bericht' WHEN law AND (age <= 90 OR future) THEN 'nieuwe of aangekondigde regelgeving' ELSE 'niet meer actueel' END AS reason FROM s),
c AS (SELECT *, {words} AS ws, CASE reason WHEN 'actueel bericht' THEN 1 WHEN 'nieuwe of aangekondigde regelgeving' THEN 2 WHEN 'aangekondigde wijziging' THEN 2 WHEN 'blijvend relevante uitleg' THEN 3 END AS tier, length(text) % 7 = 0 AS imp FROM r),
x AS (SELECT * FROM c WHERE tier < 3 ORDER BY tier, imp DESC, day DESC, id LIMIT 1),
y AS (SELECT c.* FROM c, x WHERE c.tier < 3 AND c.id <> x.id AND NOT ({jac}) ORDER BY c.tier, c.imp DESC, c.day DESC, c.id LIMIT 1)
SELECT id, tier, reason, CASE WHEN tier IS NULL THEN 'rejected' WHEN id IN (SELECT id FROM x UNION SELECT id FROM y) THEN 'selected' ELSE 'deferred' END AS choice FROM c
"""


def candidate_rows(spark, d):
    """Documents as records: a third with a year in the title, some of the days to come, some announcing a law."""
    n = F.length("text")
    rows = items(spark, d).select("doc_id", "source", "title", "link", "text", "day")
    title = F.when(n % 3 == 0, F.concat("title", F.lit(" "), (2020 + n % 5).cast("string"))).otherwise(F.col("title"))
    text = F.when(n % 6 == 0, F.concat("text", F.lit(" De wet geldt per 1 januari 2027."))).otherwise(F.col("text"))
    return rows.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), title.alias("title"), F.col("source").alias("category"), F.col("link").alias("url"), text.alias("text"), F.date_add("day", 20).cast("timestamp").alias("published"))


def candidate_reasons(spark, d):
    """Each unlabelled document as a subject to write about, held against labelled ones as articles and open proposals, with its reason and choice."""
    special = F.col("category").isin("src2", "src0")
    rows = _weighed(candidate_rows(spark, d), special)
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    mine, theirs = rows.join(labels, "id", "left_anti"), rows.join(labels, "id", "left_semi").withColumn("source_url", F.when(F.col("id") % 2 == 0, F.col("url")))
    bodies = mine.where("id % 17 = 0").select(F.lit("auto/x").alias("headRefName"), F.when(F.col("id") % 2 == 0, "2024-01-01").alias("mergedAt"), F.lit("OPEN").alias("state"), F.concat(F.lit("<!-- bron: "), "url", F.lit(" -->")).alias("body"))
    return _chosen(H.judged_candidates(mine, theirs, G.proposal_urls(bodies, "auto/", "bron"), F.lit(NOW).cast("timestamp"), special))


def run_summary(spark, d):
    """What a run did, told while its rows are written: items by outcome, candidates by choice."""
    when = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    run = T.observed_write(ingested(spark, d).select("doc_id", "reason", "recorded"), shared_path(spark, "run"), items=F.count("*"), created=when(F.col("recorded")), known=when(F.col("reason") == "dubbel"), put_off=when(F.col("reason") == "niet beoordeeld"))
    choice = F.col("choice")
    run |= T.observed_write(candidate_reasons(spark, d), shared_path(spark, "run"), candidates=F.count("*"), selected=when(choice == "selected"), deferred=when(choice == "deferred"), rejected=when(choice == "rejected"))
    return spark.createDataFrame(list(run.items()), "metric string, n long")


def _candidates_sql() -> str:
    strength, _ = K.tier_sql(SAMPLE, "title", "concat_ws(' ', title, text)")
    ws, ts = f"list_sort(list_distinct({C.sql_significant('title')}))", f"list_distinct(list_filter({C.sql_significant(YEARLESS)}, lambda w: NOT regexp_full_match(w, '[0-9]+')))"
    jac = "len(list_intersect(c.ws, x.ws)) / len(list_distinct(c.ws || x.ws)) >= 0.4 AND c.category = x.category"
    return f"""
WITH t AS (SELECT doc_id AS id, {C.sql_title('text')} AS t0, text AS x0, length(text) AS n, source AS category, doc_id IN (SELECT doc_id FROM labels) AS lab FROM documents),
d AS (SELECT id, n, category, lab, CASE WHEN n % 3 = 0 THEN t0 || ' ' || (2020 + n % 5) ELSE t0 END AS title, CASE WHEN n % 3 = 0 THEN 2020 + n % 5 END AS y, CASE WHEN n % 6 = 0 THEN x0 || ' De wet geldt per 1 januari 2027.' ELSE x0 END AS text,
      regexp_replace('https://' || category || '.example/' || regexp_replace(regexp_replace({C.sql_fold('t0')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[:80], '/+$', '') AS url, CASE WHEN n % 50 <> 0 THEN DATE '2024-02-15' - (n % 120)::INT + 20 END AS day FROM t),
e AS (SELECT *, {ws} AS ws, {ts} AS ts FROM d), m AS (SELECT * FROM e WHERE NOT lab), a AS (SELECT * FROM e WHERE lab),
al AS (SELECT DISTINCT m.id FROM m JOIN a ON len(m.ws) > 0 AND len(a.ws) > 0 AND m.category = a.category AND len(list_intersect(m.ws, a.ws)) >= 0.4 * len(list_distinct(m.ws || a.ws))),
yr AS (SELECT DISTINCT m.id FROM m JOIN a ON a.y >= m.y AND len(m.ts) >= 2 AND len(list_intersect(m.ts, a.ts)) >= 0.75 * len(m.ts)),
s AS (SELECT m.*, {strength} AS kt, regexp_matches(text, '(?i)license|wet') AS law, n % 6 = 0 AS future, category IN ('src2', 'src0') AS special, DATE '2024-02-15' - day AS age, length(text) % 7 = 0 AS imp FROM m),
r AS (SELECT *, CASE WHEN url IN (SELECT url FROM a WHERE id % 2 = 0) THEN 'bron al gebruikt' WHEN url IN (SELECT url FROM m WHERE id % 17 = 0 AND id % 2 = 1) THEN 'bron in een voorstel' WHEN length(text) < 600 THEN 'te weinig brontekst'
  WHEN id IN (SELECT id FROM al) THEN 'onderwerp al behandeld' WHEN id IN (SELECT id FROM yr) THEN 'jaargebonden onderwerp al behandeld' WHEN special AND law AND future THEN 'aangekondigde wijziging' WHEN special AND kt = 'hoog' THEN 'blijvend relevante uitleg'
  WHEN special THEN 'geen sterk signaal' WHEN day IS NULL THEN 'geen publicatiedatum' WHEN age < -1 THEN 'publicatiedatum in de toekomst' WHEN age <= 14 THEN 'actueel bericht' WHEN law AND (age <= 90 OR future) THEN 'nieuwe of aangekondigde regelgeving' ELSE 'niet meer actueel' END AS reason FROM s),
c AS (SELECT *, CASE reason WHEN 'actueel bericht' THEN 1 WHEN 'nieuwe of aangekondigde regelgeving' THEN 2 WHEN 'aangekondigde wijziging' THEN 2 WHEN 'blijvend relevante uitleg' THEN 3 END AS tier FROM r),
x AS (SELECT * FROM c WHERE tier < 3 ORDER BY tier, imp DESC, day DESC, id LIMIT 1),
y AS (SELECT c.* FROM c, x WHERE c.tier < 3 AND c.id <> x.id AND NOT ({jac}) ORDER BY c.tier, c.imp DESC, c.day DESC, c.id LIMIT 1)
SELECT id, tier, reason, CASE WHEN tier IS NULL THEN 'rejected' WHEN id IN (SELECT id FROM x UNION SELECT id FROM y) THEN 'selected' ELSE 'deferred' END AS choice FROM c
"""


SUMMARY_SQL = f"""
WITH i AS ({INGEST_SQL}), c AS ({_candidates_sql()})
SELECT unnest(['items', 'created', 'known', 'put_off']) AS metric, unnest([count(*), count(*) FILTER (recorded), count(*) FILTER (reason = 'dubbel'), count(*) FILTER (reason = 'niet beoordeeld')]) AS n FROM i
UNION ALL SELECT unnest(['candidates', 'selected', 'deferred', 'rejected']), unnest([count(*), count(*) FILTER (choice = 'selected'), count(*) FILTER (choice = 'deferred'), count(*) FILTER (choice = 'rejected')]) FROM c
"""


def highlights(spark, d):
    """Four parts, spread over brands and types."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"), F.col("p_type").alias("source"), (F.col("p_size") == 50).alias("featured"), (F.col("p_size") % 3).alias("weight"), F.col("p_retailprice").alias("published"))
    return S.diversified(rows).select("id", "category", "source", F.col("place").cast("long").alias("place"))


HIGHLIGHTS_SQL = """
WITH RECURSIVE p AS (SELECT p_partkey AS id, p_brand AS category, p_type AS source, p_size = 50 AS featured, p_size % 3 AS weight, p_retailprice AS published FROM part),
s(place, id, category, source, ids, cats, srcs) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, []::BIGINT[], []::VARCHAR[], []::VARCHAR[]
  UNION ALL
  SELECT place + 1, id, category, source, list_append(ids, id), list_append(cats, category), list_append(srcs, source) FROM (
    SELECT s.place, p.id, p.category, p.source, s.ids, s.cats, s.srcs, row_number() OVER (ORDER BY len(list_filter(s.cats, lambda c: c = p.category)) < 2 AND len(list_filter(s.srcs, lambda c: c = p.source)) < 2 DESC, featured DESC, weight DESC, published DESC, p.id) AS r
    FROM s JOIN p ON NOT list_contains(s.ids, p.id) WHERE s.place < 4) WHERE r = 1
)
SELECT id, category, source, place FROM s WHERE place > 0
"""


def read_caps(spark, d):
    """Events per user up to the row at which five had survived; what lies behind is not evaluated."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return S.read_cap(rows, "user_id", "event_id", F.col("event_type") == "view", 5)


READ_SQL = """
SELECT event_id, user_id, event_type, coalesce(count(*) FILTER (event_type = 'view') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 5 AS evaluated FROM events
"""


def result_pages(spark, d):
    """Orders as search results in pages of ten: up to a customer's first short page, five pages, twenty rows."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_custkey").alias("topic"))
    from pyspark.sql import Window

    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("topic").orderBy("o_orderkey")) - 1)
    rows = rows.withColumn("page", F.floor(F.col("pos") / 10).cast("int"))
    return S.full_pages(rows, "topic", "page", "pos").select("o_orderkey", "topic", F.col("page").cast("long").alias("page"))


PAGES_SQL = """
WITH p AS (SELECT o_orderkey, o_custkey AS topic, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders),
q AS (SELECT *, pos // 10 AS page FROM p), n AS (SELECT topic, page, count(*) AS n FROM q GROUP BY ALL), l AS (SELECT topic, min(page) FILTER (n < 10) AS last FROM n GROUP BY topic)
SELECT o_orderkey, topic, page::BIGINT AS page FROM (SELECT q.*, row_number() OVER (PARTITION BY topic ORDER BY page, pos) AS r FROM q JOIN l USING (topic) WHERE page <= coalesce(last, page) AND page < 5) WHERE r <= 20
"""


def recent(spark, d):
    """Orders within six calendar months of the last date, by month ends; newest first decides ties by key."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    now = F.lit("1998-08-31").cast("timestamp")
    return rows.where(~S.too_old(F.col("t"), 6, now) & (F.col("t") <= now)).select("o_orderkey", F.datediff(now, F.col("t")).cast("long").alias("age"))


RECENT_SQL = "SELECT o_orderkey, (DATE '1998-08-31' - o_orderdate::DATE)::BIGINT AS age FROM orders WHERE o_orderdate >= TIMESTAMP '1998-08-31' - INTERVAL 6 MONTH AND o_orderdate <= TIMESTAMP '1998-08-31'"

QUERIES = {"ingest": ingest, "ingest_reasons": ingest_reasons, "topics": topics, "candidate_reasons": candidate_reasons, "run_summary": run_summary, "highlights": highlights, "read_caps": read_caps, "result_pages": result_pages, "recent_orders": recent}
SQL = {"ingest": INGEST_SQL, "ingest_reasons": REASONS_SQL, "topics": _topics_sql(), "candidate_reasons": _candidates_sql(), "run_summary": SUMMARY_SQL, "highlights": HIGHLIGHTS_SQL, "read_caps": READ_SQL, "result_pages": PAGES_SQL, "recent_orders": RECENT_SQL}
