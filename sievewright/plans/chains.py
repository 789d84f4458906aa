"""Ingest chains over pages, and deadline hits over passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import text as X
from sievewright.functions.rules import SAMPLE
from sievewright.operators import chains as H
from sievewright.operators import classify as K
from sievewright.operators import retrieve as Q
from sievewright.operators import store as T
from sievewright.operators.tables import written
from sievewright.plans import common as C
from sievewright.plans.common import table
from sievewright.plans.pages import _REGION, _STRIP, _TITLE
from sievewright.plans.retrieve import _Q, item_index, knowledge, questions
from sievewright.plans.text import URL_KEY_SQL, URL_PARTS_SQL
from sievewright.sources import feeds as G
from sievewright.sources import pages as P

NOW = "2024-06-30"
HUBS = ("de",)


def _items(spark, d):
    day = F.date_sub(F.lit(NOW).cast("date"), F.length("html") % 400)
    return table(spark, d, "pages").select(F.col("page_id").alias("ord"), F.col("url").alias("loc"), X.url_key(F.col("url")).alias("url_key"), X.url_parts(F.col("url"))["scheme"].alias("source"), day.cast("timestamp").alias("lastmod"), "html")


def url_stages(spark, d):
    """Where each page's URL ends in the funnel, decided on URL and title alone."""
    rows = _items(spark, d).select("ord", "loc", "lastmod", "url_key", P.page_title(F.col("html")).alias("text"))
    known = T.known_urls(table(spark, d, "pages").where("url LIKE '%?page%'"))
    out = H.url_funnel(rows.drop("url_key"), known, SAMPLE, HUBS)
    return out.select("ord", "url_key", "stage", "tier", F.col("place").cast("long").alias("place"))


def _stages_sql() -> str:
    s = SAMPLE
    plain = lambda c: f"replace(lower({c}), '-', ' ')"
    words = lambda w: [x.lower().replace("-", " ") for x in w]
    by = K.scores_sql("whole", s)
    strong, comp, gen = (K.any_sql(plain("whole"), words(w)) for w in (s.strong, s.comparisons, s.general))
    return f"""
WITH u AS ({URL_PARTS_SQL}), i AS (SELECT page_id AS ord, {URL_KEY_SQL} AS url_key, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg, DATE '{NOW}' - (length(html) % 400)::INT AS day, nullif({_STRIP(_TITLE)}, '') AS t, url FROM u),
w AS (SELECT *, concat_ws(' ', t, t) AS whole, row_number() OVER (PARTITION BY url_key ORDER BY day DESC, ord) AS r FROM i),
f AS (SELECT *, {strong} AS strong, {comp} AS comp, {gen} AS gen, ({' + '.join(by.values())}) AS m, ({' + '.join(e for c, e in by.items() if c != s.legal_form)}) AS other, regexp_matches(trim(whole), '(?i)^wat is (?:een|de|het)\\b') AS def FROM w),
g AS (SELECT *, CASE WHEN m = 0 OR def AND NOT strong AND NOT comp OR gen AND NOT strong AND NOT comp THEN 'afgewezen' WHEN strong OR comp THEN 'hoog' WHEN other = 0 THEN 'afgewezen' ELSE 'twijfel' END AS tier FROM f),
h AS (SELECT *, CASE WHEN r > 1 THEN 'dubbel' WHEN lower(seg[1]) = 'de' THEN 'overzicht' WHEN len(seg) <> 2 THEN 'andere vorm' WHEN tier = 'afgewezen' THEN 'niet relevant' WHEN url_key IN (SELECT url_key FROM i WHERE url LIKE '%?page%') THEN 'bekend' ELSE 'kandidaat' END AS stage FROM g)
SELECT ord, url_key, stage, tier, CASE WHEN stage = 'kandidaat' THEN n END AS place FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY tier <> 'hoog', day DESC, ord) AS n FROM h)
"""


def topic_records(spark, d):
    """Pages as topic items: too old, known, read, relevant, recorded."""
    items = _items(spark, d).drop("html")
    html = F.col("html")
    landed = table(spark, d, "pages").select("page_id", X.url_key(F.col("url")).alias("url_key"), P.page_title(html).alias("title"), P.strip_html(P.region(html, "article")).alias("body"))
    landed = T.first_per_key(landed, "url_key", "page_id").select("url_key", "title", F.col("body").alias("description"), F.lit(None).cast("string").alias("body"))
    known = T.known_urls(table(spark, d, "pages").where("url LIKE '%#%'"))
    out = H.topic_ingest(items, landed, known, SAMPLE, F.lit(NOW).cast("timestamp"), 9, 100, 30, 45)
    return out.select("ord", "source", "recorded", "reason")


def _records_sql() -> str:
    s = SAMPLE
    total, narrow = (" + ".join(K.scores_sql("x", s, w).values()) for w in ((), s.broad))
    who = " OR ".join(K.any_sql("lower(x)", w) for w in s.audiences.values())
    sig = " OR ".join(K.term_sql("x", r) for r in s.signals)
    low = "trim(regexp_replace(lower(x), '\\s+', ' ', 'g'))"
    bar = " OR ".join(f"({K.term_sql('title' if r.scope == 'title' else 'x', r)} AND NOT {K.any_sql(low, r.unless)})" for r in s.exclusions)
    scheme = r"regexp_extract(url, '^\s*([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)"
    return f"""
WITH u AS ({URL_PARTS_SQL}), i AS (SELECT page_id AS ord, {URL_KEY_SQL} AS url_key, {scheme} AS source, url, DATE '{NOW}' - (length(html) % 400)::INT AS day, nullif({_STRIP(_TITLE)}, '') AS title, {_STRIP(f"coalesce({_REGION}, '')")} AS body FROM u),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY ord) AS r FROM i) WHERE r = 1),
c AS (SELECT i.ord, i.source, CASE WHEN i.day < DATE '{NOW}' - INTERVAL 9 MONTH THEN 'te oud' WHEN i.url_key IN (SELECT url_key FROM i WHERE url LIKE '%#%') THEN 'dubbel' END AS cheap, p.title, p.body AS description, concat_ws(' ', p.title, p.body) AS x FROM i JOIN p USING (url_key)),
r AS (SELECT *, coalesce(count(*) FILTER (cheap IS NULL) OVER (PARTITION BY source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 100 AS rd FROM c),
v AS (SELECT *, coalesce(cheap, CASE WHEN title IS NULL THEN 'geen titel' WHEN length(description) < 20 THEN 'korte omschrijving' WHEN NOT ((({total}) > 0 OR {who} OR {sig}) AND (({narrow}) > 0 OR {who} OR {sig}) AND NOT ({bar})) THEN 'niet relevant' END) AS reason FROM r),
w AS (SELECT source, least(count(*) FILTER (reason IS NULL AND rd), 30) AS want FROM v GROUP BY source),
l AS (SELECT source, least(30, greatest(0, 45 - coalesce(sum(want) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS lim FROM w),
e AS (SELECT v.*, coalesce(count(*) FILTER (reason IS NULL AND rd) OVER (PARTITION BY v.source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < lim AS ev FROM v JOIN l USING (source))
SELECT ord, source, reason IS NULL AND rd AND ev AS recorded, CASE WHEN NOT ev OR NOT rd THEN 'niet beoordeeld' ELSE reason END AS reason FROM e
"""


HOST = "https://x.example/"
PROCEDURES, SERVICE = ("onthe",), (("/en/676",), ("the reti", "ing es"))
PAGE_CAP, CAP = 50, 20


def landed_maps(spark, d):
    """Pages as a tree of sitemaps of a hundred URLs: an index of indexes, maps, a circle, a map that is missing and one of another name."""
    page = F.concat(F.lit("<url><loc>"), F.regexp_replace("url", "&", "&amp;"), F.lit("</loc><lastmod>"), F.date_sub(F.lit(NOW).cast("date"), F.length("html") % 400).cast("string"), F.lit("</lastmod></url>"))
    rows = table(spark, d, "pages").select("page_id", page.alias("x"), F.expr("page_id div 100").alias("m"))
    joined = lambda order, x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, x))), lambda r: r[x]), "")
    maps = rows.groupBy("m").agg(joined("page_id", "x").alias("xs"))
    name = F.when(F.col("m") % 5 == 3, F.lit("nieuws-")).otherwise(F.lit("documents-"))
    maps = maps.select("m", F.concat(F.lit(HOST), name, F.col("m").cast("string"), F.lit(".xml")).alias("loc"), F.concat(F.lit("<urlset>"), "xs", F.lit("</urlset>")).alias("xml"))
    link = F.concat(F.lit("<sitemap><loc>"), "loc", F.lit("</loc></sitemap>"))
    lists = maps.select(F.expr("m div 10").alias("k"), "m", link.alias("x")).groupBy("k").agg(joined("m", "x").alias("xs"))
    lists = lists.select("k", F.concat(F.lit(HOST + "index-"), F.col("k").cast("string"), F.lit(".xml")).alias("loc"), F.concat(F.lit("<sitemapindex>"), "xs", F.lit(f"<sitemap><loc>{HOST}index.xml</loc></sitemap><sitemap><loc>{HOST}documents-0"), "k", F.lit("weg.xml</loc></sitemap></sitemapindex>")).alias("xml"))
    root = lists.select("k", link.alias("x")).groupBy().agg(joined("k", "x").alias("xs")).select(F.lit(HOST + "index.xml").alias("loc"), F.concat(F.lit("<sitemapindex>"), "xs", F.lit("</sitemapindex>")).alias("xml"))
    return maps.select("loc", "xml").unionByName(lists.select("loc", "xml")).unionByName(root)


def index_maps(spark, d):
    """The maps that an index of indexes leads to, with the level each is met at."""
    landed = written(landed_maps(spark, d), "landed")
    return H.expanded(landed, spark.range(1).select(F.lit(HOST + "index.xml").alias("loc")), r"documents-\d+\.xml$").select("loc", F.col("level").cast("long").alias("level"), "kind")


MAPS_SQL = f"""
WITH m AS (SELECT DISTINCT page_id // 100 AS m FROM pages), k AS (SELECT DISTINCT m // 10 AS k FROM m)
SELECT '{HOST}index.xml' AS loc, 0::BIGINT AS level, 'index' AS kind UNION ALL SELECT '{HOST}index-' || k || '.xml', 1, 'index' FROM k UNION ALL SELECT '{HOST}documents-0' || k || 'weg.xml', 2, 'niet geland' FROM k
UNION ALL SELECT '{HOST}' || CASE WHEN m % 5 = 3 THEN 'nieuws-' ELSE 'documents-' END || m || '.xml', 2, CASE WHEN m % 5 = 3 THEN 'andere naam' ELSE 'kaart' END FROM m
"""


def _indexed(spark, d):
    """The whole chain: the index expanded, its maps' URLs through the funnel, pages read, judged and recorded."""
    landed = written(landed_maps(spark, d), "landed")
    maps = H.expanded(landed, spark.range(1).select(F.lit(HOST + "index.xml").alias("loc")), r"documents-\d+\.xml$").where("kind = 'kaart'")
    found = G.sitemap_urls(landed.join(maps.select("loc"), "loc", "left_semi").select(F.regexp_extract("loc", r"(\d+)\.xml$", 1).cast("long").alias("m"), "xml"))
    html = F.col("html")
    pages = table(spark, d, "pages").select("page_id", X.url_key(F.col("url")).alias("url_key"), P.page_title(html).alias("name"), P.heading(html).alias("title"), P.described(html).alias("description"))
    pages = written(T.first_per_key(pages, "url_key", "page_id"), "pages")
    urls = found.select((F.col("m") * 1000 + F.col("pos")).alias("ord"), "loc", F.to_timestamp("lastmod").alias("lastmod"), X.url_key(F.col("loc")).alias("url_key"))
    urls = urls.join(pages.select("url_key", F.col("name").alias("text")), "url_key", "left").drop("url_key")
    known = T.known_urls(table(spark, d, "pages").where("url LIKE '%?page%'"))
    articles = table(spark, d, "pages").where("page_id % 9 = 0").select(F.col("page_id").alias("id"), F.col("page_id").alias("ord"), P.heading(html).alias("title"), F.lit(None).cast("string").alias("category")).where("title IS NOT NULL")
    return H.index_ingest(urls, pages.select("url_key", "title", "description"), known, articles, SAMPLE, HUBS, PROCEDURES, SERVICE, PAGE_CAP, CAP)


def index_records(spark, d):
    return _indexed(spark, d).select("ord", "url_key", "stage", "lowered", "recorded")


def index_reasons(spark, d):
    """How many URLs of an index ended at each stage, and how many of them had their tier lowered."""
    return _indexed(spark, d).groupBy("stage").agg(F.count("*").alias("n"), F.count_if("lowered").alias("n_lowered"))


def _index_sql() -> str:
    tier, _ = K.tier_sql(SAMPLE, "t", "concat_ws(' ', t, t)")
    late, why = K.tier_sql(SAMPLE, "coalesce(title, '')", "concat_ws(' ', title, description)")
    plain, both = "replace(lower(coalesce(title, '')), '-', ' ')", "lower(concat_ws(' ', title, description))"
    h1 = _STRIP("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")
    para = f"list_filter(list_transform(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1), lambda p: {_STRIP('p')}), lambda p: length(p) > 60)"
    return f"""
WITH u AS ({URL_PARTS_SQL}),
p0 AS (SELECT page_id, page_id // 100 AS m, url, {URL_KEY_SQL} AS url_key, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg, DATE '{NOW}' - (length(html) % 400)::INT AS day, nullif({_STRIP(_TITLE)}, '') AS name,
       CASE WHEN length({h1}) >= 5 THEN {h1} END AS title, {para}[1] AS descr FROM u),
pg AS (SELECT url_key, name, title, CASE WHEN length(descr) >= 20 THEN descr END AS description FROM p0 QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY page_id) = 1),
i AS (SELECT m * 1000 + row_number() OVER (PARTITION BY m ORDER BY page_id) - 1 AS ord, p0.url_key, seg, day, pg.name AS t FROM p0 JOIN pg USING (url_key) WHERE m % 5 <> 3),
w AS (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY day DESC, ord) AS r, {tier} AS tier FROM i),
h AS (SELECT *, CASE WHEN r > 1 THEN 'dubbel' WHEN lower(seg[1]) = 'de' THEN 'overzicht' WHEN len(seg) <> 2 THEN 'andere vorm' WHEN tier = 'afgewezen' THEN 'niet relevant' WHEN url_key IN (SELECT url_key FROM p0 WHERE url LIKE '%?page%') THEN 'bekend' ELSE 'kandidaat' END AS stage FROM w),
n AS (SELECT *, CASE WHEN stage = 'kandidaat' THEN row_number() OVER (PARTITION BY stage ORDER BY tier <> 'hoog', day DESC, ord) END AS place FROM h),
rd AS (SELECT n.ord, n.place, n.url_key, title, description, {late} AS late, {why} AS why,
       {K.any_sql(both, PROCEDURES)} OR regexp_extract(n.url_key, '^https://[^/]+([^?]*)', 1) IN ({", ".join(f"'{x}'" for x in SERVICE[0])}) OR {K.any_sql(plain, SERVICE[1])} AS offered FROM n JOIN pg USING (url_key) WHERE place <= {PAGE_CAP}),
ar AS (SELECT list_sort(list_distinct({C.sql_significant('title')})) AS ws FROM p0 WHERE page_id % 9 = 0 AND title IS NOT NULL),
al AS (SELECT DISTINCT ord FROM (SELECT ord, list_distinct({C.sql_significant('title')}) AS ws FROM rd WHERE title IS NOT NULL) a JOIN ar b ON len(a.ws) > 0 AND len(b.ws) > 0 AND len(list_intersect(a.ws, b.ws)) >= 0.4 * len(list_distinct(a.ws || b.ws))),
st AS (SELECT ord, place, CASE WHEN title IS NULL OR description IS NULL THEN 'geen titel of samenvatting' WHEN offered THEN 'procedure of dienst' WHEN late = 'afgewezen' THEN 'pagina niet relevant' WHEN ord IN (SELECT ord FROM al) THEN 'overlap' ELSE 'vastgelegd' END AS stage, why = 'titel zonder signaal' AND NOT offered AS lowered FROM rd),
ev AS (SELECT *, coalesce(count(*) FILTER (stage = 'vastgelegd') OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM st),
fin AS (SELECT n.ord, n.url_key, coalesce(ev.stage, CASE WHEN n.stage = 'kandidaat' THEN 'niet opgehaald' ELSE n.stage END) AS stage, coalesce(lowered, false) AS lowered FROM n LEFT JOIN ev ON ev.ord = n.ord AND before < {CAP})"""


INDEX_SQL = f"{_index_sql()} SELECT ord, url_key, stage, lowered, stage = 'vastgelegd' AS recorded FROM fin"
REASONS_SQL = f"{_index_sql()} SELECT stage, count(*) AS n, count(*) FILTER (lowered) AS n_lowered FROM fin GROUP BY stage"


def deadline_matches(spark, d):
    """Passages as deadlines: the two best per question, stale ones left out."""
    items = knowledge(spark, d)
    n = F.length("content")
    dated = items.select("id", F.date_add(F.lit("2024-01-01").cast("date"), n % 365).alias("deadline"), F.date_sub(F.lit(NOW).cast("date"), n % 500).alias("last_verified"))
    out = H.deadline_hits(Q.scores(questions(spark, d), item_index(items)), dated, F.lit(NOW).cast("timestamp"))
    return out.withColumn("place", F.col("place").cast("long"))


MATCHES_SQL = f"""
WITH {_Q}, f AS (SELECT id, DATE '2024-01-01' + (length(content) % 365)::INT - DATE '{NOW}' AS n FROM k WHERE length(content) % 500 <= 400)
SELECT qid, id, score, place FROM (SELECT qid, o.id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, CASE WHEN n >= 0 THEN 1.0 / (1 + n) ELSE 1.0 / n - 1 END DESC, o.id) AS place FROM own o JOIN f ON f.id = o.id WHERE score >= 2) WHERE place <= 2
"""


def page_kinds(spark, d):
    """Service pages, procedures, own texts and date kinds."""
    rows = table(spark, d, "pages").select("page_id", "url", P.page_title(F.col("html")).alias("title"), F.length("html").alias("n"))
    service = H.service_page(F.col("url"), F.coalesce("title", F.lit("")), ("/en/676",), ("the reti", "ing es"))
    own = H.own_relevance(F.when(F.col("n") % 3 == 0, "sjabloon").when(F.col("n") % 3 == 1, F.col("title")), ("sjabloon",))
    kind = H.date_kind(F.when(F.col("n") % 2 == 0, F.lit(NOW).cast("date")), F.when(F.col("n") % 5 == 0, F.lit(NOW).cast("date")))
    return rows.select("page_id", service.alias("service"), X.any_of(F.lower(F.coalesce("title", F.lit(""))), ("tion", "ung")).alias("procedure"), own.alias("own"), kind.alias("date_kind"))


KINDS_SQL = f"""
WITH u AS ({URL_PARTS_SQL}), t AS (SELECT page_id, path, coalesce(nullif({_STRIP(_TITLE)}, ''), '') AS title, length(html) AS n FROM u)
SELECT page_id, path = '/en/676' OR {K.any_sql("replace(lower(title), '-', ' ')", ("the reti", "ing es"))} AS service, {K.any_sql('lower(title)', ('tion', 'ung'))} AS procedure, n % 3 = 1 AND title <> '' AS own,
       CASE WHEN n % 2 = 0 THEN 'gepubliceerd' WHEN n % 5 = 0 THEN 'laatst gewijzigd' END AS date_kind FROM t
"""

QUERIES = {"url_stages": url_stages, "topic_records": topic_records, "deadline_matches": deadline_matches, "page_kinds": page_kinds, "index_maps": index_maps, "index_records": index_records, "index_reasons": index_reasons}
SQL = {"url_stages": _stages_sql(), "topic_records": _records_sql(), "deadline_matches": MATCHES_SQL, "page_kinds": KINDS_SQL, "index_maps": MAPS_SQL, "index_records": INDEX_SQL, "index_reasons": REASONS_SQL}
