"""Pages: cleaning, blocks, duplicates by key, and the funnel from pages to categories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievewright.functions import rules as R
from sievewright.functions import text as X
from sievewright.operators import classify as K
from sievewright.functions.rules import SAMPLE
from sievewright.plans.common import table
from sievewright.plans.text import URL_KEY_SQL, URL_PARTS_SQL
from sievewright.sources import pages as P


def funnel(spark, d):
    """Flagship: pages cleaned, first row per key, categorised, counted per host and category."""
    rows = table(spark, d, "pages").select("page_id", X.url_key(F.col("url")).alias("url_key"), X.url_parts(F.col("url"))["host"].alias("host"), P.page_title(F.col("html")).alias("title"), P.strip_html(P.region(F.col("html"), "article")).alias("body"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("url_key").orderBy("page_id")))
    text = F.concat_ws(" ", "title", "body")
    told = first.withColumn("category", K.best_category(text, SAMPLE))
    return told.groupBy("host", "category").agg(F.count("*").alias("fetched"), F.count_if(F.col("r") == 1).alias("distinct_pages"), F.count_if((F.col("r") == 1) & (F.length("body") >= 400)).alias("recorded"), F.sum(F.when(F.col("r") == 1, F.length("body")).otherwise(0)).alias("chars"))


_STRIP = lambda c: f"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({c}, '<!\\[CDATA\\[((?s:.*?))\\]\\]>', '\\1', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&quot;', '\"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g'))"
_BARE = "regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g')"
_REGION = f"regexp_replace(CASE WHEN regexp_matches({_BARE}, '(?is)<article\\b[^>]*>(.*?)</article\\s*>') THEN regexp_extract({_BARE}, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1) END, '(?is)^.*?</h1\\s*>', '')"
_TITLE = "regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1)"
FUNNEL_SQL = f"""
WITH u AS ({URL_PARTS_SQL}), c AS (
  SELECT page_id, {URL_KEY_SQL} AS url_key, host, nullif({_STRIP(_TITLE)}, '') AS title, {_STRIP(f"coalesce({_REGION}, '')")} AS body FROM u
), f AS (
  SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS r, {K.best_category_sql("concat_ws(' ', title, body)", SAMPLE)} AS category FROM c
)
SELECT host, category, count(*) AS fetched, count(*) FILTER (r = 1) AS distinct_pages, count(*) FILTER (r = 1 AND length(body) >= 400) AS recorded,
       sum(CASE WHEN r = 1 THEN length(body) ELSE 0 END)::BIGINT AS chars FROM f GROUP BY host, category
"""


def clean(spark, d):
    out = P.clean_pages(table(spark, d, "pages"))
    return out.select("page_id", "url_key", "title", "description", "ministry", "heading", "n_blocks", F.length("body").cast("long").alias("n_body"), F.md5("body").alias("body_md5"))


def page_blocks(spark, d):
    """A row per content block with its place and tag."""
    rows = table(spark, d, "pages").select("page_id", F.posexplode(P.blocks(P.region(F.col("html"), "article"))).alias("pos", "b"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "b.tag", "b.line")


def _decoded(c: str) -> str:
    for name, to in P.ENTITIES.items():
        c = f"replace({c}, '&{name};', '{to.replace(chr(39), chr(39) * 2)}')"
    return f"replace({c}, '&amp;', '&')"


# the pages hold no numeric references; one alternative per tag, for want of back-references
_PAIRS = "regexp_extract_all(r, '(?is)<p\\b[^>]*>.*?</p\\s*>|<h2\\b[^>]*>.*?</h2\\s*>|<h3\\b[^>]*>.*?</h3\\s*>|<li\\b[^>]*>.*?</li\\s*>')"
_BLOCKS = f"""
r AS (SELECT page_id, {_REGION} AS r FROM pages),
x AS (SELECT page_id, unnest({_PAIRS}) AS b, unnest(range(len({_PAIRS}))) AS i FROM r),
y AS (SELECT page_id, i, lower(regexp_extract(b, '^<([a-zA-Z0-9]+)', 1)) AS tag, regexp_extract(b, '(?is)^<[a-z0-9]+\\b[^>]*>(.*)</[a-z0-9]+\\s*>$', 1) AS inside FROM x),
z AS (SELECT page_id, i, tag, replace(replace(trim(regexp_replace({_decoded("regexp_replace(regexp_replace(inside, '(?i)<br\\s*/?>', ' ', 'g'), '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g')), '<', '&lt;'), '>', '&gt;') AS line FROM y
      WHERE NOT (tag = 'li' AND regexp_full_match(inside, '(?is)\\s*<a\\b[^>]*>.*?</a>\\s*'))),
w AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, tag, CASE WHEN tag = 'li' THEN '- ' || line ELSE line END AS l0 FROM z WHERE line <> ''),
b AS (SELECT page_id, pos, tag, CASE WHEN regexp_matches(l0, '^(?:#|-{{3,}}|\\*{{3,}}|_{{3,}}|={{3,}}|<)') THEN chr(92) || l0 ELSE l0 END AS line FROM w)"""
BLOCKS_SQL = f"WITH {_BLOCKS} SELECT page_id, pos, tag, line FROM b"

def news_pages(spark, d):
    """Documents as news pages: scripts and comments repeat the markers, menus and forms stand around the text,
    a figure and documents inside it; some lack a marker."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    markers = "Nieuwsbericht 01-01-2020 | 08:00 <p>Uit een script, lang genoeg om als alinea mee te tellen.</p> Heeft deze informatie u geholpen?"
    lines = F.transform(F.split(esc(F.col("text")), "\n"), lambda x, i: F.when(i % 4 == 3, F.concat(F.lit("<li class='x'>"), x, F.lit("</li>"))).otherwise(F.concat(F.lit("<p>"), x, F.lit("</p>"))))
    id_ = F.col("doc_id")
    html = F.concat(
        F.lit(f"<a href='#c'>Ga direct naar inhoud</a><header><nav><ul><li><a href='/'>Start</a></li></ul></nav></header><form>Vul in wat u zoekt</form><script>var a = '{markers}';</script><!-- {markers} --><main><h1>Titel</h1><p>"),
        F.when(id_ % 11 == 5, "Toespraak").otherwise("Nieuwsbericht"), F.lit("&nbsp;<span>06-10-2025</span> &#124; <b>08:00</b></p>"), F.array_join(lines, "\n"),
        F.lit("<figure><p>Een bijschrift dat lang genoeg is om als alinea mee te tellen.</p></figure><h2> Documenten </h2><p>Een document dat lang genoeg is om als alinea mee te tellen.</p><div>"),
        F.when(id_ % 13 == 7, "Einde").otherwise("Heeft deze&nbsp;informatie u geholpen?"), F.lit("</div></main><footer>Terug naar boven</footer>"),
    )
    return table(spark, d, "documents").select("doc_id", html.alias("html"))


def news_bodies(spark, d):
    return P.news_bodies(news_pages(spark, d), 1500).select("doc_id", F.length("body").cast("long").alias("n_body"), F.md5("body").alias("body_md5"))


def _news_sql() -> str:
    line = "replace(replace(trim(regexp_replace(x, '\\s+', ' ', 'g')), '<', '&lt;'), '>', '&gt;')"
    mark = lambda c: f"CASE WHEN regexp_matches({c}, '^(?:#|-{{3,}}|\\*{{3,}}|_{{3,}}|={{3,}}|<)') THEN chr(92) || {c} ELSE {c} END"
    short = "|".join(a.replace(".", r"\.") for a in R.ABBREVIATIONS)
    ends = "i > 1 AND regexp_full_match(coalesce(cs[i + 1], ''), '\\s?') AND (cs[i] IN ('.', '!', '?') OR regexp_full_match(cs[i], '[\\x{201D}\"\\x{2019}'')]') AND cs[i - 1] IN ('.', '!', '?'))"
    return f"""
WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE doc_id % 11 <> 5 AND doc_id % 13 <> 7),
l AS (SELECT doc_id, i, i % 4 <> 3 AS p, {mark("CASE WHEN i % 4 = 3 THEN '- ' || l ELSE l END")} AS l FROM (SELECT doc_id, i, {line} AS l FROM x) WHERE l <> ''),
o AS (SELECT *, coalesce(sum(length(l) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ FROM l),
j AS (SELECT doc_id, string_agg(l, chr(10) || chr(10) ORDER BY i) AS j FROM o GROUP BY doc_id),
c AS (SELECT doc_id, j, CASE WHEN length(j) > 1500 THEN list_max(list_filter(list_filter(range(1, 1501), lambda i: {ends}), lambda i: NOT regexp_matches(j[greatest(1, i - 11):i], '(?i)(?:^|\\s)(?:{short})\\.$'))) END AS cut FROM (SELECT *, string_split(j[:1501], '') AS cs FROM j)),
b AS (SELECT doc_id, CASE WHEN length(j) <= 1500 THEN j WHEN cut > 0 THEN rtrim(j[:cut]) END AS body FROM c),
n AS (SELECT doc_id, count(*) FILTER (p AND least(length(l), length(body) - start_) >= 40) AS n FROM o JOIN b USING (doc_id) GROUP BY doc_id),
g AS (SELECT doc_id, body FROM b JOIN n USING (doc_id) WHERE n >= 2 AND length(body) >= 400)
SELECT doc_id, length(body)::BIGINT AS n_body, md5(body) AS body_md5 FROM documents LEFT JOIN g USING (doc_id)
"""


def page_heads(spark, d):
    """Pages with a head of their own: a description in one of its four forms, empty in some, or none; a ministry's link."""
    id_, t = F.col("page_id"), F.regexp_replace(P.page_title(F.col("html")), "[\"'<>&]", " ")
    forms = ['<meta name="description" content="{}">', "<meta content='{}' name='description'>", '<META property="og:description" content="{}"/>', '<meta content="{}" property="og:description">']
    told = F.when(id_ % 7 == 3, F.lit("")).otherwise(F.concat(F.lit("Over "), t, F.lit(" &amp; meer")))
    meta = F.lit("")
    for k, form in enumerate(forms):
        head, tail = form.split("{}")
        meta = F.when(id_ % 5 == k, F.concat(F.lit(head), told, F.lit(tail))).otherwise(meta)
    link = F.when(id_ % 3 == 0, '<a href="/ministeries/ministerie-van-financien">').when(id_ % 3 == 1, '<a href="/ministeries/ministerie-van-elders">').otherwise("")
    html = F.concat(F.lit("<head>"), meta, F.lit("</head>"), link, F.col("html"))
    return table(spark, d, "pages").select("page_id", html.alias("html")).select("page_id", P.described(F.col("html")).alias("description"), P.ministry(F.col("html")).alias("ministry"), P.heading(F.col("html")).alias("heading"))


_H1 = _STRIP("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")
_FIRST = f"list_filter(list_transform(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1), lambda p: {_STRIP('p')}), lambda p: length(p) > 60)[1]"
HEADS_SQL = f"""
WITH t AS (SELECT page_id, {_FIRST} AS p1, {_H1} AS h1, trim(regexp_replace('Over ' || regexp_replace(nullif({_STRIP(_TITLE)}, ''), '["''<>&]', ' ', 'g') || ' & meer', '\\s+', ' ', 'g')) AS t FROM pages),
u AS (SELECT *, coalesce(CASE WHEN page_id % 5 < 4 AND page_id % 7 <> 3 THEN t END, p1) AS d FROM t)
SELECT page_id, CASE WHEN length(d) >= 20 THEN d END AS description, CASE WHEN page_id % 3 = 0 THEN 'Ministerie van Financiën' END AS ministry, CASE WHEN length(h1) >= 5 THEN h1 END AS heading FROM u
"""


def _clean_sql() -> str:
    short = "|".join(a.replace(".", r"\.") for a in R.ABBREVIATIONS)
    ends = "i > 1 AND regexp_full_match(coalesce(cs[i + 1], ''), '\\s?') AND (cs[i] IN ('.', '!', '?') OR regexp_full_match(cs[i], '[\\x{201D}\"\\x{2019}'')]') AND cs[i - 1] IN ('.', '!', '?'))"
    return f"""
WITH {_BLOCKS},
j AS (SELECT page_id, string_agg(line, chr(10) || chr(10) ORDER BY pos) AS j, count(*) AS n_blocks, count(*) FILTER (tag = 'p' AND length(line) >= 40) AS paragraphs FROM b GROUP BY page_id),
c AS (SELECT *, CASE WHEN length(j) > 8000 THEN list_max(list_filter(list_filter(range(1, 8001), lambda i: {ends}), lambda i: NOT regexp_matches(j[greatest(1, i - 11):i], '(?i)(?:^|\\s)(?:{short})\\.$'))) END AS cut FROM (SELECT *, string_split(j[:8001], '') AS cs FROM j)),
t AS (SELECT page_id, n_blocks, paragraphs, CASE WHEN length(j) <= 8000 THEN j WHEN cut > 0 THEN rtrim(j[:cut]) END AS body FROM c),
g AS (SELECT page_id, n_blocks, CASE WHEN length(body) >= 400 AND paragraphs >= 2 THEN body END AS body FROM t),
k AS (SELECT page_id, {URL_KEY_SQL} AS url_key, nullif({_STRIP(_TITLE)}, '') AS title, {_FIRST} AS d, {_H1} AS h1, {_REGION} AS r FROM ({URL_PARTS_SQL}))
SELECT page_id, url_key, title, CASE WHEN length(d) >= 20 THEN d END AS description, NULL::VARCHAR AS ministry, CASE WHEN length(h1) >= 5 THEN h1 END AS heading, CASE WHEN r IS NOT NULL THEN coalesce(n_blocks, 0) END::BIGINT AS n_blocks, length(body)::BIGINT AS n_body, md5(body) AS body_md5
FROM k LEFT JOIN g USING (page_id)
"""


QUERIES = {"page_funnel": funnel, "page_clean": clean, "page_blocks": page_blocks, "news_bodies": news_bodies, "page_heads": page_heads}
SQL = {"page_funnel": FUNNEL_SQL, "page_blocks": BLOCKS_SQL, "news_bodies": _news_sql(), "page_heads": HEADS_SQL, "page_clean": _clean_sql()}
