"""Text and key expressions over pages, documents, conversations and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import rules as R
from sievewright.functions import text as X
from sievewright.plans import common as C
from sievewright.plans.common import table


def url_keys(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", X.url_key(url).alias("url_key"), X.first_segment(url).alias("segment"), X.path_text(url).alias("path_text"), (F.size(X.path_segments(url)) == 2).alias("two_segments"), X.first_segment(url).isin("en", "de").alias("hub"))


_URL = r"'^\s*([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?([^/:?#]+)(?::([0-9]+))?([^?#]*)(\?[^#]*)?'"
URL_PARTS_SQL = f"SELECT page_id, url, html, regexp_extract(url, {_URL}, 2) AS host, regexp_extract(url, {_URL}, 3) AS port, regexp_extract(url, {_URL}, 4) AS path, regexp_extract(url, {_URL}, 5) AS query FROM pages"
URL_KEY_SQL = "CASE WHEN trim(coalesce(url, '')) = '' THEN '' WHEN host = '' THEN trim(url) ELSE 'https://' || lower(host) || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || regexp_replace(path, '/+$', '') || query END"
URL_SQL = f"""
WITH u AS ({URL_PARTS_SQL}), v AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM u)
SELECT page_id, {URL_KEY_SQL} AS url_key, lower(coalesce(seg[1], '')) AS segment, trim(regexp_replace(regexp_replace(path, '[/_.-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS path_text,
       len(seg) = 2 AS two_segments, lower(coalesce(seg[1], '')) IN ('en', 'de') AS hub FROM v
"""


def words(spark, d):
    """Each way of cutting text into words, over whole texts, as counts and digests."""
    # each step is a projection of its own, so that what later ones share is made once
    t, none = F.col("text"), F.lit(None).cast("string")
    rows = table(spark, d, "documents").select("doc_id", X.slug(C.title(t)).alias("slug"), "text", X.fold(t).alias("folded"), X.normal(t).alias("plain"), X.sentences(t).alias("sentences"))
    rows = rows.withColumns({"plain_folded": X.fold(F.col("plain")), "raw": X.raw_words(none, F.col("folded")), "split": X.split_words(F.col("folded"))})
    years = F.when(t.rlike(X.YEAR), X.split_words(X.fold(F.regexp_replace(t, X.YEAR, " ")))).otherwise(F.col("split"))
    sets = {
        "raw": F.col("raw"), "tokens": X.tokens(none, raw=F.col("raw")), "significant": X.significant_words(none, F.col("split")), "detail": X.detail_words(none, X.split_words(F.col("plain_folded"))),
        "title": F.sort_array(X.title_words(none, F.col("plain_folded"))), "topic": F.sort_array(X.topic_words(none, years)),
    }
    rows = rows.select("doc_id", "slug", "plain", "sentences", *[w.alias(f"w_{n}") for n, w in sets.items()])
    out = [c for n in sets for c in (F.size(f"w_{n}").cast("long").alias(f"n_{n}"), F.md5(F.array_join(f"w_{n}", " ")).alias(f"{n}_md5"))]
    return rows.select("doc_id", "slug", F.md5("plain").alias("normal_md5"), F.size("sentences").cast("long").alias("n_sentences"), F.md5(F.array_join("sentences", "|")).alias("sentences_md5"), *out)


def _words_sql() -> str:
    w = {
        "raw": C.sql_raw_words("text"),
        "tokens": C.sql_tokens("text"),
        "significant": C.sql_significant("text"),
        "detail": C.sql_detail("text"),
        "title": f"list_sort({C.sql_title_words('text')})",
        "topic": "list_sort(list_distinct(list_filter(" + C.sql_significant(r"regexp_replace(text, '\b20\d{2}\b', ' ', 'g')") + r", lambda w: NOT regexp_full_match(w, '\d+'))))",
    }
    out = ", ".join(f"len({e})::BIGINT AS n_{n}, md5(array_to_string({e}, ' ')) AS {n}_md5" for n, e in w.items())
    sentences = f"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
    slug = f"regexp_replace(regexp_replace({C.sql_fold(C.sql_title('text'))}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[:80]"
    return f"SELECT doc_id, {slug} AS slug, md5({C.sql_normal('text')}) AS normal_md5, len({sentences})::BIGINT AS n_sentences, md5(array_to_string({sentences}, '|')) AS sentences_md5, {out} FROM documents"


def effective_dates(spark, d):
    """Texts written from order dates, moved to a later year, and the future dates found in them."""
    day = F.add_months(F.to_date("o_orderdate"), 12 * 28)
    text = F.concat(F.lit("Nieuwe regels gelden per "), X.dutch_date(day), F.lit(" en vanaf "), F.year(day).cast("string"), F.lit("."))
    now = F.lit("2024-06-30 12:00:00").cast("timestamp")
    rows = table(spark, d, "orders").select("o_orderkey", day.alias("day"), text.alias("text"))
    found = X.future_dates(F.col("text"), now)
    return rows.select("o_orderkey", "text", X.short_date(F.col("day")).alias("short"), X.month_label(F.col("day")).alias("month"), X.future_effective_date(F.col("text"), now).cast("string").alias("effective"), F.size(found).cast("long").alias("n_future"), F.array_join(F.transform(X.years(F.col("text")), lambda y: y.cast("string")), ",").alias("years"))


_M = "[" + C.quoted(R.MONTHS) + "]"
DATES_SQL = f"""
WITH o AS (SELECT o_orderkey, (o_orderdate::DATE + INTERVAL (12 * 28) MONTH)::DATE AS d FROM orders),
p AS (SELECT *, {_M}[month(d)] AS m, make_date(year(d), 1, 1) AS j FROM o)
SELECT o_orderkey, 'Nieuwe regels gelden per ' || day(d) || ' ' || m || ' ' || year(d) || ' en vanaf ' || year(d) || '.' AS text,
       day(d) || ' ' || m[:3] || ' ' || year(d) AS short, upper(m[1]) || m[2:] || ' ' || year(d) AS month,
       CASE WHEN d > TIMESTAMP '2024-06-30 12:00:00' THEN d::VARCHAR WHEN j > TIMESTAMP '2024-06-30 12:00:00' THEN j::VARCHAR END AS effective,
       ((d > TIMESTAMP '2024-06-30 12:00:00')::INT + (j > TIMESTAMP '2024-06-30 12:00:00')::INT)::BIGINT AS n_future, year(d) || ',' || year(d) AS years FROM p
"""


def token_budget(spark, d):
    """Estimated tokens per conversation: fixed part, history, output."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(X.token_estimate(F.col("text"))).alias("history"), F.count("*").alias("turns"))
    return rows.select("conv_id", "turns", "history", (F.lit(1426) + F.col("history") + 500).alias("budget"), ((F.lit(1426) + F.col("history") + 500) > 7300).alias("over"))


BUDGET_SQL = """
SELECT conv_id, count(*) AS turns, sum(ceil(length(coalesce(text, '')) / 4))::BIGINT AS history, 1426 + sum(ceil(length(coalesce(text, '')) / 4))::BIGINT + 500 AS budget,
       1426 + sum(ceil(length(coalesce(text, '')) / 4))::BIGINT + 500 > 7300 AS over FROM conversations GROUP BY conv_id
"""


def snippets(spark, d):
    """Texts cut at sentence and word borders, and with secrets and tags taken out."""
    t = F.col("text")
    clean = X.scrub_tags(X.redact_secrets(X.plain_body(t)))
    return table(spark, d, "documents").select("doc_id", X.truncate_boundary(t, 500).alias("snippet"), X.card_text(t).alias("card"), F.length(X.truncate_sentence(t, 1000)).cast("long").alias("n_body"), F.md5(clean).alias("clean_md5"))


def _snippets_sql() -> str:
    short = "|".join(a.replace(".", r"\.") for a in R.ABBREVIATIONS)

    def ends(n: int, last: str) -> str:
        # ends of sentences within the first n characters; no look-ahead here, so the next character is asked for
        at = f"list_filter(range(1, least(length(text), {n}) + 1), lambda i: regexp_full_match(text[i:i], '[\\x{{201D}}\"\\x{{2019}}'')]') AND i > 1 AND text[i-1:i-1] IN ('.', '!', '?') AND {last} OR text[i:i] IN ('.', '!', '?') AND {last})"
        return f"list_filter({at}, lambda i: NOT regexp_matches(text[greatest(1, i - 11):i], '(?i)(?:^|\\s)(?:{short})\\.$'))"

    after = "regexp_full_match(text[i+1:i+1], '\\s')"
    cut = f"coalesce(list_max({ends(500, after)}), -1)"
    space = "(length(text[:501]) - strpos(reverse(text[:501]), ' '))"
    sent = f"list_max({ends(1000, '(' + after + ' OR i = length(text))')})"
    plain = r"array_to_string(list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda b: regexp_replace(trim(regexp_replace(b, '\s+', ' ', 'g')), '^\\([#*_=<-])', '\1')), lambda b: b <> ''), chr(10))"
    plain = f"replace(replace({plain}, '&lt;', '<'), '&gt;', '>')"
    red = rf"regexp_replace({plain}, '(?i)\b(?:sk|gsk|key|token)[_-][a-z0-9_-]{{8,}}', '[VERWIJDERD]', 'g')"
    red = rf"regexp_replace({red}, '(?i)authorization\s*[:=]\s*[^\s\"'',}}]+(?:\s+[^\s\"'',}}]+)?', 'authorization: [VERWIJDERD]', 'g')"
    red = rf"regexp_replace({red}, '(?i)bearer\s+[^\s\"'',}}]+', 'Bearer [VERWIJDERD]', 'g')"
    red = rf"regexp_replace({red}, '(?i)</?(?:bronnen|systeem)>', '', 'g')"
    return f"""
WITH c AS (SELECT doc_id, text, {cut} AS cut, {space} AS sp, {sent} AS sent FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE rtrim(text[:CASE WHEN cut >= 250 THEN cut WHEN strpos(text[:501], ' ') > 0 AND sp > 0 THEN sp ELSE 500 END]) END AS snippet,
       CASE WHEN length(text) > 155 THEN text[:152] || '…' ELSE text END AS card,
       CASE WHEN length(text) <= 1000 THEN length(text) WHEN sent > 0 THEN length(rtrim(text[:sent])) END::BIGINT AS n_body, md5({red}) AS clean_md5 FROM c
"""


QUERIES = {"text_url_keys": url_keys, "text_words": words, "text_effective_dates": effective_dates, "text_token_budget": token_budget, "text_snippets": snippets}
SQL = {"text_url_keys": URL_SQL, "text_words": _words_sql(), "text_effective_dates": DATES_SQL, "text_token_budget": BUDGET_SQL, "text_snippets": _snippets_sql()}
