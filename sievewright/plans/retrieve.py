"""Questions of conversations against benchmark passages as knowledge and documents as articles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sievewright.functions import rules as R
from sievewright.functions import text as X
from sievewright.operators import impact as I
from sievewright.operators import retrieve as Q
from sievewright.operators.tables import written
from sievewright.plans import common as C
from sievewright.plans.common import table


def questions(spark, d):
    return Q.histories(table(spark, d, "conversations"))


def knowledge(spark, d):
    """Passages as items: the first six words are the title."""
    t = F.col("text")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("item_id").alias("ord"), C.title(t, 6).alias("title"), t.alias("content"), (F.length(t) % 3).alias("priority"), (F.length(t) % 2 == 0).alias("opted"))


def item_index(items):
    return Q.index(items, [(F.col("title"), 2), (F.col("content"), 1)])


def items_found(spark, d):
    items = knowledge(spark, d)
    return Q.top(Q.scores(questions(spark, d), item_index(items)), items).select("qid", "id", "score", F.col("place").cast("long").alias("place"))


_Q = f"""
u AS (SELECT *, conv_id || '-' || turn AS qid, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM conversations),
q AS (SELECT qid, text, previous, {C.sql_raw_words('text')} AS ws FROM u WHERE role = 'user'),
k AS (SELECT item_id AS id, {C.sql_title('text', 6)} AS title, text AS content, length(text) % 3 AS priority, length(text) % 2 = 0 AS opted FROM benchmark),
ix AS (SELECT id, 2 AS w, unnest(list_distinct({C.sql_tokens('title')})) AS token FROM k UNION ALL SELECT id, 1, unnest(list_distinct({C.sql_tokens('content')})) FROM k),
own AS (SELECT qid, id, sum(w)::BIGINT AS score FROM (SELECT qid, unnest({C.sql_tokens('text')}) AS token FROM q) JOIN ix USING (token) GROUP BY ALL)"""
FOUND_SQL = f"""
WITH {_Q}
SELECT qid, id, score, place FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, priority DESC, id) AS place FROM own JOIN k USING (id) WHERE score >= 2) WHERE place <= 3
"""


def follow_ups(spark, d):
    """As above, with the previous question where the present one leans on it."""
    items = knowledge(spark, d)
    out = Q.follow_up(questions(spark, d), items, item_index(items))
    return out.select("qid", "id", "score", "past", F.col("place").cast("long").alias("place"))


FOLLOW_SQL = f"""
WITH {_Q}, l AS (SELECT qid, previous FROM q WHERE len(ws) BETWEEN 1 AND 12 AND list_has_any(ws, [{C.quoted(R.CUES)}]) AND previous IS NOT NULL),
past AS (SELECT qid, id, sum(w)::BIGINT AS past FROM (SELECT qid, unnest({C.sql_tokens('previous')}) AS token FROM l) JOIN ix USING (token) GROUP BY ALL),
b AS (SELECT coalesce(o.qid, p.qid) AS qid, coalesce(o.id, p.id) AS id, coalesce(score, 0) AS s, coalesce(past, 0) AS p FROM own o FULL JOIN past p ON o.qid = p.qid AND o.id = p.id),
m AS (SELECT *, max(s) OVER (PARTITION BY qid) >= 2 AS o FROM b), f AS (SELECT qid, id, CASE WHEN o THEN s ELSE p END AS score, CASE WHEN o THEN p ELSE 0 END AS past FROM m)
SELECT qid, id, score, past, place FROM (SELECT qid, id, score, past, row_number() OVER (PARTITION BY qid ORDER BY score DESC, past DESC, priority DESC, id) AS place FROM f JOIN k USING (id) WHERE score >= 2) WHERE place <= 3
"""


def fallback_items(spark, d):
    items, asked = knowledge(spark, d), questions(spark, d)
    titles = Q.scores(asked, Q.index(items, [(F.col("title"), 1)]))
    return Q.unambiguous(Q.scores(asked, item_index(items)), titles, items, guarded=tuple(range(0, 40, 4)))


FALLBACK_SQL = f"""
WITH {_Q}, t AS (SELECT qid, id, count(*) AS ts FROM (SELECT qid, unnest({C.sql_tokens('text')}) AS token FROM q) JOIN (SELECT id, token FROM ix WHERE w = 2) USING (token) GROUP BY ALL),
r AS (SELECT o.qid, o.id, score, coalesce(ts, 0) AS ts, priority, opted, max(score) OVER (PARTITION BY o.qid) AS best FROM own o JOIN k USING (id) LEFT JOIN t ON t.qid = o.qid AND t.id = o.id),
n AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS s2, lead(ts) OVER w AS t2 FROM r WHERE opted AND score >= 3 WINDOW w AS (PARTITION BY qid ORDER BY score DESC, ts DESC, priority DESC, id))
SELECT qid, id, score FROM n WHERE rn = 1 AND NOT coalesce(s2 = score AND t2 = ts, false) AND (NOT (id < 40 AND id % 4 = 0) OR best <= score)
"""


def articles(spark, d):
    """Documents as articles: first words as title, language and source as category and tag, a URL of their own,
    and for some the next one as successor."""
    t = F.col("text")
    later = F.when(F.length(t) % 4 == 0, F.concat(F.lit("u"), (F.col("doc_id") + 1).cast("string")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), C.title(t).alias("title"), F.concat(F.lit("u"), "doc_id").alias("url"), later.alias("superseded_by"), (F.length(t) % 365).alias("published"), t.alias("body"), F.concat_ws(" ", t, "lang", "source").alias("fields"))


_COMMON = R.QUESTION_STOP + tuple("the of and to it at er or on es with is was that this for are be by la le les el los las un une una que du est sur pour dans au aux der die das und ist ein eine einen mit auf im den dem zu von".split())


def article_index(rows):
    return I.build(rows, [(F.col("fields"), 1)], _COMMON, most=2)


def article_ranks(spark, d):
    """The two best articles per question by their whole text, successors before what they replace, replaced where that is clear."""
    rows = articles(spark, d)
    best = Q.best_articles(questions(spark, d), article_index(rows), rows, stop=_COMMON)
    return best.select("qid", F.col("place").cast("long").alias("place"), "id")


_WORDS = lambda c: f"list_filter({C.sql_raw_words(c)}, lambda w: length(w) >= 2 AND w NOT IN ({C.quoted(_COMMON)}))"
_ARTICLES = f"""
a AS (SELECT doc_id AS id, 'u' || doc_id AS url, CASE WHEN length(text) % 4 = 0 THEN 'u' || (doc_id + 1) END AS sup, length(text) % 365 AS published, text AS body, {C.sql_title('text')} AS title FROM documents),
ax AS (SELECT doc_id AS id, unnest(list_distinct({_WORDS("concat_ws(' ', text, lang, source)")})) AS token FROM documents),
sc AS (SELECT qid, id, count(*) AS score FROM (SELECT qid, unnest({_WORDS('text')}) AS token FROM q) JOIN ax USING (token) GROUP BY ALL HAVING count(*) >= 2),
rk AS (SELECT qid, id, url, sup, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sup IS NOT NULL, published DESC, id) AS r FROM sc JOIN a USING (id)),
x1 AS (SELECT qid, id, sup, r FROM rk WHERE r = 1), s1 AS (SELECT k.qid, k.id, k.r FROM rk k JOIN x1 ON x1.qid = k.qid AND x1.sup = k.url AND k.r > 1),
x2 AS (SELECT qid, id, sup, r FROM rk k WHERE r > 1 AND NOT EXISTS (SELECT 1 FROM s1 WHERE s1.qid = k.qid AND s1.r = k.r) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY r) = 1),
s2 AS (SELECT k.qid, k.id, k.r FROM rk k JOIN x2 ON x2.qid = k.qid AND x2.sup = k.url AND k.r > x2.r WHERE NOT EXISTS (SELECT 1 FROM s1 WHERE s1.qid = k.qid AND s1.r = k.r)),
fin AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY part, r) AS place FROM (SELECT qid, id, r, 1 AS part FROM s1 UNION ALL SELECT qid, id, r, 2 FROM x1 UNION ALL SELECT qid, id, r, 3 FROM s2 UNION ALL SELECT qid, id, r, 4 FROM x2)),
two AS (SELECT qid, place, f.id, sup, url FROM fin f JOIN a USING (id) WHERE place <= 2),
uniq AS (SELECT url AS sup, min(id) AS next FROM a GROUP BY url HAVING count(*) = 1),
chosen AS (SELECT t.qid, t.place, CASE WHEN next IS NOT NULL AND NOT EXISTS (SELECT 1 FROM two o WHERE o.qid = t.qid AND o.url = t.sup) AND NOT EXISTS (SELECT 1 FROM two o WHERE o.qid = t.qid AND o.sup = t.sup AND o.place < t.place) THEN next ELSE t.id END AS id FROM two t LEFT JOIN uniq USING (sup))"""
RANKS_SQL = f"WITH {_Q}, {_ARTICLES} SELECT qid, place, id FROM chosen"


CONTACT = ("contact", "question")


def _sources(spark, d):
    """What each question is answered from: knowledge, the best articles, contact; a question without any source is
    asked again with its whole history, of all of them."""
    asked, items, rows = questions(spark, d), knowledge(spark, d), articles(spark, d)
    known_index, read_index = item_index(items), article_index(rows)

    def found(asked):
        known = Q.top(Q.scores(asked, known_index), items, 2).join(items, "id").select("qid", F.lit(1).alias("block"), "place", F.lit("Kennisbank").alias("name"), "title", F.substring("content", 1, 500).alias("snippet"))
        contact = asked.where(X.any_of(F.lower("text"), CONTACT)).select("qid", F.lit(3).alias("block"), F.lit(1).alias("place"), F.lit("Contact").alias("name"), F.lit("Contact").alias("title"), F.lit("Bel of mail.").alias("snippet"))
        return written(known.unionByName(contact), "sources"), written(Q.best_articles(asked, read_index, rows, stop=_COMMON), "read")

    other, read = found(asked.select("qid", "text"))
    lost = written(Q.unanswered(asked, other, read), "lost")
    if not lost.isEmpty():
        more, also = found(lost)
        other, read = other.unionByName(more), read.unionByName(also)
    # an article is cut once, however many questions it is read for, and its text goes no further
    chosen = written(read.select("id").distinct(), "chosen")
    cut = lambda bodies: Q.snippet(F.col("body"), F.col("title"), F.lit(""), F.lit(bodies))
    shown = written(rows.join(chosen, "id", "left_semi").select("id", "title", cut(True).alias("full"), cut(False).alias("brief")), "shown")
    return asked, other, read.join(shown, "id")


def _context(asked, other, read, bodies: bool):
    read = read.select("qid", F.lit(2).alias("block"), "place", F.lit("Artikel").alias("name"), "title", F.col("full" if bodies else "brief").alias("snippet"))
    return Q.context(other.unionByName(read.withColumn("place", F.col("place").cast("int"))), asked)


def contexts(spark, d):
    """The numbered context of each question from knowledge, articles and contact, retried with its history if empty."""
    out = _context(*_sources(spark, d), True)
    return out.select("qid", "n_sources", F.md5("context").alias("context_md5"), X.token_estimate(F.col("context")).alias("tokens"))


def context_versions(spark, d):
    """How much each question's context grows where the store shows articles by their bodies instead of summaries."""
    asked, other, read = _sources(spark, d)
    out = Q.growth(_context(asked, other, read, False), _context(asked, other, read, True))
    return out.select("qid", "before", "after", "growth", (F.col("growth") <= 600).alias("within"))


def _contexts_sql() -> str:
    short = "|".join(a.replace(".", r"\.") for a in R.ABBREVIATIONS)
    plain = r"array_to_string(list_filter(list_transform(string_split_regex(body, '\n\s*\n'), lambda b: regexp_replace(trim(regexp_replace(b, '\s+', ' ', 'g')), '^\\([#*_=<-])', '\1')), lambda b: b <> ''), chr(10))"
    ends = "i > 1 AND regexp_full_match(coalesce(cs[i + 1], ''), '\\s') AND (cs[i] IN ('.', '!', '?') OR regexp_full_match(cs[i], '[\\x{201D}\"\\x{2019}'')]') AND cs[i - 1] IN ('.', '!', '?'))"
    again = re.sub(r"\b(sc|rk|x1|s1|x2|s2|fin|two|uniq|chosen)\b", r"\1_again", _ARTICLES[_ARTICLES.index("sc AS (") :]).replace("FROM q)", "FROM lost)")
    return f"""
WITH {_Q}, {_ARTICLES},
hq AS (SELECT qid, text, array_to_string(list_filter(said, lambda t: trim(t) <> ''), ' ') AS history FROM (
  SELECT role, text, conv_id || '-' || turn AS qid, list(CASE WHEN role = 'user' THEN text END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS said FROM conversations) WHERE role = 'user'),
f1 AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, priority DESC, id) AS place FROM own JOIN k USING (id) WHERE score >= 2 QUALIFY place <= 2),
lost AS (SELECT qid, concat_ws(' ', history, text) AS text FROM hq WHERE qid NOT IN (SELECT qid FROM f1) AND qid NOT IN (SELECT qid FROM chosen) AND NOT contains(lower(text), 'contact') AND NOT contains(lower(text), 'question')),
{again},
o2 AS (SELECT qid, id, sum(w) AS score FROM (SELECT qid, unnest({C.sql_tokens("text")}) AS token FROM lost) JOIN ix USING (token) GROUP BY ALL),
f2 AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, priority DESC, id) AS place FROM o2 JOIN k USING (id) WHERE score >= 2 QUALIFY place <= 2),
bd AS (SELECT id, title, p, string_split(p[:1201], '') AS cs FROM (SELECT id, title, replace(replace({plain}, '&lt;', '<'), '&gt;', '>') AS p FROM a WHERE id IN (SELECT id FROM chosen UNION SELECT id FROM chosen_again))),
ct AS (SELECT id, title, p, coalesce(list_max(list_filter(list_filter(range(1, 1201), lambda i: {ends}), lambda i: NOT regexp_matches(p[greatest(1, i - 11):i], '(?i)(?:^|\\s)(?:{short})\\.$'))), -1) AS cut, CASE WHEN contains(p[:1201], ' ') THEN length(p[:1201]) - strpos(reverse(p[:1201]), ' ') ELSE -1 END AS sp FROM bd),
sn AS (SELECT id, title, concat_ws(' ', title, '')[:500] AS brief, CASE WHEN p <> '' AND p <> trim(title) THEN CASE WHEN length(p) <= 1200 THEN p ELSE rtrim(p[:CASE WHEN cut >= 600 THEN cut WHEN sp > 0 THEN sp ELSE 1200 END]) END ELSE concat_ws(' ', title, '')[:500] END AS snippet FROM ct),
src AS (SELECT qid, 1 AS block, place, 'Kennisbank' AS name, title, content[:500] AS snippet, content[:500] AS brief FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2) JOIN k USING (id)
  UNION ALL SELECT qid, 2, place, 'Artikel', title, snippet, brief FROM (SELECT * FROM chosen UNION ALL SELECT * FROM chosen_again) JOIN sn USING (id)
  UNION ALL SELECT qid, 3, 1, 'Contact', 'Contact', 'Bel of mail.', 'Bel of mail.' FROM (SELECT qid, text FROM q UNION ALL SELECT qid, text FROM lost) WHERE contains(lower(text), 'contact') OR contains(lower(text), 'question')),
nm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY block, place) AS n FROM src),
cx AS (SELECT qid, count(*) AS n_sources, string_agg('[' || n || '] ' || name || ' — "' || title || '"' || chr(10) || snippet, chr(10) || chr(10) ORDER BY n) AS context, string_agg('[' || n || '] ' || name || ' — "' || title || '"' || chr(10) || brief, chr(10) || chr(10) ORDER BY n) AS short FROM nm GROUP BY qid),
al AS (SELECT qid, coalesce(n_sources, 0) AS n_sources, coalesce(context, '(geen bronnen gevonden)') AS context, coalesce(short, '(geen bronnen gevonden)') AS short FROM q LEFT JOIN cx USING (qid))"""


CONTEXT_SQL = f"{_contexts_sql()} SELECT qid, n_sources, md5(context) AS context_md5, ceil(length(context) / 4)::BIGINT AS tokens FROM al"
VERSIONS_SQL = f"{_contexts_sql()} SELECT qid, before, after, after - before AS growth, after - before <= 600 AS within FROM (SELECT qid, ceil(length(short) / 4)::BIGINT AS before, ceil(length(context) / 4)::BIGINT AS after FROM al)"


def fallback_answers(spark, d):
    """What a kept text answers where one item alone fits; questions for amounts or of personal cases, here those of every fifth conversation, are left out."""
    asked = questions(spark, d).withColumn("text", F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("Hoeveel kost dit: "), "text")).otherwise(F.col("text"))).where(Q.answerable(F.col("text")))
    items = knowledge(spark, d)
    sure = Q.unambiguous(Q.scores(asked, item_index(items)), Q.scores(asked, Q.index(items, [(F.col("title"), 1)])), items, guarded=tuple(range(0, 40, 4)))
    return sure.join(items, "id").select("qid", "id", Q.answer_rows(F.col("content")).alias("a")).select("qid", "id", "a.lead", F.md5("a.rest").alias("rest_md5"))


ANSWERS_SQL = f"""
WITH s AS ({FALLBACK_SQL}), p AS (SELECT item_id AS id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s, text FROM benchmark)
SELECT qid, id, coalesce(p.s[1], text) AS lead, md5(array_to_string(p.s[2:], ' ')) AS rest_md5 FROM s JOIN p USING (id) WHERE split_part(qid, '-', 1)::BIGINT % 5 <> 0
"""


def question_histories(spark, d):
    """Per question what went before it: the last question, the user's of the last eight messages, those eight, the last two."""
    return questions(spark, d).select("qid", *[F.md5(F.coalesce(c, F.lit("-"))).alias(c) for c in ("previous", "history", "recent", "latest")])


HISTORIES_SQL = """
WITH w AS (SELECT role, conv_id || '-' || turn AS qid, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous,
  list(CASE WHEN role = 'user' THEN text END) OVER e AS said, list(text) OVER e AS every, list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS two
  FROM conversations WINDOW e AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT qid, md5(coalesce(previous, '-')) AS previous, md5(coalesce(array_to_string(list_filter(said, lambda t: trim(t) <> ''), ' '), '')) AS history,
  md5(coalesce(array_to_string(list_transform(every, lambda t: t[:600]), chr(10)), '')) AS recent, md5(coalesce(array_to_string(list_transform(two, lambda t: t[:600]), chr(10)), '')) AS latest FROM w WHERE role = 'user'
"""


def routes(spark, d):
    """How each request would be answered."""
    asked = questions(spark, d)
    found = items_found(spark, d).groupBy("qid").agg(F.count("*").alias("n"))
    sure = fallback_items(spark, d).select("qid", F.lit(True).alias("sure"))
    rows = asked.join(found, "qid", "left").join(sure, "qid", "left")
    direct = F.coalesce("sure", F.lit(False)) & (F.col("history") == "") & ~Q.complex_question(F.col("text"))
    limited = F.col("turn") > 2
    return rows.select("qid", Q.decision(Q.request_error(F.col("text")), direct, limited, F.coalesce("n", F.lit(0)), F.coalesce("sure", F.lit(False))).alias("decision"), Q.dependent(F.col("text")).alias("leans"), Q.complex_question(F.col("text")).alias("complex"))


def _routes_sql() -> str:
    sure = FALLBACK_SQL.split(f"WITH {_Q},")[1].rsplit("SELECT qid, id, score FROM n", 1)
    return f"""
WITH {_Q}, hq AS (SELECT qid, turn, text, array_to_string(list_filter(said, lambda t: trim(t) <> ''), ' ') AS history FROM (
  SELECT role, text, turn, conv_id || '-' || turn AS qid, list(CASE WHEN role = 'user' THEN text END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS said FROM conversations) WHERE role = 'user'),
{sure[0]}, sure AS (SELECT qid FROM n{sure[1].rstrip()}), fd AS (SELECT DISTINCT qid FROM own WHERE score >= 2),
b AS (SELECT hq.*, ws, qid IN (SELECT qid FROM sure) AS sure, qid IN (SELECT qid FROM fd) AS found, length(text) > 140 OR length(text) - length(replace(text, '?', '')) > 1 AS complex FROM hq JOIN (SELECT qid, ws FROM q) USING (qid))
SELECT qid, CASE WHEN trim(coalesce(text, '')) = '' THEN 'fout: leeg' WHEN length(text) > 600 THEN 'fout: te lang' WHEN sure AND coalesce(history, '') = '' AND NOT complex THEN 'direct' WHEN turn > 2 AND found THEN 'bronnen zonder model'
  WHEN turn > 2 AND sure THEN 'kennisitem' WHEN turn > 2 THEN 'limiet' ELSE 'model' END AS decision, len(ws) BETWEEN 1 AND 12 AND list_has_any(ws, [{C.quoted(R.CUES)}]) AS leans, complex FROM b
"""


QUERIES = {"items_found": items_found, "follow_ups": follow_ups, "fallback_items": fallback_items, "article_ranks": article_ranks, "contexts": contexts, "context_versions": context_versions, "fallback_answers": fallback_answers, "question_histories": question_histories, "answer_routes": routes}
SQL = {"items_found": FOUND_SQL, "follow_ups": FOLLOW_SQL, "fallback_items": FALLBACK_SQL, "article_ranks": RANKS_SQL, "contexts": CONTEXT_SQL, "answer_routes": _routes_sql(), "fallback_answers": ANSWERS_SQL, "question_histories": HISTORIES_SQL, "context_versions": VERSIONS_SQL}
