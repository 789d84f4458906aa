"""Validation over documents: each against the benchmark passage of its number, and against its source's first text."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions import rules as R
from sievewright.functions import text as X
from sievewright.functions.rules import SAMPLE
from sievewright.operators import validate as V
from sievewright.operators.tables import spread_join, written
from sievewright.plans import common as C
from sievewright.plans.common import table


def fact_rows(spark, d):
    """(doc_id, kind, value) of every document's facts and numbers."""
    plain = F.col("plain")
    f = V.facts(plain, plain) | {"number": V.numbers(plain, plain)}
    # the normal form is a column of its own, so that it is made once
    rows = table(spark, d, "documents").select("doc_id", X.normal(F.col("text")).alias("plain")).select("doc_id", F.explode(V.tagged(f)).alias("f"))
    return rows.select("doc_id", "f.kind", "f.value")


_CANON = r"regexp_replace(CASE WHEN regexp_full_match(v, '\d{1,3}(\.\d{3})+(,\d+)?') THEN replace(replace(v, '.', ''), ',', '.') WHEN regexp_full_match(v, '\d+,\d+') THEN replace(v, ',', '.') ELSE v END, '\.0+$', '')"
_N = r"(?:\d[\d.,]*\d|\d)"
_FACTS = f"""
n AS (SELECT doc_id, source, {C.sql_normal('text')} AS t FROM documents),
raw AS (
  SELECT doc_id, source, 'amount' AS kind, unnest(regexp_extract_all(t, '€\\s?({_N})', 1) || regexp_extract_all(t, '({_N})\\s?(?:euro\\b|miljoen\\b|miljard\\b)', 1)) AS v FROM n
  UNION ALL SELECT doc_id, source, 'percentage', unnest(regexp_extract_all(t, '({_N})\\s?(?:%|procent\\b)', 1)) FROM n
  UNION ALL SELECT doc_id, source, 'year', unnest(list_transform(regexp_extract_all(t, '(?:^|[^a-z0-9_])((?:19|20)\\d{{2}})\\b', 1), lambda x: x)) FROM n
  UNION ALL SELECT doc_id, source, 'number', unnest(regexp_extract_all(t, '{_N}')) FROM n
), fact AS (SELECT DISTINCT doc_id, source, kind, CASE WHEN kind = 'year' THEN v ELSE {_CANON} END AS value FROM raw)"""
FACTS_SQL = f"WITH {_FACTS} SELECT doc_id, kind, value FROM fact"


def unsupported_facts(spark, d):
    """Facts of a document that the first document of its source has not."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    first = docs.groupBy("source").agg(F.min_by("text", "doc_id").alias("source_text"))
    known = first.select("source", V.supported(F.col("source_text")).alias("known"))  # once a source
    rows = spread_join(docs, known, "source", "doc_id").select("doc_id", F.explode(V.lacking(F.col("text"), F.col("known"))).alias("f"))
    return rows.select("doc_id", "f.kind", "f.value")


UNSUPPORTED_SQL = f"""
WITH {_FACTS}, o AS (SELECT source, min(doc_id) AS first FROM documents GROUP BY source)
SELECT a.doc_id, a.kind, a.value FROM fact a JOIN o USING (source)
WHERE a.kind IN ('amount', 'percentage', 'year') AND NOT EXISTS (SELECT 1 FROM fact s WHERE s.doc_id = o.first AND (s.kind = a.kind OR a.kind = 'amount' AND s.kind = 'number') AND s.value = a.value)
"""


def title_similarity(spark, d):
    """Similarity of each document's first words to those of its source's first document."""
    docs = table(spark, d, "documents").select("doc_id", "source", C.title(F.col("text")).alias("title"))
    first = docs.groupBy("source").agg(F.min_by("title", "doc_id").alias("other"))
    score = X.jaccard(X.title_words(F.col("title")), X.title_words(F.col("other")))
    return spread_join(docs, first, "source", "doc_id").select("doc_id", score.alias("score"), (score > 0.75).alias("too_close"))


SIMILARITY_SQL = f"""
WITH t AS (SELECT doc_id, source, {C.sql_title_words(C.sql_title('text'))} AS ws FROM documents), f AS (SELECT source, arg_min(ws, doc_id) AS o FROM t GROUP BY source),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 OR len(o) = 0 THEN 0.0::DOUBLE ELSE (len(list_intersect(ws, o)) / len(list_distinct(ws || o)))::DOUBLE END AS score FROM t JOIN f USING (source))
SELECT doc_id, score, score > 0.75 AS too_close FROM s
"""


def checked(spark, d):
    """The whole check: errors and warnings of each document as an article on its source's first document."""
    docs = table(spark, d, "documents")
    first = docs.groupBy("source").agg(F.min_by("text", "doc_id").alias("source_text"))
    known = written(first.select("source", V.known_source(C.title(F.col("source_text"), 12), F.col("source_text")).alias("known")), "known")  # once a source
    copies = max(1, 640 // max(1, known.count()))  # of what may be broadcast there are few rows, with copies as well
    rows = spread_join(docs, known, "source", "doc_id", copies).select(
        "doc_id", C.title(F.col("text"), 12).alias("title"), F.coalesce(F.get(X.sentences(F.col("text")), 0), F.lit("")).alias("summary"), F.col("text").alias("body"), F.lit("").alias("relevance"), F.when(F.col("lang") == "en", "voorstel").alias("status"),
        F.col("lang").alias("category"), F.array(F.lit("starter")).alias("audiences"), "known", F.concat(F.lit("https://www."), "source", F.lit(".example/x")).alias("source_url"), (F.length("text") % 9 == 0).alias("duplicate"),
    )
    out = V.validated(rows, F.lit("2024-01-01").cast("timestamp"), "example", SAMPLE.audiences, categories=("en", "de", "fr"))
    return out.select("doc_id", "ok", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


_TEXTS = {
    # (text, of which documents by length): sentences of an article and of its source
    "article": (("Het kabinet wil dit.", "n % 2 = 0"), ("De regeling is inmiddels van kracht.", "n % 3 = 0"), ("De wet is ingegaan per 1 januari 2027.", "n % 7 = 0"), ("De regels zijn momenteel geldig.", "n % 4 = 1"), ("Er is geen geldende regelgeving.", "n % 4 = 3")),
    "source": (("Er ligt een wetsvoorstel.", "n % 2 = 1"), ("Het is aangenomen.", "n % 9 = 0"), ("De regels zijn momenteel geldig.", "n % 8 = 1"), ("Zie artikel 5 lid 2 awb.", "n % 3 = 1"), ("Dit moet binnen twee weken.", "n % 3 = 2"), ("U moet zich melden bij de belastingdienst.", "n % 5 = 2"),
               ("Bedrijven met personeel die minstens twaalf werknemers hebben betalen premie.", "n % 4 = 0"), ("Een starter hoeft dit niet te doen.", "n % 6 = 5")),
    "body": (("Volgens artikel 5 geldt dit.", "n % 2 = 0"), ("Dat kan binnen twee weken.", "n % 4 = 2"), ("De Belastingdienst helpt.", "n % 3 = 0"), ("Voor bedrijven met personeel geldt een premie.", "n % 5 < 3"), ("Voor bedrijven met personeel en minstens twaalf werknemers geldt een premie.", "n % 5 = 1"), ("Er is subsidie, belasting en premie.", "n % 7 < 3")),
}


def article_rules(spark, d):
    """Each rule of the check apart: documents with sentences of articles and sources, by their length, around their own text."""
    text = lambda name: F.concat_ws(" ", *[F.expr(f"CASE WHEN {when} THEN '{t}' END") for t, when in _TEXTS[name]])
    rows = table(spark, d, "documents").select("doc_id", "text", F.length("text").alias("n"))
    rows = rows.select("doc_id", "n", F.concat_ws("\n", text("article"), "text").alias("article"), text("source").alias("source"), F.concat_ws(" ", text("body"), F.lit("Einde.")).alias("body"), F.expr("CASE n % 5 WHEN 1 THEN 'voorstel' WHEN 2 THEN 'van-kracht' WHEN 3 THEN 'onbekend' WHEN 4 THEN 'consultatie' END").alias("status"))
    now = F.lit("2024-01-01").cast("timestamp")
    who = F.when(F.col("n") % 2 == 1, F.array(F.lit("starter"), F.lit("werkgever"))).otherwise(F.array(F.lit("werkgever")))
    rows = rows.withColumn("plain", X.normal(F.col("article")))  # a column of its own, so that it is made once
    out = rows.withColumns({"errors": V.status_errors(F.col("article"), F.col("status"), F.col("source"), now, ("van-kracht", *R.TENTATIVE), F.col("plain")), "claims": V.claims(F.col("article"), F.col("source"), F.col("plain"))})
    out = out.withColumns({"dropped": V.dropped_qualifiers(F.col("body"), F.col("source")), "missing": V.missing_details(F.col("body"), F.col("source")), "excluded": V.excluded_audiences(who, F.col("source"), F.col("body"), {"starter": ("starter",), "werkgever": ("werkgevers",)}), "repeated": V.repeats_list(F.lit("Dit gaat over subsidie, belasting, premie en toeslagen."), F.col("body"))})
    return out.select("doc_id", *[F.array_join(c, "; ").alias(c) for c in ("errors", "claims", "dropped", "missing", "excluded")], "repeated")


def _rules_sql() -> str:
    parts = lambda name: "concat_ws(' ', " + ", ".join(f"CASE WHEN {when} THEN '{t}' END" for t, when in _TEXTS[name]) + ")"
    re2 = lambda p: p.replace("'", "''")
    normal = C.sql_normal("article")
    found = " || ".join(f"regexp_extract_all(replace(m, 'geen geldende regelgeving', ''), '{c}')" for c in V.CLAIMS)
    return f"""
WITH a AS (SELECT doc_id, length(text) AS n, concat_ws(chr(10), {parts('article')}, text) AS article, {parts('source')} AS source, CASE length(text) % 5 WHEN 1 THEN 'voorstel' WHEN 2 THEN 'van-kracht' WHEN 3 THEN 'onbekend' WHEN 4 THEN 'consultatie' END AS status
           FROM (SELECT *, length(text) AS n FROM documents)),
b AS (SELECT *, {normal} AS m, {C.sql_normal('source')} AS ms, coalesce(status IN ('voorstel', 'consultatie', 'voornemen'), false) AS open FROM a)
SELECT doc_id,
  array_to_string(list_filter([CASE WHEN status = 'onbekend' THEN 'ongeldige status' END, CASE WHEN open AND NOT regexp_matches(article, '{re2(V.TENTATIVE_WORDS)}') THEN 'voorlopig zonder voorbehoud' END,
    CASE WHEN open AND regexp_matches(article, '{re2(V.IN_FORCE)}') THEN 'voorlopig maar geldend genoemd' END,
    CASE WHEN (status IS NULL OR status = 'van-kracht') AND regexp_matches(source, '{re2(V.SOURCE_TENTATIVE)}') AND NOT regexp_matches(source, '{re2(V.SOURCE_DEFINITE)}') THEN 'bron is voorlopig' END, CASE WHEN n % 7 = 0 THEN 'toekomst als verleden' END], lambda x: x IS NOT NULL), '; ') AS errors,
  array_to_string(list_distinct(list_filter({found}, lambda c: NOT contains(ms, c))), '; ') AS claims,
  CASE WHEN n % 4 = 0 AND n % 5 < 3 AND n % 5 <> 1 THEN 'Bedrijven met personeel die minstens twaalf werknemers hebben betalen premie' ELSE '' END AS dropped,
  array_to_string(list_filter([CASE WHEN n % 3 = 1 AND n % 2 <> 0 THEN 'artikel 5 lid 2 awb' END, CASE WHEN n % 3 = 2 AND n % 4 <> 2 THEN 'binnen twee weken' END, CASE WHEN n % 5 = 2 AND n % 3 <> 0 THEN 'belastingdienst' END], lambda x: x IS NOT NULL), '; ') AS missing,
  CASE WHEN n % 6 = 5 AND n % 2 = 1 THEN 'starter' ELSE '' END AS excluded, n % 7 < 3 AS repeated FROM b
"""


QUERIES = {"fact_rows": fact_rows, "unsupported_facts": unsupported_facts, "title_similarity": title_similarity, "article_checks": checked, "article_rules": article_rules}
SQL = {"fact_rows": FACTS_SQL, "unsupported_facts": UNSUPPORTED_SQL, "title_similarity": SIMILARITY_SQL, "article_rules": _rules_sql()}
