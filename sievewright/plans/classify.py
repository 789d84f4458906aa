"""Documents against rule tables: relevance, category, audience, priority, tier."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions.rules import SAMPLE
from sievewright.operators import classify as K
from sievewright.operators import rule_tables as T
from sievewright.plans import common as C
from sievewright.plans.common import table


def documents(spark, d):
    return table(spark, d, "documents").withColumn("title", C.title(F.col("text")))


def category_scores(spark, d):
    """A row per document and category with a score."""
    by = K.scores(F.col("text"), SAMPLE)
    rows = documents(spark, d).select("doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), s.cast("long").alias("score")) for c, s in by.items()])).alias("x"))
    return rows.select("doc_id", "x.category", "x.score").where("score > 0")


SCORES_SQL = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, {s}::BIGINT AS score FROM documents" for c, s in K.scores_sql("text", SAMPLE).items()) + ") WHERE score > 0"


def relevance(spark, d):
    """The relevance gate with each of its parts, and what a relevant row is filed under."""
    day, now = F.date_add(F.lit("2024-01-01").cast("date"), F.length("text") % 60).cast("timestamp"), F.lit("2024-02-01").cast("timestamp")
    out = K.relevance(documents(spark, d), SAMPLE, filed=(day, now))
    return out.select("doc_id", "keyword", "audience", "signal", "corroborated", "barred", "relevant", "hint", "category", F.array_join("audiences", ",").alias("audiences"), "priority")


def _relevance_sql() -> str:
    s = SAMPLE
    total, narrow = (" + ".join(K.scores_sql("text", s, w).values()) for w in ((), s.broad))
    who = {a: K.any_sql("lower(text)", w) for a, w in s.audiences.items()}
    sig = " OR ".join(K.term_sql("text", r) for r in s.signals)
    low = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
    bar = " OR ".join(f"({K.term_sql('title' if r.scope == 'title' else 'text', r)} AND NOT {K.any_sql(low, r.unless)})" for r in s.exclusions)
    hint = "CASE " + " ".join(f"WHEN {K.term_sql('text', r)} THEN '{r.category}'" for r in s.signals if r.category) + " END"
    return f"""
WITH t AS (SELECT doc_id, text, {C.sql_title('text')} AS title FROM documents),
f AS (SELECT *, ({total}) > 0 AS keyword, ({' OR '.join(who.values())}) AS audience, ({sig}) AS signal, ({narrow}) > 0 AS narrow, ({bar}) AS barred, {hint} AS hint FROM t),
g AS (SELECT *, narrow OR audience OR signal AS corroborated FROM f)
SELECT doc_id, keyword, audience, signal, corroborated, barred, (keyword OR audience OR signal) AND corroborated AND NOT barred AS relevant, hint,
       {K.best_category_sql('text', s, 'hint')} AS category, array_to_string(list_filter([{', '.join(f"CASE WHEN {e} THEN '{a}' END" for a, e in who.items())}], lambda x: x IS NOT NULL), ',') AS audiences,
       CASE WHEN {K.any_sql('lower(text)', s.important)} THEN 'belangrijk' WHEN DATE '2024-01-01' + (length(text) % 60)::INT >= DATE '2024-02-01' - 14 THEN 'actueel' ELSE 'praktisch' END AS priority
FROM g
"""


def relevance_by_table(spark, d):
    """The same gate by a rule table instead of rules in the plan."""
    day, now = F.date_add(F.lit("2024-01-01").cast("date"), F.length("text") % 60).cast("timestamp"), F.lit("2024-02-01").cast("timestamp")
    out = T.relevance(documents(spark, d).select("doc_id", "text", "title"), T.rule_table(spark, SAMPLE), SAMPLE.default, (day, now))
    return out.select("doc_id", "keyword", "audience", "signal", "corroborated", "barred", "relevant", "hint", "category", F.array_join("audiences", ",").alias("audiences"), "priority")


def passage_rules(spark, d):
    """A rule per benchmark passage, its longer words the keywords, every other one between word borders."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 4))
    rows = table(spark, d, "benchmark").select(F.col("item_id").cast("int").alias("rule"), F.explode(words).alias("word"))
    return rows.select("rule", F.lit("categorie").alias("kind"), F.concat(F.lit("p"), "rule").alias("name"), F.col("rule").alias("rank"), F.lit("woord").alias("part"), "word", (F.length("word") % 2 == 0).alias("whole"), F.lit(False).alias("broad"), F.lit("text").alias("scope"))


def passage_words(spark, d):
    """Per document and passage how many of the passage's words the document holds, from 5 on."""
    out = T.matched(documents(spark, d).select("doc_id", "title", "text"), passage_rules(spark, d))
    return out.select("doc_id", F.explode("matches").alias("m")).select("doc_id", F.col("m.name").alias("passage"), F.col("m.n").cast("long").alias("n")).where("n >= 5")


PASSAGE_SQL = """
WITH r AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 4))) AS word FROM benchmark),
w AS (SELECT word, length(word) % 2 = 0 AS whole, list(item_id) AS items FROM r GROUP BY word),
d AS (SELECT doc_id, lower(text) AS low FROM documents), t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(low, '[a-z0-9_]+'))) AS word FROM d),
h AS (SELECT doc_id, items FROM t JOIN w USING (word) WHERE whole UNION ALL SELECT doc_id, items FROM d JOIN w ON NOT whole AND contains(low, word))
SELECT doc_id, 'p' || i AS passage, count(*) AS n FROM (SELECT doc_id, unnest(items) AS i FROM h) GROUP BY ALL HAVING count(*) >= 5
"""


MINISTRY, STEMS, BARRED = "Ministerie van Financiën", ("heit", "ción"), ("lytion",)


def ministry_bypass(spark, d):
    """The gate with a way round it: documents of a ministry's that hold a stem outside its name and nothing barred."""
    rows = documents(spark, d).withColumn("tag", F.when(F.length("text") % 3 == 0, MINISTRY)).withColumn("text", F.concat(F.lit(MINISTRY + ". "), "text"))
    rows = rows.withColumn("bypassed", K.bypass(F.col("tag"), F.col("text"), MINISTRY, STEMS, BARRED))
    return K.relevance(rows, SAMPLE, passed=F.col("bypassed")).select("doc_id", "bypassed", "corroborated", "relevant")


def _bypass_sql() -> str:
    rest = f"replace(lower('{MINISTRY}. ' || text), '{MINISTRY.lower()}', ' ')"
    by = f"(length(text) % 3 = 0 AND {K.any_sql(rest, STEMS)} AND NOT {K.any_sql('lower(text)', BARRED)})"
    return f"""
WITH r AS ({_relevance_sql()}), b AS (SELECT doc_id, {by} AS bypassed FROM documents)
SELECT doc_id, bypassed, corroborated OR bypassed AS corroborated, (keyword OR audience OR signal OR bypassed) AND (corroborated OR bypassed) AND NOT barred AS relevant FROM r JOIN b USING (doc_id)
"""


def tiers(spark, d):
    tier, reason = K.tier(F.col("title"), F.col("text"), SAMPLE)
    return documents(spark, d).select("doc_id", tier.alias("tier"), reason.alias("reason"))


def _tiers_sql() -> str:
    s = SAMPLE
    plain = lambda c: f"replace(lower({c}), '-', ' ')"
    words = lambda w: [x.lower().replace("-", " ") for x in w]
    by = K.scores_sql("whole", s)
    strong, comp, gen = (K.any_sql(plain("whole"), words(w)) for w in (s.strong, s.comparisons, s.general))
    signs = f"({K.any_sql(plain('title'), words(s.strong))} OR {K.any_sql(plain('title'), words(s.comparisons))} OR ({' + '.join(K.scores_sql('title', s).values())}) > 0)"
    steps = [
        (f"({' + '.join(by.values())}) = 0", "afgewezen", "geen categorie"),
        ("definition AND NOT strong AND NOT comp", "afgewezen", "alleen definitie"),
        ("gen AND NOT strong AND NOT comp", "afgewezen", "algemeen onderwerp"),
        (f"(strong OR comp) AND NOT {signs}", "twijfel", "titel zonder signaal"),
        ("strong", "hoog", "sterk trefwoord"),
        ("comp", "hoog", "vergelijking"),
        (f"({' + '.join(e for c, e in by.items() if c != s.legal_form)}) = 0", "afgewezen", "alleen rechtsvorm"),
    ]
    case = lambda k, last: "CASE " + " ".join(f"WHEN {x[0]} THEN '{x[k]}'" for x in steps) + f" ELSE '{last}' END"
    return f"""
WITH t AS (SELECT doc_id, {C.sql_title('text')} AS title, concat_ws(' ', {C.sql_title('text')}, text) AS whole FROM documents),
f AS (SELECT *, {strong} AS strong, {comp} AS comp, {gen} AS gen, regexp_matches(trim(whole), '(?i)^wat is (?:een|de|het)\\b') AS definition FROM t)
SELECT doc_id, {case(1, 'twijfel')} AS tier, {case(2, 'brede treffer')} AS reason FROM f
"""


QUERIES = {"category_scores": category_scores, "relevance": relevance, "relevance_by_table": relevance_by_table, "passage_words": passage_words, "ministry_bypass": ministry_bypass, "tiers": tiers}
SQL = {"category_scores": SCORES_SQL, "relevance": _relevance_sql(), "relevance_by_table": _relevance_sql(), "passage_words": PASSAGE_SQL, "ministry_bypass": _bypass_sql(), "tiers": _tiers_sql()}
