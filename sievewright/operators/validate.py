"""Checks of an article against its source: columns of one joined row, errors and warnings as arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import rules as R
from sievewright.functions import text as X

_NUM = r"\d[\d.,]*\d|\d"
_MONTH = "|".join(R.MONTHS)
# Words of a text that leaves open what it tells.
TENTATIVE_WORDS = r"(?i)voorstel|voorgesteld|consultatie|voornemen|\bplan\b|plannen|\bwil\b|willen|nog niet|nog geen|wetsvoorstel|als het parlement|na goedkeuring|zou|zouden"
# Wordings that claim that something is in force.
IN_FORCE = r"(?i)\b(?:is|zijn) (?:nu |inmiddels |al )?van kracht\b|\bgeldt (?:al|inmiddels|sinds)\b|\bis ingegaan\b|\bzijn ingegaan\b|\bis in werking getreden\b|\bzijn in werking getreden\b"
# Words of a source that tells of a proposal.
SOURCE_TENTATIVE = "(?i)wetsvoorstel|internetconsultatie|voornemen|kabinet wil|voorgesteld"
# Words of a source that tells of what holds.
SOURCE_DEFINITE = "(?i)aangenomen|in werking getreden|van kracht|staatsblad|geldt sinds|is ingegaan|geldt vanaf|gaat in op"
# Wordings of the past or the present.
AS_PAST = r"(?i)\bsinds\b|\bis ingegaan\b|\bzijn ingegaan\b|\bgeldt al\b|\bis in werking getreden\b|\bgold\b"
# The form of a reference to a law.
LEGAL = r"\bartikel\s+\d+[a-z]?(?:[.:]\d+[a-z]?)*(?:\s+lid\s+\d+)?(?:\s+(?:van\s+)?(?:het|de))?\s+(?:burgerlijk wetboek|bw|wet\s+[a-z][a-z -]{2,40}?|awr|awb)\b"
# The form of a term.
WITHIN = r"\bbinnen\s+(?:\d+|een|twee|drie|vier|vijf|zes|acht|tien|twaalf)\s+(?:dagen|dag|weken|week|maanden|maand|jaar)\b"
# Words of a procedure.
PROCEDURE = r"(?i)aanvra(?:ag|gen)|aanvraagt|\bvraagt\b[^.]*\baan\b|indienen|ingediend|\b(?:dient|dienen)\b[^.]*\bin\b|deponeren|gedeponeerd|melden|aanmelden|inschrijven"
# Public authorities, with their short names.
AUTHORITIES = (
    ("rijksdienst voor ondernemend nederland", "rvo"), ("belastingdienst",), ("kamer van koophandel", "kvk"), ("uwv",), ("douane",), ("dienst uitvoering onderwijs", "duo"),
    ("autoriteit persoonsgegevens",), ("autoriteit financiële markten", "afm"), ("de nederlandsche bank", "dnb"), ("gemeente",),
)
# Wordings that leave a group out.
EXCLUSION = r"(?i)\b(?:hoeft|hoeven|hoef)\b[^.]*\bniet\b|\bniet\b[^.]*\b(?:verplicht|nodig)\b|\bgeldt\b[^.]*\bniet\b|\bvrijgesteld\b|\buitgezonderd\b|\bniet van toepassing\b"
# Words one of which stands wherever the pattern of the same name is met; they are sought first, in the normal form.
IN_TENTATIVE_WORDS = ("voorstel", "voorgesteld", "consultatie", "voornemen", "plan", "wil", "nog ", "parlement", "goedkeuring", "zou")
IN_IN_FORCE = ("kracht", "geldt", "ingegaan", "getreden")
IN_EXCLUSION = ("niet", "vrijgesteld", "uitgezonderd")
IN_CLAIMS = (("geldt ",), ("momenteel", "op dit moment", "thans"), ("geldende ",), ("actueel",))
# Claims that something holds now.
CLAIMS = (
    r"\bgeldt (?:momenteel|op dit moment|nu|thans)\b",
    r"\b(?:is|zijn) (?:momenteel|op dit moment|thans) (?:van kracht|geldig|actueel|van toepassing)\b",
    r"\bgeldende (?:regelgeving|wetgeving|regels?)\b",
    r"\b(?:is|zijn) (?:nog steeds |nog altijd )?actueel\b",
)
#: A word that denies, at most one word before the claim.
DENIED = r"(?<!\b(?:geen|niet)\s{1,3}(?:\S{1,20}\s{1,3})?)"
QUALIFIER = r"(?i)(?<![\p{L}\d])([^.;:\n]{6,90}?)\s+(?:die|waarvan|waarbij|mits|tenzij|indien|als|wanneer|alleen als)\s+([^.;\n]{8,200})"


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _none(of: str) -> Column:
    return F.array().cast(f"array<{of}>")


def _any(plain: Column, words: tuple[str, ...]) -> Column:
    """Whether a word stands in the text; far cheaper than a pattern, which is then asked only of texts that have one."""
    return reduce(lambda a, b: a | b, [plain.contains(w) for w in words])


def facts(text: Column, plain: Column | None = None) -> dict[str, Column]:
    """Distinct amounts, percentages, dates and years of a text, numbers in canonical form; ``plain`` is the text in normal form, if known."""
    t = X.normal(text) if plain is None else plain
    amounts = F.concat(_all(t, rf"€\s?({_NUM})", 1), _all(t, rf"({_NUM})\s?(?:euro\b|miljoen\b|miljard\b)", 1))
    dates = _all(t, rf"(?<![a-z0-9_])\d{{1,2}}\s+(?:{_MONTH})(?![a-z0-9_])")
    return {
        "amount": F.array_distinct(F.transform(amounts, X.canonical_number)),
        "percentage": F.array_distinct(F.transform(_all(t, rf"({_NUM})\s?(?:%|procent\b)", 1), X.canonical_number)),
        "date": F.array_distinct(F.transform(dates, lambda d: F.regexp_replace(F.regexp_replace(d, r"\s+", " "), "^0", ""))),
        "year": F.array_distinct(_all(t, r"(?<![a-z0-9_])(?:19|20)\d{2}(?![a-z0-9_])")),
    }


def numbers(text: Column, plain: Column | None = None) -> Column:
    return F.array_distinct(F.transform(_all(X.normal(text) if plain is None else plain, _NUM), X.canonical_number))


def tagged(values: dict[str, Column]) -> Column:
    """All values as one array of (kind, value)."""
    mark = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value"))
    return F.concat(*[F.transform(v, mark(k)) for k, v in values.items()])


def supported(source: Column) -> Column:
    """What a source supports, as one value: amounts and any other number, percentages, dates, years, its text in normal form."""
    def told(plain):
        s = facts(plain, plain)
        return F.struct(F.array_union(s["amount"], numbers(plain, plain)).alias("amount"), s["percentage"].alias("percentage"), s["date"].alias("date"), s["year"].alias("year"), plain.alias("plain"))

    return X.once(X.normal(source), told)


def lacking(article: Column, known: Column, plain: Column | None = None) -> Column:
    """(kind, value) of the article's facts that are not among ``known``, what its source supports."""
    def told(plain):
        a = facts(plain, plain)
        missing = {k: F.array_except(a[k], known[k]) for k in a}
        missing["date"] = F.filter(missing["date"], lambda d: F.instr(known["plain"], d) == 0)
        return F.when(~plain.rlike(r"\d"), _none("struct<kind:string,value:string>")).otherwise(tagged(missing))  # every fact has a digit

    return X.once(X.normal(article) if plain is None else plain, told)


def unsupported(article: Column, source: Column) -> Column:
    """(kind, value) of the article's facts that the source has not; any number in the source supports an amount."""
    return X.once(supported(source), lambda known: lacking(article, known))


def undecided(source: Column) -> Column:
    """Whether a source tells of a proposal and of nothing that holds."""
    return source.rlike(SOURCE_TENTATIVE) & ~source.rlike(SOURCE_DEFINITE)


def status_errors(article: Column, status: Column, source: Column, now: Column, known: tuple[str, ...], plain: Column | None = None, undecided_: Column | None = None) -> Column:
    """``plain`` is the article in normal form and ``undecided_`` what is asked of the source, where they are known."""
    plain = X.normal(article) if plain is None else plain
    tentative = status.isin(*R.TENTATIVE)
    late = F.exists(X.sentences(article), lambda s: s.contains("20") & (F.size(X.future_dates(s, now)) > 0) & s.rlike(AS_PAST))
    return F.array_compact(F.array(
        F.when(status.isNotNull() & ~status.isin(*known), "ongeldige status"),
        F.when(tentative & ~(_any(plain, IN_TENTATIVE_WORDS) & article.rlike(TENTATIVE_WORDS)), "voorlopig zonder voorbehoud"),
        F.when(tentative & _any(plain, IN_IN_FORCE) & article.rlike(IN_FORCE), "voorlopig maar geldend genoemd"),
        F.when((status.isNull() | (status == "van-kracht")) & (undecided(source) if undecided_ is None else undecided_), "bron is voorlopig"),
        F.when(article.contains("20") & late, "toekomst als verleden"),
    ))


def claims(article: Column, source: Column, plain: Column | None = None, source_plain: Column | None = None) -> Column:
    """Claims of being in force that the source does not make; normal forms are made unless given."""
    # the claim is looked for first, and only where there is one, what stands before it
    made = lambda a: F.concat(*[F.when(~_any(a, words), _none("string")).otherwise(_all(a, f"(?={c}){DENIED}{c}")) for words, c in zip(IN_CLAIMS, CLAIMS)])
    new = lambda made: F.array_distinct(F.filter(made, lambda c: F.instr(X.normal(source) if source_plain is None else source_plain, c) == 0))
    return X.once(X.normal(article) if plain is None else plain, lambda a: X.once(made(a), new))


def conditions(source: Column) -> Column:
    """Conditions of a source: words of their head (h) and of the rest (q), and the whole."""
    lines = F.split(source, r"\n+|(?<=[.;])\s+")
    heads = F.flatten(F.transform(lines, lambda s: F.arrays_zip(_all(s, QUALIFIER, 1).alias("head"), _all(s, QUALIFIER, 2).alias("rest"), _all(s, QUALIFIER).alias("whole"))))
    last = lambda w: F.slice(w, F.greatest(F.size(w) - 2, F.lit(1)), F.lit(3))
    words = F.transform(heads, lambda x: F.struct(last(X.detail_words(x["head"])).alias("h"), F.filter(F.array_distinct(X.detail_words(x["rest"])), lambda w: F.length(w) > 4).alias("q"), x["whole"].alias("whole"), x["rest"].alias("rest")))
    return F.filter(words, lambda x: (F.size(x["h"]) >= 2) & (F.size(x["q"]) >= 2) & ~x["rest"].rlike(r":\s*$"))


def dropped_qualifiers(article: Column, source: Column, known: Column | None = None) -> Column:
    """Conditions of the source whose head stands in a sentence of the article without half of their words; ``known`` are its ``conditions``."""
    sets = F.transform(X.sentences(article), lambda s: X.detail_words(s))

    def dropped(sets, x):
        hits = F.filter(sets, lambda s: F.forall(x["h"], lambda w: F.array_contains(s, w)))
        return X.once(hits, lambda hits: (F.size(hits) > 0) & ~F.exists(hits, lambda s: F.size(F.array_intersect(x["q"], s)) * 2 >= F.size(x["q"])))

    # the article's sentences are only cut into words where the source has conditions
    found = X.once(conditions(source) if known is None else known, lambda heads: F.when(F.size(heads) > 0, X.once(sets, lambda sets: F.filter(heads, lambda x: dropped(sets, x)))).otherwise(heads))
    return F.array_distinct(F.transform(found, lambda x: F.substring(X.squeeze(F.regexp_replace(x["whole"], r"^[-•*]\s*", "")), 1, 160)))


def _named(names: tuple[str, ...]) -> str:
    return rf"(?i)\b(?:{'|'.join(names)})\b"


def details(source: Column) -> Column:
    """Legal references, terms, and authorities in procedures of a source."""
    def told(s, steps):
        met = F.array(*[F.when(F.exists(steps, lambda x: x.rlike(_named(names))), F.lit(names[0])) for names in AUTHORITIES])
        return F.struct(_all(s, LEGAL).alias("legal"), _all(s, WITHIN).alias("terms"), F.array_compact(met).alias("names"))

    steps = F.transform(F.filter(X.sentences(source), lambda x: x.rlike(PROCEDURE)), X.normal)
    return X.once(F.struct(X.normal(source).alias("s"), steps.alias("steps")), lambda x: told(x["s"], x["steps"]))


def missing_details(article: Column, source: Column, known: Column | None = None) -> Column:
    """Legal references, terms and authorities in procedures that the article leaves out; ``known`` are the source's ``details``."""
    def left_out(a, x):
        legal = F.filter(x["legal"], lambda r: F.instr(a, F.regexp_extract(r, r"artikel\s+\S+", 0)) == 0)
        terms = F.filter(x["terms"], lambda t: F.instr(a, t) == 0)
        names = F.array(*[F.when(F.array_contains(x["names"], n[0]) & ~a.rlike(_named(n)), F.lit(n[0])) for n in AUTHORITIES])
        return F.array_distinct(F.concat(legal, terms, F.array_compact(names)))

    nothing = lambda x: x["legal"].isNotNull() & (F.size(x["legal"]) + F.size(x["terms"]) + F.size(x["names"]) == 0)
    return X.once(details(source) if known is None else known, lambda x: F.when(nothing(x), _none("string")).otherwise(X.once(X.normal(article), lambda a: left_out(a, x))))


def exclusions(text: Column, plain: Column | None = None) -> Column:
    """The words of each sentence that excludes; ``plain`` is the normal form of the text or of one that holds it."""
    sets = F.transform(F.filter(X.sentences(text), lambda s: s.rlike(EXCLUSION)), lambda s: X.detail_words(s))
    return F.when(text.isNotNull() & ~_any(X.normal(text) if plain is None else plain, IN_EXCLUSION), _none("array<string>")).otherwise(sets)


def excluded_audiences(audiences: Column, source: Column, article: Column, keywords: dict[str, tuple[str, ...]], plain: Column | None = None, known: Column | None = None) -> Column:
    """Chosen audiences with a keyword all of whose words stand in a sentence that excludes; ``known`` are the source's ``exclusions``."""
    sets = F.concat(exclusions(source) if known is None else known, exclusions(article, plain))

    def named(sets, words):
        out = F.lit(False)
        for w in words:
            out = out | F.exists(sets, lambda s: F.forall(X.detail_words(F.lit(w)), lambda x: F.array_contains(s, x)))
        return out

    return X.once(sets, lambda sets: F.array_compact(F.array(*[F.when(F.array_contains(audiences, a) & named(sets, w), F.lit(a)) for a, w in keywords.items()])))


def repeats_list(summary: Column, body: Column) -> Column:
    """Whether a sentence of the summary lists four or more parts, three quarters of which the body has."""
    parts = lambda s: F.filter(F.transform(F.split(s, r",|\s+en\s+|\s+of\s+"), lambda s: X.detail_words(s)), lambda p: F.size(p) > 0)
    lists = F.filter(F.transform(X.sentences(summary), parts), lambda parts: F.size(parts) >= 4)

    def had(words, parts):
        same = F.filter(parts, lambda p: F.size(F.filter(p, lambda w: F.array_contains(words, w))) >= F.ceil(F.size(p) / 2))
        return F.size(same) / F.size(parts) >= 0.75

    # the body is only cut into words where the summary has a list
    return X.once(lists, lambda lists: F.when(F.size(lists) > 0, X.once(X.detail_words(body), lambda words: F.exists(lists, lambda parts: had(words, parts)))).otherwise(F.when(summary.isNotNull(), False)))


def known_source(title: Column, text: Column) -> Column:
    """What the check asks of a source, as one value that all its articles share."""
    return F.struct(
        title.alias("title"), supported(F.concat_ws("\n", title, text)).alias("facts"), X.normal(text).alias("plain"), undecided(text).alias("undecided"),
        conditions(text).alias("conditions"), details(text).alias("details"), exclusions(text).alias("exclusions"),
    )


def validated(rows: DataFrame, now: Column, host: str, keywords: dict, statuses=("van-kracht", *R.TENTATIVE), categories: tuple = ()) -> DataFrame:
    """Adds errors, warnings and ok. Rows have title, summary, body, relevance, status, category, audiences,
    source_url, duplicate, and ``known``, which is ``known_source`` of their source."""
    rows = rows.withColumn("_whole", F.concat_ws("\n", "title", "summary", "body", "relevance"))
    rows = rows.withColumn("_plain", X.normal(F.col("_whole")))  # a column of its own, so that it is made once
    whole, plain, known, none = F.col("_whole"), F.col("_plain"), F.col("known"), F.lit(None).cast("string")
    checks = [
        (~X.url_parts(F.col("source_url"))["host"].endswith(host), "bron niet officieel"),
        (F.col("duplicate"), "bron al gebruikt"),
        (~F.length("title").between(20, 120), "titellengte"),
        (~F.length("summary").between(60, 600), "samenvattingslengte"),
        (F.length("body") < 400, "tekst te kort"),
        (F.regexp_count("body", F.lit(r"(?m)^## ")) < 2, "te weinig koppen"),
        (F.col("body").rlike(r"<[a-zA-Z/][^>]*>"), "html in tekst"),
        (F.exists(F.regexp_extract_all("body", F.lit(r"\]\((https?://[^)]+)\)"), F.lit(1)), lambda u: ~X.url_parts(u)["host"].endswith(host)), "vreemde link"),
        (~F.col("category").isin(*categories) if categories else F.lit(False), "onbekende categorie"),
        (X.jaccard(X.title_words(F.col("title")), X.title_words(known["title"])) > 0.75, "titel lijkt te veel op bron"),
    ]
    single = F.array_compact(F.array(*[F.when(c, F.lit(e)) for c, e in checks]))
    facts_ = F.transform(lacking(whole, known["facts"], plain), lambda x: F.concat(x["kind"], F.lit(" "), x["value"]))
    errors = F.concat(single, facts_, status_errors(whole, F.col("status"), none, now, statuses, plain, known["undecided"]))
    warnings = F.concat(
        F.transform(claims(whole, none, plain, known["plain"]), lambda c: F.concat(F.lit("claim: "), c)),
        F.transform(dropped_qualifiers(F.col("body"), none, known["conditions"]), lambda c: F.concat(F.lit("voorwaarde: "), c)),
        F.transform(missing_details(F.col("body"), none, known["details"]), lambda c: F.concat(F.lit("ontbreekt: "), c)),
        F.transform(excluded_audiences(F.col("audiences"), none, F.col("body"), keywords, plain, known["exclusions"]), lambda c: F.concat(F.lit("uitgezonderd: "), c)),
        F.array_compact(F.array(F.when(repeats_list(F.col("summary"), F.col("body")), "samenvatting herhaalt opsomming"))),
    )
    return rows.withColumns({"errors": errors, "warnings": warnings}).withColumn("ok", F.size("errors") == 0).drop("_whole", "_plain")
