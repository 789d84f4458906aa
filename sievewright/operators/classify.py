"""Relevance and category by rule tables: boolean and string columns of one projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.rules import Rules, Term
from sievewright.functions.text import any_of, contains_keyword, squeeze


def scores(text: Column, rules: Rules, without: tuple[str, ...] = ()) -> dict[str, Column]:
    """Per category, the number of its keywords that the text holds."""
    lower = F.lower(text)
    return _summed({w: contains_keyword(lower, w, w in rules.whole_words) for words in rules.categories.values() for w in words}, rules, without)


def _summed(found: dict[str, Column], rules: Rules, without: tuple[str, ...] = ()) -> dict[str, Column]:
    return {c: reduce(lambda a, b: a + b, [found[w].cast("int") for w in words if w not in without], F.lit(0)) for c, words in rules.categories.items()}


def best_category(text: Column, rules: Rules, hint: Column | None = None) -> Column:
    """The category of the highest score, the first of equals; without a score the hint, then the default."""
    return _best(scores(text, rules), rules, hint)


def _best(by: dict[str, Column], rules: Rules, hint: Column | None) -> Column:
    top = F.greatest(*by.values())
    picked = reduce(lambda rest, c: F.when(by[c] == top, c).otherwise(rest), reversed(by), F.lit(None).cast("string"))
    fallback = F.lit(rules.default) if hint is None else F.coalesce(hint, F.lit(rules.default))
    return F.when(top > 0, picked).otherwise(fallback)


def audiences(text: Column, rules: Rules) -> Column:
    return _audiences(F.lower(text), rules)


def _audiences(lower: Column, rules: Rules) -> Column:
    return F.array_compact(F.array(*[F.when(any_of(lower, words), F.lit(a)) for a, words in rules.audiences.items()]))


def priority(text: Column, published: Column, now: Column, rules: Rules) -> Column:
    """belangrijk by keyword, actueel within 14 days (dates to come count too), else praktisch."""
    return _priority(any_of(F.lower(text), rules.important), published, now)


def _priority(important: Column, published: Column, now: Column) -> Column:
    recent = published.isNotNull() & (published >= now - F.expr("INTERVAL 14 DAYS"))
    return F.when(important, "belangrijk").when(recent, "actueel").otherwise("praktisch")


def term(text: Column, rule: Term) -> Column:
    """Every ``all`` and one ``any`` term; a rule without terms never matches."""
    return _term(squeeze(F.lower(text)), rule)


def _term(low: Column, rule: Term) -> Column:
    if not rule.all and not rule.any:
        return F.lit(False)
    out = reduce(lambda a, t: a & (F.instr(low, t) > 0), rule.all, F.lit(True))
    return out & any_of(low, rule.any) if rule.any else out


def signal(text: Column, rules: Rules) -> Column:
    return reduce(lambda a, r: a | term(text, r), rules.signals, F.lit(False))


def signal_category(text: Column, rules: Rules) -> Column:
    """The category of the first matching rule that has one."""
    return reduce(lambda rest, r: F.when(term(text, r), r.category).otherwise(rest), [r for r in reversed(rules.signals) if r.category], F.lit(None).cast("string"))


def excluded(title: Column, text: Column, rules: Rules) -> Column:
    out = F.lit(False)
    for r in rules.exclusions:
        out = out | (term(title if r.scope == "title" else text, r) & ~any_of(squeeze(F.lower(text)), r.unless))
    return out


def bypass(tag: Column, text: Column, wanted: str, stems: tuple[str, ...], barred: tuple[str, ...]) -> Column:
    """A page of the wanted ministry passes if a stem occurs outside the ministry's name and no barred term does."""
    rest = F.replace(F.lower(text), F.lit(wanted.lower()), F.lit(" "))
    return F.coalesce(tag == wanted, F.lit(False)) & any_of(rest, stems) & ~any_of(F.lower(text), barred)


def relevance(docs: DataFrame, rules: Rules, title: str = "title", text: str = "text", passed: Column | None = None, filed: tuple[Column, Column] | None = None) -> DataFrame:
    """The rows with keyword, audience, signal, corroborated, barred, relevant and hint.

    With ``filed``, a date of publication and the present, also category, audiences and priority. The
    lower-case text, its squeezed form and each keyword's test are columns of their own, made once.
    """
    words = list(dict.fromkeys(w for ws in rules.categories.values() for w in ws))
    out = docs.withColumn("_low", F.lower(text)).withColumn("_sq", squeeze(F.col("_low")))
    low, squeezed = F.col("_low"), F.col("_sq")
    found = F.array(*[contains_keyword(low, w, w in rules.whole_words) for w in words])
    terms = F.array(*[_term(squeezed, r) for r in rules.signals])
    out = out.withColumns({"_kw": found, "_who": _audiences(low, rules), "_sig": terms})
    hits = {w: F.get("_kw", k) for k, w in enumerate(words)}
    total = reduce(lambda a, b: a + b, _summed(hits, rules).values())
    narrow = reduce(lambda a, b: a + b, _summed(hits, rules, rules.broad).values())
    out = out.withColumns({"keyword": total > 0, "audience": F.size("_who") > 0, "signal": F.array_contains("_sig", True) if rules.signals else F.lit(False), "bypassed": F.lit(False) if passed is None else passed})
    out = out.withColumn("corroborated", (narrow > 0) | F.col("bypassed") | F.col("audience") | F.col("signal"))
    barred = F.lit(False)
    for r in rules.exclusions:
        barred = barred | (_term(squeeze(F.lower(title)) if r.scope == "title" else squeezed, r) & ~any_of(squeezed, r.unless))
    out = out.withColumn("barred", barred)
    gate = F.col("keyword") | F.col("bypassed") | F.col("audience") | F.col("signal")
    hint = reduce(lambda rest, k: F.when(F.get("_sig", k), rules.signals[k].category).otherwise(rest), [k for k in reversed(range(len(rules.signals))) if rules.signals[k].category], F.lit(None).cast("string"))
    out = out.withColumns({"relevant": gate & F.col("corroborated") & ~F.col("barred"), "hint": hint})
    if filed:
        out = out.withColumns({"category": _best(_summed(hits, rules), rules, F.col("hint")), "audiences": F.col("_who"), "priority": _priority(any_of(low, rules.important), *filed)})
    return out.drop("_low", "_sq", "_kw", "_who", "_sig")


def tier(title: Column, text: Column, rules: Rules) -> tuple[Column, Column]:
    """(tier, reason): afgewezen, twijfel or hoog; hoog needs a signal in the title itself."""
    whole = F.concat_ws(" ", title, text)
    plain = _plain(F.lower(whole))
    return _tier(title, F.trim(whole), *(any_of(plain, _words(w)) for w in (rules.strong, rules.comparisons, rules.general)), scores(whole, rules), rules)


def tiered(rows: DataFrame, rules: Rules, name: str = "strength", title: str = "title", text: str = "text") -> DataFrame:
    """The rows with ``tier``'s tier; the lower-case text and each keyword's test are columns of their own, made once."""
    keys = list(dict.fromkeys(w for ws in rules.categories.values() for w in ws))
    out = rows.withColumn("_whole", F.concat_ws(" ", title, text)).withColumn("_low", F.lower("_whole"))
    out = out.withColumns({"_kw": F.array(*[contains_keyword(F.col("_low"), w, w in rules.whole_words) for w in keys]), "_plain": _plain(F.col("_low"))})
    out = out.withColumns({f"_{k}": any_of(F.col("_plain"), _words(w)) for k, w in (("strong", rules.strong), ("comparison", rules.comparisons), ("general", rules.general))})
    by = _summed({w: F.get("_kw", k) for k, w in enumerate(keys)}, rules)
    kept = out.withColumn(name, _tier(F.col(title), F.trim("_whole"), F.col("_strong"), F.col("_comparison"), F.col("_general"), by, rules)[0])
    return kept.drop("_whole", "_low", "_kw", "_plain", "_strong", "_comparison", "_general")


def _plain(low: Column) -> Column:
    return F.replace(low, F.lit("-"), F.lit(" "))


def _words(words) -> tuple[str, ...]:
    return tuple(x.lower().replace("-", " ") for x in words)


def _tier(title: Column, whole: Column, strong: Column, comparison: Column, general: Column, by: dict[str, Column], rules: Rules) -> tuple[Column, Column]:
    matched = reduce(lambda a, b: a + b, by.values())
    other = reduce(lambda a, b: a + b, [s for c, s in by.items() if c != rules.legal_form], F.lit(0))
    definition = whole.rlike(r"(?i)^wat is (?:een|de|het)(?![A-Za-z0-9_])")
    head = _plain(F.lower(title))
    signs = any_of(head, _words(rules.strong)) | any_of(head, _words(rules.comparisons)) | (reduce(lambda a, b: a + b, scores(title, rules).values()) > 0)
    steps = [
        (matched == 0, "afgewezen", "geen categorie"),
        (definition & ~strong & ~comparison, "afgewezen", "alleen definitie"),
        (general & ~strong & ~comparison, "afgewezen", "algemeen onderwerp"),
        ((strong | comparison) & ~signs, "twijfel", "titel zonder signaal"),
        (strong, "hoog", "sterk trefwoord"),
        (comparison, "hoog", "vergelijking"),
        (other == 0, "afgewezen", "alleen rechtsvorm"),
    ]
    pick = lambda k, last: reduce(lambda rest, s: F.when(s[0], s[k]).otherwise(rest), reversed(steps), F.lit(last))
    return pick(1, "twijfel"), pick(2, "brede treffer")


# The same rules as SQL expressions.


def _has(low: str, word: str, whole: bool) -> str:
    w = word.replace("'", "''")
    return f"regexp_matches({low}, '(^|[^A-Za-z0-9_]){w}($|[^A-Za-z0-9_])')" if whole else f"contains({low}, '{w}')"


def any_sql(low: str, words, whole=()) -> str:
    return "(" + " OR ".join([_has(low, w, w in whole) for w in words] or ["false"]) + ")"


def scores_sql(text: str, rules: Rules, without=()) -> dict[str, str]:
    low = f"lower({text})"
    return {c: "(" + " + ".join([f"{_has(low, w, w in rules.whole_words)}::INT" for w in words if w not in without] or ["0"]) + ")" for c, words in rules.categories.items()}


def best_category_sql(text: str, rules: Rules, hint: str = "NULL") -> str:
    by = scores_sql(text, rules)
    top = f"greatest({', '.join(by.values())})"
    return f"CASE WHEN {top} = 0 THEN coalesce({hint}, '{rules.default}') " + " ".join(f"WHEN {s} = {top} THEN '{c}'" for c, s in by.items()) + " END"


def term_sql(text: str, rule: Term) -> str:
    if not rule.all and not rule.any:
        return "false"
    low = f"trim(regexp_replace(lower({text}), '\\s+', ' ', 'g'))"
    return "(" + " AND ".join([_has(low, w, False) for w in rule.all] + ([any_sql(low, rule.any)] if rule.any else [])) + ")"


def tier_sql(rules: Rules, title: str = "title", whole: str = "whole") -> tuple[str, str]:
    """The tier and its reason, ``whole`` being title and text."""
    plain = lambda c: f"replace(lower({c}), '-', ' ')"
    words = lambda w: [x.lower().replace("-", " ") for x in w]
    by = scores_sql(whole, rules)
    strong, comparison, general = (any_sql(plain(whole), words(w)) for w in (rules.strong, rules.comparisons, rules.general))
    signs = f"({any_sql(plain(title), words(rules.strong))} OR {any_sql(plain(title), words(rules.comparisons))} OR ({' + '.join(scores_sql(title, rules).values())}) > 0)"
    steps = [
        (f"({' + '.join(by.values())}) = 0", "afgewezen", "geen categorie"),
        (f"regexp_matches(trim({whole}), '(?i)^wat is (?:een|de|het)\\b') AND NOT {strong} AND NOT {comparison}", "afgewezen", "alleen definitie"),
        (f"{general} AND NOT {strong} AND NOT {comparison}", "afgewezen", "algemeen onderwerp"),
        (f"({strong} OR {comparison}) AND NOT {signs}", "twijfel", "titel zonder signaal"),
        (strong, "hoog", "sterk trefwoord"),
        (comparison, "hoog", "vergelijking"),
        (f"({' + '.join(e for c, e in by.items() if c != rules.legal_form)}) = 0", "afgewezen", "alleen rechtsvorm"),
    ]
    case = lambda k, last: "CASE " + " ".join(f"WHEN {x[0]} THEN '{x[k]}'" for x in steps) + f" ELSE '{last}' END"
    return case(1, "twijfel"), case(2, "brede treffer")
