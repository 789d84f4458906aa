"""Text and key expressions: every function takes and gives Columns, so Catalyst sees all of it."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievewright.functions import rules as R

_FOLDED = {c: b for c in map(chr, range(0xC0, 0x250)) if len(b := unicodedata.normalize("NFD", c)[0]) == 1 and b != c and b.isascii()}
_FOLDED |= {c: b for c in map(chr, range(0x1E00, 0x1F00)) if (b := unicodedata.normalize("NFD", c)[0]) != c and b.isascii()}
#: Java's \s leaves out the no-break space and its kin.
SPACE = r"[\s\x{00A0}\x{202F}\x{2007}\x{FEFF}]"
#: Unicode's space separators.
SEPARATORS = "".join(c for c in map(chr, range(0x3001)) if unicodedata.category(c) == "Zs")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("CAST(array() AS array<string>)")


def once(c: Column, f) -> Column:
    """``f`` of a value that is made once, however often ``f`` names it, also inside functions of arrays."""
    return F.get(F.transform(F.array(c), f), 0)


def fold(c: Column) -> Column:
    """Lower case without accents; only texts beyond ASCII pay for the table."""
    bare = lambda x: F.regexp_replace(F.translate(x, "".join(_FOLDED), "".join(_FOLDED.values())), r"[\x{0300}-\x{036F}]", "")
    # a list of one, so that what is tested is made once
    return F.get(F.transform(F.array(F.lower(c)), lambda x: F.when(F.octet_length(x) == F.length(x), x).otherwise(bare(x))), 0)


def squeeze(c: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def url_parts(url: Column) -> dict[str, Column]:
    pattern = r"^\s*([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?([^/:?#]+)(?::([0-9]+))?([^?#]*)(\?[^#]*)?(?:#.*)?$"
    return {n: F.regexp_extract(url, pattern, k) for k, n in enumerate(("scheme", "host", "port", "path", "query"), 1)}


def url_key(url: Column) -> Column:
    """https, lower-case host, no fragment, default port or trailing slashes; blank gives '', no URL itself trimmed."""
    p = url_parts(url)
    port = F.when(p["port"].isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), p["port"]))
    key = F.concat(F.lit("https://"), F.lower(p["host"]), port, F.regexp_replace(p["path"], "/+$", ""), p["query"])
    return F.when(F.trim(F.coalesce(url, F.lit(""))) == "", "").when(p["host"] == "", F.trim(url)).otherwise(key)


def path_segments(url: Column) -> Column:
    return F.filter(F.split(url_parts(url)["path"], "/"), lambda x: x != "")


def first_segment(url: Column) -> Column:
    return F.coalesce(F.lower(F.get(path_segments(url), 0)), F.lit(""))


def path_text(url: Column) -> Column:
    """The path's words; '' where the URL is none."""
    return squeeze(F.regexp_replace(url_parts(url)["path"], "[/_.-]+", " "))


def slug(c: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def raw_words(c: Column, folded: Column | None = None) -> Column:
    return F.regexp_extract_all(fold(c) if folded is None else folded, F.lit("[a-z0-9]+"), F.lit(0))


def tokens(c: Column, stop=R.QUESTION_STOP, raw: Column | None = None) -> Column:
    """Words of two characters or more that are no stop words, in order, repeats kept."""
    return F.filter(raw_words(c) if raw is None else raw, lambda w: (F.length(w) >= 2) & ~w.isin(*stop))


def split_words(folded: Column) -> Column:
    """The words of a folded text, hyphens inside."""
    return F.regexp_extract_all(folded, F.lit("[a-z0-9-]+"), F.lit(0))


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def significant_words(c: Column, split: Column | None = None) -> Column:
    """Words of a title with plural endings cut."""
    stem = lambda w: F.when((F.length(w) > 6) & w.endswith("en"), _cut(w, 2)).when((F.length(w) > 5) & w.endswith("s") & ~w.endswith("ss"), _cut(w, 1)).otherwise(w)
    words = split_words(fold(c)) if split is None else split
    return F.transform(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*R.TITLE_STOP)), stem)


def detail_words(c: Column, split: Column | None = None) -> Column:
    """Words of a text with plural endings cut and doubled vowels folded."""
    stem = lambda w: F.when((F.length(w) > 6) & w.endswith("en"), _cut(w, 2)).when((F.length(w) > 5) & w.endswith("s"), _cut(w, 1)).otherwise(w)
    words = split_words(fold(normal(c))) if split is None else split
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*R.DETAIL_STOP))
    return F.transform(kept, lambda w: F.regexp_replace(stem(w), r"([aeou])\1", "$1"))


def title_words(c: Column, folded: Column | None = None) -> Column:
    """The distinct words of a title that have three characters or more; ``folded`` is its normal form without accents."""
    words = raw_words(c, fold(normal(c)) if folded is None else folded)
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))


def normal(c: Column) -> Column:
    """No-break spaces and white space as one space, lower case; ends stay."""
    # single spaces, nearly all there is, are no match, and so not replaced by themselves
    return F.lower(F.regexp_replace(F.replace(c, F.lit("&nbsp;"), F.lit(" ")), f"{SPACE}{{2,}}|(?! ){SPACE}", " "))


def canonical_number(n: Column) -> Column:
    """Dutch thousands dots and decimal comma to a plain number; a zero fraction goes."""
    bare = F.regexp_replace(n, r"\s", "")
    thousands = F.replace(F.regexp_replace(bare, r"\.", ""), F.lit(","), F.lit("."))
    out = F.when(bare.rlike(r"^\d{1,3}(\.\d{3})+(,\d+)?$"), thousands).when(bare.rlike(r"^\d+,\d+$"), F.replace(bare, F.lit(","), F.lit("."))).otherwise(bare)
    return F.regexp_replace(out, r"\.0+$", "")


def sentences(c: Column) -> Column:
    # trim itself takes two arguments: named alone it would get each sentence's place as the characters to trim
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s, F.lit(SEPARATORS))), lambda s: s != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays taken as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def _month(name: Column) -> Column:
    return F.array_position(_strings(R.MONTHS), F.lower(name)).cast("int")


def _dates(text: Column, lead: str) -> Column:
    """Dates after ``lead``; without day and month, 1 January. A day past the month's end runs on into the next."""
    pattern = rf"(?i)(?<![A-Za-z0-9_]){lead}(?:(\d{{1,2}})\s+({'|'.join(R.MONTHS)})\s+)?(20\d{{2}})(?![A-Za-z0-9_])"
    parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(n) for k, n in enumerate("dmy", 1)])
    first = lambda x: F.make_date(x["y"].cast("int"), F.when(x["m"] == "", 1).otherwise(_month(x["m"])), F.lit(1))
    return F.transform(parts, lambda x: F.date_add(first(x), F.when(x["d"] == "", 1).otherwise(x["d"].try_cast("int")) - 1))


def future_effective_date(text: Column, now: Column) -> Column:
    """The first date introduced as one of effect that lies after ``now``, else null."""
    return F.get(F.filter(_dates(text, r"(?:per|vanaf|met ingang van|ingaat op|in werking op)\s+"), lambda d: d.cast("timestamp") > now), 0)


def future_dates(sentence: Column, now: Column) -> Column:
    return F.filter(_dates(sentence, ""), lambda d: d.cast("timestamp") > now)


def years(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<![A-Za-z0-9_])(20\d{2})(?![A-Za-z0-9_])"), F.lit(1)), lambda y: y.cast("int"))


YEAR = r"(?<![A-Za-z0-9_])20\d{2}(?![A-Za-z0-9_])"


def topic_words(c: Column, split: Column | None = None) -> Column:
    """The distinct significant words of a title without years and numbers; ``split`` are its words, years already out."""
    words = significant_words(F.regexp_replace(c, YEAR, " ") if split is None else c, split)
    return F.array_distinct(F.filter(words, lambda w: ~w.rlike(r"^\d+$")))


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4).cast("long")


def _ends(text: Column, last: bool) -> Column:
    """Places where a sentence ends, as counts of characters from the start."""
    after = r"(?=\s|$)" if last else r"(?=\s)"
    parts = F.regexp_extract_all(text, F.lit(rf"(?s).*?[.!?][\x{{201D}}\"\x{{2019}}')]?{after}"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<at:int,tail:string>>)").alias("out"))

    def step(acc, p):
        at = acc["at"] + F.length(p)
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("at"), F.substring(text, F.greatest(at - 11, F.lit(1)), F.least(at, F.lit(12))).alias("tail")))).alias("out"))

    short = "|".join(a.replace(".", r"\.") for a in R.ABBREVIATIONS)
    ends = F.aggregate(parts, start, step, lambda acc: acc["out"])
    return F.transform(F.filter(ends, lambda e: ~e["tail"].rlike(rf"(?i)(?:^|\s)(?:{short})\.$")), lambda e: e["at"])


def truncate_sentence(text: Column, most: int) -> Column:
    """Up to the last sentence end within ``most`` characters, abbreviations left out; null without one."""
    cut = lambda t: once(F.substring(t, 1, most + 1), lambda head: F.array_max(F.filter(_ends(head, True), lambda e: e <= most)))
    shorter = lambda t: once(cut(t), lambda at: F.when(at > 0, F.rtrim(F.substring(t, F.lit(1), at))))
    return once(text, lambda t: F.when(F.length(t) <= most, t).otherwise(shorter(t)))


def truncate_boundary(text: Column, most: int) -> Column:
    """Up to the last sentence end, unless that loses over half; then to the last space; then hard."""
    def cut(head):
        end = F.coalesce(F.array_max(F.filter(_ends(head, False), lambda e: e <= most)), F.lit(-1))
        space = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
        return once(end, lambda e: F.when(e >= most / 2, e).when(space > 0, space).otherwise(most))

    shorter = lambda t: F.rtrim(F.substring(t, F.lit(1), once(F.substring(t, 1, most + 1), cut)))
    return once(text, lambda t: F.when(F.length(t) <= most, t).otherwise(shorter(t)))


def plain_body(body: Column) -> Column:
    """Text of a markdown body: a line per block, escapes undone."""
    lines = F.transform(F.split(body, r"\n\s*\n"), lambda b: F.regexp_replace(squeeze(b), r"^\\(?=[#*_=<-])", ""))
    return F.replace(F.replace(F.array_join(F.filter(lines, lambda b: b != ""), "\n"), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))


def dutch_date(d: Column) -> Column:
    return F.when(d.isNotNull(), F.concat_ws(" ", F.day(d).cast("string"), F.element_at(_strings(R.MONTHS), F.month(d)), F.year(d).cast("string")))


def short_date(d: Column) -> Column:
    return F.when(d.isNotNull(), F.concat_ws(" ", F.day(d).cast("string"), F.substring(F.element_at(_strings(R.MONTHS), F.month(d)), 1, 3), F.year(d).cast("string")))


def month_label(d: Column) -> Column:
    return F.when(d.isNotNull(), F.concat_ws(" ", F.initcap(F.element_at(_strings(R.MONTHS), F.month(d))), F.year(d).cast("string")))


def source_label(name: Column, published: Column, superseded: Column) -> Column:
    """The name with its date in Amsterdam, and ``historisch`` if a successor replaced it."""
    extra = F.concat(F.date_format(F.from_utc_timestamp(published, "Europe/Amsterdam"), "dd-MM-yyyy"), F.when(superseded, ", historisch").otherwise(""))
    inside = F.concat(F.regexp_replace(name, r"\)$", ""), F.lit(", "), extra, F.lit(")"))
    return F.when(published.isNull(), name).when(name.endswith(")"), inside).otherwise(F.concat(name, F.lit(" ("), extra, F.lit(")")))


def redact_secrets(c: Column, key: str = "") -> Column:
    """A known key, keys by their form, and authorisation values replaced."""
    out = F.replace(c, F.lit(key), F.lit("[VERWIJDERD]")) if len(key) >= 8 else c
    out = F.regexp_replace(out, r"(?i)\b(?:sk|gsk|key|token)[_-][a-z0-9_-]{8,}", "[VERWIJDERD]")
    out = F.regexp_replace(out, r"(?i)authorization\s*[:=]\s*[^\s\"',}]+(?:\s+[^\s\"',}]+)?", "authorization: [VERWIJDERD]")
    return F.regexp_replace(out, r"(?i)bearer\s+[^\s\"',}]+", "Bearer [VERWIJDERD]")


def scrub_tags(c: Column, tags=("bronnen", "systeem")) -> Column:
    return F.regexp_replace(c, rf"(?i)</?(?:{'|'.join(tags)})>", "")


def card_text(c: Column, most: int = 155, cut: int = 152) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, cut), F.lit("…"))).otherwise(c)


def contains_keyword(lower: Column, keyword: str, whole: bool) -> Column:
    """Substring match, or a match between ASCII word borders for ``whole`` keywords."""
    if not whole:
        return F.instr(lower, keyword) > 0
    return lower.rlike(rf"(?<![A-Za-z0-9_])\Q{keyword}\E(?![A-Za-z0-9_])")


def any_of(lower: Column, words, whole=()) -> Column:
    return reduce(lambda a, b: a | b, [contains_keyword(lower, w, w in whole) for w in words], F.lit(False))
