"""Pages to clean columns: one projection of native column functions, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import text as X

# Named character references and the characters they stand for.
ENTITIES = {
    "nbsp": " ", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "euro": "€", "ndash": "–", "mdash": "—", "hellip": "…", "bull": "•", "middot": "·",
    "lsquo": "‘", "rsquo": "’", "sbquo": "‚", "ldquo": "“", "rdquo": "”", "bdquo": "„", "laquo": "«", "raquo": "»", "deg": "°", "sect": "§", "copy": "©", "reg": "®", "shy": "",
    "eacute": "é", "egrave": "è", "ecirc": "ê", "euml": "ë", "aacute": "á", "agrave": "à", "auml": "ä", "iacute": "í", "iuml": "ï", "oacute": "ó", "ouml": "ö", "uacute": "ú", "uuml": "ü", "ccedil": "ç",
    "Eacute": "É", "Euml": "Ë", "Iuml": "Ï", "Ouml": "Ö", "Uuml": "Ü",
}
NO_CONTENT = r"(?is)<!--.*?-->|<(script|style|noscript|template|svg|iframe)\b.*?</\1\s*>"
ASIDE = r"(?is)<(nav|aside|header|footer|form|button|dialog)\b.*?</\1\s*>"
FIGURE = r"(?is)<figure\b.*?</figure\s*>"
# What stands around the text of a news page, in HTML: a line of kind, date and time before it, a
# question after it, a heading of documents inside it, and words of the site's own parts.
GAP = r"(?:\s|&nbsp;|&#160;|<[^>]*>)*"
NEWS_START = rf"Nieuwsbericht{GAP}\d{{2}}-\d{{2}}-\d{{4}}{GAP}(?:\||&#124;|&#x7c;){GAP}\d{{2}}:\d{{2}}"
NEWS_END = r"Heeft(?:\s|&nbsp;)+deze(?:\s|&nbsp;)+informatie(?:\s|&nbsp;)+u(?:\s|&nbsp;)+geholpen"
NEWS_STOP = r">\s*(?:Documenten|Bijlagen|Downloads)\s*<"
NEWS_BOILERPLATE = r"(?i)Vul in wat u zoekt|Heeft deze informatie|Terug naar boven|Ga direct naar inhoud"
MINISTRIES = {"ministerie-van-financien": "Ministerie van Financiën"}


def strip_html(c: Column) -> Column:
    """CDATA unwrapped, tags to spaces, six references decoded in this order, white space collapsed."""
    out = F.regexp_replace(c, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    out = F.regexp_replace(out, "<[^>]*>", " ")
    for name, to in (("nbsp", " "), ("amp", "&"), ("quot", '"'), ("#39", "'"), ("lt", "<"), ("gt", ">")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(to))
    return X.squeeze(F.coalesce(out, F.lit("")))


def decode(c: Column) -> Column:
    """Character references decoded once: whatever gives an ampersand comes last."""
    numbers = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?i)&#(x[0-9a-f]{1,6}|[0-9]{1,7});"), F.lit(1)))
    code = lambda n: F.when(F.lower(n).startswith("x"), F.conv(F.substring(n, 2, 8), 16, 10)).otherwise(n).cast("int")
    char = lambda n: F.when(code(n) == 160, " ").otherwise(F.decode(F.unhex(F.lpad(F.hex(code(n)), 8, "0")), "UTF-32"))
    valid = F.filter(numbers, lambda n: (code(n) > 0) & (code(n) <= 0x10FFFF) & (code(n) != 38))
    out = F.aggregate(valid, c, lambda acc, n: F.replace(acc, F.concat(F.lit("&#"), n, F.lit(";")), char(n)))
    out = F.when(F.instr(c, "&") > 0, reduce(lambda a, e: F.replace(a, F.lit(f"&{e[0]};"), F.lit(e[1])), ENTITIES.items(), out)).otherwise(c)
    return F.regexp_replace(out, "(?i)&(?:amp|#0*38|#x0*26);", "&")


def block_text(inner: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(inner, r"(?i)<br\s*/?>", " "), "<[^>]*>", " ")
    return F.replace(F.replace(X.squeeze(X.once(bare, decode)), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def neutral_line(c: Column) -> Column:
    """Line starts that markdown would read as more than text get a backslash."""
    return F.when(c.rlike(r"^(?:#|-{3,}|\*{3,}|_{3,}|={3,}|<)"), F.concat(F.lit("\\"), c)).otherwise(c)


def meta_description(html: Column) -> Column:
    """The first of four forms that is there decides, even when it is empty."""
    forms = [
        r"""(?i)<meta[^>]+name=["']description["'][^>]+content=["']([^"']*)["']""",
        r"""(?i)<meta[^>]+content=["']([^"']*)["'][^>]+name=["']description["']""",
        r"""(?i)<meta[^>]+property=["']og:description["'][^>]+content=["']([^"']*)["']""",
        r"""(?i)<meta[^>]+content=["']([^"']*)["'][^>]+property=["']og:description["']""",
    ]
    hit = reduce(lambda rest, p: F.when(html.rlike(p), F.regexp_extract(html, p, 1)).otherwise(rest), reversed(forms), F.lit(None).cast("string"))
    return F.nullif(strip_html(hit), F.lit(""))


def ministry(html: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in MINISTRIES.items() for x in kv])
    return F.element_at(known, F.lower(F.regexp_extract(html, r'(?i)href="/ministeries/([a-z0-9-]+)"', 1)))


def page_title(html: Column, suffix: str = "") -> Column:
    found = strip_html(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]*)</title>", 1))
    return F.nullif(F.trim(F.regexp_replace(found, rf"(?i)\s*\|\s*\Q{suffix}\E\s*$", "")) if suffix else found, F.lit(""))


def heading(html: Column) -> Column:
    h1 = strip_html(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    return X.once(h1, lambda h: F.when(F.length(h) >= 5, h))


def described(html: Column) -> Column:
    """The meta description, else the first paragraph of over 60 characters; null under 20."""
    paragraphs = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), strip_html)
    out = F.coalesce(meta_description(html), F.get(F.filter(paragraphs, lambda p: F.length(p) > 60), 0))
    return X.once(out, lambda o: F.when(F.length(o) >= 20, o))


def region(html: Column, tag: str, end: str | None = None) -> Column:
    """What stands inside ``tag``, after its first heading and before ``end``; asides taken out. Null without the tag."""
    bare = F.regexp_replace(html, NO_CONTENT, " ")
    pattern = rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"
    inner = X.once(bare, lambda b: F.when(b.rlike(pattern), F.regexp_replace(F.regexp_extract(b, pattern, 1), ASIDE, " ")))
    inner = F.regexp_replace(inner, r"(?is)^.*?</h1\s*>", "")
    return F.get(F.split(inner, f"(?i){end}", 2), 0) if end else inner


def between(html: Column, start: str, end: str, stop: str | None = None) -> Column:
    """What stands between two markers, cut at ``stop``; null where either is missing. Markers inside scripts,
    comments and figures are none."""
    bare = F.regexp_replace(F.regexp_replace(html, NO_CONTENT, " "), FIGURE, " ")
    after = F.get(F.split(bare, f"(?is){start}", 2), 1)
    parts = F.split(after, f"(?is){end}", 2)
    inner = F.when(F.size(parts) > 1, F.get(parts, 0))
    return F.get(F.split(inner, f"(?is){stop}", 2), 0) if stop else inner


def blocks(inner: Column, links: bool = False) -> Column:
    """(tag, line) per non-empty block; list items that are one link only go unless ``links``."""
    pattern = F.lit(r"(?is)<(p|h2|h3|li)\b[^>]*>(.*?)</\1\s*>")
    pairs = F.arrays_zip(F.regexp_extract_all(inner, pattern, F.lit(1)).alias("tag"), F.regexp_extract_all(inner, pattern, F.lit(2)).alias("body"))
    if not links:
        pairs = F.filter(pairs, lambda x: ~((F.lower(x["tag"]) == "li") & x["body"].rlike(r"(?is)^\s*<a\b[^>]*>.*?</a>\s*$")))
    lines = F.transform(pairs, lambda x: F.struct(F.lower(x["tag"]).alias("tag"), block_text(x["body"]).alias("line")))
    marked = lambda x: neutral_line(F.when(x["tag"] == "li", F.concat(F.lit("- "), x["line"])).otherwise(x["line"]))
    return F.transform(F.filter(lines, lambda x: x["line"] != ""), lambda x: F.struct(x["tag"].alias("tag"), marked(x).alias("line")))


def joined(found: Column, most: int) -> Column:
    """Blocks joined by blank lines and cut at a sentence."""
    return X.truncate_sentence(F.array_join(F.transform(found, lambda x: x["line"]), "\n\n"), most)


def told(found: Column, text: Column, least: int, paragraph: int, paragraphs: int, boilerplate: str | None, after: bool) -> Column:
    """``text``, or null if it is too short, boilerplate, or of too few paragraphs.

    ``after`` counts paragraphs on what survives the cut, else on all blocks; ``text`` should then be a
    column, since it is looked at once a block.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))

    def step(acc, x):
        kept = F.least(F.length(x["line"]), F.length(text) - acc["at"]) if after else F.length(x["line"])
        return F.struct((acc["at"] + F.length(x["line"]) + 2).alias("at"), (acc["n"] + ((x["tag"] == "p") & (kept >= paragraph)).cast("int")).alias("n"))

    ok = (F.length(text) >= least) & (F.aggregate(found, start, step, lambda acc: acc["n"]) >= paragraphs)
    return F.when(ok & ~text.rlike(boilerplate) if boilerplate else ok, text)


def body(found: Column, most: int = 8000, least: int = 400, paragraph: int = 40, paragraphs: int = 2, boilerplate: str | None = None, after: bool = False) -> Column:
    """Blocks joined by blank lines and cut at a sentence; null if too short, boilerplate, or of too few paragraphs."""
    return X.once(joined(found, most), lambda text: told(found, text, least, paragraph, paragraphs, boilerplate, after))


def news_bodies(pages: DataFrame, most: int = 8000, least: int = 400, paragraph: int = 40, paragraphs: int = 2) -> DataFrame:
    """Adds ``body`` to pages with ``html``: the text of a news page between its markers, as markdown; null where it
    cannot be told. Each step is a column of its own, made once."""
    rows = pages.withColumn("_blocks", blocks(between(F.col("html"), NEWS_START, NEWS_END, NEWS_STOP), links=True))
    rows = rows.withColumn("_text", joined(F.col("_blocks"), most))
    return rows.withColumn("body", told(F.col("_blocks"), F.col("_text"), least, paragraph, paragraphs, NEWS_BOILERPLATE, True)).drop("_blocks", "_text")


def clean_pages(pages: DataFrame, tag: str = "article", suffix: str = "") -> DataFrame:
    """One row per page: key, title, description, ministry, heading, body."""
    html = F.col("html")
    rows = pages.select("page_id", "url", X.url_key(F.col("url")).alias("url_key"), "html", blocks(region(html, tag)).alias("blocks"))
    return rows.select("page_id", "url", "url_key", page_title(html, suffix).alias("title"), described(html).alias("description"), ministry(html).alias("ministry"), heading(html).alias("heading"), body(F.col("blocks")).alias("body"), F.size("blocks").cast("long").alias("n_blocks"))
