"""Text expressions at their edges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sievewright.functions import text as X
from sievewright.sources import pages as P


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c"))).first()[0]


@pytest.mark.parametrize("url,key", [
    ("HTTP://Www.Example.org:80/a/b//?q=1#top", "https://www.example.org/a/b?q=1"), ("https://x.nl:443/", "https://x.nl"), ("https://x.nl:8080/a/", "https://x.nl:8080/a"),
    ("  ", ""), (None, ""), ("  geen url ", "geen url"), ("http://u:p@x.nl/é", "https://x.nl/é"),
])
def test_url_key(spark, url, key):
    assert one(spark, url, X.url_key) == key


def test_words_keep_repeats_and_order(spark):
    assert one(spark, "De BTW, btw én de bv: reëel é", X.tokens) == ["btw", "btw", "bv", "reeel"]
    assert one(spark, "Ondernemers en artikelen, klas loss zzp-ers", X.significant_words) == ["ondernemer", "artikel", "klas", "loss", "zzp-er"]
    assert one(spark, "eenmanszaken of rechtspersoon", X.detail_words) == ["enmanszak", "rechtsperson"]


def test_sentences_keep_digits_that_are_their_place(spark):
    text = "Een. 1 twee? \u00a0\n2.0 is drie\n\n 33 vier 3!\n4"
    assert one(spark, text, X.sentences) == ["Een.", "1 twee?", "2.0 is drie", "33 vier 3!", "4"]
    assert one(spark, "0 nul. \u20031 een\u3000\n2", X.sentences) == ["0 nul.", "1 een", "2"]


@pytest.mark.parametrize("text,date", [
    ("geldt per 31 februari 2027", dt.date(2027, 3, 3)), ("vanaf 2028", dt.date(2028, 1, 1)), ("met ingang van 1 juli 2020 en vanaf 2 mei 2026", dt.date(2026, 5, 2)), ("in 2030", None), ("kóper 2031", dt.date(2031, 1, 1)),
])
def test_future_effective_date(spark, text, date):
    assert one(spark, text, lambda c: X.future_effective_date(c, F.lit("2025-01-01").cast("timestamp"))) == date


@pytest.mark.parametrize("raw,number", [("1.250.000", "1250000"), ("1.250,50", "1250.50"), ("2,5", "2.5"), ("21", "21"), ("3.00", "3"), ("1.2.3", "1.2.3")])
def test_canonical_number(spark, raw, number):
    assert one(spark, raw, X.canonical_number) == number


def test_truncation(spark):
    text = "Eerste zin. Zie bijv. artikel drie. " + "woord " * 30
    assert one(spark, text, lambda c: X.truncate_sentence(c, 30)) == "Eerste zin."
    assert one(spark, "geen einde hier maar lang", lambda c: X.truncate_sentence(c, 10)) is None
    assert one(spark, text, lambda c: X.truncate_boundary(c, 40)) == "Eerste zin. Zie bijv. artikel drie."
    assert one(spark, "a" * 50, lambda c: X.truncate_boundary(c, 20)) == "a" * 20
    assert one(spark, "kort", lambda c: X.truncate_boundary(c, 20)) == "kort"


def test_source_label(spark):
    f = lambda c: X.source_label(c, F.lit("2025-06-30 23:30:00").cast("timestamp"), F.lit(True))
    assert one(spark, "Bron", f) == "Bron (01-07-2025, historisch)"
    assert one(spark, "Bron (x)", f) == "Bron (x, 01-07-2025, historisch)"


def test_redaction(spark):
    f = lambda c: X.redact_secrets(c, "geheim-1234")
    assert one(spark, "geheim-1234 en Bearer abc.def en sk-abcdefghij", f) == "[VERWIJDERD] en Bearer [VERWIJDERD] en [VERWIJDERD]"


def test_keyword_borders_are_ascii(spark):
    f = lambda c: X.contains_keyword(F.lower(c), "kor", True)
    assert one(spark, "de KOR.", f) and one(spark, "ékor", f) and not one(spark, "korting", f)


def test_entities_are_decoded_once(spark):
    assert one(spark, "&amp;lt; &#233;&#x20AC; &nbsp;&euro;&shy;", P.decode) == "&lt; é€  €"
    assert one(spark, "<![CDATA[a<br>b]]> &amp;lt;", P.strip_html) == "a b <"


def test_empty_meta_stops_the_chain(spark):
    html = '<meta name="description" content=""><meta property="og:description" content="x">'
    assert one(spark, html, P.meta_description) is None
    assert one(spark, html[36:], P.meta_description) == "x"


def page(paragraphs):
    return "<main><nav><p>menu</p></nav><h1>Kop</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "<ul><li><a href='/'>link</a></li><li>punt</li></ul></main>"


def test_body_counts_paragraphs_before_or_after_the_cut(spark):
    long = ("Dit is een zin van een zekere lengte. " * 12).strip()
    html = page([long, long])
    blocks = lambda c: P.blocks(P.region(c, "main"))
    assert one(spark, html, lambda c: P.body(blocks(c))).endswith("- punt")
    assert one(spark, html, lambda c: P.body(blocks(c), most=460)) is not None
    assert one(spark, html, lambda c: P.body(blocks(c), most=460, after=True)) is None
    assert one(spark, page(["kort"]), lambda c: P.body(blocks(c))) is None
    assert one(spark, "<p>geen main</p>", lambda c: P.body(blocks(c))) is None
