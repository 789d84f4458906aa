"""Relevance by rule tables: one pass over each text for all keywords of all rules, however many.

A rule table has a row per keyword: ``rule`` (int), ``kind`` (categorie, doelgroep, belangrijk, signaal,
uitsluiting), ``name`` (what the rule files under, or null), ``rank`` (order of preference), ``part``
(woord, or for rules of terms alle, een, tenzij), ``word``, ``whole`` (match between word borders alone),
``broad`` (too wide to corroborate), ``scope`` (text or title).

Tasks walk one automaton of all words along a text, so the time depends on the text and what is found in
it, not on how many keywords there are; ``matches`` names the rules that hold, and all else is columns.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions.rules import Rules
from sievewright.functions.text import squeeze

SCHEMA = "rule int, kind string, name string, rank int, part string, word string, whole boolean, broad boolean, scope string"
#: The most keywords that are sent to tasks; a table beyond it is refused.
MOST = 1_000_000
#: Rows whose texts a worker holds as strings at a time.
ROWS = 256
MATCHES = "array<struct<kind:string,name:string,rank:int,n:int,narrow:int>>"


def rule_rows(rules: Rules) -> list[tuple]:
    """Rules as rows of a rule table."""
    out: list[tuple] = []
    for kind, groups in (("categorie", rules.categories), ("doelgroep", rules.audiences), ("belangrijk", {"belangrijk": rules.important})):
        for rank, (name, words) in enumerate(groups.items()):
            rule = len({r[0] for r in out})
            out += [(rule, kind, name, rank, "woord", w, kind == "categorie" and w in rules.whole_words, w in rules.broad, "text") for w in words]
    for kind, terms in (("signaal", rules.signals), ("uitsluiting", rules.exclusions)):
        for rank, t in enumerate(terms):
            rule = len({r[0] for r in out})
            out += [(rule, kind, t.category, rank, part, w, False, False, t.scope) for part, words in (("alle", t.all), ("een", t.any), ("tenzij", t.unless)) for w in words]
    return out


def rule_table(spark: SparkSession, rules: Rules) -> DataFrame:
    return spark.createDataFrame(rule_rows(rules), SCHEMA)


class Matcher:
    """Which rules hold for a text."""

    def __init__(self, rows: list[tuple]):
        import ahocorasick

        self.rules: dict[int, dict] = {}
        uses: dict[str, list] = {}
        self.spaced = set()
        for rule, kind, name, rank, part, word, whole, broad, scope in rows:
            at = self.rules.setdefault(rule, {"kind": kind, "name": name, "rank": rank, "alle": 0, "een": 0, "scope": scope})
            if part in ("alle", "een"):
                at[part] += 1
            uses.setdefault(word, []).append((rule, part, whole, broad))
            if part == "woord" and " " in word:  # such words are looked for in the text as it is, all others where white space is one space
                self.spaced.add(word)
        self.uses = uses
        self.automaton = ahocorasick.Automaton()
        for word in uses:
            if word:
                self.automaton.add_word(word, word)
        self.empty = uses.get("", [])
        if len(self.automaton):
            self.automaton.make_automaton()

    def words(self, text: str) -> dict[str, bool]:
        """The words in a text, and whether one stands between word borders."""
        found: dict[str, bool] = {}
        if not len(self.automaton):
            return found
        for end, word in self.automaton.iter(text):
            if not found.get(word):
                first = end - len(word) + 1
                found[word] = not (first and _letter(text[first - 1])) and not (end + 1 < len(text) and _letter(text[end + 1]))
        return found

    def matches(self, low: str, squeezed: str, title: str) -> list[dict]:
        in_text, in_title = self.words(squeezed), self.words(title)
        for word in self.spaced:
            in_text.pop(word, None)
        spaced = {w: f for w, f in self.words(low).items() if w in self.spaced} if self.spaced else {}
        parts: dict[int, dict] = {}
        for found, scope in ((in_text, "text"), (in_title, "title")):
            for word, bordered in found.items():
                for rule, part, whole, broad in self.uses[word]:
                    # terms of a title's rule are looked for there, what cancels it in the whole text
                    wanted = "text" if part in ("tenzij", "woord") else self.rules[rule]["scope"]
                    if part == "woord" and word in self.spaced or wanted != scope or whole and not bordered:
                        continue
                    own = parts.setdefault(rule, {})
                    own[part] = own.get(part, 0) + 1
                    own["smal"] = own.get("smal", 0) + (not broad)
        for word, bordered in spaced.items():
            for rule, part, whole, broad in self.uses[word]:
                if part == "woord" and not (whole and not bordered):
                    own = parts.setdefault(rule, {})
                    own[part] = own.get(part, 0) + 1
                    own["smal"] = own.get("smal", 0) + (not broad)
        out = []
        for rule in sorted(parts):
            own, r = parts[rule], self.rules[rule]
            terms = (r["alle"] or r["een"]) and own.get("alle", 0) == r["alle"] and (not r["een"] or own.get("een", 0)) and not own.get("tenzij")
            if own.get("woord") or terms:
                out.append({"kind": r["kind"], "name": r["name"], "rank": r["rank"], "n": own.get("woord", 0), "narrow": own.get("smal", 0) if own.get("woord") else 0})
        return out


def _letter(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def matched(docs: DataFrame, rules: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """Adds ``matches``: per rule that holds its kind, name, rank, and for keywords how many occur and how many of them are not broad."""
    import pyarrow as pa

    from sievewright.session import ship

    ship(docs.sparkSession)
    rows = rules.select("rule", "kind", "name", "rank", "part", "word", "whole", "broad", "scope").where("word <> ''").distinct().limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a rule table of more than {MOST} keywords")
    rows = sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[4], r[5]))
    names = docs.columns

    def run(batches) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(rows)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("rank", pa.int32()), ("n", pa.int32()), ("narrow", pa.int32())]))
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):  # few texts at a time are strings here
            texts = zip(*(batch.column(c).to_pylist() for c in ("_low", "_sq", "_ti")))
            found = pa.array([matcher.matches(*x) for x in texts], kind)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], found], names=[*names, "matches"])

    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    out = docs.withColumn("_low", low).withColumn("_sq", squeeze(F.col("_low"))).withColumn("_ti", squeeze(F.lower(F.coalesce(F.col(title), F.lit("")))))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return out.mapInArrow(run, f"{fields}, matches {MATCHES}")


def of_kind(kind: str) -> Column:
    return F.filter("matches", lambda m: m["kind"] == kind)


def relevance(docs: DataFrame, rules: DataFrame, default: str, filed: tuple[Column, Column], title: str = "title", text: str = "text") -> DataFrame:
    """The columns that ``classify.relevance`` gives, by a rule table; ``filed`` is a date of publication and the present."""
    out = matched(docs, rules, title, text)
    named = F.filter(of_kind("signaal"), lambda m: m["name"].isNotNull())
    first = lambda found, *keys: F.get(F.array_sort(F.transform(found, lambda m: F.struct(*[k(m) for k in keys], m["name"].alias("name")))), 0)["name"]
    out = out.withColumns({"keyword": F.size(of_kind("categorie")) > 0, "signal": F.size(of_kind("signaal")) > 0, "barred": F.size(of_kind("uitsluiting")) > 0, "hint": first(named, lambda m: m["rank"].alias("r"))})
    audience = F.transform(F.array_sort(F.transform(of_kind("doelgroep"), lambda m: F.struct(m["rank"].alias("r"), m["name"].alias("name")))), lambda m: m["name"])
    best = first(of_kind("categorie"), lambda m: (-m["n"]).alias("n"), lambda m: m["rank"].alias("r"))
    published, now = filed
    recent = published.isNotNull() & (published >= now - F.expr("INTERVAL 14 DAYS"))
    narrow = F.exists(of_kind("categorie"), lambda m: m["narrow"] > 0)
    out = out.withColumns({"audiences": audience, "category": F.coalesce(best, "hint", F.lit(default)), "priority": F.when(F.size(of_kind("belangrijk")) > 0, "belangrijk").when(recent, "actueel").otherwise("praktisch"), "_narrow": narrow})
    out = out.withColumn("audience", F.size("audiences") > 0)
    out = out.withColumn("corroborated", F.col("_narrow") | F.col("audience") | F.col("signal"))
    gate = F.col("keyword") | F.col("audience") | F.col("signal")
    return out.withColumn("relevant", gate & F.col("corroborated") & ~F.col("barred")).drop("_narrow", "matches")
