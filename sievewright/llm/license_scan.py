"""Licence scan by a positional index of rare tokens.

A template is a licence's wording with mandatory key phrases at fixed places. The index holds, for each
template, the rarest words of its key phrases (by document frequency over the whole corpus) with their
positions. A file's licence words are looked up in it; where the words of a template stand in the file
at the same relative positions, the offsets they vote for intersect, and at each offset left the key
phrases are verified word by word. A later phrase may stand a few words off its place, as wordings vary.

Every word in the index belongs to a mandatory phrase, so a place that would verify is never missed,
whatever the corpus's frequencies; they decide only how many offsets are looked at. ``score`` is the
share of a template's words by weight (the binary digits of the inverse document frequency) that its best
place holds.

All of it is column functions over a row at a time: one pass counts the licence words' documents, one
scans; nothing is shuffled but those counts, and only files that hold all key words of a template are
looked at closer. The templates and counts (a row per licence word) are literals of the plan.

Defined cases: a null or empty text has no words and no labels, score 0; repeated ids keep their rows;
columns beside ``doc_id`` and ``text`` are left out, so their names cannot clash; an empty table gives no
rows; phrases of several templates may share words; texts of any length are scanned whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.shared import table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words a phrase may stand off its place for each phrase before it.
SLACK = 3
#: Words of a template that the index holds.
ANCHORS = 3

# Licence wordings, key phrases in brackets. The first three are the base phrases.
BASE = (
    ("mit", "[under the mit license]"),
    ("apache-2", "[apache license version 2]"),
    ("cc-by-nc", "[cc by nc]"),
)
TEMPLATES = (
    ("agpl-3", "[gnu affero general public license] as published by the free software foundation either [version 3] of the license"),
    ("agpl-3", "[gnu affero general public license version 3]"),
    ("apache-2", "[licensed under the apache license] version 2 0 the license you may not use this file [except in compliance with the license]"),
    ("apache-2", "[license apache 2 0]"),
    ("bsd-2-clause", "[under the bsd 2 clause license]"),
    ("bsd-3-clause", "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "[under the bsd 3 clause license]"),
    ("boost-1", "[distributed under the boost software license] version 1 0"),
    ("cc-by", "[cc by 4 0]"),
    ("cc-by", "[creative commons attribution 4 0 international license]"),
    ("cc-by-nc", "[creative commons attribution noncommercial 4 0]"),
    ("cc-by-nd", "[cc by nd]"),
    ("cc-by-sa", "[cc by sa]"),
    ("cc-by-sa", "[creative commons attribution sharealike 4 0]"),
    ("cc0", "[cc0 1 0 universal]"),
    ("epl-2", "[eclipse public license] v [2 0]"),
    ("gpl-2", "[gnu general public license version 2]"),
    ("gpl-2", "[gnu general public license] as published by the free software foundation either [version 2] of the license"),
    ("gpl-3", "[gnu general public license version 3]"),
    ("gpl-3", "[gnu general public license] as published by the free software foundation either [version 3] of the license"),
    ("isc", "[permission to use copy modify and or distribute this software] for any purpose with or without fee [is hereby granted]"),
    ("lgpl-2.1", "[gnu lesser general public license version 2 1]"),
    ("lgpl-3", "[gnu lesser general public license version 3]"),
    ("mit", "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files the software [to deal in the software without restriction]"),
    ("mpl-2", "[subject to the terms of the mozilla public license v 2 0]"),
    ("mpl-2", "[mozilla public license version 2]"),
    ("unlicense", "[free and unencumbered software released into the public domain]"),
    ("zlib", "[provided as is without any express or implied warranty] in no event will the authors be held liable"),
)


@dataclass(frozen=True)
class Template:
    label: str
    base: bool
    words: tuple[str, ...]
    #: (place, words a phrase may be off, its words); the first phrase stands at place 0.
    phrases: tuple[tuple[int, int, tuple[str, ...]], ...]

    @property
    def keys(self) -> tuple[str, ...]:
        return tuple(sorted({w for _, _, ws in self.phrases for w in ws}))


def parsed(label: str, wording: str, base: bool = False) -> Template:
    words: list[str] = []
    phrases = []
    for piece in re.findall(r"\[[^\]]+\]|[^\[\]]+", wording):
        own = piece.strip("[] ").split()
        if piece.startswith("["):
            phrases.append((len(words), SLACK * len(phrases), tuple(own)))
        words += own
    if not phrases or phrases[0][0] or not wording.replace("[", "").replace("]", "").isascii():
        raise ValueError(f"a template starts with a key phrase, in ASCII: {wording}")
    return Template(label, base, tuple(words), tuple(phrases))


def templates(base=BASE, more=TEMPLATES) -> list[Template]:
    return [parsed(a, b, True) for a, b in base] + [parsed(a, b) for a, b in more]


def lowered(text: Column) -> Column:
    """A-Z in lower case. The two other letters whose lower case is ASCII keep their form; what else
    ``lower`` changes stays beyond ASCII, so neither words' bounds nor licence words are touched."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.contains("K") | text.contains("İ"), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def weights(docs: DataFrame, found: list[Template]) -> dict[str, int]:
    """For each template word the binary digits of (rows + 1) div (rows that hold it + 1): rarer words weigh more."""
    vocabulary = sorted({w for t in found for w in t.words})
    held = docs.select(F.array_intersect(strings(vocabulary), words(F.col("text"))).alias("held"))
    marks = held.select(F.explode(F.concat(F.array(F.lit("")), "held")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    n = {r["word"]: r["n"] for r in marks.collect()}  # a row per template word, whatever the corpus
    return {w: ((n.get("", 0) + 1) // (n.get(w, 0) + 1)).bit_length() for w in vocabulary}


def indexed(found: list[Template], weight: dict[str, int], anchors: int = ANCHORS) -> Column:
    """The templates with their postings, as one literal array."""
    rows = []
    for number, t in enumerate(found):
        rare = sorted(t.keys, key=lambda w: (-weight[w], w))[:anchors]
        posts = [F.struct(F.lit(w).alias("word"), F.array(*[F.struct(F.lit(at + i).alias("at"), F.lit(off).alias("off")) for at, off, ws in t.phrases for i, x in enumerate(ws) if x == w]).alias("spots")) for w in rare]
        phrases = [F.struct(F.lit(at).alias("at"), F.lit(off).alias("off"), strings(ws).alias("words")) for at, off, ws in t.phrases]
        terms = [F.struct(F.lit(w).alias("word"), F.lit(weight[w]).alias("weight")) for w in sorted(set(t.words))]
        rows.append(F.struct(
            F.lit(number).alias("number"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), strings(t.keys).alias("keys"), F.array(*posts).alias("posts"), F.array(*phrases).alias("phrases"),
            F.array(*terms).alias("terms"), F.lit(sum(weight[w] for w in set(t.words))).alias("total"), F.lit(len(t.words) + t.phrases[-1][1]).alias("reach"),
        ))
    return F.array(*rows)


def offsets(hits: Column, post: Column) -> Column:
    """Where the template would start by one rare word: its positions in the file less those in the template."""
    own = F.filter(hits, lambda h: h["word"] == post["word"])
    spot = lambda h: F.flatten(F.transform(post["spots"], lambda s: F.sequence(h["at"] - s["at"] - s["off"], h["at"] - s["at"] + s["off"])))
    return F.array_distinct(F.flatten(F.transform(own, spot)))


def stands(text: Column, phrase: Column, start: Column) -> Column:
    """Whether a phrase stands at its place, or as far off as it may."""
    at = start + phrase["at"]
    near = F.sequence(at - phrase["off"], at + phrase["off"])
    return F.exists(near, lambda i: (i >= 0) & (F.slice(text, F.greatest(i, F.lit(0)) + 1, F.size(phrase["words"])) == phrase["words"]))


def scan(docs: DataFrame, found: list[Template] | None = None, anchors: int = ANCHORS) -> DataFrame:
    """(doc_id, n_words, matches): per row its matches, an array of (number, label, base, places, score), one per template found."""
    found = templates() if found is None else found
    table_ = indexed(found, weights(docs, found), anchors)
    keys = sorted({w for t in found for w in t.keys})
    rows = docs.select("doc_id", words(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "words", F.array_intersect(strings(keys), "words").alias("keys"))
    rows = rows.select("doc_id", "words", F.when(F.size("keys") > 0, F.filter(table_, lambda t: F.size(F.array_except(t["keys"], F.col("keys"))) == 0)).otherwise(F.filter(table_, lambda t: F.lit(False))).alias("open"))
    wanted = F.array_distinct(F.flatten(F.transform("open", lambda t: F.transform(t["posts"], lambda p: p["word"]))))
    rows = rows.select("doc_id", "words", "open", F.when(F.size("open") > 0, wanted).alias("wanted"))
    spots = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda h: F.array_contains(F.col("wanted"), h["word"]))
    rows = rows.select("doc_id", "words", "open", F.when(F.size("open") > 0, spots).alias("hits"))

    def places(t: Column) -> Column:
        votes = F.transform(t["posts"], lambda p: offsets(F.col("hits"), p))
        meet = F.aggregate(F.slice(votes, 2, anchors), F.get(votes, 0), lambda a, b: F.array_intersect(a, b))
        return F.array_sort(F.filter(meet, lambda o: (o >= 0) & F.forall(t["phrases"], lambda p: stands(F.col("words"), p, o))))

    def held(t: Column, o: Column) -> Column:
        near = F.slice(F.col("words"), o + 1, t["reach"])
        return F.aggregate(F.filter(t["terms"], lambda x: F.array_contains(near, x["word"])), F.lit(0), lambda a, x: a + x["weight"])

    matched = F.transform("open", lambda t: F.struct(t["number"].alias("number"), t["label"].alias("label"), t["base"].alias("base"), places(t).alias("places"), t.alias("t")))
    rows = rows.select("doc_id", "words", F.when(F.size("open") > 0, F.filter(matched, lambda m: F.size(m["places"]) > 0)).alias("matched"))
    scored = F.transform("matched", lambda m: F.struct(m["number"].alias("number"), m["label"].alias("label"), m["base"].alias("base"), m["places"].alias("places"), (F.array_max(F.transform(m["places"], lambda o: held(m["t"], o))) / m["t"]["total"]).alias("score")))
    none = F.filter(F.array(F.struct(F.lit(0).alias("number"), F.lit("").alias("label"), F.lit(False).alias("base"), F.array(F.lit(0)).alias("places"), F.lit(0.0).alias("score"))), lambda m: F.lit(False))
    return rows.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.coalesce(scored, none).alias("matches"))


def listed(matches: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    base = F.filter("matches", lambda m: m["base"])
    rows = scan(table(spark, sf_dir, "documents")).select("*", base.alias("base"))
    spots = F.flatten(F.transform("base", lambda m: m["places"]))
    rows = rows.select("doc_id", "n_words", "matches", "base", spots.alias("spots"))
    return rows.select(
        "doc_id", "n_words", F.size("spots").cast("bigint").alias("n_base"), F.array_min("spots").cast("bigint").alias("first_word"), F.array_max("spots").cast("bigint").alias("last_word"),
        listed(F.col("base")).alias("base_labels"), listed(F.col("matches")).alias("labels"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


def _sql(found: list[Template]) -> str:
    listed_ = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    phrase = lambda p: f"{{'at': {p[0]}, 'off': {p[1]}, 'ws': {listed_(p[2])}}}"
    rows = ",\n".join(f"({i}, '{t.label}', {t.base}, {listed_(sorted(set(t.words)))}, {listed_(t.keys)}, [{', '.join(map(phrase, t.phrases))}], {len(t.words) + t.phrases[-1][1]})" for i, t in enumerate(found))
    return rf"""
WITH t(number, label, base, terms, keys, phrases, reach) AS (VALUES
{rows}
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents
), df AS (
  SELECT w, count(*) AS c FROM (SELECT unnest(list_distinct(ws)) AS w FROM d) GROUP BY w
), weight AS (
  SELECT term, length(bin(((SELECT count(*) FROM d) + 1) // (coalesce(c, 0) + 1))) AS k FROM (SELECT DISTINCT unnest(terms) AS term FROM t) LEFT JOIN df ON w = term
), total AS (
  SELECT number, sum(k) AS total FROM (SELECT number, unnest(terms) AS term FROM t) JOIN weight USING (term) GROUP BY number
), spot AS (
  SELECT r, number, ws, phrases, reach, terms, unnest(range(0, len(ws))) AS o FROM d JOIN t ON list_has_all(ws, keys)
), hit AS (
  SELECT r, number, o, unnest(list_intersect(terms, ws[o + 1:o + reach])) AS term FROM spot
  WHERE len(list_filter(phrases, lambda p: len(list_filter(range(o + p.at - p.off, o + p.at + p.off + 1), lambda j: j >= 0 AND ws[j + 1:j + len(p.ws)] = p.ws)) = 0)) = 0
), place AS (
  SELECT r, number, o, sum(k) / any_value(total) AS score FROM hit JOIN weight USING (term) JOIN total USING (number) GROUP BY r, number, o
), f AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(o) FILTER (base) AS first_word, max(o) FILTER (base) AS last_word, max(score) AS score,
         list_sort(list_distinct(list(label) FILTER (base))) AS base_labels, list_sort(list_distinct(list(label))) AS labels FROM place JOIN t USING (number) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(base_labels, ','), '') AS base_labels, coalesce(array_to_string(labels, ','), '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN f USING (r)
"""


OP13_SQL = _sql(templates())
