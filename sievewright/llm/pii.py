"""Personal data: base patterns, and gradient-boosted candidates beyond them, in column functions alone.

Generators of high recall propose spans in written-out forms, which may overlap: addresses with ``(at)``
and ``dot``, numeric addresses with spaced or bracketed dots, cards with other separators, telephone
numbers without plus sign or inside a longer failing match. A span of the base patterns stays as it is.
Every candidate is described by format (digits, groups, separators, brackets, borders) and context (a cue
word shortly before).

Labels do not come from the base's patterns matching a candidate. Base spans are rewritten, where they
stand, into the written-out forms: these are the positives. The same names and digits as prices, dates,
lists and codes are decoys. A candidate of the corpus is unlabelled, as it may be personal data: it is a
negative only where no positive of its kind has its shape, and all such count as much as what is made, at
most. Positives and decoys count in four surroundings alike, with and without a cue and with plain borders,
so that what stands around the corpus's base spans is not what is learnt; e-mail addresses are described by
their separators, not by the length of names and domains. Boosted trees per kind tell the two apart, and a
cue never lowers a score; a threshold per kind is calibrated on held-out documents to
``precision``. Candidates at or above it that overlap no base span and no better candidate are added.
Without any base span of a kind there is nothing to learn from, and nothing of that kind is added.

Features take few values, so the training table is grouped: its size depends on them, not on the corpus,
and it holds all documents. Fitting reads that table on the driver; scores are CASE expressions.

Defined cases: a null or empty text has no spans; nested digit runs, very long runs included, are matched
without backtracking; repeated rows get equal results; equal starts are ordered by kind as listed.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.shared import table, written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: The base patterns, written so that no match has to be retried from inside a run.
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9]){11,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_AT = r"(?: ?[(\[{<] ?(?:at|AT|@) ?[)\]}>] ?| @ ?|@ )"
_DOT = r"(?: ?[(\[{<] ?(?:dot|DOT|\.) ?[)\]}>] ?| (?:dot|DOT) |\.)"
_LABEL = r"[A-Za-z0-9][A-Za-z0-9-]*+"
#: Generators beyond the base, (kind, what a text must hold, pattern).
WIDE = (
    ("email", r"[(\[{<] ?(?:at|AT|@) ?[)\]}>]|@ | @", rf"(?<![{_LOCAL}])[{_LOCAL}]++{_AT}{_LABEL}(?:{_DOT}{_LABEL})++"),
    ("email", r" (?:at|AT) \S+ (?:dot|DOT) ", rf"(?<![{_LOCAL}])[{_LOCAL}]++ (?:at|AT) {_LABEL}(?: (?:dot|DOT) {_LABEL})++"),
    ("ip", r"[0-9] ?[(\[{ ] ?(?:\.|dot)|[0-9]\. [0-9]", r"(?<![0-9.])[0-9]{1,3}+(?:(?: ?\. ?| ?[(\[{] ?(?:\.|dot|DOT) ?[)\]}] ?| (?:dot|DOT) )[0-9]{1,3}+){3}+(?![0-9])"),
    ("card", "[0-9]{4}", r"(?<![0-9])[0-9]{4}+(?:[ ._/,:\u00A0-]{1,3}+[0-9]{4}+){3}(?![0-9])"),
    ("card", "[0-9]{4}", r"(?<![0-9])[0-9]{4}+[ ._/,:\u00A0-]{1,3}+[0-9]{6}+[ ._/,:\u00A0-]{1,3}+[0-9]{5}(?![0-9])"),
    ("phone", r"\+[0-9]", r"(?<![0-9A-Za-z+])\+[0-9]{1,3} ?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9])"),
    ("phone", r"[0-9)][ ./-][0-9]|\) ?[0-9]", r"(?<![0-9A-Za-z+./-])\(?[0-9]{2,5}\)?(?:[ ./-]{1,3}+[0-9]{2,6}){1,5}(?![0-9A-Za-z])"),
)
CUES = {"email": "mail|contact|write", "ip": "address|host|server", "card": "card|credit|visa|iban|account|number", "phone": "phone|tel|call|mobile|fax|contact"}
#: Name and largest value of each feature.
FEATURES = (("digits", 20), ("groups", 8), ("longest", 8), ("opens", 6), ("spaces", 6), ("dots", 5), ("dashes", 5), ("slashes", 3), ("brackets", 4), ("words", 4), ("left", 2), ("right", 2), ("cue", 1))
#: What of them makes a shape: the separators, with the digits where these are not free.
_SEPARATORS = ("groups", "spaces", "dots", "dashes", "slashes", "brackets", "words")
SHAPE = {"email": _SEPARATORS, "ip": _SEPARATORS, "card": ("digits", *_SEPARATORS), "phone": ("digits", "longest", "opens", *_SEPARATORS)}
#: What stands for the @ of an address.
AT = r" ?[(\[{<] ?(?:at|AT|@) ?[)\]}>] ?| (?:at|AT) | ?@ ?"
SPAN = "array<struct<s:int,k:int,e:int,m:string>>"


@dataclass(frozen=True)
class Params:
    trees: int = 40
    rate: float = 0.4
    precision: float = 0.9
    folds: int = 5


def spans(text: Column, pattern: str, kind: int, needs: str) -> Column:
    """Leftmost non-overlapping matches, in order, as (start, kind, end, match).

    Starts are running sums of the lengths of the matches and of what lies between them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.expr(f"CAST(array() AS {SPAN})").alias("out"))

    def step(acc, x):
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    both = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m"))
    return F.when(text.rlike(needs), F.aggregate(both, start, step, lambda acc: acc["out"])).otherwise(F.expr(f"CAST(array() AS {SPAN})"))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    n = F.length(d)

    def add(total, i):
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def accepted(x: Column) -> Column:
    """Whether the base keeps a match of its pattern."""
    d = digits(x["m"])
    n = F.length(d)
    octets = F.forall(F.split(x["m"], r"\."), lambda o: F.length(F.regexp_replace(o, "^0+", "")) <= 3)
    low = F.forall(F.split(x["m"], r"\."), lambda o: F.coalesce(F.substring(F.regexp_replace(o, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255)
    return (
        F.when(x["k"] == 0, True)
        .when(x["k"] == 1, octets & low)
        .when(x["k"] == 2, (n >= 12) & (n <= 19) & F.when((n >= 12) & (n <= 19), luhn(d)).otherwise(False))
        .otherwise((n >= 9) & (n <= 15))
    )


def possible(x: Column) -> Column:
    """Whether a proposal can be what it looks like: parts of an address up to 255, a card's check sum, as many digits as a number has."""
    n = F.length(digits(x["m"]))
    low = F.forall(F.regexp_extract_all(x["m"], F.lit("[0-9]+"), F.lit(0)), lambda o: o.try_cast("int") <= 255)
    return F.when(x["k"] == 0, True).when(x["k"] == 1, low).when(x["k"] == 2, F.when((n >= 12) & (n <= 19), luhn(digits(x["m"]))).otherwise(False)).otherwise((n >= 7) & (n <= 15))


def rewritten(x: Column) -> Column:
    """A base span in other forms: (form, whether it still is personal data)."""
    m, d = x["m"], digits(x["m"])
    at = lambda a, n: F.substring(d, a, n)
    user, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    dotted = lambda dot: F.regexp_replace(domain, r"\.", dot)
    emails = [F.concat(user, F.lit(a), dotted(b)) for a, b in ((" (at) ", "."), ("(at)", "."), ("[at]", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" at ", " dot "), (" @ ", "."), ("{at}", "{dot}"))]
    ips = [F.regexp_replace(m, r"\.", dot) for dot in (" . ", "[.]", "(.)", " dot ", "[dot]", "(dot)", " [dot] ", ". ")]
    four = lambda sep: F.concat(at(1, 4), F.lit(sep), at(5, 4), F.lit(sep), at(9, 4), F.lit(sep), at(13, 4))
    six = lambda sep: F.concat(at(1, 4), F.lit(sep), at(5, 6), F.lit(sep), at(11, 5))
    n = F.length(d)
    cards = [F.when(n == 16, four(sep)).when(n == 15, six(sep)) for sep in (".", "_", "/", "  ", " - ", " / ", ":", "\u00a0")]
    last = F.substring(d, n - 9, F.lit(10))  # the number within its country
    part = lambda a, k: F.substring(last, a, k)
    shapes = (("(", ") ", "-"), ("(", ") ", " "), ("", "-", "-"), ("", ".", "."), ("", " ", " "), ("", " ", "-"), ("", "/", "-"), ("(", ")", "-"), ("0", " ", " "), ("0", "-", "-"))
    phones = [F.when(n >= 10, F.concat(F.lit(a), part(1, 3), F.lit(b), part(4, 3), F.lit(c), part(7, 4))) for a, b, c in shapes]
    pair = lambda a: F.substring(last, a, F.lit(2))
    phones += [F.when(n >= 10, F.concat(F.lit("0"), F.substring(last, 2, F.lit(1)), *[F.concat(F.lit(c), pair(a)) for a in (3, 5, 7, 9)])) for c in " ."]
    phones += [F.concat(F.lit("00"), F.regexp_replace(F.substring(m, 2, 1 << 20), r"[()]", "")), m]
    bad = {
        0: [F.concat(user, F.lit(x)) for x in (" @ 4.50", "@ 10.30", " (at) 10.30")],
        2: [F.when(n == 16, four(sep)).when(n == 15, six(sep)) for sep in (", ", ": ")],
        1: [F.concat(at(1, 1), F.lit(". "), at(2, 1), F.lit(". "), at(3, 1), F.lit(". "), at(1, 1))],
        3: [F.concat(at(1, 4), F.lit(c), at(5, 2), F.lit(c), at(7, 2)) for c in "-/. "]
        + [F.concat(at(1, 2), F.lit(c), at(3, 2), F.lit(c), at(5, 4)) for c in "-/. "]
        + [F.concat(at(1, 4), F.lit("-"), at(5, 2), F.lit("-"), at(7, 2), F.lit(" "), at(1, 2)), F.concat(at(1, 4), F.lit("-"), at(5, 4)), F.concat(at(1, 3), F.lit("-"), at(4, 2), F.lit("-"), at(6, 4))]
        + [F.concat(at(1, 3), F.lit(" "), at(4, 3), F.lit(" "), at(7, 3)), F.concat(at(1, 2), F.lit("."), at(3, 3), F.lit("."), at(6, 2))],
    }
    forms = lambda good, wrong: F.array(*[F.struct(g.alias("m"), F.lit(1).alias("y")) for g in good], *[F.struct(w.alias("m"), F.lit(0).alias("y")) for w in wrong])
    made = [forms(g, bad.get(k, [])) for k, g in enumerate((emails, ips, cards, phones))]
    return F.filter(F.when(x["k"] == 0, made[0]).when(x["k"] == 1, made[1]).when(x["k"] == 2, made[2]).otherwise(made[3]), lambda f: f["m"].isNotNull())


def found(docs: DataFrame, key: list[str]) -> DataFrame:
    """``key``, ``base`` (accepted base spans), ``cand`` (proposals apart from them) and ``made`` (base spans rewritten)."""
    text = F.col("_t")
    rows = docs.select(*key, F.coalesce("text", F.lit("")).alias("_t"))
    base = F.concat(spans(text, EMAIL, 0, "@"), spans(text, IP, 1, r"[0-9]\.[0-9]"), spans(text, CARD, 2, "[0-9]"), spans(text, PHONE, 3, r"\+[0-9]"))
    wide = F.concat(*[spans(text, pattern, KINDS.index(k), needs) for k, needs, pattern in WIDE])
    rows = rows.withColumn("_ok", F.filter(base, accepted))
    apart = lambda c: F.forall("_ok", lambda b: (b["e"] <= c["s"]) | (c["e"] <= b["s"]))
    rows = rows.withColumn("_wide", F.array_distinct(F.filter(wide, lambda c: apart(c) & possible(c))))
    cand = F.transform("_wide", lambda c: described(text, c, c["m"], F.lit(0), F.lit(False)))
    made = F.flatten(F.transform("_ok", lambda b: F.transform(rewritten(b), lambda f: described(text, b, f["m"], f["y"], F.lit(True)))))
    return rows.select(*key, F.col("_ok").alias("base"), cand.alias("cand"), made.alias("made"))


def described(text: Column, c: Column, m: Column, y: Column, made: Column) -> Column:
    """The features of the form ``m`` at the place of the span ``c``; of an e-mail address, its separators are counted."""
    before = F.lower(F.substring(text, F.greatest(c["s"] - 31, F.lit(1)), F.least(c["s"], F.lit(32))))
    number = c["k"] != 0
    seen = F.when(number, m).otherwise(F.regexp_extract(m, AT, 0))
    count = lambda what: F.length(seen) - F.length(F.regexp_replace(seen, what, ""))
    dot = F.when(m.rlike(r"[(\[{<] ?(?:dot|DOT|\.)"), 2).when(m.rlike(" (?:dot|DOT) "), 1).otherwise(0)
    border = lambda x: F.when(x.rlike(r"[A-Za-z0-9]"), 2).when(x.rlike(r"[\\/_#=:.-]"), 1).otherwise(0)
    left = F.when(c["s"] > 0, F.substring(text, c["s"], F.lit(1))).otherwise("")
    right = F.regexp_replace(F.substring(text, c["e"] + 1, F.lit(2)), r"^[.:](?:\s|$)", " ")
    runs = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    cue = F.lit(False)
    for k, name in enumerate(KINDS):
        cue = cue | ((c["k"] == k) & before.rlike(CUES[name]))
    value = {
        "digits": F.when(number, F.length(digits(m))).otherwise(0),
        "groups": F.when(number, F.size(runs)).otherwise(m.rlike("[A-Za-z]{2,}$").cast("int")),
        "longest": F.when(number, F.array_max(F.transform(runs, F.length))).otherwise(0),
        "opens": F.when(number, F.length(F.element_at(runs, 1))).otherwise(0),
        "spaces": count(r"\s"),
        "dots": F.when(number, count(r"\.")).otherwise(dot),
        "dashes": F.when(number, count("-")).otherwise(0),
        "slashes": count("[/_:,]"),
        "brackets": count(r"[()\[\]{}<>]"),
        "words": F.size(F.regexp_extract_all(seen, F.lit(r"(?<![A-Za-z0-9])(?:at|AT|dot|DOT)(?![A-Za-z0-9])"), F.lit(0))),
        "left": border(left),
        "right": border(F.substring(right, 1, 1)),
        "cue": cue.cast("int"),
    }
    return F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), y.alias("y"), made.alias("made"), *[F.least(F.coalesce(value[n], F.lit(0)), F.lit(most)).cast("int").alias(n) for n, most in FEATURES])


@dataclass
class Trees:
    """Depth-two trees: (feature, cut, left pair, right pair); a pair is (feature, cut, value under, value over)."""

    bias: float
    trees: list
    threshold: float = math.inf

    def score(self, row: tuple) -> float:
        z = self.bias
        for f, cut, *sides in self.trees:
            g, at, low, high = sides[row[f] >= cut]
            z += high if row[g] >= at else low
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def column(self, c: Column) -> Column:
        z = F.lit(self.bias)
        name = [n for n, _ in FEATURES]
        for f, cut, *sides in self.trees:
            low, high = (F.when(c[name[g]] >= at, F.lit(b)).otherwise(F.lit(a)) for g, at, a, b in sides)
            z = z + F.when(c[name[f]] >= cut, high).otherwise(low)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def boost(x: np.ndarray, weight: np.ndarray, positive: np.ndarray, p: Params) -> Trees:
    """Newton boosting of the log loss over rows of features with their weights and how much of these is positive.

    Gradients are summed in a histogram per feature, whose values are few. The cue only splits what a first
    split has parted, and only where its side has the larger value, so that it never lowers a score.
    """
    cue = [name for name, _ in FEATURES].index("cue")
    share = (positive.sum() + 0.5) / (weight.sum() + 1)
    model = Trees(math.log(share / (1 - share)), [])
    z = np.full(len(x), model.bias)

    def best(part, g, h, first):
        """The split of ``part`` with the largest gain, as (gain, feature, cut)."""
        top = (0.0, 0, 0)
        for f, (_, most) in enumerate(FEATURES):
            gl, hl = (np.cumsum(np.bincount(x[part, f], v[part], most + 1)) for v in (g, h))
            gain = gl**2 / (hl + 1) + (gl[-1] - gl) ** 2 / (hl[-1] - hl + 1) - gl[-1] ** 2 / (hl[-1] + 1)
            if f == cue and (first or gl[0] / (hl[0] + 1) < (gl[-1] - gl[0]) / (hl[-1] - hl[0] + 1)):
                continue  # gradients fall as values rise
            at = int(np.argmax(gain[:-1]))
            if gain[at] > top[0] + 1e-9:
                top = (float(gain[at]), f, at + 1)
        return top

    value = lambda part, g, h: float(-p.rate * g[part].sum() / (h[part].sum() + 1))
    for _ in range(p.trees if len(x) else 0):
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g, h = weight * q - positive, weight * q * (1 - q)
        gain, f, cut = best(np.ones(len(x), bool), g, h, True)
        if gain < 1e-6:
            break
        sides = []
        for part in (x[:, f] < cut, x[:, f] >= cut):
            _, f2, at = best(part, g, h, False)
            low, high = part & (x[:, f2] < at), part & (x[:, f2] >= at)
            sides.append((f2, at, value(low, g, h), value(high, g, h)))
            z += np.where(low, sides[-1][2], 0) + np.where(high, sides[-1][3], 0)
        model.trees.append((f, cut, *sides))
    return model


def labelled(grouped: list) -> dict[bool, list[tuple]]:
    """Training rows of one kind, (features, weight, positive weight), by whether they are held out.

    ``grouped`` holds (held, made, kind, features, count, positives). Half of what is made counts as it stands and half
    between plain borders, each half with and half without a cue.
    """
    names = [n for n, _ in FEATURES]
    left, right, cue = (names.index(n) for n in ("left", "right", "cue"))
    shape = lambda r: tuple(r[3][names.index(n)] for n in SHAPE[KINDS[r[2]]])
    trusted = {shape(r) for r in grouped if r[1] and r[5]}
    against = [r for r in grouped if not r[1] and shape(r) not in trusted]
    share = min(1.0, sum(r[4] for r in grouped if r[1]) / max(1, sum(r[4] for r in against)))
    total: dict[tuple, list[float]] = {}

    def add(held, features, n, pos):
        both = total.setdefault((held, tuple(features)), [0.0, 0.0])
        both[0], both[1] = both[0] + n, both[1] + pos

    for held, _, _, features, n, _ in against:
        add(held, features, share * n, 0.0)
    for held, made, _, features, n, pos in grouped:
        for plain in (False, True) if made else ():
            for c in (0, 1):
                x = list(features)
                x[cue] = c
                if plain:
                    x[left] = x[right] = 0
                add(held, x, n / 4, pos / 4)
    return {held: sorted((x, n, pos) for (h, x), (n, pos) in total.items() if h == held) for held in (False, True)}


def train(cands: DataFrame, p: Params = Params()) -> list[Trees]:
    """A model per kind, from the candidates of all documents; ``cands`` has cand, made and fold (0 calibrates)."""
    names = [n for n, _ in FEATURES]
    flat = cands.select("fold", F.explode(F.concat("cand", "made")).alias("c")).select("fold", "c.k", *[f"c.{n}" for n in names], "c.y", "c.made")
    grouped = flat.groupBy((F.col("fold") == 0).alias("held"), "made", "k", *names).agg(F.count("*").alias("n"), F.sum("y").alias("pos")).collect()
    models = []
    for k in range(len(KINDS)):
        rows = labelled(sorted((r["held"], r["made"], k, tuple(r[n] for n in names), r["n"], r["pos"]) for r in grouped if r["k"] == k))
        fit = rows[False] or rows[True]
        model = boost(np.array([r[0] for r in fit], int).reshape(-1, len(names)), np.array([r[1] for r in fit]), np.array([r[2] for r in fit]), p)
        scored = sorted(((model.score(f), n, pos) for f, n, pos in rows[True] or fit), reverse=True)
        n = pos = 0.0
        for at, (s, a, b) in enumerate(scored):
            n, pos = n + a, pos + b
            last = at + 1 == len(scored) or scored[at + 1][0] < s
            if last and pos >= p.precision * n and s >= 0.5:
                model.threshold = s - 1e-9
        models.append(model)
    return models


def chosen(models: list[Trees]) -> Column:
    """The added spans: at or above their threshold, best first, none over a base span or a better one."""
    score = lambda c: F.coalesce(*[F.when(c["k"] == k, m.column(c)) for k, m in enumerate(models)])
    limit = lambda c: F.coalesce(*[F.when(c["k"] == k, F.lit(m.threshold)) for k, m in enumerate(models)])
    apart = lambda a, b: (a["e"] <= b["s"]) | (b["e"] <= a["s"])
    free = F.filter("cand", lambda c: score(c) >= limit(c))
    ranked = F.array_sort(F.transform(free, lambda c: F.struct((-score(c)).alias("r"), c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))))
    none = F.expr("CAST(array() AS array<struct<s:int,k:int,e:int>>)")
    take = lambda acc, c: F.when(F.forall(acc, lambda a: apart(a, c)), F.concat(acc, F.array(F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))))).otherwise(acc)
    return F.aggregate(ranked, none, take)


def joined(found: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _detected(docs: DataFrame, carry: list[Column], p: Params) -> DataFrame:
    """``_c0``, ``_c1``, … for ``carry``, then base and added; own names, so that none of the input's can clash."""
    names = [f"_c{i}" for i in range(len(carry))]
    rows = docs.select(*[c.alias(n) for c, n in zip(carry, names)], F.col("text").alias("text"))
    got = found(rows.withColumn("_f", F.pmod(F.xxhash64("text"), F.lit(p.folds))), [*names, "_f"]).withColumnRenamed("_f", "fold")
    got = written(got, "candidates")
    models = train(got, p)
    plain = F.transform("base", lambda b: F.struct(b["s"].alias("s"), b["k"].alias("k"), b["e"].alias("e")))
    return got.select(*names, plain.alias("base"), chosen(models).alias("added"))


def detect(docs: DataFrame, key: str, p: Params = Params()) -> DataFrame:
    """``key``, ``base`` and ``added`` (arrays of start, kind, end) per row; texts are read once."""
    return _detected(docs, [F.col(key)], p).withColumnRenamed("_c0", key)


def redact(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows with every found span replaced by its kind in brackets, ``n_chars`` brought up to date."""
    got = _detected(docs, [F.col(f"`{c}`") for c in docs.columns], p)
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    whole = F.col(own["text"])
    tag = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        more = F.concat(acc["out"], F.substring(whole, acc["at"] + 1, x["s"] - acc["at"]), F.element_at(tag, x["k"] + 1))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    every = F.array_sort(F.concat("base", "added"))
    clean = F.aggregate(every, start, step, lambda acc: F.concat(acc["out"], F.substring(whole, acc["at"] + 1, F.length(whole))))
    text = F.when(F.size(every) > 0, clean).otherwise(whole)
    new = {"text": text} | ({"n_chars": F.when(F.size(every) > 0, F.length(text)).otherwise(F.col(own["n_chars"])).cast(docs.schema["n_chars"].dataType)} if "n_chars" in own else {})
    return got.select(*[new.get(c, F.col(n)).alias(c) for c, n in own.items()])


def op5_pii(spark, sf_dir: str) -> DataFrame:
    out = detect(table(spark, sf_dir, "documents"), "doc_id")
    count = lambda k: F.size(F.filter("base", lambda b: b["k"] == k)).cast("long")
    return out.select("doc_id", *[count(k).alias(f"n_{n}") for k, n in enumerate(KINDS)], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
