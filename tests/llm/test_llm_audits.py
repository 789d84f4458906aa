"""Source audit, Merkle manifest and licence scan against brute-force forms, and on nulls, empties, repeats, ties and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sievewright.llm import license_scan, merkle_manifest, source_audit

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree long, idx int, digest string, words string, now string, part string"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(7)
    words = ["de", "het", "één", "été", "naïve", "Über", "aap", "noot", "mies", "x", "İd", "K"]
    text = lambda n: " ".join(r.choice(words) + r.choice(["", "", ".", "\n"]) for _ in range(n))
    rows = [(i, text(r.randrange(0, 60)), r.choice(["nl", "fr", None]), r.choice(["hot", "hot", "hot", f"s{i % 5}", None, "é"]), i if i % 7 else None) for i in range(140)]
    rows += [(3, rows[3][1], rows[3][2], rows[3][3], rows[3][4])] * 3  # repeated rows
    rows += [(None, "a\nb", "nl", "hot", 1), (None, None, None, None, None), (500, "", "nl", "hot", 0), (501, None, "de", "only", 0), (502, "x\n" * 30_000, "nl", "hot", 9)]
    rows += [(600, "Licensed under CC BY-NC 4.0. cc by nc cc  by\nnc", "en", "s1", 1), (601, "Released under the MIT License.", "en", "s1", 1), (602, f"{MIT} {MIT.upper()}", "en", "s1", 1), (603, "the mit license under", "en", "s1", 1)]
    rows += [(604, "GNU General Public License as published by the Free Software Foundation, Inc; either version 3", "en", "s1", 1), (605, "version 20 apache license version 2 " * 400, "en", "s1", 1), (606, "underthemitlicense ünder the mit license cc by ncé", "en", "s1", 1)]
    rows += [(607, "GNU General Public LİCENSE, version 3", "en", "s1", 1), (608, "GNU GENERAL PUBLIC LICENSE VERSION 3", "en", "s1", 1)]
    return spark.createDataFrame([(*x, 1, 2, "c", "d", "e", "f") for x in rows], SCHEMA).repartition(4).cache()


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def by_hand(rows):
    leaf = lambda r, t: sha(*[encoded(r[c]) for c in ("doc_id", "source", "lang", "n_chars")], encoded(t))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    def beside(tree, i):
        for level in tree[:-1]:
            start = i // 3 * 3
            yield level[start:i], level[i + 1 : start + 3]
            i //= 3

    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for k in order:
        groups[k].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = {k: levels([leaf(r, r["text"]) for r in groups[k]]) for k in order}
    top = levels([trees[k][-1][0] for k in order])
    for place, k in enumerate(order):
        for i, r in enumerate(groups[k]):
            bent = r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            node, proof = leaf(r, r["text"].replace("\n", "") if bent else r["text"]), []
            for left, right in [*beside(trees[k], i), *beside(top, place)]:
                proof += left + right
                node = sha(*left, node, *right)
            yield r["doc_id"], trees[k][0][i], trees[k][-1][0], top[-1][0], sha(*proof), node, node == top[-1][0]


def manifest(docs):
    out = merkle_manifest.manifest(docs, merkle_manifest.tampered(F.col("text"), F.col("doc_id")))
    return Counter(tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof", "folded", "verified").collect())


def test_manifest(docs, monkeypatch):
    want = Counter(by_hand(docs.collect()))
    assert manifest(docs) == want
    assert {v for *_, v in want} == {True, False}
    monkeypatch.setattr(merkle_manifest, "SPREAD", 3)  # copies of nodes near the top, as large tables have them
    assert manifest(docs) == want


def test_manifest_of_one_row_and_of_none(docs):
    for one in (docs.where("doc_id = 501"), docs.where("doc_id = 3"), docs.where("source = 's1'"), docs.where("doc_id in (501, 601)")):
        assert manifest(one) == Counter(by_hand(one.collect()))
    assert not manifest(docs.limit(0))


def audited(rows, least, top):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    count, held = defaultdict(Counter), defaultdict(Counter)
    groups = {(r["lang"] or "", r["source"] or "") for r in rows}
    for r in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(r["text"]))
        count[r["lang"] or "", r["source"] or ""].update(terms)
        held[r["lang"] or ""].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in held[lang].items() if n >= least]
        sources = sorted((s for at, s in groups if at == lang), key=str.encode)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        whole = shares(sum((count[lang, s] for s in sources), Counter()))
        p = {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            found = {"pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s], "term": [(f(p[s][t], whole[t]), t) for t in kept if count[lang, s][t] and p[s][t] > whole[t]]}
            for part, items in found.items():
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= top}
    return out


@pytest.mark.parametrize("bits", [64, 3, 1])
@pytest.mark.parametrize("least,top", [(10, 10), (2, 3), (1000, 10)])
def test_audit(docs, bits, least, top):
    got = source_audit.audit(docs, least, top, bits).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == audited(docs.collect(), least, top)


def test_audit_hands_on_what_a_task_holds(docs, monkeypatch):
    monkeypatch.setattr(source_audit, "HELD", 5)
    assert {tuple(r) for r in source_audit.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect()} == audited(docs.collect(), 10, 10)


def test_audit_of_no_rows(docs):
    assert source_audit.audit(docs.limit(0)).count() == 0


def test_shares_of_huge_counts(spark):
    n, total, terms = 3 * 10**15, 9 * 10**17, 10**9
    got = spark.range(1).select(source_audit.share(F.lit(n), F.lit(total), F.lit(terms))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * terms)


def scanned(rows, found):
    split = [re.findall(license_scan.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")) for r in rows]
    df = Counter(w for x in split for w in set(x))
    weight = lambda w: ((len(rows) + 1) // (df[w] + 1)).bit_length()
    for r, ws in zip(rows, split):
        places, labels, base, score = [], set(), set(), 0.0
        for t in found:
            for o in range(len(ws)):
                if all(any(j >= 0 and tuple(ws[j : j + len(p)]) == p for j in range(o + at - off, o + at + off + 1)) for at, off, p in t.phrases):
                    near = set(ws[o : o + len(t.words) + t.phrases[-1][1]])
                    labels.add(t.label)
                    score = max(score, sum(weight(w) for w in set(t.words) & near) / sum(weight(w) for w in set(t.words)))
                    if t.base:
                        base.add(t.label)
                        places.append(o)
        yield r["doc_id"], len(ws), tuple(sorted(places)), ",".join(sorted(base)), ",".join(sorted(labels)), score


def licences(docs, **more):
    base = F.filter("matches", lambda m: m["base"])
    out = license_scan.scan(docs, **more).withColumn("base", base)
    spots = F.array_sort(F.flatten(F.transform("base", lambda m: m["places"])))
    score = F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0))
    return Counter((r[0], r[1], tuple(r[2]), *r[3:]) for r in out.select("doc_id", "n_words", spots, license_scan.listed(F.col("base")), license_scan.listed(F.col("matches")), score).collect())


def test_licences(docs):
    want = Counter(scanned(docs.collect(), license_scan.templates()))
    assert licences(docs) == want
    assert licences(docs, anchors=1) == want and licences(docs, anchors=9) == want  # what is looked up first decides nothing
    labels = {i: got for i, _, _, _, got, _ in want if i}
    assert labels[600] == "cc-by-nc" and labels[601] == labels[602] == "mit" and labels[603] == labels[606] == labels[607] == "" and labels[604] == labels[608] == "gpl-3" and labels[605] == "apache-2"


def test_licences_of_no_rows_and_of_other_templates(docs):
    assert not licences(docs.limit(0))
    own = [license_scan.parsed("own", "[de de] het [aap]"), license_scan.parsed("rep", "[x x] y x [x]")]
    assert licences(docs, found=own) == Counter(scanned(docs.collect(), own))
    with pytest.raises(ValueError):
        license_scan.parsed("late", "no phrase [at first]")


def test_licences_run_in_the_engine(docs):
    plan = license_scan.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
