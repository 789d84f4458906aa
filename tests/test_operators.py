"""Operators against brute force and at the edges of their rules."""

import itertools
import random
import re
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from sievewright.functions import text as X
from sievewright.functions.rules import Rules, Term
from sievewright.operators import chains, facets, impact, limits, overlap, retrieve, rule_tables, select, store, tables, validate
from sievewright.sources import feeds, pages
from sievewright.streaming import limits as streaming


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# store


def test_ids_take_the_next_free_number(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a-2"), (5, "b"), (6, "b")], "n long, base string")
    held = spark.createDataFrame([("a",), ("b-2",)], "id string")
    got = {r["n"]: r["id"] for r in rows_of(store.unique_ids(rows, "base", "n", held))}
    assert len(set(got.values())) == 6 and got[1] == "a-2" and got[2] == "a-3" and got[5] == "b" and got[6] == "b-3"


def test_digits_that_no_id_was_given_take_no_number(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c"), (6, "c")], "n long, base string")
    held = spark.createDataFrame([("a-1",), ("b-02",), ("c-2",), ("c-9000000000",)], "id string")
    got = {r["n"]: r["id"] for r in rows_of(store.unique_ids(rows, "base", "n", held))}
    assert got == {1: "a", 2: "a-2", 3: "b", 4: "b-2", 5: "c", 6: "c-3"}


def test_upsert_keeps_ids_and_checks(spark):
    old = spark.createDataFrame([("k1", 1, "x", "kandidaat"), ("k2", 2, "y", "kandidaat")], "url_key string, id long, title string, status string")
    new = spark.createDataFrame([("k1", 9, "z", "verwerkt"), ("k3", 3, "w", "kandidaat")], old.schema)
    got = {r["url_key"]: (r["id"], r["title"], r["change"]) for r in rows_of(store.upsert(old, store.checked(new)))}
    assert got == {"k1": (1, "z", "replaced"), "k2": (2, "y", "kept"), "k3": (3, "w", "added")}
    for bad in ([("", 1, "x", "kandidaat")], [("k", 1, "x", "weg")]):
        with pytest.raises(PySparkException):
            store.checked(spark.createDataFrame(bad, old.schema)).collect()


def test_patch_sets_deletes_and_refuses_strangers(spark):
    old = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "id long, x string, y string")
    change = spark.createDataFrame([(1, ["x"], None, "z")], "id long, fields_set array<string>, x string, y string")
    assert {tuple(r.values()) for r in rows_of(store.patch(old, change, "id", ("x", "y")))} == {(1, None, "b"), (2, "c", "d")}
    with pytest.raises(PySparkException):
        store.patch(old, change.withColumn("id", F.lit(9)), "id", ("x", "y")).collect()


# overlap


def test_overlap_equals_brute_force(spark):
    rng = random.Random(1)
    words = [f"woord{k}x" for k in range(25)]
    side = lambda n, at: [(at + i, at + i, " ".join(rng.choices(words, k=rng.randrange(6))), rng.choice([None, "p", "q"])) for i in range(n)]
    mine, theirs = side(120, 0), side(120, 1000)
    df = lambda rows: spark.createDataFrame(rows, "id long, ord long, title string, category string")
    got = {r["id"]: (r["match"], round(r["score"], 9)) for r in rows_of(overlap.best_overlap(df(mine), df(theirs)))}
    want = {}
    for i, _, a, c in mine:
        best = None
        for j, _, b, d in theirs:
            x, y = set(a.split()), set(b.split())
            if x and y and (c is None or d is None or c == d) and (s := len(x & y) / len(x | y)) >= 0.4 and (best is None or s > best[1]):
                best = (j, s)
        if best:
            want[i] = (best[0], round(best[1], 9))
    assert got == want


def test_titles_meet_by_two_words_and_category(spark):
    """Sets that share one word, or are of two categories, make no joined row."""
    many = spark.createDataFrame([(i, i, f"gedeeld eigen{i}x ander{i}x", "p" if i % 2 else "q") for i in range(60)], "id long, ord long, title string, category string")
    sets = many.select(F.col("id").alias("set"), F.split("title", " ").alias("words"), "category")
    keys = overlap._keyed(sets, overlap._two(F.col("words"), F.col("category")), "x")
    assert keys.count() == keys.select("key").distinct().count() == 180
    assert {r["match"] == r["id"] for r in rows_of(overlap.best_overlap(many, many))} == {True}


def test_newer_year(spark):
    df = lambda rows: spark.createDataFrame(rows, "id long, ord long, title string")
    mine = df([(1, 1, "Tarieven inkomstenbelasting boxen 2025"), (2, 2, "Tarieven inkomstenbelasting"), (3, 3, "Aangifte 2025")])
    theirs = df([(10, 10, "Tarieven inkomstenbelasting boxen 2024"), (11, 11, "Boxen en tarieven inkomstenbelasting 2026"), (12, 12, "Tarieven inkomstenbelasting boxen 2025")])
    assert [tuple(r.values()) for r in rows_of(overlap.newer_year(mine, theirs))] == [(1, 11, 2026, 2025)]


# selection


def test_budget_equals_a_loop(spark):
    rng = random.Random(4)
    rows = [(f"s{k}", i, rng.random() < 0.6) for k in range(5) for i in range(rng.randrange(1, 15))]
    df = spark.createDataFrame(rows, "source string, pos long, ok boolean")
    rank = F.substring("source", 2, 2).cast("int")
    for budget, cap in itertools.product((0, 3, 9, 100), (2, 5)):
        got = {(r["source"], r["pos"]): (r["recorded"], r["evaluated"]) for r in rows_of(select.budgeted(df, "source", "pos", F.col("ok"), F.lit(cap), rank, budget))}
        left, want = budget, {}
        for k in range(5):
            n = 0
            for s, i, ok in (r for r in rows if r[0] == f"s{k}"):
                seen = n < min(cap, left)
                want[s, i] = (seen and ok, seen)
                n += seen and ok
            left -= n
        assert got == want


def test_diversified_equals_the_loop(spark):
    rng = random.Random(7)
    for _ in range(4):
        rows = [(i, rng.choice("ab"), rng.choice("xyz"), rng.random() < 0.2, rng.randrange(3), rng.randrange(9)) for i in range(30)]
        order = sorted(rows, key=lambda r: (-r[3], -r[4], -r[5], r[0]))
        want = []
        for r in order:
            if len(want) < 5 and sum(w[1] == r[1] for w in want) < 2 and sum(w[2] == r[2] for w in want) < 2:
                want.append(r)
        want += [r for r in order if r not in want][: 5 - len(want)]
        got = rows_of(select.diversified(spark.createDataFrame(rows, "id long, category string, source string, featured boolean, weight int, published long"), limit=5))
        assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == [r[0] for r in want]


def test_topics_suppress_overlap_and_hold_back_the_last_tier(spark):
    day = "2024-01-0{}"
    rows = [(1, "Nieuwe tarieven loonheffing", "p", 1, False, day.format(5)), (2, "Tarieven loonheffing nieuwe", "p", 1, False, day.format(4)), (3, "Subsidie innovatie bedrijven", "p", 2, True, day.format(3)), (4, "Uitleg rechtsvorm kiezen", "q", 3, True, day.format(9)), (5, "Heel ander verhaal", "q", 2, False, day.format(1))]
    df = spark.createDataFrame(rows, "id long, title string, category string, tier int, important boolean, published string").withColumn("published", F.to_timestamp("published"))
    got = {r["id"]: (r["choice"], r["why"]) for r in rows_of(select.pick_topics(df))}
    assert [i for i, x in got.items() if x[0] == "selected"] == [1, 3]
    assert got[2][1] == "overlap met gekozen onderwerp" and got[4][1] != "gekozen" and got[5][1] == "maximum bereikt"
    only = rows_of(select.pick_topics(df.where("tier = 3")))
    assert [r["choice"] for r in only] == ["selected"]


@pytest.mark.parametrize("name", ["topics", "candidate_reasons"])
def test_candidates_leave_their_texts_behind(spark, monkeypatch, name):
    """What is joined, ranked and told holds no text, and the choice reads the documents no more."""
    from sievewright.plans import select as plans

    seen, best = [], plans.O.best_overlap
    monkeypatch.setattr(plans.O, "best_overlap", lambda mine, theirs: seen.extend([mine, theirs]) or best(mine, theirs))
    out = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(seen) == 2 and not any("text" in df.columns for df in seen)
    assert not any("documents.parquet" in f for df in (*seen, out) for f in df.inputFiles())


def test_topics_leave_out_yearly_subjects_already_treated(spark, tmp_path):
    """A subject of a year that a labelled document treats for that year or a later one, and changes announced for a day to come, as in its SQL."""
    import duckdb
    from sievewright.plans import select as plans

    filler = " ".join(f"woord{i}" for i in range(120))
    texts = [
        (1, "src3", f"Overzicht vrijstellingen huurinkomsten ondernemers 2023 belastingkantoor amsterdam wijzer {filler}", True),
        (2, "src5", f"Vrijstellingen huurinkomsten 2023 ondernemers en van de het {filler}", False), (3, "src5", f"Vrijstellingen huurinkomsten 2025 ondernemers en van de het {filler}", False),
        (4, "src5", f"Vrijstellingen huurinkomsten jaarlijks ondernemers en van de het {filler}", False), (5, "src2", f"Iets nieuws op komst {filler} de wet geldt per 31 april 2024.", False),
        (6, "src2", f"Iets ouds voorbij {filler} de wet geldt per 1 maart 2021.", False), (7, "src4", f"Geheel anders {filler} {filler} de wet ingaat op 2031 en meer.", False),
    ]
    spark.createDataFrame([(i, t, "nl", s, len(t)) for i, s, t, _ in texts], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _, _, labelled in texts if labelled], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(tuple(r.values()) for r in rows_of(plans.topics(spark, str(tmp_path)).select("id", "tier", "reason", "choice")))
    told = {r[0]: r[2] for r in got}
    assert told[2] == "jaargebonden onderwerp al behandeld" and told[5] == "aangekondigde wijziging" and "jaargebonden onderwerp al behandeld" not in (told[3], told[4])
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(con.sql(f"SELECT id, tier, reason, choice FROM ({plans.SQL['topics']})").fetchall())


def test_ingest_joins_no_texts(spark, monkeypatch):
    from sievewright.plans import select as plans

    seen, known = [], plans.T.known_urls
    monkeypatch.setattr(plans.T, "known_urls", lambda rows, **k: seen.append(rows) or known(rows, **k))
    plans.ingested(spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and "text" not in seen[0].columns and not any("documents.parquet" in f for f in seen[0].inputFiles())


def test_tiers_in_steps_equal_those_in_one_expression(spark):
    from sievewright.functions.rules import SAMPLE
    from sievewright.operators import classify

    texts = ["Keiten lytion", "wat is een keit", "lich-ontion", "thereas und", None, "", "under thing", "elle wat is de", "mente lytion ontion"]
    rows = spark.createDataFrame([(a, b) for a in ("x lytion", "keit", "", None) for b in texts], "title string, text string")
    tier, _ = classify.tier(F.col("title"), F.col("text"), SAMPLE)
    got = rows_of(classify.tiered(rows, SAMPLE).withColumn("want", tier))
    assert len({r["want"] for r in got}) == 3 and all(r["strength"] == r["want"] for r in got)


def test_month_ends_are_clamped(spark):
    now = F.lit("2024-08-31").cast("timestamp")
    df = spark.createDataFrame([("2024-02-29",), ("2024-02-28",), (None,)], "d string").withColumn("t", F.to_timestamp("d"))
    assert [r[0] for r in df.select(select.too_old(F.col("t"), 6, now)).collect()] == [False, True, True]


# retrieval


def test_scores_equal_brute_force_with_aliases(spark):
    rng = random.Random(3)
    vocab = ["arbeidsongeschiktheidsverzekering", "arbeidsongeschiktheid", "basisverzekering", "btw", "bv", "de", "auto"]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, text(4), text(8)) for i in range(20)]
    asked = [(f"q{i}", text(rng.randrange(6))) for i in range(20)]
    idx = retrieve.index(spark.createDataFrame(items, "id long, title string, content string"), [(F.col("title"), 2), (F.col("content"), 1)])
    got = {(r["qid"], r["id"]): r["score"] for r in rows_of(retrieve.scores(spark.createDataFrame(asked, "qid string, text string"), idx))}
    hit = lambda w, t: w in t or w == vocab[0] and {vocab[1], vocab[2]} <= t
    want = Counter()
    for q, s in asked:
        for i, a, b in items:
            for w in s.split():
                if w != "de":
                    want[q, i] += 2 * hit(w, set(a.split())) + hit(w, set(b.split()))
    assert got == {k: v for k, v in want.items() if v}


def promoted(rows):
    ranked = sorted(rows, key=lambda r: (-r[1], r[3] is not None, -r[4], r[0]))
    for i in range(len(ranked)):
        to = ranked[i][3]
        j = next((k for k in range(i + 1, len(ranked)) if to and ranked[k][2] == to), None)
        if j is not None:
            ranked.insert(i, ranked.pop(j))
    return [r[0] for r in ranked]


@pytest.mark.parametrize("most", [1, 2, 3, 50])
def test_promotion_equals_the_list_form(spark, most):
    rng = random.Random(11)
    articles, scored, want = [], [], {}
    for q in range(150):
        n = rng.randrange(2, 9)
        url = lambda: f"u{q}-{rng.randrange(n)}"  # noqa: B023, E731
        rows = [(100 * q + i, rng.randrange(2, 5), f"u{q}-{i}" if q % 3 else url(), rng.choice([None, url(), url()]), rng.randrange(4)) for i in range(n)]  # a third share urls
        articles += [(i, i, u, s, p) for i, _, u, s, p in rows]
        scored += [(f"q{q}", r[0], r[1]) for r in rows]
        want[f"q{q}"] = promoted(rows)[:most]
    out = retrieve.ranked_articles(spark.createDataFrame(scored, "qid string, id long, score long"), spark.createDataFrame(articles, "id long, ord long, url string, superseded_by string, published long"), most)
    got = {}
    for r in sorted(rows_of(out), key=lambda r: (r["qid"], r["place"])):
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == want


def test_a_chain_of_a_thousand_successors(spark):
    rows = [(i, 5, f"u{i}", f"u{i + 1}", 2000 - i) for i in range(1000)] + [(1000, 5, "u1000", "u1000", 0)]
    articles = spark.createDataFrame([(i, i, u, s, p) for i, _, u, s, p in rows], "id long, ord long, url string, superseded_by string, published long")
    out = retrieve.ranked_articles(spark.createDataFrame([("q", r[0], r[1]) for r in rows], "qid string, id long, score long"), articles, 2000)
    assert [r["id"] for r in sorted(rows_of(out), key=lambda r: r["place"])] == promoted(rows)


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    pick = lambda n: " ".join(words[min(59, int(rng.paretovariate(0.7)) - 1)] for _ in range(n))
    items = [(i, pick(rng.randrange(0, 4)), pick(rng.randrange(0, 30)) + rng.choice(["", "", " arbeidsongeschiktheid basisverzekering"])) for i in range(400)]
    asked = [(f"q{i}", pick(rng.randrange(0, 9)) + rng.choice(["", "", "", " arbeidsongeschiktheidsverzekering"])) for i in range(80)]
    asked += [("same", asked[3][1]), ("none", "w999"), ("empty", ""), ("null", None)]
    return items, asked


def overlap_score(question, fields):
    tokens = lambda t: [w for w in (t or "").split() if len(w) > 1]
    total = 0
    for text, weight in fields:
        held = set(tokens(text))
        total += weight * sum(w in held or w == "arbeidsongeschiktheidsverzekering" and {"arbeidsongeschiktheid", "basisverzekering"} <= held for w in tokens(question))
    return total


@pytest.mark.parametrize("most,weights,long_", [(1, (1, 1), 10), (2, (2, 1), 50_000), (5, (3, 1), 25)])
def test_the_index_finds_what_a_loop_finds(spark, library, monkeypatch, most, weights, long_):
    monkeypatch.setattr(impact, "LONG", long_)  # lists this long are dealt over salts
    items, asked = library
    want = {}
    for q, text in asked:
        scores = [(overlap_score(text, [(t, weights[0]), (b, weights[1])]), i % 7, i) for i, t, b in items]
        best = sorted((x for x in scores if x[0] >= 2), key=lambda x: (-x[0], x[1], x[2]))[:most]
        want |= {(q, place): (i, score) for place, (score, _, i) in enumerate(best, 1)}
    rows = spark.createDataFrame(items, "id long, title string, body string").withColumn("tie", F.col("id") % 7)
    idx = impact.build(rows, [(F.col("title"), weights[0]), (F.col("body"), weights[1])], most=most)
    best, named, told = impact.top(spark.createDataFrame(asked, "qid string, text string"), idx, rows.select("id", "tie"), [F.col("tie"), F.col("id")], most, 2)
    got = {(r["qid"], r["place"]): (r["id"], r["score"]) for r in rows_of(named.join(best, "bag"))}
    assert got == want
    bars = impact.thresholds(told, idx, most, 2)
    listed = impact.opened(told, idx, bars)[0].agg(F.sum("size")).first()[0]
    assert listed < told.agg(F.sum("df")).first()[0] / 2  # most postings of what is asked are never listed


def test_a_part_keeps_the_first_places_over_blocks():
    """Equal scores go to the earlier rank; a question is done once all its tokens are met so often."""
    part = impact.Part(2, 2)
    for token, n in (("a", 1), ("b", 2)):
        part.ask("q", token, n, 1, 7)
    part.block(0, [("a", 1, [0, 5]), ("b", 1, [5, 9]), ("b", 3, [7])])
    assert part.bags["q"]["best"] == [(6, 7), (3, 5)]
    part.block(impact.BLOCK, [("a", 1, [1, 2]), ("b", 3, [2, 3]), ("b", 1, [1])])
    assert part.bags["q"]["best"] == [(7, impact.BLOCK + 2), (6, 7)]  # (6, BLOCK + 3) comes later
    part.block(2 * impact.BLOCK, [("a", 1, [0]), ("b", 3, [0])])
    part.block(3 * impact.BLOCK, [("a", 1, [0]), ("b", 3, [0])])
    assert [r[1:] for r in part.rows()] == [(impact.BLOCK + 2, 7), (2 * impact.BLOCK, 7)]


def test_items_are_dealt_once_over_blocks(spark, library, monkeypatch):
    """Blocks of few items find what a loop finds, also past 255 points; a task's items are not copied for parts of the questions."""
    items, asked = library
    asked = [*asked, ("long", " ".join(["w1"] * 300 + ["w2", "w40"]))]
    seen, frame = [], type(spark.range(1))
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **k: seen.append(self) or plain(self, *a, **k))
    monkeypatch.setattr(impact, "SLOTS", 90, raising=False)
    rows = spark.createDataFrame(items, "id long, title string, body string").withColumn("tie", F.col("id") % 7)
    idx = impact.build(rows, [(F.col("title"), 2), (F.col("body"), 1)], most=2)
    best, named, _ = impact.top(spark.createDataFrame(asked, "qid string, text string"), idx, rows.select("id", "tie"), [F.col("tie"), F.col("id")], 2, 2)
    got = {(r["qid"], r["place"]): (r["id"], r["score"]) for r in rows_of(named.join(best, "bag"))}
    want = {}
    for q, text in asked:
        scores = sorted((-overlap_score(text, [(t, 2), (b, 1)]), i % 7, i) for i, t, b in items)
        want |= {(q, place): (i, -s) for place, (s, _, i) in enumerate(scores[:2], 1) if -s >= 2}
    assert got == want and got["long", 1][1] > 255
    told = [r for df in seen for r in rows_of(df)]
    assert len({r["block"] for r in told}) >= 5
    copied = sum(len(str(r)) for r in told if not r.get("bag") and r.get("kind") != 2)  # all but questions
    assert copied < 5 * sum(len(t) + len(b) + 60 for _, t, b in items)


def test_contexts_carry_no_bodies(spark, monkeypatch):
    """An article is cut once; what is written and joined per question holds no whole text."""
    from sievewright.plans import retrieve as plans

    seen, keep = {}, plans.written
    monkeypatch.setattr(plans, "written", lambda df, name, **k: seen.setdefault(name, keep(df, name, **k)))
    _, _, read = plans._sources(spark, "/root/testdata/sf0.001")
    assert not any("body" in df.columns for df in (read, *seen.values()))
    assert not any("documents.parquet" in f for f in read.inputFiles())


def test_substitution_is_sequential(spark):
    articles = spark.createDataFrame([(1, "a", "n"), (2, "b", "n"), (3, "n", None), (4, "c", "d"), (5, "d", None), (6, "d", None)], "id long, url string, superseded_by string")
    chosen = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 3, 4), ("r", 1, 3), ("r", 2, 1)], "qid string, place int, id long")
    got = {(r["qid"], r["place"]): r["id"] for r in rows_of(retrieve.substituted(chosen, articles))}
    assert got == {("q", 1): 3, ("q", 2): 2, ("q", 3): 4, ("r", 1): 3, ("r", 2): 1}


def test_citations_fall_back_to_the_first_four(spark):
    answers = spark.createDataFrame([("q", [9, 2], False), ("r", [9], False), ("s", [9], True)], "qid string, cited array<long>, insufficient boolean")
    sources = spark.createDataFrame([(q, i, i) for q in "qrs" for i in range(1, 6)], "qid string, place int, id long")
    assert {r["qid"]: r["ids"] for r in rows_of(retrieve.cited(answers, sources))} == {"q": [2], "r": [1, 2, 3, 4], "s": []}


# validation


def test_facts_against_source(spark):
    row = spark.createDataFrame([("Vanaf 1 januari 2026 is het € 1.250,50 of 21 procent, eerst 2 miljoen.", "Het bedrag is 1.250,50 euro per 01 januari, 19%.")], "a string, s string")
    got = row.select(validate.unsupported(F.col("a"), F.col("s")).alias("x")).first()[0]
    assert {(r["kind"], r["value"]) for r in got} == {("percentage", "21"), ("amount", "2"), ("year", "2026")}


def test_status_claims_and_details(spark):
    row = spark.createDataFrame([("De regel is van kracht. Het geldt momenteel. De ondernemer krijgt subsidie.", "voorstel", "Het wetsvoorstel ligt er. De ondernemer krijgt subsidie mits jaarlijks administratie gevoerd. U vraagt het aan bij de gemeente binnen 30 dagen volgens artikel 5 awr.")], "a string, st string, s string")
    now = F.lit("2025-01-01").cast("timestamp")
    errors, claims, dropped, missing = row.select(validate.status_errors(F.col("a"), F.col("st"), F.col("s"), now, ("voorstel",)), validate.claims(F.col("a"), F.col("s")), validate.dropped_qualifiers(F.col("a"), F.col("s")), validate.missing_details(F.col("a"), F.col("s"))).first()
    assert errors == ["voorlopig zonder voorbehoud", "voorlopig maar geldend genoemd"]
    assert claims == ["geldt momenteel"]
    assert len(dropped) == 1 and "mits" in dropped[0]
    assert missing == ["artikel 5 awr", "binnen 30 dagen", "gemeente"]


# facets


def test_audience_orders_but_does_not_filter(spark):
    df = spark.createDataFrame([(1, 1, "a", "p", "x", ["k"]), (2, 2, "b", "p", "x", ["g"]), (3, 3, "c", "q", "x", ["g"])], "id long, ord long, title string, category string, source string, audiences array<string>")
    found = facets.search(df, category="p", audience="g")
    assert [r["id"] for r in rows_of(facets.shown(found))] == [2, 1]
    assert facets.valid(df, "category", "zz") is None and facets.active("p", None, "") == 1


# limits


def loop(hits, limit, weighted):
    kept, out = {}, {}
    for i, k, t, w in sorted(hits, key=lambda h: (h[2], h[0])):
        used = sum(x for s, x in kept.get(k, []) if t - s < limit.micros)
        out[i] = used + w <= limit.most if weighted else used < limit.most
        if out[i]:
            kept.setdefault(k, []).append((t, w if weighted else 1))
    return out


@pytest.fixture(scope="module")
def hits(spark, tmp_path_factory):
    rng = random.Random(6)
    rows = [(i, rng.randrange(4), rng.randrange(200) * 1_000_000, float(rng.randrange(1, 5))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, key long, t long, w double").select("id", "key", F.timestamp_micros("t").alias("ts"), "w")
    path = str(tmp_path_factory.mktemp("hits"))
    df.orderBy("ts", "id").coalesce(1).write.mode("overwrite").parquet(path)
    return rows, df, path


@pytest.mark.parametrize("weighted", [False, True])
def test_stream_equals_replay_equals_loop(spark, hits, tmp_path, weighted):
    rows, df, path = hits
    limit = limits.Limit(10, 6)
    want = loop(rows, limit, weighted)
    assert {r["id"]: r["admitted"] for r in rows_of(limits.replay(df, limit, weighted))} == want
    stream = spark.readStream.schema(df.schema).parquet(path)
    streaming.to_completion(streaming.limited(stream, limit, weighted), f"{tmp_path}/out", f"{tmp_path}/state")
    assert {r["id"]: r["admitted"] for r in rows_of(spark.read.parquet(f"{tmp_path}/out"))} == want


def test_window_edge_is_open(spark):
    df = spark.createDataFrame([(1, 1, 0, 1.0), (2, 1, 10, 1.0), (3, 1, 10, 1.0), (4, 1, 19, 1.0)], "id long, key long, s long, w double").withColumn("ts", F.timestamp_seconds("s"))
    assert [r["used"] for r in sorted(rows_of(limits.usage(df, limits.Limit(10, 9))), key=lambda r: r["id"])] == [1, 1, 2, 3]


def test_three_limits(spark):
    df = spark.createDataFrame([(i, 0, i % 2, i, 10.0, i != 2) for i in range(8)], "id long, lane long, key long, s long, w double, ok boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["decision"] for r in rows_of(limits.combined(df, limits.Limit(60, 4), limits.Limit(60, 2), limits.Limit(60, 45)))}
    assert got == {0: "toegelaten", 1: "toegelaten", 2: "mislukt", 3: "toegelaten", 4: "tokenlimiet", 5: "eigen limiet", 6: "tokenlimiet", 7: "eigen limiet"}


def three_by_hand(hits, everyone, each, tokens):
    """Decisions and what a client has used after them, hit by hit."""
    done, held = [], []
    for i, lane, key, t, w, ok in sorted(hits, key=lambda h: (h[3], h[0])):
        recent = [h for h in done if h[0] == lane and t - h[2] < everyone.seconds]
        own = [h for h in done if h[:2] == (lane, key) and t - h[2] < each.seconds]
        weight = sum(h[1] for h in held if h[0] == lane and t - h[2] < tokens.seconds)
        stop = "algemene limiet" if len(recent) >= everyone.most else "eigen limiet" if len(own) >= each.most else "tokenlimiet" if weight + w > tokens.most else None
        if not stop:
            held.append((lane, w, t))
            if ok:
                done.append((lane, key, t))
        yield i, key, stop or ("toegelaten" if ok else "mislukt"), len(own) + (not stop and ok)


def test_three_limits_as_a_stream_and_after_a_restart(spark, tmp_path):
    rng = random.Random(2)
    at, hits = 1000, []
    for i in range(600):
        at += rng.choice([0, 0, 1, 1, 2, 40 if i % 97 == 0 else 3])
        hits.append((i, i % 2, rng.randrange(5), at, float(rng.randrange(1, 9)), rng.random() < 0.8))
    three = limits.Limit(20, 6), limits.Limit(30, 3), limits.Limit(15, 40)
    want = set(three_by_hand(hits, *three))
    assert len({w[2] for w in want}) == 5
    frame = lambda rows: spark.createDataFrame(rows, "id long, lane long, key long, s long, w double, ok boolean").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    assert {tuple(r.values()) for r in rows_of(limits.combined(frame(hits), *three))} == want
    source = f"{tmp_path}/in"
    for part in (hits[:150], hits[150:420], hits[420:]):  # each part is a run of its own, from the checkpoint of the last
        frame(part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame(hits[:1]).schema).parquet(source)
        streaming.to_completion(streaming.three_limits(stream, *three), f"{tmp_path}/out", f"{tmp_path}/state")
    got = rows_of(spark.read.parquet(f"{tmp_path}/out"))
    assert sorted(r["id"] for r in got) == [h[0] for h in hits]
    assert {tuple(r.values()) for r in got} == want


def test_a_run_is_counted_while_it_is_written(spark, tmp_path):
    rows = spark.range(1000).withColumn("even", F.col("id") % 2 == 0)
    assert store.observed_write(rows, f"{tmp_path}/run", n=F.count("*"), even=F.count_if("even"), none=F.sum(F.when(F.col("id") < 0, 1))) == {"n": 1000, "even": 500, "none": 0}
    assert spark.read.parquet(f"{tmp_path}/run").count() == 1000


def test_unanswered_questions_are_asked_with_their_history(spark):
    asked = spark.createDataFrame([("a", "x", "h"), ("b", "y", "h"), ("c", "z", ""), ("d", "w", None)], "qid string, text string, history string")
    some = lambda *ids: spark.createDataFrame([(i, 1) for i in ids], "qid string, place int")
    assert {r["qid"]: r["text"] for r in rows_of(retrieve.unanswered(asked, some("a", "a"), some()))} == {"b": "h y", "c": " z", "d": "w"}


def test_questions_a_kept_text_does_not_answer(spark):
    texts = ["Hoeveel kost het?", "wat MAG IK doen", "magik", "wat is btw", None, "Is dit beter?"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, text string")
    assert [r["n"] for r in rows_of(rows.where(retrieve.answerable(F.col("text"))))] == [2, 3, 4]


# rule tables


def test_five_thousand_keywords_in_one_pass(spark):
    rng = random.Random(8)
    part = lambda n: "".join(rng.choice("abcdeé _") for _ in range(n)).strip() or "a"
    words = list({part(rng.randrange(2, 6)) for _ in range(5000)} | {"a b", "a  b", "b\tc"})
    rows = [(i % 40, "categorie", f"c{i % 40}", i % 40, "woord", w, i % 3 == 0, i % 5 == 0, "text") for i, w in enumerate(words)]
    texts = ["", None, "A B a  b b\tc", *[part(rng.randrange(1, 60)).upper() for _ in range(150)]]
    docs = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "id long, title string, text string")
    found = rule_tables.matched(docs, spark.createDataFrame(rows, rule_tables.SCHEMA)).select("id", F.explode("matches").alias("m")).select("id", "m.name", "m.n", "m.narrow")
    want = set()
    for i, t in enumerate(texts):
        low = (t or "").lower()
        one = " ".join(low.split())
        n, narrow = Counter(), Counter()
        for _, _, name, _, _, w, whole, broad, _ in rows:
            text = low if " " in w else one
            pattern = rf"(?<![A-Za-z0-9_]){re.escape(w)}(?![A-Za-z0-9_])" if whole else re.escape(w)
            if re.search(pattern, text):
                n[name] += 1
                narrow[name] += not broad
        want |= {(i, name, n[name], narrow[name]) for name in n}
    assert {tuple(r.values()) for r in rows_of(found)} == want


def test_rules_of_terms_by_table(spark):
    rules = Rules(categories={}, signals=(Term(all=("een wet", "nu"), any=("ja", "nee"), category="x"), Term(all=("alleen",)), Term()), exclusions=(Term(any=("reclame",), unless=("toch",)), Term(any=("gratis",), scope="title")))
    texts = [("", "een  wet nu ja"), ("", "een wet nu"), ("", "alleen"), ("", "reclame alleen"), ("", "reclame toch alleen"), ("Gratis", "alleen"), ("x", "gratis alleen"), ("Gratis toch", "alleen")]
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id long, title string, text string")
    now = F.lit("2024-01-01").cast("timestamp")
    out = rule_tables.relevance(docs, rule_tables.rule_table(spark, rules), "over", (now, now))
    assert {r["id"]: (r["signal"], r["hint"], r["barred"], r["relevant"]) for r in rows_of(out)} == {
        0: (True, "x", False, True), 1: (False, None, False, False), 2: (True, None, False, True), 3: (True, None, True, False),
        4: (True, None, False, True), 5: (True, None, True, False), 6: (True, None, False, True), 7: (True, None, True, False),
    }


# chains


def test_an_index_in_a_circle(spark):
    xml = lambda *locs: "<sitemapindex>" + "".join(f"<sitemap><loc> {x} </loc></sitemap>" for x in locs) + "</sitemapindex>"
    landed = spark.createDataFrame([("r", xml("a", "b", "documents-1.xml")), ("a", xml("r", "b", "c")), ("b", xml("documents-2.xml", "other.xml")), ("c", xml("documents-2.xml", "documents-3.xml?a=1&amp;b=documents-3.xml")), ("documents-1.xml", "<urlset/>"), ("documents-2.xml", "<urlset/>"), ("other.xml", "<urlset/>"), ("not met", "<urlset/>")], "loc string, xml string")
    got = {r["loc"]: (r["level"], r["kind"]) for r in rows_of(chains.expanded(landed, spark.createDataFrame([("r",)], "loc string"), r"documents-\d+\.xml$"))}
    assert got == {"r": (0, "index"), "a": (1, "index"), "b": (1, "index"), "documents-1.xml": (1, "kaart"), "documents-2.xml": (2, "kaart"), "other.xml": (2, "andere naam"), "c": (2, "index"), "documents-3.xml?a=1&b=documents-3.xml": (3, "niet geland")}


def test_news_text_between_markers(spark):
    long_ = "Een alinea die lang genoeg is om als inhoud mee te tellen, met een zin. " * 4
    fake = f"Nieuwsbericht 01-01-2020 | 08:00 <p>nep {long_}</p> Heeft deze informatie u geholpen"
    page = f"<script>{fake}</script><!-- {fake} --><style>{fake}</style><main><p>NIEUWSBERICHT<br/>&nbsp;06-10-2025 <i>&#x7c;</i> 08:00</p><p>{long_}</p><figure>{fake}</figure><h2>Kop &#0038; staart</h2><ul><li><a href='x'>link</a></li></ul><p>{long_}</p><h2> Bijlagen </h2><p>weg {long_}</p><div>Heeft&nbsp;deze informatie u geholpen?</div><p>na {long_}</p>"
    docs = spark.createDataFrame([(1, page), (2, page.replace("NIEUWSBERICHT", "Toespraak")), (3, page.replace("u geholpen?", "iets")), (4, page.replace("Kop", "Terug naar boven")), (5, None)], "n int, html string")
    got = {r["n"]: r["body"] for r in rows_of(pages.news_bodies(docs))}
    assert got.pop(1) == f"{long_.strip()}\n\nKop & staart\n\n- link\n\n{long_.strip()}"
    assert set(got.values()) == {None}


# scans


def test_landed_files(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "2025-a.json").write_text('{"title": "A"}')
    assert rows_of(feeds.records(spark, str(tmp_path / "r"), "title string")) == [{"id": "2025-a", "title": "A"}]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.md").write_text('---\ntitle: "Zeg \\"ja\\""\ncategory: "c"\n---\ntekst')
    (tmp_path / "m" / "b.md").write_text("zonder titel")
    assert rows_of(feeds.articles(spark, str(tmp_path / "m"))) == [{"file": "a.md", "title": 'Zeg "ja"', "category": "c", "source_url": None}]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.json").write_text('[{"headRefName": "auto/1", "body": "<!-- bron: https://a -->"}, {"headRefName": "auto/2", "mergedAt": "x", "state": "MERGED", "body": "<!-- bron: https://b -->"}]')
    assert [r["url"] for r in rows_of(feeds.proposals(spark, str(tmp_path / "p"), "auto/", "bron", True))] == ["https://a"]
    (tmp_path / "p" / "y.json").write_text("geen json")
    with pytest.raises(Exception, match="FAILFAST|FAILED_READ_FILE"):
        feeds.proposals(spark, str(tmp_path / "p"), "auto/", "bron").collect()


def test_feeds(spark):
    rss = "<rss><channel><item><title>A</title><link>l</link><description></description><content:encoded>vol</content:encoded><pubDate>d</pubDate></item></channel></rss>"
    atom = '<feed xmlns="x"><entry><title>B</title><link rel="self" href="s"/><link href="t"/><summary>kort</summary><updated>u</updated></entry></feed>'
    got = rows_of(feeds.feed_items(spark.createDataFrame([(1, rss), (2, atom), (3, "<p>geen</p>")], "n long, xml string")))
    assert {(r["n"], r["title"], r["link"], r["description"], r["pub_date"]) for r in got} == {(1, "A", "l", "vol", "d"), (2, "B", "t", "kort", "u")}
    index = spark.createDataFrame([("<sitemapindex><sitemap><loc>https://x/documents-1.xml</loc></sitemap><sitemap><loc>https://x/other.xml</loc></sitemap></sitemapindex>",)], "xml string")
    assert [r["loc"] for r in rows_of(feeds.indexed_maps(index))] == ["https://x/documents-1.xml"]


def test_dependent_questions(spark):
    ask = lambda t: spark.createDataFrame([(t,)], "t string").select(retrieve.dependent(F.col("t"))).first()[0]
    assert ask("En hoe zit dat?") and not ask("Wat is KIA?") and not ask("dat " + "woord " * 12)
    assert spark.range(1).select(X.jaccard(F.expr("CAST(array() AS array<string>)"), F.array(F.lit("a")))).first()[0] == 0.0


# positions and streams


def test_spread_join_keeps_every_row_once(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"))
    few = rows.groupBy("key").agg(F.count("*").alias("n"))
    got = rows_of(tables.spread_join(rows, few, "key", "id", copies=4))
    assert len(got) == 500 and {r["id"] for r in got} == set(range(500))
    assert all(r["n"] == sum(x["key"] == r["key"] for x in got) for r in got)


def test_counted_before_equals_plain_count(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), r.choice([1, 2, 3, 4]) * 100 + i % 7, r.random() < 0.5) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g string, pos int, flag boolean").repartition(5)
    for group in ("g", None):
        got = {x["id"]: x["n"] for x in rows_of(tables.counted_before(df, group, [F.col("pos"), F.col("id")], F.col("flag"), "n"))}
        for i, g, pos, _ in rows:
            assert got[i] == sum(f for j, h, p, f in rows if (group is None or h == g) and (p, j) < (pos, i))


def test_daily_ingest_replays_a_batch_without_loss(spark, tmp_path):
    S = streaming

    source, store, state = (str(tmp_path / x) for x in ("in", "store", "state"))
    batch = lambda lo, hi: spark.createDataFrame([(i, f"https://x.nl/{i % 15}") for i in range(lo, hi)], "id long, url_key string").write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("id long, url_key string").parquet(source)
    batch(0, 10)
    S.daily_ingest(stream(), store, state)
    batch(10, 20)
    S.daily_ingest(stream(), store, state)
    first = sorted(tuple(r) for r in spark.read.parquet(f"{store}/*").select("id", "url_key").collect())
    assert len(first) == 15
    for f in (tmp_path / "state" / "commits").iterdir():  # the last batch ran, but was not committed
        if f.name.strip(".").split(".")[0] == "1":
            f.unlink()
    S.daily_ingest(stream(), store, state)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{store}/*").select("id", "url_key").collect()) == first


def test_missing_authorities_and_denied_claims(spark):
    V = validate

    row = spark.createDataFrame([("U kunt dit aanvragen bij de autoriteit financiële markten of bij DUO.", "Er is nog geen geldende regel. Dit geldt nu. Bel de AFM.")], "source string, article string")
    got = row.select(V.missing_details(F.col("article"), F.col("source")).alias("m"), V.claims(F.col("article"), F.col("source")).alias("c")).first()
    assert got["m"] == ["dienst uitvoering onderwijs"] and got["c"] == ["geldt nu"]


def test_a_source_is_asked_once_for_all_its_articles(spark, monkeypatch):
    """What the check joins to a document is what was told of its source, not the source's text to be asked again."""
    from sievewright.plans import validate as plans

    seen, join = [], plans.spread_join
    monkeypatch.setattr(plans, "spread_join", lambda rows, few, *a: seen.append(few) or join(rows, few, *a))
    out = plans.checked(spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and "source_text" not in seen[0].columns and not any("documents.parquet" in f for f in seen[0].inputFiles())
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_checks_seek_rare_words_before_patterns(spark):
    """Texts without a claim cost little more than their normal form, and the words sought first turn no match away."""
    import time

    words = "De ondernemer krijgt subsidie en betaalt belasting over het jaar. "
    df = spark.range(64).select(F.concat(F.repeat(F.lit(words), 400), F.col("id").cast("string")).alias("t")).repartition(4).cache()
    df.count()

    def took(c):
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            df.select(F.sum(F.hash(c))).collect()
            best = min(best, time.perf_counter() - began)
        return best

    assert took(validate.claims(F.col("t"), F.lit("x"))) < 4 * took(X.normal(F.col("t"))) + 0.2
    rows = ["Dit IS momenteel van kracht.", "Het geldt\u00a0nu.", "geldende&nbsp;regels", "Er zijn geen geldende regels", "Zij zijn nog altijd actueel", "niets", ""]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(rows)), "i int, t string").orderBy("i").select(validate.claims(F.col("t"), F.lit(""))).collect()]
    assert got == [["is momenteel van kracht"], ["geldt nu"], ["geldende regels"], [], ["zijn nog altijd actueel"], [], []]
    none = spark.createDataFrame([(None, "Het geldt nu.")], "s string, a string")
    s, a = F.col("s"), F.col("a")
    told = none.select(validate.missing_details(a, s), validate.excluded_audiences(F.array(F.lit("x")), s, a, {"x": ("x",)}), validate.claims(s, a), validate.dropped_qualifiers(a, s)).first()
    assert list(told) == [None, [], None, None]  # as before for an unknown source


def test_shared_folder_without_a_setting(spark):
    """A local session whose setting is unset gets one folder, the same for all that is written."""
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=spark.sparkContext)
    first, second = (tables.shared_path(unset, "x") for _ in range(2))
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
    assert spark.sparkContext.getCheckpointDir() in first


def test_values_named_in_functions_of_arrays_are_made_once(spark):
    df = spark.createDataFrame([(["Een. Twee.", "Drie."],)], "a array<string>")
    text = F.array_join("a", " ")
    for c in (X.truncate_sentence(text, 8), X.truncate_boundary(text, 8), validate.unsupported(text, F.lit("x")), validate.claims(text, F.lit("x"))):
        assert df.select(c.alias("x"))._jdf.queryExecution().analyzed().toString().count("array_join(") == 1
    assert df.select(X.truncate_sentence(text, 8)).first()[0] == "Een."


def test_a_stream_of_files_out_of_time_order_loses_no_hit(spark, tmp_path):
    from sievewright.plans import limits as queries

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").limit(60).withColumn("late", F.row_number().over(Window.orderBy("ts")) > 30)
    for late in (True, False):
        events.where(F.col("late") == late).drop("late").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    told = lambda f: {tuple(r.values()) for r in rows_of(f(spark, str(tmp_path)).select("id", "key", "decision", "used"))}
    assert told(queries.three_limits_stream) == told(queries.three_limits)
