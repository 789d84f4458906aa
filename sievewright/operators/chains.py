"""Whole ingest chains: URL lists and topic items to candidates, each row with the stage it ended at."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import text as X
from sievewright.functions.rules import Rules
from sievewright.operators import classify as K
from sievewright.operators import overlap as O
from sievewright.operators import select as S
from sievewright.operators.tables import counted_before, written
from sievewright.sources.feeds import indexed_locs, with_pages


def _first(steps: list[tuple[Column, str]], last: str) -> Column:
    return reduce(lambda rest, s: F.when(s[0], s[1]).otherwise(rest), reversed(steps), F.lit(last))


def hub_page(url: Column, hubs: tuple[str, ...]) -> Column:
    return X.first_segment(url).isin(*hubs)


def service_page(url: Column, title: Column, paths: tuple[str, ...], words: tuple[str, ...]) -> Column:
    """A page that offers a service or a product, by its path or by a word of its title."""
    return X.url_parts(url)["path"].isin(*paths) | X.any_of(F.replace(F.lower(title), F.lit("-"), F.lit(" ")), words)


def newest_first(updated: Column, *ties: str) -> list[Column]:
    """Sort keys: newest first, missing dates as the oldest, then input order."""
    return [F.coalesce(updated.cast("timestamp"), F.lit("1970-01-01").cast("timestamp")).desc(), *map(F.col, ties)]


def url_funnel(urls: DataFrame, known: DataFrame, rules: Rules, hubs: tuple[str, ...], depth: int = 2) -> DataFrame:
    """Adds ``stage`` and, for candidates, ``tier`` and ``place`` to rows of loc, lastmod, ord, text.

    In this order: repeated key, hub, wrong depth, no relevance, already known, candidate. Candidates are
    placed by tier, then newest first. Everything is decided before any page is read.
    """
    key = X.url_key(F.col("loc"))
    rows = urls.withColumn("url_key", key).withColumn("_r", F.row_number().over(Window.partitionBy("url_key").orderBy(*newest_first(F.col("lastmod"), "ord"))))
    rows = rows.join(known.select("url_key").distinct().withColumn("_known", F.lit(True)), "url_key", "left")
    tier, _ = K.tier(F.col("text"), F.col("text"), rules)
    rows = rows.withColumn("tier", tier)
    stage = _first([
        (F.col("_r") > 1, "dubbel"), (hub_page(F.col("loc"), hubs), "overzicht"), (F.size(X.path_segments(F.col("loc"))) != depth, "andere vorm"),
        (F.col("tier") == "afgewezen", "niet relevant"), (F.col("_known").isNotNull(), "bekend"),
    ], "kandidaat")
    rows = rows.withColumn("stage", stage)
    order = [F.when(F.col("tier") == "hoog", 0).otherwise(1), *newest_first(F.col("lastmod"), "ord")]
    rows = rows.withColumn("_last", (F.col("stage") != "kandidaat").cast("int"))
    placed = counted_before(rows, None, [F.col("_last"), *order], F.lit(True), "_before")
    return placed.withColumn("place", F.when(F.col("_last") == 0, F.col("_before") + 1).cast("int")).drop("_r", "_known", "_last", "_before")


def expanded(landed: DataFrame, roots: DataFrame, fits: str, most: int = 50) -> DataFrame:
    """(loc, level, kind): every sitemap that indexes lead to from ``roots`` (loc), level by level.

    ``landed`` has loc and xml. An index adds its children to the next level's frontier, a table of its own;
    what was met before, by a shorter way or in a circle, is left out. Kinds: ``index``, ``kaart`` for a map
    of URLs whose name fits, ``andere naam`` for one that does not, ``niet geland`` for one that is missing.
    """
    frontier, met, level = roots.select("loc").distinct(), None, 0
    while level < most:
        told = frontier.join(landed.select("loc", "xml"), "loc", "left")
        index = F.col("xml").rlike(r"(?i)<sitemapindex[\s>]")
        kind = _first([(F.col("xml").isNull(), "niet geland"), (index, "index"), (~F.col("loc").rlike(fits), "andere naam")], "kaart")
        now = written(told.select("loc", F.lit(level).alias("level"), kind.alias("kind"), F.when(index, indexed_locs(F.col("xml"))).alias("children")), "frontier")
        met = now if met is None else met.unionByName(now)
        frontier = written(now.select(F.explode("children").alias("loc")).distinct().join(met.select("loc"), "loc", "left_anti"), "next")
        if frontier.isEmpty():
            break
        level += 1
    return met.select("loc", "level", "kind")


def index_ingest(urls: DataFrame, pages: DataFrame, known: DataFrame, articles: DataFrame, rules: Rules, hubs: tuple[str, ...], procedures: tuple[str, ...], service: tuple[tuple[str, ...], tuple[str, ...]], page_cap: int, cap: int, depth: int = 2) -> DataFrame:
    """URLs of an index to records: the funnel on URLs first, then pages are read in order of place, and each
    row keeps the reason it ended with in ``stage``, ``vastgelegd`` for a record.

    Urls have loc, lastmod, ord, text; pages url_key, title, description; articles id, ord, title, category.
    A run reads ``page_cap`` pages and makes ``cap`` records; rows behind that are ``niet opgehaald``. Adds
    ``lowered``, whether a title without a signal lowered the tier, whatever came of the row.
    """
    rows = url_funnel(urls, known, rules, hubs, depth)
    rows = written(rows, "funnel")
    read = with_pages(rows.where((F.col("stage") == "kandidaat") & (F.col("place") <= page_cap)).drop("stage", "tier", "text"), pages, required=False)
    both = F.concat_ws(" ", "title", "description")
    tier, why = K.tier(F.col("title"), F.col("description"), rules)
    read = read.withColumns({"_tier": tier, "_why": why, "category": K.best_category(both, rules)})
    read = written(read, "read")
    alike = O.best_overlap(read.where("title IS NOT NULL").select(F.col("ord").alias("id"), "ord", "title", "category"), articles).select(F.col("id").alias("ord"), F.lit(True).alias("_alike")).distinct()
    read = read.join(alike, "ord", "left")
    offered = X.any_of(F.lower(both), procedures) | service_page(F.col("loc"), F.coalesce("title", F.lit("")), *service)
    late = _first([
        (F.col("title").isNull() | F.col("description").isNull(), "geen titel of samenvatting"), (offered, "procedure of dienst"),
        (F.col("_tier") == "afgewezen", "pagina niet relevant"), (F.col("_alike").isNotNull(), "overlap"),
    ], "vastgelegd")
    read = written(read.select("ord", "place", late.alias("_stage"), ((F.col("_why") == "titel zonder signaal") & ~offered).alias("_lowered")), "late")
    read = counted_before(read, None, [F.col("place")], F.col("_stage") == "vastgelegd", "_n").where(F.col("_n") < cap)
    out = rows.join(read.select("ord", "_stage", "_lowered"), "ord", "left")
    stage = F.coalesce("_stage", F.when(F.col("stage") == "kandidaat", "niet opgehaald").otherwise(F.col("stage")))
    return out.withColumns({"stage": stage, "lowered": F.coalesce("_lowered", F.lit(False)), "recorded": stage == "vastgelegd"}).drop("_stage", "_lowered")


def topic_ingest(items: DataFrame, pages: DataFrame, known: DataFrame, rules: Rules, now: Column, months: int, page_cap: int, cap: int, budget: int) -> DataFrame:
    """Items of topics to records: age and known keys first, then the page is read, then relevance and caps.

    Items have source, ord, loc, url_key, lastmod. Adds ``reason`` (null for a record) and ``recorded``.
    """
    rows = items.join(known.select("url_key").distinct().withColumn("_known", F.lit(True)), "url_key", "left")
    cheap = _first([(S.too_old(F.col("lastmod"), months, now), "te oud"), (F.col("_known").isNotNull(), "dubbel")], "")
    rows = S.read_cap(rows.withColumn("_cheap", F.nullif(cheap, F.lit(""))), "source", "ord", F.col("_cheap").isNull(), page_cap).withColumnRenamed("evaluated", "_read")
    rows = with_pages(rows, pages, required=False)
    rows = K.relevance(rows.withColumn("_text", F.concat_ws(" ", "title", "description", "body")), rules, title="title", text="_text")
    late = _first([(F.col("title").isNull(), "geen titel"), (F.length(F.coalesce("description", F.lit(""))) < 20, "korte omschrijving"), (~F.col("relevant"), "niet relevant")], "")
    rows = rows.withColumn("reason", F.coalesce("_cheap", F.nullif(late, F.lit(""))))
    rows = written(rows, "judged")
    rank = F.dense_rank().over(Window.orderBy("source"))
    names = items.select("source").distinct().withColumn("_rank", rank)  # a row per source
    rows = S.budgeted(rows.join(names, "source"), "source", "ord", F.col("reason").isNull() & F.col("_read"), F.lit(cap), F.col("_rank"), budget)
    return rows.withColumn("reason", F.when(~F.col("evaluated") | ~F.col("_read"), "niet beoordeeld").otherwise(F.col("reason")))


def judged_candidates(records: DataFrame, articles: DataFrame, pending: DataFrame, now: Column, special: Column) -> DataFrame:
    """Adds ``tier`` (1 to 3, null where none) and ``reason`` to records of id, ord, title, category, url, published,
    ``strength`` and what ``select.evidence`` adds; their texts are not needed any more.

    First a URL that an article (id, ord, title, category, source_url) is based on, then one in ``pending``
    (url) proposals; then the rules of ``select.candidate``, fed by titles that overlap an article's and by
    articles on the same yearly subject for that year or a later one. URLs meet by key; both joins on titles
    go over an index of words, and each gives a record one row at most.
    """
    keys = lambda df, c, name: df.where(F.col(c).isNotNull()).select(X.url_key(F.col(c)).alias("_key")).distinct().withColumn(name, F.lit(True))
    alike = O.best_overlap(records, articles).select("id", F.lit(True).alias("_alike"))
    yearly = O.newer_year(records, articles).select("id", F.lit(True).alias("_yearly"))
    rows = records.withColumn("_key", X.url_key(F.col("url"))).join(keys(articles, "source_url", "_covered"), "_key", "left").join(keys(pending, "url", "_pending"), "_key", "left")
    rows = rows.join(alike, "id", "left").join(yearly, "id", "left")
    tier, reason = S.candidate(F.col("_alike").isNotNull(), F.col("_yearly").isNotNull(), F.col("published"), now, special)
    taken = F.when(F.col("_covered"), "bron al gebruikt").when(F.col("_pending"), "bron in een voorstel")
    return rows.withColumns({"tier": F.when(taken.isNull(), tier), "reason": F.coalesce(taken, reason)}).drop("_key", "_covered", "_pending", "_alike", "_yearly")


def deadline_hits(scored: DataFrame, deadlines: DataFrame, now: Column, most: int = 2, stale_days: int = 400) -> DataFrame:
    """(qid, id, place): the best deadlines by score, coming ones first and nearest first, then past ones latest first.

    Those last verified over ``stale_days`` ago go.
    """
    fresh = deadlines.where(F.unix_micros(now) - F.unix_micros(F.col("last_verified").cast("timestamp")) <= stale_days * 86_400_000_000)
    days = F.datediff("deadline", now)
    near = F.when(days.isNull(), 0.0).when(days >= 0, 1.0 / (1 + days)).otherwise(1.0 / days - 1)
    rows = scored.where("score >= 2").join(fresh.select("id", near.alias("near")), "id")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("near").desc(), "id"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("qid", "id", "score", "place")


def own_relevance(text: Column, templates: tuple[str, ...]) -> Column:
    """Whether a relevance text is the article's own, not a template."""
    return (F.trim(F.coalesce(text, F.lit(""))) != "") & ~F.trim(text).isin(*templates)


def date_kind(published: Column, modified: Column) -> Column:
    """Which date an article shows."""
    return F.when(published.isNotNull(), "gepubliceerd").when(modified.isNotNull(), "laatst gewijzigd")
