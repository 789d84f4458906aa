"""Scans of landed files: feeds, sitemaps, search results, records, articles, proposals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "title string, link array<string>, description string, encoded string, pubDate string"
ENTRY = "title string, link array<struct<_href:string,_rel:string>>, summary string, content string, updated string, published string"
URL = "loc string, lastmod string, title string, publication_date string"


def _bare(xml: Column) -> Column:
    """Namespace prefixes dropped, so that readers see plain names."""
    return F.regexp_replace(F.regexp_replace(xml, r"<(/?)(?:news|content|dc|media|atom):", "<$1"), r"\sxmlns(?::\w+)?=(?:\"[^\"]*\"|'[^']*')", "")


def _elements(xml: Column, tag: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>"), F.lit(0))


def feed_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """A row per item of RSS 2.0 or entry of Atom: title, link, description, pub_date, pos.

    Atom's link is the first that is not ``self``, else the first; a missing description falls back to the
    encoded or full content.
    """
    keep = [c for c in feeds.columns if c != xml]
    whole = _bare(F.col(xml))
    rss = feeds.select(*keep, F.posexplode(_elements(whole, "item")).alias("pos", "_x")).withColumn("i", F.from_xml("_x", ITEM))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    rss = rss.select(*keep, "pos", text(F.col("i.title")).alias("title"), text(F.get("i.link", 0)).alias("link"), F.coalesce(text(F.col("i.description")), text(F.col("i.encoded"))).alias("description"), text(F.col("i.pubDate")).alias("pub_date"))
    atom = feeds.select(*keep, F.posexplode(_elements(whole, "entry")).alias("pos", "_x")).withColumn("e", F.from_xml("_x", ENTRY))
    links = F.filter("e.link", lambda x: F.coalesce(x["_rel"], F.lit("")) != "self")
    link = F.coalesce(F.get(links, 0)["_href"], F.get("e.link", 0)["_href"])
    atom = atom.select(*keep, "pos", text(F.col("e.title")).alias("title"), link.alias("link"), F.coalesce(text(F.col("e.summary")), text(F.col("e.content"))).alias("description"), F.coalesce(text(F.col("e.published")), text(F.col("e.updated"))).alias("pub_date"))
    return rss.unionByName(atom)


def sitemap_urls(maps: DataFrame, xml: str = "xml") -> DataFrame:
    """(…, pos, loc, lastmod) per url of a sitemap."""
    keep = [c for c in maps.columns if c != xml]
    out = maps.select(*keep, F.posexplode(_elements(_bare(F.col(xml)), "url")).alias("pos", "_x"))
    out = out.withColumn("_flat", F.regexp_replace("_x", "(?is)</?news>", "")).withColumn("u", F.from_xml("_flat", URL))
    return out.select(*keep, "pos", F.trim("u.loc").alias("loc"), F.nullif(F.trim("u.lastmod"), F.lit("")).alias("lastmod"), F.nullif(F.trim("u.title"), F.lit("")).alias("title"), F.nullif(F.trim("u.publication_date"), F.lit("")).alias("published"))


def news_items(maps: DataFrame, xml: str = "xml") -> DataFrame:
    """News sitemap rows that have a title and a link, dated by publication, else by modification."""
    out = sitemap_urls(maps, xml)
    return out.where("title IS NOT NULL AND loc IS NOT NULL AND loc <> ''").withColumn("pub_date", F.coalesce("published", "lastmod")).drop("published", "lastmod")


def indexed_locs(xml: Column) -> Column:
    """The sitemaps an index names, references undone."""
    locs = F.regexp_extract_all(_bare(xml), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    return F.transform(locs, lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def indexed_maps(index: DataFrame, xml: str = "xml", pattern: str = r"documents-\d+\.xml$") -> DataFrame:
    """(loc): the sitemaps of an index whose name fits."""
    return index.select(F.explode(indexed_locs(F.col(xml))).alias("loc")).where(F.col("loc").rlike(pattern))


def search_results(pages: DataFrame, base: str, body: str = "body") -> DataFrame:
    """A row per result of landed search pages, relative links made absolute."""
    keep = [c for c in pages.columns if c != body]
    shape = "struct<rawResponse:struct<rawResults:array<struct<url:struct<raw:string>,sort_date:struct<raw:string>>>>>"
    rows = pages.select(*keep, F.posexplode(F.from_json(body, shape)["rawResponse"]["rawResults"]).alias("pos", "r")).where("r.url.raw IS NOT NULL")
    link = F.col("r.url.raw")
    return rows.select(*keep, "pos", F.when(link.rlike("^https?://"), link).otherwise(F.concat(F.lit(base), link)).alias("loc"), F.col("r.sort_date.raw").alias("lastmod"))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a folder of JSON files; the file's name is the id."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("id"), "*")


def article_fields(text: Column) -> dict[str, Column]:
    """Title, category and source URL of an article's front matter; escaped quotes undone."""
    field = lambda n: F.nullif(F.replace(F.regexp_extract(text, rf'(?m)^{n}:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit('\\"'), F.lit('"')), F.lit(""))
    return {"title": field("title"), "category": field("category"), "source_url": field("sourceUrl")}


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles of a folder of markdown files that have a title."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return rows.select("file", *[c.alias(n) for n, c in article_fields(F.col("value")).items()]).where("title IS NOT NULL")


def proposals(spark: SparkSession, path: str, prefix: str, marker: str, open_only: bool = False) -> DataFrame:
    """(url): URLs marked in the bodies of proposals on a branch prefix: those unmerged, or those open.

    Broken input fails the job. A missing state counts as open.
    """
    shape = "headRefName string, mergedAt string, state string, body string"
    rows = spark.read.schema(shape).option("mode", "FAILFAST").option("multiLine", True).json(path)
    return proposal_urls(rows, prefix, marker, open_only)


def proposal_urls(rows: DataFrame, prefix: str, marker: str, open_only: bool = False) -> DataFrame:
    free = F.col("state").isNull() | (F.col("state") == "OPEN") if open_only else F.col("mergedAt").isNull()
    rows = rows.where(F.col("headRefName").startswith(prefix) & free)
    return rows.select(F.explode(F.regexp_extract_all("body", F.lit(rf"<!--\s*\Q{marker}\E:\s*(\S+)\s*-->"), F.lit(1))).alias("url"))


def visible(articles: DataFrame) -> DataFrame:
    return articles.where(~F.coalesce("hidden", F.lit(False)))


def with_pages(items: DataFrame, pages: DataFrame, required: bool) -> DataFrame:
    """Items with their landed page's columns by URL key; a missing page gives nulls, or drops the row."""
    fields = [c for c in pages.columns if c not in items.columns]
    return items.join(pages.select("url_key", *fields), "url_key", "inner" if required else "left")


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
