"""Faceted lists: filters that narrow, an audience that only re-orders, related and successor rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid(rows: DataFrame, column: str, value: str | None) -> str | None:
    """The facet value, or none where no row has it."""
    return value if value and not rows.where(F.col(column) == value).isEmpty() else None


def search(rows: DataFrame, category=None, source=None, words: str = "", audience=None, fields=("title",)) -> DataFrame:
    """Matching rows with ``for_audience``, which orders but does not filter."""
    out = rows.where(F.col("category") == category) if category else rows
    out = out.where(F.col("source") == source) if source else out
    needle = words.strip().lower()
    out = out.where(F.instr(F.lower(F.concat_ws(" ", *fields)), needle) > 0) if needle else out
    match = F.array_contains("audiences", audience) if audience else F.lit(False)
    return out.withColumn("for_audience", match)


def shown(found: DataFrame, first: int = 9) -> DataFrame:
    """The first rows of a search in their order: the audience's first, then input order."""
    return found.orderBy(F.col("for_audience").desc(), "ord").limit(first)


def counts(rows: DataFrame, first: int = 9, refined: bool = False) -> DataFrame:
    """One row: how many match, how many for the audience, how many are shown at first."""
    return rows.agg(F.count("*").alias("matches"), F.count_if("for_audience").alias("for_audience"), F.least(F.count("*"), F.lit(2**31 if refined else first)).cast("long").alias("visible"))


def active(*filters) -> int:
    return sum(bool(f) for f in filters)


def related(rows: DataFrame, most: int = 3) -> DataFrame:
    """(id, other, place): the newest ``most`` others of the category. Only the first ``most + 1`` per category are joined."""
    w = Window.partitionBy("category").orderBy(F.col("published").desc(), "id")
    best = rows.select("id", "category", "published").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most + 1)
    pairs = rows.select("id", "category").join(best.select(F.col("id").alias("other"), "category", "r"), "category").where("id <> other")
    place = F.row_number().over(Window.partitionBy("id").orderBy("r"))
    return pairs.withColumn("place", place).where(F.col("place") <= most).select("id", "other", "place")


def details(rows: DataFrame) -> DataFrame:
    """Each article with its successor (first by order) and what its page shows."""
    next_ = rows.groupBy("url").agg(F.min_by("id", "ord").alias("successor")).withColumnRenamed("url", "superseded_by")
    out = rows.join(next_, "superseded_by", "left")
    return out.withColumns({"outdated": F.col("superseded_by").isNotNull() | F.col("status").isin("vervallen", "historisch"), "long_body": F.length("body") > 1.3 * F.length("summary")})
