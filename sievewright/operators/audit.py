"""Data-quality checks as counts of what breaks them: zero is good."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def broken(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, n): per check the rows that break it, in one pass."""
    got = rows.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    return got.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in checks])).alias("x")).select("x.check", "x.n")


def unmatched(name: str, left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(check, n): keys that only one side has, per direction."""
    sides = [(f"{name}: missing", left, right), (f"{name}: extra", right, left)]
    return reduce(DataFrame.unionByName, [a.select(key).join(b.select(key), key, "left_anti").agg(F.count("*").alias("n")).select(F.lit(n).alias("check"), "n") for n, a, b in sides])


def dead_links(rows: DataFrame, body: str, visible: DataFrame, prefix: str) -> DataFrame:
    """(id, slug): links below ``prefix`` that lead to no visible row of ``slug``."""
    slugs = F.regexp_extract_all(body, F.lit(rf"\Q{prefix}\E([a-z0-9-]+)"), F.lit(1))
    return rows.select("id", F.explode(slugs).alias("slug")).join(visible.select("slug"), "slug", "left_anti").select("id", "slug").distinct()
