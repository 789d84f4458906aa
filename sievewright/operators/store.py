"""A store of records keyed by normalised URL: known keys, upserts, patches, ids, links, run results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from sievewright.functions import text as X

STATUSES = ("kandidaat", "verwerkt", "afgewezen")
#: The end of an id that was given a number: from 2 on, without leading zeros. Others end in digits of their own.
NUMBERED = r"-([2-9]|[1-9][0-9]{1,17})$"


def known_urls(*tables: DataFrame, url: str = "url") -> DataFrame:
    """(url_key): the distinct keys of all tables; blank URLs have none."""
    keys = [t.select(X.url_key(F.col(url)).alias("url_key")) for t in tables]
    return reduce(DataFrame.union, keys).where("url_key <> ''").distinct()


def first_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def new_rows(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose URL key the store has not; one shuffle on the key."""
    return rows.join(known, "url_key", "left_anti")


def checked(rows: DataFrame) -> DataFrame:
    """Fails the job on a row without a URL or with an unknown status."""
    bad = F.when(F.coalesce(F.col("url_key"), F.lit("")) == "", F.raise_error(F.lit("a record has no URL"))).when(~F.col("status").isin(*STATUSES), F.raise_error(F.concat(F.lit("unknown status: "), F.col("status"))))
    return rows.where(bad.cast("string").isNull())


def upsert(store: DataFrame, rows: DataFrame, key: str = "url_key", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rows of equal key replace the store's whole row but for ``keep``; others are added. Adds ``change``."""
    fields = [c for c in store.columns if c != key]
    old = store.select(key, F.struct(*fields).alias("_old"))
    new = rows.select(key, F.struct(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in fields]).alias("_new"))
    both = old.join(new, key, "full_outer")
    value = lambda c: F.coalesce(F.col(f"_old.{c}"), F.col(f"_new.{c}")) if c in keep else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
    change = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "added").otherwise("replaced")
    return both.select(key, *[value(c).alias(c) for c in fields], change.alias("change"))


def patch(store: DataFrame, changes: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Only the fields named in a change's ``fields_set`` are set; a null there deletes. Unknown keys are an error."""
    given = changes.select(key, "fields_set", *[F.col(f).alias(f"_{f}") for f in fields])
    rows = store.withColumn("_here", F.lit(True)).join(given, key, "full_outer")
    stranger = F.raise_error(F.concat(F.lit("unknown key: "), F.col(key).cast("string"))).cast("boolean")
    has = lambda f: F.coalesce(F.array_contains("fields_set", f), F.lit(False))
    out = rows.where(F.when(F.col("_here").isNull(), stranger).otherwise(True))
    return out.withColumns({f: F.when(has(f), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}).select(*store.columns)


def record_base(title: Column, date: Column) -> Column:
    """``YYYY-MM-DD-slug`` with stand-ins for a missing date or title."""
    words = X.slug(F.coalesce(title, F.lit("")))
    return F.concat(F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("zonder-datum")), F.lit("-"), F.when(words == "", "bron").otherwise(words))


def unique_ids(rows: DataFrame, base: str, order: str, existing: DataFrame) -> DataFrame:
    """``id`` per row: the base, or with the first free of -2, -3, … in ``order``; ``existing`` has id.

    The n-th row of a base takes the n-th number that no existing id holds. An id made so can equal
    another base as it stands; such rows, few if any, go through another round.
    """
    todo, taken, done = rows, existing.select("id").distinct(), None
    while True:
        parts = taken.select(F.col("id").alias(base), F.lit(1).cast("long").alias("k")).union(taken.where(F.col("id").rlike(NUMBERED)).select(F.regexp_replace("id", NUMBERED, ""), F.regexp_extract("id", NUMBERED, 1).cast("long")))
        held = parts.groupBy(base).agg(F.array_sort(F.collect_set("k")).alias("_taken"))
        n = F.row_number().over(Window.partitionBy(base).orderBy(order))
        k = F.aggregate(F.coalesce("_taken", F.expr("CAST(array() AS array<bigint>)")), F.col("_n").cast("long"), lambda at, t: at + (t <= at).cast("long"))
        got = todo.withColumn("_n", n).join(held, base, "left").withColumn("_k", k)
        got = got.withColumn("id", F.when(F.col("_k") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), F.col("_k").cast("string"))))
        got = got.withColumn("_first", F.row_number().over(Window.partitionBy("id").orderBy(order)))
        clash = got.where("_first > 1").select(*rows.columns)
        good = got.where("_first = 1").select(*rows.columns, "id")
        done = good if done is None else done.unionByName(good)
        if clash.isEmpty():
            return done
        taken = taken.union(good.select("id"))
        todo = clash


def link(records: DataFrame, articles: DataFrame) -> DataFrame:
    """Each record's article, by slug or else by URL: two equi-joins, no disjunction."""
    by_slug = articles.select(F.col("slug").alias("article_slug"), F.col("slug").alias("_a"))
    by_url = articles.where("url_key <> ''").groupBy("url_key").agg(F.min("slug").alias("_b"))
    return records.join(by_slug, "article_slug", "left").join(by_url, "url_key", "left").withColumn("article", F.coalesce("_a", "_b")).drop("_a", "_b")


def exclusions(created: DataFrame, records: DataFrame, proposals: DataFrame) -> DataFrame:
    """(id): records of created articles and those with an open proposal, once each, sorted."""
    pending = records.join(proposals.select("url_key").distinct(), "url_key", "left_semi").select("id")
    return created.select("id").union(pending).distinct().orderBy("id")


def status_changes(run: DataFrame) -> DataFrame:
    """A run's outcome as patches: rejected for good, or still a candidate where only validation failed."""
    status = F.when(F.col("outcome") == "created", "verwerkt").when(F.col("outcome").isin("rejected", "overlap"), "afgewezen")
    reason = F.when(F.col("outcome").isin("rejected", "overlap"), F.col("reason"))
    return run.where(status.isNotNull()).select("id", status.alias("status"), reason.alias("reason"), F.array(F.lit("status"), F.lit("reason")).alias("fields_set"))


def observed_write(rows: DataFrame, path: str, **counts: Column) -> dict[str, int]:
    """Writes a run's rows, and what they add up to, told by the same pass: nothing is read again."""
    told = Observation()
    rows.observe(told, *[c.alias(n) for n, c in counts.items()]).write.parquet(path)
    return {n: told.get[n] or 0 for n in counts}


def run_result(stages: DataFrame) -> DataFrame:
    """One JSON row: totals, stages per source in name order, failed sources."""
    per = stages.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("fetched", "relevant", "recorded")], F.max("failed").alias("failed"))
    out = per.agg(
        *[F.sum(c).alias(c) for c in ("fetched", "relevant", "recorded")],
        F.array_sort(F.collect_list(F.struct("source", "fetched", "relevant", "recorded"))).alias("sources"),
        F.array_sort(F.collect_list(F.when(F.col("failed"), F.col("source")))).alias("failed"),
    )
    return out.select(F.to_json(F.struct("*")).alias("result"))
