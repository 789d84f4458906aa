"""Deadlines: labels, urgency, months, the next one, and period tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import text as X


def days_until(day: Column, today: Column) -> Column:
    return F.datediff(day, today)


def label(days: Column) -> Column:
    return F.when(days == 0, "vandaag").when(days < 0, "verstreken").when(days == 1, "nog 1 dag").otherwise(F.concat(F.lit("nog "), days.cast("string"), F.lit(" dagen")))


def urgency(days: Column) -> Column:
    return F.when(days < 0, "verstreken").when(days <= 7, "week").when(days <= 30, "maand").otherwise("later")


def filtered(rows: DataFrame, tax_type: str | None = None, audience: str | None = None) -> DataFrame:
    """By equal tax type and by an audience in the list; here an audience does filter."""
    out = rows.where(F.col("tax_type") == tax_type) if tax_type else rows
    return out.where(F.array_contains("audiences", audience)) if audience else out


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("deadline").asc_nulls_last(), "id")


def next_deadline(rows: DataFrame, today: Column, *groups: str) -> DataFrame:
    """The earliest row from today on, per group; today counts."""
    return rows.where(F.col("deadline") >= today).groupBy(*groups).agg(F.min_by(F.struct("id", "deadline"), F.struct("deadline", "id")).alias("x")).select(*groups, "x.id", "x.deadline")


def in_month(rows: DataFrame, month: Column) -> DataFrame:
    return rows.where(F.trunc("deadline", "MM") == F.trunc(month, "MM"))


def months(rows: DataFrame) -> DataFrame:
    """(month, label, n, ids): rows per month in order, undated ones apart under a null month."""
    got = rows.groupBy(F.trunc("deadline", "MM").alias("month")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("deadline", "id"))).alias("x"))
    return got.select("month", X.month_label(F.col("month")).alias("label"), "n", F.transform("x", lambda r: r["id"]).alias("ids"))


def closest_month(available: DataFrame, target: Column) -> DataFrame:
    """The month asked for, else the next that has rows, else the last."""
    return available.agg(F.coalesce(F.min(F.when(F.col("month") >= target, F.col("month"))), F.max("month")).alias("month"))


def periods(rows: DataFrame, every: int, kind: str) -> DataFrame:
    """A period table (year, month) as labelled deadlines: due on the last day of the month after the period."""
    end = F.make_date("year", "month", F.lit(1))
    name = F.when(F.lit(every) == 1, X.month_label(end)).when(F.lit(every) == 3, F.concat(F.quarter(end).cast("string"), F.lit("e kwartaal "), F.col("year").cast("string"))).otherwise(F.col("year").cast("string"))
    return rows.where(F.col("month") % every == 0).select("year", "month", F.lit(kind).alias("tax_type"), name.alias("period"), F.last_day(F.add_months(end, 1)).alias("deadline"))


def types_in_order(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(tax_type, place): the types that occur, in the order of ``names``, others behind them by name."""
    order = F.array(*[F.lit(n) for n in names])
    kinds = rows.select("tax_type").where("tax_type IS NOT NULL").distinct()  # a row per type
    known = F.nullif(F.array_position(order, F.col("tax_type")), F.lit(0))
    return kinds.withColumn("place", F.row_number().over(Window.orderBy(known.asc_nulls_last(), "tax_type")))
