"""Choosing rows: caps per group, a shared budget, stop positions, diversified and non-overlapping picks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import text as X
from sievewright.operators.tables import counted_before


def capped(rows: DataFrame, group: str, most: int, *order) -> DataFrame:
    """The first ``most`` rows of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def full_pages(rows: DataFrame, topic: str, page: str, pos: str, size: int = 10, pages: int = 5, most: int = 20) -> DataFrame:
    """Search results up to the first short page of a topic, ``pages`` pages and ``most`` rows."""
    counts = rows.groupBy(topic, page).agg(F.count("*").alias("_n"))
    last = counts.groupBy(topic).agg(F.min(F.when(F.col("_n") < size, F.col(page))).alias("_last"))
    kept = rows.join(last, topic).where((F.col(page) <= F.coalesce("_last", F.col(page))) & (F.col(page) < pages)).drop("_last")
    return capped(kept, topic, most, page, pos)


def read_cap(rows: DataFrame, group: str, pos: str, survives: Column, most: int) -> DataFrame:
    """Adds ``evaluated``: false behind the row at which ``most`` rows of the group had survived the cheap filters."""
    return counted_before(rows, group, [F.col(pos)], survives, "_before").withColumn("evaluated", F.col("_before") < most).drop("_before")


def budgeted(rows: DataFrame, source: str, pos: str, eligible: Column, cap: Column, rank: Column, budget: int) -> DataFrame:
    """Adds ``recorded`` and ``evaluated``: per source at most ``cap`` eligible rows, in all at most ``budget``.

    Sources are served in the order of ``rank``. What earlier sources take is the smaller of the budget
    and the sum of what they want. Rows behind the one that met a limit are not evaluated.
    """
    marked = rows.withColumn("_e", eligible)
    marked = counted_before(marked, source, [F.col(pos)], F.col("_e"), "_k")
    want = marked.groupBy(source).agg(F.count_if("_e").alias("_n"), F.max(cap).alias("_cap"), F.min(rank).alias("_rank"))
    earlier = Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)  # a row per source
    want = want.withColumn("_want", F.least("_n", "_cap")).withColumn("_left", F.greatest(F.lit(0), budget - F.coalesce(F.sum("_want").over(earlier), F.lit(0))))
    want = want.select(source, F.least("_cap", "_left").alias("_limit"))
    out = marked.join(want, source).withColumn("evaluated", F.col("_k") < F.col("_limit"))
    return out.withColumn("recorded", F.col("_e") & F.col("evaluated")).drop("_e", "_k", "_limit")


def rejection(title: Column, link: Column, description: Column, known: Column, relevant: Column, dated: Column) -> Column:
    """The first reason against an item, null if there is none."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(blank(title) | blank(link), "ontbrekende velden").when(known, "dubbel").when(F.length(F.coalesce(description, F.lit(""))) < 20, "korte omschrijving").when(~relevant, "niet relevant").when(~dated, "geen datum")


def too_old(when: Column, months: int, now: Column) -> Column:
    """Older than so many calendar months, or without a date."""
    return when.isNull() | (when < F.add_months(now, -months).cast("timestamp"))


def funnel(rows: DataFrame, source: str, reason: str = "reason", sample: int = 5, pos: str = "pos", title: str = "title") -> DataFrame:
    """Per source and reason: the count and the first ``sample`` titles; per source the line of all reasons."""
    told = rows.where(F.col(reason).isNotNull())
    counts = told.groupBy(source, reason).agg(F.count("*").alias("n"))
    some = capped(told.withColumn("_g", F.struct(source, reason)), "_g", sample, pos)
    titles = some.groupBy(source, reason).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, title))), lambda x: x[title]), " | ").alias("titles"))
    line = counts.groupBy(source).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(reason, "n"))), lambda x: F.concat(x[reason], F.lit(": "), x["n"].cast("string"))), ", ").alias("line"))
    return counts.join(titles, [source, reason]).join(line, source)


def evidence(rows: DataFrame, now: Column, law: str, text: str = "text") -> DataFrame:
    """Adds what ``candidate`` asks of a text, ``short``, ``lawful`` and ``future`` (lawful and with a date to come), so that the text itself can stay behind."""
    # each is asked for only where it decides: dates are sought in longer texts that are lawful and hold a year
    c, short, lawful = F.col(text), F.col("short"), F.col("lawful")
    out = rows.withColumn("short", F.length(F.coalesce(c, F.lit(""))) < 600).withColumn("lawful", F.when(~short, c.rlike(law)))
    return out.withColumn("future", F.when(lawful & (F.instr(c, "20") > 0), X.future_effective_date(c, now).isNotNull()).otherwise(False))


def candidate(title_hit: Column, year_hit: Column, published: Column, now: Column, special: Column) -> tuple[Column, Column]:
    """(tier 1 to 3 or null, reason) of a record as a subject to write about; it has ``evidence`` and, where special, its ``strength``."""
    age = (F.unix_micros(now) - F.unix_micros(published)) / 86_400_000_000
    short, signal, future, tier = (F.col(c) for c in ("short", "lawful", "future", "strength"))
    steps = [
        (short, None, "te weinig brontekst"),
        (title_hit, None, "onderwerp al behandeld"),
        (year_hit, None, "jaargebonden onderwerp al behandeld"),
        (special & signal & future, 2, "aangekondigde wijziging"),
        (special & (tier == "hoog"), 3, "blijvend relevante uitleg"),
        (special, None, "geen sterk signaal"),
        (published.isNull(), None, "geen publicatiedatum"),
        (age < -1, None, "publicatiedatum in de toekomst"),
        (age <= 14, 1, "actueel bericht"),
        (signal & ((age <= 90) | future), 2, "nieuwe of aangekondigde regelgeving"),
    ]
    pick = lambda k, last: reduce(lambda rest, s: F.when(s[0], F.lit(s[k])).otherwise(rest), reversed(steps), last)
    return pick(1, F.lit(None).cast("int")), pick(2, F.lit("niet meer actueel"))


def pick_topics(rows: DataFrame, most: int = 2, least: float = 0.4) -> DataFrame:
    """Adds ``choice`` (selected, deferred) and ``why`` to candidates of id, title, category, tier, important, published.

    The best ranked is taken, then the next that overlaps none taken. The last tier counts only where the
    others gave nothing, and gives one. Each of the ``most`` steps is one top-1 query.
    """
    order = [F.col("tier").asc(), F.col("important").desc(), F.col("published").desc(), F.col("id").asc()]
    taken: list = []

    def overlaps(t):
        return X.jaccard(F.array_distinct(X.significant_words(F.col("title"))), F.array(*[F.lit(w) for w in t["words"]]) if t["words"] else F.expr("CAST(array() AS array<string>)")) >= least

    def clash(t):
        agree = F.col("category").isNull() | F.lit(t["category"] is None) | (F.col("category") == F.lit(t["category"]))
        return overlaps(t) & agree

    words = F.array_distinct(X.significant_words(F.col("title"))).alias("words")
    for last, limit in ((False, most), (True, 1)):
        if last and taken:
            break
        pool = rows.where(F.col("tier") == 3 if last else F.col("tier") < 3)
        while len(taken) < limit:
            free = reduce(lambda df, t: df.where(~F.coalesce(clash(t), F.lit(False)) & (F.col("id") != t["id"])), taken, pool)
            top = free.orderBy(*order).select("id", "title", "category", words, "tier", "important", "published").limit(1).collect()
            if not top:
                break
            taken += top
    ids = [t["id"] for t in taken]
    chosen = F.col("id").isin(*ids) if ids else F.lit(False)
    # a row is held against those taken before its turn; later ones had no say
    rank = F.struct(F.col("tier").cast("int").alias("a"), (-F.col("important").cast("int")).alias("b"), (-F.unix_micros(F.col("published").cast("timestamp"))).alias("c"), F.col("id").cast("long").alias("d"))
    hit = reduce(lambda a, t: a | (F.coalesce(clash(t), F.lit(False)) & (rank > _rank_of(t))), taken, F.lit(False))
    full = F.lit(len(taken) >= most)
    final = taken[-1] if taken else None
    late = full & (rank > _rank_of(final)) if final is not None else F.lit(False)
    why = F.when(chosen, "gekozen").when(late, "maximum bereikt").when(hit, "overlap met gekozen onderwerp").when(F.col("tier") == 3, "alleen als er niets actueels is").otherwise("maximum bereikt")
    return rows.withColumn("choice", F.when(chosen, "selected").otherwise("deferred")).withColumn("why", why)


def _rank_of(t) -> Column:
    when = F.lit(t["published"]).cast("timestamp")
    return F.struct(F.lit(t["tier"]).cast("int").alias("a"), F.lit(-int(t["important"])).alias("b"), (-F.unix_micros(when)).alias("c"), F.lit(t["id"]).cast("long").alias("d"))


def diversified(rows: DataFrame, limit: int = 4, each: int = 2) -> DataFrame:
    """``limit`` rows, best first, at most ``each`` per category and per source while that lasts, then any.

    Rows have id, category, source, featured, weight, published. Pruning to the first ``each`` rows of a
    pair and the first ``limit`` of all loses nothing; what remains takes at most ``limit`` top-1 steps.
    """
    order = [F.col("featured").desc(), F.col("weight").desc(), F.col("published").desc(), F.col("id").asc()]
    pair = rows.withColumn("_g", F.struct("category", "source"))
    pruned = capped(pair, "_g", each, *order).drop("_g").union(rows.orderBy(*order).limit(limit)).dropDuplicates(["id"])
    taken: list = []
    for spread in (True, False):
        while len(taken) < limit:
            free = pruned.where(~F.col("id").isin(*[t["id"] for t in taken])) if taken else pruned
            if spread:
                for c in ("category", "source"):
                    full = [v for v in {t[c] for t in taken} if sum(t[c] == v for t in taken) >= each]
                    free = free.where(~F.col(c).isin(*full)) if full else free
            top = free.orderBy(*order).limit(1).collect()
            if not top:
                break
            taken += top
    ids = [t["id"] for t in taken]
    return rows.where(F.col("id").isin(*ids) if ids else F.lit(False)).withColumn("place", reduce(lambda rest, k: F.when(F.col("id") == ids[k], k + 1).otherwise(rest), range(len(ids)), F.lit(None).cast("int")))
