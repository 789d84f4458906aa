"""Audit of how the sources of a language diverge in their terms, with strings materialised late.

Tasks count terms per language and source and write the counts as a table: a 64-bit digest of each term,
its occurrences and documents, and beside them, in a column of its own, the string. All joins and sums
read the digests alone. The smallest and largest string of a digest tell whether two terms share it;
only such terms are split, by their strings. Strings come back for the terms that a result names.

Sums are exact whole numbers. Two sources of a language are compared over the terms that either holds:
what all other terms add is the same number for each, known from the counts of the two. So the work
per term is the square of the sources that hold it, and no pair of sources reads the whole vocabulary.

Defined cases: null text, language and source count as empty strings; rows that repeat count each; a
group without terms is compared by its even distribution, and with no kept term at all every value is 0;
an empty table gives no rows; other columns are left out, so their names cannot clash; ties are ranked by
the bytes of their item. Very long texts are counted whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm.shared import cut, table, written

#: A byte that is part of a term as it is, in lower case or beyond ASCII; all else parts terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Counts a task holds before it hands them on, and the most rows behind them.
HELD = 600_000
HELD_ROWS = 1 << 20
#: Occurrences and documents of a term are held as one number: documents times this, plus occurrences.
ONE = 1 << 40


def counts(docs: DataFrame, bits: int = 64, named: bool = False) -> DataFrame:
    """(lang, source, digest, n, docs, term): partial counts, each term in one row per group and task.

    ``term`` stands in the first of the rows a task hands on for it and is null in the others, or in all
    rows where ``named``.
    """

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        shift, low = 64 - bits, 1 << 63 if bits == 64 else 0

        def out(held):
            digests: dict[bytes, int] = {}
            for (lang, source), found in held.items():
                fresh = [t if named or t not in digests else None for t in found]
                for t in fresh:
                    if t is not None:
                        digests[t] = (xxhash.xxh64_intdigest(t, 11) >> shift) - low
                sums = np.fromiter(found.values(), np.int64, len(found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array([source] * len(found), pa.string()), pa.array([digests[t] for t in found], pa.int64()), pa.array(sums % ONE), pa.array(sums // ONE), pa.array(fresh, pa.binary())],
                    names=["lang", "source", "digest", "n", "docs", "term"],
                )

        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = rows = 0
        for batch in cut(batches):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                group = held.setdefault((lang, source), {})
                before = len(group)
                for term, n in Counter(text.encode("utf-8", "surrogatepass").translate(LETTERS).split()).items():
                    group[term] = group.get(term, 0) + ONE + n
                size, rows = size + len(group) - before, rows + 1
                if size > HELD or rows >= HELD_ROWS:
                    yield from out(held)
                    held, size, rows = {}, 0, 0
        yield from out(held)

    filled = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return filled.mapInArrow(run, "lang string, source string, digest long, n long, docs long, term binary")


def kept_digests(partial: DataFrame, least_docs: int) -> DataFrame:
    """(lang, digest): what may be a kept term, since so many documents of a language hold it or what shares its digest."""
    return partial.groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "digest")


def split(docs: DataFrame, partial: DataFrame, least_docs: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Sums per group (lang, source, digest, part, n, docs) of what may be kept, and the string of each key (digest, part).

    ``part`` is null for a digest of one term; where the smallest and the largest string of a digest
    differ, it is the string. Only then are strings part of a key; they are counted anew, since tasks do
    not name every count.
    """
    sums = partial.groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    sums = written(sums, "sums")
    wanted = written(kept_digests(sums, least_docs), "wanted")
    sums = sums.join(wanted, ["lang", "digest"], "left_semi")
    ends = partial.where("term IS NOT NULL").select("digest", "term").join(wanted.select("digest").distinct(), "digest", "left_semi")
    ends = written(ends.groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "terms")
    shared = ends.where("low <> high").select("digest")
    none = F.lit(None).cast("binary").alias("part")
    if shared.isEmpty():
        return sums.select("lang", "source", "digest", none, "n", "docs"), ends.select("digest", none, F.col("low").alias("term"))
    again = counts(docs, bits, named=True).join(shared, "digest", "left_semi").withColumnRenamed("term", "part")
    again = written(again.groupBy("lang", "source", "digest", "part").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "again")
    rest = sums.join(shared, "digest", "left_anti").select("lang", "source", "digest", none, "n", "docs")
    names = ends.where("low = high").select("digest", none, F.col("low").alias("term"))
    return rest.unionByName(again), names.unionByName(again.select("digest", "part", F.col("part").alias("term")).distinct())


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), in decimals, so that no product overflows."""
    top, low = (n.cast("decimal(20,0)") + 2) * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(20,0)") + terms.cast("decimal(18,0)") * 2
    return 1 + F.call_function("div", top, low)


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): how far a source is from each other one, and its telling terms."""
    partial = written(counts(docs, bits), "counts")
    sums, names = split(docs, partial, least_docs, bits)
    key = ["digest", "part"]
    sums = written(sums, "split")
    of_lang = sums.groupBy("lang", *key).agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    same = lambda a, b: (a["lang"] == b["lang"]) & (a["digest"] == b["digest"]) & a["part"].eqNullSafe(b["part"])
    s, k = sums.drop("docs").alias("s"), of_lang.alias("k")
    kept = written(s.join(k, same(_Of("s"), _Of("k"))).select("s.lang", "s.source", "s.digest", "s.part", "s.n", "k.lang_n"), "kept")

    # a row per language and per group: sizes, and the share of a term that the group does not hold
    langs = kept.groupBy("lang", *key).agg(F.first("lang_n").alias("c")).groupBy("lang").agg(F.sum("c").alias("lang_total"), F.count("*").alias("terms"))
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    zero = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms")))
    groups = written(groups.withColumn("zero", zero), "groups")
    shares = kept.join(groups, ["lang", "source"]).withColumns({"p": share(F.col("n"), F.col("total"), F.col("terms")), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))})
    shares = written(shares.select("lang", "source", *key, "n", "p", "q", "zero"), "shares")

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs(shares, groups)).unionByName(ranked(telling(shares, names, top)).where(F.col("rank") <= top))


class _Of:
    """Columns of an aliased table."""

    def __init__(self, name: str):
        self.name = name

    def __getitem__(self, column: str) -> Column:
        return F.col(f"{self.name}.{column}")


def pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, part, item, value) for each two sources of a language."""
    one = groups.select("lang", "source", "zero", "terms")
    two = one.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero2"))
    both = one.join(two, "lang").where(F.col("source") != F.col("item"))
    zeros = apart(F.col("zero"), F.col("zero2"))
    base = both.select("lang", "source", "item", F.coalesce(F.col("terms") * zeros, F.lit(0).cast("bigint")).alias("v"))
    # terms of one source set against the other's share of terms it lacks, once per distinct share
    steps = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    alone = steps.join(both, ["lang", "source"]).select("lang", "source", "item", (F.col("k") * (apart(F.col("p"), F.col("zero2")) - zeros)).alias("v"))
    alone = alone.groupBy("lang", "source", "item").agg(F.sum("v").alias("v"))
    # terms that both hold: what those two sums miss
    a, b = shares.alias("a"), shares.alias("b")
    same = (F.col("a.lang") == F.col("b.lang")) & (F.col("a.digest") == F.col("b.digest")) & F.col("a.part").eqNullSafe(F.col("b.part")) & (F.col("a.source") < F.col("b.source"))
    p, q, zp, zq = (F.col(c) for c in ("a.p", "b.p", "a.zero", "b.zero"))
    held = a.join(b, same).select(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("b.source").alias("item"), (apart(p, q) - apart(p, zq) - apart(zp, q) + apart(zp, zq)).alias("v"))
    held = held.groupBy("lang", "source", "item").agg(F.sum("v").alias("v"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "v")
    found = base.unionByName(alone).unionByName(turned(alone)).unionByName(held).unionByName(turned(held))
    return found.groupBy("lang", "source", "item").agg(F.sum("v").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")


def telling(shares: DataFrame, names: DataFrame, top: int) -> DataFrame:
    """(lang, source, part, item, value): the terms a source uses more than its language; ties at the end are all there."""
    value = apart(F.col("p"), F.col("q"))
    place = F.rank().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc()))
    best = shares.where("p > q").select("lang", "source", "digest", "part", value.alias("value")).withColumn("place", place).where(F.col("place") <= top)
    same = (F.col("t.digest") == F.col("w.digest")) & F.col("t.part").eqNullSafe(F.col("w.part"))
    return best.alias("t").join(names.alias("w"), same).select("t.lang", "t.source", F.lit("term").alias("part"), F.col("w.term").cast("string").alias("item"), "t.value")


def op11_source_audit(spark, sf_dir: str) -> DataFrame:
    out = audit(table(spark, sf_dir, "documents"))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
), w AS (
  SELECT lang, source, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), v AS (
  SELECT lang, term, count(*)::HUGEINT AS c FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10
), m AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM v GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*)::HUGEINT AS c FROM w GROUP BY ALL
), full_ AS (
  SELECT g.lang, g.source, v.term, coalesce(c.c, 0) AS c, v.c AS lc FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term
), p AS (
  SELECT f.lang, f.source, f.term, f.c, 1 + (1000000000 * (f.c + 2)) // (sum(f.c) OVER (PARTITION BY f.lang, f.source)::HUGEINT + 2 * m.v) AS p,
         1 + (1000000000 * (f.lc + 2)) // (m.n + 2 * m.v) AS q FROM full_ f JOIN m USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q
)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found) WHERE part = 'pair' OR rank <= 10
"""
