"""Merkle manifest of a dataset: a proof per row, and rows told whose text was tampered with.

A row's leaf is the SHA-256 of its fields. Per source, leaves in order of id are folded three by three
until one node is left, the subroot; subroots in order of source are folded likewise into the root. Built
levels are stored as parent-linked node rows: each node names its parent and the digests of its siblings
to the left and right. A recursive query then starts at every leaf with the digest of what is there now,
climbs a parent a step, appends that step's siblings as a row, and folds the digest; a row is verified if
what arrives at the top is the root.

For size: positions in a source are prefix counts over ranges, so no source is one task's. Near the top
all leaves below a node meet its row; node rows are therefore repeated once per ``SPREAD`` leaves, and
leaves are dealt over these copies, so no key meets more than a few hundred rows. Steps carry digests and
keys only; texts are read once.

Defined cases: a null field counts as ``-``; null and repeated ids keep a leaf per row, nulls first and
equal ids in order of their leaves; a null id is never tampered with; a null source is a source of its
own, the first; an empty table gives no rows; a single row is leaf, subroot and root with no siblings;
other columns are left out, so their names cannot clash. Texts of any length are hashed whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm.shared import shared_path, table, written
from sievewright.operators.tables import counted_before

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
#: Leaves that share one copy of a node row in the climb.
SPREAD = ARITY**6
TOP = -1


def digest(*parts: Column) -> Column:
    """SHA-256 of strings, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def text_of(d: Column) -> Column:
    return F.lower(F.hex(d))


def encoded(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    s = value.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def tampered(text: Column, doc_id: Column) -> Column:
    """The text without line feeds, for ids whose decimal form has an even crc32; elsewhere as it is."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.translate(text, "\n", "")).otherwise(text)


def leaves(docs: DataFrame, now: Column) -> DataFrame:
    """(doc_id, source, leaf, now): the digest of each row, and of the row with the text ``now``."""
    leaf = lambda text: digest(*[encoded(F.col(c)) for c in FIELDS[:-1]], encoded(text))
    return docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), F.when(now.eqNullSafe(F.col("text")), leaf(F.col("text"))).otherwise(leaf(now)).alias("now"))


def placed(rows: DataFrame) -> DataFrame:
    """Adds ``tree`` (place of the source in order), ``n`` (its leaves) and ``idx`` (place of a leaf in it, from 0)."""
    order = ["source", "doc_id", "leaf"]
    dealt = written(written(rows, "hashed").repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "leaves")
    held = written(dealt.groupBy("source", "_range").agg(F.count("*").alias("_n")), "held")
    trees = counted_before(held.groupBy("source").agg(F.sum("_n").alias("n")), None, [F.col("source")], F.lit(True), "tree").withColumnRenamed("source", "_of")
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(trees, F.col("source").eqNullSafe(F.col("_of")))
    held = held.select("_of", F.col("_range").alias("_at"), "_base", "tree", "n")
    inside = F.row_number().over(Window.partitionBy("source", "_range").orderBy("doc_id", "leaf"))
    found = dealt.join(held, F.col("source").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_at")))
    return found.select("doc_id", "source", "leaf", "now", "tree", "n", (F.col("_base") + inside - 1).alias("idx"))


def runs(level: DataFrame) -> DataFrame:
    """The runs of one level: (tree, idx, n, count, kids, digest), ``idx`` and ``n`` those of the level above."""
    kid = F.struct("idx", "digest", "count", "now")
    up = level.groupBy("tree", F.expr(f"idx div {ARITY}").alias("up"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"))
    up = up.agg(F.array_sort(F.collect_list(kid)).alias("kids"), F.sum("count").alias("count")).withColumnRenamed("up", "idx")
    return up.withColumn("digest", digest(F.array_join(F.transform("kids", lambda k: text_of(k["digest"])), "")))


def linked(grouped: DataFrame, level: int) -> DataFrame:
    """Each node of a level with its parent and the digests beside it.

    The parent of a source's last run is its subroot, which stands in the tree of subroots.
    """
    side = lambda keep: F.unhex(F.array_join(F.transform(F.filter("kids", keep), lambda k: F.hex(k["digest"])), ""))
    rows = grouped.select("*", F.explode("kids").alias("kid"))
    last = (F.col("n") == 1) & (F.col("tree") != TOP)
    kid = F.col("kid")
    left, right = side(lambda k: k["idx"] < F.col("kid.idx")), side(lambda k: k["idx"] > F.col("kid.idx"))
    return rows.select(
        "tree", F.lit(level).alias("level"), kid["idx"].alias("idx"), kid["count"].alias("count"), kid["now"].alias("now"), F.when(last, F.lit(TOP).cast("bigint")).otherwise(F.col("tree")).alias("up_tree"),
        F.when(last, 0).otherwise(level + 1).alias("up_level"), F.when(last, F.col("tree")).otherwise(F.col("idx")).alias("up_idx"), F.col("count").alias("up_count"), left.alias("left"), right.alias("right"),
    )


def build(level: DataFrame, most: int, path: str, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels above ``level`` (tree, idx, n, count, digest, now), stored one by one: (linked nodes per level, single nodes per level)."""
    spark, links, single, depth = level.sparkSession, [], [level.where("n = 1").select("tree", "digest", "count")], 0
    while most > 1:
        at = f"{path}/{name}-{depth}"
        runs(level.where("n > 1")).write.parquet(at)
        grouped = spark.read.parquet(at)
        links.append(linked(grouped, depth))
        level = grouped.select("tree", "idx", "n", "count", "digest", F.lit(None).cast("binary").alias("now"))
        single.append(level.where("n = 1").select("tree", "digest", "count"))
        most, depth = -(-most // ARITY), depth + 1
    return links, single


CLIMB = """
WITH RECURSIVE climb(tree, idx, step, up_tree, up_level, up_idx, slot, siblings, folded) MAX RECURSION LEVEL 1000 AS (
  SELECT tree, idx, 0, up_tree, up_level, up_idx, slot, siblings, folded FROM {start}
  UNION ALL
  SELECT c.tree, c.idx, c.step + 1, n.up_tree, n.up_level, n.up_idx, pmod(xxhash64(c.tree, c.idx), n.up_copies), concat(n.left, n.right),
         unhex(sha2(concat(lower(hex(n.left)), lower(hex(c.folded)), lower(hex(n.right))), 256))
  FROM climb c JOIN {nodes} n ON c.up_tree = n.tree AND c.up_level = n.level AND c.up_idx = n.idx AND c.slot = n.copy
)
SELECT tree, idx, step, siblings, folded FROM climb LIMIT ALL
"""


def copies(count: str) -> Column:
    return F.expr(f"greatest(1, {count} div {SPREAD})")


def manifest(docs: DataFrame, now: Column | None = None) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof, folded, verified) per row; ``now`` is the text as it is found."""
    spark = docs.sparkSession
    now = F.col("text") if now is None else now
    path = shared_path(spark, "manifest")
    rows = written(placed(leaves(docs, now)), "placed")
    most = rows.agg(F.max("n")).first()[0] or 0
    base = rows.select("tree", "idx", "n", F.lit(1).cast("bigint").alias("count"), F.col("leaf").alias("digest"), "now")
    links, single = build(base, most, path, "level")
    roots = written(reduce(DataFrame.unionByName, single), "subroots")
    n = roots.count()
    top = roots.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.lit(n).cast("bigint").alias("n"), "count", "digest", F.lit(None).cast("binary").alias("now"))
    top_links, top_single = build(top, n, path, "top")
    root = next((r[0] for s in reversed(top_single) for r in s.select("digest").take(1)), None)

    # where each leaf starts: its own run's siblings, or, a lone leaf, the subroot it is
    slot = F.pmod(F.xxhash64("tree", "idx"), copies("up_count"))
    alone = rows.where("n = 1").select("tree", "idx", F.lit(TOP).cast("bigint").alias("up_tree"), F.lit(0).alias("up_level"), F.col("tree").alias("up_idx"), F.lit(0).cast("bigint").alias("slot"), F.lit(b"").alias("siblings"), F.col("now").alias("folded"))
    first = [x.select("tree", "idx", "up_tree", "up_level", "up_idx", slot.alias("slot"), F.concat("left", "right").alias("siblings"), digest(text_of(F.col("left")), text_of(F.col("now")), text_of(F.col("right"))).alias("folded")) for x in links[:1]]
    start = reduce(DataFrame.unionByName, [alone, *first])
    above = [*links[1:], *top_links]
    if above:
        copied = F.explode(F.sequence(F.lit(0).cast("bigint"), copies("count") - 1)).alias("copy")
        nodes = written(reduce(DataFrame.unionByName, above).select("tree", "level", "idx", copied, "up_tree", "up_level", "up_idx", copies("up_count").alias("up_copies"), "left", "right"), "nodes")
        climbed = spark.sql(CLIMB, start=start, nodes=nodes)
    else:
        climbed = start.select("tree", "idx", F.lit(0).alias("step"), "siblings", "folded")
    steps = F.array_sort(F.collect_list(F.struct("step", "siblings", "folded")))
    proofs = climbed.groupBy("tree", "idx").agg(steps.alias("s"))
    proofs = proofs.select("tree", "idx", F.sha2(F.array_join(F.transform("s", lambda x: text_of(x["siblings"])), "").cast("binary"), 256).alias("proof"), text_of(F.element_at("s", -1)["folded"]).alias("folded"))
    spots = roots.select("tree", F.explode(F.sequence(F.lit(0).cast("bigint"), copies("count") - 1)).alias("copy"), text_of(F.col("digest")).alias("subroot"))
    out = rows.withColumn("copy", F.pmod(F.xxhash64("tree", "idx"), copies("n"))).join(proofs, ["tree", "idx"]).join(spots, ["tree", "copy"])
    top_root = F.lit(root and root.hex())
    return out.select("doc_id", "source", text_of(F.col("leaf")).alias("leaf"), "subroot", top_root.alias("root"), "proof", "folded", (F.col("folded") == top_root).alias("verified"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    out = manifest(table(spark, sf_dir, "documents"), tampered(F.col("text"), F.col("doc_id")))
    return out.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified")


#: crc32 of the decimal id: every byte, then eight shifts each.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b:
  list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END + y))))"""
_SQL_FIELDS = " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in FIELDS)
OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text, CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS now FROM documents
), h AS (
  SELECT doc_id, source, sha256({_SQL_FIELDS}) AS leaf, sha256({_SQL_FIELDS.replace("text::", "now::")}) AS now FROM d
), leaf AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS r, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM h
), tree(source, lvl, l) AS (
  SELECT source, 0, list(leaf ORDER BY i) FROM leaf GROUP BY source
  UNION ALL
  SELECT source, lvl + 1, list_transform(range(0, len(l), 3), lambda j: sha256(array_to_string(l[j + 1:j + 3], ''))) FROM tree WHERE len(l) > 1
), sub AS (
  SELECT source, lvl AS height, l[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k FROM tree WHERE len(l) = 1
), top(lvl, l) AS (
  SELECT 0, list(subroot ORDER BY k) FROM sub
  UNION ALL
  SELECT lvl + 1, list_transform(range(0, len(l), 3), lambda j: sha256(array_to_string(l[j + 1:j + 3], ''))) FROM top WHERE len(l) > 1
), steps AS (
  SELECT k, lvl AS step, lvl, l, false AS up FROM tree JOIN sub ON tree.source IS NOT DISTINCT FROM sub.source WHERE len(l) > 1
  UNION ALL
  SELECT k, height + lvl, lvl, l, true FROM sub, top WHERE len(l) > 1
), climb(r, i, k, step, folded, proof) AS (
  SELECT r, i, k, 0, now, '' FROM leaf JOIN sub ON leaf.source IS NOT DISTINCT FROM sub.source
  UNION ALL
  SELECT r, i, k, step + 1, sha256(array_to_string(l[b + 1:p], '') || folded || array_to_string(l[p + 2:b + 3], '')), proof || array_to_string(l[b + 1:p], '') || array_to_string(l[p + 2:b + 3], '')
  FROM (SELECT *, p // 3 * 3 AS b FROM (SELECT c.r, c.i, c.k, c.step, c.folded, c.proof, s.l, CASE WHEN up THEN c.k ELSE c.i END // (3 ** lvl)::BIGINT AS p FROM climb c JOIN steps s ON s.k = c.k AND s.step = c.step))
), ends AS (
  SELECT r, arg_max(folded, step) AS folded, arg_max(proof, step) AS proof FROM climb GROUP BY r
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM leaf JOIN ends USING (r) JOIN sub ON leaf.source IS NOT DISTINCT FROM sub.source, (SELECT l[1] AS root FROM top WHERE len(l) = 1)
"""
