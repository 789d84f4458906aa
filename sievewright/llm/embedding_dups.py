"""Near-duplicate embeddings by collision counting over one-dimensional projections.

Unit vectors are projected on the axes of a fixed random rotation. If the cosine of two vectors is at
least ``least``, their squared distance is at most ``2 - 2 * least``, and since the axes are
orthonormal, they can lie further apart than ``w`` on at most ``(2 - 2 * least) / w**2`` of them. So every
pair that links collides, within windows of half-width ``w`` centred on the query, on at least
``dims - misses`` sorted projections: the count is calibrated to a recall of one. Pairs that reach it
are verified by the cosine in double precision.

Only vectors of one label and length meet. Equal vectors are one node with a count. The first projection
deals nodes into bands as wide as the largest distance, so that only a band and the next one meet;
bands are cut into blocks by a hash, and each pair of blocks is one group, which returns per node its
number of links and the smallest node it reaches, never the pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, rows with a
null label and rows with a null vec_id link with nothing; those with a null vec_id have a null
component and are not kept; repeated rows are vectors of their own and link with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.shared import components, table, written
from sievewright.llm.simhash import reach

LEAST = 0.93
BLOCK = 1024
HOT_SHARE = 1e-3


def rotation(dims: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))[0]


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def window(dims: int, least: float) -> tuple[float, int]:
    """Half-width and misses allowed: about a spread of random differences, in which misses are rare for what links."""
    w = 1.04 / np.sqrt(dims)
    return w, int((2 - 2 * least) / w**2 + 1e-9)


def collide(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs collide on enough projections. Stops counting once few pairs are left."""
    dims = a.shape[1]
    w, misses = window(dims, least)
    missed = np.zeros((len(a), len(b)), np.uint8 if dims < 250 else np.uint16)
    for k in range(dims):
        order = np.argsort(b[:, k], kind="stable")
        ranked = b[order, k]
        lo, hi = np.searchsorted(ranked, a[:, k] - w - 1e-9, "left"), np.searchsorted(ranked, a[:, k] + w + 1e-9, "right")
        place = np.empty(len(b), np.int32)
        place[order] = np.arange(len(b))
        missed += (place[None, :] < lo[:, None]) | (place[None, :] >= hi[:, None])
        if k % 8 == 7 and (missed <= misses).mean() < 0.02:
            break
    return missed <= misses


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, least: float) -> np.ndarray:
    """The matrix of links: pairs that collide often enough, verified."""
    ua, ub = unit(a), unit(b)
    out = collide(ua @ axes, ub @ axes, least)
    i, j = np.nonzero(out)
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        out[p, q] = (ua[p] * ub[q]).sum(1) >= least
    return out


def banded(nodes: DataFrame, least: float) -> DataFrame:
    """The nodes with the band of their first projection."""
    width = float(np.sqrt(2 - 2 * least)) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            band = np.zeros(len(dims), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = unit(np.stack([v.values.to_numpy() for v in batch.column("embedding").take(pa.array(at))]).astype(float))
                band[at] = np.floor(x @ rotation(int(d))[:, 0] / width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(band)], names=[*batch.schema.names, "band"])

    return nodes.mapInArrow(run, "label int, dims int, embedding array<double>, node bigint, copies bigint, band bigint")


def links(nodes: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(node, links, low) per node and group of blocks in which it links."""
    rows = written(banded(nodes, least), "bands")
    place = ["label", "dims", "band"]
    cells = rows.groupBy(*place).agg(F.ceil(F.count("*") / block).cast("bigint").alias("g"))
    rows = rows.join(cells, place).withColumn("b", F.pmod(F.xxhash64("node"), F.col("g")))
    blocks = cells.select(*place, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("g") - 1)).alias("b"))
    left = blocks.select("label", "dims", F.col("band").alias("band1"), F.col("b").alias("b1"), F.explode(F.array("band", F.col("band") + 1)).alias("band2"))
    right = blocks.select("label", "dims", F.col("band").alias("band2"), F.col("b").alias("b2"))
    pairs = left.join(right, ["label", "dims", "band2"]).where("band1 < band2 OR b1 <= b2")
    key = ["label", "dims", "band1", "b1", "band2", "b2"]
    first = pairs.select(*key, F.col("band1").alias("band"), F.col("b1").alias("b"), F.lit(1).alias("side"))
    second = pairs.where("band1 < band2 OR b1 < b2").select(*key, F.col("band2").alias("band"), F.col("b2").alias("b"), F.lit(2).alias("side"))
    dealt = rows.drop("g").join(first.union(second), [*place, "b"]).select(*key, "side", "node", "copies", "embedding")

    def run(key, group):
        dims = key[1].as_py()
        x = group.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        side, node, copies = (group.column(c).to_numpy() for c in ("side", "node", "copies"))
        one, two = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        alone = not len(two) and (key[2].as_py(), key[3].as_py()) == (key[4].as_py(), key[5].as_py())
        if alone:
            two = one
        ok = linked(x[one], x[two], rotation(dims), least) if len(one) and len(two) else np.zeros((len(one), len(two)), bool)
        if alone:
            np.fill_diagonal(ok, False)
            ids, count = node[one], ok @ copies[one]
            np.fill_diagonal(ok, True)
            low = reach(ok, ids)
        else:
            ids, count = np.concatenate([node[one], node[two]]), np.concatenate([ok @ copies[two], ok.T @ copies[one]])
            both = np.eye(len(ids), dtype=bool)
            both[: len(one), len(one) :], both[len(one) :, : len(one)] = ok, ok.T
            low = reach(both, ids)
        at = count > 0
        return pa.table({"node": ids[at], "links": count[at].astype(np.int64), "low": low[at]})

    return dealt.groupBy(*key).applyInArrow(run, "node bigint, links bigint, low bigint")


def near_duplicates(vectors: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding, label)."""
    whole = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
    rows = rows.withColumn("ok", whole & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    nodes = rows.where("ok").groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = written(nodes.select("label", F.size("embedding").alias("dims"), "embedding", "node", "copies"), "vectors")
    found = written(links(nodes, least, block), "links")
    parts = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    total = found.groupBy("node").agg(F.sum("links").alias("more"))
    told = nodes.join(total, "node", "left").join(parts, "node", "left")
    told = told.select("label", "embedding", "copies", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    told = written(told.where("n_links > 0"), "told")
    # vectors with very many copies, at most 1 / HOT_SHARE of them, join by broadcast: no task gets them all
    many = max(2, HOT_SHARE * vectors.count())
    hot = F.broadcast(told.where(F.col("copies") >= many).select("label", "embedding", F.col("n_links").alias("n1"), F.col("component_id").alias("c1")))
    rest = told.where(F.col("copies") < many).select("label", "embedding", F.col("n_links").alias("n2"), F.col("component_id").alias("c2"))
    first = rows.join(hot, ["label", "embedding"], "left")
    cold = first.where("c1 IS NULL").join(rest, ["label", "embedding"], "left").select("vec_id", "ok", "n2", "c2")
    out = first.where("c1 IS NOT NULL").select("vec_id", "ok", "n1", "c1").union(cold)
    n, c = F.when(F.col("ok"), F.col("n1")), F.when(F.col("ok"), F.col("c1"))
    component = F.coalesce(c, "vec_id")
    return out.select("vec_id", F.coalesce(n, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op2_embedding_dups(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, label, row_number() OVER () AS r FROM embeddings
), g AS (
  SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e
  WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) AND a.n > 0 AND b.n > 0
  WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.93
), c(a, b) AS (
  SELECT a, b FROM p UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a
), l AS (SELECT a, count(*) AS n FROM p GROUP BY a), m AS (SELECT a, min(b) AS b FROM c GROUP BY a)
SELECT vec_id, coalesce(l.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m.b, vec_id))::BIGINT AS component_id, vec_id <= coalesce(m.b, vec_id) AS kept
FROM e LEFT JOIN l ON vec_id = l.a LEFT JOIN m ON vec_id = m.a
"""
