"""Best-fit packing of texts into sequences, with conflicts.

A text longer than ``capacity`` words is cut into full pieces, each a bin of its own, and a rest. Rests
are packed best-fit, longest first: among open bins ordered by residual, the search starts at the
tightest bin that has room and goes on to the next larger residual until a bin is compatible. A bin
holds at most one text of a source and one of a duplicate cluster; per bin two bitmaps say which it has.

Texts are dealt to shards of about ``shard_rows`` by a hash of the id and packed per shard, so no source
or cluster, however frequent, meets in one task, and no bin spans shards.

Defined cases: a null or empty text is one piece of no words; a null source conflicts with nothing; a
null id is packed like any other; repeated rows are one cluster and so go to different bins; ties in
length are broken by id, then by piece.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.shared import per_row, table
from sievewright.llm.simhash import groups

CAPACITY = 2048
SHARD_ROWS = 4096


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """A bin number per item, for items in the order given; a source under 0 conflicts with nothing."""
    free: list[tuple[int, int]] = []  # (residual, bin), ordered
    has_source: list[int] = []
    has_cluster: list[int] = []
    out = []
    for n, s, c in zip(lengths, sources, clusters):
        source, cluster = (1 << s if s >= 0 else 0), 1 << c
        at = bisect_left(free, (n, -1))
        while at < len(free) and (has_source[free[at][1]] & source or has_cluster[free[at][1]] & cluster):
            at += 1
        if at < len(free):
            residual, b = free.pop(at)
        else:
            residual, b = capacity, len(has_source)
            has_source.append(0)
            has_cluster.append(0)
        has_source[b] |= source
        has_cluster[b] |= cluster
        out.append(b)
        if residual > n:
            insort(free, (residual - n, b))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, piece, first_word, n_words, shard, bin, at_word): where each piece of each text goes.

    ``docs`` has doc_id, text and source. Pieces of a text cover all its words once.
    """
    import hashlib

    def measure(texts):
        raw = [x.encode("utf-8", "surrogatepass") for x in texts]
        return {"words": [len(x.split()) for x in raw], "cluster": [int.from_bytes(hashlib.blake2b(b" ".join(x.split()), digest_size=8).digest(), "little", signed=True) for x in raw]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("source").alias("_s"), F.col("source").isNull().alias("_n"), "text")
    sized = per_row(rows, ["doc_id", "_s", "_n"], "words bigint, cluster bigint", measure)
    shards = max(1, -(-docs.count() // shard_rows))
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)).cast("long"))
    dealt = dealt.withColumn("source", F.when(F.col("_n"), None).otherwise(F.col("_s"))).select("shard", "doc_id", "source", "cluster", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), ids, *values in groups(batches, ["shard"], ["doc_id", "unnamed", "source", "none", "cluster", "words"]):
            yield pack_shard(int(shard), ids, values[0].astype(bool), *values[1:], capacity)

    ready = dealt.select("shard", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("unnamed"), F.coalesce("source", F.lit(0)).alias("source"), F.col("source").isNull().alias("none"), "cluster", "words")
    ready = ready.repartition("shard").sortWithinPartitions("shard", F.col("words") % capacity, "doc_id", "cluster")
    return ready.mapInArrow(run, "doc_id bigint, piece bigint, first_word bigint, n_words bigint, shard bigint, bin bigint, at_word bigint")


def pack_shard(shard, ids, null, source, none, cluster, words, capacity) -> pa.RecordBatch:
    """All pieces of one shard's texts, which come by rising rest."""
    words = words.astype(np.int64)
    full = words // capacity
    rest = words - full * capacity
    order = np.flatnonzero((rest > 0) | (full == 0))[::-1]  # longest rest first
    sources = np.where(none.astype(bool), -1, np.unique(source, return_inverse=True)[1])
    clusters = np.unique(cluster, return_inverse=True)[1]
    bins = np.array(best_fit(rest[order].tolist(), sources[order].tolist(), clusters[order].tolist(), capacity), np.int64)
    at, used = np.zeros(len(order), np.int64), {}
    for k, b in enumerate(bins.tolist()):
        at[k] = used.get(b, 0)
        used[b] = used.get(b, 0) + int(rest[order[k]])
    owner = np.repeat(np.arange(len(ids)), full)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
    n, opened = len(owner), len(used)
    row = np.concatenate([owner, order])
    number = np.concatenate([piece, full[order]])
    columns = [pa.array(ids[row], mask=null[row]), number, number * capacity, np.concatenate([np.full(n, capacity), rest[order]]), np.full(len(row), shard), np.concatenate([opened + np.arange(n), bins]), np.concatenate([np.zeros(n, np.int64), at])]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns], names=["doc_id", "piece", "first_word", "n_words", "shard", "bin", "at_word"])


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
