"""SimHash near-duplicates with pigeonring filtering.

Fingerprint: 64 bits; a bit is 1 if it is set in more than half of the hashes of the text's word
shingles, repeats included. Two fingerprints link if they differ in at most ``most`` bits.

Candidates: the fingerprint is cut into ``most + 1`` segments on a ring. If two fingerprints differ in at
most ``most`` bits, then from some segment on, every run of l segments differs in at most
``floor(l * most / (most + 1))`` bits; in particular that first segment is equal. So fingerprints are
grouped by (segment number, segment value), chains of following segments are held against their
budgets, and only pairs whose whole chain holds are checked in full. Nothing is missed.

Rows with equal fingerprints are one node. A group of more than ``block`` nodes is cut into blocks by a
hash and each pair of blocks is compared by a task of its own; a task returns, per node, the smallest
node it reaches there, never the pairs themselves. Components then come from star steps.

Defined cases: a text of fewer words than a shingle is one shingle; without words (null, empty, blank)
the fingerprint is zero and links like any other; repeated rows share a component; rows without an id
take part under no id: they form their own nodes' members but never name a component, and a component
all of whose ids are null gets a null ``component_id``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.shared import components, one_per_id, per_row, table, written

SEED = 42
CHUNK = 1 << 16


def fingerprint(text: str, words: int = 3) -> int:
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) >= words else iter([b" ".join(w)])
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    bits, n = np.zeros(64, np.int64), 0
    while len(h := np.fromiter(islice(hashes, CHUNK), "<u8")):
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
        if len(h) < CHUNK:
            break
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: list[str], words: int = 3) -> DataFrame:
    """``key`` and ``fp`` (the 64 bits as a long) per row; no shuffle."""
    return per_row(docs, key, "fp bigint", lambda texts: {"fp": np.array([fingerprint(x, words) for x in texts], np.uint64).view(np.int64)})


def segments(most: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each of ``most + 1`` segments."""
    m = most + 1
    cuts = [64 * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def linked(fps: np.ndarray, first: int, most: int) -> np.ndarray:
    """Which pairs link, as a matrix: those whose chain from segment ``first`` on keeps to its budgets."""
    differ = fps[:, None] ^ fps[None, :]
    ring = segments(most)
    total = np.zeros(differ.shape, np.uint8)
    ok = np.ones(differ.shape, bool)
    for length in range(1, len(ring) + 1):
        at, bits = ring[(first + length - 1) % len(ring)]
        mask = np.uint64(((1 << bits) - 1) << at)
        total += np.bitwise_count(differ & mask)
        ok &= total <= length * most // (most + 1)
        if not ok.any():
            break
    return ok


def reach(ok: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each node reaches over the links of a matrix with a true diagonal."""
    low = ids.copy()
    while True:
        now = np.where(ok, low[None, :], np.iinfo(np.int64).max).min(1)
        if (now == low).all():
            return low
        low = now


def links(nodes: DataFrame, most: int, block: int = 1024) -> DataFrame:
    """Star edges (a, b) between ``node`` ids that connect what links; ``nodes`` has node and fp, fp distinct."""
    ring = segments(most)
    cell = lambda k: F.shiftrightunsigned("fp", ring[k][0]).bitwiseAND(F.lit((1 << ring[k][1]) - 1))
    cells = nodes.select("node", "fp", F.posexplode(F.array(*[cell(k) for k in range(len(ring))])).alias("seg", "val"))
    counts = cells.groupBy("seg", "val").agg(F.count("*").alias("n")).where("n > 1").withColumn("g", F.ceil(F.col("n") / block).cast("int"))
    mine = cells.join(counts.drop("n"), ["seg", "val"]).withColumn("b", F.pmod(F.xxhash64("fp"), F.col("g")))
    partners = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("g").cast("bigint") - 1), lambda j: F.struct(F.least("b", j).alias("lo"), F.greatest("b", j).alias("hi")))
    pairs = mine.select("seg", "val", F.explode(partners).alias("p"), "node", "fp").select("seg", "val", "p.lo", "p.hi", "node", "fp")
    group = ["seg", "val", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, fp in groups(batches, group, ["node", "fp"]):
            if len(node) > 1:
                low = reach(linked(fp.view(np.uint64), int(key[0]), most), node)
                if (at := low < node).any():
                    yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(low[at])], names=["a", "b"])

    return pairs.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a bigint, b bigint")


def groups(batches: Iterator[pa.RecordBatch], key: list[str], values: list[str]) -> Iterator[tuple]:
    """(key, *value arrays) per run of equal keys; only one run is held at a time."""
    held: list[list[np.ndarray]] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in key])
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in values]
        starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1), batch.num_rows]
        for lo, hi in zip(starts, starts[1:]):
            k = tuple(keys[:, lo])
            if held and k != last:
                yield last, *(np.concatenate(x) for x in zip(*held))
                held = []
            last = k
            held.append([c[lo:hi] for c in cols])
    if held:
        yield last, *(np.concatenate(x) for x in zip(*held))


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) per row."""
    rows = written(fingerprints(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"], words), "fingerprints")
    nodes = written(rows.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    parts = components(links(nodes, most))
    named = written(nodes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "named")
    return rows.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 3, most: int = 2) -> DataFrame:
    """One row per component, with all its columns: that of the smallest id, of rows that share it the smallest text's. Rows without an id stay, for nothing names them."""
    found = near_duplicates(docs, words, most).where("doc_id = component_id").select("doc_id").distinct()
    known = one_per_id(docs.where("doc_id IS NOT NULL").join(found, "doc_id", "left_semi"))
    return known.unionByName(docs.where("doc_id IS NULL"))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
