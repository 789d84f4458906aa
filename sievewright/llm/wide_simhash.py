"""SimHash near-duplicates at a set similarity, by long fingerprints and the same pigeonring filter.

For similarities such as 0.8 the few bits of ``simhash`` differ too much to be searched. Here a text's
set of word shingles is summed into signed buckets, mixed by a random-sign Hadamard transform, and the
signs are its fingerprint: two texts differ in about ``acos(cosine) / pi`` of the bits. The ring is cut
into segments. A pair at the limit has several segments on which it is equal (about six), so about one
pair in 200 has none that also passes the chain; from there the next three segments are held against
budgets in proportion, which leaves almost no chance pairs. The chain's budgets lie one and a half
standard deviations above the expected distance. All bits are a filter, five deviations wide; what it
leaves is decided by the Jaccard similarity of the two sets of shingles, so no pair below the limit links.

Segments lengthen with the logarithm of the number of texts, so that as few texts share one by chance at
every size, and there are as many as keep the share of pairs found: ``Ring.of``. At 0.8, some 2 million
texts take 113 segments of 18 bits; work per text grows with the number of texts to the power of about
a quarter, up to segments of 31 bits.

Equal sets of shingles are one node. Nodes that share a segment meet in sorted runs; a run of over ``block``
nodes is compared by pairs of blocks instead, each a group of its own. A task returns a row for each node
that has a chained partner, with the smallest of these, and never the pairs. The smallest partner of each
node over all segments is checked first. Once these links have made components, every chained pair that is
still apart is checked inside a task, by all bits and then by the sets, and the task returns the smallest
component that each reaches. So all pairs count and no rows grow with the square of a group.

Defined cases: as in ``simhash``; a text of fewer words than a shingle is one shingle, texts without
words are alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.shared import components, one_per_id, per_row, written
from sievewright.llm.simhash import groups

SHORT = 8
BLOCKS = ["cell", "lo", "hi"]


@dataclass(frozen=True)
class Ring:
    """A fingerprint of ``size`` bits, a power of two, in segments of ``bits``; ``most`` bits may differ."""

    size: int
    bits: int
    least: float

    @classmethod
    def of(cls, texts: int, least: float) -> Ring:
        """For so many texts: a segment is shared by chance with about eight, a pair at the limit found with 0.995."""
        bits = min(max(18, math.ceil(math.log2(max(2, texts))) - 3), 31)
        equal = (1 - math.acos(2 * least / (1 + least)) / math.pi) ** bits
        return cls(max(2048, 1 << math.ceil(math.log2(bits * 5.1 / equal))), bits, least)

    @property
    def segments(self) -> int:
        return self.size // self.bits

    @property
    def ahead(self) -> int:
        """Segments behind an equal one that the chain looks at: three, or what 63 bits hold."""
        return min(3, 63 // self.bits)

    @property
    def used(self) -> int:
        return self.segments * self.bits

    @property
    def most(self) -> int:
        """For the budgets of chains."""
        return self._limit(1.5)

    @property
    def far(self) -> int:
        """No pair at the limit is likely to differ in more bits."""
        return self._limit(5)

    def _limit(self, deviations: float) -> int:
        share = math.acos(2 * self.least / (1 + self.least)) / math.pi
        return int(self.used * share + deviations * math.sqrt(self.used * share * (1 - share)))


_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(64)]


def shingles(text: str, words: int) -> np.ndarray:
    """The set of the text's shingles as sorted hashes."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    k = min(words, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h += one[i : i + len(h)] * _POWERS[i]
    return np.unique(h)


def similar(x: bytes, y: bytes, least: float) -> bool:
    """Whether two sets of ``shingles`` have a Jaccard similarity of ``least`` at the least."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) if len(a) else True


def buckets(h: np.ndarray, size: int) -> np.ndarray:
    """The set of shingles as signed sums in ``size`` buckets; weights vary a little, so that sums seldom are zero."""
    for shift in (29, 32):
        h = (h ^ (h >> np.uint64(shift))) * _POWERS[7]
    h ^= h >> np.uint64(31)
    weight = np.where(h >> np.uint64(63), 1.0, -1.0) * (0.75 + ((h >> np.uint64(52)) & np.uint64(1023)).astype(float) / 2046)
    return np.bincount((h & np.uint64(size - 1)).astype(np.int64), weight, size).astype(np.float32)


def fingerprints(texts: list[str], words: int, size: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``size`` bits, packed in bytes, and a hash of each set of shingles."""
    signs = np.where(np.random.default_rng(size).random(size) < 0.5, -1, 1).astype(np.float32)
    out, sig = np.zeros((len(texts), size // 8), np.uint8), np.zeros(len(texts), np.uint64)
    some = max(1, (1 << 17) // size)
    for at in range(0, len(texts), some):
        sets = [shingles(t, words) for t in texts[at : at + some]]
        sig[at : at + some] = [xxhash.xxh64_intdigest(h.tobytes()) for h in sets]
        x = np.stack([buckets(h, size) for h in sets]) * signs
        step = 1
        while step < size:
            pairs = x.reshape(len(x), -1, 2, step)
            x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(x), size)
            step *= 2
        out[at : at + some] = np.packbits(x > 0, axis=1)
    return out, sig.view(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def segments(fps: np.ndarray, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """Per row and segment: the segment's number and value as one key, and the bits of the next segments."""
    bits = np.unpackbits(fps, axis=1)[:, : ring.used].reshape(len(fps), ring.segments, ring.bits)
    values = bits @ (1 << np.arange(ring.bits, dtype=np.int64))
    ahead = sum(np.roll(values, -k - 1, axis=1) << (ring.bits * k) for k in range(ring.ahead))
    return values + (np.arange(ring.segments, dtype=np.int64) << ring.bits), ahead


def chained(a: np.ndarray, b: np.ndarray, ring: Ring) -> np.ndarray:
    """Whether the segments ahead of two equal ones keep to their budgets."""
    differ = a ^ b
    ok = np.ones(differ.shape, bool)
    for k in range(1, ring.ahead + 1):
        ok &= np.bitwise_count(differ & np.int64((1 << ring.bits * k) - 1)) <= (k + 1) * ring.most // ring.segments
    return ok


def _lows(node: np.ndarray, ahead: np.ndarray, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """Which nodes of a cell have a chained partner, and the smallest node among these and itself."""
    touched, low = np.zeros(len(node), bool), node.copy()
    for at in range(0, len(node), 256):
        ok = chained(ahead[at : at + 256, None], ahead[None, :], ring)
        touched[at : at + 256] = ok.sum(1) > 1  # each is chained to itself
        low[at : at + 256] = np.where(ok, node[None, :], np.iinfo(np.int64).max).min(1)
    return touched, low


def _cells(nodes: DataFrame, ring: Ring) -> DataFrame:
    """(cell, ahead, node): a row per node and segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                fps = np.frombuffer(b"".join(part.column("wide").to_pylist()), np.uint8).reshape(-1, ring.size // 8)
                cell, ahead = segments(fps, ring)
                node = np.repeat(part.column("node").to_numpy(), ring.segments)
                yield pa.RecordBatch.from_arrays([pa.array(cell.ravel()), pa.array(ahead.ravel()), pa.array(node)], names=["cell", "ahead", "node"])

    return nodes.mapInArrow(run, "cell bigint, ahead bigint, node bigint")


FOUND = "cell bigint, ahead bigint, node bigint, low bigint"


def _found(cell: np.ndarray, ahead: np.ndarray, node: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (cell, ahead, node, low)], names=["cell", "ahead", "node", "low"])


def candidates(nodes: DataFrame, ring: Ring, block: int = 4096) -> DataFrame:
    """(cell, ahead, node, low): the nodes that share a segment with one that keeps to the chain's budgets.

    ``low`` is the smallest such node, or the node itself. A row per node and cell, however many pairs
    meet there.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in ("cell", "ahead", "node")])
            x = x if held is None else np.concatenate([held, x], axis=1)
            # the last cell may go on in the next batch; of one that is too long already, its number is enough
            last = int(np.searchsorted(x[0], x[0, -1])) if x.shape[1] else 0
            held = x[:, last:]
            yield rows(x[:, :last])
        if held is not None:
            yield rows(held)

    def rows(x: np.ndarray) -> pa.RecordBatch:
        cell, ahead, node = x
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, len(cell)))
        short = np.repeat(size <= SHORT, size)
        touched, low = np.zeros(len(cell), bool), node.copy()
        for d in range(1, SHORT):
            i = np.flatnonzero((cell[d:] == cell[:-d]) & short[d:]) if len(cell) > d else np.zeros(0, np.int64)
            i = i[chained(ahead[i], ahead[i + d], ring)]
            touched[i] = touched[i + d] = True
            np.minimum.at(low, i, node[i + d])
            np.minimum.at(low, i + d, node[i])
        crowded = np.zeros(len(cell), bool)
        for at, n in zip(starts[size > SHORT], size[size > SHORT]):
            if n > block:
                crowded[at] = True  # for passes of its own
            else:
                touched[at : at + n], low[at : at + n] = _lows(node[at : at + n], ahead[at : at + n], ring)
        names = ["cell", "ahead", "node", "low", "crowded"]
        out = touched | crowded
        return pa.RecordBatch.from_arrays([pa.array(c[out]) for c in (cell, ahead, node, low, crowded)], names=names)

    def crowd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ahead, node in groups(batches, BLOCKS, ["ahead", "node"]):
            touched, low = _lows(node, ahead, ring)
            yield _found(np.full(int(touched.sum()), key[0]), ahead[touched], node[touched], low[touched])

    found = written(_cells(nodes, ring).repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, FOUND + ", crowded boolean"), "chained")
    near, marked = found.where("NOT crowded").drop("crowded"), found.where("crowded").select("cell")
    if marked.isEmpty():
        return near
    more = _dealt(_cells(nodes, ring).join(marked, "cell"), block).select(*BLOCKS, "ahead", "node")
    more = more.repartition(*BLOCKS).sortWithinPartitions(*BLOCKS).mapInArrow(crowd, FOUND)
    return written(near.union(more.groupBy("cell", "ahead", "node").agg(F.min("low").alias("low"))), "chained")


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """Rows with ``lo`` and ``hi``: a cell of more than ``block`` rows by pairs of its blocks, any other as one."""
    counts = rows.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.when(F.col("n") > block, F.ceil(F.col("n") / (block // 2))).otherwise(1).cast("bigint").alias("g"))
    mine = rows.join(counts, "cell").withColumn("k", F.pmod(F.xxhash64("node"), F.col("g")))
    partner = F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("g") - 1), lambda j: F.struct(F.least("k", j).alias("lo"), F.greatest("k", j).alias("hi"))))
    return mine.withColumn("p", partner).select(*rows.columns, "p.lo", "p.hi")


def rest(dense: DataFrame, parts: DataFrame, nodes: DataFrame, ring: Ring, block: int = 4096, docs: DataFrame | None = None, words: int = 5) -> DataFrame:
    """Star edges (a, b) for all verified pairs of chained nodes that ``parts``, the components so far, leave apart.

    Nodes with a chained partner of another component get their fingerprints. Rows of nodes whose every pair
    differs in too many bits, or is met in an earlier cell, end there; only the others get their sets, which
    decide inside the task, and only the smallest component that each component reaches leaves it.
    """
    named = dense.join(parts, "node", "left").select("cell", "ahead", "node", F.coalesce("component", "node").alias("part"))

    def apart(ahead: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(part), 256):
            i, j = np.nonzero(chained(ahead[at : at + 256, None], ahead[None, at:], ring) & (part[at : at + 256, None] != part[None, at:]))
            yield i[i < j] + at, j[i < j] + at

    def open_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ahead, node, part in groups(batches, BLOCKS, ["ahead", "node", "part"]):
            if (part == part[0]).all():
                continue
            open_ = np.zeros(len(node), bool)
            for i, j in apart(ahead, part):
                open_[i] = open_[j] = True
            n = int(open_.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k)) for k in key] + [pa.array(x[open_]) for x in (ahead, node, part)], names=[*BLOCKS, "ahead", "node", "part"])

    used = np.packbits(np.arange(ring.size) < ring.used).view(np.uint64)

    def near(cell: int, ahead: np.ndarray, part: np.ndarray, wide: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs apart that all bits leave, each in the first of the cells where it is chained."""
        fps = np.frombuffer(b"".join(wide), np.uint8).reshape(len(part), -1)
        bits, (cells, aheads) = fps.view(np.uint64) & used, segments(fps, ring)
        for i, j in apart(ahead, part):
            for at in range(0, len(i), 1 << 12):
                p, q = i[at : at + (1 << 12)], j[at : at + (1 << 12)]
                ok = np.bitwise_count(bits[p] ^ bits[q]).sum(1, dtype=np.int64) <= ring.far
                p, q = p[ok], q[ok]
                ok = ((cells[p] == cells[q]) & chained(aheads[p], aheads[q], ring)).argmax(1) == cell >> ring.bits
                yield p[ok], q[ok]

    def by_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ahead, node, part, wide in groups(batches, BLOCKS, ["ahead", "node", "part", "wide"]):
            some = np.zeros(len(node), bool)
            for i, j in near(key[0], ahead, part, wide):
                some[i] = some[j] = True
            if n := int(some.sum()):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k)) for k in key] + [pa.array(x[some]) for x in (ahead, node, part)] + [pa.array(wide[some], pa.binary())], names=[*BLOCKS, "ahead", "node", "part", "wide"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ahead, part, wide, sets in groups(batches, BLOCKS, ["ahead", "part", "wide", "shingles"]):
            labels, label = np.unique(part, return_inverse=True)
            root = list(range(len(labels)))

            def top(k: int) -> int:
                while root[k] != k:
                    root[k] = k = root[root[k]]
                return k

            for p, q in near(key[0], ahead, part, wide):
                for x, y in zip(p.tolist(), q.tolist()):
                    u, v = top(int(label[x])), top(int(label[y]))
                    if u != v and (sets[x] is None or similar(sets[x], sets[y], ring.least)):
                        root[max(u, v)] = min(u, v)
            low = np.array([top(k) for k in range(len(labels))])
            less = low < np.arange(len(labels))
            yield pa.RecordBatch.from_arrays([pa.array(labels[less]), pa.array(labels[low[less]])], names=["a", "b"])

    dealt = lambda rows: rows.repartition(*BLOCKS).sortWithinPartitions(*BLOCKS)
    head = "cell bigint, lo bigint, hi bigint, ahead bigint, node bigint, part bigint"
    rows = _dealt(named, block).select(*BLOCKS, "ahead", "node", "part")
    ends = written(dealt(rows).mapInArrow(open_ends, head), "open")
    full = ends.join(nodes.select("node", "wide"), "node").select(*BLOCKS, "ahead", "node", "part", "wide")
    full = written(dealt(full).mapInArrow(by_bits, head + ", wide binary"), "near")
    sets = full.withColumn("shingles", F.lit(None).cast("binary")) if docs is None else full.join(shingle_sets(docs, full.select("node"), words), "node")
    return dealt(sets.select(*BLOCKS, "ahead", "part", "wide", "shingles")).mapInArrow(check, "a bigint, b bigint")


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the documents named in ``ids``."""
    some = docs.withColumnRenamed("doc_id", "node").join(ids.select("node").distinct(), "node", "left_semi")
    return per_row(some, ["node"], "shingles binary", lambda texts: {"shingles": pa.array([shingles(t, words).tobytes() for t in texts], pa.binary())})


def close(pairs: DataFrame, nodes: DataFrame, ring: Ring) -> DataFrame:
    """The pairs that differ in so few bits that they may be similar."""
    both = pairs.join(nodes.select(F.col("node").alias("a"), F.col("wide").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("wide").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, ring.size // 8) for c in "xy")
            differ = np.unpackbits(x ^ y, axis=1)[:, : ring.used].sum(1)
            yield batch.filter(pa.array(differ <= ring.far)).select(["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, docs: DataFrame, ring: Ring, words: int) -> DataFrame:
    """The pairs whose sets of shingles are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    sets = written(shingle_sets(docs, ids, words), "shingles")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    least = ring.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(x.as_py(), y.as_py(), least) for x, y in zip(batch.column("x"), batch.column("y"))]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def linked(nodes: DataFrame, ring: Ring, block: int = 4096, docs: DataFrame | None = None, words: int = 5) -> DataFrame:
    """(node, component) over all chained pairs that are similar; without ``docs``, all that the bits leave."""
    chained_ = candidates(nodes, ring, block)
    first = chained_.where("low < node").groupBy(F.col("node").alias("a")).agg(F.min("low").alias("b"))
    links = written(close(written(first, "first"), nodes, ring), "close")
    if docs is not None:
        links = written(verified(links, docs, ring, words), "links")
    more = written(rest(chained_.drop("low"), components(links), nodes, ring, max(2, block // 4), docs, words), "rest")
    return components(links) if more.isEmpty() else components(links.union(more))


def near_duplicates(docs: DataFrame, words: int = 5, least: float = 0.8, block: int = 4096) -> DataFrame:
    """(doc_id, component_id) per row with an id: the smallest id that links of ``least`` similarity reach."""
    ring = Ring.of(docs.count(), least)
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def prints(texts: list[str]) -> dict:
        wide, sig = fingerprints(texts, words, ring.size)
        return {"wide": _binary(wide), "sig": sig}

    found = written(per_row(rows, ["doc_id"], "wide binary, sig bigint", prints), "wide")
    nodes = written(found.groupBy("wide", "sig").agg(F.min("doc_id").alias("node")), "nodes")
    parts = linked(nodes, ring, block, rows, words)
    named = written(nodes.join(parts, "node", "left").select("wide", "sig", F.coalesce("component", "node").alias("component_id")), "named")
    return found.join(named, ["wide", "sig"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """One row per component, with all its columns: that of the smallest id, of rows that share it the smallest text's. Rows without an id stay, for nothing names them."""
    found = near_duplicates(docs, words, least).where("doc_id = component_id").select("doc_id").distinct()
    known = one_per_id(docs.where("doc_id IS NOT NULL").join(found, "doc_id", "left_semi"))
    return known.unionByName(docs.where("doc_id IS NULL"))
