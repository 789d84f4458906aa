"""Language-model scores from a probabilistic suffix tree over words.

Training texts give exact counts of all words and of all contexts of one and of two words with the words
that follow them. A next word is explicit in a context if it follows it ``least`` times, at any corpus
size. A context stays only if its next-word distribution differs from that of the next shorter context by
a likelihood-ratio test. Its distribution keeps explicit next words, discounted, and gives the rest of its
mass to the shorter context's; the root adds one half to every count. A token is scored by the longest
suffix of what precedes it that is a state of the tree. Each distribution sums to one over the known words
and one unknown word.

Texts are split into words once, into groups of chunks whose words are numbered; tasks that own words by a hash count
them and tell each group its words' ids. Ids run by falling count, so the count of any word follows from
where the counts begin. A logarithm of a probability is a sum of what word, pair and triple add, so every
position is dealt once, by its pair: to the task of its first word, if that is not frequent, which then
judges the word as a context by itself. There pairs and triples are counted, and each text's share of the
scores is summed and told to its chunk. Of contexts of two words, explicit counts travel and, back, what they leave.

What is frequent, by a share of all tokens, is broadcast instead: at most ``1 / pair_share`` words, pairs and
triples. The share decides where a number is looked up, not what it is. ``grow`` is the tree of what is
frequent alone.

Defined cases: a null or empty text is the end token alone; a null id belongs to fold 0 and trains;
without training texts, N and V are 0; rows that repeat are scored alike, each on its own; words stand for
themselves by 64 bits of their hash, and at most 2**31 are told apart. Rows are read twice and told apart by
their place, so a partition must give the same rows each time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from hashlib import blake2b
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm.shared import cut, fold, table
from sievewright.llm.warc import steady

#: The end of a text, as a token: no word is empty.
END = b""
#: What stands before a text's start.
START = -2


@dataclass(frozen=True)
class Params:
    word_share: float = 2e-6
    pair_share: float = 1e-5
    least: int = 2
    discount: float = 0.5
    penalty: float = 2.0
    held_fold: int = 1
    flush: int = 400_000
    positions: int = 1_000_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame, p: Params) -> DataFrame:
    """(word, n, every): occurrences in training texts and in all texts; ``docs`` has text and train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())  # held out, training
        for batch in cut(batches):
            for x, train in zip(batch.column("text").to_pylist(), batch.column("train").to_pylist()):
                seen[train].update(words(x))
                seen[train][END] += 1
            if len(seen[0]) + len(seen[1]) > p.flush:
                yield from (rows(seen[t], t) for t in (0, 1))
                seen[0].clear()
                seen[1].clear()
        yield from (rows(seen[t], t) for t in (0, 1))

    def rows(seen, train):
        n = np.fromiter(seen.values(), np.int64, len(seen))
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(n * train), pa.array(n)], names=["word", "n", "every"])

    return docs.mapInArrow(run, "word string, n bigint, every bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))


class Batch:
    """Ids of all tokens of some texts in a row; -1 for words without an id, -2 before a text's start."""

    def __init__(self, texts: list, ids: dict[bytes, int]):
        self.texts = [words(x) for x in texts]
        end = ids.get(END, -1)
        self.sizes = np.array([len(w) + 1 for w in self.texts], np.int64)
        self.ids = np.empty(int(self.sizes.sum()), np.int64)
        at = 0
        self.starts = np.cumsum(self.sizes) - self.sizes
        for w in self.texts:
            self.ids[at : at + len(w)] = np.fromiter(map(ids.get, w, repeat(-1)), np.int64, len(w))
            at += len(w) + 1
            self.ids[at - 1] = end
        self.h1 = self.before(1)
        self.h2 = self.before(2)

    def before(self, n: int) -> np.ndarray:
        out = np.full(len(self.ids), -2)
        out[n:] = self.ids[:-n]
        for k in range(n):
            at = self.starts[self.sizes > k] + k
            out[at] = -2
        return out


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in sorted ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def pair_counts(docs: DataFrame, ids, contexts, span: int, p: Params) -> DataFrame:
    """(key, n) in training texts. Without ``contexts``, keys are ``first * span + next`` over frequent words;
    with the sorted keys of frequent pairs, ``place of the two words before * span + next``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in cut(batches):
            b = Batch(batch.column("text").to_pylist(), ids.value)
            w = np.where(b.ids < span, b.ids, -1)  # ids run by falling count: the first are frequent
            if contexts is None:
                ctx = np.where(b.h1 < span, b.h1, -1)
            else:
                ok = (b.h1 >= 0) & (b.h1 < span) & (b.h2 >= 0) & (b.h2 < span)
                ctx = find(contexts.value, np.where(ok, b.h2 * span + b.h1, -1))
            ok = (w >= 0) & (ctx >= 0)
            held.append(ctx[ok] * span + w[ok])
            size += len(held[-1])
            if size > 4_000_000:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)

    def rows(held):
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    return docs.where("train").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """The states of one length: keys ``context * span + next`` with their own share, and each context's rest."""

    keys: np.ndarray
    share: np.ndarray
    rest: np.ndarray  # by context; 1 and no keys where a context is no state


@dataclass
class Tree:
    total: int
    distinct: int
    span: int
    root: np.ndarray  # root probability by id
    one: Level
    two: Level
    pairs: np.ndarray  # sorted keys of the contexts of two words

    def next_probability(self, ids: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Probability of each token after the two before it; for words without an id, its ratio to the root's."""
        out = np.where(ids >= 0, self.root[ids] if len(self.root) else 1.0, 1.0)
        one = np.where((h1 >= 0) & (h1 < self.span), h1, -1)
        out = self.step(self.one, one, ids, out)
        both = np.where((one >= 0) & (h2 >= 0) & (h2 < self.span), h2 * self.span + h1, -1)
        return self.step(self.two, find(self.pairs, both), ids, out)

    def step(self, level: Level, ctx: np.ndarray, ids: np.ndarray, below: np.ndarray) -> np.ndarray:
        if not len(level.rest):
            return below
        out = np.where(ctx >= 0, level.rest[ctx], 1.0) * below
        ok = (ctx >= 0) & (ids >= 0) & (ids < self.span)
        at = find(level.keys, np.where(ok, ctx * self.span + ids, -1))
        return out + np.where(at >= 0, level.share[at] if len(level.share) else 0.0, 0.0)


def tallies(at: np.ndarray, n: np.ndarray, own: np.ndarray | float, shorter: np.ndarray, size: int) -> list[np.ndarray]:
    """Per context, over its explicit next words: twice the log likelihood ratio, occurrences, the shorter context's mass, words."""
    return [np.bincount(at, x, size) for x in (2 * n * np.log(n / own / shorter), n, shorter, np.ones(len(n)))]


def judged(g: np.ndarray, inside: np.ndarray, was: np.ndarray, df: np.ndarray, held: np.ndarray, p: Params) -> np.ndarray:
    """The mass each context leaves to the shorter one: 1 for those that are no state, less for all others."""
    left = np.maximum(held - inside, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = g + np.where(left > 0, 2 * left * np.log(left / held / np.maximum(1 - was, 1e-12)), 0)
        return np.where((df > 0) & (g > p.penalty * df), 1 - (inside - p.discount * df) / held, 1.0)


def level(keys: np.ndarray, n: np.ndarray, held: np.ndarray, shorter: np.ndarray, p: Params, span: int) -> Level:
    """Keeps the contexts that differ from the next shorter one.

    ``held``: occurrences of each context; ``shorter``: probability of each key's next word in the shorter
    context. The statistic is twice the log likelihood ratio, over explicit words and the rest.
    """
    ctx, size = keys // span, len(held)
    rest = judged(*tallies(ctx, n, held[ctx], shorter, size), held, p)
    keep = rest[ctx] < 1
    return Level(keys[keep], (n[keep] - p.discount) / held[ctx[keep]], rest)


def pulled(counts: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The keys counted at least ``least`` times, sorted, and their counts; a share bounds their number."""
    got = counts.where(F.col("n") >= least).toArrow()
    keys, n = got["key"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order].astype(np.int64), n[order].astype(np.int64)


def frequent(p: Params, total: int) -> float:
    """The least count of a frequent word, pair or triple."""
    return max(float(p.least), p.pair_share * total)


def grow(docs: DataFrame, counts: DataFrame, p: Params):
    """The tree of what is frequent, the broadcast ids, and the least count of a word with an id."""
    total, distinct, every = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0), F.coalesce(F.sum("every"), F.lit(0))).first()
    least = max(2.0, p.word_share * every)
    got = counts.where(F.col("every") >= least).orderBy(F.desc("n"), "word").toArrow()
    vocab, n = [x.encode("utf-8", "surrogatepass") for x in got["word"].to_pylist()], got["n"].to_numpy().astype(np.int64)
    context = docs.sparkSession.sparkContext
    ids = context.broadcast({w: i for i, w in enumerate(vocab)})
    enough = frequent(p, total)
    span = max(1, int((n >= enough).sum()))
    root = (n + 0.5) / (total + 0.5 * (distinct + 1))
    keys, pairs = pulled(pair_counts(docs, ids, None, span, p), enough)
    own = np.maximum(n[:span], 1).astype(float)
    plain = n / max(1, total)
    one = level(keys, pairs, own, plain[keys % span] if len(keys) else np.zeros(0), p, span)
    tree = Tree(total, distinct, span, root, one, Level(keys[:0], np.zeros(0), np.zeros(0)), keys)
    # two words: contexts are the frequent pairs, which the text's last pair can end as well
    long, thrice = pulled(pair_counts(docs, ids, context.broadcast(keys), span, p), enough)
    if len(long):
        at = keys[long // span]
        shorter = tree.next_probability(long % span, at % span, np.full(len(long), -2))
        tree.two = level(long, thrice, pairs.astype(float), shorter, p, span)
    return tree, ids, least


#: Kinds of pieces: a chunk's tokens and texts, its words and their ids, positions, what is explicit, contexts and states of two words, sums.
TEXT, DOCS, WORDS, IDS, PLACE, PAIRS, TRIPLES, CONTEXT, STATE, OWN, SUMS = range(11)
KINDS = {
    TEXT: [np.int32],
    DOCS: [np.int64, np.int32],
    WORDS: [np.int64, np.int32, np.int32],
    IDS: [np.int32, np.int32],
    PLACE: [np.int32] * 4,
    PAIRS: [np.int32, np.int32, np.int64],
    TRIPLES: [np.int32, np.int32, np.int64],
    CONTEXT: [np.int32, np.int32, np.int64, np.float64],
    STATE: [np.int32, np.int32, np.int64, np.float64],
    OWN: [np.int32, np.int32, np.float64],
    SUMS: [np.int32, np.float64],
}
#: A group has at most as many chunks as this many bits can tell.
GROUP = 8
PIECE = "part int, kind int, base bigint, n int, body binary"


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns in one compressed piece, equal bytes of neighbouring numbers side by side."""
    return pa.Codec("zstd", compression_level=3).compress(b"".join(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in columns), asbytes=True)


def unpacked(body: bytes, n: int, kinds: list) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    if not n:
        return [np.zeros(0, k) for k in kinds]
    raw, out, at = np.frombuffer(pa.decompress(body, n * sum(sizes), codec="zstd", asbytes=True), np.uint8), [], 0
    for k, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k).reshape(-1))
        at += n * size
    return out


def piece(part: int, kind: int, base: int, columns: list[np.ndarray]) -> tuple:
    """(part, (kind, base, rows, body)): what is dealt to a part."""
    return int(part), (kind, int(base), len(columns[0]), packed([np.ascontiguousarray(x, k) for x, k in zip(columns, KINDS[kind])]))


def pieces(part: np.ndarray, kind: int, base: int, columns: list[np.ndarray], parts: int) -> Iterator[tuple]:
    """A piece for each part that has rows; columns come sorted by part."""
    cuts = np.searchsorted(part, np.arange(parts + 1))
    columns = [np.ascontiguousarray(x, k) for x, k in zip(columns, KINDS[kind])]
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        yield piece(k, kind, base, [x[cuts[k] : cuts[k + 1]] for x in columns])


def read(rows: list, kind: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of all pieces of a kind, and each row's base."""
    some = [x for x in rows if x[0] == kind]
    got = [unpacked(body, n, KINDS[kind]) for _, _, n, body in some]
    columns = [np.concatenate([g[k] for g in got]) if got else np.zeros(0, dtype) for k, dtype in enumerate(KINDS[kind])]
    return columns, np.repeat(np.array([x[1] for x in some], np.int64), [x[2] for x in some])


def place(part: int) -> int:
    return part


def mixed(*numbers: np.ndarray | int, parts: int) -> np.ndarray:
    """The part of some numbers."""
    h = np.zeros(1, np.uint64)
    for x, k in zip(numbers, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
        h = h + np.asarray(x, np.int64).astype(np.uint64) * np.uint64(k)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def home(group: int, parts: int) -> int:
    """The part that keeps a group of chunks: evenly spread over tasks and over the groups of each."""
    return int(((group >> 20) * 0.6180339887498949 + (group & (1 << 20) - 1) * 0.7548776662466927) % 1 * parts)


def groups(*sorted_columns: np.ndarray) -> np.ndarray:
    """A number for each run of equal rows."""
    new = np.zeros(len(sorted_columns[0]), bool)
    for x in sorted_columns:
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two ids in one number."""
    return (a.astype(np.int64) << 32) + b


def frame(spark: SparkSession, batches: RDD, schema: str) -> DataFrame:
    """The record batches of an RDD as a table."""

    def closed(batch: pa.RecordBatch) -> tuple[bytes]:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema) as stream:
            stream.write_batch(batch)
        return (out.getvalue().to_pybytes(),)

    def opened(bodies: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bodies:
            for x in batch.column("body"):
                yield from pa.ipc.open_stream(x.as_buffer())

    return spark.createDataFrame(batches.map(closed), "body binary", verifySchema=False).mapInArrow(opened, schema)


class Numbered(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self)
        return out


def chunked(rows: DataFrame, parts: int, p: Params) -> RDD:
    """Chunks of texts in numbers at their homes, and the words of groups of chunks with counts, dealt by a hash of the word.

    A group's chunks, at most ``1 << GROUP``, share the numbers of words and so their home.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, many, held, size, numbers, n = TaskContext.get().partitionId() << 20, 0, [], 0, Numbered(), np.zeros(0, np.int64)
        for batch in cut(batches, 1 << 20):
            for x, rid, train in zip(batch.column("text").to_pylist(), batch.column("rid").to_pylist(), batch.column("train").to_pylist()):
                w = words(x)
                w.append(END)
                held.append((2 * rid + train, np.fromiter(map(numbers.__getitem__, w), np.int32, len(w))))
                size += len(w)
                if size >= p.positions:
                    rows, n = chunk_of(group, many, held, n)
                    yield table_of(rows)
                    many, held, size = many + 1, [], 0
                    if len(numbers) >= p.flush or many >> GROUP:
                        yield table_of(words_of(group, numbers, n))
                        group, many, numbers, n = group + 1, 0, Numbered(), np.zeros(0, np.int64)
        if size:
            rows, n = chunk_of(group, many, held, n)
            yield table_of(rows)
        if len(numbers):
            yield table_of(words_of(group, numbers, n))

    def chunk_of(group, many, held, n):
        doc, ids = np.array([x for x, _ in held], np.int64), np.concatenate([x for _, x in held])
        sizes = np.array([len(x) for _, x in held], np.int32)
        more = np.bincount(ids[np.repeat(doc & 1, sizes) == 1], minlength=max(len(n), int(ids.max()) + 1))
        more[: len(n)] += n
        at, chunk = home(group, parts), (group << GROUP) + many
        return [piece(at, TEXT, chunk, [ids]), piece(at, DOCS, chunk, [doc, sizes])], more

    def words_of(group, numbers, n):
        code = np.frombuffer(b"".join(blake2b(w, digest_size=8).digest() for w in numbers), np.int64)
        part = mixed(code, parts=parts)
        order = np.argsort(part, kind="stable")
        return pieces(part[order], WORDS, group, [code[order], order, n[order]], parts)

    def table_of(rows):
        flat = [(k, *x) for k, x in rows]
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*flat), (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["part", "kind", "base", "n", "body"])

    return rows.select("rid", "text", "train").mapInArrow(run, PIECE).rdd.map(lambda r: (r[0], (r[1], r[2], r[3], bytes(r[4])))).partitionBy(parts, place)


@dataclass
class Known:
    """What every task knows: ids run by falling count, so where each count begins tells the count of any word.

    Pairs and triples here are the frequent ones.
    """

    total: int
    distinct: int
    span: int  # frequent words
    solid: int  # words seen ``least`` times
    counts: np.ndarray  # falling
    first: np.ndarray  # the first id of each count
    few: np.ndarray  # the counts of the first ids
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted: first word * span + second
    pair_n: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    triples: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted: place of the first two in pairs * span + third
    triple_n: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    rest: np.ndarray | None = None  # what frequent words leave
    share: np.ndarray | None = None  # of each pair's second word after the first
    rest_two: np.ndarray | None = None  # what pairs leave

    def n(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.few):
            return np.zeros(len(ids), np.int64)
        out = self.few[np.minimum(ids, len(self.few) - 1)]
        far = np.flatnonzero(ids >= len(self.few))
        out[far] = self.counts[np.searchsorted(self.first, ids[far], "right") - 1]
        return out

    def root(self, ids: np.ndarray) -> np.ndarray:
        return (self.n(ids) + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the pair (a, b) stands, -1 where it is not frequent."""
        out = np.full(len(a), -1)
        near = np.flatnonzero((a >= 0) & (a < self.span) & (b >= 0) & (b < self.span))
        out[near] = find(self.pairs, a[near].astype(np.int64) * self.span + b[near])
        return out

    def triple(self, before: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), -1)
        near = np.flatnonzero((before >= 0) & (b < self.span))
        out[near] = find(self.triples, before[near].astype(np.int64) * self.span + b[near])
        return out


def dictionary(rows: list) -> tuple:
    """Words of a part by falling count: each row's number in its group, group and word, and the counts of words."""
    (code, number, n), chunk = read(rows, WORDS)
    _, word = np.unique(code, return_inverse=True)
    total = np.bincount(word, n, 0).astype(np.int64)
    rank = np.empty(len(total), np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
    return number, chunk, rank[word], -np.sort(-total)


def named(first: RDD, parts: int, p: Params) -> tuple[RDD, Known]:
    """The ids of each group's words at its home, and what all tasks know of words."""

    def census(rows: Iterator[tuple]) -> Iterator[tuple]:
        rows = list(rows)
        *_, n = dictionary([x for _, x in rows])
        if len(n):
            yield rows[0][0], *np.unique(n, return_counts=True)

    got = first.mapPartitions(census).collect()
    part = np.repeat(np.array([x[0] for x in got], np.int64), [len(x[1]) for x in got])
    n, many = (np.concatenate([x[k] for x in got]) if got else np.zeros(0, np.int64) for k in (1, 2))
    order = np.lexsort((part, -n))
    part, n, many = part[order], n[order], many[order]
    start = np.cumsum(many) - many
    if many.sum() >= 1 << 31:
        raise ValueError("more than 2**31 distinct words")
    new = np.flatnonzero(np.diff(n, prepend=-1))
    total, distinct = int((n * many).sum()), int(many[n > 0].sum())
    enough = frequent(p, total)
    few = np.repeat(n, many) if many.sum() < 1 << 18 else np.repeat(n[start < 1 << 18], many[start < 1 << 18])[: 1 << 18]
    known = Known(total, distinct, max(1, int(many[n >= enough].sum())), int(many[n >= p.least].sum()), n[new], start[new], few)
    by_part = np.argsort(part, kind="stable")
    starts = first.context.broadcast((part[by_part], many[by_part], start[by_part]))

    def answer(rows: Iterator[tuple]) -> Iterator[tuple]:
        rows = list(rows)
        number, chunk, rank, n = dictionary([x for _, x in rows])
        if not len(n):
            return
        part, many, start = starts.value
        at = slice(*np.searchsorted(part, [rows[0][0], rows[0][0] + 1]))
        ids = np.arange(len(n)) + np.repeat(start[at] - (np.cumsum(many[at]) - many[at]), many[at])
        order = np.argsort(chunk, kind="stable")
        number, chunk, ids = number[order], chunk[order], ids[rank[order]]
        for c in np.unique(chunk).tolist():
            x = slice(*np.searchsorted(chunk, [c, c + 1]))
            yield piece(home(c, parts), IDS, c, [number[x], ids[x]])

    return first.mapPartitions(answer).partitionBy(parts, place), known


@dataclass
class Chunk:
    """Tokens of some texts in a row; -2 before a text's start."""

    chunk: int
    doc: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray

    def __post_init__(self):
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.h1, self.train = self.shifted(self.ids, START), np.repeat(self.doc & 1, self.sizes) == 1
        self.h2 = self.shifted(self.h1, START)

    def shifted(self, x: np.ndarray, none: int) -> np.ndarray:
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.starts] = none
        return out

    def frequent(self, known: Known) -> tuple[np.ndarray, np.ndarray]:
        """Places of each position's pair and triple."""
        pair = known.pair(self.h1, self.ids)
        return pair, known.triple(self.shifted(pair, -1), self.ids)


def chunks(rows: list) -> Iterator[Chunk]:
    bodies: dict[int, dict] = {}
    for x in rows:
        if x[0] in (TEXT, DOCS, IDS):
            bodies.setdefault(x[1] << GROUP if x[0] == IDS else x[1], {}).setdefault(x[0], []).append(x)
    for chunk, of in sorted(bodies.items()):
        if IDS in of:  # a group begins
            (number, ids), _ = read(of[IDS], IDS)
            by_number = np.empty(len(ids), np.int32)
            by_number[number] = ids
        (doc, sizes), _ = read(of[DOCS], DOCS)
        yield Chunk(chunk, doc, sizes.astype(np.int64), by_number[read(of[TEXT], TEXT)[0][0]])


def often(spark: SparkSession, texts: RDD, known: Known, p: Params) -> Known:
    """Also knows frequent pairs and triples and their counts.

    A pair counts as frequent by what the chunks report where its share is large; what has twice the
    share is in any case. All that is found is counted in all chunks.
    """
    context, span, enough = spark.sparkContext, known.span, frequent(p, known.total)

    def report(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for t in chunks([x for _, x in rows]):
            least = p.pair_share * t.train.sum()
            near = t.train & (t.ids < span) & (t.h1 >= 0) & (t.h1 < span)
            key = np.where(near, t.h1.astype(np.int64) * span + t.ids, -1)
            some, n = np.unique(key[near], return_counts=True)
            some, n = some[n >= least], n[n >= least]
            at = np.full(len(key), -1)
            at[near] = find(some, key[near])
            before = t.shifted(at, -1)
            far = (at >= 0) & (before >= 0)
            long, m = np.unique(before[far] * span + t.ids[far], return_counts=True)
            long, m = long[m >= least], m[m >= least]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, some[long // span]])), pa.array(np.concatenate([np.full(len(some), -1), long % span])), pa.array(np.concatenate([n, m]))], names=["x", "y", "n"])

    got = frame(spark, texts.mapPartitions(report), "x bigint, y bigint, n bigint").groupBy("x", "y").agg(F.sum("n").alias("n")).where(F.col("n") >= enough).toArrow()
    x, y = got["x"].to_numpy(), got["y"].to_numpy()
    pairs = np.sort(x[y < 0])
    known = replace(known, pairs=pairs, triples=np.sort(find(pairs, x[y >= 0]) * span + y[y >= 0]))
    shared = context.broadcast(known)

    def count(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        k = shared.value
        sums = [np.zeros(len(k.pairs), np.int64), np.zeros(len(k.triples), np.int64)]
        for t in chunks([x for _, x in rows]):
            for total, at in zip(sums, t.frequent(k)):
                total += np.bincount(at[(at >= 0) & t.train], minlength=len(total))
        n = np.concatenate(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["x", "n"])

    got = frame(spark, texts.mapPartitions(count), "x bigint, n bigint").groupBy("x").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(pairs) + len(known.triples), np.int64)
    n[got["x"].to_numpy()] = got["n"].to_numpy()
    return replace(known, pair_n=n[: len(pairs)], triple_n=n[len(pairs) :])


def dealt(c: np.ndarray, a: np.ndarray, b: np.ndarray, apart: np.ndarray | bool, span: int, parts: int) -> np.ndarray:
    """The part of a pair (a, b): that of a, if it is not frequent. Triples of a frequent pair lie apart."""
    return mixed(a, np.where(a < span, b, 0), np.where(apart, c, 0), parts=parts)


def occurrences(texts: RDD, shared, parts: int, p: Params) -> RDD:
    """Positions whose pair or triple is not frequent, with the text and the two words before.

    A pair with a word seen less than ``least`` times adds nothing, so such positions are left out, except
    after words that are not frequent: their task has all that follows them.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        k = shared.value
        for t in chunks([x for _, x in rows]):
            pair, triple = t.frequent(k)
            ok = (t.h1 >= 0) & (t.h1 < k.solid) & ((t.ids < k.solid) | (t.h1 >= k.span)) & ((pair < 0) | (t.h2 >= 0) & (triple < 0))
            c, a, b, apart = t.h2[ok], t.h1[ok], t.ids[ok], pair[ok] >= 0
            doc = np.repeat(2 * np.arange(len(t.doc)) + (t.doc & 1), t.sizes)[ok]
            part = dealt(c, a, b, apart, k.span, parts)
            width = int(max(b.max(initial=1), a.max(initial=1))).bit_length()
            order = np.argsort((part << 2 * width) + (a.astype(np.int64) << width) + b) if parts.bit_length() + 2 * width < 63 else np.lexsort((b, a, part))
            yield from pieces(part[order], PLACE, t.chunk, [c[order], a[order], b[order], doc[order]], parts)

    return texts.mapPartitions(run).partitionBy(parts, place)


@dataclass
class Counted:
    """The pairs of a part, sorted, and their triples, with occurrences in training texts."""

    a: np.ndarray
    b: np.ndarray
    n: np.ndarray
    pair: np.ndarray  # of each triple
    c: np.ndarray
    m: np.ndarray

    def judged(self, k: Known, p: Params):
        """Which pairs are frequent; what the first word leaves; the second word's share after it, and what it gets from the root."""
        hot, own = k.pair(self.a, self.b), np.maximum(k.n(self.a), 1)
        known, near = (self.n >= p.least) & (hot < 0), self.a < k.span
        rest = np.ones(len(self.a))
        rest[near] = k.rest[self.a[near]]
        if len(self.a):
            of = groups(self.a)
            some = known & ~near
            held = own[np.flatnonzero(np.diff(of, prepend=-1))]
            left = judged(*tallies(of[some], self.n[some], own[some], k.n(self.b[some]) / k.total, len(held)), held, p)
            rest[~near] = left[of[~near]]
        share = np.where(known & (rest < 1), (self.n - p.discount) / own, 0.0)
        share[hot >= 0] = k.share[hot[hot >= 0]]
        return hot, rest, share, rest * k.root(self.b)


def counted(rows: list) -> tuple[Counted, np.ndarray, np.ndarray, np.ndarray]:
    """What a part's positions hold, and by position: its row among the pieces, its pair, its triple."""
    (c, a, b, doc), _ = read(rows, PLACE)
    key = both(a, b)
    order = np.argsort(key)
    pair = groups(key[order])
    second = np.argsort(both(pair, c[order] + 2))
    order, pair = order[second], pair[second]
    c = c[order]
    triple = groups(pair, c)
    at, of = (np.flatnonzero(np.diff(x, prepend=-1)) for x in (pair, triple))
    train = doc[order] & 1
    n, m = (np.bincount(x, train, 0).astype(np.int64) for x in (pair, triple))
    return Counted(a[order[at]], b[order[at]], n, pair[of], c[of], m), order, pair, triple


def explicit(places: RDD, p: Params) -> RDD:
    """What occurs ``least`` times in each part; triples also where only their whole pair, elsewhere, does."""

    def run(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        x, *_ = counted([x for _, x in rows])
        some = (x.m >= p.least) & (x.c >= 0)
        keep = x.n >= p.least
        yield piece(part, PAIRS, part, [x.a[keep], x.b[keep], x.n[keep]])
        yield piece(part, TRIPLES, part, [(np.cumsum(keep) - 1)[x.pair[some]], x.c[some], x.m[some]])

    return places.mapPartitionsWithIndex(run, preservesPartitioning=True)


def reopened(rows: list) -> Counted:
    return Counted(*read(rows, PAIRS)[0], *read(rows, TRIPLES)[0])


SUMMED = "x bigint, g double, inside double, was double, df double"


def summed(spark: SparkSession, batches: RDD, size: int) -> list[np.ndarray]:
    """The sums of rows (x, ...) by x, a frequent word or pair."""
    got = frame(spark, batches, SUMMED).groupBy("x").agg(*[F.sum(c).alias(c) for c in ("g", "inside", "was", "df")]).toArrow()
    out = [np.zeros(size) for _ in range(4)]
    for column, c in zip(out, ("g", "inside", "was", "df")):
        column[got["x"].to_numpy()] = got[c].to_numpy()
    return out


def batch_of(x: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)), *[pa.array(c.astype(float)) for c in columns]], names=["x", "g", "inside", "was", "df"])


def fit(spark: SparkSession, lists: RDD, known: Known, parts: int, p: Params) -> tuple[RDD, Known]:
    """States of two words where their pairs and triples lie, and what frequent words and pairs leave."""
    context, span, shared = spark.sparkContext, known.span, spark.sparkContext.broadcast(known)

    def ones(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        k, x = shared.value, reopened([x for _, x in rows])
        some = (x.a < span) & (k.pair(x.a, x.b) < 0)
        a, at = np.unique(x.a[some], return_inverse=True)
        yield batch_of(a, tallies(at, x.n[some], k.n(x.a[some]), k.n(x.b[some]) / k.total, len(a)))

    a, b = known.pairs // span, known.pairs % span
    own = known.n(np.arange(span)) if known.total else np.ones(span)
    own = np.maximum(own, 1)
    sums = summed(spark, lists.mapPartitions(ones), span)
    sums = [x + y for x, y in zip(sums, tallies(a, known.pair_n, own[a], known.n(b) / max(1, known.total), span))]
    rest = judged(*sums, own, p)
    known = replace(known, rest=rest, share=np.where(rest[a] < 1, (known.pair_n - p.discount) / own[a], 0.0))
    ready = context.broadcast(known)

    def twos(rows: Iterator[tuple], hot: bool):
        """By explicit triple: where its context stands if that is frequent, the context, occurrences, probability in the shorter one."""
        k, x = ready.value, reopened([x for _, x in rows])
        _, _, share, below = x.judged(k, p)
        a = x.a[x.pair]
        at = k.pair(x.c, a)
        some = (at >= 0) == hot
        return [y[some] for y in (at, x.c, a, x.m, (share + below)[x.pair])]

    def frequent_twos(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        at, _, _, m, likely = twos(rows, True)
        some, of = np.unique(at, return_inverse=True)
        yield batch_of(some, tallies(of, m, 1.0, likely, len(some)))

    def other_twos(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        _, c, a, m, likely = twos(rows, False)
        to = dealt(c, c, a, False, span, parts)
        order = np.lexsort((c, a, to))
        yield from pieces(to[order], CONTEXT, part, [x[order] for x in (c, a, m, likely)], parts)

    sums = summed(spark, lists.mapPartitions(frequent_twos), len(known.pairs))
    at, last = known.triples // span, known.triples % span
    likely = known.share[find(known.pairs, b[at] * span + last)] + rest[b[at]] * known.root(last) if len(at) else np.zeros(0)
    sums = [x + y for x, y in zip(sums, tallies(at, known.triple_n, 1.0, likely, len(a)))]
    sums[0] = sums[0] - 2 * sums[1] * np.log(np.maximum(known.pair_n, 1))
    known = replace(known, rest_two=judged(*sums, np.maximum(known.pair_n, 1), p))

    def states(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        rows = [x for _, x in rows]
        (c, a, m, likely), source = read(rows, CONTEXT)
        (first, second, n), _ = read(rows, PAIRS)
        key, of = np.unique(both(c, a), return_inverse=True)
        own = n[find(both(first, second), key)] if len(key) else n[:0]
        rest = judged(*tallies(of, m, own[of], likely, len(key)), own, p)
        stays = rest < 1
        yield piece(part, OWN, part, [key[stays] >> 32, key[stays] & 0xFFFFFFFF, rest[stays]])
        keep = stays[of]
        source, of = np.divmod(np.unique(both(source[keep], of[keep])), 1 << 32)
        yield from pieces(source, STATE, part, [key[of] >> 32, key[of] & 0xFFFFFFFF, own[of], rest[of]], parts)

    asked = lists.mapPartitionsWithIndex(other_twos).partitionBy(parts, place)
    return lists.union(asked).partitionBy(parts, place).mapPartitionsWithIndex(states).partitionBy(parts, place), known


def sums(places: RDD, states: RDD, fitted, parts: int, p: Params) -> RDD:
    """What a part's words, pairs and triples add to the score of each text, at the home of its chunk."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        k, rows = fitted.value, [x for _, x in rows]
        x, order, pair, triple = counted(rows)
        if not len(order):
            return
        hot, rest, share, below = x.judged(k, p)
        likely = share + below
        add = np.where(hot < 0, np.log10(1 + share / below) + np.where(x.a >= k.span, np.log10(rest), 0.0), 0.0)
        (first, second, left), _ = read(rows, OWN)
        at = find(both(first, second), both(x.a, x.b))
        add += np.where((at >= 0) & (hot < 0), np.log10(np.append(left, 1.0)[at]), 0.0)
        (c, a, own, left), _ = read(rows, STATE)
        by = np.argsort(both(c, a))
        before, last = x.a[x.pair], k.pair(x.c, x.a[x.pair])
        at = find(both(c, a)[by], both(x.c, before))
        own, left = np.append(own[by], 1)[at], np.append(left[by], 1.0)[at]
        near = last >= 0
        own[near], left[near] = k.pair_n[last[near]], k.rest_two[last[near]]
        state = (x.c >= 0) & (x.m >= p.least) & (left < 1)
        more = np.where(state, np.log10(1 + np.where(state, (x.m - p.discount) / own, 0.0) / (left * likely[x.pair])), 0.0)
        value = add[pair] + more[triple]
        (*_, doc), chunk = read(rows, PLACE)
        some = value != 0
        order, value = order[some], value[some]
        known, of = np.unique(chunk, return_inverse=True)
        key, at = np.unique(both(of[order], doc[order] >> 1), return_inverse=True)
        total = np.bincount(at, value, len(key))
        for j, t in enumerate(known.tolist()):
            y = slice(*np.searchsorted(key, [j << 32, j + 1 << 32]))
            if y.stop > y.start:
                yield piece(home(t >> GROUP, parts), SUMS, t, [key[y] & 0xFFFFFFFF, total[y]])

    return places.union(states).partitionBy(parts, place).mapPartitions(run).partitionBy(parts, place)


def score(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text", (fold(F.col("doc_id")) != p.held_fold).alias("train"), F.monotonically_increasing_id().alias("rid"))
    first = chunked(rows, parts, p)
    ids, known = named(first, parts, p)
    texts = first.union(ids).partitionBy(parts, place)
    known = often(spark, texts, known, p)
    places = occurrences(texts, spark.sparkContext.broadcast(known), parts, p)
    lists = explicit(places, p).persist(StorageLevel.DISK_ONLY)
    states, known = fit(spark, lists, known, parts, p)
    fitted = spark.sparkContext.broadcast(known)

    def run(pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        k, pieces = fitted.value, [x for _, x in pieces]
        a, b = k.pairs // k.span, k.pairs % k.span
        leaves = np.log10(k.rest)
        pair_value = np.append(np.log10(1 + k.share / (k.rest[a] * k.root(b))) + np.log10(k.rest_two), 0.0)
        at, last = k.triples // k.span, k.triples % k.span
        likely = k.rest[b[at]] * k.root(last) + (k.share[find(k.pairs, b[at] * k.span + last)] if len(at) else 0.0)
        share = np.where(k.rest_two[at] < 1, (k.triple_n - p.discount) / np.maximum(k.pair_n[at], 1), 0.0)
        triple_value = np.append(np.log10(1 + share / (k.rest_two[at] * likely)), 0.0)
        (doc, more), chunk = read(pieces, SUMS)
        for t in chunks(pieces):
            pair, triple = t.frequent(k)
            base = np.log10(k.root(t.ids))
            near = (t.h1 >= 0) & (t.h1 < k.span)
            model = base + np.where(near, leaves[np.where(near, t.h1, 0)], 0.0) + pair_value[pair] + triple_value[triple]
            mine = chunk == t.chunk
            add = lambda x: np.add.reduceat(x, t.starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(t.doc >> 1), pa.array(t.sizes), pa.array(add((t.ids < k.distinct).astype(np.int64))), pa.array(add(base)), pa.array(add(model) + np.bincount(doc[mine], more[mine], len(t.doc)))],
                names=["rid", "n_tokens", "n_known", "base_score", "score"],
            )

    whole = texts.union(sums(places, states, fitted, parts, p)).partitionBy(parts, place)
    scores = frame(spark, whole.mapPartitions(run), "rid bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    held = (~F.col("train")).alias("held_out")
    return rows.select("rid", "doc_id", "train").join(scores, "rid").select("doc_id", held, "n_tokens", "n_known", F.lit(known.total).cast("long").alias("train_tokens"), "base_score", "score")


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(table(steady(spark), sf_dir, "documents"))
