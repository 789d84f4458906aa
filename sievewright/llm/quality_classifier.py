"""Quality classifier: random-indexing token vectors, pooled per text, then a two-layer network.

1. Every token, however rare, has a row by a hash of itself, in a table of ``rows`` rows; no token is left
   out, and no vocabulary is counted. Rare tokens share rows, frequent ones dominate theirs.
2. Random indexing over all texts: each row has a fixed random index vector of signs, and its context
   vector is the sum of the index vectors of the tokens within two places, over the whole corpus.
3. A text's features are the mean and the spread of its tokens' context vectors.
4. A two-layer numpy network is fitted to at most ``max_train`` labelled texts, chosen by a hash of the
   id; a fifth of them is set aside to calibrate a temperature, so that scores are probabilities.

Ids, languages, sources and labels are never inputs of a score.

Defined cases: a null or empty text has all-zero features and still gets a score; an id with two
different labels trains nothing; of rows that share an id the smallest text trains; with fewer than two
classes among the labels, every score is the share of label 1 (0.5 without labels); repeated rows get
equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.shared import cut, fold, per_row, table, written

REACH = 2
CHUNK = 200_000
PIECE = 1 << 20
#: What a byte is: white space or control, letter (all beyond ASCII too), digit, underscore, mark.
KIND = np.array([0 if c <= 32 or c == 127 else 1 if c >= 128 or chr(c).isalpha() else 2 if chr(c).isdigit() else 3 if c == 95 else 4 for c in range(256)], np.uint8)
_BASE = 0x9E3779B97F4A7C15
_POWERS, _INVERSE = (np.cumprod(np.where(np.arange(PIECE + 1) == 0, np.uint64(1), np.uint64(x)), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


@dataclass(frozen=True)
class Params:
    dims: int = 48
    signs: int = 4
    rows: int = 1 << 14
    max_train: int = 20_000
    hidden: int = 32
    epochs: int = 40
    seed: int = 7
    threshold: float = 0.3


def pieces(raw: bytes) -> list[bytes]:
    """The text in pieces of at most PIECE bytes, cut at white space where there is some."""
    out = []
    while len(raw) > PIECE:
        at = max(raw.rfind(b" ", 0, PIECE), raw.rfind(b"\n", 0, PIECE)) + 1 or PIECE
        out.append(raw[:at])
        raw = raw[at:]
    return [*out, raw]


def token_codes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each token, a run of bytes of one kind, and whether it is a word. Hashes are differences of one running sum."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    kind = KIND[b]
    cuts = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(b)]])
    real = kind[cuts[:-1]] != 0
    starts, ends = cuts[:-1][real], cuts[1:][real]
    running = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b + np.uint64(1)) * _POWERS[: len(b)], out=running[1:])
    codes = (running[ends] - running[starts]) * _INVERSE[starts]
    return (codes ^ (codes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9), kind[starts] == 1


def token_rows(text: str, rows: int) -> np.ndarray:
    """The row of each token, ``rows`` a power of two. One that equals the token before, or as a word the one
    before that, is followed by row ``rows``. Runs of over PIECE bytes count as several tokens."""
    parts = [token_codes(x) for x in pieces(text.encode("utf-8", "surrogatepass"))]
    codes, word = parts[0] if len(parts) == 1 else (np.concatenate(x) for x in zip(*parts))
    again = np.zeros(len(codes), bool)
    again[1:] = codes[1:] == codes[:-1]
    again[2:] |= (codes[2:] == codes[:-2]) & word[2:]
    out = (codes >> np.uint64(65 - rows.bit_length())).astype(np.int64)
    return np.insert(out, np.flatnonzero(again) + 1, rows) if again.any() else out


def index_vectors(p: Params) -> np.ndarray:
    """For each row and for the mark of repeats, the ``signs`` places of its sparse sign vector: 2 * dimension + (sign < 0)."""
    return np.random.default_rng(p.seed).integers(0, 2 * p.dims, (p.signs, p.rows + 1))


def context_vectors(docs: DataFrame, p: Params) -> np.ndarray:
    """Random indexing over all texts, in sums per row, scaled to length one."""
    names = [f"v{k}" for k in range(p.dims)]

    def accumulate(batches):
        index = index_vectors(p)
        sums = np.zeros((p.rows + 1) * 2 * p.dims, np.int64)
        held, size = [], 0
        for batch in cut(batches):
            for x in batch.column("text").to_pylist():
                ids = token_rows(x or "", p.rows)
                held += [ids, np.full(REACH, -1)]  # a gap, so that no pair reaches over two texts
                size += len(ids)
                if size > CHUNK:
                    add_pairs(sums, np.concatenate(held), index, 2 * p.dims)
                    held, size = [], 0
        if held:
            add_pairs(sums, np.concatenate(held), index, 2 * p.dims)
        sums = sums.reshape(-1, p.dims, 2)
        sums = sums[:, :, 0] - sums[:, :, 1]
        at = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(sums[at, k]) for k in range(p.dims))], names=["id", *names])

    parts = docs.select("text").mapInArrow(accumulate, "id bigint, " + ", ".join(f"{c} bigint" for c in names))
    out = np.zeros((p.rows + 1, p.dims), np.float32)
    for r in parts.groupBy("id").agg(*[F.sum(c).alias(c) for c in names]).collect():  # p.rows + 1 rows at the most
        out[r[0]] = r[1:]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def add_pairs(sums: np.ndarray, ids: np.ndarray, index: np.ndarray, width: int) -> None:
    """Count, in each token's row of ``sums``, the places of the index vectors of the tokens within ``REACH`` of it."""
    for reach in range(1, REACH + 1):
        a, b = ids[:-reach], ids[reach:]
        ok = (a >= 0) & (b >= 0)
        a, b = a[ok], b[ok]
        for places in index:
            sums += np.bincount(np.concatenate([a * width + places[b], b * width + places[a]]), minlength=len(sums))


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Per text: mean and standard deviation of its tokens' vectors."""
    dims = vectors.shape[1]
    out = np.zeros((len(texts), 2 * dims), np.float32)
    for i, x in enumerate(texts):
        ids = token_rows(x, len(vectors) - 1)
        if len(ids):
            ids, n = np.unique(ids, return_counts=True)
            rows, share = vectors[ids], (n / n.sum()).astype(np.float32)
            out[i, :dims] = mean = share @ rows
            out[i, dims:] = np.sqrt(np.maximum(share @ (rows * rows) - mean * mean, 0))
    return out


@dataclass
class Network:
    """Two layers over standardised features; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, p: Params) -> Network:
    """Adam on the log loss with weight decay; a fifth of the rows chooses the temperature."""
    rng, d = np.random.default_rng(p.seed), x.shape[1]
    flat = np.zeros((d, p.hidden))
    net = Network(np.zeros(d), np.ones(d), flat, np.zeros(p.hidden), np.zeros(p.hidden), 0.0)
    share = float(y.mean()) if len(y) else 0.5
    net.b2 = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if len(y) < 10 or share in (0.0, 1.0):
        return net
    net.mean, net.scale = x.mean(0), x.std(0) + 1e-6
    net.w1, net.w2 = rng.normal(0, np.sqrt(2 / d), (d, p.hidden)), rng.normal(0, np.sqrt(1 / p.hidden), p.hidden)
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 5], order[len(y) // 5 :]
    z = (x - net.mean) / net.scale
    moments: dict = {}
    step = 0
    for _ in range(p.epochs):
        rng.shuffle(train)
        for at in range(0, len(train), 128):
            i = train[at : at + 128]
            h = z[i] @ net.w1 + net.b1
            a = np.maximum(h, 0)
            g = (1 / (1 + np.exp(-np.clip(a @ net.w2 + net.b2, -30, 30))) - y[i]) / len(i)
            back = np.outer(g, net.w2) * (h > 0)
            step += 1
            for name, grad in (("w1", z[i].T @ back + 1e-4 * net.w1), ("b1", back.sum(0)), ("w2", a.T @ g + 1e-4 * net.w2), ("b2", g.sum())):
                m, v = moments.get(name, (0, 0))
                moments[name] = m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
                setattr(net, name, getattr(net, name) - 3e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
    logit = net.logits(x[held])
    loss = lambda t: np.mean(np.logaddexp(0, logit / t) - y[held] * logit / t)
    net.temperature = float(min(np.geomspace(0.25, 16, 61), key=loss))
    return net


@dataclass
class Model:
    vectors: np.ndarray
    net: Network

    def score(self, texts: list[str]) -> np.ndarray:
        return self.net.score(pooled(texts, self.vectors))


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """Vectors from all texts; the network from labelled rows whose fold is not 0."""
    vectors = context_vectors(docs, p)
    clear = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2")
    chosen = clear.where(fold(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_train).select("doc_id", "y")
    rows = docs.select("doc_id", "text").join(F.broadcast(written(chosen, "chosen")), "doc_id")  # max_train rows at most
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = per_row(rows, ["doc_id", "y"], "x array<float>", lambda texts: {"x": list(pooled(texts, vectors))}).orderBy("doc_id").collect()
    x = np.array([r[2] for r in got], float).reshape(len(got), 2 * p.dims)
    return Model(vectors, fit(x, np.array([r[1] for r in got], float), p))


def score(docs: DataFrame, model: Model, key: list[str]) -> DataFrame:
    """``key`` and ``score`` per row; no shuffle."""
    return per_row(docs, key, "score double", lambda texts: {"score": model.score(texts).astype(float)})


def keep(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows, with all their columns, that score at least ``threshold``."""

    def run(batches):
        for batch in cut(batches):
            yield batch.filter(pa.array(model.score([x or "" for x in batch.column("text").to_pylist()]) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, p = table(spark, sf_dir, "documents"), Params()
    model = train(docs, table(spark, sf_dir, "labels"), p)
    out = score(docs, model, ["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))
