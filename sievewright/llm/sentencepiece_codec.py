"""SentencePiece encoding and decoding in Spark tasks.

An Aho-Corasick automaton over the pieces reads the text once. At each position the output links list
every piece that ends there, and each relaxes the best state of that position, as in Viterbi search:

- unigram models: a state is a score, and the piece with the best sum wins;
- BPE models, where sums of scores do not give the merges' result: a state is the last piece of the
  merged prefix. A piece is taken if it survives merging next to the state it follows, that is, if merging
  the two alone gives back the two; exactly one piece per position does. Results of pairs are remembered.

Text is cut where no piece can reach over: before runs of space marks, between a letter or digit and a
mark that follows none inside any piece, and at characters in no piece. Equal parts are encoded once per
worker as long as the memory of ``REMEMBERED`` parts lasts. Characters in no piece become their UTF-8 byte pieces, or the unknown piece.

Defined cases: a null or empty text has no ids; decoding gives back every text exactly where the model
has byte pieces; ids out of range decode to nothing; rows that repeat give equal ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm.shared import cut, table

SPACE = "▁"
REMEMBERED = 400_000


@dataclass(frozen=True)
class Pieces:
    """What encoding needs of a model: (piece, score) by id, with None for pieces that no text matches."""

    names: tuple
    scores: tuple
    bytes_: tuple  # id of the piece of each byte, or empty
    unknown: int
    unigram: bool


def load(path: str, unigram: bool = False) -> Pieces:
    """The pieces of a model file, read on the driver. ``unigram`` says which of the two kinds it is."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    names = tuple(None if special(i) else model.id_to_piece(i) for i in range(n))
    found = {model.id_to_piece(i): i for i in range(n) if model.is_byte(i)}
    return Pieces(names, tuple(model.get_score(i) for i in range(n)), tuple(found[f"<0x{b:02X}>"] for b in range(256)) if len(found) == 256 else (), model.unk_id(), unigram)


class Codec:
    def __init__(self, pieces: Pieces):
        import ahocorasick

        self.p = pieces
        self.ids = {x: i for i, x in enumerate(pieces.names) if x}
        self.rank = {x: pieces.scores[i] for x, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for x, i in self.ids.items():
            self.automaton.add_word(x, (i, len(x)))
        self.automaton.make_automaton()
        letters = {c for x in self.ids for c in x}
        self.letters = letters
        # parts: space marks and what follows them up to the next; a line end apart if no piece has it
        apart = "" if "\n" in letters else "\n"
        follows = {y for x in self.ids for w, y in zip(x, x[1:]) if w.isascii() and w.isalnum()}
        marks = re.escape("".join(c for c in "!\"#$%&()*+,./:;<=>?@[\\]^`{|}~" if c not in follows))
        inner = f"(?:[^{SPACE}{marks}{apart}]|(?<![A-Za-z0-9])[{marks}])" if marks else f"[^{SPACE}{apart}]"
        self.parts = re.compile((f"[{marks}]?" if marks else "") + f"{SPACE}*{inner}+|{SPACE}+" + (f"|[{marks}]" if marks else "") + ("|\n" if apart else ""))
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.low = min((pieces.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        self.known: dict[str, bytes] = {}
        self.raw = [(x or "").replace(SPACE, " ").encode("utf-8") for x in pieces.names]
        for b, i in enumerate(pieces.bytes_):
            self.raw[i] = bytes([b])

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        marked = SPACE + text.replace(" ", SPACE)
        known, out = self.known, []
        for part in self.parts.findall(marked):
            got = known.get(part)
            if got is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                got = np.array(self.part(part), "<i4").tobytes()
                if len(part) < 64:
                    known[part] = got
            out.append(got)
        return np.frombuffer(b"".join(out), "<i4")

    def part(self, text: str) -> list[int]:
        """The ids of one part, split at characters in no piece."""
        if self.letters.issuperset(text):
            return self.viterbi(text)
        out, at = [], 0
        for i, c in enumerate(text):
            if c not in self.letters:
                out += self.viterbi(text[at:i]) if i > at else []
                out += [self.p.bytes_[b] for b in c.encode("utf-8", "surrogatepass")] if self.p.bytes_ else [self.p.unknown]
                at = i + 1
        return out + (self.viterbi(text[at:]) if at < len(text) else [])

    def viterbi(self, text: str) -> list[int]:
        """One pass; ``last[i]`` is the piece that ends the best segmentation of the first i characters."""
        return self.best_sum(text) if self.p.unigram else self.only_merge(text)

    def only_merge(self, text: str) -> list[int]:
        n = len(text)
        last, size = [-1] * (n + 1), [1] * (n + 1)
        pairs, many = self.pairs, len(self.p.names)
        for end, (piece, length) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                ok = pairs.get(before * many + piece)
                if ok is None:
                    ok = self.beside(before, piece)
            else:
                ok = self.stands(piece)
            if ok:
                last[end], size[end] = piece, length
        if last[n] < 0:  # a vocabulary whose merges do not reach all its pieces
            return self.merged(text)
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return out[::-1]

    def best_sum(self, text: str) -> list[int]:
        n, scores = len(text), self.p.scores
        last, size = [-1] * (n + 1), [1] * (n + 1)
        best = [0.0] + [-1e300] * n
        at = 0
        for end, (piece, length) in self.automaton.iter(text):
            end += 1
            while at < end - 1:  # no piece may have ended there: one unknown character
                at += 1
                self.unknown(at, best, last, size)
            score = best[end - length] + scores[piece]
            if score > best[end]:
                best[end], last[end], size[end] = score, piece, length
        while at < n:
            at += 1
            self.unknown(at, best, last, size)
        out = []
        while n:
            if last[n] >= 0:
                out.append(last[n])
            else:
                out += [self.p.bytes_[b] for b in text[n - 1].encode("utf-8")][::-1] if self.p.bytes_ else [self.p.unknown]
            n -= size[n]
        return out[::-1]

    def unknown(self, at: int, best: list, last: list, size: list) -> None:
        if best[at] < best[at - 1] + self.low:
            best[at], last[at], size[at] = best[at - 1] + self.low, -1, 1

    def stands(self, piece: int) -> bool:
        ok = self.alone.get(piece)
        if ok is None:
            ok = self.alone[piece] = self.merged(self.p.names[piece]) == [piece]
        return ok

    def beside(self, a: int, b: int) -> bool:
        """Whether two pieces stay two when merging starts from their characters."""
        if len(self.pairs) >= 4 * REMEMBERED:
            self.pairs.clear()
        names = self.p.names
        together = self.ids.get(names[a] + names[b])
        ok = (together is None or not self.stands(together)) and self.merged(names[a] + names[b]) == [a, b]
        self.pairs[a * len(names) + b] = ok
        return ok

    def merged(self, text: str) -> list[int]:
        """BPE by definition: the best pair is merged, the leftmost of equals, until no pair is a piece."""
        parts, rank = list(text), self.rank.get
        while True:
            best, at = -1e300, -1
            for i in range(len(parts) - 1):
                score = rank(parts[i] + parts[i + 1], best)
                if score > best:
                    best, at = score, i
            if at < 0:
                return [self.ids.get(x, self.p.unknown) for x in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def decode(self, ids) -> str:
        n, raw = len(self.raw), self.raw
        text = b"".join([raw[i] for i in ids if 0 <= i < n]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(2)
def codec(pieces: Pieces) -> Codec:
    return Codec(pieces)


def encode(texts: DataFrame, pieces: Pieces, carry: list[str], check: bool = False) -> DataFrame:
    """``carry`` and ``ids`` per row; with ``check`` also whether decoding gives the text back. No shuffle."""
    shared = texts.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in cut(batches):
            words = [x or "" for x in batch.column("_text").to_pylist()]
            ids = [c.encode(x) for x in words]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            columns = [batch.column(k) for k in range(len(carry))] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))]
            names = [*batch.schema.names[:-1], "ids"]
            if check:
                columns.append(pa.array([c.decode(i.tolist()) == x for i, x in zip(ids, words)], pa.bool_()))
                names.append("round_trip")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = texts.select(*carry, F.col("text").alias("_text"))
    head = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in carry)
    return rows.mapInArrow(run, head + "ids array<int>" + (", round_trip boolean" if check else ""))


def decode(encoded: DataFrame, pieces: Pieces, carry: list[str]) -> DataFrame:
    """``carry`` and ``text`` per row of ``ids``; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in cut(batches):
            got = pa.array([c.decode([i for i in x or () if i is not None]) for x in batch.column("_ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(carry))), got], names=[*batch.schema.names[:-1], "text"])

    rows = encoded.select(*carry, F.col("ids").alias("_ids"))
    head = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in carry)
    return rows.mapInArrow(run, head + "text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents"), load(model or default_model()), ["doc_id"], check=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")
