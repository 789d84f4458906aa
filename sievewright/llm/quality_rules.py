"""Quality rules as a short-circuit cascade.

Each rule reads one measure of a text. A sample gives every rule's cost (seconds per text) and rejection
rate; the cascade runs the rules in falling order of rejection per cost and measures a text only until
one rule rejects it. The order changes the time, never the verdict: a text is kept if no rule rejects it.

Defined cases: a null or empty text has no words and fails ``few_words``; rows that repeat are judged
alike; columns beside ``text`` pass through and never clash, since results are joined to nothing.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.shared import per_row

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(WINDOW)]


class Text:
    """A text whose measures are taken when asked for."""

    def __init__(self, text: str):
        self.text, self.raw = text, text.encode("utf-8", "surrogatepass")
        self.words = self.raw.split()
        self._repeated: int | None = None

    def n_words(self) -> int:
        return len(self.words)

    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, b" \t\n\v\f\r")))

    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    def n_marks(self) -> int:
        return self.raw.count(b"!")

    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    def n_dup_lines(self) -> int:
        lines = self.lines()
        return len(lines) - len(set(lines))

    def n_repeat_words(self) -> int:
        """As ``_count_repeated``, taken once a text."""
        if self._repeated is None:
            self._repeated = self._count_repeated()
        return self._repeated

    def _count_repeated(self) -> int:
        """Words inside windows of eight words that the text holds more than once.

        A rolling 64-bit hash finds candidates; only texts with equal hashes are then compared exactly.
        """
        n = len(self.words) - WINDOW + 1
        if n < 2:
            return 0
        one = np.fromiter(map(hash, self.words), np.int64, len(self.words)).view(np.uint64)
        rolled = np.zeros(n, np.uint64)
        for k, p in enumerate(_POWERS):
            rolled += one[k : k + n] * p
        order = np.sort(rolled)
        twice = order[1:][order[1:] == order[:-1]]
        if not len(twice):
            return 0
        at = np.flatnonzero(np.isin(rolled, twice))
        found = Counter(windows := [tuple(self.words[i : i + WINDOW]) for i in at])
        covered = np.zeros(len(self.words) + 1, np.int64)
        for i, w in zip(at, windows):
            if found[w] > 1:
                covered[i] += 1
                covered[i + WINDOW] -= 1
        return int((np.cumsum(covered) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: Ratios are compared as whole numbers, so that no rounding decides.
RULES = (
    Rule("few_words", lambda t: t.n_words() < 20),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words() > 30 * t.n_words()),
    Rule("symbols", lambda t: 10 * t.n_symbols() > t.n_words()),
    Rule("exclamations", lambda t: 10 * t.n_marks() > 3 * t.n_words()),
    Rule("repeated_lines", lambda t: 100 * t.n_dup_lines() > 60 * len(t.lines())),
)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 200) -> tuple[list[Rule], dict]:
    """The rules by rejections per second on the first ``sample_rows`` texts, and what was measured.

    The sample bounds only this estimate, read from as few partitions as hold it; it reaches no verdict.
    """
    cost, hits = np.zeros(len(rules)), np.zeros(len(rules))
    sample = [Text(r[0] or "") for r in docs.select("text").take(sample_rows)]
    for t in sample:
        for k, r in enumerate(rules):
            began = time.perf_counter()
            hits[k] += r.rejects(t)
            cost[k] += time.perf_counter() - began
    n = max(1, len(sample))
    seen = {r.name: {"seconds": c / n, "rejects": h / n} for r, c, h in zip(rules, cost, hits)}
    rank = lambda r: (-seen[r.name]["rejects"] / max(seen[r.name]["seconds"], 1e-9), seen[r.name]["seconds"], r.name)
    return sorted(rules, key=rank), seen


def cascade(rules: list[Rule], t: Text) -> str | None:
    """The first rule that rejects the text, if one does; later rules are not asked."""
    return next((r.name for r in rules if r.rejects(t)), None)


def judge(docs: DataFrame, key: list[str], rules: tuple[Rule, ...] = RULES, measures: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the ``measures`` asked for, ``rejected_by`` (string, null if kept) and ``kept`` per row."""
    ordered, _ = order_rules(docs, rules)

    def run(texts):
        out = {m: [] for m in (*measures, "rejected_by", "kept")}
        for x in texts:
            t = Text(x)
            for m in measures:
                out[m].append(getattr(t, m)())
            out["rejected_by"].append(by := cascade(ordered, t))
            out["kept"].append(by is None)
        return out | {"rejected_by": _strings(out["rejected_by"])}

    return per_row(docs, key, ", ".join([*(f"{m} bigint" for m in measures), "rejected_by string, kept boolean"]), run)


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows, with all their columns, that no rule rejects; nothing is shuffled."""
    ordered, _ = order_rules(docs, rules)

    def run(batches):
        import pyarrow as pa

        from sievewright.llm.shared import cut

        for batch in cut(batches):
            yield batch.filter(pa.array([cascade(ordered, Text(x or "")) is None for x in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _strings(values: list):
    import pyarrow as pa

    return pa.array(values, pa.string())


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    from sievewright.llm.shared import table

    out = judge(table(spark, sf_dir, "documents"), ["doc_id"], measures=("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents
), w AS (
  SELECT doc_id, t, r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), p AS (
  SELECT r, i, array_to_string(ws[i:i+7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), q AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM p) WHERE c > 1
), n AS (
  SELECT r, count(DISTINCT i + k) AS n FROM q, range(0, 8) AS x(k) GROUP BY r
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^!]', '', 'g')) AS marks, len(ls) AS lines
  FROM w LEFT JOIN n USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR 10 * marks > 3 * n_words OR 100 * n_dup_lines > 60 * lines) AS kept
FROM m
"""
