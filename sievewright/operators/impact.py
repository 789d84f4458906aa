"""The best rows per question from an inverted index, exact, without reading every posting.

A posting says how much a token adds to an item, if a question holds it; an item's score is the sum over
the question's tokens. Per token the index knows how many items hold it, the most it adds, and a few of
its best items. A question is answered in steps, all of them equi-joins:

1. the best items of its tokens are scored in full; the last of the wanted places gives a threshold;
2. its most frequent tokens, as long as all they add together stays below the threshold, need not be
   listed: an item that holds only those cannot win. Of the other tokens only postings heavy enough to
   reach the threshold with everything else are listed;
3. items found so and still able to reach the threshold are looked up, by token and item, in the rest.

So a token that half of all items hold is listed only for questions that hold little else. Lists are
split over salts where they are long, and equal questions are answered once.

Where whole texts are asked of whole texts, nearly every item is a candidate of every question. Then the
first places alone are wanted, and ``first_places`` deals items over blocks, each a task that holds its items
by token and scores all questions, as they pass, on all of them. Items move once; what is copied to each
block is the questions' tokens, a small part of the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import rules as R
from sievewright.functions import text as X
from sievewright.operators.tables import counted_before, written

#: Postings of a token and weight beyond which they are dealt over salts.
LONG = 50_000
#: Most blocks that are that long, whatever the index: the length grows with it, so that they can be sent to all tasks.
MOST_LONG = 10_000
#: Copies of a question's row where many of its items meet it.
COPIES = 16
#: Items of a block of the order, if they come in that order.
BLOCK = 4096
#: Most items of a task's block; blocks there are where that is less; questions times items of a block before there are so many.
SLOTS, PARTS, WORK = 49_152, 24, 2**22
#: A token has a row of a block's slots if that share of them holds it, and so many have one at most.
SHARE, ROWS = 64, 4096


@dataclass(frozen=True)
class Index:
    """``held`` (id, w, tokens with spaces between them), written; from it, made where asked for: ``postings`` (token, id, w), ``blocks`` (token, w, n), ``tokens`` (token, df, most), ``best`` (token, id)."""

    held: DataFrame
    postings: DataFrame
    blocks: DataFrame
    tokens: DataFrame
    best: DataFrame

    def among(self, ids: DataFrame) -> Index:
        """The same with postings of the items (id) alone."""
        few = self.held.join(ids, "id", "left_semi")
        return replace(self, held=few, postings=_postings(few))


def held_tokens(items: DataFrame, groups: list[tuple[Column, int]], stop=R.QUESTION_STOP, aliases=None) -> DataFrame:
    """(id, w, tokens): the distinct tokens of each group of fields, as one string, with its weight, whole texts.

    A token with an alias that a group does not hold counts there if the group holds all required terms.
    """
    aliases = R.ALIASES if aliases is None else aliases
    listed = []
    for field, w in groups:
        rows = items.select("id", X.tokens(field, stop, F.array_distinct(X.raw_words(field))).alias("held"))
        more = [F.when(~F.array_contains("held", k) & (F.size(F.array_except(F.array(*map(F.lit, v)), "held")) == 0), F.lit(k)) for k, v in aliases.items()]
        held = F.concat("held", F.array_compact(F.array(*more))) if more else F.col("held")
        listed.append(rows.select("id", F.lit(w).cast("long").alias("w"), F.array_join(held, " ").alias("tokens")).where("tokens <> ''"))  # one string takes half the room of an array
    out = listed[0]
    for other in listed[1:]:
        out = out.unionByName(other)
    return out


def _postings(held: DataFrame) -> DataFrame:
    return held.select(F.explode(F.split("tokens", " ")).alias("token"), "id", "w").groupBy("token", "id").agg(F.sum("w").alias("w"))


def build(items: DataFrame, groups: list[tuple[Column, int]], stop=R.QUESTION_STOP, aliases=None, most: int = 3) -> Index:
    """The index of items with an ``id``; ``most`` is how many places a question may ask for."""
    held = written(held_tokens(items, groups, stop, aliases), "held", compression="zstd")
    posts = _postings(held)
    blocks = posts.groupBy("token", "w").agg(F.count("*").alias("n"))
    tokens = blocks.groupBy("token").agg(F.sum("n").alias("df"), F.max("w").alias("most"))
    place = F.row_number().over(Window.partitionBy("token").orderBy(F.col("w").desc(), "id"))
    best = posts.withColumn("_place", place).where(F.col("_place") <= most).select("token", "id")
    return Index(held, posts, blocks, tokens, best)


def bags(questions: DataFrame, stop=R.QUESTION_STOP) -> tuple[DataFrame, DataFrame]:
    """Questions (qid, bag), and what each distinct bag of tokens asks, (bag, tokens with spaces between them); bags are numbers, questions without a token have none."""
    sorted_ = F.array_sort(X.tokens(F.col("text"), stop))
    rows = written(questions.select("qid", F.array_join(sorted_, " ").alias("tokens")).where("tokens <> ''").withColumn("_key", F.sha2("tokens", 256)), "asked")
    one = written(rows.groupBy("_key").agg(F.first("tokens").alias("tokens")).withColumn("bag", F.monotonically_increasing_id()), "bags")
    return rows.join(one.select("_key", "bag"), "_key").select("qid", "bag"), one.select("bag", "tokens")


def counted(asked: DataFrame) -> DataFrame:
    """(bag, token, n) of bags (bag, tokens)."""
    return asked.select("bag", F.explode(F.split("tokens", " ")).alias("token")).groupBy("bag", "token").agg(F.count("*").alias("n"))


def full_scores(pairs: DataFrame, asked: DataFrame, idx: Index, copies: int = COPIES) -> DataFrame:
    """(bag, id, score) of the pairs (bag, id) given: every token looked up by token and item."""
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_copy")
    wanted = asked.select("bag", "token", "n", copy).hint("merge")  # sizes are guessed without the copies: never sent through the driver
    dealt = pairs.select("bag", "id").distinct().withColumn("_copy", F.pmod(F.xxhash64("id"), F.lit(copies)).cast("int"))
    hits = dealt.join(wanted, ["bag", "_copy"]).join(idx.postings, ["token", "id"])
    return hits.groupBy("bag", "id").agg(F.sum(F.col("n") * F.col("w")).alias("score"))


def thresholds(asked: DataFrame, idx: Index, most: int, least: int) -> DataFrame:
    """(bag, bar): a score that at least ``most`` items reach, or ``least``."""
    seeds = asked.select("bag", "token").join(idx.best, "token").select("bag", "id")
    place = F.row_number().over(Window.partitionBy("bag").orderBy(F.col("score").desc()))
    sure = full_scores(seeds, asked, idx).withColumn("_place", place).where(F.col("_place") <= most)
    sure = sure.groupBy("bag").agg(F.when(F.count("*") >= most, F.min("score")).alias("bar"))
    return asked.select("bag").distinct().join(sure, "bag", "left").select("bag", F.greatest(F.coalesce("bar", F.lit(least)), F.lit(least)).alias("bar"))


def opened(asked: DataFrame, idx: Index, bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is listed, (bag, token, w, n, size) per block of postings, and what is only looked up, (bag, token, n, most).

    All that the tokens looked up can add stays below the bar; a block is listed if it can still reach it.
    """
    w = Window.partitionBy("bag").orderBy(F.col("df").desc(), "token")
    rows = asked.join(bars, "bag").withColumn("_up_to", F.sum(F.col("n") * F.col("most")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = written(rows.withColumn("_all", F.sum(F.col("n") * F.col("most")).over(Window.partitionBy("bag"))).withColumn("_listed", F.col("_up_to") >= F.col("bar")), "opened")
    blocks = rows.where("_listed").join(idx.blocks.withColumnRenamed("n", "size"), "token")
    blocks = blocks.where(F.col("n") * F.col("w") + F.col("_all") - F.col("n") * F.col("most") >= F.col("bar"))
    return blocks.select("bag", "token", "w", "n", "size"), rows.where("NOT _listed").select("bag", "token", "n", "most")


def candidates(idx: Index, bars: DataFrame, listed: DataFrame, rest: DataFrame) -> DataFrame:
    """(bag, id, part): every item whose score may reach the bar, and what the lists gave it; ``listed`` and ``rest`` are ``opened``."""
    total = idx.blocks.agg(F.sum("n")).first()[0] or 0
    length = max(LONG, -(-total // MOST_LONG))
    salts = lambda c: F.expr(f"{c} div {length} + 1")
    long_ = F.broadcast(idx.blocks.where(F.col("n") >= length).select("token", "w", salts("n").alias("_salts")))  # at most MOST_LONG rows
    posts = idx.postings.join(long_, ["token", "w"], "left").withColumn("_salt", F.pmod(F.xxhash64("id"), F.coalesce("_salts", F.lit(1))))
    wanted = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts("size") - 1)))
    found = wanted.join(posts, ["token", "w", "_salt"]).groupBy("bag", "id").agg(F.sum(F.col("n") * F.col("w")).alias("part"))
    # an item that reaches the bar stands in no block left out, so only the tokens looked up can add to its part
    more = rest.groupBy("bag").agg(F.sum(F.col("n") * F.col("most")).alias("more"))
    bound = bars.join(more, "bag", "left").fillna(0, ["more"])
    bound = bound.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).hint("merge")
    dealt = found.withColumn("_copy", F.pmod(F.xxhash64("id"), F.lit(COPIES)).cast("int"))
    return dealt.join(bound, ["bag", "_copy"]).where(F.col("part") + F.col("more") >= F.col("bar")).select("bag", "id", "part")


def scored(asked: DataFrame, idx: Index, most: int, least: int) -> DataFrame:
    """(bag, id, score): all items that score at least as the last of ``most`` places does, and at least ``least``.

    Lists gave such an item all of its tokens but those only looked up, so these are what is looked up here.
    """
    bars = written(thresholds(asked, idx, most, least), "bars")
    listed, rest = opened(asked, idx, bars)
    found = written(candidates(idx, bars, listed, rest), "candidates")
    more = full_scores(found, rest, idx).withColumnRenamed("score", "more")
    out = found.join(more, ["bag", "id"], "left").select("bag", "id", (F.col("part") + F.coalesce("more", F.lit(0))).alias("score"))
    return out.where(F.col("score") >= least)


class Block:
    """Items by slot, in the order that decides between equal scores: the slots of each token, and a row of all slots where many hold it."""

    def __init__(self, names, ranks, places, slots, weights):
        """``names`` are the tokens and ``ranks`` those of the slots; a posting is the place of its name, a slot and a weight, one for each two."""
        import numpy as np

        order = np.argsort(places, kind="stable")
        self.names, self.ranks = names, ranks
        self.slots, self.weights = slots[order].astype(np.int32), weights[order].astype(np.min_scalar_type(int(weights.max(initial=0))))
        df = np.bincount(places, minlength=len(names))
        starts = np.concatenate(([0], np.cumsum(df)))
        self.top = np.maximum.reduceat(self.weights, starts[:-1]).astype(np.int64) if len(names) else np.zeros(0, np.int64)
        often = np.argsort(-df, kind="stable")[:ROWS]
        often = often[df[often] * SHARE >= len(ranks)]
        self.rows = np.zeros((len(often), len(ranks)), self.weights.dtype)
        for row, place in zip(self.rows, often.tolist()):
            at = slice(starts[place], starts[place + 1])
            row[self.slots[at]] = self.weights[at]
        self.row = dict(zip(often.tolist(), self.rows))
        self.starts, self.tops = starts.tolist(), self.top.tolist()
        self.sums = np.zeros(len(ranks), np.uint8), np.zeros(len(ranks), np.int64)

    def best(self, places: list[int], n: list[int], most: int, bar: int) -> list[tuple]:
        """The first ``most`` (score, rank) above ``bar``, for the tokens at these places, each asked ``n`` times."""
        import numpy as np

        full = sum([self.tops[p] * k for p, k in zip(places, n)])
        if full <= bar:
            return []
        sums = self.sums[full > 255]  # what is summed up fits
        sums.fill(0)
        for p, k in zip(places, n):
            add = self.row.get(p)
            if add is not None:
                np.add(sums, add if k == 1 else add.astype(sums.dtype) * k, out=sums)
                continue
            start, end = self.starts[p], self.starts[p + 1]
            add = self.weights[start:end]
            sums[self.slots[start:end]] += add if k == 1 else add.astype(sums.dtype) * k
        out = []
        for _ in range(min(most, len(sums))):
            slot = int(sums.argmax())  # the first of equals
            if sums[slot] <= bar:
                break
            out.append((int(sums[slot]), int(self.ranks[slot])))
            sums[slot] = 0
        return out


class Part:
    """The open questions of a part, and the best (score, rank) each has met; ``bar`` is the score to beat."""

    def __init__(self, most: int, least: int):
        self.most, self.least = most, least
        self.bags: dict[str, dict] = {}

    def ask(self, bag: str, token: str, n: int, bar: int, full: int) -> None:
        if bag not in self.bags:
            self.bags[bag] = {"tokens": [], "n": [], "bar": bar, "full": full, "best": []}
        bag = self.bags[bag]
        bag["tokens"].append(token)
        bag["n"].append(n)

    def block(self, first: int, lists: list[tuple]) -> None:
        """Scores the items from rank ``first`` on; lists: (token, weight, slots)."""
        import numpy as np
        import pyarrow as pa

        places = {t: i for i, t in enumerate(dict.fromkeys(t for t, _, _ in lists))}
        flat = lambda of: np.concatenate([np.zeros(0, np.int64), *(np.full(len(slots), of(t, w)) for t, w, slots in lists)])
        slots = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x) for _, _, x in lists)])
        self.scan(Block(pa.array(places, pa.string()), first + np.arange(BLOCK), flat(lambda t, w: places[t]), slots, flat(lambda t, w: w)))

    def scan(self, block: Block) -> None:
        """Scores the items of a block that comes after those before it."""
        import pyarrow as pa
        import pyarrow.compute as pc

        open_ = [bag for bag in self.bags.values() if bag["bar"] < bag["full"]]
        places = iter(pc.index_in(pa.array([t for bag in open_ for t in bag["tokens"]], pa.string()), value_set=block.names).to_pylist())
        for bag in open_:
            at = [(p, n) for p, n in zip((next(places) for _ in bag["tokens"]), bag["n"]) if p is not None]
            found = block.best([p for p, _ in at], [n for _, n in at], self.most, bag["bar"])
            if found:
                bag["best"] = sorted([*bag["best"], *found], key=lambda x: (-x[0], x[1]))[: self.most]
                if len(bag["best"]) == self.most:
                    bag["bar"] = max(bag["bar"], bag["best"][-1][0])

    def rows(self) -> list[tuple]:
        return [(name, rank, score) for name, bag in self.bags.items() for score, rank in bag["best"]]


class Gathered:
    """What a task has read of a block before its questions come: items' ranks, then their tokens."""

    def __init__(self):
        self.ids, self.ranks, self.held, self.w, self.tokens = [], [], [], [], []

    def add(self, kind: int, rows) -> None:
        import pyarrow.compute as pc

        n = rows.column("n").to_numpy(zero_copy_only=False)
        if kind == 0:
            self.ids.append(rows.column("id"))
            self.ranks.append(n)
        else:
            self.held.append(rows.column("id"))
            self.w.append(n)
            self.tokens.append(pc.split_pattern(rows.column("tokens"), " "))

    def block(self) -> Block | None:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.ids or not self.held:
            return None
        ranks = np.concatenate(self.ranks)
        order = np.argsort(ranks, kind="stable")
        slot = np.empty(len(ranks), np.int64)
        slot[order] = np.arange(len(ranks))
        of = pc.index_in(pa.chunked_array(self.held), value_set=pa.chunked_array(self.ids).combine_chunks())
        lengths = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in self.tokens])
        names = pa.chunked_array([x.flatten() for x in self.tokens]).dictionary_encode().unify_dictionaries()
        places = np.concatenate([x.indices.to_numpy() for x in names.chunks])
        of = np.repeat(pc.fill_null(of, -1).to_numpy(), lengths)
        slots, weights, known = slot[of], np.repeat(np.concatenate(self.w), lengths), of >= 0
        key = places[known].astype(np.int64) * len(ranks) + slots[known]
        weights = weights[known]
        if sum(map(len, self.held)) > len(ranks):  # an item has several groups of fields
            key, at = np.unique(key, return_inverse=True)
            weights = np.bincount(at, weights).astype(np.int64)
        # names that no known item holds are left out
        held, places = np.unique(key // len(ranks), return_inverse=True)
        return Block(names.chunk(0).dictionary.take(pa.array(held)), ranks[order], places, key % len(ranks), weights)


def _scored(rows: DataFrame, most: int, least: int) -> DataFrame:
    """(bag, rank, score): the first places of each question among a block's items. Rows are (block, kind, id, n, tokens), n being
    an item's rank (kind 0), the weight of tokens of it (1) or a question's bag (2)."""
    import pyarrow as pa

    def told(block: Block, rows) -> pa.RecordBatch:
        part, most_w = Part(most, least), int(block.top.max(initial=0))
        for bag, tokens in zip(rows.column("n").to_pylist(), rows.column("tokens").to_pylist()):
            tokens = tokens.split(" ")
            for token, n in Counter(tokens).items():
                part.ask(bag, token, n, least - 1, len(tokens) * most_w)
        part.scan(block)
        cols = list(zip(*part.rows())) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["bag", "rank", "score"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        import numpy as np

        at, gathered, block = None, None, None
        for batch in batches:
            keys = batch.column("block").to_numpy() * 3 + batch.column("kind").to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for start, end in zip(ends, ends[1:]):
                if start == end:
                    continue
                of, kind = divmod(int(keys[start]), 3)
                if of != at:
                    at, gathered, block = of, Gathered(), None
                if kind < 2:
                    gathered.add(kind, batch.slice(start, end - start))
                    continue
                if gathered:
                    block, gathered = gathered.block(), None
                if block:
                    yield told(block, batch.slice(start, end - start))

    return rows.sortWithinPartitions("block", "kind").mapInArrow(run, "bag bigint, rank bigint, score bigint")


def _keys(spark, n: int) -> Column:
    """A number for each of ``n`` partitions that lies there when dealt by it."""
    found = spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id")).collect()  # n rows
    return F.array(*[F.lit(r["id"]) for r in sorted(found, key=lambda r: r["at"])])


def first_places(asked: DataFrame, idx: Index, order: DataFrame, by: list[Column], most: int, least: int) -> DataFrame:
    """(bag, id, score, place): the first ``most`` of all items of ``least`` points or more, by score and then ``by``."""
    from sievewright.session import ship

    ship(asked.sparkSession)
    ranks = written(counted_before(order, None, by, F.lit(True), "rank").select("id", F.col("rank").cast("long").alias("rank")), "ranks")
    items = ranks.count()
    blocks = max(-(-items // SLOTS), min(PARTS, 1 + items * asked.count() // WORK))
    keys = _keys(asked.sparkSession, blocks)
    dealt = F.get(keys, F.pmod(F.xxhash64("id"), F.size(keys)).cast("int")).alias("block")
    none = F.lit(None)
    tokens, id_ = none.cast("string").alias("tokens"), none.cast(idx.held.schema["id"].dataType).alias("id")
    kinds = [
        ranks.select(dealt, F.lit(0).alias("kind"), "id", F.col("rank").alias("n"), tokens),
        idx.held.select(dealt, F.lit(1).alias("kind"), "id", F.col("w").alias("n"), "tokens"),
        asked.select(F.explode(keys).alias("block"), F.lit(2).alias("kind"), id_, F.col("bag").alias("n"), "tokens"),  # each block is asked everything
    ]
    found = _scored(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).repartition(blocks, "block"), most, least)
    place = F.row_number().over(Window.partitionBy("bag").orderBy(F.col("score").desc(), "rank"))
    return found.withColumn("place", place).where(F.col("place") <= most).join(ranks, "rank").select("bag", "id", "score", "place")


def top(questions: DataFrame, idx: Index, order: DataFrame, by: list[Column], most: int, least: int, stop=R.QUESTION_STOP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bag, id, score, place), the questions (qid, bag), and what each bag asks, (bag, token, n, df, most) for tokens the index has.

    ``order`` has ``id`` and the columns that ``by`` breaks equal scores with.
    """
    named, asked = bags(questions, stop)
    return written(first_places(asked, idx, order, by, most, least), "best"), named, counted(asked).join(idx.tokens, "token")
