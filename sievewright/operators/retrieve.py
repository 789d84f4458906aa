"""Keyword retrieval for tables of questions: an inverted index joined on tokens, never a pair loop."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import rules as R
from sievewright.functions import text as X
from sievewright.operators import impact
from sievewright.operators.tables import written

LEAST = 2


def index(items: DataFrame, groups: list[tuple[Column, int]], stop=R.QUESTION_STOP) -> DataFrame:
    """(id, grp, w, token): the distinct tokens of each weighted group of fields."""
    parts = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(w).alias("w"), F.array_distinct(X.tokens(c, stop)).alias("tokens")) for g, (c, w) in enumerate(groups)])
    return items.select("id", F.explode(parts).alias("p")).select("id", "p.grp", "p.w", F.explode("p.tokens").alias("token"))


def scores(questions: DataFrame, idx: DataFrame, stop=R.QUESTION_STOP, aliases=None) -> DataFrame:
    """(qid, id, score): per occurrence of a question's token, the weights of the groups that hold it.

    A token with an alias that a group does not hold counts there if the group holds all required terms.
    """
    aliases = R.ALIASES if aliases is None else aliases
    asked = questions.select("qid", F.explode(X.tokens(F.col("text"), stop)).alias("token")).groupBy("qid", "token").agg(F.count("*").alias("n"))
    hits = asked.join(idx, "token").select("qid", "id", "grp", "token", (F.col("n") * F.col("w")).alias("s"))
    if aliases:
        terms = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        wanted = asked.where(F.col("token").isin(*aliases)).withColumn("terms", F.element_at(terms, F.col("token")))
        wanted = wanted.select("qid", F.col("token").alias("alias"), "n", F.size("terms").alias("k"), F.explode("terms").alias("token"))
        full = wanted.join(idx, "token").groupBy("qid", "alias", "n", "k", "id", "grp", "w").agg(F.count("*").alias("c")).where("c = k")
        full = full.select("qid", "id", "grp", F.col("alias").alias("token"), (F.col("n") * F.col("w")).alias("s"))
        hits = hits.unionByName(full.join(hits, ["qid", "id", "grp", "token"], "left_anti"))
    return hits.groupBy("qid", "id").agg(F.sum("s").alias("score"))


def top(scored: DataFrame, items: DataFrame, most: int = 3, least: int = LEAST, by: tuple[str, ...] = ("score",)) -> DataFrame:
    """(qid, id, …, place): the best by score, then priority, then input order; items has id, priority, ord."""
    order = [F.col(c).desc() for c in by] + [F.col("priority").desc(), F.col("ord").asc()]
    rows = scored.where(F.col("score") >= least).join(items.select("id", "priority", "ord"), "id")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def histories(turns: DataFrame) -> DataFrame:
    """Each user turn with the one before it, and of the last eight messages those of the user and all, cut to 600 characters, and the last two.

    Frames are bounded, so a conversation of any length costs its turns, not their square.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    said = F.when(F.col("role") == "user", F.col("text"))
    recent = F.array_join(F.transform(F.collect_list(F.col("text")).over(w.rowsBetween(-8, -1)), lambda t: F.substring(t, 1, 600)), "\n")
    latest = F.array_join(F.transform(F.collect_list(F.col("text")).over(w.rowsBetween(-2, -1)), lambda t: F.substring(t, 1, 600)), "\n")
    out = turns.withColumns({"previous": F.last(said, ignorenulls=True).over(before), "history": F.array_join(F.filter(F.collect_list(said).over(w.rowsBetween(-8, -1)), lambda t: F.trim(t) != ""), " "), "recent": recent, "latest": latest})
    return out.where("role = 'user'").withColumn("qid", F.concat_ws("-", "conv_id", "turn"))


def dependent(text: Column, most: int = 12) -> Column:
    """Whether a question leans on one before it: short, with a word that points back."""
    words = X.raw_words(text)
    return F.size(words).between(1, most) & F.arrays_overlap(words, F.array(*map(F.lit, R.CUES)))


def follow_up(questions: DataFrame, items: DataFrame, idx: DataFrame, most: int = 3) -> DataFrame:
    """(qid, id, place). The question's own score leads; for dependent ones the previous question breaks
    ties, and stands in alone where the question itself finds nothing."""
    leaning = questions.withColumn("leans", F.coalesce(dependent(F.col("text")) & F.col("previous").isNotNull(), F.lit(False)))
    own = scores(questions.select("qid", "text"), idx)
    past = scores(leaning.where("leans").select("qid", F.col("previous").alias("text")), idx).withColumnRenamed("score", "past")
    both = own.join(past, ["qid", "id"], "full_outer").fillna(0, ["score", "past"])
    best = F.max("score").over(Window.partitionBy("qid"))
    lead = both.withColumn("own", best >= LEAST).withColumn("first", F.when(F.col("own"), F.col("score")).otherwise(F.col("past")))
    lead = lead.select("qid", "id", F.col("first").alias("score"), F.when(F.col("own"), F.col("past")).otherwise(0).alias("past"))
    return top(lead, items, most, by=("score", "past")).select("qid", "id", "score", "past", "place")


def unambiguous(scored: DataFrame, title_scores: DataFrame, items: DataFrame, least: int = 3, guarded: tuple = ()) -> DataFrame:
    """(qid, id): the opted-in item of the best score, unless the next has the same score and title score.

    A guarded winner also needs that no item at all, opted in or not, scores strictly better.
    """
    rows = scored.join(title_scores.withColumnRenamed("score", "title_score"), ["qid", "id"], "left").fillna(0, ["title_score"]).join(items.select("id", "priority", "ord", "opted"), "id")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("title_score").desc(), F.col("priority").desc(), "ord")
    mine = rows.where(F.col("opted") & (F.col("score") >= least))
    mine = mine.withColumns({"r": F.row_number().over(w), "s2": F.lead("score").over(w), "t2": F.lead("title_score").over(w)})
    won = mine.where((F.col("r") == 1) & ~F.coalesce((F.col("s2") == F.col("score")) & (F.col("t2") == F.col("title_score")), F.lit(False)))
    best = scored.groupBy("qid").agg(F.max("score").alias("best"))
    return won.join(best, "qid").where(~F.col("id").isin(*guarded) | (F.col("best") <= F.col("score")) if guarded else F.lit(True)).select("qid", "id", "score")


def ranked_articles(scored: DataFrame, articles: DataFrame, most: int) -> DataFrame:
    """(qid, id, score, place): the first ``most`` places by score, those without a successor first, newest
    first; then each successor that stands behind one it replaces moves right before the first such.

    Articles have id, url, superseded_by, published, ord. ``scored`` holds all rows of a question, or at
    least its first ``most`` and the successors of those.

    Read from the top, a row that is reached pulls its successors, as far as they still stand behind it, to
    right before itself; a pulled row is not reached any more and pulls nothing. So a row is pulled if a row
    before it that names it is not pulled itself, and its place is told by the key (place of the first row
    that pulls it, or its own; pulled or reached; own place). The first ``most`` places hold only the first
    ``most`` rows and their successors.
    """
    rows = written(scored.select("qid", "id", "score").join(articles.select("id", "url", "superseded_by", "published", "ord"), "id"), "scored")
    by = [F.col("score").desc(), F.col("superseded_by").isNotNull().cast("int"), F.col("published").desc(), "ord", "id"]
    place = F.row_number().over(Window.partitionBy("qid").orderBy(*by))
    first = written(rows.withColumn("r", place).where(F.col("r") <= most), "first")
    names = first.where("superseded_by IS NOT NULL").select("qid", F.col("superseded_by").alias("url"), F.col("r").alias("x"))
    next_ = rows.join(names.select("qid", "url").distinct(), ["qid", "url"], "left_semi").join(first.select("qid", "id", "r"), ["qid", "id"], "left_anti")
    after = Window.partitionBy("qid").orderBy(*by)
    nodes = written(first.select("qid", "id", "score", "url", "r").unionByName(next_.withColumn("r", F.row_number().over(after) + most).select("qid", "id", "score", "url", "r")), "nodes")
    edges = written(names.join(nodes.select("qid", "url", F.col("r").alias("y")), ["qid", "url"]).where("y > x").select("qid", "x", "y"), "edges")
    pulled = pulled_rows(edges.where(F.col("y") <= most))
    pullers = edges.join(pulled.select("qid", F.col("y").alias("x")), ["qid", "x"], "left_anti").groupBy("qid", F.col("y").alias("r")).agg(F.min("x").alias("by"))
    keyed = nodes.join(pullers, ["qid", "r"], "left").where((F.col("r") <= most) | F.col("by").isNotNull())
    key = Window.partitionBy("qid").orderBy(F.coalesce("by", "r"), F.col("by").isNull(), "r")
    return keyed.withColumn("place", F.row_number().over(key)).where(F.col("place") <= most).select("qid", "id", "score", F.col("place").cast("long").alias("place"))


def best_articles(questions: DataFrame, idx: impact.Index, articles: DataFrame, most: int = 2, least: int = LEAST, stop=R.QUESTION_STOP) -> DataFrame:
    """(qid, place, id): the first places of all articles of ``least`` points or more, successors promoted and put
    in for what they replace. The index lists no more than the first places need; successors of those are
    scored by lookup."""
    by = [F.col("superseded_by").isNotNull().cast("int"), F.col("published").desc(), F.col("ord"), F.col("id")]
    articles = written(articles.select("id", "url", "superseded_by", "published", "ord"), "articles")  # their texts stay behind
    named, asked = impact.bags(questions, stop)
    best = written(impact.first_places(asked, idx, articles, by, most, least), "best")
    links = articles.where("superseded_by IS NOT NULL").select("id", F.col("superseded_by").alias("url"))
    later = best.select("bag", "id").join(links, "id").select("bag", "url").join(articles.select("id", "url"), "url").select("bag", "id")
    later = written(later.join(best.select("bag", "id"), ["bag", "id"], "left_anti"), "later")
    few = idx.among(written(later.select("id").distinct(), "successors"))
    rows = best.select("bag", "id", "score").unionByName(impact.full_scores(later, impact.counted(asked), few, copies=1).where(F.col("score") >= least))
    ranked = ranked_articles(rows.withColumnRenamed("bag", "qid"), articles, most)
    chosen = substituted(ranked, articles).withColumnRenamed("qid", "bag")
    return named.join(chosen, "bag").select("qid", "place", "id")


def pulled_rows(edges: DataFrame) -> DataFrame:
    """(qid, y): the rows y of edges (qid, x, y) for which some x is not such a row itself; x < y.

    A row with one open predecessor is that predecessor or its contrary, so edges jump over it to what it
    depends on, and the way a chain is known doubles with each round: a chain of a thousand takes ten.
    """
    known = []
    open_ = edges.select("qid", "x", "y", F.lit(True).alias("neg"))
    fresh = open_.select("qid", F.col("x").alias("node")).distinct().join(open_.select("qid", F.col("y").alias("node")).distinct(), ["qid", "node"], "left_anti").withColumn("value", F.lit(False))
    while True:
        told = open_.join(fresh.select("qid", F.col("node").alias("x"), "value"), ["qid", "x"], "left")
        term = F.when(F.col("value").isNotNull(), F.col("value") != F.col("neg"))
        w = Window.partitionBy("qid", "y")
        told = told.withColumns({"term": term}).withColumns({"yes": F.coalesce(F.max("term").over(w), F.lit(False)), "left": F.sum(F.col("term").isNull().cast("int")).over(w)})
        told = written(told, "told")
        fresh = told.where("yes OR left = 0").select("qid", F.col("y").alias("node"), F.col("yes").alias("value")).distinct()
        fresh = written(fresh, "fresh")
        known.append(fresh)
        rest = told.where("NOT yes AND left > 0 AND term IS NULL")
        single = rest.where("left = 1").select("qid", F.col("y").alias("x"), F.col("x").alias("to"), F.col("neg").alias("turned"))
        # an edge to a row that depends on one other now leads to that other, or to its contrary
        open_ = rest.join(single, ["qid", "x"], "left").select("qid", F.coalesce("to", "x").alias("x"), "y", F.when(F.col("turned").isNull(), F.col("neg")).otherwise(F.col("neg") != F.col("turned")).alias("neg")).distinct()
        open_ = written(open_, "open")
        if open_.isEmpty():
            break
    out = known[0]
    for more in known[1:]:
        out = out.unionByName(more)
    return out.where("value").select("qid", F.col("node").alias("y"))


def substituted(chosen: DataFrame, articles: DataFrame) -> DataFrame:
    """(qid, place, id): chosen rows replaced by their successor if its URL is unique and not chosen already.

    Of two rows with one successor, only the first is replaced.
    """
    unique = articles.groupBy("url").agg(F.count("*").alias("n"), F.min("id").alias("next")).where("n = 1").select(F.col("url").alias("superseded_by"), "next")
    rows = chosen.select("qid", "place", "id").join(articles.select("id", "url", "superseded_by"), "id")
    taken = rows.select("qid", F.col("url").alias("superseded_by"), F.lit(True).alias("taken")).distinct()
    rows = rows.join(unique, "superseded_by", "left").join(taken, ["qid", "superseded_by"], "left")
    first = F.row_number().over(Window.partitionBy("qid", "superseded_by").orderBy("place"))
    swap = F.col("next").isNotNull() & F.col("taken").isNull() & (first == 1)
    return rows.select("qid", "place", F.when(swap, F.col("next")).otherwise(F.col("id")).alias("id"))


def snippet(body: Column, summary: Column, relevance: Column, full: Column) -> Column:
    """The body cut to 1200 characters where ``full`` and it says more than the summary; else both fields cut to 500."""
    plain = X.plain_body(body)
    return F.when(full & (plain != "") & (plain != F.trim(summary)), X.truncate_boundary(plain, 1200)).otherwise(F.substring(F.concat_ws(" ", summary, relevance), 1, 500))


def context(sources: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, n_sources, context): blocks of sources numbered in order; a fixed line where there are none.

    Sources have qid, block, place, name, title, snippet.
    """
    n = F.row_number().over(Window.partitionBy("qid").orderBy("block", "place"))
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col("name"), F.lit(' — "'), F.col("title"), F.lit('"\n'), F.col("snippet"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n\n")
    got = sources.withColumn("n", n).groupBy("qid").agg(F.count("*").alias("n_sources"), text.alias("context"))
    return questions.select("qid").join(got, "qid", "left").select("qid", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.coalesce("context", F.lit("(geen bronnen gevonden)")).alias("context"))


def growth(before: DataFrame, after: DataFrame) -> DataFrame:
    """(qid, before, after, growth): estimated tokens of each question's context under two versions of a store, and by how
    much they grew; a question one version does not know counts as empty there."""
    told = lambda df, name: df.select("qid", X.token_estimate(F.col("context")).alias(name))
    out = told(before, "before").join(told(after, "after"), "qid", "full_outer").fillna(0, ["before", "after"])
    return out.withColumn("growth", F.col("after") - F.col("before"))


def unanswered(questions: DataFrame, *sources: DataFrame) -> DataFrame:
    """(qid, text): the questions that none of the tables of sources (qid, …) answers, each with its history before it."""
    lost = questions
    for found in sources:
        lost = lost.join(found.select("qid").distinct(), "qid", "left_anti")
    return lost.select("qid", F.concat_ws(" ", "history", "text").alias("text"))


def cited(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(qid, ids): cited ids that are sources; where none is and the answer did not say so, the first four."""
    have = sources.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("have"))
    kept = F.array_intersect("cited", "have")
    return answers.join(have, "qid").select("qid", F.when((F.size(kept) == 0) & ~F.col("insufficient"), F.slice("have", 1, 4)).otherwise(kept).alias("ids"))


def answer_rows(text: Column) -> Column:
    """(first sentence, the rest) of a source; a text without a sentence leads as it is."""
    s = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")
    return F.struct(F.coalesce(F.get(s, 0), text).alias("lead"), F.array_join(F.slice(s, 2, 1000000), " ").alias("rest"))


def answerable(text: Column) -> Column:
    """Whether a kept text alone may answer a question: not where it asks for an amount, a comparison or a personal case."""
    return ~F.coalesce(text, F.lit("")).rlike(R.PERSONAL)


def request_error(text: Column) -> Column:
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "leeg").when(F.length(text) > 600, "te lang")


def complex_question(text: Column) -> Column:
    return (F.length(text) > 140) | (F.regexp_count(text, F.lit(r"\?")) > 1)


def decision(error: Column, direct: Column, limited: Column, sources: Column, item: Column) -> Column:
    """How a request is answered."""
    return F.when(error.isNotNull(), F.concat(F.lit("fout: "), error)).when(direct, "direct").when(limited & (sources > 0), "bronnen zonder model").when(limited & item, "kennisitem").when(limited, "limiet").otherwise("model")
