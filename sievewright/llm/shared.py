"""What several operators need: the shared folder, written tables, words, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the ASCII white space that ``bytes.split`` splits at as well.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``; only where that is unset on this machine
    alone, as in local tests, a temporary folder serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sievewright-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/sievewright/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """The table written to the shared folder and read again: this cuts the lineage and survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name, codec))


def stored(df: DataFrame, name: str, codec: str | None = None) -> str:
    """Where in the shared folder the table has been written."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return path


def fold(key: Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def per_row(df: DataFrame, key: list[str], schema: str, f) -> DataFrame:
    """``f(list of texts) -> {column: list}`` over batches of ``text``, beside the ``key`` columns.

    Rows stay where they are: no shuffle. Batches are cut at about 8 MB of text, so that memory does not
    depend on how many long texts follow each other. A null text counts as empty.
    """
    kept = df.select(*key, "text")
    fields = [x.strip().split(" ", 1)[0] for x in schema.split(", ")]
    head = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            out = f(texts)
            columns = [batch.column(c) for c in key] + [x if isinstance(x := out[c], pa.Array) else pa.array(x) for c in fields]
            yield pa.RecordBatch.from_arrays(columns, names=[*key, *fields])

    return kept.mapInArrow(run, f"{head}, {schema}" if key else schema)


def one_per_id(docs: DataFrame) -> DataFrame:
    """Of the rows that share a ``doc_id`` the one of the smallest text, whatever order they come in."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    best = docs.groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(whole, F.struct("text", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))).alias("_row"))
    return best.select("_row.*")


def cut(batches: Iterable[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes at the most, or of one row."""
    for batch in batches:
        n = max(1, -(-batch.nbytes // most))
        step = max(1, -(-batch.num_rows // n))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node that has a link.

    ``edges`` has two long columns ``a`` and ``b``. Alternating large-star and small-star steps, each
    written to the shared folder; they end when a step changes nothing. No node's neighbours meet in
    memory: a step is a minimum per node and an equi-join.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(e.join(low, "u").select("u", F.col("m").alias("v")))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = written(small.where("u <> v").distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = e.groupBy("u").agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return nodes.withColumnRenamed("u", "node").union(roots)
