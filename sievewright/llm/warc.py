"""WARC archives: writing through Spark's text writer, reading by boundary-chain verification.

Writing: a record per page; of records with equal payloads of at least ``min_bytes`` bytes, that of the
largest id is a response and the others revisit it. Each task writes one archive of whole records.

Reading: archives are split anywhere. A split's task sees the bytes cut at every record magic, those
inside payloads included, and emits each candidate's offset and the offset of its successor, which the
lengths in its header give. Offsets in a file follow from the lengths of its splits. Within a split each
candidate's successors are followed to the first one outside it; pointer jumping over these from the
file's start then finds where the record chain enters each split. A last pass walks every split from
its entry and keeps only what the chain reaches, so a magic inside a payload is never a record. Only
pieces of a record that runs on over a split's end are gathered by a shuffle.

Defined cases: a null html is an empty payload; rows of equal id and payload that share the largest id
are all responses; a null id is written as an empty id and never named by a revisit if any id is known; a
page without a url has no target URI; a chain that breaks (bad header, lengths past the end of the file)
ends there, a row of type ``damaged`` says so, and what follows is unread. Versions 1.0 and 1.1 are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.llm.shared import cut, shared_path, stored, table, written

#: What every record begins with; the minor version and the end of the line follow.
MAGIC = "WARC/1."
VERSION = re.compile(rb"[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HEADER = re.compile(rb"(?i)^([a-z-]+):[ \t]*(.*?)[ \t]*$")
#: Keys held by at least this share of rows are broadcast; there are at most its inverse of them.
HOT_SHARE = 1e-3


def decided(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The pages (page_id, url if there is one, html) with payload_bytes, sha1 (hex) and ``response_id``: the id that a revisit refers to, else null.

    Only ids and digests are grouped. Digests that many pages share join by broadcast, so that no task
    gets a third of all rows; their number is bounded by ``HOT_SHARE``.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select("page_id", url.alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("sha1"))
    groups = written(rows.where(F.col("payload_bytes") >= min_bytes).groupBy("sha1").agg(F.count("*").alias("n"), F.max("page_id").alias("top")).where("n > 1"), "digests")
    total = pages.count()
    hot = F.broadcast(groups.where(F.col("n") >= max(2, HOT_SHARE * total)).select("sha1", F.col("top").alias("hot")))
    rest = groups.where(F.col("n") < max(2, HOT_SHARE * total)).select("sha1", "top")
    keyed = rows.select("page_id", "sha1").join(hot, "sha1", "left").where("hot IS NULL").join(rest, "sha1").select("page_id", "sha1", "top")
    cold = written(keyed.where("page_id < top OR page_id IS NULL").distinct(), "revisits")
    out = rows.join(hot, "sha1", "left").join(cold.withColumnRenamed("top", "cold"), ["page_id", "sha1"], "left")
    top = F.coalesce("hot", "cold")
    return out.withColumn("response_id", F.when(top.isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < top)), top)).select("page_id", "url", "html", "payload_bytes", "sha1", "response_id")


def digest(sha1_hex):
    """Base32 of a SHA-1, from its hex digits: every 40 bits are eight base32 letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for k in range(4):
        n = F.conv(F.substring(sha1_hex, 10 * k + 1, 10), 16, 10).cast("long")
        parts += [F.substring(F.lit(letters), (F.shiftright(n, 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for j in range(8)]
    return F.concat(*parts)


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """A WARC file per task below ``path``; nothing but Spark's writer touches the store."""
    rows = decided(pages, min_bytes)
    rid = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("response_id").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(revisit, "").otherwise(F.col("html"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit(f"{MAGIC}0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), rid(F.col("page_id")),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("url", r"\s", "%20")), F.lit("")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), digest(F.col("sha1")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), rid(F.col("response_id")), F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"),
    )
    rows.select(F.concat(head, http, body, F.lit("\r\n")).alias("value")).write.option("lineSep", "\r\n").text(path)


def header(block: bytes) -> tuple[dict[str, str], int] | None:
    """Fields of a record's header and its length, magic left out; None if it is no header."""
    end = block.find(b"\r\n\r\n")
    if end < 0 or not VERSION.match(block):
        return None
    fields = {}
    for line in block[:end].split(b"\r\n")[1:]:
        m = HEADER.match(line)
        if not m:
            return None
        fields[m[1].decode().lower()] = m[2].decode("utf-8", "replace")
    return (fields, end + 4) if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


def steady(spark: SparkSession) -> SparkSession:
    """A session with the settings of this one, in which a text file is split alike by every scan.

    What Spark chooses a split's length from is fixed here, the parallelism of this moment among it, so
    executors that come or go between two scans, or later settings of ``spark``, change nothing.
    """
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            own.conf.set(k, v)
    slots = spark.conf.get("spark.sql.files.minPartitionNum", None) or spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    fixed = {"spark.sql.files.minPartitionNum": slots or str(spark.sparkContext.defaultParallelism)}
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        fixed[k] = spark.conf.get(k)
    for k, v in fixed.items():
        own.conf.set(k, v)
    return own


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, seq, value): the bytes after each magic, up to the next, in order within a split.

    The reader's line separator is the magic itself, so a file is cut at every occurrence of it by
    whichever split the piece starts in. The first piece of a file is what precedes its first magic.
    """
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row per split: its bytes, and the offsets of its candidates and of their successors, from its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, found = None, 0, []
        for batch in batches:
            for file, split, value in zip(batch.column("file").to_pylist(), batch.column("split").to_pylist(), batch.column("value")):
                if (file, split) != key:
                    if key:
                        yield batch_of(*key, at, found)
                    key, at, found = (file, split), 0, []
                raw = value.as_buffer()
                got = header(raw[: 1 << 16].to_pybytes()) or header(raw.to_pybytes())
                found.append((at, at + len(MAGIC) + got[1] + int(got[0]["content-length"]) + 4 if got else -1))
                at += raw.size + len(MAGIC)
        if key:
            yield batch_of(*key, at, found)

    def batch_of(file, split, size, found):
        return pa.RecordBatch.from_pylist([{"file": file, "split": split, "size": size, "at": [a for a, _ in found], "next": [b for _, b in found]}], schema=pa.schema([("file", pa.string()), ("split", pa.int64()), ("size", pa.int64()), ("at", pa.list_(pa.int64())), ("next", pa.list_(pa.int64()))]))

    return pieces(spark, path).mapInArrow(run, "file string, split bigint, size bigint, at array<bigint>, next array<bigint>")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, base, entry, owner): where the split's bytes start, where the record chain enters it
    (-1 if it does not), and the start of the record that covers the split's first bytes.

    A piece at ``at`` follows a magic that ends there: its record starts at ``base + at - len(magic)``,
    base counting from the first magic. The first piece of a file, before any magic, is no candidate.
    """
    rows = written(candidates(spark, path), "candidates")
    order = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # only three numbers per split of a file meet, not the offsets
    bases = rows.select("file", "split", "size").withColumn("base", F.coalesce(F.sum("size").over(order), F.lit(0))).drop("size")
    rows = written(rows.join(bases, ["file", "split"]), "based")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                jump: dict[int, tuple[int, int]] = {}
                for at, to in sorted(zip(r["at"], r["next"]), reverse=True):
                    # to the first record outside, and from the last one inside
                    jump[at] = jump.get(to, (to, at)) if to >= 0 else (-1, at)
                rows = [{"file": r["file"], "split": r["split"], "base": r["base"], "size": r["size"], "node": r["base"] + a, "out": r["base"] + to if to >= 0 else -1, "last": r["base"] + last} for a, (to, last) in jump.items()]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("split", "base", "size", "node", "out", "last"))]))

    nodes = written(rows.mapInArrow(run, "file string, split bigint, base bigint, size bigint, node bigint, out bigint, last bigint"), "jumps")
    # the first record starts where the first magic ends; an empty piece stands before it
    start = len(MAGIC)
    reached = nodes.where(F.col("node") == start).select("file", "node")
    jump = nodes.where("out >= 0").select("file", "node", F.col("out").alias("to"))
    known = reached.count()
    while known:
        more = written(reached.union(reached.join(jump, ["file", "node"]).select("file", F.col("to").alias("node"))).distinct(), "reached")
        if (now := more.count()) == known:
            break
        hop = jump.select("file", F.col("node").alias("to"), F.col("to").alias("far"))
        jump = written(jump.join(hop, ["file", "to"], "left").select("file", "node", F.coalesce("far", "to").alias("to")), "jump")
        reached, known = more, now
    hit = nodes.join(reached, ["file", "node"], "left_semi").select("file", "split", F.col("node").alias("entry"), "last")
    splits = rows.select("file", "split", "base").join(hit, ["file", "split"], "left")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select("file", "split", "base", F.coalesce("entry", F.lit(-1)).alias("entry"), F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(-1)).alias("owner"))


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The archives' records: record_id, target_uri, type, refers_to, digest, payload_bytes, http_length, payload.

    ``payload_bytes`` and ``digest`` are computed from the bytes read; for a revisit they come from its
    header and from the length in its HTTP block. With ``payload`` false the bytes themselves stay out.
    """
    own = steady(spark)
    plan = written(entries(own, path), "entries")
    # one row per input split, as many as the scan itself has to list on the driver
    where = {(r["file"], r["split"]): (r["base"], r["entry"], r["owner"]) for r in plan.collect()}
    shared = spark.sparkContext.broadcast(where)
    fields = [("file", pa.string()), ("start", pa.int64()), ("part", pa.int64()), ("bytes", pa.binary())]
    columns = [("record_id", pa.string()), ("target_uri", pa.string()), ("type", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
    shape = pa.schema([*fields, *columns])
    magic = MAGIC.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, rows, size = None, None, [], 0
        for batch in cut(batches):
            for file, split, value in zip(batch.column("file").to_pylist(), batch.column("split").to_pylist(), batch.column("value")):
                if (file, split) != key:
                    rows += fragments(held)
                    key, held = (file, split), None
                    base, entry, owner = shared.value[key]
                    at, live = base, entry
                raw = value.as_py()
                if at == live:  # the chain is here: a record starts with this piece
                    got = header(raw)
                    need = got[1] + int(got[0]["content-length"]) + 4 if got else len(raw)
                    live = at + len(magic) + need
                    if not got:  # the chain ends here
                        rows.append({"type": "damaged"})
                        live = -1
                    elif need <= len(raw):
                        rows.append(record(raw[: need - 4], payload))
                    else:
                        held = [file, at, [(at, raw)], need, len(raw)]
                elif held:  # inside a record that began in this split
                    held[2].append((at, raw))
                    held[4] += len(magic) + len(raw)
                    if held[4] >= held[3]:
                        rows.append(record(magic.join(x for _, x in held[2])[: held[3] - 4], payload))
                        held = None
                elif owner >= 0 and (entry < 0 or at < entry):  # inside one that began before it
                    rows += [{"file": file, "start": owner, "part": at, "bytes": raw}]
                at += len(raw) + len(magic)
                size += len(raw)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=shape)
                    rows, size = [], 0
        rows += fragments(held)
        yield pa.RecordBatch.from_pylist(rows, schema=shape)

    def fragments(held):
        return [{"file": held[0], "start": held[1], "part": at, "bytes": raw} for at, raw in held[2]] if held else []

    def gather(key, group):
        got = sorted(zip(group.column("part").to_pylist(), group.column("bytes").to_pylist()))
        raw = magic.join(x for _, x in got)
        head = header(raw)
        need = head[1] + int(head[0]["content-length"]) if head else 0
        whole = head and got[0][0] == key[1].as_py() and len(raw) >= need
        return pa.Table.from_pylist([record(raw[:need], payload) if whole else {"type": "damaged"}], schema=pa.schema(columns))

    kinds = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary"}
    text = lambda c: ", ".join(f"{n} {kinds[t]}" for n, t in c)
    # written by the session whose splits are fixed, and read again by the caller's
    found = spark.read.schema(text([*fields, *columns])).parquet(stored(pieces(own, path).mapInArrow(run, text([*fields, *columns])), "records"))
    if any(r[2] >= 0 for r in where.values()):  # else no file has a second split, and nothing can run on
        whole = found.where("start IS NULL").select(*[c for c, _ in columns])
        return whole.unionByName(found.where("start IS NOT NULL").select(*[c for c, _ in fields]).groupBy("file", "start").applyInArrow(gather, text(columns)))
    # a record that runs on over the end of its file left pieces: its first one tells so
    kind = F.when(F.col("start").isNotNull(), "damaged").otherwise(F.col("type")).alias("type")
    return found.where("start IS NULL OR part = start").select(*[kind if c == "type" else c for c, _ in columns])


def record(raw: bytes, payload: bool) -> dict:
    fields, n = header(raw)
    body = raw[n:]
    cut_at = body.find(b"\r\n\r\n") + 4 if fields.get("content-type", "").startswith("application/http") else 0
    http, data = body[:cut_at], body[cut_at:]
    out = {"record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "type": fields["warc-type"], "refers_to": fields.get("warc-refers-to")}
    if out["type"] == "revisit":
        length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        out |= {"digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "payload_bytes": int(length[1]) if length else None}
    else:
        out |= {"digest": base64.b32encode(hashlib.sha1(data).digest()).decode(), "payload_bytes": len(data), "payload": data if payload else None}
    return out


def op4_warc(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    got = read_warc(spark, path, payload=False)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return got.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), number(F.col("refers_to")).alias("refers_to"))


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages
), c AS (
  SELECT page_id, n, d, top, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(d, 1 + 10 * k::INT, 10))::BIGINT >> (35 - 5 * j)::INT) & 31)::INT, 1), '' ORDER BY k, j) AS x
  FROM p, range(0, 4) AS a(k), range(0, 8) AS b(j) GROUP BY ALL
)
SELECT page_id, n::BIGINT AS payload_bytes, x AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM c
"""
