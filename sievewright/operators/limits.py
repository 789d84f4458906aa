"""Sliding-window usage limits over hits (id, key, ts, w)."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limit:
    """At most ``most`` weight within ``seconds``; a hit exactly that old is out."""

    seconds: int
    most: float

    @property
    def micros(self) -> int:
        return self.seconds * 1_000_000


def usage(hits: DataFrame, limit: Limit) -> DataFrame:
    """Adds ``used``: the weight in the window before and with each hit. Hits of one instant count in order of id."""
    t = F.unix_micros("ts")
    frame = Window.partitionBy("key").orderBy("_t").rangeBetween(-(limit.micros - 1), 0)
    later = Window.partitionBy("key", "_t").orderBy("id").rowsBetween(1, Window.unboundedFollowing)
    rows = hits.withColumn("_t", t)
    return rows.withColumn("used", F.sum("w").over(frame) - F.coalesce(F.sum("w").over(later), F.lit(0))).drop("_t")


class Meter:
    """The weights of one key within the window; reading never writes."""

    def __init__(self, limit: Limit, hits=()):
        self.limit, self.hits = limit, deque(hits)
        self.total = sum(w for _, w in self.hits)

    def prune(self, now: int) -> None:
        while self.hits and now - self.hits[0][0] >= self.limit.micros:
            self.total -= self.hits.popleft()[1]
        if not self.hits:
            self.total = 0.0

    def usage(self, now: int) -> float:
        self.prune(now)
        return self.total

    def limited(self, now: int) -> bool:
        return self.usage(now) >= self.limit.most

    def exceeds(self, now: int, weight: float) -> bool:
        return self.usage(now) + weight > self.limit.most

    def record(self, now: int, weight: float = 1.0) -> None:
        self.prune(now)
        self.hits.append((now, weight))
        self.total += weight


def decide(meter: Meter, now: int, weight: float, weighted: bool) -> bool:
    """Whether a hit is admitted, and so recorded: below the limit, or for weights, still within it."""
    ok = not (meter.exceeds(now, weight) if weighted else meter.limited(now))
    if ok:
        meter.record(now, weight)
    return ok


def replay(hits: DataFrame, limit: Limit, weighted: bool = False) -> DataFrame:
    """(id, key, admitted): each key's hits in order of time and id; only admitted hits count.

    That is recursive, so a key's hits go through one task, sorted, holding no more than the window.
    """
    import pyarrow as pa

    from sievewright.session import ship

    ship(hits.sparkSession)

    def run(batches):
        key, meter = None, None
        for batch in batches:
            ok = []
            for k, t, w in zip(batch.column("key").to_pylist(), batch.column("t").to_pylist(), batch.column("w").to_pylist()):
                if meter is None or k != key:
                    key, meter = k, Meter(limit)
                ok.append(decide(meter, t, w if weighted else 1.0, weighted))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(ok, pa.bool_())], names=["id", "key", "admitted"])

    rows = hits.select("id", "key", F.unix_micros("ts").alias("t"), F.col("w").cast("double").alias("w"))
    kind = hits.schema["key"].dataType.simpleString()
    return rows.repartition("key").sortWithinPartitions("key", "t", "id").mapInArrow(run, f"id bigint, key {kind}, admitted boolean")


ADMITTED, FAILED = "toegelaten", "mislukt"


def admission(everyone: Meter, own: Meter, reserved: Meter, now: int, weight: float, ok: bool) -> str:
    """What becomes of a hit: admitted, failed in the work, or the first limit that stops it.

    Request limits count successes and are read before the work; weight is reserved before it and stays
    so when the work fails.
    """
    if everyone.limited(now):
        return "algemene limiet"
    if own.limited(now):
        return "eigen limiet"
    if reserved.exceeds(now, weight):
        return "tokenlimiet"
    reserved.record(now, weight)
    if not ok:
        return FAILED
    everyone.record(now)
    own.record(now)
    return ADMITTED


def combined(hits: DataFrame, everyone: Limit, each: Limit, tokens: Limit) -> DataFrame:
    """(id, key, decision, used) under three limits; ``used`` is what the client has used once the hit is settled.

    Hits have a ``lane``, what shares the limits on all requests and on weight. A lane's hits are decided one
    by one, since each decision depends on all before it: lanes are what is parallel. A task holds no more
    than the hits of a lane's windows.
    """
    import pyarrow as pa

    from sievewright.session import ship

    ship(hits.sparkSession)

    def run(batches):
        lane, all_, reserved, keys = None, Meter(everyone), Meter(tokens), {}
        for batch in batches:
            out, used = [], []
            for at, k, t, w, ok in zip(*(batch.column(c).to_pylist() for c in ("lane", "key", "t", "w", "ok"))):
                if at != lane:
                    lane, all_, reserved, keys = at, Meter(everyone), Meter(tokens), {}
                own = keys.setdefault(k, Meter(each))
                out.append(admission(all_, own, reserved, t, w, ok))
                used.append(int(own.usage(t)))
                if len(keys) > 10_000:  # keys whose window is empty need no meter
                    keys = {k: m for k, m in keys.items() if m.usage(t)}
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(out, pa.string()), pa.array(used, pa.int64())], names=["id", "key", "decision", "used"])

    rows = hits.select("id", "lane", "key", F.unix_micros("ts").alias("t"), F.col("w").cast("double").alias("w"), "ok")
    kind = hits.schema["key"].dataType.simpleString()
    return rows.repartition("lane").sortWithinPartitions("lane", "t", "id").mapInArrow(run, f"id bigint, key {kind}, decision string, used bigint")
