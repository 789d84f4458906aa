"""Usage limits and ingest on streams."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sievewright.operators.limits import ADMITTED, Limit, Meter, admission, decide

#: Groups of clients that a lane's hits are settled in.
GROUPS = 16
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Limiter(StatefulProcessor):
    """Decides each hit of a key, in order of time and id within a micro-batch; state holds the window's hits."""

    def __init__(self, limit: Limit, weighted: bool):
        self.limit, self.weighted = limit, weighted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hits = handle.getListState("hits", "t bigint, w double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        got = pd.concat(list(rows)).sort_values(["t", "id"])
        meter = Meter(self.limit, sorted((t, w) for t, w in self.hits.get()))
        ok = [decide(meter, int(t), float(w) if self.weighted else 1.0, self.weighted) for t, w in zip(got["t"], got["w"])]
        meter.prune(int(got["t"].iloc[-1]))
        self.hits.put(list(meter.hits)) if meter.hits else self.hits.clear()
        yield pd.DataFrame({"id": got["id"], "key": key[0], "admitted": ok})

    def close(self) -> None:
        pass


def limited(hits: DataFrame, limit: Limit, weighted: bool = False) -> DataFrame:
    """The streaming form of ``operators.limits.replay``: (id, key, admitted) per hit of a stream."""
    spark = hits.sparkSession
    # the processor's own driver-side worker has no search path of this package: send the code itself
    for module in (sys.modules[__name__], sys.modules[Meter.__module__]):
        cloudpickle.register_pickle_by_value(module)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = hits.select("id", "key", F.unix_micros("ts").alias("t"), F.col("w").cast("double").alias("w"))
    return rows.groupBy("key").transformWithStateInPandas(Limiter(limit, weighted), outputStructType="id bigint, key bigint, admitted boolean", outputMode="Append", timeMode="None")


class Reserve(StatefulProcessor):
    """Before the work: decides each hit of a lane under three limits and reserves its weight.

    Requests of the lane and of each client count where they succeed; weight counts from the reservation
    on, whatever comes of it. State is what stands in the windows, so the limits themselves bound it; an
    event-time timer clears it once the last window has passed.
    """

    def __init__(self, everyone: Limit, each: Limit, tokens: Limit):
        self.everyone, self.each, self.tokens = everyone, each, tokens

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getListState("done", "t bigint, w double")
        self.held = handle.getListState("held", "t bigint, w double")
        self.own = handle.getListState("own", "key bigint, t bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        got = pd.concat(list(rows)).sort_values(["t", "id"])
        done, held, own = Meter(self.everyone, sorted(self.done.get())), Meter(self.tokens, sorted(self.held.get())), {}
        for client, t in sorted(self.own.get(), key=lambda x: x[1]):
            own.setdefault(client, Meter(self.each)).record(t)
        out = [admission(done, own.setdefault(int(k), Meter(self.each)), held, int(t), float(w), bool(ok)) for k, t, w, ok in zip(got["key"], got["t"], got["w"], got["ok"])]
        now = int(got["t"].iloc[-1])
        for meter in (done, held, *own.values()):
            meter.prune(now)
        _keep(self.done, list(done.hits))
        _keep(self.held, list(held.hits))
        _keep(self.own, [(client, t) for client, m in own.items() for t, _ in m.hits])
        _timer(self.handle, now + max(self.everyone.micros, self.each.micros, self.tokens.micros))
        yield pd.DataFrame({"id": got["id"], "lane": key[0], "key": got["key"], "ts": got["ts"], "t": got["t"], "decision": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        for state in (self.done, self.held, self.own):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


class Settle(StatefulProcessor):
    """After the work: what each client has used in its window, once a hit is settled.

    A group is many clients of a lane: each group costs calls to the state store, however few its hits.
    """

    def __init__(self, each: Limit):
        self.each = each

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getListState("hits", "key bigint, t bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        got = pd.concat(list(rows)).sort_values(["t", "id"])
        own, used, now = {}, [], int(got["t"].iloc[-1])
        for client, t in sorted(self.hits.get(), key=lambda x: x[1]):
            own.setdefault(client, Meter(self.each)).record(t)
        for client, t, decision in zip(got["key"].tolist(), got["t"].tolist(), got["decision"]):
            meter = own.get(client)
            if decision == ADMITTED:
                meter = own.setdefault(client, Meter(self.each))
                meter.record(t)
            used.append(int(meter.usage(t)) if meter else 0)
        for meter in own.values():
            meter.prune(now)
        _keep(self.hits, [(client, t) for client, m in own.items() for t, _ in m.hits])
        _timer(self.handle, now + self.each.micros)
        yield pd.DataFrame({"id": got["id"], "key": got["key"], "decision": got["decision"], "used": used})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.hits.clear()
        return iter([])

    def close(self) -> None:
        pass


def _keep(state, rows: list) -> None:
    state.put(rows) if rows else state.clear()


def _timer(handle: StatefulProcessorHandle, micros: int) -> None:
    """One timer, at this time; what was set before goes."""
    for at in list(handle.listTimers()):
        handle.deleteTimer(at)
    handle.registerTimer(-(-micros // 1000))


def three_limits(hits: DataFrame, everyone: Limit, each: Limit, tokens: Limit, late: str = "1 second") -> DataFrame:
    """The streaming form of ``operators.limits.combined``: (id, key, decision, used) per hit (id, lane, key, ts, w, ok).

    Two stateful operators in a row: one by ``lane``, what shares the request and weight limits, decides and
    reserves; one by groups of a lane's clients settles. Hits of a micro-batch are taken in order of time and id, batches in
    the order they come; a hit ``late`` or more behind the latest of the batches before is left out.
    """
    spark = hits.sparkSession
    for module in (sys.modules[__name__], sys.modules[Meter.__module__]):
        cloudpickle.register_pickle_by_value(module)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = hits.withWatermark("ts", late).select("id", "lane", "key", "ts", F.unix_micros("ts").alias("t"), F.col("w").cast("double").alias("w"), "ok")
    decided = rows.groupBy("lane").transformWithStateInPandas(Reserve(everyone, each, tokens), outputStructType="id bigint, lane bigint, key bigint, ts timestamp, t bigint, decision string", outputMode="Append", timeMode="EventTime", eventTimeColumnName="ts")
    return decided.withColumn("clients", F.pmod(F.xxhash64("key"), F.lit(GROUPS)).cast("int")).groupBy("lane", "clients").transformWithStateInPandas(Settle(each), outputStructType="id bigint, key bigint, decision string, used bigint", outputMode="Append", timeMode="EventTime")


def windowed_usage(hits: DataFrame, size: str = "60 seconds", slide: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    """Weight per key and sliding window; rows behind the watermark are dropped."""
    return hits.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("window"), "key").agg(F.sum("w").alias("used"), F.count("*").alias("n")).select("key", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "used", "n")


def complete_into(out: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream of aggregates over all that is there; each batch's whole result replaces the last at ``path``, written by the executors."""

    def load(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    out.writeStream.outputMode("complete").foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def to_completion(out: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there, into Parquet, and stops."""
    query = out.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def daily_ingest(rows: DataFrame, store: str, checkpoint: str) -> None:
    """Appends rows of new URL keys to the store, batch by batch; a key already there, or twice in a batch, is skipped.

    A batch is held against the batches before it alone: one that runs again, after a crash between its
    write and its commit, replaces its own rows by the same rows.
    """

    def load(batch: DataFrame, number: int) -> None:
        from sievewright.operators.store import first_per_key, new_rows

        try:
            known = batch.sparkSession.read.parquet(store).where(F.col("batch") < number).select("url_key")
        except Exception as e:  # the first batch finds no store yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = batch.select("url_key").limit(0)
        new_rows(first_per_key(batch, "url_key", "id"), known).write.mode("overwrite").parquet(f"{store}/batch={number}")

    rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
