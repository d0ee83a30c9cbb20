"""Streams with a state for each key: a review log of which the last entry counts, and a queue of work that resumes.

States live in Spark's state store, so a restarted query goes on where it was, and a key's state moves with no other key's.
Both need the RocksDB provider, which ``keyed_state`` sets for the session.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Buckets of a queue's items.
ITEM_BUCKETS = 4096


def keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


DECISION = StructType([StructField("seq", LongType()), StructField("decision", StringType())])
QUEUED = StructType([StructField("state", StringType()), StructField("tries", LongType()), StructField("due", LongType())])


class LastDecision(StatefulProcessor):
    """Gives back a key's decision whenever a later one comes; entries that come again or late give nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", DECISION)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        best = max(((r["seq"], r["decision"] or "") for r in rows if r["seq"] is not None), default=None)
        if best is None:
            return
        held = self.last.get()
        if held is None or best > (held[0], held[1]):
            self.last.update(best)
            yield Row(key=key[0], seq=best[0], decision=best[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        return iter(())

    def close(self) -> None:
        pass


def last_decisions(log: DataFrame, key: str, order: str, decision: str) -> DataFrame:
    """key, seq, decision: the changes of each key's last decision in a streaming log, a null decision taken as blank.

    Of entries with an equal order the largest decision counts; entries without an order don't.
    """
    keyed_state(log.sparkSession)
    kind = log.schema[key].dataType
    out = StructType([StructField("key", kind), StructField("seq", LongType()), StructField("decision", StringType())])
    entries = log.select(F.col(key).alias("key"), F.col(order).cast("long").alias("seq"), F.col(decision).cast("string").alias("decision"))
    return entries.groupBy("key").transformWithState(LastDecision(), out, "Update", "None")


class Queue(StatefulProcessor):
    """Items to do once, given out again when no result came in time, and done for good with one.

    A call to the state store costs about as much as a hundred items' work, so items share a bucket's state: a list of (name,
    key, state, tries, due), read and written at once. The bucket has a timer at its earliest due time or before.
    """

    def __init__(self, lease_ms: int, kind: DataType) -> None:
        self.lease = lease_ms
        self.schema = StructType([StructField("name", StringType()), StructField("key", kind), *QUEUED.fields])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        came: dict[str, tuple] = {}
        for r in rows:
            of, first, finished = came.get(r["name"], (r["key"], None, False))
            if r["ms"] is not None:
                first = r["ms"] if first is None else min(first, r["ms"])
            came[r["name"]] = of, first, finished or r["is_result"]
        held = {x[0]: tuple(x) for x in self.items.get()}
        before = self._earliest(held.values())
        new, changed = {}, False
        for name, (of, first, finished) in came.items():
            _, _, state, tries, _ = held.get(name, (name, of, "", 0, -1))
            if state == "done" or not finished and (state or first is None):
                continue
            if finished:
                now = (name, of, "done", tries, -1)
            else:
                now = (name, of, "todo", 1, max(first, timerValues.getCurrentWatermarkInMs()) + self.lease)
            if name in held:
                held[name], changed = now, True
            else:
                new[name] = now
            yield Row(key=of, state=now[2], tries=now[3])
        if changed:
            self.items.put([*held.values(), *new.values()])
        elif new:
            self.items.appendList([*new.values()])
        due = self._earliest(new.values())
        if due is not None and (before is None or due < before):
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        expiry, mark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        held, changed = [], False
        for name, of, state, tries, due in self.items.get():
            if state == "todo" and (due <= expiry or due < mark):
                tries, due, changed = tries + 1, max(due, mark) + self.lease, True
                yield Row(key=of, state="todo", tries=tries)
            held.append((name, of, state, tries, due))
        if changed:
            self.items.put(held)
        due = self._earliest(held)
        if due is not None:
            self.handle.registerTimer(due)

    @staticmethod
    def _earliest(items) -> int | None:
        return min((x[4] for x in items if x[2] == "todo"), default=None)

    def close(self) -> None:
        pass


def work_queue(events: DataFrame, key: str, time: str, is_result: str, lease: str = "1 hour", late: str = "10 minutes", buckets: int = ITEM_BUCKETS) -> DataFrame:
    """key, state (todo or done), tries: what to do next, from a stream of items and of their results (where ``is_result``).

    An item is given out once, and again whenever ``lease`` has passed in event time without a result. A result ends it,
    before or after the item itself; what comes later, or again, gives nothing. Items share ``buckets`` states, a number that
    stays as it is for a checkpoint's life; a batch reads and writes the states of its own items only.
    """
    spark = events.sparkSession
    keyed_state(spark)
    out = StructType([StructField("key", events.schema[key].dataType), StructField("state", StringType()), StructField("tries", LongType())])
    marked = events.withWatermark(time, late).select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"),
        F.to_json(F.struct(F.col(key).alias("k"))).alias("name"),
        F.col(key).alias("key"),
        F.col(time).alias("at"),
        F.expr(f"unix_millis(`{time}`)").alias("ms"),
        F.coalesce(F.expr(is_result), F.lit(False)).alias("is_result"),
    )
    return marked.groupBy("bucket").transformWithState(Queue(_milliseconds(spark, lease), events.schema[key].dataType), out, "Update", "EventTime")


def _milliseconds(spark: SparkSession, span: str) -> int:
    return spark.sql(f"SELECT unix_millis(timestamp '1970-01-01 00:00:00Z' + interval {span})").first()[0]
