"""Incremental forms: resuming a cache of results, reviewing by an append-only log, and streaming deduplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.streaming.store import BUCKETS, BucketedStore


def pending(items: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    """Items without a result; safe for nulls, which are never done."""
    return items.join(done.select(*([key] if isinstance(key, str) else key)).distinct(), key, "left_anti")


def resumed(items: DataFrame, done: DataFrame, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The old results of these items and new ones for the rest, in the columns of ``done``."""
    old = done.join(items.select(key).distinct(), key, "left_semi")
    return old.unionByName(work(pending(items, done, key)).select(*done.columns))


def dedup_stream(events: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """A stream's first event of each key; state of a key is dropped once the watermark has passed it."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time: str, by: list[str], size: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count("*").alias("n"))


def upsert(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, buckets: int = BUCKETS, first: bool = False):
    """A query, not yet started, that keeps the last (or with ``first`` the first) row of each key in a ``BucketedStore``.

    A batch reads and writes only the buckets of its keys; one that comes again changes nothing.
    """
    store = BucketedStore(stream.sparkSession, path, key, order, buckets, first)
    return stream.writeStream.foreachBatch(store.merge).option("checkpointLocation", checkpoint)
