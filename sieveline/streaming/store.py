"""A table of the last (or the first) row of each key, in buckets of which a batch touches only its own.

    path/rows/v=N/bucket=B   the rows of bucket B as of version N
    path/versions/N.json     which version of each bucket is the current one at version N, and the table's settings

A version becomes visible by its JSON file, which is put there whole and once. Readers take the newest; a bucket's rows are
deleted when none of the last ``KEPT`` versions refers to them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.plans.commit import AlreadyThere, delete, names, put_if_absent, read_text

BUCKETS, KEPT = 64, 2


class BucketedStore:
    def __init__(self, spark: SparkSession, path: str, key: str, order: str, buckets: int = BUCKETS, first: bool = False) -> None:
        """``order`` decides which of a key's rows is the last, or with ``first`` the first, and then the other columns do."""
        self.spark, self.path, self.key, self.order, self.first = spark, path.rstrip("/"), key, order, first
        newest = self.newest()
        self.buckets = self._version(newest)["buckets"] if newest is not None else buckets

    def newest(self) -> int | None:
        found = [int(n[:-5]) for n in names(self.spark, f"{self.path}/versions") if n.endswith(".json") and n[:-5].isdigit()]
        return max(found, default=None)

    def _version(self, n: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/versions/{n:012d}.json"))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, at: dict[str, int]) -> DataFrame | None:
        """The rows of buckets at their versions; only their folders are listed and read."""
        folders = [f"{self.path}/rows/v={v}/bucket={b}" for b, v in sorted(at.items())]
        return self.spark.read.parquet(*folders) if folders else None

    def table(self) -> DataFrame | None:
        """The newest version's rows; None before the first one."""
        n = self.newest()
        return None if n is None else self._rows(self._version(n)["at"])

    def merge(self, batch: DataFrame, n: int) -> bool:
        """Make version ``n`` of the newest one and a batch; False, and nothing is changed, if there is one already.

        As the batch's keys decide about buckets, a batch is read twice, so it is kept for that time.
        """
        before = self.newest()
        if before is not None and before >= n:
            return False
        at = self._version(before)["at"] if before is not None else {}
        others = [c for c in batch.columns if c != self.key]
        last = (F.min_by if self.first else F.max_by)(F.struct(*others), F.struct(self.order, *[c for c in others if c != self.order])).alias("_v")
        held = batch.persist()
        try:
            touched = {str(r[0]) for r in held.select(self._bucket()).distinct().collect()}  # at most ``buckets``
            old = self._rows({b: v for b, v in at.items() if b in touched})
            rows = held if old is None else old.select(*held.columns).unionByName(held)
            merged = rows.groupBy(self.key).agg(last).select(self.key, "_v.*").withColumn("bucket", self._bucket())
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/v={n}")
        finally:
            held.unpersist()
        now = at | {b: n for b in touched}
        try:
            put_if_absent(self.spark, f"{self.path}/versions/{n:012d}.json", json.dumps({"buckets": self.buckets, "at": now}, sort_keys=True))
        except AlreadyThere:
            return False
        self._forget(n)
        return True

    def _forget(self, n: int) -> None:
        """Delete versions before the last KEPT, and rows that none of these refers to."""
        known = sorted(int(x[:-5]) for x in names(self.spark, f"{self.path}/versions") if x.endswith(".json"))
        kept = [v for v in known if v <= n][-KEPT:]
        used = {(v, b) for k in kept for b, v in self._version(k)["at"].items()}
        for folder in names(self.spark, f"{self.path}/rows"):
            v = int(folder.removeprefix("v="))
            if v > n:
                continue
            there = [x.removeprefix("bucket=") for x in names(self.spark, f"{self.path}/rows/{folder}") if x.startswith("bucket=")]
            unused = [b for b in there if (v, b) not in used]
            for b in unused:
                delete(self.spark, f"{self.path}/rows/{folder}/bucket={b}")
            if len(unused) == len(there):
                delete(self.spark, f"{self.path}/rows/{folder}")
        for v in known:
            if v not in kept and v < n:
                delete(self.spark, f"{self.path}/versions/{v:012d}.json")
