"""Digests of ordered groups of any size, carried over batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fold(separator: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, n = None, None, 0
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, ["g", "n", "digest"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch["g"].type
            code = batch["g"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [len(code)]]).tolist()
            pieces = batch["piece"].cast(pa.binary()).to_pylist()
            for a, b in zip(edges[:-1], edges[1:]):
                group = batch["g"][a].as_py()
                if digest is None or group != now:
                    if digest is not None:
                        done.append((now, n, digest.hexdigest()))
                    now, digest, n = group, hashlib.sha256(), 0
                elif separator:
                    digest.update(separator)
                digest.update(separator.join(pieces[a:b]))
                n += b - a
            if len(done) >= 4096:
                yield out()
        if digest is not None:
            done.append((now, n, digest.hexdigest()))
            yield out()

    return run


def ordered_digests(rows: DataFrame, group: str, order: list[str], piece: str, separator: str = "") -> DataFrame:
    """group, n, digest: the SHA-256 (hex) of each group's pieces (text or bytes, none null) in order, with a separator between.

    A group's rows go to one task, which reads them sorted and keeps a digest's state, so its memory doesn't grow with them.
    """
    inner = rows.select(F.col(group).alias("g"), F.col(piece).alias("piece"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    ordered = inner.repartition("g").sortWithinPartitions("g", *[f"o{i}" for i in range(len(order))]).select("g", "piece")
    kind = inner.schema["g"].dataType.simpleString()
    return ordered.mapInArrow(_fold(separator.encode()), f"g {kind}, n long, digest string").withColumnRenamed("g", group)
