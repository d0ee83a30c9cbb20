"""Passing rows through Python with their other columns, whatever these are called."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that a worker turns into Python objects at once.
ROWS = 256
#: Rows that are sent to a worker at once.
BATCH_ROWS = 512


def bound_batches(spark: SparkSession) -> None:
    """Batches to Python of at most BATCH_ROWS, as texts may be long; a session's own smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Give memory that is free in this process back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        return


def tidy(run):
    """``run`` over slices of the batches; what it needed goes back to the machine at the end, as workers live on."""

    def wrapped(batches):
        yield from run(batch.slice(i, ROWS) for batch in batches for i in range(0, batch.num_rows, ROWS))
        release()

    return wrapped


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own, each not one of the frame's in either case."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def map_last(df: DataFrame, last: str, run, added: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` without ``last``, with new columns: ``run`` gets the other columns as c0, c1, ... and ``last`` at the end.

    added: what ``run`` calls a new column, to its final name and type. Columns that have such a name are replaced.
    """
    bound_batches(df.sparkSession)
    final = [name for name, _ in added.values()]
    names = [c for c in df.columns if c != last and c not in final]
    inner = df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)], quoted(last).alias("last"))
    schema = [f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(names)] + [f"{own} {kind}" for own, (_, kind) in added.items()]
    out = inner.mapInArrow(tidy(run), ", ".join(schema))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *[F.col(own).alias(name) for own, (name, _) in added.items()])
