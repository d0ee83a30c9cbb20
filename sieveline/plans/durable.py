"""Cutting lineage in a way that survives the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A durable table has at most so many files for each core, or one for so many bytes read, whichever is more.
WAVES, FILE_BYTES = 2, 16 << 20

#: Bytes of the last durable tables of this driver, by the number of their RDD, and how many are remembered.
_sizes: dict[int, int] = {}
REMEMBERED = 4096
#: From here on a plan's size is Spark's way to say that it doesn't know.
UNKNOWN = 1 << 62


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. On one machine a folder of our own where that is unset; on a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.gettempdir() + "/sieveline-shared"


def bytes_read(df: DataFrame) -> int:
    """Bytes of the files and durable tables that a plan reads; what Spark doesn't know the size of counts as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRDD":
            total += _sizes.get(leaf.rdd().id(), 0)
        else:
            size = int(leaf.stats().sizeInBytes())
            total += size if size < UNKNOWN else 0
    return total


def durable(df: DataFrame, least: int = 1) -> DataFrame:
    """``df`` computed once and written to the shared folder; its files go once the driver's JVM has collected the table.

    They are given to Spark's context cleaner, which by default cleans shuffles but not checkpoints; so a table lives as
    long as a plan reads it, and a lost executor's rows can be read again until then.

    There is a file for each partition, and creating one costs a file system more than a small table's rows do, so small
    tables get few. The number of files, and of tasks, grows with the bytes that the plan reads, so no task does. Where the
    work doesn't go by bytes, ``least`` tasks are left apart.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(spark))
    files = max(WAVES * context.defaultParallelism, -(-bytes_read(df) // FILE_BYTES), least)
    done = df.coalesce(min(files, (1 << 31) - 1)).checkpoint(eager=True)
    kept = done._jdf.queryExecution().analyzed().rdd()
    # A checkpoint carries the constraints of the plan behind it, which multiply over the rounds of a loop until the
    # optimizer takes longer than the job; the same rows without them:
    rows = done._jdf.queryExecution().toRdd()
    out = DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), spark)
    if kept.getCheckpointFile().isDefined():
        if not context._jsc.sc().cleaner().isEmpty():
            context._jsc.sc().cleaner().get().registerRDDCheckpointDataForCleanup(kept, kept.id())
        while len(_sizes) >= REMEMBERED:
            del _sizes[next(iter(_sizes))]
        path = context._jvm.org.apache.hadoop.fs.Path(kept.getCheckpointFile().get())
        _sizes[rows.id()] = path.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return out


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder's URI under the shared folder, not yet created."""
    return f"{shared_root(spark)}/sieveline-{tag}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, uri: str) -> None:
    """Delete a folder by Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
