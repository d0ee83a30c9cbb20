"""Durable tables and their files, with Spark's default configuration."""

import gc
import glob
import time

from pyspark.sql import functions as F

from sieveline.plans import durable as D


def files(spark):
    return set(glob.glob(spark.sparkContext.getCheckpointDir()[5:] + "/rdd-*"))


def collected(spark, done, seconds=30):
    for _ in range(2 * seconds):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        if done():
            return True
        time.sleep(0.5)
    return done()


def test_files_go_with_their_tables(spark):
    D.durable(spark.range(1))
    before = files(spark)
    tables = [D.durable(spark.range(100).withColumn("x", F.col("id") * i)) for i in range(4)]
    assert len(files(spark) - before) == 4
    sums = tables[0].join(tables[3], "id").select(F.sum(tables[3].x - tables[0].x).alias("s"))
    mine = files(spark) - before
    del tables
    assert collected(spark, lambda: len(files(spark) & mine) == 2)  # a plan holds two of them
    assert sums.first().s == 3 * 4950
    del sums
    assert collected(spark, lambda: not files(spark) & mine)


def test_sizes_of_few_tables_are_remembered(spark, monkeypatch):
    monkeypatch.setattr(D, "REMEMBERED", 2)
    tables = [D.durable(spark.range(10)) for _ in range(4)]
    assert len(D._sizes) <= 2 and D.bytes_read(tables[-1]) > 0 and D.bytes_read(tables[0]) == 0
