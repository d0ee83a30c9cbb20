"""Digest trees, streamed CSV digests and sealing."""

import hashlib
import threading

import pytest
from pyspark.sql import functions as F

from sieveline.plans import provenance as P


def test_rows_never_share_their_text(spark):
    rows = [("a\x1f1b", "c"), ("a", "b\x1f1c"), ("a", None), ("a", ""), ("a", "-"), (None, "a"), ("1:a", "b"), ("", "a"), ("é", "b")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(P.row_text(["x", "y"])).distinct().count() == len(rows)
    digests = {P.table_digest(df.where(df.x.eqNullSafe(F.lit(x)) & df.y.eqNullSafe(F.lit(y)))).first().digest for x, y in rows}
    assert len(digests) == len(rows)


def test_trees_of_equal_tables_are_equal_and_others_lead_to_their_rows(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), F.lit(None).cast("string").alias("none"))
    root = lambda d, **k: P.tree_root(d, "key", **k).first()
    assert root(df) == root(df.repartition(7).orderBy(F.desc("id"))) and root(df).rows == 3000
    assert root(df) != root(df.withColumnRenamed("none", "nil")) and root(df) != root(df.where("id > 0")) and root(df) != root(df.union(df.limit(1)))
    other = df.withColumn("none", F.when(F.col("id") == 20, "x")).where("id <> 40")
    leaves = P.differing_leaves(df, other, "key")
    digest = lambda k: hashlib.sha256(str(k).encode()).hexdigest()[:2]
    assert {r.leaf for r in leaves.collect()} == {digest(20), digest(40)}
    found = {r.id for r in P.rows_of_leaves(df, "key", leaves).collect()}
    assert {20, 40} <= found and len(found) < 60
    assert P.differing_leaves(df, df.repartition(3), "key").count() == 0 and P.rows_of_leaves(df, "key", leaves.limit(0)).count() == 0
    assert root(df.where("false")) is None and root(df, levels=1).rows == 3000


def test_csv_digest_is_that_of_a_frame(spark):
    rows = [(f"k{i:04d}", i if i % 5 else None, i * 0.1 if i % 3 else None, None if i % 7 else 'a "quoted", text\n', i % 2 == 0, i) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, n int, x double, t string, b boolean, m long").repartition(5)
    frame = df.orderBy("key").toPandas().to_csv(index=False, lineterminator="\n")
    assert P.csv_digest(df, "key") == hashlib.sha256(frame.encode()).hexdigest()
    assert P.csv_digest(df.where("false"), "key") == hashlib.sha256(b"key,n,x,t,b,m\n").hexdigest()


def test_a_sealed_folder_stays_as_it_is(spark, tmp_path):
    folder, df = f"file://{tmp_path}/bench", spark.range(3).withColumn("x", F.lit("a"))
    P.prepare(spark, folder, {"pool": df})
    with pytest.raises(FileExistsError, match="pool"):
        P.prepare(spark, folder, {"pool": df})
    P.prepare(spark, folder, {"pool": df, "screen": df}, force=True)
    assert P.sealed(spark, folder) is None
    outcomes = []

    def write(i):
        try:
            P.seal(spark, folder, {"writer": i, "digests": {"config": "1"}})
            outcomes.append(i)
        except P.Sealed:
            pass

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(outcomes) == 1 and P.sealed(spark, folder)["writer"] == outcomes[0]
    for call in (lambda: P.prepare(spark, folder, {"pool": df}, force=True), lambda: P.seal(spark, folder, {"digests": {"config": "1"}}), lambda: P.seal(spark, folder, {"digests": {"config": "2"}}, force=True)):
        with pytest.raises(P.Sealed):
            call()
    P.seal(spark, folder, {"writer": "next", "digests": {"config": "1"}}, force=True)
    assert P.sealed(spark, folder)["writer"] == "next"
