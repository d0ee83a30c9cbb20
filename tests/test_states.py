"""Mergeable aggregates, vector sign flips, the grouped split, buckets and keyed states, on skewed and odd rows."""

import json
import math
import os
import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import aggregates as G
from sieveline.functions import text as T
from sieveline.operators import duplicates as D
from sieveline.operators import evaluation as E
from sieveline.operators import inference as I
from sieveline.operators import sampling as S
from sieveline.plans import commit
from sieveline.plans.folds import ordered_digests
from sieveline.plans.order import numbered
from sieveline.streaming import state as W
from sieveline.streaming.store import BucketedStore

RANGE = G.Aggregate(
    ("x",),
    lambda: np.array([math.inf, -math.inf]),
    lambda s, rows: np.array([min(s[0], np.nanmin(rows["x"], initial=math.inf)), max(s[1], np.nanmax(rows["x"], initial=-math.inf))]),
    lambda a, b: np.stack([np.minimum(a[..., 0], b[..., 0]), np.maximum(a[..., 1], b[..., 1])], axis=-1),
    lambda s: s[:, 1] - s[:, 0],
)


def test_user_aggregates_of_skewed_groups(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [("hot" if i % 10 else [None, "", "a:b", "c"][i // 10 % 4], i % 3 if i % 7 else None, float(r.random())) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, h int, x double").repartition(9)
    got = {(v.g, v.h): v.value for v in G.aggregated(df, ["g", "h"], RANGE).collect()}
    want = {k: max(x for g, h, x in rows if (g, h) == k) - min(x for g, h, x in rows if (g, h) == k) for k in {(g, h) for g, h, _ in rows}}
    assert got == pytest.approx(want)
    assert G.aggregated(df, [], RANGE).first().value == pytest.approx(max(x for *_, x in rows) - min(x for *_, x in rows))
    assert G.aggregated(df.where("false"), ["g"], RANGE).count() == 0


def test_tasks_pass_on_states_and_not_rows(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id") % 50).alias("grp"), F.rand(1).alias("x")).repartition(8)
    mean = G.sums(("x",), lambda s: s[:, 1] / s[:, 0])
    partial = df.select("grp", F.to_json(F.struct("grp")).alias("_key"), F.col("x").alias("_v0")).mapInArrow(G._fold(mean, ["grp"]), "grp long, state array<double>")
    assert partial.count() <= 8 * 50
    weights = I.hashed_weights(df, 300)
    held = G.states(df, ["grp"], mean)
    draws = weights.groupBy(F.col("grp").alias("_group")).agg(F.collect_list("iteration").cast("array<long>").alias("iterations"), F.collect_list("weight").alias("weights"))
    moved = held.join(draws, F.col("grp") == F.col("_group")).repartition(3).select("state", "iterations", "weights").mapInArrow(G._draw(mean), "iteration long, state array<double>")
    assert moved.count() <= 3 * 300


def test_draws_merge_states_as_often_as_rows_would_be_repeated(spark):
    r = np.random.default_rng(2)
    rows = [(f"g{i % 7}", float(r.random())) for i in range(100)]
    df = spark.createDataFrame(rows, "grp string, x double").repartition(4)
    weights = I.drawn_weights(spark, [f"g{i}" for i in range(7)], 50, 3)
    got = {v.iteration: v.value for v in G.drawn_values(G.states(df, ["grp"], RANGE), weights, RANGE).collect()}
    want = {}
    for w in weights.collect():
        want.setdefault(w.iteration, []).extend(x for g, x in rows if g == w.grp for _ in range(w.weight))
    assert got == pytest.approx({i: max(x) - min(x) for i, x in want.items()})
    mean = G.sums(("x",), lambda s: s[:, 1] / s[:, 0])
    got = I.bootstrap_aggregate(df, weights, mean).first()
    same = I.bootstrap_custom(df, weights, lambda d: d.x.mean()).first()
    assert (got.ci_lower, got.ci_upper) == pytest.approx((same.ci_lower, same.ci_upper)) and got.estimate == pytest.approx(np.mean([x for _, x in rows]))


def test_drawn_signs_against_a_plain_version(spark):
    r = np.random.default_rng(3)
    d = {f"k{i}": float(r.standard_normal() + 0.3) for i in range(90)} | {None: 0.5}
    df = spark.createDataFrame([(k, v) for k, v in d.items()], "grp string, diff double").repartition(6)
    got = I.sign_flip_test(df, "grp", 1000, seed=9).first()
    flipped = sum(v * I.signs([k or ""], 1000, 9)[0] for k, v in d.items())
    reached = (np.abs(flipped) >= abs(sum(d.values())) - 1e-12 * len(d)).sum()
    assert got.p_value == pytest.approx((reached + 1) / 1001) and got.permutations == 1000
    assert got.method == "group_clustered_monte_carlo_sign_flip" and got.observed == pytest.approx(sum(d.values()) / len(d))
    vectors = df.select(F.coalesce("grp", F.lit("")).alias("key"), F.col("diff").alias("d")).mapInArrow(I._flipped_sums(1000, 9), "state array<double>")
    assert vectors.count() <= 6
    assert abs(I.signs([f"s{i}" for i in range(200)], 1000, 1).mean()) < 0.01


@pytest.mark.parametrize("bad", [None, math.nan, math.inf])
def test_selection_refuses_what_isnt_finite(spark, bad):
    df = spark.createDataFrame([("a", 0.9), ("b", bad)], "name string, m double")
    for chosen in (E.select_model(df, "m", "a"), E.first_best(df, "m", "name")):
        with pytest.raises(Exception, match="m isn't finite"):
            chosen.collect()


def test_numbers_and_digests_of_an_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 2).alias("h")).repartition(7)
    assert all(r.k == r.at for r in numbered(df, ["k"], "at").collect())
    assert numbered(df.where("false"), ["k"], "at").count() == 0
    import hashlib

    got = {r.g: (r.n, r.digest) for r in ordered_digests(df.select(F.when(F.col("k") % 10 > 0, "hot").alias("g"), "k", F.col("k").cast("string").alias("p")), "g", ["k"], "p", "|").collect()}
    digest = lambda ks: (len(ks), hashlib.sha256("|".join(map(str, ks)).encode()).hexdigest())
    assert got == {"hot": digest([k for k in range(5000) if k % 10]), None: digest(list(range(0, 5000, 10)))}


def split_sizes(rows, labels):
    return {s: Counter(x for r in rows if r.split == s for x in (r.labels or ["-"])) for s in labels}


def test_grouped_split_keeps_every_row_and_meets_its_quotas(spark):
    r = np.random.default_rng(4)
    rows = [(i, f"g{i // 3}", [x for x, p in (("a", 0.5), ("b", 0.1), ("c", 0.02)) if r.random() < p] or None) for i in range(6000)]
    rows += [(7000 + i, None, ["a"] if i % 2 else []) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, g string, labels array<string>").repartition(6)
    got = S.grouped_split(df, "g", "labels").collect()
    assert sorted(x.id for x in got) == sorted(x[0] for x in rows) and {x.split for x in got} == {"train", "validation", "test"}
    of = {}
    for x in got:
        assert of.setdefault(x.g, x.split) == x.split
    every, sizes = Counter(x for row in rows for x in (row[2] or ["-"])), split_sizes(got, ("train", "validation", "test"))
    for split, f in (("train", 0.7), ("validation", 0.15), ("test", 0.15)):
        for x, n in every.items():
            assert abs(sizes[split][x] - f * n) <= max(35, 0.02 * n), (split, x)
    again = S.grouped_split(df.repartition(2), "g", "labels").collect()
    assert {x.id: x.split for x in got} == {x.id: x.split for x in again}
    assert S.grouped_split(df.where("false"), "g", "labels").count() == 0


def test_grouped_split_of_one_large_group(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")).alias("g"), F.array(F.lit("a")).alias("labels"))
    got = S.grouped_split(df, "g", "labels").groupBy("g").agg(F.count_distinct("split").alias("s"), F.count("*").alias("n")).collect()
    assert len(got) == 101 and all(x.s == 1 for x in got) and max(x.n for x in got) == 900


def test_hot_bands_are_banded_again(spark):
    r = np.random.default_rng(7)
    low = r.choice(1 << 16, 900, replace=False).astype(np.uint64)
    hot = (np.uint64(0xABCDEF) << np.uint64(40)) | low  # nine tenths agree in 48 bits
    high = r.integers(0, 1 << 63, 100, dtype=np.uint64) * np.uint64(2)
    x = np.concatenate([hot, high, high ^ np.uint64(1 << 63), high ^ np.uint64(5)])
    df = spark.createDataFrame([(f"{v:016x}",) for v in x.tolist()], "hash string")
    apart = np.array([[bin(int(a) ^ int(b)).count("1") for b in x] for a in x])
    want = {(f"{x[i]:016x}", f"{x[j]:016x}", int(apart[i, j])) for i, j in zip(*np.nonzero(apart <= 2))}
    for most in (1 << 20, 100):
        got = [tuple(v) for v in D.near_hashes(df, df, most=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert {tuple(v) for v in D.near_hashes(df, df.limit(50), 1, 10).collect()} <= want


def test_a_hot_bands_comparisons_are_bounded(spark):
    rows = spark.range(50_000).select(F.lpad(F.hex(F.when(F.col("id") % 10 > 0, F.col("id") * 41).otherwise(F.xxhash64("id"))), 16, "0").alias("hash"), F.lit(0).alias("path"))
    banded, compared = rows.withColumn("x", T.hash_bits(F.col("hash"))), 0
    for level in range(D.LEVELS):
        banded = D._banded(banded, level)
        sizes = banded.groupBy("path", "key").agg(F.count("*").alias("n"))
        last = level == D.LEVELS - 1
        compared += sizes.where(F.lit(last) | (F.col("n") * F.col("n") <= 1 << 12)).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
        banded = banded.join(sizes.where(F.col("n") * F.col("n") > 1 << 12), ["path", "key"], "left_semi").select("hash", "x", "path")
    assert compared < 50_000**2 / 20 and all(len(left) == 3 for row in D.band_tree() for _, left, _ in row)


def test_dense_hashes_meet_between_and_are_one_row_a_bit(spark):
    r = np.random.default_rng(17)
    dense = r.choice(1 << 12, 700, replace=False).astype(np.uint64)
    x = np.concatenate([dense, dense[:50] << np.uint64(50), r.integers(0, 1 << 63, 60, dtype=np.uint64)]).tolist()
    names = [f"{v:016X}" if i % 7 == 0 else f"{v:016x}" for i, v in enumerate(x)]
    df = spark.createDataFrame([(n,) for n in names], "hash string")
    some = spark.createDataFrame([(n,) for n in names[::2]], "hash string")
    for most in (1 << 20, 64, 0):
        for distance in (0, 1, 2):
            want = {(a, b, d) for a, v in zip(names, x) for b, w in zip(names[::2], x[::2]) if (d := bin(v ^ w).count("1")) <= distance}
            got = [tuple(v) for v in D.near_hashes(df, some, distance, most).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    sides = D._banded(df.limit(700).select("hash", T.hash_bits(F.col("hash")).alias("x"), F.lit(0).alias("path")), 0)
    hot = D._hot_values(sides, sides, 0, 64).collect()
    assert {(h.path, len(h.bits), h.productive) for h in hot} == {(0, 13, True), (1, 13, False)}  # the second path's pairs all have the first
    met = D._flipped(sides.join(D._hot_values(sides, sides, 0, 64), ["path", "key"]).where("path = 0"), True)
    assert met.count() == 700 * 13 and met.groupBy("mid").count().agg(F.max("count")).first()[0] <= 13


# ---------------------------------------------------------------------------------------------- stores and streams

def test_a_batch_touches_its_buckets_and_a_replay_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    store = BucketedStore(spark, root, "k", "seq", 8)
    feed = lambda rows: spark.createDataFrame(rows, "k long, seq long, v string")
    assert store.table() is None
    assert store.merge(feed([(i, 0, "a") for i in range(100)]), 0)
    held = lambda n: json.loads((tmp_path / "store" / "versions" / f"{n:012d}.json").read_text())["at"]
    before = held(0)
    assert store.merge(feed([(5, 1, "b"), (5, 0, "old"), (6, -1, "late")]), 1)
    touched = [b for b in before if held(1)[b] != before[b]]
    assert 1 <= len(touched) <= 2 and all(held(1)[b] == 1 for b in touched)
    rows = {r.k: r.v for r in store.table().collect()}
    assert rows == {i: "b" if i == 5 else "a" for i in range(100)}
    everything = sorted(os.walk(root))
    assert not store.merge(feed([(5, 9, "again")]), 1) and sorted(os.walk(root)) == everything
    for n in range(2, 6):
        assert store.merge(feed([(i, n, f"v{n}") for i in range(100)]), n)
    assert len(os.listdir(f"{root}/versions")) == 2 and len(os.listdir(f"{root}/rows")) == 2
    assert {r.v for r in BucketedStore(spark, root, "k", "seq", 99).table().collect()} == {"v5"}
    assert store.merge(feed([]), 6) and store.table().count() == 100


def test_one_of_two_writers_wins(spark, tmp_path):
    uri, outcomes = f"file://{tmp_path}/a b/seal.json", []

    def write(i):
        try:
            commit.put_if_absent(spark, uri, f"writer {i} " * 1000)
            outcomes.append(i)
        except commit.AlreadyThere:
            outcomes.append(None)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    winner = [i for i in outcomes if i is not None]
    assert len(winner) == 1 and commit.read_text(spark, uri) == f"writer {winner[0]} " * 1000
    assert commit.names(spark, f"file://{tmp_path}/a b") == ["seal.json"] and commit.names(spark, f"file://{tmp_path}/none") == []


def run(stream, name, checkpoint):
    q = stream.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def test_decisions_have_a_state_by_key(spark, tmp_path):
    src, out = str(tmp_path / "log"), str(tmp_path / "out")
    feed = lambda rows: spark.createDataFrame(rows, "k string, at long, what string").coalesce(1).write.mode("append").parquet(src)
    seen = []

    def step(rows):
        feed(rows)
        log = spark.readStream.schema("k string, at long, what string").parquet(src)
        changes = W.last_decisions(log, "k", "at", "what")
        q = changes.writeStream.foreachBatch(lambda df, n: seen.append({tuple(r) for r in df.collect()})).outputMode("update").option("checkpointLocation", out).trigger(availableNow=True).start()
        q.awaitTermination()

    step([("a", 1, "accept"), ("a", 2, "reject"), ("b", 1, None), ("c", None, "accept"), (None, 1, "x")])
    assert set().union(*seen) == {("a", 2, "reject"), ("b", 1, ""), (None, 1, "x")}
    seen.clear()
    step([("a", 1, "late"), ("a", 2, "reject"), ("b", 5, "accept")])
    assert set().union(*seen) == {("b", 5, "accept")}


def test_work_is_given_out_again_until_it_is_done(spark, tmp_path):
    src, out = str(tmp_path / "work"), str(tmp_path / "out")
    seen = []

    def step(rows):
        timed = spark.createDataFrame(rows, "k string, s long, done boolean").withColumn("ts", F.timestamp_seconds(F.col("s") + 1000))
        timed.coalesce(1).write.mode("append").parquet(src)
        events = spark.readStream.schema(timed.schema).parquet(src)
        queue = W.work_queue(events, "k", "ts", "done", "1 hour", "1 minute")
        q = queue.writeStream.foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).outputMode("update").option("checkpointLocation", out).trigger(availableNow=True).start()
        q.awaitTermination()
        got = sorted(seen)
        seen.clear()
        return got

    assert step([("a", 0, False), ("b", 10, False), ("c", 20, None), ("d", 30, True)]) == [("a", "todo", 1), ("b", "todo", 1), ("c", "todo", 1), ("d", "done", 0)]
    assert step([("a", 100, True), ("a", 100, True), ("b", 110, False), ("d", 110, False)]) == [("a", "done", 1)]
    again = step([("z", 4000, False)])  # b and c have had their hour
    assert again == [("b", "todo", 2), ("c", "todo", 2), ("z", "todo", 1)]
    assert step([("b", 4001, True)]) == [("b", "done", 2)]


def test_stores_of_a_stream_grow_with_its_bytes_and_a_key_takes_few_calls(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace as Stub

    from pyspark.sql.types import LongType

    from sieveline import queries as core

    spark.range(200_000).write.parquet(str(tmp_path / "events.parquet"))
    source = spark.read.parquet(str(tmp_path / "events.parquet"))
    assert core._states(source) == 8
    monkeypatch.setattr(core, "STATE_BYTES", 1 << 14)
    assert core._states(source) > 20
    monkeypatch.setattr(core, "STATE_BYTES", 1 << 13)
    with core._few_states(spark, core._states(source)):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "4"  # the session's own is the most

    calls = []
    kept = lambda name, value=None: lambda *a: calls.append((name, *a)) or value
    queue = W.Queue(100, LongType())
    queue.handle = Stub(registerTimer=kept("timer"))
    queue.items = Stub(get=kept("get", []), put=kept("put"), appendList=kept("append"))
    rows = [{"name": str(k), "key": k, "is_result": k == 7, "ms": 5 + k} for k in range(50)] * 2
    assert len(list(queue.handleInputRows((0,), iter(rows), Stub(getCurrentWatermarkInMs=lambda: 0)))) == 50
    assert [c[0] for c in calls] == ["get", "append", "timer"] and calls[-1] == ("timer", 105)
    items = calls[1][1]
    calls.clear()
    queue.items.get = kept("get", items)
    again = list(queue.handleExpiredTimer((0,), Stub(getCurrentWatermarkInMs=lambda: 120), Stub(getExpiryTimeInMs=lambda: 105)))
    assert sorted((r.key, r.tries) for r in again) == [(k, 2) for k in range(15) if k != 7] and calls[-1] == ("timer", 120)


def test_a_prompt_names_keys_ids_and_rules():
    from sieveline.functions.ontology import Label, Ontology

    food = Ontology((Label("rice", "staple", hint="white grains"), Label("egg", "protein"), Label("tofu", "protein", hint="cubes")))
    assert food.prompt("Look.") == "Look.\nAllowed ids: rice, egg, tofu"
    text = food.prompt("Look.", ("Only what is seen.",), "v2", hints=True)
    assert "  staple: rice (white grains)" in text and "  protein: egg; tofu (cubes)" in text and text.endswith("- Only what is seen.\nVersion: v2")
    assert all(f"  {k}: " in text for k in ("food_name", "visible_ingredients", "uncertain_ingredients", "abstain", "reason"))
