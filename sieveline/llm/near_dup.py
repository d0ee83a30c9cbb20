"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Signature: an initial permutation scatters a text's shingles over ``UNIVERSE`` places; one more permutation, shifted
circularly by k, gives coordinate k. The K shifted values of a place lie side by side in memory, so a signature is the
column-wise minimum of contiguous rows. Bands of coordinates become keys; texts that share a key are candidates.

Plan: texts with equal shingle sets form a class (one partial aggregate), and only classes go on. In each bucket every
class is compared to the smallest one, and the links give components. A second pass looks, in buckets that still hold
several components, at pairs across components that a finer sketch leaves open: 4,096 bits, one for each of as many more
coordinates, that differ in 410 places on average at a similarity of 0.8. A class is held against each other component
that it meets in a bucket once, and a pair of other classes comes from its first common band only.
Where a bucket or a component would take more than ``COMPARISONS``, its classes meet by pieces of the sketch instead.
So a large group of near copies costs a few pairs for each member, texts that merely share a passage drop out before they
are paired, and no link between two texts of a bucket is lost to the star. Links are confirmed on the full sets. Joins
read tables cut by ``durable``, so hot buckets and groups can be split by the adaptive planner.

At the threshold of 0.8, 36 bands of 5 miss a pair with probability 6e-7, and the sketch another with 3e-6; 192 pieces of 21
of its bits, each of which agrees with probability 0.9, miss one with 2e-10.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.columns import bound_batches, fresh, quoted, tidy
from sieveline.llm.wordhash import mix, shingles, word_hashes
from sieveline.operators.components import connected_components
from sieveline.plans.durable import durable
from sieveline.plans.membership import maybe_in

BANDS, ROWS, UNIVERSE_BITS = 36, 5, 22
SKETCH_BITS, GLANCES, SIGMAS = 4096, (256, 1024), 4.5
#: Comparisons by sketch of a bucket or a component, and bits of a piece, three of which are in a word of the sketch.
COMPARISONS, PIECE = 1 << 22, 21
ALIAS = {"key": "", "n": "n", "at": "a", "sketch": "s", "bands": "b"}
_cache: dict[tuple[int, int], np.ndarray] = {}


def _circulant(seed: int, width: int) -> np.ndarray:
    """Row y holds the values of place y under the second permutation and its ``width`` circular shifts."""
    if (seed, width) not in _cache:
        turn = np.random.default_rng(seed).permutation(1 << UNIVERSE_BITS).astype(np.int32)
        _cache[seed, width] = sliding_window_view(np.concatenate([turn, turn[:width]]), width)
    return _cache[seed, width]


def _signature(table: np.ndarray, elements: np.ndarray) -> np.ndarray:
    place = mix(elements + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - UNIVERSE_BITS)
    step = max(1, 400_000 // table.shape[1])
    low = table[place[:step]].min(axis=0)
    for i in range(step, len(place), step):
        low = np.minimum(low, table[place[i : i + step]].min(axis=0))
    return low


def _set_key(elements: np.ndarray) -> bytes:
    """128 bits that stand for a set: two sums of mixed elements."""
    a = mix(elements ^ np.uint64(0xA24BAED4963EE407)).sum(dtype=np.uint64)
    b = mix(elements ^ np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64)
    return np.array([a, b]).astype(">u8").tobytes()


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """(ids, distinct shingle hashes of each text in order) for slices of the batches."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
        for i, j, hashes, ptr in word_hashes(texts):
            yield ids[i:j], [np.unique(shingles(hashes[a:b], size)) for a, b in zip(ptr[:-1], ptr[1:])]


def _signatures(size: int, bands: int, rows: int, seed: int):
    def run(batches):
        table = _circulant(seed, bands * rows)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for ids, sets in _sets(batches, size):
            low = np.array([_signature(table, s) if len(s) else np.zeros(bands * rows, np.int32) for s in sets])
            key = np.broadcast_to(salt, (len(sets), bands)).copy()
            cells = low.reshape(len(sets), bands, rows).astype(np.uint64)
            for r in range(rows):
                key = mix(key * np.uint64(0xD6E8FEB86659FD93) + cells[:, :, r])
            keys = key.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([_set_key(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([keys[i] if len(s) else None for i, s in enumerate(sets)], pa.list_(pa.int64())),
                ],
                ["id", "key", "n", "bands"],
            )
        _cache.clear()  # cheap to make again, and workers live on

    return run


def _full_sets(size: int, seed: int):
    def run(batches):
        table = _circulant(seed + 1, SKETCH_BITS)
        for _, sets in _sets(batches, size):
            sets = [s for s in sets if len(s)]
            bits = [np.packbits((_signature(table, s) & 1).astype(bool)).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_set_key(s) for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                    pa.array(bits, pa.list_(pa.int64())),
                ],
                ["key", "elements", "sketch"],
            )
        _cache.clear()

    return run


def _most_differing(bits: int, percent: int, sigmas: float) -> int:
    """Bits that may differ between sets similar enough, so many standard deviations above the mean."""
    p = (1 - percent / 100) / 2
    return round(bits * p + sigmas * (bits * p * (1 - p)) ** 0.5)


def _differing(bits: int) -> Column:
    words = [F.bit_count(F.col("xs")[i].bitwiseXOR(F.col("ys")[i])) for i in range(bits // 64)]
    return functools.reduce(operator.add, words)


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xs").to_pylist(), batch.column("ys").to_pylist()):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([a, b])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) of classes whose full sets are similar enough. Both tables must be durable."""
    xs, ys = (sets.select(F.col("key").alias(k), F.col("elements").alias(k + "s")) for k in "xy")
    full = pairs.join(xs, "x").join(ys, "y").select("x", "y", "xs", "ys")
    return full.mapInArrow(tidy(_verify(percent)), "x binary, y binary")


def _hot(left: DataFrame, left_by: str, right: DataFrame, right_by: str) -> DataFrame:
    """hot: the values that would take more comparisons than COMPARISONS."""
    a, b = (df.groupBy(F.col(by).alias("hot")).agg(F.count("*").alias(n)) for df, by, n in ((left, left_by, "n"), (right, right_by, "m")))
    return durable(a.join(b, "hot").where(F.col("n") * F.col("m") > COMPARISONS).select("hot"))


def _without(df: DataFrame, by: str, hot: DataFrame) -> DataFrame:
    """A durable table's rows of other values, as a durable table, so that a join on them can be split."""
    return df if hot.isEmpty() else durable(df.join(hot, F.col(by) == F.col("hot"), "left_anti"))


def _by_pieces(left: DataFrame, left_by: str, right: DataFrame, right_by: str, hot: DataFrame) -> DataFrame:
    """Distinct pairs (x, y) of classes that share a hot value and a piece of the sketch at the same place."""
    pieces = F.flatten(F.transform("sketch", lambda w: F.array(*[F.shiftrightunsigned(w, PIECE * k).bitwiseAND((1 << PIECE) - 1) for k in range(3)])))
    cut = lambda df, by, name: df.join(hot, F.col(by) == F.col("hot"), "left_semi").select(F.col(by).alias("by"), F.col("key").alias(name), F.posexplode(pieces).alias("at", "piece"))
    return durable(durable(cut(left, left_by, "x")).join(durable(cut(right, right_by, "y")), ["by", "at", "piece"]).where("x <> y").select("x", "y").distinct())


def near_duplicates(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    seed: int = 7,
) -> DataFrame:
    """One row for each row of ``documents``: id_col, n_shingles, component_id, kept.

    Texts are linked whose sets of distinct ``shingle``-word shingles (A-Z lower-cased) have a Jaccard similarity of
    ``percent`` hundredths or more; component_id is the smallest id reachable. Fewer words than a shingle: the whole
    sequence is the one element. Null or wordless texts: n_shingles 0, linked with nothing, own component. Repeated rows
    share their component; rows that repeat an id with the same text are kept or not together. A null id counts as the
    largest: its component_id is null only where no row of the group has an id, and then the row is kept. An empty table
    gives an empty result; other columns are ignored.
    """
    bound_batches(documents.sparkSession)
    docs = documents.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    seen = durable(
        docs.mapInArrow(tidy(_signatures(shingle, bands, rows, seed)), f"id {kind}, key binary, n long, bands array<long>")
    )
    classes = durable(
        seen.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    )
    placed = classes.select("key", "n", F.explode("bands").alias("band"))
    hubs = durable(
        placed.groupBy("band").agg(F.min("key").alias("hub"), F.count("*").alias("c")).where("c > 1").select("band", "hub")
    )
    members = durable(maybe_in(placed, "band", hubs, "band").join(hubs, "band").select("band", "key", "n", "hub"))
    wanted = durable(members.select("key").distinct())
    ids = durable(classes.select("key", "rep").join(wanted, "key", "left_semi").select(F.col("rep").alias("_id")).distinct())
    near = maybe_in(docs, "id", ids, "_id")
    # an inner join, as the optimizer would push a semi join below the filter; ids are distinct
    texts = near.join(ids, near["id"].eqNullSafe(ids["_id"])).select("id", "text")
    sets = durable(texts.mapInArrow(tidy(_full_sets(shingle, seed)), "key binary, elements binary, sketch array<long>").dropDuplicates(["key"]))
    hub_n = durable(members.where("key = hub").select("band", F.col("n").alias("hub_n")))
    alike = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    star = durable(
        members.join(hub_n, "band")
        .where((F.col("key") != F.col("hub")) & alike(F.col("n"), F.col("hub_n")))
        .select(F.col("hub").alias("x"), F.col("key").alias("y"))
        .distinct()
    )
    links = durable(_linked(star, sets, percent))
    groups = connected_components(links, "x", "y")

    where = durable(
        members.join(groups, F.col("key") == F.col("node"), "left").select(
            "band", "key", "n", "hub", F.coalesce("component", "key").alias("at")
        )
    )
    split = durable(where.groupBy("band").agg(F.min("at").alias("a"), F.max("at").alias("z")).where("a <> z").select("band"))
    mixed = where.join(split, "band")
    heads = durable(mixed.where("key = hub").select("band", F.col("at").alias("head")))
    mixed = durable(mixed.join(heads, "band"))
    minor = durable(mixed.where("at <> head").select("band", "key", "at", "head"))
    placed_at = mixed.select("key", "n", "at").distinct()
    traits = durable(mixed.select("key", "n", "at").distinct().join(sets.select("key", "sketch"), "key"))
    sided = lambda df, side: df.select(*[F.col(c).alias(side + b) if c in ALIAS else F.col(c) for c in df.columns for b in [ALIAS.get(c, c)]])
    near = alike(F.col("xn"), F.col("yn"))
    for bits in (*GLANCES, SKETCH_BITS):
        near = near & (_differing(bits) <= _most_differing(bits, percent, SIGMAS if bits == SKETCH_BITS else 7))
    asking = durable(minor.select("key", "head").distinct().join(traits, "key"))
    hot_heads = _hot(asking, "head", traits, "at")
    asks = sided(_without(asking, "head", hot_heads), "x")
    to_heads = asks.join(sided(traits, "y"), (F.col("head") == F.col("ya")) & near).select("x", "y")
    placed_minor = durable(minor.select("band", "key").join(traits, "key").join(classes.select("key", "bands"), "key"))
    hot_bands = _hot(placed_minor, "band", placed_minor, "band")
    cold = _without(placed_minor, "band", hot_bands)
    first = F.element_at(F.array_intersect("xb", "yb"), 1) == F.col("band")
    p, q = sided(cold, "x"), sided(cold, "y").withColumnRenamed("band", "_band")
    between = p.join(q, (F.col("band") == F.col("_band")) & (F.col("x") < F.col("y")) & (F.col("xa") != F.col("ya")) & near & first)
    found = to_heads.union(between.select("x", "y"))
    # a pair whose first common band is hot is found there, or missed by the others' rule; so pieces look at all of its pairs
    for left, by, right, right_by, hot in ((asking, "head", traits, "at", hot_heads), (placed_minor, "band", placed_minor, "band", hot_bands)):
        if not hot.isEmpty():
            pairs = _by_pieces(left, by, right, right_by, hot).join(sided(traits, "x"), "x").join(sided(traits, "y"), "y")
            found = found.union(pairs.where((F.col("xa") != F.col("ya")) & near).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))
    across = durable(found.distinct())
    more = durable(_linked(across, sets, percent))
    groups = durable(connected_components(links.unionByName(more), "x", "y"))

    rooted = durable(
        classes.select("key", "rep").join(groups, F.col("key") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "key").alias("root"))
    )
    least = durable(rooted.groupBy("root").agg(F.min("rep").alias("least")))
    named = durable(rooted.join(least, "root").select(F.col("key").alias("_key"), "least"))
    return (
        seen.select("id", "key", "n")
        .join(named, F.col("key") == F.col("_key"), "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"),
        )
        .withColumn("kept", F.when(F.col("component_id").isNull(), True).otherwise(F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))))
    )


def one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``documents``, one for each group of near duplicates: the smallest by id (null the largest) and text hash.

    Of rows that repeat both, one. Null or wordless texts are in no group, so all of them stay.
    """
    own, kept_row, n, repeat = fresh(documents, "_row", "_kept", "_n", "_repeat")
    row = F.struct(quoted(id_col).isNull().alias("none"), quoted(id_col).alias("id"), F.xxhash64(quoted(text_col)).alias("hash"))
    docs = documents.withColumn(own, row)
    kept = near_duplicates(docs, own, text_col, **options).where("kept").groupBy(F.col(own).alias(kept_row)).agg(F.max("n_shingles").alias(n))
    nth = F.row_number().over(Window.partitionBy(own).orderBy(kept_row))  # by the join's own key: no more shuffles
    found = docs.join(kept, F.col(own) == F.col(kept_row)).withColumn(repeat, nth).where((F.col(repeat) == 1) | (F.col(n) == 0))
    return found.select(*map(quoted, documents.columns))
