"""Near duplicates among vectors by an epsilon grid order join on cosine similarity.

A cosine of t or more is a distance of at most eps = sqrt(2 - 2 t) between unit vectors. Unit vectors are turned to the
principal axes of a bounded sample and sorted by the cells of a grid on the leading ones; the turn keeps distances, so it
decides about speed only. Range partitions of that order are its intervals. Every interval has a box over the leading
coordinates and over the norm of all others, and two intervals are provably distant if their boxes are more than eps apart.

Plan: pairs of intervals start at the whole sequence and are replaced by pairs of their ``FAN`` parts, level by level, in
joins that keep what isn't distant. The intervals of the last level have about ``SPAN`` rows each. Neighbouring ones are
tiles of ``TILE_BYTES`` at most, and two tiles meet in one task, which goes through their pairs of intervals: so an interval
is sent once for each tile that it may have links with, not for each interval. For a pair the task goes on in the same way
down to ``LEAF`` rows, counts what is left by matrix products and decides about products near the threshold in double
precision. For a pair of tiles it gives back sums of links and a spanning forest of them, never the links themselves; rows
have numbers there, and their keys stay behind. Equal vectors are one class with a weight, so a popular vector is one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.ann import usable
from sieveline.llm.columns import bound_batches, quoted
from sieveline.operators.components import connected_components
from sieveline.plans.durable import durable

#: Leading coordinates of a box, and of the sort key; cells of the grid in a distance of eps.
BOX, KEY, CELLS = 16, 8, 2
#: Rows of an interval and of a leaf; parts of an interval on the next level; partitions of the order at most.
SPAN, LEAF, FAN, PARTITIONS = 4096, 32, 64, 4096
#: Bytes of vectors in an interval and in a tile, rows and bytes of the sample behind the axes.
SPAN_BYTES, TILE_BYTES, SAMPLE, SAMPLE_BYTES = 16 << 20, 16 << 20, 4096, 32 << 20
#: A row's number is that of its block, shifted by so many bits, and its place there.
PLACE_BITS = 32


def _by_length(values: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, rows) of vectors that lie end to end in ``values``, for each length."""
    start = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        yield dim, at, values[start[at][:, None] + np.arange(dim)]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The components of a column of vectors end to end, and their lengths."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _units(rows: np.ndarray) -> np.ndarray:
    """Rows over their norms, first over their largest component so that no square is lost or infinite."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True, initial=0)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def principal_axes(vectors: list[list[float]]) -> dict[int, np.ndarray]:
    """For each length of the sample's vectors, its leading principal axes as columns."""
    axes = {}
    for dim in {len(v) for v in vectors}:
        x = _units(np.array([v for v in vectors if len(v) == dim], np.float64))
        x = x - x.mean(axis=0)
        axes[dim] = np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :BOX])
    return axes


def _traits(units: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Coordinates for boxes: the length far apart, BOX leading coordinates (or zeros), the norm of all others."""
    n, dim = units.shape
    lead = units @ axes.get(dim, np.eye(dim)[:, :BOX])
    rest = np.sqrt(np.maximum(1 - (lead * lead).sum(axis=1), 0))
    out = np.zeros((n, BOX + 2))
    out[:, 0], out[:, 1 : 1 + lead.shape[1]], out[:, -1] = 4.0 * dim, lead, rest
    return out


def _sort_keys(axes: dict[int, np.ndarray], eps: float):
    """Adds a vector's cell: its length, and the grid's cell along the leading axes."""

    def run(batches):
        for batch in batches:
            cells = np.zeros((batch.num_rows, KEY + 1), np.int32)
            for dim, at, rows in _by_length(*_flat(batch["vector"])):
                cells[at, 0], cells[at, 1:] = dim, np.floor(_traits(_units(rows), axes)[:, 1 : 1 + KEY] / (eps / CELLS))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("key", "copies", "vector")), pa.array([*cells], pa.list_(pa.int32()))], ["key", "copies", "vector", "cell"])

    return run


def _packed(values: np.ndarray) -> bytes:
    """Doubles as bytes, as singles if these have the same values."""
    with np.errstate(over="ignore"):
        single = values.astype(np.float32)
    return (single if (single == values).all() else values).tobytes()


BLOCK = "part long, seq long, keys array<string>, copies array<long>, dims array<long>, data binary, lo array<double>, hi array<double>"


def _blocks(axes: dict[int, np.ndarray], rows: int):
    """The rows of a sorted partition in blocks, each one row: at most twice ``rows``, so that most partitions are one."""

    def made(held: list[pa.RecordBatch], seq: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        values, lengths = _flat(t["vector"].chunk(0))
        traits = np.concatenate([_traits(_units(x), axes) for _, _, x in _by_length(values, lengths)])
        cells = (t["part"][0].as_py(), seq, t["key"].to_pylist(), t["copies"].to_pylist(), lengths, _packed(values), traits.min(axis=0), traits.max(axis=0))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], ["part", "seq", "keys", "copies", "dims", "data", "lo", "hi"])

    def run(batches):
        held, n, seq = [], 0, 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 2 * rows:
                yield made(held, seq)
                held, n, seq = [], 0, seq + 1
        if n:
            yield made(held, seq)

    return run


class Forest:
    """Disjoint sets over 0..n-1, named by their smallest member, for whole arrays of links at once."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            a, b = self.root[x], self.root[y]
            apart = np.flatnonzero(a != b)
            if not len(apart):
                return
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _gaps(a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> np.ndarray:
    """Squared distances between boxes, row by row."""
    gap = np.maximum(np.maximum(a_lo - b_hi, b_lo - a_hi), 0)
    return (gap * gap).sum(axis=1)


def near_leaves(a: np.ndarray, b: np.ndarray, same: bool, eps: float, leaf: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of leaves (runs of ``leaf`` rows of two sorted arrays of traits) that aren't provably distant, and all there are.

    Both sequences are halved together; a pair of halves goes on only if its boxes are near enough.
    """
    depth = max(math.ceil(math.log2(max(len(a), len(b)) / leaf)), 0)
    boxes = []
    for x in (a, b):
        size = leaf
        lo = np.minimum.reduceat(x, np.arange(0, len(x), size))
        hi = np.maximum.reduceat(x, np.arange(0, len(x), size))
        levels = [(lo, hi)]
        for _ in range(depth):
            at = np.arange(0, len(lo), 2)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            levels.append((lo, hi))
        boxes.append(levels)
    i = j = np.zeros(1, np.int64)
    for level in range(depth, -1, -1):
        if level < depth:
            i, j = (np.repeat(2 * i, 4) + np.tile([0, 0, 1, 1], len(i))), (np.repeat(2 * j, 4) + np.tile([0, 1, 0, 1], len(j)))
        (a_lo, a_hi), (b_lo, b_hi) = boxes[0][level], boxes[1][level]
        there = (i < len(a_lo)) & (j < len(b_lo))
        if same:
            there &= i <= j
        i, j = i[there], j[there]
        near = _gaps(a_lo[i], a_hi[i], b_lo[j], b_hi[j]) <= eps * eps * (1 + 1e-9) + 1e-12
        i, j = i[near], j[near]
    na, nb = len(boxes[0][0][0]), len(boxes[1][0][0])
    return i, j, na * (na + 1) // 2 if same else na * nb


def count_links(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray, same: bool, cosine: float, axes: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the rows of b linked to each row of a, of a to each of b, and roots of the linked rows of a followed by b.

    Rows are original vectors of one length in the grid's order. Where both are the ``same``, each pair counts once.
    """
    eps, dim = math.sqrt(max(2 - 2 * cosine, 0)), a.shape[1]
    ua, ub = _units(a), _units(b)
    fa, fb = ua.astype(np.float32), ub.astype(np.float32)
    doubt = 1e-6 + 4e-7 * dim
    to_a, to_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    forest = Forest(len(a) if same else len(a) + len(b))
    base = 0 if same else len(a)
    left, right, _ = near_leaves(_traits(ua, axes), _traits(ub, axes), same, eps, LEAF)
    order = np.argsort(left, kind="stable")
    left, right = left[order], right[order]
    for at, end in zip(*_runs(left)):
        i0 = left[at] * LEAF
        i1 = min(i0 + LEAF, len(a))
        for first, last in zip(*_consecutive(right[at:end])):
            j0, j1 = right[at + first] * LEAF, min((right[at + last - 1] + 1) * LEAF, len(b))
            product = fa[i0:i1] @ fb[j0:j1].T
            if product.max() < cosine - doubt:
                continue
            hit = product >= cosine + doubt
            open_ = (product >= cosine - doubt) & ~hit
            if open_.any():
                x, y = np.nonzero(open_)
                hit[x, y] = (ua[i0 + x] * ub[j0 + y]).sum(axis=1) >= cosine
            if same:
                hit &= np.arange(i0, i1)[:, None] < np.arange(j0, j1)[None, :]
            if not hit.any():
                continue
            to_a[i0:i1] += hit @ wb[j0:j1]
            to_b[j0:j1] += wa[i0:i1] @ hit
            x, y = np.nonzero(hit)
            forest.link(i0 + x, base + j0 + y)
    return to_a, to_b, forest.root


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values."""
    if not len(values):
        return values, values
    edge = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate([[0], edge]), np.concatenate([edge, [len(values)]])


def _consecutive(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _runs(np.sort(values) - np.arange(len(values)))


def _side(rows: dict[str, pa.ChunkedArray], at: list[int]) -> list[tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """For each of a tile's blocks, in order: its box, and for each length vectors, weights and numbers of rows."""
    out = []
    for k in at:
        lengths = rows["dims"][k].values.to_numpy()
        data = rows["data"][k].as_buffer()
        values = np.frombuffer(data, np.float64 if data.size == 8 * lengths.sum() else np.float32)
        copies, block = rows["copies"][k].values.to_numpy(), rows["block"][k].as_py()
        kinds = {dim: (x, copies[i], (block << PLACE_BITS) + i) for dim, i, x in _by_length(values, lengths)}
        out.append((rows["lo"][k].values.to_numpy(), rows["hi"][k].values.to_numpy(), kinds))
    return out


def _compare(cosine: float, axes: dict[int, np.ndarray]):
    schema = pa.schema([("num", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    eps = math.sqrt(max(2 - 2 * cosine, 0))

    def run(table: pa.Table) -> pa.Table:
        columns = {c: table[c] for c in ("dims", "data", "copies", "block", "lo", "hi")}
        side, block = (table[c].to_numpy() for c in ("side", "block"))
        same = table["a"][0] == table["b"][0]
        places = [[k for k in np.argsort(block).tolist() if side[k] == s] for s in (0, 1)]
        left = _side(columns, places[0])
        right = left if same else _side(columns, places[1])
        blocks = left if same else left + right
        first: dict[tuple[int, int], int] = {}  # of a block's rows of a length, among all rows of the two tiles
        n = 0
        for k, (_, _, kinds) in enumerate(blocks):
            for dim, (x, _, _) in kinds.items():
                first[k, dim] = n
                n += len(x)
        links, forest = np.zeros(n, np.int64), Forest(n)
        for i, (a_lo, a_hi, a_kinds) in enumerate(left):
            for j, (b_lo, b_hi, b_kinds) in enumerate(right):
                if same and j < i or _gaps(a_lo[None], a_hi[None], b_lo[None], b_hi[None])[0] > eps * eps * (1 + 1e-9) + 1e-12:
                    continue
                own = same and i == j
                for dim in a_kinds.keys() & b_kinds.keys():
                    (a, wa, _), (b, wb, _) = a_kinds[dim], b_kinds[dim]
                    to_a, to_b, root = count_links(a.astype(np.float64), b.astype(np.float64), wa, wb, own, cosine, axes)
                    at = [first[i, dim] + np.arange(len(a))]
                    links[at[0]] += to_a
                    at.append(first[j if same else len(left) + j, dim] + np.arange(len(b)))
                    links[at[1]] += to_b
                    rows = at[0] if own else np.concatenate(at)
                    linked = np.flatnonzero(root != np.arange(len(root)))
                    forest.link(rows[linked], rows[root[linked]])
        num = np.concatenate([number for _, _, kinds in blocks for _, _, number in kinds.values()])
        at = np.flatnonzero(links)
        return pa.Table.from_arrays([pa.array(num[at]), pa.array(links[at]), pa.array(num[forest.root[at]])], schema=schema)

    return run


def _near(limit: float) -> Column:
    """Whether the boxes a_lo, a_hi and b_lo, b_hi are at most ``limit`` apart."""
    gap = lambda x, y: F.greatest(x - y, F.lit(0.0))
    one = F.zip_with("a_lo", "b_hi", gap)
    other = F.zip_with("b_lo", "a_hi", gap)
    both = F.zip_with(one, other, lambda x, y: x * x + y * y)  # one of them is zero
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x) <= limit * limit * (1 + 1e-9) + 1e-12


def near_intervals(boxes: DataFrame, eps: float, fan: int = FAN) -> DataFrame:
    """(a, b) with a <= b: the intervals (span, lo, hi) whose boxes aren't provably distant, found from the whole sequence down."""
    last = boxes.agg(F.max("span")).first()[0] or 0
    depth = 1
    while last // fan**depth:
        depth += 1
    each = [f(F.col(c)[i]).alias(f"{c}{i}") for c, f in (("lo", F.min), ("hi", F.max)) for i in range(BOX + 2)]
    pack = lambda c: F.array(*[F.col(f"{c}{i}") for i in range(BOX + 2)]).alias(c)
    pairs = None
    for level in range(depth - 1, -1, -1):
        node = F.floor(F.col("span") / F.lit(fan**level)).cast("long")
        at = durable(boxes.groupBy(node.alias("node")).agg(*each).select("node", F.floor(F.col("node") / F.lit(fan)).cast("long").alias("up"), pack("lo"), pack("hi")))
        a = at.select(F.col("up").alias("a_up"), F.col("node").alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
        b = at.select(F.col("up").alias("b_up"), F.col("node").alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
        if pairs is None:
            pairs = at.select(F.col("up").alias("p"), F.col("up").alias("q")).distinct()
        halves = pairs.join(a, F.col("p") == F.col("a_up"))
        pairs = durable(halves.join(b, (F.col("q") == F.col("b_up")) & (F.col("a") <= F.col("b")) & _near(eps)).select(F.col("a").alias("p"), F.col("b").alias("q")))
    return pairs.select(F.col("p").alias("a"), F.col("q").alias("b"))


def tile_spans(spans: int | None, span_bytes: int | None, cores: int) -> int:
    """How many intervals make a tile: as many as TILE_BYTES hold, but so few that each core gets about four pairs of tiles."""
    return max(min(TILE_BYTES // max(span_bytes or 1, 1), (spans or 1) // math.ceil(math.sqrt(8 * cores))), 1)


def met_tiles(pairs: DataFrame, tile: int) -> DataFrame:
    """(a, b, side, span): the intervals that each pair of tiles needs of its first (side 0) and second tile."""
    of = lambda c: F.floor(F.col(c) / F.lit(tile)).cast("long")
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("span")), F.struct(F.lit(1).alias("side"), F.col("b").alias("span")))
    each = pairs.select(of("a").alias("ta"), of("b").alias("tb"), F.explode(ends).alias("m"))
    side = F.when(F.col("ta") == F.col("tb"), 0).otherwise(F.col("m.side"))
    return each.select(F.col("ta").alias("a"), F.col("tb").alias("b"), side.alias("side"), F.col("m.span").alias("span")).distinct()


def linked_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", span: int = SPAN) -> DataFrame:
    """One row for each row of ``vectors``: id_col, n_links, component_id, kept.

    Vectors of one length are linked if their cosine, in double precision, is ``cosine`` (above 0) or more. n_links counts
    the other rows that a row is linked with, component_id is the smallest id reachable by links, its own included, and
    kept marks the row that bears it. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing. Rows with equal vectors are linked, repeated rows included, and rows that repeat an id are rows of their own.
    A null id counts as the largest: component_id is null only where no row of the group has an id, and then the row is
    kept. An empty table gives an empty result; columns other than the two are ignored.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    eps = math.sqrt(max(2 - 2 * cosine, 0))
    rows = vectors.select(quoted(id_col).alias("id"), quoted(vector_col).cast("array<double>").alias("vector"))
    key = F.when(usable(F.col("vector")), F.concat_ws(":", F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector")))
    keyed = rows.withColumn("key", key)
    classes = durable(keyed.where("key is not null").groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("vector").alias("vector")))
    facts = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    n, longest = facts[0], max(facts[1] or 1, 1)
    drawn = classes.orderBy(F.xxhash64(F.lit(13), "key")).limit(max(min(SAMPLE, SAMPLE_BYTES // (8 * longest)), 1)).select("vector").collect()
    axes = principal_axes([r[0] for r in drawn])
    span = max(min(span, SPAN_BYTES // (8 * longest)), LEAF)
    wanted = max(min(math.ceil(n / span), PARTITIONS), 1)
    celled = classes.select("key", "copies", "vector").mapInArrow(_sort_keys(axes, eps), "key string, copies long, vector array<double>, cell array<int>")
    ordered = celled.repartitionByRange(wanted, "cell", "key").sortWithinPartitions("cell", "key").drop("cell").withColumn("part", F.spark_partition_id())
    blocks = durable(ordered.mapInArrow(_blocks(axes, span), BLOCK))
    most = blocks.agg(F.max("part"), F.max("seq")).first()
    parts, each = (most[0] or 0) + 1, (most[1] or 0) + 1
    together = max(parts * span // max(n, 1), 1) if each == 1 else 1  # where there are more partitions than asked for
    block = F.col("part") * each + F.col("seq")
    placed = blocks.withColumn("block", block).withColumn("span", F.floor(block / F.lit(together)).cast("long"))
    tile = tile_spans(*placed.agg(F.max("span") + 1, F.max(F.octet_length("data")) * together).first(), spark.sparkContext.defaultParallelism)
    met = durable(met_tiles(near_intervals(placed.select("span", "lo", "hi"), eps), tile))
    tasks = met.select("a", "b").distinct().count()
    tasks = max(min(tasks, max(8 * spark.sparkContext.defaultParallelism, tasks // 16)), 1)
    held = met.join(placed.drop("part", "seq", "keys"), "span").drop("span").repartition(tasks, "a", "b")
    found = durable(held.groupBy("a", "b").applyInArrow(_compare(cosine, axes), "num long, links long, root long"), tasks)
    groups = connected_components(found.where("num <> root"), "num", "root").withColumnRenamed("node", "num")
    links = found.groupBy("num").agg(F.sum("links").alias("links"))
    numbered = placed.select(F.shiftleft("block", PLACE_BITS).alias("first"), F.posexplode("keys").alias("at", "key")).select("key", (F.col("first") + F.col("at")).alias("num"))
    placed_classes = durable(classes.select("key", "copies", "least").join(numbered, "key"))
    named = durable(
        placed_classes.join(links, "num", "left")
        .join(durable(groups), "num", "left")
        .select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "num").alias("group"))
    )
    least = named.groupBy("group").agg(F.min("least").alias("component"))
    of = durable(named.join(least, "group").select(F.col("key").alias("_key"), "n_links", "component"))
    out = durable(keyed.select("id", "key")).join(of, F.col("key") == F.col("_key"), "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.when(component.isNull(), True).otherwise(F.coalesce(F.col("id") == component, F.lit(False))).alias("kept"),
    )
