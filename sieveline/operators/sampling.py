"""Class-balanced sampling, sealed splits, shuffles and worklists, by the order of a hash that any engine can repeat."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.plans.durable import durable

SPLITS = (("train", 12), ("validation", 4), ("test", 4))


def draw_order(id_col: str, seed: int) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")), 256)


def _first_of_class(df: DataFrame, by: str, id_col: str, k: int, seed: int, rank: str) -> DataFrame:
    """The k first of each class by the hash. Bounded heaps would do, but rows beyond k leave in the window's own limit."""
    order = Window.partitionBy(by).orderBy(draw_order(id_col, seed), id_col)
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def reserve_pool(df: DataFrame, by: str, id_col: str, k: int = 100, seed: int = 42, strict: bool = False) -> DataFrame:
    """k candidates of each class with candidate_rank from 1; strict fails where a class is too small."""
    pool = _first_of_class(df, by, id_col, k, seed, "candidate_rank")
    if strict and (small := pool.groupBy(by).count().where(F.col("count") < k).orderBy(by).take(1)):
        raise ValueError(f"class {small[0][0]} has {small[0][1]} candidates, {k} are needed")
    return pool


def sealed_split(accepted: DataFrame, by: str, id_col: str, splits: tuple[tuple[str, int], ...] = SPLITS, seed: int = 42, strict: bool = False) -> DataFrame:
    """``accepted`` with split: within each class, the first of a hash order train, then validation, then test."""
    total = sum(n for _, n in splits)
    if strict and (odd := accepted.groupBy(by).count().where(F.col("count") != total).take(1)):
        raise ValueError(f"class {odd[0][0]} has {odd[0][1]} rows, {total} are needed")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(draw_order(id_col, seed), id_col))
    split, upto = F.lit(None).cast("string"), total
    for name, n in reversed(splits):
        split = F.when(F.col("_n") <= upto, name).otherwise(split)
        upto -= n
    first = accepted.withColumn("_n", rank).where(F.col("_n") <= total)  # by rank, so that no task sorts a whole class
    return first.withColumn("split", split).drop("_n")


def sample_and_split(df: DataFrame, by: str, id_col: str, splits: tuple[tuple[str, int], ...] = SPLITS, seed: int = 42) -> DataFrame:
    """A pool of exactly the split's size, sealed at once."""
    return sealed_split(reserve_pool(df, by, id_col, sum(n for _, n in splits), seed), by, id_col, splits, seed + 1).drop("candidate_rank")


def shuffled(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    return df.orderBy(draw_order(id_col, seed), id_col)


def split_pivot(df: DataFrame, by: str, splits: list[str]) -> DataFrame:
    return df.groupBy(by).pivot("split", splits).count().na.fill(0, splits)


def accepted_rows(pool: DataFrame, screen: DataFrame, by: str, id_col: str = "candidate_id") -> DataFrame:
    """Accepted candidates by class and rank."""
    return pool.join(screen.where("decision = 'accept'").select(id_col), id_col, "left_semi").orderBy(by, "candidate_rank")


def worklist_head(screen: DataFrame, by: str, quota: int, preferred: str | None = None, after: int = 0) -> DataFrame:
    """The next candidate to review: the preferred class first, then others in order; classes at quota are left out.

    Within the preferred class the lowest open rank after ``after`` comes first, then the lowest of all.
    """
    open_classes = screen.groupBy(by).agg(F.count_if(F.col("decision") == "accept").alias("_a")).where(F.col("_a") < quota).select(by)
    mine = F.col(by) == preferred if preferred is not None else F.lit(False)
    later = mine & (F.col("candidate_rank") > after)
    return screen.where("decision = ''").join(open_classes, by, "left_semi").orderBy(F.desc(mine), by, F.desc(later), "candidate_rank").limit(1)


def next_pending(items: DataFrame, position: str, current: int, pending: Column) -> DataFrame:
    """The first pending item after ``current``, else the first of all."""
    return items.where(pending).orderBy(F.desc(F.col(position) > current), position).limit(1)


def _cut_points(want: dict[str, float], total: int) -> list[tuple[str, float]]:
    """Upper ends, in rows, of each split's part of ``total`` rows: in proportion to what the splits still want."""
    open_ = {s: max(w, 0.0) for s, w in want.items()}
    whole = sum(open_.values())
    if not whole:
        open_, whole = {s: 1.0 for s in want}, float(len(want))
    upto, out = 0.0, []
    for split, w in open_.items():
        upto += w
        out.append((split, upto * total / whole))
    return out


def _split_at(middle: Column, cuts: list[tuple[str, float]]) -> Column:
    """The split whose part holds the middle of a group's rows; twice the middle, as it stays whole."""
    out = F.lit(cuts[-1][0])
    for split, upto in reversed(cuts[:-1]):
        out = F.when(middle < 2 * upto, split).otherwise(out)
    return out


def grouped_split(df: DataFrame, group: str, labels: str, fractions: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """``df`` with split; a group never crosses splits, and each label is spread by the fractions.

    Iterative stratification (Sechidis et al., 2011) by quotas. A round takes the label with the fewest rows left and all
    groups left that have it, in the order of a hash, and deals them to the splits in proportion to what each still wants of
    that label: a group goes where the middle of its rows falls in the running sum. Groups without labels come last, by
    the rows that a split still wants. All rows with a null group are one group; null labels are none.

    The driver sees counts of labels and of DEALT parts of the hash's range. Groups stay where they are: what a round takes
    follows from the labels of the rounds before it, and running sums are formed within a part.
    """
    fractions = fractions or {"train": 0.70, "validation": 0.15, "test": 0.15}
    each = df.select(F.col(group).alias("_g"), F.coalesce(labels, F.array().cast(df.schema[labels].dataType)).alias("_l"))
    sets = each.select("_g", F.explode_outer("_l").alias("_x")).groupBy("_g").agg(F.array_sort(F.collect_set("_x")).alias("_set"))
    sizes = each.groupBy(F.col("_g").alias("_h")).agg(F.count("*").alias("_n"))
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col("_g").cast("string")), 256)
    joined = sets.join(sizes, F.col("_g").eqNullSafe(F.col("_h"))).select("_g", "_set", "_n", order.alias("_order"))
    groups = durable(joined.withColumn("_part", F.substring("_order", 1, DEALT)))
    every = groups.select(F.explode("_set").alias("x"), "_n").groupBy("x").agg(F.sum("_n").alias("n")).collect()
    left = {r["x"]: r["n"] for r in every}
    total = groups.agg(F.sum("_n")).first()[0] or 0
    want = {s: {x: f * n for x, n in left.items()} for s, f in fractions.items()}
    room = {s: f * total for s, f in fractions.items()}
    within = Window.partitionBy("_part").orderBy("_order", "_g").rowsBetween(Window.unboundedPreceding, 0)
    placed, done = [], []
    while True:
        rare = min(left, key=lambda x: (left[x], x)) if left else None
        mine = groups if rare is None else groups.where(F.array_contains("_set", rare))
        taken = mine.where(~F.arrays_overlap("_set", F.array(*map(F.lit, done)))) if done else mine
        parts = sorted(map(tuple, taken.groupBy("_part").agg(F.sum("_n").alias("n")).collect()))
        begins, upto = {}, 0
        for part, n in parts:
            begins[part], upto = upto, upto + n
        cuts = _cut_points({s: want[s][rare] for s in fractions} if rare is not None else room, upto)
        table = df.sparkSession.createDataFrame([*begins.items()], "_p string, _begin long")
        middle = 2 * (F.col("_begin") + F.sum("_n").over(within)) - F.col("_n")
        dealt = taken.join(F.broadcast(table), F.col("_part") == F.col("_p")).withColumn("split", _split_at(middle, cuts)).select("_g", "_set", "_n", "split")
        placed.append(durable(dealt) if begins else None)
        if rare is None:
            break
        for split, x, n in placed[-1].select("split", F.explode("_set").alias("x"), "_n").groupBy("split", "x").agg(F.sum("_n")).collect():
            want[split][x] -= n
            left[x] -= n
        for split, n in placed[-1].groupBy("split").agg(F.sum("_n")).collect():
            room[split] -= n
        done.append(rare)
        left = {x: n for x, n in left.items() if n > 0}
    rounds = [p.select("_g", "split") for p in placed if p is not None]
    named = functools.reduce(DataFrame.unionByName, rounds) if rounds else groups.select("_g", F.lit(None).cast("string").alias("split"))
    return df.join(named, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


#: Hexadecimal digits of the hash that tell the parts apart in which running sums are formed: 4,096 parts.
DEALT = 3
