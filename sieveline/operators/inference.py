"""Resampling inference from group sums: bootstrap intervals and sign-flip tests, without repeating rows.

Draws are a table (iteration, group, weight). A statistic of a resample is a quotient of weighted sums of group sums, so
an iteration costs as many rows as there are groups, whatever the number of samples.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.operators.aggregates import Aggregate, drawn_values, finished, merged, states
from sieveline.plans.durable import durable
from sieveline.plans.order import numbered

#: Two sums closer than this count as tied.
TIE = 1e-12


def hashed_weights(groups: DataFrame, iterations: int, seed: int = 42, group: str = "grp") -> DataFrame:
    """(iteration, grp, weight): as many draws with replacement as there are groups, from a hash that any engine can repeat."""
    ranked = durable(numbered(groups.select(group).distinct(), [group], "_at"))
    each = ranked.crossJoin(F.broadcast(ranked.agg(F.count("*").alias("_g"))))  # one row
    each = each.select("_at", "_g", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "iteration", "_at")), 1, 8), 16, 10).cast("bigint") % F.col("_g")
    draws = each.select("iteration", drawn.alias("_pick")).groupBy("iteration", "_pick").agg(F.count("*").alias("weight"))
    return draws.join(ranked, F.col("_pick") == F.col("_at")).select("iteration", group, "weight")


def drawn_weights(spark: SparkSession, groups: list, iterations: int, seed: int = 42) -> DataFrame:
    """The same table from numpy's generator, on the driver: groups and iterations are a test's parameters."""
    rng = np.random.default_rng(seed)
    counts = np.stack([np.bincount(rng.integers(0, len(groups), len(groups)), minlength=len(groups)) for _ in range(iterations)])
    at, g = np.nonzero(counts)
    return spark.createDataFrame(pd.DataFrame({"iteration": at, "grp": [groups[i] for i in g], "weight": counts[at, g]}))


#: Statistics as quotients of group sums: name to numerator and denominator.
STATISTICS: dict[str, Callable[[], tuple[Column, Column]]] = {
    "micro_f1": lambda: (2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
    "sample_f1": lambda: (F.col("f1"), F.col("n")),
}


def group_sums(samples: DataFrame, by: list[str], group: str = "grp") -> DataFrame:
    """Sums of tp, fp, fn and f1, and n, of each group of samples (as ``sample_f1`` gives them)."""
    return samples.groupBy(*by, group).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "f1")], F.count("*").alias("n"))


def _quotient(statistic: str, weight: Column | None = None) -> Column:
    a, b = STATISTICS[statistic]()
    w = F.lit(1) if weight is None else weight
    a, b = F.sum(w * a), F.sum(w * b)
    return F.when(b > 0, a / b).otherwise(0.0)


def _interval(values: DataFrame, by: list[str], confidence: float) -> DataFrame:
    tail = (1 - confidence) / 2
    ends = [F.percentile("value", q).alias(n) for n, q in (("ci_lower", tail), ("ci_upper", 1 - tail))]
    return values.groupBy(*by).agg(*ends) if by else values.agg(*ends)


def bootstrap_interval(sums: DataFrame, weights: DataFrame, statistic: str = "micro_f1", by: list[str] = [], confidence: float = 0.95, group: str = "grp") -> DataFrame:
    """by, estimate, ci_lower, ci_upper of a registered statistic; the interval's ends are linear quantiles."""
    values = sums.join(weights, group).groupBy(*by, "iteration").agg(_quotient(statistic, F.col("weight")).alias("value"))
    estimate = sums.groupBy(*by).agg(_quotient(statistic).alias("estimate"))
    interval = _interval(values, by, confidence)
    return estimate.join(interval, by) if by else estimate.crossJoin(interval)


def bootstrap_difference(sums_a: DataFrame, sums_b: DataFrame, weights: DataFrame, statistic: str = "sample_f1", confidence: float = 0.95, group: str = "grp") -> DataFrame:
    """estimate, ci_lower, ci_upper of B minus A on the same draws."""
    value = lambda df, name: df.join(weights, group).groupBy("iteration").agg(_quotient(statistic, F.col("weight")).alias(name))
    values = value(sums_a, "a").join(value(sums_b, "b"), "iteration").select((F.col("b") - F.col("a")).alias("value"))
    whole = sums_a.agg(_quotient(statistic).alias("a")).crossJoin(sums_b.agg(_quotient(statistic).alias("b")))
    return whole.select((F.col("b") - F.col("a")).alias("estimate")).crossJoin(_interval(values, [], confidence))


def bootstrap_aggregate(rows: DataFrame, weights: DataFrame, aggregate: Aggregate, confidence: float = 0.95, group: str = "grp") -> DataFrame:
    """estimate, ci_lower, ci_upper of a user's aggregate over rows, resampled by group.

    Rows become a state of their group where they are; a draw merges states. So a task sees at most a state for each draw
    and partition, whatever the number of rows or their spread over groups.
    """
    held = durable(states(rows, [group], aggregate))
    interval = _interval(drawn_values(held, weights, aggregate, group), [], confidence)
    whole = finished(merged(held.select("state"), [], aggregate), [], aggregate)
    return whole.select(F.col("value").alias("estimate")).crossJoin(interval)  # one row each


def bootstrap_custom(rows: DataFrame, weights: DataFrame, metric: Callable[[pd.DataFrame], float], confidence: float = 0.95, group: str = "grp") -> DataFrame:
    """The interval of any function of a frame of rows; each iteration's rows meet in one task, so for small tables only.

    ``bootstrap_aggregate`` takes functions that can be merged, and rows without bound.
    """
    repeated = rows.join(weights, group).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int")))).drop("_i", "weight")
    value = lambda key, df: pd.DataFrame({"iteration": [key[0]], "value": [float(metric(df.drop(columns="iteration")))]})
    return _interval(repeated.groupBy("iteration").applyInPandas(value, "iteration long, value double"), [], confidence)


#: Sign vectors of groups that a task forms at once, and random bits of one digest.
CHUNK, BITS = 64, 128


def signs(keys: list[str], iterations: int, seed: int) -> np.ndarray:
    """-1 or 1 for each key and iteration: the bits of the MD5 of seed:key:block, 128 iterations a block, highest first."""
    blocks = -(-iterations // BITS)
    digests = b"".join(hashlib.md5(f"{seed}:{k}:{b}".encode()).digest() for k in keys for b in range(blocks))
    bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(len(keys), -1)[:, :iterations]
    return 1 - 2 * bits.astype(np.int8)


def _flipped_sums(iterations: int, seed: int):
    """Each task's sums of its groups' differences under all sign vectors: one vector a task, not a row a group and iteration."""

    def run(batches):
        total, any_rows = np.zeros(iterations), False
        for batch in batches:
            keys, d = batch["key"].to_pylist(), batch["d"].to_numpy(zero_copy_only=False)
            for i in range(0, len(keys), CHUNK):
                total += d[i : i + CHUNK] @ signs(keys[i : i + CHUNK], iterations, seed)
                any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["state"])

    return run


#: Vectors that add up.
SUM = Aggregate((), lambda: np.zeros(0), lambda state, rows: state, np.add, lambda states: states[:, 0])


def sign_flip_test(samples: DataFrame, group: str | None = "grp", iterations: int = 10_000, seed: int = 42, row: str = "sample_id") -> DataFrame:
    """observed, p_value, method, permutations for paired differences (column diff), flipped by group, or without one by
    the key ``row``, so that reruns agree; rows without that column are numbered once.

    All 2^G sign vectors where there are at most ``iterations``, else as many random ones with the usual correction, from
    ``signs``: each task adds up a vector over the iterations, and the vectors are merged in a tree. Sums within TIE of the observed one count as reached, so p doesn't hang on the order of additions.
    """
    spark = samples.sparkSession
    prefix = "group_clustered" if group else "sample_level"
    key = group or row
    if key not in samples.columns:
        samples = durable(samples.withColumn(key, F.monotonically_increasing_id()))
    grouped = samples.groupBy(key)
    sums = grouped.agg(F.sum("diff").alias("d"), F.count("*").alias("n"))
    n_groups = sums.count()
    exact = n_groups < 62 and 2**n_groups <= iterations
    if exact:
        ranked = sums.withColumn("_at", F.row_number().over(Window.orderBy(key)) - 1)  # at most log2(iterations) rows
        flips = spark.range(2**n_groups).withColumnRenamed("id", "iteration")
        sign = F.when(F.expr("shiftright(iteration, _at) & 1") == 1, -1).otherwise(1)
        flipped = flips.crossJoin(F.broadcast(ranked)).groupBy("iteration").agg(F.sum(sign * F.col("d")).alias("s"))
    else:
        pairs = sums.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.coalesce("d", F.lit(0.0)).cast("double").alias("d"))
        vectors = merged(pairs.mapInArrow(_flipped_sums(iterations, seed), "state array<double>"), [], SUM)
        flipped = vectors.select(F.posexplode("state").alias("iteration", "s"))
    observed = sums.agg(F.sum("d").alias("obs"), F.sum("n").alias("rows"))
    reached = F.count_if(F.abs("s") >= F.abs("obs") - TIE * F.col("rows"))
    p = reached / F.count("*") if exact else (reached + 1) / (F.count("*") + 1)
    kind = "exact" if exact else "monte_carlo"
    return flipped.crossJoin(F.broadcast(observed)).groupBy("obs", "rows").agg(p.alias("p_value"), F.count("*").alias("permutations")).select(
        (F.col("obs") / F.col("rows")).alias("observed"), "p_value", F.lit(f"{prefix}_{kind}_sign_flip").alias("method"), "permutations"
    )
