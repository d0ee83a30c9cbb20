"""Aggregates of a user's own as mergeable states: rows meet a state in their own task, and only states move.

A state is a vector of doubles. Every partition folds its rows into one state a group; partial states are merged in a tree
(first by a salt, then by group), so no task sees more than a state for each partition, however large a group is. A
bootstrap merges the groups' states as often as a draw takes each group, again first within partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Doubles in the states that a task holds before it passes them on, and merging tasks for one group's partial states.
HELD, TREE = 1 << 22, 64


@dataclass(frozen=True)
class Aggregate:
    """What to do with rows.

    columns: the numeric columns that ``update`` gets, as arrays by name; a null is NaN
    init:    the state of no rows
    update:  a state and arrays of a batch of one group's rows to the next state
    merge:   two arrays of states along the last axis to their union's states; must be associative and commutative
    finish:  an array of states to an array of values, one for each state
    """

    columns: tuple[str, ...]
    init: Callable[[], np.ndarray]
    update: Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], np.ndarray]


def sums(columns: tuple[str, ...], finish: Callable[[np.ndarray], np.ndarray]) -> Aggregate:
    """The aggregate whose state is the rows' count and the columns' sums."""

    def update(state: np.ndarray, rows: dict[str, np.ndarray]) -> np.ndarray:
        return state + np.array([len(rows[columns[0]]), *(rows[c].sum() for c in columns)])

    return Aggregate(columns, lambda: np.zeros(1 + len(columns)), update, np.add, finish)


def _one(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _states(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return _one(column).flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _as_lists(states: np.ndarray) -> pa.Array:
    width = states.shape[1] if states.ndim == 2 else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(len(states) + 1) * width, pa.int32()), pa.array(states.ravel(), pa.float64()))


def _fold(aggregate: Aggregate, keys: list[str]):
    """Rows to one state for each of their groups in the task; the groups' columns are taken from their first rows."""
    names = [*keys, "state"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[pa.RecordBatch, np.ndarray]] = {}

        def out() -> pa.RecordBatch:
            states = _as_lists(np.array([s for _, s in held.values()], np.float64))
            columns = [pa.concat_arrays([f[k] for f, _ in held.values()]) for k in keys]
            held.clear()
            return pa.RecordBatch.from_arrays([*columns, states], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch["_key"].dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            edges = np.concatenate([[0], np.flatnonzero(np.diff(code[order])) + 1, [len(order)]])
            values = {c: batch[f"_v{i}"].to_numpy(zero_copy_only=False) for i, c in enumerate(aggregate.columns)}
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                rows = order[a:b]
                name = coded.dictionary[int(code[rows[0]])].as_py()
                first, state = held.get(name) or (batch.select(keys).slice(int(rows[0]), 1), aggregate.init())
                held[name] = first, aggregate.update(state, {c: v[rows] for c, v in values.items()})
            if len(held) * max(len(next(iter(held.values()))[1]), 1) >= HELD:
                yield out()
        if held:
            yield out()

    return run


def _merge(aggregate: Aggregate, keys: list[str]):
    def run(table: pa.Table) -> pa.Table:
        states = _states(table["state"])
        while len(states) > 1:
            half = len(states) // 2
            states = np.concatenate([aggregate.merge(states[:half], states[half : 2 * half]), states[2 * half :]])
        return pa.Table.from_arrays([*(table[k].slice(0, 1) for k in keys), _as_lists(states)], [*keys, "state"])

    return run


def _schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "state array<double>"])


def merged(partial: DataFrame, by: list[str], aggregate: Aggregate) -> DataFrame:
    """by, state: one state for each group of partial ones (by, state)."""
    schema = _schema(partial, by)
    salted = partial.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(TREE)))
    near = salted.groupBy(*by, "_salt").applyInArrow(_merge(aggregate, by), schema)
    return near.groupBy(*by).applyInArrow(_merge(aggregate, by), schema)


def states(rows: DataFrame, by: list[str], aggregate: Aggregate) -> DataFrame:
    """by, state for each group of rows; nulls of ``by`` are a group. No rows give no state, not even without ``by``."""
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    values = [F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(aggregate.columns)]
    inner = rows.select(*by, key.alias("_key"), *values)
    return merged(inner.mapInArrow(_fold(aggregate, by), _schema(rows, by)), by, aggregate)


def _finish(aggregate: Aggregate, keys: list[str]):
    def run(batches):
        for batch in batches:
            values = aggregate.finish(_states(batch["state"])) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), pa.array(np.asarray(values, np.float64))], [*keys, "value"])

    return run


def finished(held: DataFrame, by: list[str], aggregate: Aggregate) -> DataFrame:
    """by, value of states (by, state)."""
    return held.select(*by, "state").mapInArrow(_finish(aggregate, by), _schema(held, by).replace("state array<double>", "value double"))


def aggregated(rows: DataFrame, by: list[str], aggregate: Aggregate) -> DataFrame:
    """by, value: a user's aggregate of each group of rows."""
    return finished(states(rows, by, aggregate), by, aggregate)


def _draw(aggregate: Aggregate):
    """Groups' states and draws to one state for each iteration in the task: a group drawn w times is merged w times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = np.zeros((0, 0)), np.zeros(0, bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.cumsum(batch["iterations"].value_lengths().to_numpy(zero_copy_only=False))
            at, weight = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("iterations", "weights"))
            own = _states(batch["state"])
            if int(at.max(initial=-1)) >= len(seen):
                more = int(at.max()) + 1 - len(seen)
                fresh = np.tile(aggregate.init(), (more, 1))
                held = np.concatenate([held, fresh]) if len(seen) else fresh
                seen = np.concatenate([seen, np.zeros(more, bool)])
            for state, a, b in zip(own, np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
                i, w = at[a:b], weight[a:b]
                seen[i[w > 0]] = True
                for k in range(1, int(w.max(initial=0)) + 1):
                    hit = i[w >= k]
                    held[hit] = aggregate.merge(held[hit], np.broadcast_to(state, (len(hit), len(state))))
        at = np.flatnonzero(seen)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), _as_lists(held[at])], ["iteration", "state"])

    return run


def drawn_values(held: DataFrame, weights: DataFrame, aggregate: Aggregate, group: str = "grp") -> DataFrame:
    """iteration, value of the resample that takes each group's rows as often as (iteration, group, weight) says.

    held: group, state; one row a group, as ``states`` gives them. Iterations count from 0. Nothing is repeated but merges
    of states; what moves is a state for each iteration and task.
    """
    draws = weights.groupBy(F.col(group).alias("_group")).agg(F.collect_list(F.struct("iteration", "weight")).alias("d"))
    draws = draws.select("_group", F.transform("d", lambda x: x["iteration"].cast("long")).alias("iterations"), F.transform("d", lambda x: x["weight"].cast("long")).alias("weights"))
    joined = held.join(draws, F.col(group).eqNullSafe(F.col("_group"))).select("state", "iterations", "weights")
    partial = joined.mapInArrow(_draw(aggregate), "iteration long, state array<double>")
    return finished(merged(partial, ["iteration"], aggregate), ["iteration"], aggregate)
