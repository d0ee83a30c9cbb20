"""Joins that hold what they were asked to hold: how many rows may meet a key, and whether each finds one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.duplicates import repeated_keys


def _unique(df: DataFrame, on: list[str], side: str) -> None:
    if rows := repeated_keys(df.select(*on), *on).take(1):
        raise ValueError(f"a key of the {side} table repeats: {rows[0].asDict()}")


def many_to_one(left: DataFrame, right: DataFrame, on: list[str], covered: bool = False) -> DataFrame:
    """Left join that fails where a key of the right table repeats, and with ``covered`` where a left row finds none."""
    _unique(right, on, "right")
    if covered and (rows := left.join(right.select(*on), on, "left_anti").select(*on).take(1)):
        raise ValueError(f"a row finds no partner: {rows[0].asDict()}")
    return left.join(right, on, "left")


def one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join that fails where a key of either table repeats."""
    _unique(left, on, "left")
    _unique(right, on, "right")
    return left.join(right, on)


def coverage(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """rows, matched: how many left rows have a partner."""
    known = right.select(*on).distinct().withColumn("_hit", F.lit(True))
    return left.join(known, on, "left").agg(F.count("*").alias("rows"), F.count("_hit").alias("matched"))
