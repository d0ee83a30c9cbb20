"""A filter of fixed size that drops most rows without a partner before a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter; with 2^15 in a row of the table that is broadcast, at most 8 MB whatever the input.
BITS = 1 << 26


def _slot(c: Column) -> tuple[Column, Column]:
    h = F.pmod(F.xxhash64(c), F.lit(BITS))
    return F.shiftright(h, 15), h.bitwiseAND((1 << 15) - 1)


def maybe_in(df: DataFrame, column: str, wanted: DataFrame, wanted_column: str) -> DataFrame:
    """The rows of ``df`` whose value may be among ``wanted``'s: all that are, and by chance some that aren't.

    The broadcast is bounded by BITS; where it fills up, fewer rows are dropped and an exact join after it still holds.
    ``wanted`` should be durable, as it is read here and by that join.
    """
    bucket, place = _slot(F.col(wanted_column))
    maps = wanted.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    bucket, place = _slot(F.col(column))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr(f"shiftleft(1, cast(pmod(xxhash64(`{column}`), {BITS}) & 7 as int))")) != 0
    return df.join(F.broadcast(maps), bucket == F.col("_bucket")).where(hit).drop("_bucket", "_bits")
