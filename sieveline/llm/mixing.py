"""Mixing sources to target weights by pivotal dependent rounding, in built-in expressions only.

A source's documents are each due target/size copies. The whole part is certain; the fractions are rounded in pairs: two
documents exchange words at random, so that their sum in words and each one's expectation stay, until one of the two
fractions is 0 or 1; the other meets the next document. A block of about ``FAN`` documents is one fold, largest first,
that leaves one document, mostly a small one, with a fraction. These residuals are the next level of the reduction tree.
So a hot source is spread over as many blocks as it needs. Documents far above their source's mean size go first, then
those above it, and the others are due what these leave, so each source misses its target by about one small document.
Random numbers are hashes of what is paired, so reruns agree.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.columns import fresh, quoted
from sieveline.plans.durable import durable
from sieveline.plans.membership import maybe_in

#: Documents in a block, copies of a repeated row that one task makes at once, and from how many means of its source's
#: sizes a document is in the first or the second class that is settled.
FAN, COPIES, LARGE = 128, 4096, (4, 1)
#: Words are runs of other characters than these; the repeating weights; the most copies.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add target to (source, source_size, ...): shares of the total by weight, none above ``most`` times its size.

    Sources count by code point, null last. There may be as many sources as hosts: places come from sorted partitions and
    their sizes, and the level at which uncapped sources meet from rounds of sums, in each of which more sources reach
    their cap, until none is above. The driver gets sums.
    """
    order = F.asc_nulls_last("source")
    parted = durable(sizes.orderBy(order).withColumn("_part", F.spark_partition_id()))
    # a row for each partition
    upto = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy(F.col("_part").alias("_at")).agg(F.count("*").alias("_n")).select("_at", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1 + F.col("_start")
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    df = durable(
        parted.join(F.broadcast(starts), F.col("_part") == F.col("_at")).withColumns({"_w": weight, "_cap": (most * F.col("source_size")).cast("double")})
    )
    total = df.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = level * F.col("_w") > F.col("_cap")
        free, taken, now = df.agg(F.sum(F.when(~over, F.col("_w"))), F.sum(F.when(over, F.col("_cap"))), F.count_if(over)).first()
        if now == capped or not free:
            break
        level, capped = (total - (taken or 0.0)) / free, now
    return df.withColumn("target", F.least("_cap", F.lit(level) * F.col("_w"))).drop("_w", "_cap", "_part", "_at", "_start")


def _chance(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / float(1 << 53)


def _exchange(state: Column, item: Column, level: int, seed: int) -> Column:
    """Pair the pending item with the next one: words move until one of the two fractions is 0 or 1, which is then done."""
    p = state["pending"]
    a, b, x, y = p["size"].cast("double"), item["size"].cast("double"), p["x"], item["x"]
    up, down = F.least(a * (1 - x), b * y), F.least(a * x, b * (1 - y))
    gain = _chance(F.lit(seed), F.lit(level), p["k1"], p["k2"], item["k1"], item["k2"]) * (up + down) < down
    first = F.when(gain, a * (1 - x) <= b * y).otherwise(a * x <= b * (1 - y))  # whose fraction becomes whole
    whole = F.when(gain == first, 1.0).otherwise(0.0)
    inner = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    kept_x = inner(F.when(gain, x + up / a).otherwise(x - down / a))
    kept_y = inner(F.when(gain, y - up / b).otherwise(y + down / b))
    settled = (x == 0) | (x == 1)
    return F.struct(
        F.when(settled, item).when(first, item.withField("x", kept_y)).otherwise(p.withField("x", kept_x)).alias("pending"),
        F.array_append(state["done"], F.when(settled, p).when(first, p.withField("x", whole)).otherwise(item.withField("x", whole))).alias("done"),
    )


def _folder(level: int, seed: int):
    return lambda state, item: _exchange(state, item, level, seed)


def round_fractions(items: DataFrame, most_in_a_source: int, fan: int = FAN, seed: int = 2) -> DataFrame:
    """Round x of (source, in_source, item: struct<size, k1, k2, x, ...>) to 0 or 1; the sum of size*x stays but for the last of each source."""
    fields = items.schema["item"].dataType.simpleString()
    levels = max(1, math.ceil(math.log(max(most_in_a_source, 2), fan) - 1e-9))
    done: list[DataFrame] = []
    for level in range(1, levels + 1):
        blocks = F.ceil(F.col("in_source") / float(fan**level)) if level < levels else F.lit(1).cast("long")
        block = F.pmod(F.xxhash64(F.lit(seed + level), "item.k1", "item.k2"), blocks)
        order = F.struct((-F.col("item.size")).alias("o"), F.col("item.k1").alias("a"), F.col("item.k2").alias("b"), "item")
        grouped = items.groupBy("source", "in_source", block.alias("block")).agg(F.sort_array(F.collect_list(order)).alias("xs"))
        start = F.struct(F.element_at("xs", 1).alias("pending"), F.array().cast(f"array<{fields}>").alias("done"))
        folded = durable(
            grouped.withColumn("xs", F.transform("xs", lambda s: s["item"]))
            .select("source", "in_source", F.aggregate(F.slice("xs", 2, F.size("xs")), start, _folder(level, seed)).alias("s"))
            .select("source", "in_source", "s.pending", "s.done")
        )
        done.append(folded.select("source", F.explode("done").alias("item")))
        items = folded.select("source", "in_source", F.col("pending").alias("item"))
    final = F.when(_chance(F.lit(seed), F.lit(0), "item.k1", "item.k2") < F.col("item.x"), 1.0).otherwise(0.0)
    done.append(items.select("source", F.col("item").withField("x", final).alias("item")))
    return functools.reduce(DataFrame.unionByName, done)


def _keys(id_col: str, text_col: str, source_col: str) -> tuple[Column, Column]:
    """128 bits that stand for a row's id, source and text."""
    parts = [c for name in (id_col, source_col, text_col) for c in (quoted(name), quoted(name).isNull())]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def _repeated(rows: DataFrame, n: str) -> DataFrame:
    """Each row as often as its column ``n`` says; a row with many copies is dealt to tasks that make some of them each."""
    part, i = fresh(rows, "_part", "_i")
    count, last = F.col(n), F.lit(COPIES - 1).cast("long")
    numbers = lambda low, high: F.explode(F.sequence(low.cast("long"), high.cast("long")))
    few = rows.where((count > 0) & (count <= COPIES)).withColumn(i, numbers(F.lit(1), count)).drop(i)
    many = rows.where(count > COPIES).withColumn(part, numbers(F.lit(0), F.floor((count - 1) / COPIES)))
    dealt = many.repartition(F.xxhash64(part, *[quoted(c) for c in rows.columns[:2]]))
    start = F.col(part) * COPIES + 1
    return few.unionByName(dealt.withColumn(i, numbers(start, F.least(start + last, count))).drop(part, i))


def mix_plan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row for each distinct (id, source, text): k1, k2, id, size, m, source_size, target, whole, extra.

    m rows share it; ``extra`` of them get whole + 1 copies and the rest ``whole``. Texts without words have no weight and
    get no copy. Equal rows are counted before anything else moves, so a hot group of them is one row here.
    """
    size = F.coalesce(F.regexp_count(quoted(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    k1, k2 = _keys(id_col, text_col, source_col)
    rows = documents.select(k1.alias("k1"), k2.alias("k2"), quoted(id_col).alias("id"), quoted(source_col).alias("source"), size.alias("size"))
    units = durable(rows.groupBy("source", "k1", "k2", "id", "size").agg(F.count("*").alias("m")))
    n, mass = F.sum("m"), F.sum(F.col("size") * F.col("m"))
    means = F.col("size") * F.col("docs") / F.greatest("source_size", F.lit(1))
    turn = F.when(means > LARGE[0], 0).when(means > LARGE[1], 1).otherwise(2)
    sizes = units.groupBy("source").agg(mass.alias("source_size"), F.count("*").alias("in_source"), n.alias("docs"))
    targets = durable(source_targets(sizes, weights, most))
    most_in_a_source = targets.agg(F.max("in_source")).first()[0] or 0
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    left = durable(_of_source(units, targets.withColumn("due", due)).withColumn("turn", turn))
    done: list[DataFrame] = []
    for k in range(len(LARGE)):
        done.append(durable(_settled(left.where(F.col("turn") == k), most_in_a_source)))
        copies = F.col("m") * F.col("whole") + F.col("extra")
        taken = done[-1].groupBy("source").agg(F.sum(F.col("size") * copies).alias("taken"), mass.alias("mass"))
        rest = left.where(F.col("turn") > k).groupBy("source").agg(F.max("due").alias("due"), mass.alias("rest"))
        owed = F.col("due") * (F.col("rest") + F.coalesce("mass", F.lit(0))) - F.coalesce("taken", F.lit(0))
        share = F.when(F.col("rest") > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), owed / F.col("rest")))).otherwise(0.0)
        shares = durable(_of_source(rest, taken, "left").select("source", share.alias("due")))
        left = durable(_of_source(left.where(F.col("turn") > k).drop("due"), shares))
    return functools.reduce(DataFrame.unionByName, [*done, _settled(left, most_in_a_source)])


def _of_source(rows: DataFrame, of: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their source, which may be null."""
    by = of.withColumnRenamed("source", "_s")
    return rows.join(by, rows["source"].eqNullSafe(by["_s"]), how).drop("_s")


def _settled(parts: DataFrame, most_in_a_source: int) -> DataFrame:
    """Rows due so many copies, with whole and extra: ``extra`` of the m rows get one copy more."""
    due = F.when(F.abs(F.col("due") - F.round("due")) < 1e-12, F.round("due")).otherwise(F.col("due"))
    parts = parts.withColumn("due", due).withColumn("whole", F.when(F.col("size") > 0, F.floor("due")).otherwise(0).cast("long"))
    parts = parts.withColumn("_f", F.when(F.col("size") > 0, F.col("m") * (F.col("due") - F.col("whole"))).otherwise(0.0))
    parts = durable(parts.withColumn("certain", F.floor("_f").cast("long")).withColumn("x", F.col("_f") - F.col("certain")))
    names = ["size", "k1", "k2", "x", "id", "m", "source_size", "target", "whole", "certain"]
    loose = parts.where("x > 0").select("source", "in_source", F.struct(*names).alias("item"))
    rounded = round_fractions(loose, most_in_a_source).select("source", "item.*")
    everything = parts.where("x = 0").select("source", *names).unionByName(rounded)
    return everything.withColumn("extra", F.col("certain") + F.col("x").cast("long")).drop("certain", "x")


def mix_sizes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of ``documents``: id_col, size, source_size, target, taken (size times copies).

    Null and empty texts have size 0; repeated rows have a row each; other columns, whatever their names, are ignored; an
    empty table gives an empty result.
    """
    plan = mix_plan(documents, id_col, text_col, source_col)
    row = lambda n, copies: plan.select("k1", "k2", F.col("id").alias("_id"), "size", "source_size", "target", n.alias("n"), copies.alias("copies"))
    each = _repeated(row(F.col("extra"), F.col("whole") + 1).unionByName(row(F.col("m") - F.col("extra"), F.col("whole"))), "n")
    return each.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``documents`` with each row repeated as often as the mix takes it (0 to ``most`` times), all columns kept.

    A null source is a source of its own; null or empty texts have no weight and are not taken; rows equal in id, source
    and text are counted as one with many copies, and in the order of their other columns some of them get one copy more;
    columns of any name are kept; an empty table gives an empty result.
    """
    names = documents.columns
    k1, k2, p1, p2, m, whole, extra, copies, rows, upto = fresh(documents, "_k1", "_k2", "_p1", "_p2", "_m", "_whole", "_extra", "_copies", "_rows", "_upto")
    plan = mix_plan(documents, id_col, text_col, source_col, weights, most).select(
        F.col("k1").alias(p1), F.col("k2").alias(p2), F.col("m").alias(m), F.col("whole").alias(whole), F.col("extra").alias(extra)
    )
    plan = durable(plan.where(F.col(whole) + F.col(extra) > 0))
    same = (F.col(k1) == F.col(p1)) & (F.col(k2) == F.col(p2))
    one, two = _keys(id_col, text_col, source_col)
    keyed = documents.withColumns({k1: one, k2: two})
    single = keyed.join(plan.where(F.col(m) == 1), same).withColumn(copies, F.col(whole) + F.col(extra))
    out = single.select(*map(quoted, names), F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias(copies)).drop(copies)
    hot = plan.where(F.col(m) > 1)
    if hot.isEmpty():
        return out
    # equal rows meet as counts: partial sums come before the shuffle, after a filter of fixed size by the keys
    kinds = maybe_in(keyed, k1, hot, p1).groupBy(k1, k2, *map(quoted, names)).agg(F.count("*").alias(rows))
    known = kinds.join(hot, same)
    order = Window.partitionBy(k1, k2).orderBy(F.xxhash64(*[quoted(c) for c in names]), *map(quoted, names))
    known = known.withColumn(upto, F.sum(rows).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    more = F.greatest(F.lit(0), F.least(F.col(rows), F.col(extra) - (F.col(upto) - F.col(rows))))
    known = known.withColumn(copies, F.col(rows) * F.col(whole) + more)
    return out.unionByName(_repeated(known.select(k1, k2, *map(quoted, names), copies), copies).select(*map(quoted, names)))
