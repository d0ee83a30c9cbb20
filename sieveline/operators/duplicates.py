"""Exact and near duplicates by content hashes, leakage against a reference set, and groups tied by shared values."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import hash_bits, short_id
from sieveline.operators.components import connected_components
from sieveline.plans.durable import durable
from sieveline.plans.folds import ordered_digests

#: Most bits in which two near hashes may differ; one more band than that, and one of them is equal.
MOST_DISTANCE = 2
#: Comparisons of a band's value from which on its hashes are banded again, and how often that may be. After the last time
#: at most eight bits are left, so no value has more than 256 hashes of a side.
MOST_COMPARISONS, LEVELS = 1 << 20, 5
#: Bits in which the hashes of a band's value differ up to which they meet at the hashes between them instead. So many values
#: are sent to every task rather than shuffled.
MOST_FLIPS, SENT_VALUES = 32, 10_000


def _check(distance: int, least: int = 0) -> None:
    if not least <= distance <= MOST_DISTANCE:
        raise ValueError(f"distance must be between {least} and {MOST_DISTANCE}")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


@functools.cache
def band_tree(levels: int = LEVELS) -> list[list[tuple[int, tuple[int, ...], tuple[int, ...]]]]:
    """For each level and path of bands: the bits that its hashes agree on, the bands of the bits left, and the bands before
    those on the path, in which a pair must differ for its first common path to be this one."""
    bands = MOST_DISTANCE + 1
    nodes, out = [(0, tuple(range(63, -1, -1)), ())], []
    for _ in range(levels + 1):
        row, below = [], []
        for held, left, before in nodes:
            cuts = [round(i * len(left) / bands) for i in range(bands + 1)]
            parts = [left[x:y] for x, y in zip(cuts, cuts[1:])]
            masks = tuple(sum(1 << bit for bit in part) for part in parts)
            row.append((held, masks, before))
            for i, mask in enumerate(masks):
                below.append((held | mask, tuple(bit for j, part in enumerate(parts) if j != i for bit in part), before + masks[:i]))
        out.append(row)
        nodes = below
    return out


def _banded(rows: DataFrame, level: int) -> DataFrame:
    """(hash, x, path) to one row for each band of the path's bits left, with its value (all bits agreed on) as key."""
    tree, bands = band_tree(), MOST_DISTANCE + 1
    children = F.array(*[F.array(*[F.lit(_signed(held | m)) for m in masks]) for held, masks, _ in tree[level]])
    each = rows.select("hash", "x", "path", F.posexplode(F.element_at(children, F.col("path") + 1)).alias("band", "mask"))
    return each.select("hash", "x", (F.col("path") * bands + F.col("band")).alias("path"), F.col("x").bitwiseAND(F.col("mask")).alias("key"))


def _first(apart: Column, level: int) -> Column:
    """Whether a path is the first common one of hashes that differ in these bits, or may be if these are all that differ anywhere."""
    before = F.array(*[F.array(*[F.lit(_signed(m)) for m in masks]).cast("array<long>") for _, _, masks in band_tree()[level + 1]])
    return F.forall(F.element_at(before, F.col("path") + 1), lambda m: apart.bitwiseAND(m) != 0)


def _compared(left: DataFrame, right: DataFrame, level: int, distance: int) -> DataFrame:
    """Pairs within a band's value, each from its first common path only."""
    a, b = (df.select("path", "key", F.col("hash").alias(n), F.col("x").alias(n + "x")) for df, n in ((left, "a"), (right, "b")))
    apart = F.col("ax").bitwiseXOR(F.col("bx"))
    d = F.bit_count(apart)
    return a.join(b, ["path", "key"]).where((d <= distance) & _first(apart, level)).select("a", "b", d.cast("int").alias("distance"))


def _flipped(rows: DataFrame, flips: bool) -> DataFrame:
    """Each hash (its string only where its bits don't tell it) with no bit flipped (-1) and, with ``flips``, with each of ``bits``."""
    bit = F.explode("bits") if flips else F.lit(-1).cast("byte")
    each = rows.select("path", F.when(F.col("hash") != _hash_of("x"), F.col("hash")).alias("odd"), "x", bit.alias("bit"))
    return each.withColumn("mid", F.when(F.col("bit") < 0, F.col("x")).otherwise(F.expr("x ^ shiftleft(1L, bit)")))


def _hash_of(x: str) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def _met_between(left: DataFrame, right: DataFrame, level: int, distance: int) -> DataFrame:
    """Pairs within a band's value whose hashes may differ in ``bits`` only, each from its first common path only.

    Hashes two bits apart meet where the first has the lower of these flipped and the second the higher, hashes one bit apart
    where the first has it flipped; so nothing is compared but what is near, or one hash with itself.
    """
    a, b = (
        _flipped(df, distance >= least).select("path", "mid", F.col("odd").alias(n), F.col("x").alias(n + "x"), F.col("bit").alias(n + "bit")) for df, n, least in ((left, "a", 1), (right, "b", 2))
    )
    apart = F.col("ax").bitwiseXOR(F.col("bx"))
    once = (F.col("bbit") < 0) | ((F.col("abit") >= 0) & (F.col("abit") < F.col("bbit")))
    met = a.join(b, ["path", "mid"]).where(once & _first(apart, level))
    return met.select(F.coalesce("a", _hash_of("ax")).alias("a"), F.coalesce("b", _hash_of("bx")).alias("b"), F.bit_count(apart).cast("int").alias("distance"))


def _hot_values(a: DataFrame, b: DataFrame, level: int, most: int) -> DataFrame:
    """(path, key, bits, productive): values of bands that would take more than ``most`` comparisons, the bits in which their
    hashes differ after a -1, and whether any pair of them can have its first common path here."""
    counted = lambda df, n: df.groupBy("path", "key").agg(F.count("*").alias(n), F.bit_and("x").alias(n + "_and"), F.bit_or("x").alias(n + "_or"))
    hot = counted(a, "n").join(counted(b, "m"), ["path", "key"]).where(F.col("n") * F.col("m") > most)
    apart = F.expr("(n_or | m_or) ^ (n_and & m_and)")
    bits = F.concat(F.array(F.lit(-1)), F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col("apart"), i) == 1)).cast("array<byte>")
    return hot.select("path", "key", apart.alias("apart")).select("path", "key", bits.alias("bits"), _first(F.col("apart"), level).alias("productive"))


def near_hashes(left: DataFrame, right: DataFrame, distance: int = MOST_DISTANCE, most: int = MOST_COMPARISONS) -> DataFrame:
    """(a, b, distance) for hashes (16 hex characters, column hash) of the two tables at most ``distance`` bits apart.

    Both sides are reduced to distinct hashes before they are banded, so a popular hash is one row. The hashes of a band's
    value that would need more than ``most`` comparisons meet at the hashes between them if they differ in few bits in all
    (dense ones, of which banding leaves many together), and else are banded again by the bits left, as near ones differ in
    these only. A pair comes from its first common path of bands only, so nothing needs to be made distinct again.
    """
    _check(distance)
    side = lambda df: df.where("hash <> ''").select("hash").distinct().select("hash", hash_bits(F.col("hash")).alias("x"), F.lit(0).alias("path"))
    a, b = durable(side(left)), durable(side(right))
    found = []
    for level in range(LEVELS):
        a, b = _banded(a, level), _banded(b, level)
        hot = durable(_hot_values(a, b, level, most))
        dense = F.size("bits") <= MOST_FLIPS + 1
        values, flipped, again = hot.agg(F.count("*"), F.count_if(F.col("productive") & dense), F.count_if(F.col("productive") & ~dense)).first()
        if not values:
            found.append(_compared(a, b, level, distance))
            break
        if values <= SENT_VALUES:
            hot = F.broadcast(hot)
        if flipped:
            found.append(_met_between(*(df.join(hot.where("productive").where(dense), ["path", "key"]) for df in (a, b)), level, distance))
        last = level == LEVELS - 1
        apart = hot.where(~F.col("productive") | dense) if last else hot
        found.append(_compared(*(df.join(apart.select("path", "key"), ["path", "key"], "left_anti") for df in (a, b)), level, distance))
        if last or not again:
            break
        left_over = hot.where("productive").where(~dense)
        a, b = (durable(df.join(left_over, ["path", "key"], "left_semi").select("hash", "x", "path")) for df in (a, b))
    return functools.reduce(DataFrame.unionByName, found)


def near_pairs(df: DataFrame, distance: int = MOST_DISTANCE) -> DataFrame:
    """(a, b, distance) for different hashes of one table, a < b."""
    return near_hashes(df, df, distance).where("a < b")


def duplicate_groups(inventory: DataFrame, distance: int = MOST_DISTANCE, sha: str = "sha256", near: str = "dhash", status: str = "status") -> DataFrame:
    """``inventory`` with duplicate_group and duplicate_group_size.

    Rows of status ok are tied by an equal sha or by hashes at most ``distance`` bits apart (-1: by sha only), transitively.
    A group is named after its smallest sha; other rows have a blank group of size 0.
    """
    _check(distance, -1)
    ok = inventory.where(F.col(status) == "ok")
    nodes = ok.select(sha, F.col(near).alias("hash")).distinct()
    if distance < 0:
        groups = nodes.select(F.col(sha).alias("node"), F.col(sha).alias("least")).distinct()
    else:
        heads = nodes.where("hash <> ''").groupBy("hash").agg(F.min(sha).alias("head"))
        members = nodes.join(heads, "hash").select(F.col(sha).alias("src"), F.col("head").alias("dst"))
        a, b = (heads.select(F.col("hash").alias(k), F.col("head").alias(v)) for k, v in (("a", "src"), ("b", "dst")))
        across = near_pairs(nodes, distance).join(a, "a").join(b, "b").select("src", "dst")
        linked = connected_components(members.union(across)).select("node", F.col("component").alias("least"))
        groups = nodes.select(F.col(sha).alias("node")).distinct().join(linked, "node", "left").select("node", F.coalesce("least", "node").alias("least"))
    sizes = ok.groupBy(F.col(sha).alias("node")).agg(F.count("*").alias("c")).join(groups, "node")
    totals = sizes.groupBy("least").agg(F.sum("c").alias("size"))
    named = groups.join(totals, "least").select("node", short_id(F.col("least"), "dup-").alias("g"), "size")
    hit = (F.col(sha) == F.col("node")) & (F.col(status) == "ok")
    return inventory.join(named, hit, "left").select(
        *inventory.columns, F.coalesce("g", F.lit("")).alias("duplicate_group"), F.coalesce("size", F.lit(0)).cast("long").alias("duplicate_group_size")
    )


def representatives(grouped: DataFrame, by: str = "food_class", group: str = "duplicate_group", sha: str = "sha256") -> DataFrame:
    """The first row of each group in the order of class and sha, so a group over several classes goes to the first of them.

    Rows with a blank group, which are those of status other than ok, represent nothing.
    """
    grouped = grouped.where(F.col(group) != "")
    first = Window.partitionBy(group).orderBy(by, sha, *[c for c in grouped.columns if c not in (by, sha, group)])
    return grouped.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def overlap_report(candidates: DataFrame, reference: DataFrame, distance: int = MOST_DISTANCE) -> DataFrame:
    """candidate_id, candidate_sha256, reference_sample_id, match_type, hash_distance: at most one row for each candidate.

    candidates: candidate_id, sha256, hash, status; reference: sample_id, sha256, hash, ord. An equal sha wins (of several
    references the last by ord); else the nearest hash within ``distance``, ties to the first by ord.
    """
    _check(distance)
    ok = candidates.where("status = 'ok'")
    exact = reference.groupBy("sha256").agg(F.max_by("sample_id", "ord").alias("reference_sample_id"))
    hits = ok.join(exact, "sha256").select(
        "candidate_id", F.col("sha256").alias("candidate_sha256"), "reference_sample_id", F.lit("exact_sha256").alias("match_type"), F.lit(0).alias("hash_distance")
    )
    rest = ok.join(exact, "sha256", "left_anti")
    firsts = reference.where("hash <> ''").groupBy("hash").agg(F.min(F.struct("ord", "sample_id")).alias("r"))
    best = near_hashes(rest, reference, distance).join(firsts, F.col("b") == F.col("hash")).groupBy("a").agg(F.min(F.struct("distance", "r")).alias("m"))
    near = rest.join(best, F.col("hash") == F.col("a")).select(
        "candidate_id", F.col("sha256").alias("candidate_sha256"), F.col("m.r.sample_id").alias("reference_sample_id"), F.lit("near_difference_hash").alias("match_type"), F.col("m.distance").alias("hash_distance")
    )
    return hits.unionByName(near)


def quarantine(candidates: DataFrame, report: DataFrame) -> DataFrame:
    """The candidates that aren't in an overlap report."""
    return candidates.join(report.select("candidate_id").distinct(), "candidate_id", "left_anti")


def constraint_components(rows: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """``rows`` with connected_group: rows that share a non-blank value in any of the columns are one group, transitively.

    Values of different columns never meet. A null is no value. The group's name is a hash of its sorted column=value
    tokens, or singleton_row=id for a row without values; it is carried over a group's tokens as they are read in order, so
    no task holds them all.
    """
    tokens = F.array(*[F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(c + "="), F.trim(F.col(c).cast("string")))) for c in columns])
    base = rows.withColumn("_tokens", F.filter(tokens, lambda t: t.isNotNull()))
    each = base.select(F.col(id_col).alias("_id"), F.explode("_tokens").alias("t"))
    edges = base.where("size(_tokens) > 1").select(F.element_at("_tokens", 1).alias("src"), F.explode(F.slice("_tokens", 2, len(columns))).alias("dst"))
    linked = connected_components(edges)
    values = durable(each.select("t").distinct().join(linked, F.col("t") == F.col("node"), "left").select("t", F.coalesce("component", "t").alias("root")))
    names = ordered_digests(values, "root", ["t"], "t", "\n").select("root", F.concat(F.lit("connected-"), F.substring("digest", 1, 16)).alias("g"))
    of = values.join(names, "root").select(F.col("t").alias("_t"), "g")
    joined = base.withColumn("_first", F.try_element_at("_tokens", F.lit(1))).join(of, F.col("_first") == F.col("_t"), "left")
    return joined.select(*rows.columns, F.coalesce("g", F.concat(F.lit("singleton_row="), F.col(id_col).cast("string"))).alias("connected_group"))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by one partial aggregate: no sort, and a hot key is combined before it moves."""
    others = [c for c in df.columns if c not in keys]
    value = F.struct(*others) if others else F.lit(1)
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in others])
