"""Rules over tables as violations (rule_order, rule_id, key, detail): all of them, not only the first.

``check`` raises the violation of the lowest order and key, for callers that want a failure.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.ontology import Ontology
from sieveline.functions.text import parse_boolean, tidy
from sieveline.plans.order import numbered

#: Why a candidate may be rejected, and the flags of a sheet.
REASONS = (
    "composite_or_multi_panel",
    "heavy_graphic_overlay",
    "multiple_unrelated_dishes",
    "wrong_food_class",
    "non_food",
    "unreadable_or_low_quality",
    "privacy_or_sensitive_content",
    "other",
)
FLAGS = ("unreadable", "non_food", "no_visible_ontology_label")
SCHEMA = "rule_order int, rule_id string, key string, detail string"


def require_columns(df: DataFrame, *names: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def row_rules(df: DataFrame, key: str, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """Violations of (rule_id, broken, detail) in one pass over the rows."""
    found = [F.when(broken, F.struct(F.lit(i).alias("rule_order"), F.lit(name).alias("rule_id"), F.col(key).cast("string").alias("key"), detail.cast("string").alias("detail"))) for i, (name, broken, detail) in enumerate(rules)]
    return df.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("v")).select("v.*")


def violations(*parts: DataFrame) -> DataFrame:
    """Violations of several checks, orders made to follow on by hundreds."""
    moved = [p.withColumn("rule_order", F.col("rule_order") + 100 * i) for i, p in enumerate(parts)]
    return functools.reduce(DataFrame.unionByName, moved)


def check(found: DataFrame) -> None:
    if first := found.orderBy("rule_order", "key").take(1):
        raise ValueError(f"{first[0]['rule_id']}: {first[0]['key']} ({first[0]['detail']})")


def _named(df: DataFrame, order: int, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(order).alias("rule_order"), F.lit(rule).alias("rule_id"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def same_keys(left: DataFrame, right: DataFrame, key: str, rule: str = "id_set") -> DataFrame:
    """Keys of one table that the other lacks, and keys that repeat in the first."""
    a, b = left.select(key), right.select(key)
    return functools.reduce(
        DataFrame.unionByName,
        [
            _named(a.groupBy(key).count().where("count > 1"), 0, f"{rule}_repeated", F.col(key), F.col("count")),
            _named(b.join(a, key, "left_anti").distinct(), 1, f"{rule}_missing", F.col(key), F.lit("missing")),
            _named(a.join(b, key, "left_anti").distinct(), 2, f"{rule}_unexpected", F.col(key), F.lit("unexpected")),
        ],
    )


def same_values(left: DataFrame, right: DataFrame, key: str, columns: list[str], rule: str = "frozen") -> DataFrame:
    """Keys of both tables whose columns differ as text."""
    r = right.select(F.col(key).alias("_k"), *[F.col(c).cast("string").alias(f"_{c}") for c in columns])
    joined = left.join(r, F.col(key) == F.col("_k"))
    return row_rules(joined, key, [(f"{rule}_{c}", ~F.col(c).cast("string").eqNullSafe(F.col(f"_{c}")), F.col(c)) for c in columns])


def class_inventory(inventory: DataFrame, expected: list[str], by: str = "food_class", status: str = "status") -> DataFrame:
    """Classes expected but not there, or there but not expected."""
    spark = inventory.sparkSession
    want = spark.createDataFrame([(c,) for c in expected], f"`{by}` string")
    return same_keys(inventory.where(F.col(status) == "ok").select(by).distinct(), want, by, "class")


def quality_screen(screen: DataFrame, pool: DataFrame, quota: int, complete: bool = False, by: str = "food_class", id_col: str = "candidate_id", frozen: list[str] | None = None) -> DataFrame:
    """Violations of a screening sheet against its pool."""
    require_columns(screen, id_col, by, "decision", "rejection_reason", "notes")
    decision, reason, notes = tidy(F.col("decision")), tidy(F.col("rejection_reason")), F.trim(F.coalesce("notes", F.lit("")))
    rules = [
        ("decision_domain", ~decision.isin("", "accept", "reject"), decision),
        ("accept_with_reason", (decision == "accept") & (reason != ""), reason),
        ("blank_with_reason", (decision == "") & (reason != ""), reason),
        ("reject_without_reason", (decision == "reject") & (reason == ""), decision),
        ("unknown_reason", (decision == "reject") & (reason != "") & ~reason.isin(*REASONS), reason),
        ("other_without_note", (decision == "reject") & (reason == "other") & (notes == ""), reason),
    ]
    accepted = screen.groupBy(by).agg(F.count_if(decision == "accept").alias("n"))
    over = accepted.where(F.col("n") != quota if complete else F.col("n") > quota)
    parts = [same_keys(screen, pool, id_col), same_values(screen, pool, id_col, frozen or [by, "candidate_rank"]), row_rules(screen, id_col, rules)]
    return violations(*parts, _named(over, 0, "class_quota", F.col(by), F.col("n")))


def sheet_rules(sheet: DataFrame, ontology: Ontology, complete: bool = False, id_col: str = "sample_id") -> DataFrame:
    """Violations of the rows of an annotation or adjudication sheet."""
    visible, uncertain = (ontology.parse_cell(F.col(f"{c}_ingredients")) for c in ("visible", "uncertain"))
    read = sheet.withColumns({"_v": visible, "_u": uncertain} | {f"_{f}": parse_boolean(F.col(f)) for f in FLAGS})
    flags = functools.reduce(lambda a, b: a + b, [F.coalesce(F.col(f"_{f}"), F.lit(False)).cast("int") for f in FLAGS])
    unknown = F.concat(F.col("_v.unknown"), F.col("_u.unknown"))
    both = F.array_intersect("_v.labels", "_u.labels")
    labels = F.size("_v.labels") + F.size("_u.labels")
    bad_flag = functools.reduce(lambda a, b: a | b, [F.col(f"_{f}").isNull() for f in FLAGS])
    rules = [
        ("flag_value", bad_flag, F.concat_ws(",", *FLAGS)),
        ("unknown_labels", F.size(unknown) > 0, F.array_join(unknown, ",")),
        ("visible_uncertain_overlap", F.size(both) > 0, F.array_join(both, ",")),
        ("several_flags", flags > 1, flags),
        ("flag_with_labels", (flags > 0) & (labels > 0), labels),
    ]
    if complete:
        rules.append(("blank_row", (flags == 0) & (labels == 0), labels))
    return row_rules(read, id_col, rules)


def annotation_sheet(sheet: DataFrame, manifest: DataFrame, ontology: Ontology, complete: bool = False, id_col: str = "sample_id") -> DataFrame:
    """Violations of one annotator's sheet against the manifest."""
    require_columns(sheet, id_col, "annotator_id", "visible_ingredients", "uncertain_ingredients", *FLAGS)
    people = sheet.agg(F.count_distinct("annotator_id").alias("n"), F.count("*").alias("rows")).where("n <> 1 and rows > 0")
    return violations(
        same_keys(sheet, manifest, id_col), _named(people, 0, "one_annotator", F.lit("annotator_id"), F.col("n")), sheet_rules(sheet, ontology, complete, id_col)
    )


def metric_inputs(cells: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Cells that aren't binary, scores that aren't in [0, 1], and samples with another number of cells than the rest."""
    p = F.col("p")
    rows = row_rules(cells, sample, [("binary", ~F.coalesce(F.col("y").isin(0, 1), F.lit(False)), F.col("y")), ("score_range", ~F.coalesce(~F.isnan(p) & p.between(0, 1), F.lit(False)), p)])
    sizes = cells.groupBy(sample).count()
    most = sizes.agg(F.max("count").alias("m"))
    return violations(rows, _named(sizes.join(F.broadcast(most), F.col("count") != F.col("m")), 0, "shape", F.col(sample), F.col("count")))  # one row


def integrity(manifest: DataFrame, inventory: DataFrame, path: str = "relative_path", sha: str = "sha256") -> DataFrame:
    """path, problem for files of the manifest that are missing or changed."""
    now = inventory.select(F.col(path).alias("_p"), F.col(sha).alias("_s"))
    joined = manifest.select(path, sha).join(now, F.col(path) == F.col("_p"), "left")
    problem = F.when(F.col("_p").isNull(), "missing").when(F.col(sha) != F.col("_s"), "changed")
    return joined.select(path, problem.alias("problem")).where("problem is not null").distinct()


def split_sizes(manifest: DataFrame, expected: dict[str, int], by: str = "food_class") -> DataFrame:
    """Classes whose splits have other sizes than expected."""
    each = manifest.groupBy(by).agg(*[F.count_if(F.col("split") == s).alias(s) for s in expected])
    return row_rules(each, by, [(f"split_{s}", F.col(s) != n, F.col(s)) for s, n in expected.items()])


def stale_rows(queue: DataFrame, fresh: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of immutable columns, as text, that only one of two queues has."""
    text = lambda df: df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    a, b = text(queue), text(fresh)
    return a.exceptAll(b).withColumn("side", F.lit("old")).unionByName(b.exceptAll(a).withColumn("side", F.lit("new")))


def model_cache(cache: DataFrame, manifest: DataFrame, fixed: list[str], id_col: str = "sample_id", by: str = "food_class") -> DataFrame:
    """Violations of a cache of model outputs: repeated or unknown ids, another class, mixed run settings."""
    extra = _named(cache.join(manifest.select(id_col), id_col, "left_anti"), 0, "unknown_id", F.col(id_col), F.lit("not in manifest"))
    twice = _named(cache.groupBy(id_col).count().where("count > 1"), 0, "repeated_id", F.col(id_col), F.col("count"))
    mixed = [_named(cache.agg(F.count_distinct(c).alias("n")).where("n > 1"), i, f"mixed_{c}", F.lit(c), F.col("n")) for i, c in enumerate(fixed)]
    return violations(twice, extra, same_values(cache, manifest, id_col, [by], "class"), *mixed)


def accepted_candidates(accepted: DataFrame, quota: int, by: str = "food_class", id_col: str = "candidate_id", group: str = "duplicate_group") -> DataFrame:
    """Violations of what a sealed manifest is drawn from: ids repeat, candidates share a group of duplicates, a class hasn't
    exactly ``quota`` candidates. Blank groups are shared like others."""
    require_columns(accepted, by, id_col, group)
    repeated = lambda c, order: _named(accepted.groupBy(c).count().where("count > 1"), order, f"repeated_{c}", F.col(c), F.col("count"))
    sizes = _named(accepted.groupBy(by).count().where(F.col("count") != quota), 2, "class_size", F.col(by), F.col("count"))
    return functools.reduce(DataFrame.unionByName, [repeated(id_col, 0), repeated(group, 1), sizes])


def cache_order(cache: DataFrame, requested: DataFrame, order: str, id_col: str = "sample_id") -> DataFrame:
    """Violations of a complete cache: ids that one of the tables lacks, and ids at another place than requested.

    Both tables have a column ``order``, by which (then by id) their rows follow each other; only the places are compared.
    """
    places = lambda df, n: numbered(df.select(id_col, order), [order, id_col], n).select(F.col(id_col).alias(f"{n}_id"), n)
    both = places(cache, "held").join(places(requested, "asked"), F.col("held_id") == F.col("asked_id"), "full")
    key = F.coalesce("held_id", "asked_id")
    rules = [("missing", F.col("held").isNull(), F.col("asked")), ("unrequested", F.col("asked").isNull(), F.col("held")), ("misplaced", F.col("held") != F.col("asked"), F.concat_ws(" for ", "held", "asked"))]
    return row_rules(both.withColumn("_key", key), "_key", rules)


def no_violations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
