"""Annotation sheets: construction, progress, agreement of two annotators, adjudication and the final labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.ontology import Ontology
from sieveline.functions.text import parse_boolean, tidy
from sieveline.operators.validation import FLAGS, check, same_keys, sheet_rules, violations

CELLS = ("visible_ingredients", "uncertain_ingredients")
IDS = ("sample_id", "relative_path", "food_class", "split")


def new_sheet(manifest: DataFrame, annotator: str) -> DataFrame:
    blank = {c: F.lit("") for c in (*CELLS, "notes")} | {f: F.lit(False) for f in FLAGS}
    return manifest.select(*IDS).withColumn("annotator_id", F.lit(annotator)).withColumns(blank).select(*IDS, "annotator_id", *CELLS, *FLAGS, "notes")


def new_screen(pool: DataFrame) -> DataFrame:
    return pool.select("candidate_id", "candidate_rank", "relative_path", "food_class").withColumns({c: F.lit("") for c in ("decision", "rejection_reason", "notes")})


def normalised(sheet: DataFrame, ontology: Ontology) -> DataFrame:
    """Label cells rewritten in canonical order, flags as booleans."""
    cells = {c: F.array_join(ontology.parse_cell(F.col(c))["labels"], "|") for c in CELLS}
    return sheet.withColumns(cells | {f: F.coalesce(parse_boolean(F.col(f)), F.lit(False)) for f in FLAGS})


def screen_progress(screen: DataFrame, classes: list[str], quota: int, by: str = "food_class") -> DataFrame:
    """by, reviewed, accepted, rejected, needed, remaining, complete for each expected class."""
    d = tidy(F.col("decision"))
    seen = screen.groupBy(by).agg(F.count_if(d != "").alias("r"), F.count_if(d == "accept").alias("a"), F.count_if(d == "reject").alias("x"), F.count("*").alias("n"))
    want = screen.sparkSession.createDataFrame([(c,) for c in classes], f"`{by}` string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = want.join(seen, by, "left").select(by, zero("r").alias("reviewed"), zero("a").alias("accepted"), zero("x").alias("rejected"), (zero("n") - zero("r")).alias("remaining"))
    needed = F.greatest(F.lit(quota) - F.col("accepted"), F.lit(0))
    return out.withColumn("needed", needed).withColumn("complete", F.col("needed") == 0)


def is_complete(ontology: Ontology) -> Column:
    labels = [F.size(ontology.parse_cell(F.col(c))["labels"]) > 0 for c in CELLS]
    flags = [F.coalesce(parse_boolean(F.col(f)), F.lit(False)) for f in FLAGS]
    out = labels[0]
    for c in (*labels[1:], *flags):
        out = out | c
    return out


def annotation_progress(sheet: DataFrame, ontology: Ontology) -> DataFrame:
    """completed, remaining, total."""
    read = sheet.select(is_complete(ontology).alias("_done"))
    return read.agg(F.count_if("_done").alias("completed"), F.count("*").alias("total")).select("completed", (F.col("total") - F.col("completed")).alias("remaining"), "total")


def _pair(a: DataFrame, b: DataFrame, ontology: Ontology, id_col: str) -> DataFrame:
    side = lambda df, s: normalised(df, ontology).select(id_col, *[F.col(c).alias(f"{c}_{s}") for c in (*CELLS, *FLAGS)])
    return side(a, "a").join(side(b, "b"), id_col)


def kappa(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Cohen's kappa of two binary ratings; null where both raters use one value only."""
    n = n11 + n10 + n01 + n00
    chance = ((n11 + n10) * (n11 + n01) + (n01 + n00) * (n10 + n00)) / (n * n)
    one_value = ((n11 == n) | (n00 == n)) & (n10 + n01 == 0)
    return F.when(~one_value & (n > 0), ((n11 + n00) / n - chance) / (1 - chance))


def kappa_per_label(cells: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """label, kappa from cells of (label, a, b) with 0 and 1."""
    n = lambda x, y: F.count_if((F.col(a) == x) & (F.col(b) == y))
    counts = cells.groupBy("label").agg(n(1, 1).alias("n11"), n(1, 0).alias("n10"), n(0, 1).alias("n01"), n(0, 0).alias("n00"))
    return counts.select("label", kappa(*[F.col(c).cast("double") for c in ("n11", "n10", "n01", "n00")]).alias("kappa"))


def agreement(a: DataFrame, b: DataFrame, ontology: Ontology, id_col: str = "sample_id") -> DataFrame:
    """One row: mean Jaccard of visible labels (two empty sets agree), exact sets, share of equal cells, and each flag."""
    pair = _pair(a, b, ontology, id_col)
    sets = [F.filter(F.split(f"visible_ingredients_{s}", r"\|"), lambda x: x != "") for s in "ab"]
    common, union = F.size(F.array_intersect(*sets)), F.size(F.array_union(*sets))
    flags = [F.avg((F.col(f"{f}_a") == F.col(f"{f}_b")).cast("double")).alias(f"{f}_agreement") for f in FLAGS]
    return pair.agg(
        F.count("*").alias("samples"),
        F.avg(F.when(union > 0, common / union).otherwise(1.0)).alias("mean_jaccard"),
        F.avg((union == common).cast("double")).alias("exact_set_agreement"),
        F.avg(1 - (union - common) / len(ontology.ids)).alias("micro_cell_agreement"),
        *flags,
    )


def label_kappas(a: DataFrame, b: DataFrame, ontology: Ontology, id_col: str = "sample_id") -> DataFrame:
    """label, kappa over the visible labels of two sheets."""
    pair = _pair(a, b, ontology, id_col)
    each = F.explode(F.array(*map(F.lit, ontology.ids)))
    has = lambda s: F.array_contains(F.split(f"visible_ingredients_{s}", r"\|"), F.col("label")).cast("int")
    return kappa_per_label(pair.withColumn("label", each).select("label", has("a").alias("a"), has("b").alias("b")))


def adjudication_queue(manifest: DataFrame, a: DataFrame, b: DataFrame, ontology: Ontology) -> DataFrame:
    """Both annotators' cells side by side; resolved cells are filled where all but the notes agree, else left blank."""
    side = lambda df, s: normalised(df, ontology).select("sample_id", *[F.col(c).alias(f"{c}_{s}") for c in (*CELLS, *FLAGS, "notes")])
    pair = manifest.select(*IDS).join(side(a, "a"), "sample_id").join(side(b, "b"), "sample_id")
    same = F.lit(True)
    for c in (*CELLS, *FLAGS):
        same = same & F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    filled = {f"resolved_{c}": F.when(F.col("status") == "agreement", F.col(f"{c}_a")).otherwise("" if c in CELLS else False) for c in (*CELLS, *FLAGS)}
    return pair.withColumn("status", F.when(same, "agreement").otherwise("needs_adjudication")).withColumns(filled).withColumn("resolution_notes", F.lit(""))


def unresolved(queue: DataFrame) -> DataFrame:
    """Disagreements without a note on how they were resolved."""
    return queue.where((F.col("status") == "needs_adjudication") & (F.trim(F.coalesce("resolution_notes", F.lit(""))) == ""))


def finalised(queue: DataFrame, ontology: Ontology) -> DataFrame:
    """The resolved columns under their own names; fails on a disagreement without a note or a row that breaks a sheet's rules."""
    if rows := unresolved(queue).orderBy("sample_id").take(1):
        raise ValueError(f"disagreements are open, first {rows[0]['sample_id']}")
    out = queue.select(*IDS, *[F.col(f"resolved_{c}").alias(c) for c in (*CELLS, *FLAGS)], "resolution_notes")
    check(sheet_rules(out, ontology, complete=True))
    return normalised(out, ontology)


def combined(primary: DataFrame, adjudicated: DataFrame, manifest: DataFrame | None = None, evaluation: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """Training rows of the first annotator and adjudicated evaluation rows, each with its annotation_source.

    Which rows are for evaluation is the manifest's word. Fails unless the two cover its rows, each once. Without a manifest
    the first annotator's sheet stands for it, and adjudicated training rows are left out.
    """
    names = [*IDS, *CELLS, *FLAGS]
    for_evaluation = F.col("split").isin(*evaluation)
    if manifest is None:
        manifest, adjudicated = primary, adjudicated.where(for_evaluation)
    training, held = (manifest.where(c).select("sample_id") for c in (~for_evaluation, for_evaluation))
    first = primary.join(training, "sample_id", "left_semi").select(*names, F.col("notes").alias("resolution_notes"), F.lit("primary_annotator_only").alias("annotation_source"))
    second = adjudicated.select(*names, "resolution_notes", F.lit("double_annotated_adjudicated").alias("annotation_source"))
    check(violations(same_keys(first, training, "sample_id", "training"), same_keys(second, held, "sample_id", "evaluation")))
    return first.unionByName(second)


def evaluable(labels: DataFrame) -> DataFrame:
    return labels.where(~F.col("unreadable") & ~F.col("non_food"))


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last entry of each key in an append-only log."""
    others = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_v")).select(key, "_v.*")
