"""Multi-label metrics over long tables of (sample, label, y, p), in a few aggregates whatever the number of labels.

y is 0 or 1, p a score in [0, 1]. A quotient of nothing by nothing is 0, but a sample without true and predicted labels
has an F1 of 1. Average precision steps over distinct scores, so tied scores count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Score ranges whose running totals are formed apart, so that no task needs all scores of a label.
RANGES = 4096


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def predicted(cells: DataFrame, threshold: float | Column) -> DataFrame:
    """Add yhat and the cell's tp, fp and fn."""
    yhat = (F.col("p") >= threshold).cast("int")
    return cells.withColumn("yhat", yhat).withColumns(
        {"tp": F.col("y") * F.col("yhat"), "fp": (1 - F.col("y")) * F.col("yhat"), "fn": F.col("y") * (1 - F.col("yhat"))}
    )


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]


def sample_f1(cells: DataFrame, threshold: float | Column, by: list[str], sample: str = "sample_id") -> DataFrame:
    """by, sample, tp, fp, fn, f1 for each sample."""
    each = predicted(cells, threshold).groupBy(*by, sample).agg(*_sums())
    total = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return each.withColumn("f1", F.when(total > 0, 2 * F.col("tp") / total).otherwise(1.0))


def per_label_metrics(cells: DataFrame, threshold: float | Column, by: list[str] = []) -> DataFrame:
    """support, predicted_positive, precision, recall and f1 of each label."""
    each = predicted(cells, threshold).groupBy(*by, "label").agg(*_sums())
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return each.select(
        *by,
        "label",
        (tp + fn).alias("support"),
        (tp + fp).alias("predicted_positive"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def average_precision(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, ap: the sum over distinct scores of the rise in recall times the precision; 0 without positives."""
    spot = F.least(F.floor(F.col("p") * RANGES), F.lit(RANGES - 1))
    steps = cells.groupBy(*by, spot.alias("_r"), "p").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    ranges = steps.groupBy(*by, "_r").agg(F.sum("pos").alias("_pos"), F.sum("n").alias("_n"))
    above = Window.partitionBy(*by).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    ranges = ranges.select(*by, "_r", zero("_pos").alias("_pos0"), zero("_n").alias("_n0"))
    down = Window.partitionBy(*by, "_r").orderBy(F.desc("p"))
    both = [*by, "_r"]
    run = steps.join(ranges, both).withColumns({"_tp": F.col("_pos0") + F.sum("pos").over(down), "_all": F.col("_n0") + F.sum("n").over(down)})
    gained = F.sum(F.col("pos") * (F.col("_tp") / F.col("_all")))
    return run.groupBy(*by).agg(ratio(gained, F.sum("pos")).alias("ap"), F.sum("pos").alias("positives"))


def precision_at_k(cells: DataFrame, k: int, by: list[str] = [], sample: str = "sample_id") -> DataFrame:
    """Mean share of true labels among each sample's k highest; ties by idx, k at most the number of labels."""
    rank = F.row_number().over(Window.partitionBy(*by, sample).orderBy(F.desc("p"), "idx"))
    each = cells.withColumn("_k", rank).groupBy(*by, sample).agg(F.sum(F.when(F.col("_k") <= k, F.col("y")).otherwise(0)).alias("hit"), F.count("*").alias("labels"))
    return each.groupBy(*by).agg(F.avg(F.col("hit") / F.least(F.lit(k), "labels")).alias("precision_at_k"))


def multilabel_metrics(cells: DataFrame, threshold: float | Column, by: list[str] = [], sample: str = "sample_id") -> DataFrame:
    """One row for each value of ``by``: sizes, micro precision, recall and F1, macro F1 over labels with support, sample F1 and exact match."""
    labels = per_label_metrics(cells, threshold, by)
    has = F.col("support") > 0
    macro = labels.groupBy(*by).agg(
        F.count("*").alias("labels"), F.count_if(has).alias("labels_with_test_support"), F.coalesce(F.avg(F.when(has, F.col("f1"))), F.lit(0.0)).alias("macro_f1_supported")
    )
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    micro = (
        sample_f1(cells, threshold, by, sample)
        .groupBy(*by)
        .agg(
            F.count("*").alias("samples"),
            ratio(tp, tp + fp).alias("micro_precision"),
            ratio(tp, tp + fn).alias("micro_recall"),
            ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"),
            F.avg("f1").alias("sample_f1"),
            F.avg((F.col("fp") + F.col("fn") == 0).cast("double")).alias("exact_match"),
        )
    )
    return micro.join(macro, by) if by else micro.crossJoin(macro)  # one row each


def ranking_metrics(cells: DataFrame, by: list[str] = []) -> DataFrame:
    """micro_average_precision over all cells, and macro_average_precision over labels with positives."""
    micro = average_precision(cells, by).select(*by, F.col("ap").alias("micro_average_precision"))
    each = average_precision(cells, [*by, "label"]).where("positives > 0")
    macro = each.groupBy(*by).agg(F.avg("ap").alias("macro_average_precision"))
    return micro.join(macro, by, "left") if by else micro.crossJoin(macro)


def threshold_sweep(cells: DataFrame, grid: list[float], by: list[str] = []) -> DataFrame:
    """The metrics at each threshold of a fixed grid, in one pass over the cells."""
    wide = cells.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in grid])))
    return multilabel_metrics(wide, F.col("threshold"), [*by, "threshold"])


def best_threshold(sweep: DataFrame, by: list[str] = []) -> DataFrame:
    """The row of largest micro F1, then micro precision, then threshold."""
    names = [c for c in sweep.columns if c not in by]
    best = F.max_by(F.struct(*names), F.struct("micro_f1", "micro_precision", "threshold"))
    return (sweep.groupBy(*by) if by else sweep.groupBy()).agg(best.alias("b")).select(*by, "b.*")


def prevalence_baseline(truth: DataFrame, sample: str = "sample_id") -> DataFrame:
    """label, idx, prevalence, top_k and yhat: the labels as many as the median sample has, by prevalence; ties by idx."""
    sizes = truth.groupBy(sample).agg(F.sum("y").cast("double").alias("n")).agg(F.bround(F.median("n"), 0).cast("int").alias("top_k"))
    means = truth.groupBy("label", "idx").agg(F.avg(F.col("y").cast("double")).alias("prevalence"))
    rank = F.row_number().over(Window.orderBy(F.desc("prevalence"), "idx"))  # one row for each label
    return means.crossJoin(F.broadcast(sizes)).withColumn("yhat", (rank <= F.col("top_k")).cast("int"))


def pos_weights(truth: DataFrame, most: float = 20.0) -> DataFrame:
    """label, pos_weight: negatives by positives, between 1 and ``most``."""
    pos, n = F.sum("y"), F.count("*")
    return truth.groupBy("label").agg(F.least(F.lit(most), F.greatest(F.lit(1.0), (n - pos) / F.greatest(pos, F.lit(1)))).cast("float").alias("pos_weight"))


def _finite(metric: str) -> Column:
    """The metric, or an error for a null, NaN or infinite one; to be used in an order, where it is evaluated for every row."""
    value = F.col(metric).cast("double")
    good = F.coalesce(F.abs(value) < float("inf"), F.lit(False)) & ~F.isnan(value)
    return F.when(good, value).otherwise(F.raise_error(F.concat(F.lit(f"{metric} isn't finite: "), F.coalesce(value.cast("string"), F.lit("null")))).cast("double"))


def select_model(candidates: DataFrame, metric: str, simplest: str, name: str = "name") -> DataFrame:
    """The candidate of largest metric; of equal ones the one that counts as simplest, then the first by name.

    A null or non-finite metric of any candidate is an error.
    """
    return candidates.orderBy(F.desc(_finite(metric)), F.desc(F.col(name) == simplest), name).limit(1)


def label_coverage(df: DataFrame, labels: str, id_col: str) -> DataFrame:
    """labels, samples: how many different labels occur, and in how many samples any does."""
    return df.select(id_col, F.explode(labels).alias("_l")).agg(F.count_distinct("_l").alias("labels"), F.count_distinct(id_col).alias("samples"))


def rates(df: DataFrame, by: list[str] = [], **of: Column) -> DataFrame:
    """The share of rows in which each condition holds (a null doesn't), and rows."""
    each = [F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(n) for n, c in of.items()]
    return df.groupBy(*by).agg(*each, F.count("*").alias("rows"))


def first_best(history: DataFrame, metric: str, step: str = "epoch") -> DataFrame:
    """The first step that attains the largest value of a metric; a null or non-finite value at any step is an error."""
    return history.orderBy(F.desc(_finite(metric)), step).limit(1)
