"""Queries over the driver tables that apply the library's operators, each with an SQL twin where SQL can express it.

The driver's tables stand in for a labelled benchmark: documents are its samples (source or language the class), quality
and toxic its labels, hashes of the text its contents. Predictions are simple functions of a document's numbers.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.functions.ontology import Label, Ontology, names_match
from sieveline.operators import aggregates as G
from sieveline.operators import annotation as A
from sieveline.operators import duplicates as D
from sieveline.operators import evaluation as E
from sieveline.operators import inference as I
from sieveline.operators import joins as J
from sieveline.operators import records as R
from sieveline.operators import sampling as S
from sieveline.operators import validation as V
from sieveline.operators.evidence import source_votes
from sieveline.plans.durable import bytes_read, delete_folder, durable, shared_folder
from sieveline.plans.provenance import differing_leaves, table_digest, tree_root
from sieveline.sources import recipes
from sieveline.sources.evidence import collect_evidence, stream_evidence
from sieveline.streaming.incremental import pending, upsert
from sieveline.streaming.state import last_decisions, work_queue
from sieveline.streaming.store import BucketedStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
THRESHOLD = 0.5
GRID = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
ITERATIONS = 2000
#: Bytes of a stream's files for each of its state stores.
STATE_BYTES = 1 << 20


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------------------------------------- metrics

def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, lang, source, idx, label, y, p: two labels for each labelled document, scores in hundredths with many ties."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    both = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    n, d = F.col("n_chars"), F.col("doc_id")
    cell = lambda i, name, p: F.struct(F.lit(i).alias("idx"), F.lit(name).alias("label"), F.col(name).alias("y"), (p / 100.0).alias("p"))
    each = F.explode(F.array(cell(0, "quality", (n + 30 * F.col("quality")) % 101), cell(1, "toxic", (7 * n + d + 40 * F.col("toxic")) % 101)))
    return both.select(d.alias("sample_id"), "lang", "source", each.alias("c")).select("sample_id", "lang", "source", "c.*")


CELLS = """
WITH both_labels AS (SELECT * FROM documents JOIN labels USING (doc_id)),
cells AS (
  SELECT doc_id AS sample_id, lang, source, 0 AS idx, 'quality' AS label, quality AS y, ((n_chars + 30 * quality) % 101) / 100.0::DOUBLE AS p FROM both_labels
  UNION ALL
  SELECT doc_id, lang, source, 1, 'toxic', toxic, ((7 * n_chars + doc_id + 40 * toxic) % 101) / 100.0::DOUBLE FROM both_labels),
hits AS (SELECT *, CAST(p >= 0.5 AS INT) AS h, CASE WHEN p >= 0.5 AND y = 1 THEN 1 ELSE 0 END AS tp,
                CASE WHEN p >= 0.5 AND y = 0 THEN 1 ELSE 0 END AS fp, CASE WHEN p < 0.5 AND y = 1 THEN 1 ELSE 0 END AS fn FROM cells),
by_sample AS (SELECT sample_id, lang, source, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn,
                     CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) > 0 THEN 2 * sum(tp) / CAST(2 * sum(tp) + sum(fp) + sum(fn) AS DOUBLE) ELSE 1.0 END AS f1
              FROM hits GROUP BY ALL)
"""
MICRO = """CASE WHEN sum(tp) + sum(fp) > 0 THEN sum(tp) / CAST(sum(tp) + sum(fp) AS DOUBLE) ELSE 0 END AS micro_precision,
       CASE WHEN sum(tp) + sum(fn) > 0 THEN sum(tp) / CAST(sum(tp) + sum(fn) AS DOUBLE) ELSE 0 END AS micro_recall,
       CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) > 0 THEN 2 * sum(tp) / CAST(2 * sum(tp) + sum(fp) + sum(fn) AS DOUBLE) ELSE 0 END AS micro_f1"""


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to so many digits, as engines add in different orders."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(CELLS + f""",
by_label AS (SELECT lang, label, sum(tp) + sum(fn) AS support,
                    CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) > 0 THEN 2 * sum(tp) / CAST(2 * sum(tp) + sum(fp) + sum(fn) AS DOUBLE) ELSE 0 END AS f1
             FROM hits GROUP BY ALL),
macro AS (SELECT lang, count(*) AS labels, count(*) FILTER (support > 0) AS s, coalesce(avg(f1) FILTER (support > 0), 0) AS m FROM by_label GROUP BY lang),
micro AS (SELECT lang, count(*) AS samples, {MICRO}, avg(f1) AS sample_f1, avg(CASE WHEN fp + fn = 0 THEN 1.0 ELSE 0.0 END) AS exact_match FROM by_sample GROUP BY lang)
SELECT lang, samples, round(micro_precision, 9) AS micro_precision, round(micro_recall, 9) AS micro_recall, round(micro_f1, 9) AS micro_f1,
       round(sample_f1, 9) AS sample_f1, round(exact_match, 9) AS exact_match, labels, s AS labels_with_test_support, round(m, 9) AS macro_f1_supported
FROM micro JOIN macro USING (lang)""")
def multilabel_metrics_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.multilabel_metrics(cells(spark, sf_dir), THRESHOLD, ["lang"]))


@query(CELLS + """
SELECT lang, label, CAST(sum(tp) + sum(fn) AS BIGINT) AS support, CAST(sum(tp) + sum(fp) AS BIGINT) AS predicted_positive,
       round(CASE WHEN sum(tp) + sum(fp) > 0 THEN sum(tp) / CAST(sum(tp) + sum(fp) AS DOUBLE) ELSE 0 END, 9) AS precision,
       round(CASE WHEN sum(tp) + sum(fn) > 0 THEN sum(tp) / CAST(sum(tp) + sum(fn) AS DOUBLE) ELSE 0 END, 9) AS recall,
       round(CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) > 0 THEN 2 * sum(tp) / CAST(2 * sum(tp) + sum(fp) + sum(fn) AS DOUBLE) ELSE 0 END, 9) AS f1
FROM hits GROUP BY lang, label""")
def per_label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.per_label_metrics(cells(spark, sf_dir), THRESHOLD, ["lang"]))


@query(CELLS + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY p DESC, idx) AS k FROM cells)
SELECT lang, round(avg(hit), 9) AS precision_at_k FROM (SELECT lang, sample_id, sum(y)::DOUBLE AS hit FROM ranked WHERE k <= 1 GROUP BY ALL) GROUP BY lang""")
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.precision_at_k(cells(spark, sf_dir), 1, ["lang"]))


AP = """
, steps AS (SELECT lang, {k} p, sum(y) AS pos, count(*) AS n FROM cells GROUP BY ALL),
run AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM steps WINDOW w AS (PARTITION BY lang {by} ORDER BY p DESC)),
ap AS (SELECT lang {by}, CASE WHEN sum(pos) > 0 THEN sum(pos * (tp / CAST(seen AS DOUBLE))) / sum(pos) ELSE 0 END AS ap, sum(pos) AS positives FROM run GROUP BY ALL)
"""


@query(CELLS + AP.format(k="", by="") + "SELECT lang, round(ap, 9) AS ap, CAST(positives AS BIGINT) AS positives FROM ap")
def avg_precision_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.average_precision(cells(spark, sf_dir), ["lang"]))


@query(CELLS + AP.format(k="label,", by=", label") + "SELECT lang, round(avg(ap), 9) AS macro_average_precision FROM ap WHERE positives > 0 GROUP BY lang")
def avg_precision_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = E.average_precision(cells(spark, sf_dir), ["lang", "label"]).where("positives > 0")
    return rounded(each.groupBy("lang").agg(F.avg("ap").alias("macro_average_precision")))


SWEEP = CELLS.split("hits AS")[0].rstrip().rstrip(",") + f""",
grid AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold),
swept AS (SELECT threshold, sample_id, label, CASE WHEN p >= threshold AND y = 1 THEN 1 ELSE 0 END AS tp,
                 CASE WHEN p >= threshold AND y = 0 THEN 1 ELSE 0 END AS fp, CASE WHEN p < threshold AND y = 1 THEN 1 ELSE 0 END AS fn FROM cells, grid),
micro AS (SELECT threshold, {MICRO} FROM swept GROUP BY threshold),
shown AS (SELECT threshold, round(micro_precision, 9) AS micro_precision, round(micro_recall, 9) AS micro_recall, round(micro_f1, 9) AS micro_f1 FROM micro)
"""
SWEPT = ["threshold", "micro_precision", "micro_recall", "micro_f1"]


@query(SWEEP + "SELECT * FROM shown")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.threshold_sweep(cells(spark, sf_dir), GRID).select(*SWEPT))


@query(SWEEP + "SELECT * FROM shown ORDER BY micro_f1 DESC, micro_precision DESC, threshold DESC LIMIT 1")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.best_threshold(E.threshold_sweep(cells(spark, sf_dir), GRID).select(*SWEPT)))


@query(CELLS + """,
sizes AS (SELECT CAST(round_even(median(n), 0) AS INT) AS top_k FROM (SELECT sample_id, CAST(sum(y) AS DOUBLE) AS n FROM cells GROUP BY ALL)),
means AS (SELECT label, idx, avg(y) AS prevalence FROM cells GROUP BY ALL)
SELECT label, idx, round(prevalence, 9) AS prevalence, top_k, CAST(row_number() OVER (ORDER BY prevalence DESC, idx) <= top_k AS INT) AS yhat FROM means, sizes""")
def prevalence_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.prevalence_baseline(cells(spark, sf_dir)))


@query(CELLS + """
SELECT label, CAST(least(20.0, greatest(1.0, (count(*) - sum(y)) / CAST(greatest(sum(y), 1) AS DOUBLE))) AS FLOAT) AS pos_weight FROM cells GROUP BY label""")
def pos_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pos_weights(cells(spark, sf_dir))


@query(CELLS + """,
m AS (SELECT source, CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) > 0 THEN 2 * sum(tp) / CAST(2 * sum(tp) + sum(fp) + sum(fn) AS DOUBLE) ELSE 0 END AS f FROM by_sample GROUP BY source)
SELECT source AS epoch, round(f, 9) AS micro_f1 FROM m ORDER BY round(f, 9) DESC, source LIMIT 1""")
def first_best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = rounded(E.multilabel_metrics(cells(spark, sf_dir), THRESHOLD, ["source"])).select(F.col("source").alias("epoch"), "micro_f1")
    return E.first_best(scores, "micro_f1")


# ---------------------------------------------------------------------------------------------- inference

WEIGHTS = f"""
, grps AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS g FROM (SELECT DISTINCT source AS grp FROM by_sample)),
weights AS (
  SELECT i AS iteration, CAST('0x' || substr(md5('42:' || i || ':' || pos), 1, 8) AS BIGINT) % g AS pick, count(*) AS w
  FROM grps, range(0, {ITERATIONS}) AS r(i) GROUP BY ALL),
sums AS (SELECT source AS grp, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(f1) AS f1, count(*) AS n FROM by_sample GROUP BY ALL),
drawn AS (SELECT iteration, w, sums.* FROM weights JOIN grps ON pick = pos JOIN sums USING (grp))
"""
_F1 = "CASE WHEN sum({w}(2 * tp + fp + fn)) > 0 THEN sum({w}(2 * tp)) / CAST(sum({w}(2 * tp + fp + fn)) AS DOUBLE) ELSE 0 END"


def _scored(spark: SparkSession, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    return E.sample_f1(cells(spark, sf_dir), threshold, ["source"]).withColumnRenamed("source", "grp")


@query(CELLS + WEIGHTS + f""",
vals AS (SELECT iteration, {_F1.format(w="w * ")} AS v FROM drawn GROUP BY iteration)
SELECT round((SELECT {_F1.format(w="")} FROM sums), 9) AS estimate, round(quantile_cont(v, 0.025), 9) AS ci_lower, round(quantile_cont(v, 0.975), 9) AS ci_upper FROM vals""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = I.group_sums(_scored(spark, sf_dir), [])
    return rounded(I.bootstrap_interval(sums, I.hashed_weights(sums, ITERATIONS)))


OTHER = CELLS.replace("p >= 0.5", "p >= 0.3").replace("p < 0.5", "p < 0.3").replace("WITH both_labels AS (SELECT * FROM documents JOIN labels USING (doc_id)),", "").replace("hits", "hits2").replace("by_sample", "by_sample2").replace("cells AS (", "cells2 AS (").replace("FROM cells)", "FROM cells2)")


@query(CELLS + "," + OTHER + WEIGHTS + """,
sums2 AS (SELECT source AS grp, sum(f1) AS f1, count(*) AS n FROM by_sample2 GROUP BY ALL),
vals AS (SELECT iteration, sum(w * sums2.f1) / sum(w * sums2.n) - sum(w * drawn.f1) / sum(w * drawn.n) AS v FROM drawn JOIN sums2 USING (grp) GROUP BY iteration)
SELECT round((SELECT sum(f1) / sum(n) FROM sums2) - (SELECT sum(f1) / sum(n) FROM sums), 9) AS estimate,
       round(quantile_cont(v, 0.025), 9) AS ci_lower, round(quantile_cont(v, 0.975), 9) AS ci_upper FROM vals""")
def bootstrap_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (I.group_sums(_scored(spark, sf_dir, t), []) for t in (THRESHOLD, 0.3))
    return rounded(I.bootstrap_difference(a, b, I.hashed_weights(a, ITERATIONS)))


@query(CELLS + "," + OTHER + """,
d AS (SELECT hash AS pos, sum(df) AS d FROM (SELECT CAST(substr(a.source, 4) AS INT) % 12 AS hash, b.f1 - a.f1 AS df FROM by_sample a JOIN by_sample2 b USING (sample_id)) GROUP BY ALL),
obs AS (SELECT sum(d) AS o, count(*) AS g FROM d), n AS (SELECT count(*) AS n FROM by_sample),
ranked AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, d FROM d),
flips AS (SELECT i, sum(CASE WHEN (i >> pos) & 1 = 1 THEN -d ELSE d END) AS s FROM ranked, range(0, CAST(pow(2, (SELECT g FROM obs)) AS BIGINT)) AS r(i) GROUP BY i)
SELECT round(o / n, 9) AS observed, round(count(*) FILTER (abs(s) >= abs(o) - 1e-12 * n) / CAST(count(*) AS DOUBLE), 9) AS p_value,
       'group_clustered_exact_sign_flip' AS method, count(*) AS permutations FROM flips, obs, n GROUP BY o, n""")
def sign_flip_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (_scored(spark, sf_dir, t) for t in (THRESHOLD, 0.3))
    pair = a.select("sample_id", "grp", F.col("f1").alias("f1a")).join(b.select("sample_id", "f1"), "sample_id")
    diffs = pair.select((F.substring("grp", 4, 9).cast("int") % 12).alias("grp"), (F.col("f1") - F.col("f1a")).alias("diff"))
    return rounded(I.sign_flip_test(diffs))


@query(CELLS + WEIGHTS + """,
vals AS (SELECT iteration, sum(w * f1) / sum(w * n) AS v FROM drawn GROUP BY iteration)
SELECT round((SELECT sum(f1) / sum(n) FROM sums), 9) AS estimate, round(quantile_cont(v, 0.025), 9) AS ci_lower, round(quantile_cont(v, 0.975), 9) AS ci_upper FROM vals""")
def bootstrap_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean as a user's own aggregate over samples."""
    mean = G.sums(("f1",), lambda s: s[:, 1] / s[:, 0])
    return rounded(_resampled(spark, sf_dir, mean))


def _resampled(spark: SparkSession, sf_dir: str, aggregate: G.Aggregate) -> DataFrame:
    samples = _scored(spark, sf_dir)
    return I.bootstrap_aggregate(samples, I.hashed_weights(samples, ITERATIONS), aggregate)


@query(CELLS + WEIGHTS + """,
squares AS (SELECT source AS grp, sum(f1 * f1) AS q FROM by_sample GROUP BY ALL),
spread AS (SELECT iteration, sqrt(greatest(sum(w * q) / sum(w * n) - pow(sum(w * f1) / sum(w * n), 2), 0)) AS v FROM drawn JOIN squares USING (grp) GROUP BY iteration)
SELECT round((SELECT stddev_pop(f1) FROM by_sample), 9) AS estimate, round(quantile_cont(v, 0.025), 9) AS ci_lower, round(quantile_cont(v, 0.975), 9) AS ci_upper FROM spread""")
def bootstrap_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard deviation of sample F1 as a user's own aggregate: count, mean and squared deviations, merged pairwise."""

    def update(state: np.ndarray, rows: dict[str, np.ndarray]) -> np.ndarray:
        x = rows["f1"]
        return merge(state, np.array([len(x), x.mean(), ((x - x.mean()) ** 2).sum()]))

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = a[..., 0] + b[..., 0]
        share = b[..., 0] / np.maximum(n, 1)
        apart = b[..., 1] - a[..., 1]
        return np.stack([n, a[..., 1] + apart * share, a[..., 2] + b[..., 2] + apart * apart * a[..., 0] * share], axis=-1)

    spread = G.Aggregate(("f1",), lambda: np.zeros(3), update, merge, lambda s: np.sqrt(s[:, 2] / np.maximum(s[:, 0], 1)))
    return rounded(_resampled(spark, sf_dir, spread))


@query(CELLS + "," + OTHER + """,
d AS (SELECT a.source AS g, sum(b.f1 - a.f1) AS d FROM by_sample a JOIN by_sample2 b USING (sample_id) GROUP BY ALL),
obs AS (SELECT sum(d) AS o FROM d), n AS (SELECT count(*) AS n FROM by_sample),
flips AS (
  SELECT i, sum(CASE WHEN (CAST('0x' || substr(md5('42:' || g || ':' || i // 128), (i % 128) // 4 + 1, 1) AS INT) >> (3 - i % 4)) & 1 = 1 THEN -d ELSE d END) AS s
  FROM d, range(0, 10000) AS r(i) GROUP BY i)
SELECT round(o / n, 9) AS observed, round((count(*) FILTER (abs(s) >= abs(o) - 1e-12 * n) + 1) / CAST(count(*) + 1 AS DOUBLE), 9) AS p_value,
       'group_clustered_monte_carlo_sign_flip' AS method, count(*) AS permutations FROM flips, obs, n GROUP BY o, n""")
def sign_flip_monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty sources have more sign vectors than iterations, so these are drawn."""
    a, b = (_scored(spark, sf_dir, t) for t in (THRESHOLD, 0.3))
    pair = a.select("sample_id", "grp", F.col("f1").alias("f1a")).join(b.select("sample_id", "f1"), "sample_id")
    return rounded(I.sign_flip_test(pair.select("grp", (F.col("f1") - F.col("f1a")).alias("diff"))))


# ---------------------------------------------------------------------------------------------- ontology

def part_ontology(spark: SparkSession, sf_dir: str) -> Ontology:
    """Labels of part names and of their last words: a fixed vocabulary of some dozens, so it may meet on the driver."""
    names = [r[0] for r in table(spark, sf_dir, "part").select(F.lower("p_name")).distinct().orderBy(F.lower("p_name")).collect()]
    heads = sorted({n.split()[-1] for n in names})
    return Ontology(tuple(Label(n.replace(" ", "_"), "part") for n in names) + tuple(Label(h, "head") for h in heads if h not in names))


PHRASES = """
WITH names AS (SELECT DISTINCT lower(p_name) AS a FROM part),
aliases AS (SELECT a FROM names UNION SELECT string_split(a, ' ')[-1] FROM names),
idx AS (SELECT a, row_number() OVER (ORDER BY a NOT IN (SELECT a FROM names), a) AS i FROM aliases),
pat AS (SELECT '(?:^|[^a-z0-9])(' || string_agg(replace(a, ' ', '  '), '|' ORDER BY -length(a), a) || ')(?:[^a-z0-9]|$)' AS re FROM aliases),
txt AS (SELECT p_partkey AS k, p_brand AS brand, lower(p_name) || ', ' || lower(p_type) || ' ' || lower(string_split(p_name, ' ')[-1]) AS t FROM part),
hit AS (SELECT k, brand, unnest(regexp_extract_all(regexp_replace(t, '([^a-z0-9])', '\\1\\1', 'g'), re, 1)) AS h FROM txt, pat),
lab AS (SELECT DISTINCT k, brand, replace(h, '  ', ' ') AS a FROM hit)
"""


def part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", F.concat(name, F.lit(", "), F.lower("p_type"), F.lit(" "), F.element_at(F.split(name, " "), -1)).alias("t")
    )


@query(PHRASES + "SELECT txt.k AS p_partkey, coalesce(string_agg(replace(lab.a, ' ', '_'), '|' ORDER BY i), '') AS labels FROM txt LEFT JOIN lab ON lab.k = txt.k LEFT JOIN idx ON idx.a = lab.a GROUP BY txt.k")
def phrase_extract_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = part_ontology(spark, sf_dir)
    return part_texts(spark, sf_dir).select("p_partkey", F.array_join(o.extract(F.col("t")), "|").alias("labels"))


@query(PHRASES + "SELECT replace(a, ' ', '_') AS label, count(DISTINCT brand) AS independent_sources, count(DISTINCT brand) >= 2 AS accepted FROM lab GROUP BY a")
def phrase_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = part_ontology(spark, sf_dir)
    evidence = part_texts(spark, sf_dir).select(F.lit("all").alias("food_class"), F.col("t").alias("title"), F.lit("").alias("snippet"), F.col("p_brand").alias("domain"))
    return source_votes(evidence, o).select("label", "independent_sources", "accepted")


VOTES = PHRASES.replace("SELECT p_partkey AS k, p_brand AS brand, lower(p_name) || ', ' || lower(p_type) || ' ' || lower(string_split(p_name, ' ')[-1]) AS t FROM part", """
  SELECT p_partkey AS k, 'c' || p_size % 3 || '/' || p_brand AS brand,
         CASE WHEN p_partkey % 4 = 0 THEN '' ELSE lower(p_name) END || ' ' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE lower(p_type) || ' ' || lower(string_split(p_name, ' ')[-1]) END AS t
  FROM part WHERE p_partkey % 6 <> 0""")


@query(VOTES + """
SELECT split_part(brand, '/', 1) AS food_class, replace(a, ' ', '_') AS label, count(DISTINCT brand) AS independent_sources, count(DISTINCT brand) >= 3 AS accepted
FROM lab GROUP BY split_part(brand, '/', 1), a""")
def phrase_votes_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three classes, with titles, snippets and domains of which some are missing or blank."""
    o, k, name = part_ontology(spark, sf_dir), F.col("p_partkey"), F.lower("p_name")
    evidence = table(spark, sf_dir, "part").select(
        F.concat(F.lit("c"), F.col("p_size") % 3).alias("food_class"),
        F.when(k % 4 > 0, name).alias("title"),
        F.when(k % 5 > 0, F.concat(F.lower("p_type"), F.lit(" "), F.element_at(F.split(name, " "), -1))).alias("snippet"),
        F.when(k % 6 == 0, " ").otherwise(F.col("p_brand")).alias("domain"),
    )
    return source_votes(evidence, o, minimum=3)


@query(PHRASES + "SELECT count(DISTINCT a) AS labels, count(DISTINCT k) AS samples FROM lab")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = part_ontology(spark, sf_dir)
    return E.label_coverage(part_texts(spark, sf_dir).select("p_partkey", o.extract(F.col("t")).alias("ls")), "ls", "p_partkey")


@query("""
WITH c AS (SELECT p_partkey, [trim(x) FOR x IN regexp_split_to_array(p_name || CASE WHEN p_size % 3 = 0 THEN '; Widget ' ELSE ' , ' END || upper(p_name), '[|,;]')] AS parts FROM part),
names AS (SELECT DISTINCT lower(p_name) AS a FROM part), heads AS (SELECT DISTINCT string_split(a, ' ')[-1] AS a FROM names)
SELECT p_partkey, coalesce(string_agg(DISTINCT replace(lower(x), ' ', '_'), '|') FILTER (a IS NOT NULL), '') AS labels,
       coalesce(string_agg(x, '|') FILTER (a IS NULL AND x <> ''), '') AS unknown
FROM (SELECT p_partkey, unnest(parts) AS x FROM c) LEFT JOIN (SELECT a FROM names UNION SELECT a FROM heads) k ON lower(x) = k.a GROUP BY p_partkey""")
def cell_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = part_ontology(spark, sf_dir)
    cell = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, "; Widget ").otherwise(" , "), F.upper("p_name"))
    read = table(spark, sf_dir, "part").select("p_partkey", o.parse_cell(cell).alias("c"))
    return read.select("p_partkey", o.serialize(F.col("c.labels")).alias("labels"), F.array_join("c.unknown", "|").alias("unknown"))


@query("""
SELECT p_partkey, lower(regexp_replace(p_name, '\\s+', ' ', 'g')) = lower(p_name) AND p_size % 2 = 0 AS matched FROM part""")
def food_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise("other thing")
    return table(spark, sf_dir, "part").select("p_partkey", names_match(said, F.lower("p_name"), {"gadget": ["gizmo"]}).alias("matched"))


@query("""
WITH t AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' yes ' WHEN 2 THEN 'Y' WHEN 3 THEN '1' WHEN 4 THEN 'No' WHEN 5 THEN '' WHEN 6 THEN 'maybe' WHEN 7 THEN NULL ELSE '0' END AS x FROM events)
SELECT event_id, CASE WHEN lower(trim(coalesce(x, ''))) IN ('true', '1', 'yes', 'y') THEN true WHEN lower(trim(coalesce(x, ''))) IN ('false', '0', 'no', 'n', '') THEN false END AS flag FROM t""")
def boolean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.element_at(F.array(*[F.lit(x) for x in ("TRUE", " yes ", "Y", "1", "No", "", "maybe", None, "0")]), (F.col("event_id") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", T.parse_boolean(tokens).alias("flag"))


@query("""
SELECT p_partkey, trim(regexp_replace(lower(CASE WHEN p_size % 5 = 0 THEN p_brand ELSE p_name END), '[^a-z0-9]+', '-', 'g'), '-') AS group_id FROM part""")
def group_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("p_size") % 5 == 0, "  ").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(title, F.col("p_brand")).alias("group_id"))


@query("""
WITH RECURSIVE f AS (SELECT event_id, user_id, (event_id % 7 = 0) AS a, (event_id % 5 = 0) AS b, (event_id % 3 = 0) AS c FROM events)
SELECT event_id, CASE WHEN a THEN 'unreadable' WHEN b THEN 'non_food' WHEN c THEN 'no_visible_ontology_label' ELSE '' END AS status FROM f""")
def special_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", T.special_status(e % 7 == 0, e % 5 == 0, e % 3 == 0).alias("status"))


# ---------------------------------------------------------------------------------------------- duplicates

def content_hash(text: Column) -> Column:
    """64 bits, 16 hex characters: four minima over the words' MD5, each word's taken once."""
    words = F.transform(F.array_distinct(F.split(F.coalesce(text, F.lit("")), " ")), lambda w: F.md5(w))
    least = lambda ws, i: F.substring(F.array_min(F.transform(ws, lambda h: F.substring(h, 8 * i + 1, 8))), 5, 4)
    return F.element_at(F.transform(F.array(words), lambda ws: F.concat(*[least(ws, i) for i in range(4)])), 1)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept, as filters and both sides of a join would compute the hashes again."""
    return durable(
        table(spark, sf_dir, "documents").select(
            "doc_id", F.col("lang").alias("food_class"), F.sha2("text", 256).alias("sha256"), content_hash(F.col("text")).alias("dhash"), F.lit("ok").alias("status")
        )
    )


INVENTORY = """
WITH RECURSIVE words AS (SELECT doc_id, md5(unnest(list_distinct(string_split(coalesce(text, ''), ' ')))) AS h FROM documents),
hashed AS (SELECT doc_id, substr(min(substr(h, 1, 8)), 5, 4) || substr(min(substr(h, 9, 8)), 5, 4) || substr(min(substr(h, 17, 8)), 5, 4) || substr(min(substr(h, 25, 8)), 5, 4) AS dhash FROM words GROUP BY doc_id),
inventory AS (SELECT doc_id, lang AS food_class, sha256(text) AS sha256, dhash FROM documents JOIN hashed USING (doc_id)),
bits AS (SELECT DISTINCT dhash, CAST('0x' || dhash AS UBIGINT) AS x FROM inventory),
near AS (SELECT a.dhash AS a, b.dhash AS b, CAST(bit_count(CAST(xor(a.x, b.x) AS UHUGEINT)::VARCHAR::HUGEINT) AS INT) AS distance FROM bits a JOIN bits b ON a.dhash < b.dhash)
"""


@query("""
WITH h AS (SELECT DISTINCT CASE WHEN c_custkey % 10 = 0 THEN substr(md5(CAST(c_custkey AS VARCHAR)), 1, 16) ELSE printf('%016x', 11 * c_custkey) END AS h FROM customer),
bits AS (SELECT h, CAST('0x' || h AS UBIGINT) AS x FROM h)
SELECT a.h AS a, b.h AS b, CAST(bit_count(CAST(xor(a.x, b.x) AS UHUGEINT)::VARCHAR::HUGEINT) AS INT) AS distance FROM bits a JOIN bits b ON a.h < b.h
WHERE bit_count(CAST(xor(a.x, b.x) AS UHUGEINT)::VARCHAR::HUGEINT) <= 2""")
def near_hashes_of_a_hot_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of which nine in ten agree in two of the three bands; the values that many share are banded again."""
    key = F.col("c_custkey")
    hash_ = F.when(key % 10 == 0, F.substring(F.md5(key.cast("string")), 1, 16)).otherwise(F.lower(F.lpad(F.hex(11 * key), 16, "0")))
    rows = table(spark, sf_dir, "customer").select(hash_.alias("hash"))
    return D.near_hashes(rows, rows, most=1 << 12).where("a < b")


@query(INVENTORY + "SELECT a, b, distance FROM near WHERE distance <= 2")
def near_dup_pairs_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.near_pairs(inventory(spark, sf_dir).withColumnRenamed("dhash", "hash"))


GROUPS = """
, e AS (SELECT a, b FROM near WHERE distance <= 2 UNION SELECT b, a FROM near WHERE distance <= 2),
reach(x, y) AS (SELECT dhash, dhash FROM bits UNION SELECT reach.x, e.b FROM reach JOIN e ON e.a = reach.y),
named AS (SELECT x, min(sha256) AS least, count(DISTINCT doc_id) AS n FROM reach JOIN inventory ON dhash = y GROUP BY x),
grouped AS (SELECT doc_id, food_class, sha256, 'dup-' || substr(least, 1, 16) AS duplicate_group, n AS duplicate_group_size FROM inventory JOIN named ON dhash = x)
"""


@query(INVENTORY + GROUPS + "SELECT doc_id, duplicate_group, duplicate_group_size FROM grouped")
def dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.duplicate_groups(inventory(spark, sf_dir)).select("doc_id", "duplicate_group", "duplicate_group_size")


EXACT = """
WITH grouped AS (SELECT doc_id, lang AS food_class, sha256(text) AS sha256, 'dup-' || substr(sha256(text), 1, 16) AS duplicate_group, count(*) OVER (PARTITION BY text) AS duplicate_group_size FROM documents)
"""


@query(EXACT + "SELECT doc_id, duplicate_group, duplicate_group_size FROM grouped")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.duplicate_groups(inventory(spark, sf_dir), -1).select("doc_id", "duplicate_group", "duplicate_group_size")


@query(EXACT + "SELECT doc_id, food_class, duplicate_group FROM grouped QUALIFY row_number() OVER (PARTITION BY duplicate_group ORDER BY food_class, sha256, doc_id) = 1")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = D.duplicate_groups(inventory(spark, sf_dir), -1).select("doc_id", "food_class", "sha256", "duplicate_group")
    return D.representatives(grouped).select("doc_id", "food_class", "duplicate_group")


def _leak(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents held against those of every tenth id, some of which stand in twice and some with a changed text."""
    inv = inventory(spark, sf_dir).withColumnRenamed("dhash", "hash")
    reference = inv.where("doc_id % 10 = 0").select(F.concat(F.lit("r"), "doc_id").alias("sample_id"), "sha256", "hash", F.col("doc_id").alias("ord"))
    return inv.where("doc_id % 10 <> 0").withColumnRenamed("doc_id", "candidate_id"), reference


OVERLAP = INVENTORY + """
, ref AS (SELECT doc_id AS ord, sha256, dhash, CAST('0x' || dhash AS UBIGINT) AS x FROM inventory WHERE doc_id % 10 = 0),
cand AS (SELECT doc_id AS candidate_id, sha256, CAST('0x' || dhash AS UBIGINT) AS x FROM inventory WHERE doc_id % 10 <> 0),
exact AS (SELECT candidate_id, c.sha256 AS candidate_sha256, 'r' || max(ord) AS reference_sample_id, 'exact_sha256' AS match_type, 0 AS hash_distance FROM cand c JOIN ref r USING (sha256) GROUP BY ALL),
pairs AS (SELECT candidate_id, c.sha256, ord, CAST(bit_count(CAST(xor(c.x, r.x) AS UHUGEINT)::VARCHAR::HUGEINT) AS INT) AS dist
          FROM cand c, ref r WHERE candidate_id NOT IN (SELECT candidate_id FROM exact)),
report AS (SELECT * FROM exact UNION ALL
  SELECT candidate_id, sha256, 'r' || ord, 'near_difference_hash', dist FROM pairs WHERE dist <= 2 QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY dist, ord) = 1)
"""


@query(OVERLAP + "SELECT * FROM report")
def overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.overlap_report(*_leak(spark, sf_dir))


@query(OVERLAP + "SELECT candidate_id FROM cand WHERE candidate_id NOT IN (SELECT candidate_id FROM report)")
def overlap_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, reference = _leak(spark, sf_dir)
    return D.quarantine(candidates, D.overlap_report(candidates, reference)).select("candidate_id")


@query("""
WITH RECURSIVE r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'a=' || c_custkey // 6 END AS a, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'b=' || c_custkey % 500 END AS b FROM customer),
v AS (SELECT id, a AS t FROM r WHERE a <> '' UNION SELECT id, b FROM r WHERE b <> ''),
e AS (SELECT DISTINCT x.t AS x, y.t AS y FROM v x JOIN v y USING (id)),
reach(x, y) AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
named AS (SELECT x, 'connected-' || substr(sha256(string_agg(y, chr(10) ORDER BY y)), 1, 16) AS g FROM reach GROUP BY x)
SELECT id, coalesce(min(g), 'singleton_row=' || id) AS connected_group FROM r LEFT JOIN v USING (id) LEFT JOIN named ON x = t GROUP BY id""")
def constraint_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 4 == 0, "").otherwise(F.expr("c_custkey div 6").cast("string")).alias("a"), F.when(k % 3 == 0, " ").otherwise((k % 500).cast("string")).alias("b")
    )
    return D.constraint_components(rows, ["a", "b"], "id").select("id", "connected_group")


# ---------------------------------------------------------------------------------------------- sampling

_POOL = "WITH pool AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id), doc_id) AS candidate_rank FROM documents QUALIFY candidate_rank <= {k})"
_SPLIT = """, split_of AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('43:' || doc_id), doc_id) AS n FROM pool),
sealed AS (SELECT doc_id, source, CASE WHEN n <= 6 THEN 'train' WHEN n <= 8 THEN 'validation' ELSE 'test' END AS split FROM split_of WHERE n <= 10)"""
SPLITS = (("train", 6), ("validation", 2), ("test", 2))


@query(_POOL.format(k=10) + "SELECT doc_id, source, CAST(candidate_rank AS INT) AS candidate_rank FROM pool")
def reserve_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reserve_pool(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 10)


@query(_POOL.format(k=10) + _SPLIT + "SELECT * FROM sealed")
def sealed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample_and_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", SPLITS)


@query(_POOL.format(k=10) + _SPLIT + "SELECT source, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test FROM sealed GROUP BY source")
def split_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_pivot(sealed_split(spark, sf_dir), "source", ["train", "validation", "test"])


@query("""
WITH s AS (SELECT c_mktsegment AS food_class, c_custkey AS candidate_rank, CASE WHEN c_custkey % 7 = 0 THEN 'accept' WHEN c_custkey % 3 = 0 THEN '' ELSE 'reject' END AS decision FROM customer),
o AS (SELECT food_class FROM s GROUP BY ALL HAVING count(*) FILTER (decision = 'accept') < 1000000)
SELECT food_class, candidate_rank FROM s JOIN o USING (food_class) WHERE decision = ''
ORDER BY food_class = 'MACHINERY' DESC, food_class, (food_class = 'MACHINERY' AND candidate_rank > 50) DESC, candidate_rank LIMIT 1""")
def worklist_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    decision = F.when(k % 7 == 0, "accept").when(k % 3 == 0, "").otherwise("reject")
    screen = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("food_class"), k.alias("candidate_rank"), decision.alias("decision"))
    return S.worklist_head(screen, "food_class", 1_000_000, "MACHINERY", 50).select("food_class", "candidate_rank")


def _quotas(x: str, taken: str, wants: str) -> str:
    """SQL of a round of the grouped split: its groups with a split, by the middle of their rows in the running sum."""
    return f"""
{x}t AS (SELECT *, 2 * sum(n) OVER (ORDER BY h, g) - n AS mid, sum(n) OVER () AS whole FROM grps WHERE {taken}),
{x}w AS (SELECT {wants.format(0)} AS w1, {wants.format(1)} AS w2, {wants.format(2)} AS w3),
{x}v AS (SELECT greatest(w1, 0) AS a, greatest(w2, 0) AS b, greatest(w3, 0) AS c FROM {x}w),
{x} AS (SELECT g, q, t, n, CASE WHEN mid < 2 * (a * whole / (a + b + c)) THEN 'train' WHEN mid < 2 * ((a + b) * whole / (a + b + c)) THEN 'validation' ELSE 'test' END AS split FROM {x}t, {x}v)"""


def _wanted(weight: str, *rounds: str) -> str:
    """SQL of a split's share of the rows with a condition, less those that rounds have given it; {{0}} is the split's number."""
    return f"(SELECT [0.7, 0.15, 0.15][{{0}} + 1]::DOUBLE * coalesce(sum(n) FILTER ({weight}), 0) FROM grps)" + "".join(
        f" - (SELECT coalesce(sum(n) FILTER ({weight} AND split = ['train', 'validation', 'test'][{{0}} + 1]), 0) FROM {r})" for r in rounds
    )


@query("""
WITH d AS (SELECT doc_id, sha256(text) AS g, quality = 1 AS q, toxic = 1 AS t FROM documents JOIN labels USING (doc_id)),
grps AS (SELECT g, bool_or(q) AS q, bool_or(t) AS t, count(*) AS n, sha256('42:' || g) AS h FROM d GROUP BY g),
"""
+ _quotas("toxic1", "t AND (SELECT sum(n) FILTER (t) < sum(n) FILTER (q) FROM grps)", _wanted("t")) + ","
+ _quotas("good1", "q AND NOT (t AND (SELECT sum(n) FILTER (t) < sum(n) FILTER (q) FROM grps))", _wanted("q", "toxic1")) + ","
+ _quotas("toxic2", "t AND NOT q AND NOT (SELECT sum(n) FILTER (t) < sum(n) FILTER (q) FROM grps)", _wanted("t", "good1")) + ","
+ _quotas("rest", "NOT t AND NOT q", _wanted("true", "toxic1", "good1", "toxic2"))
+ """
SELECT doc_id, g, split FROM d JOIN (FROM toxic1 UNION ALL FROM good1 UNION ALL FROM toxic2 UNION ALL FROM rest) USING (g)""")
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    labels = F.filter(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull())
    rows = docs.select("doc_id", F.sha2("text", 256).alias("g"), labels.alias("labels"))
    return S.grouped_split(rows, "g", "labels").select("doc_id", "g", "split")


@query("""
WITH d AS (SELECT event_id, CASE WHEN user_id % 3 > 0 THEN user_id // 3 END AS g, event_type FROM events)
SELECT event_type AS label, CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS groups_in_two_splits, true AS near_quotas FROM d GROUP BY event_type""")
def grouped_split_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user, a third of them without one (a single group): no row is lost, no group is in two splits, and each
    label's rows in a split are within the largest groups' rows of its quota."""
    user = F.when(F.col("user_id") % 3 > 0, F.expr("user_id div 3"))
    rows = table(spark, sf_dir, "events").select("event_id", user.alias("g"), F.array("event_type").alias("labels"))
    split = durable(S.grouped_split(rows, "g", "labels").select(F.col("labels")[0].alias("label"), "g", "split"))
    crossing = split.groupBy("g").agg(F.count_distinct("split").alias("s")).agg(F.count_if(F.col("s") > 1).alias("groups_in_two_splits"))
    widest = split.groupBy("g", "label").agg(F.count("*").alias("c")).groupBy("label").agg(F.max("c").alias("widest"))
    counts = split.groupBy("label").agg(F.count("*").alias("rows"), *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "validation", "test")])
    off = F.greatest(*[F.abs(F.col(s) - f * F.col("rows")) for s, f in (("train", 0.7), ("validation", 0.15), ("test", 0.15))])
    return counts.join(widest, "label").crossJoin(crossing).select("label", "rows", "groups_in_two_splits", (off <= F.col("widest")).alias("near_quotas"))


# ---------------------------------------------------------------------------------------------- validation, annotation

def _screen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A pool of customers by segment and a sheet with mistakes."""
    k = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select(k.alias("candidate_id"), F.col("c_mktsegment").alias("food_class"), (k % 100).alias("candidate_rank"))
    i = F.col("candidate_id")
    decision = F.when(i % 11 == 0, "accept").when(i % 5 == 0, "").when(i % 97 == 0, "later").otherwise(" Reject")
    reason = F.when(i % 22 == 0, "other").when(i % 25 == 0, "non_food").when((i % 5 == 0) | (i % 11 == 0), "").when(i % 13 == 0, "ugly").when(i % 17 == 0, "other").when(i % 19 == 0, "").otherwise("wrong_food_class")
    sheet = base.withColumns({"decision": decision, "rejection_reason": reason, "notes": F.when(i % 2 == 0, "seen").otherwise("")})
    changed = sheet.where("candidate_id % 101 <> 0").withColumn("candidate_rank", F.when(i % 103 == 0, -1).otherwise(F.col("candidate_rank")))
    return changed, base


SCREEN = """
WITH pool AS (SELECT c_custkey AS candidate_id, c_mktsegment AS food_class, c_custkey % 100 AS candidate_rank FROM customer),
sheet AS (
  SELECT candidate_id AS i, food_class, CASE WHEN candidate_id % 103 = 0 THEN -1 ELSE candidate_rank END AS candidate_rank,
    CASE WHEN candidate_id % 11 = 0 THEN 'accept' WHEN candidate_id % 5 = 0 THEN '' WHEN candidate_id % 97 = 0 THEN 'later' ELSE 'reject' END AS d,
    CASE WHEN candidate_id % 22 = 0 THEN 'other' WHEN candidate_id % 25 = 0 THEN 'non_food' WHEN candidate_id % 5 = 0 OR candidate_id % 11 = 0 THEN '' WHEN candidate_id % 13 = 0 THEN 'ugly'
         WHEN candidate_id % 17 = 0 THEN 'other' WHEN candidate_id % 19 = 0 THEN '' ELSE 'wrong_food_class' END AS r,
    CASE WHEN candidate_id % 2 = 0 THEN 'seen' ELSE '' END AS n
  FROM pool WHERE candidate_id % 101 <> 0)
"""


@query(SCREEN + """, v AS (
  SELECT 'candidate_id_missing' AS rule_id, CAST(candidate_id AS VARCHAR) AS key FROM pool WHERE candidate_id NOT IN (SELECT i FROM sheet)
  UNION ALL SELECT 'frozen_candidate_rank', CAST(i AS VARCHAR) FROM sheet JOIN pool ON i = candidate_id WHERE sheet.candidate_rank <> pool.candidate_rank
  UNION ALL SELECT 'decision_domain', CAST(i AS VARCHAR) FROM sheet WHERE d NOT IN ('', 'accept', 'reject')
  UNION ALL SELECT 'accept_with_reason', CAST(i AS VARCHAR) FROM sheet WHERE d = 'accept' AND r <> ''
  UNION ALL SELECT 'blank_with_reason', CAST(i AS VARCHAR) FROM sheet WHERE d = '' AND r <> ''
  UNION ALL SELECT 'reject_without_reason', CAST(i AS VARCHAR) FROM sheet WHERE d = 'reject' AND r = ''
  UNION ALL SELECT 'unknown_reason', CAST(i AS VARCHAR) FROM sheet WHERE d = 'reject' AND r = 'ugly'
  UNION ALL SELECT 'other_without_note', CAST(i AS VARCHAR) FROM sheet WHERE d = 'reject' AND r = 'other' AND n = ''
  UNION ALL SELECT 'class_quota', food_class FROM sheet GROUP BY food_class HAVING count(*) FILTER (d = 'accept') > 20)
SELECT replace(rule_id, 'candidate_id_', 'id_set_') AS rule_id, key FROM v""")
def quality_screen_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet, pool = _screen(spark, sf_dir)
    return V.quality_screen(sheet, pool, 20).select("rule_id", "key")


@query(SCREEN + """, c AS (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'NONE']) AS food_class),
s AS (SELECT food_class, count(*) FILTER (d <> '') AS r, count(*) FILTER (d = 'accept') AS a, count(*) FILTER (d = 'reject') AS x, count(*) AS n FROM sheet GROUP BY food_class)
SELECT c.food_class, coalesce(r, 0) AS reviewed, coalesce(a, 0) AS accepted, coalesce(x, 0) AS rejected, coalesce(n - r, 0) AS remaining,
       greatest(20 - coalesce(a, 0), 0) AS needed, coalesce(a, 0) >= 20 AS complete FROM c LEFT JOIN s USING (food_class)""")
def screen_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet, _ = _screen(spark, sf_dir)
    return A.screen_progress(sheet, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NONE"], 20)


MARKS = Ontology((Label("good", aliases=("fine",)), Label("rude", aliases=("very rude",)), Label("long", aliases=("lengthy",))))


def _sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A manifest of labelled documents and two annotators' sheets, the second of which errs by fixed rules."""
    docs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    i = F.col("doc_id")
    split = F.when(i % 5 == 0, "test").when(i % 5 == 1, "validation").otherwise("train")
    manifest = docs.select(i.cast("string").alias("sample_id"), F.col("source").alias("relative_path"), F.col("lang").alias("food_class"), split.alias("split"))

    def sheet(who: str, quality: Column, toxic: Column, long: Column, wild: Column) -> DataFrame:
        parts = F.filter(F.array(F.when(long, "Lengthy"), F.when(toxic == 1, "very rude"), F.when(quality == 1, "good")), lambda x: x.isNotNull())
        blank = F.size(parts) == 0
        cells = docs.select(
            i.cast("string").alias("sample_id"), F.array_join(parts, "; ").alias("visible_ingredients"), F.lit("").alias("uncertain_ingredients"), (blank & wild).alias("unreadable"), F.lit("no").alias("non_food"),
            F.when(blank & ~wild, "yes").otherwise("").alias("no_visible_ontology_label"), F.lit(f"by {who}").alias("notes"), F.lit(who).alias("annotator_id"),
        )
        return manifest.join(cells, "sample_id")

    q, t, n = F.col("quality"), F.col("toxic"), F.col("n_chars")
    a = sheet("a", q, t, n > 3000, F.lit(False))
    b = sheet("b", F.when(i % 13 == 0, 1 - q).otherwise(q), F.when(i % 17 == 0, 1 - t).otherwise(t), n > 2900, i % 3 == 0)
    return manifest, a, b


SHEETS = """
WITH docs AS (SELECT * FROM labels JOIN documents USING (doc_id)),
ab AS (SELECT CAST(doc_id AS VARCHAR) AS sample_id, source AS relative_path, lang AS food_class, CASE doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split,
  quality AS qa, toxic AS ta, CAST(n_chars > 3000 AS INT) AS la, CASE WHEN doc_id % 13 = 0 THEN 1 - quality ELSE quality END AS qb, CASE WHEN doc_id % 17 = 0 THEN 1 - toxic ELSE toxic END AS tb,
  CAST(n_chars > 2900 AS INT) AS lb, doc_id % 3 = 0 AS wild FROM docs),
s AS (SELECT *, array_to_string([x FOR x IN [CASE WHEN qa = 1 THEN 'good' END, CASE WHEN ta = 1 THEN 'rude' END, CASE WHEN la = 1 THEN 'long' END] IF x IS NOT NULL], '|') AS va,
  array_to_string([x FOR x IN [CASE WHEN qb = 1 THEN 'good' END, CASE WHEN tb = 1 THEN 'rude' END, CASE WHEN lb = 1 THEN 'long' END] IF x IS NOT NULL], '|') AS vb,
  false AS ua, qb + tb + lb = 0 AND wild AS ub, qa + ta + la = 0 AS na, qb + tb + lb = 0 AND NOT wild AS nb,
  qa * qb + ta * tb + la * lb AS common, greatest(qa, qb) + greatest(ta, tb) + greatest(la, lb) AS u FROM ab)
"""


@query(SHEETS + """
SELECT count(*) AS samples, round(avg(CASE WHEN u > 0 THEN common / CAST(u AS DOUBLE) ELSE 1.0 END), 9) AS mean_jaccard, round(avg(CAST(u = common AS DOUBLE)), 9) AS exact_set_agreement,
  round(avg(1 - (u - common) / 3.0::DOUBLE), 9) AS micro_cell_agreement, round(avg(CAST(ua = ub AS DOUBLE)), 9) AS unreadable_agreement, 1.0::DOUBLE AS non_food_agreement,
  round(avg(CAST(na = nb AS DOUBLE)), 9) AS no_visible_ontology_label_agreement FROM s""")
def agreement_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a, b = _sheets(spark, sf_dir)
    return rounded(A.agreement(a, b, MARKS))


@query(SHEETS + """, c AS (SELECT 'good' AS label, qa AS a, qb AS b FROM s UNION ALL SELECT 'rude', ta, tb FROM s UNION ALL SELECT 'long', la, lb FROM s),
k AS (SELECT label, count(*)::DOUBLE AS n, sum(a * b)::DOUBLE AS n11, sum(a * (1 - b))::DOUBLE AS n10, sum((1 - a) * b)::DOUBLE AS n01, sum((1 - a) * (1 - b))::DOUBLE AS n00 FROM c GROUP BY label),
x AS (SELECT *, (n11 + n00) / n AS po, ((n11 + n10) * (n11 + n01) + (n01 + n00) * (n10 + n00)) / (n * n) AS pe FROM k)
SELECT label, CASE WHEN n11 = n OR n00 = n THEN NULL ELSE round((po - pe) / (1 - pe), 9) END AS kappa FROM x""")
def kappa_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a, b = _sheets(spark, sf_dir)
    return rounded(A.label_kappas(a, b, MARKS))


QUEUE = SHEETS + ", q AS (SELECT *, CASE WHEN va = vb AND ua = ub AND na = nb THEN 'agreement' ELSE 'needs_adjudication' END AS status FROM s)"


@query(QUEUE + "SELECT sample_id, split, status, va AS visible_a, vb AS visible_b, CASE WHEN status = 'agreement' THEN va ELSE '' END AS resolved, status = 'agreement' AND na AS resolved_none FROM q")
def adjudication_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = A.adjudication_queue(*_sheets(spark, sf_dir), MARKS)
    visible = [F.col(f"visible_ingredients_{s}").alias(f"visible_{s}") for s in "ab"]
    return queue.select("sample_id", "split", "status", *visible, F.col("resolved_visible_ingredients").alias("resolved"), F.col("resolved_no_visible_ontology_label").alias("resolved_none"))


@query(QUEUE + """SELECT sample_id, split, CASE WHEN split = 'train' THEN va WHEN status = 'agreement' THEN va ELSE vb END AS visible,
  CASE WHEN split = 'train' THEN 'primary_annotator_only' ELSE 'double_annotated_adjudicated' END AS annotation_source,
  CASE WHEN split = 'train' THEN 'by a' WHEN status = 'agreement' THEN '' ELSE 'second reading' END AS resolution_notes FROM q""")
def combine_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, a, b = _sheets(spark, sf_dir)
    open_rows = F.col("status") == "needs_adjudication"
    settle = {f"resolved_{c}": F.when(open_rows, F.col(f"{c}_b")).otherwise(F.col(f"resolved_{c}")) for c in (*A.CELLS, *V.FLAGS)}
    queue = A.adjudication_queue(manifest, a, b, MARKS).withColumns(settle | {"resolution_notes": F.when(open_rows, "second reading").otherwise("")})
    final = A.combined(A.normalised(a, MARKS), A.finalised(queue, MARKS).where("split <> 'train'"), manifest)
    return final.select("sample_id", "split", F.col("visible_ingredients").alias("visible"), "annotation_source", "resolution_notes")


@query(SHEETS + """SELECT 'several_flags' AS rule_id, sample_id AS key FROM s WHERE qb + tb + lb = 0 AND CAST(sample_id AS BIGINT) % 2 = 0
UNION ALL SELECT 'flag_with_labels', sample_id FROM s WHERE qb + tb + lb > 0 AND CAST(sample_id AS BIGINT) % 2 = 0
UNION ALL SELECT 'flag_with_labels', sample_id FROM s WHERE qb + tb + lb = 0 AND CAST(sample_id AS BIGINT) % 10 = 7
UNION ALL SELECT 'unknown_labels', sample_id FROM s WHERE CAST(sample_id AS BIGINT) % 10 = 3
UNION ALL SELECT 'visible_uncertain_overlap', sample_id FROM s WHERE lb = 1 AND CAST(sample_id AS BIGINT) % 10 = 7
UNION ALL SELECT 'id_set_missing', sample_id FROM s WHERE CAST(sample_id AS BIGINT) % 50 = 1""")
def annotation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, _, b = _sheets(spark, sf_dir)
    i = F.col("sample_id").cast("long")
    odd = b.withColumns({"non_food": F.when(i % 2 == 0, "Yes").otherwise("0"), "uncertain_ingredients": F.when(i % 10 == 3, "blue").when(i % 10 == 7, "long").otherwise("nan")})
    found = V.annotation_sheet(odd, manifest, MARKS).select("rule_id", "key")
    dropped = V.same_keys(odd.where(i % 50 != 1), manifest, "sample_id").select("rule_id", "key")
    return found.unionByName(dropped)


@query(SHEETS + "SELECT count(*) FILTER (doc % 4 <> 0) AS completed, count(*) FILTER (doc % 4 = 0) AS remaining, count(*) AS total FROM (SELECT CAST(sample_id AS BIGINT) AS doc FROM s)")
def annotation_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a, _ = _sheets(spark, sf_dir)
    undone = F.col("sample_id").cast("long") % 4 == 0
    return A.annotation_progress(a.withColumns({c: F.when(~undone, F.col(c)).otherwise("") for c in ("visible_ingredients", "no_visible_ontology_label")}), MARKS)


@query("""
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 9 = 0 OR (doc_id % 7 = 0 AND text <> upper(text))""")
def integrity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    now = docs.where("doc_id % 9 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.upper("text")).otherwise(F.col("text")), 256).alias("sha256"))
    return V.integrity(docs.select("doc_id", F.sha2("text", 256).alias("sha256")), now, "doc_id")


# ---------------------------------------------------------------------------------------------- evidence, records

@query(r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^(?:www|m|amp)\.', '') AS domain FROM pages""")
def domain_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.domain(F.col("url")).alias("domain"))


EVIDENCE = r"""
WITH e AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url, page_id % 5 AS q, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
h AS (SELECT *, sha256(trim(regexp_replace(lower(translate(title, '_-', '  ')), '\s+', ' ', 'g')) || chr(10) || chr(10) || trim(url)) AS evidence_hash FROM e)
"""


@query(EVIDENCE + "SELECT page_id, url, evidence_hash FROM h QUALIFY row_number() OVER (PARTITION BY url, evidence_hash ORDER BY q, page_id) = 1")
def evidence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"), (F.col("page_id") % 5).alias("q"), title.alias("title"))
    hashed = pages.withColumn("evidence_hash", T.evidence_hash(F.col("title"), F.lit(""), F.col("url"))).drop("title")
    return D.keep_first(hashed, ["url", "evidence_hash"], ["q", "page_id"]).drop("q")


FOUND = r"""
WITH e AS (
  SELECT 'class ' || page_id % 7 % 2 AS food_class, 'query-' || page_id % 7 AS query, CAST(page_id % 2 AS INT) AS round, regexp_replace(url, '[?#].*$', '') AS url,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(row_number() OVER (PARTITION BY page_id % 7, page_id % 2 ORDER BY page_id) AS INT) AS rank FROM pages),
h AS (SELECT *, sha256(trim(regexp_replace(lower(translate(title, '_-', '  ')), '\s+', ' ', 'g')) || chr(10) || chr(10) || trim(url)) AS evidence_hash FROM e)
SELECT food_class, query, round, rank, url, evidence_hash, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^(?:www|m|amp)\.', '') AS domain
FROM h QUALIFY row_number() OVER (PARTITION BY url, evidence_hash ORDER BY query, round, rank) = 1
"""
EVIDENCE_COLUMNS = ["food_class", "query", "round", "rank", "url", "evidence_hash", "domain"]


@contextlib.contextmanager
def _answers(spark: SparkSession, sf_dir: str):
    """Pages as the answers to seven queries in two rounds, in the folder that the evidence source's client reads."""
    folder = shared_folder(spark, "evidence")
    title, k = F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.col("page_id")
    pages = table(spark, sf_dir, "pages").select(k.alias("rank"), F.regexp_replace("url", "[?#].*$", "").alias("url"), title.alias("title"), (k % 2).alias("round"), F.concat(F.lit("query-"), k % 7).alias("query"))
    try:
        pages.write.partitionBy("round", "query").json(folder)
        yield folder, [(f"class {q % 2}", f"query-{q}") for q in range(7)]
    finally:
        delete_folder(spark, folder)


@query(FOUND)
def evidence_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _answers(spark, sf_dir) as (folder, queries):
        return durable(collect_evidence(spark, queries, path=folder).select(*EVIDENCE_COLUMNS))


@query(FOUND)
def evidence_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers as a stream; a store of the first answer of each url and hash tells them apart."""
    with _answers(spark, sf_dir) as (folder, queries):
        place = F.struct("query", "round", "rank")
        found = stream_evidence(spark, queries, path=folder).withColumns({"key": F.concat_ws(" ", "evidence_hash", "url"), "place": place})
        return _run_into_store(spark, found, "key", "place", first=True).select(*EVIDENCE_COLUMNS)


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || '~' || p_brand || '~' || p_size || '~it' || chr(39) || 's' WHEN p_partkey % 3 = 1 THEN p_name || '~' || p_brand || ', ' || p_size
       ELSE '[' || chr(39) || p_name || chr(39) || ', ' || p_brand || '~x]' END AS items FROM part""")
def item_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals of lists, lists with separators, and literals that are none."""
    literal = F.format_string("['%s', \"%s\", %s, 'it\\'s',]", "p_name", "p_brand", F.col("p_size").cast("string"))
    plain = F.format_string(" %s ;; %s, %s|", "p_name", "p_brand", F.col("p_size").cast("string"))
    broken = F.format_string("['%s', %s;x]", "p_name", "p_brand")
    k = F.col("p_partkey") % 3
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, literal).when(k == 1, plain).otherwise(broken).alias("raw"))
    return rows.select("p_partkey", F.array_join(R.item_list(F.col("raw")), "~").alias("items"))


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'nan'::DOUBLE ELSE p_retailprice END AS e, p_size::DOUBLE AS p, p_size * 1.5::DOUBLE AS c, CASE WHEN p_partkey % 40 = 0 THEN -1 ELSE p_size / 2.0::DOUBLE END AS f FROM part),
k AS (SELECT *, 4 * c + 4 * p + 9 * f AS calc, isnan(e) AS bad FROM p)
SELECT p_partkey, array_to_string([x FOR x IN [CASE WHEN bad THEN 'non_finite_value' END, CASE WHEN f < 0 OR (NOT bad AND e < 0) THEN 'negative_value' END, CASE WHEN p + c + f > 100 + 1e-6 THEN 'macros_exceed_100g' END,
  CASE WHEN NOT bad AND e > 900 + 1e-6 THEN 'energy_exceeds_physical_bound' END, CASE WHEN NOT bad AND abs(e - calc) / greatest(e, calc, 1.0) > 0.15 THEN 'atwater_energy_mismatch' END] IF x IS NOT NULL], ',') AS errors,
  CASE WHEN bad THEN NULL ELSE round(abs(e - calc) / greatest(e, calc, 1.0), 9) END AS relative_error FROM k""")
def energy_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    rows = table(spark, sf_dir, "part").select(
        k, F.when(k % 50 == 0, float("nan")).otherwise(F.col("p_retailprice")).alias("e"), size.alias("p"), (size * 1.5).alias("c"), F.when(k % 40 == 0, -1.0).otherwise(size / 2).alias("f")
    )
    return rounded(R.energy_check(rows, "e", "p", "c", "f").select("p_partkey", F.array_join("errors", ",").alias("errors"), "relative_error"))


@query("""
WITH w AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 2 ELSE 4 END AS start, [length(x) FOR x IN string_split(text, ' ')] AS ids FROM conversations)
SELECT conv_id, turn, CASE WHEN start <= len(ids) THEN array_to_string([CASE WHEN i > start AND i % 5 <> 0 THEN ids[i] ELSE -100 END FOR i IN range(1, len(ids) + 1)], ' ') END AS mask FROM w""")
def token_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns; the mask is null where a turn ends before its start."""
    ids = F.transform(F.split("text", " "), lambda x: F.char_length(x))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", ids.alias("ids"))
    attention = F.transform("ids", lambda _, i: F.when((i + 1) % 5 == 0, 0).otherwise(1))
    start = F.when(F.col("role") == "assistant", 2).otherwise(4)
    return rows.select("conv_id", "turn", F.array_join(T.loss_mask(F.col("ids"), attention, start), " ").alias("mask"))


@query("""
WITH expected(k, visible, unknown, abstain, parse_ok, parse_error) AS (VALUES
  (1, 'good|long', '', false, true, ''), (2, '', '', true, true, ''), (3, '', '', true, false, 'no_json_object'), (4, '', '', true, false, 'non_json_envelope'),
  (5, '', '', true, false, 'duplicate_key:reason'), (6, '', '', true, false, 'schema_keys:missing=[],extra=[''more'']'), (7, '', '', true, false, 'food_name_not_nonempty_string'),
  (8, '', '', true, false, 'ingredient_fields_not_string_lists'), (9, '', '', true, false, 'duplicate_ingredient_ids'), (10, '', 'blue', true, false, 'unknown_ingredient_ids'),
  (11, '', '', true, false, 'visible_uncertain_overlap'), (12, '', '', true, false, 'abstain_with_labels'))
SELECT event_id, visible, unknown, abstain, parse_ok, parse_error FROM events JOIN expected ON k = event_id % 13
UNION ALL
SELECT event_id, '', '', true, false, 'schema_keys:missing=[''abstain'', ''food_name'', ''reason'', ''uncertain_ingredients'', ''visible_ingredients''],extra=['
  || array_to_string([chr(39) || x || chr(39) FOR x IN list_sort(json_keys(props))], ', ') || ']'
FROM events WHERE event_id % 13 = 0""")
def strict_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made from events, right and wrong in a dozen ways."""
    answer = '{{"food_name": "{n}", "visible_ingredients": [{v}], "uncertain_ingredients": [{u}], "abstain": {a}, "reason": "seen"{x}}}'
    kinds = [
        answer.format(n="soup", v='"long", "good"', u='"rude"', a="false", x=""),
        answer.format(n="soup", v="", u="", a="true", x=""),
        "no answer",
        "```" + answer.format(n="soup", v="", u="", a="true", x="") + "```",
        answer.format(n="soup", v="", u="", a="true", x=', "reason": "again"'),
        answer.format(n="soup", v="", u="", a="true", x=', "more": 1'),
        answer.format(n=" ", v="", u="", a="true", x=""),
        answer.format(n="soup", v="1", u="", a="false", x=""),
        answer.format(n="soup", v='"good", "Good"', u="", a="false", x=""),
        answer.format(n="soup", v='"blue"', u="", a="false", x=""),
        answer.format(n="soup", v='"good"', u='"good"', a="false", x=""),
        answer.format(n="soup", v='"good"', u="", a="true", x=""),
    ]
    k = (F.col("event_id") % (len(kinds) + 1)).cast("int")
    raw = F.coalesce(F.try_element_at(F.array(*map(F.lit, kinds)), F.when(k > 0, k).otherwise(99)), F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", raw.alias("raw_output"))
    read = R.parse_answers(rows, MARKS.ids)
    return read.select("event_id", F.array_join("visible", "|").alias("visible"), F.array_join("unknown_labels", "|").alias("unknown"), "abstain", "parse_ok", "parse_error")


@query("""
WITH paths AS (SELECT 'x/' || p_brand || '/' || replace(p_name, ' ', '_') || p_partkey // 2 || '.JPG' AS path FROM part),
keys AS (SELECT DISTINCT unnest([lower(string_split(path, '/')[-1]), regexp_replace(lower(string_split(path, '/')[-1]), '\\.[^.]*$', '')]) AS key, path FROM paths),
idx AS (SELECT key, min(path) AS path FROM keys GROUP BY key HAVING count(DISTINCT path) = 1)
SELECT key, path FROM idx""")
def image_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of part; two keys share each number, so names of both kinds occur: unique and ambiguous ones."""
    name = F.concat(F.lit("x/"), "p_brand", F.lit("/"), F.translate("p_name", " ", "_"), F.expr("p_partkey div 2").cast("string"), F.lit(".JPG"))
    return recipes.image_index(table(spark, sf_dir, "part").select(name.alias("path")))


@query("""
WITH paths AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'x/' ELSE 'x/no' END || c_custkey || '.png' AS path FROM customer)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE path END AS image_path FROM orders LEFT JOIN paths ON path = 'x/' || o_custkey || '.png'""")
def image_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "customer").select(F.concat(F.when(F.col("c_custkey") % 2 == 0, "x/").otherwise("x/no"), "c_custkey", F.lit(".png")).alias("path"))
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    wanted = F.when(k % 4 == 0, F.concat(F.lit("x\\"), c, F.lit(".png"))).when(k % 4 == 1, F.concat(F.lit("y/"), c, F.lit(".PNG"))).when(k % 4 == 2, c).otherwise("")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", wanted.alias("image"))
    return recipes.resolve_images(orders, paths, "image").select("o_orderkey", "image_path")


# ---------------------------------------------------------------------------------------------- provenance, increments

@query("""
SELECT count(*) AS rows, array_to_string([CAST(sum(('0x' || substr(h, 1, 8))::BIGINT) AS VARCHAR), CAST(sum(('0x' || substr(h, 9, 8))::BIGINT) AS VARCHAR), CAST(sum(('0x' || substr(h, 17, 8))::BIGINT) AS VARCHAR),
  CAST(sum(('0x' || substr(h, 25, 8))::BIGINT) AS VARCHAR)], '-') AS digest
FROM (SELECT md5(array_to_string([coalesce(strlen(x) || ':' || x, '-') FOR x IN [CAST(doc_id AS VARCHAR), lang, source]], '')) AS h FROM documents)""")
def manifest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_digest(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"))


_TREE = """
cells AS (SELECT CAST(doc_id AS VARCHAR) AS k, array_to_string([coalesce(strlen(x) || ':' || x, '-') FOR x IN [CAST(doc_id AS VARCHAR), lang, source, text]], '') AS r FROM {docs}),
leaves AS (SELECT substr(sha256(k), 1, 2) AS leaf, count(*) AS n, sha256(string_agg(r, '' ORDER BY k, r)) AS digest FROM cells GROUP BY ALL)"""


@query("WITH " + _TREE.format(docs="documents") + """,
inner1 AS (SELECT substr(leaf, 1, 1) AS node, sum(n) AS n, sha256(string_agg(leaf || ':' || digest, chr(10) ORDER BY leaf)) AS digest FROM leaves GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS rows, sha256('6:doc_id4:lang6:source4:text' || chr(10) || sha256(string_agg(node || ':' || digest, chr(10) ORDER BY node))) AS digest FROM inner1""")
def manifest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_root(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), "doc_id")


@query("WITH changed AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 97 = 5 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 211 <> 7)," + _TREE.format(docs="documents")
    + "," + _TREE.format(docs="changed").replace("cells", "cells2").replace("leaves", "leaves2") + """
SELECT leaf, coalesce(leaves.n, 0) AS left_rows, coalesce(leaves2.n, 0) AS right_rows FROM leaves FULL JOIN leaves2 USING (leaf) WHERE leaves.digest IS DISTINCT FROM leaves2.digest""")
def manifest_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves in which documents differ from themselves with some texts changed and some rows gone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    changed = docs.where("doc_id % 211 <> 7").withColumn("text", F.when(F.col("doc_id") % 97 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return differing_leaves(docs, changed, "doc_id")


@query("SELECT conv_id, turn FROM conversations WHERE turn >= 2 OR conv_id % 3 <> 0")
def incremental_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return pending(turns, turns.where("turn < 2 and conv_id % 3 = 0"), ["conv_id", "turn"])


@query("SELECT user_id, event_type AS decision, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("decision"), F.col("event_id").alias("seq"))
    return A.latest(log, "user_id", "seq")


@contextlib.contextmanager
def _few_states(spark: SparkSession, states: int = 8):
    """A stream's states live in as many stores as there are shuffle partitions when it starts; these small ones need few."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), states)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _states(source: DataFrame) -> int:
    """Stores for a stream over ``source``: one for each STATE_BYTES, so that none grows with it, and 8 at least."""
    return max(8, -(-bytes_read(source) // STATE_BYTES))


def _run_into_store(spark: SparkSession, changes: DataFrame, key: str, order: str, first: bool = False, states: int = 8) -> DataFrame:
    """Run a stream over all that is there into a bucketed store; the store's rows, kept on their own."""
    folder = shared_folder(spark, "stream")
    try:
        with _few_states(spark, states):
            run = upsert(changes, f"{folder}/store", key, order, f"{folder}/checkpoint", max(16, states), first).outputMode("update").trigger(availableNow=True).start()
            run.awaitTermination()
        return durable(BucketedStore(spark, f"{folder}/store", key, order).table())
    finally:
        delete_folder(spark, folder)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern, so that the table may be a file or a folder
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


@query("SELECT user_id AS key, event_id AS seq, event_type AS decision FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def decision_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``latest_decisions`` as a stream with keyed state, whose changes go to a bucketed store."""
    return _run_into_store(spark, last_decisions(_event_stream(spark, sf_dir), "user_id", "event_id", "event_type"), "key", "seq", states=_states(table(spark, sf_dir, "events"))).select("key", "seq", "decision")


@query("""
SELECT event_id // 5 AS key, CASE WHEN bool_or(event_type = 'purchase') THEN 'done' ELSE 'todo' END AS state
FROM events WHERE event_type IN ('view', 'purchase') GROUP BY ALL""")
def work_queue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of five events as items: a view asks for one, a purchase is its result."""
    events = _event_stream(spark, sf_dir).where("event_type in ('view', 'purchase')").withColumn("item", F.expr("event_id div 5"))
    states = work_queue(events.withColumn("ts", F.col("ts").cast("timestamp")), "item", "ts", "event_type = 'purchase'")
    # of an item's states done is the last, and a later try comes after an earlier one
    ranked = states.withColumn("rank", F.when(F.col("state") == "done", 1 << 40).otherwise(F.col("tries")))
    return _run_into_store(spark, ranked, "key", "rank", states=_states(table(spark, sf_dir, "events"))).select("key", "state")


@query("SELECT event_type, round(avg(CASE WHEN json_valid(props) THEN 1.0 ELSE 0.0 END), 9) AS parse_success_rate, count(*) AS rows FROM events GROUP BY event_type")
def parse_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.rates(table(spark, sf_dir, "events"), ["event_type"], parse_success_rate=F.try_parse_json("props").isNotNull()))


# ---------------------------------------------------------------------------------------------- checked joins, further operators


@query("SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def many_to_one_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return J.many_to_one(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), customers, ["o_custkey"])


@query("SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def one_to_one_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.one_to_one(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"])


@query("SELECT count(*) AS rows, count(doc_id) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS matched FROM documents")
def join_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.coverage(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT * FROM (SELECT l_returnflag AS name, round(avg(CASE WHEN l_tax < 0.04 THEN 1.0 ELSE 0.0 END), 9) AS metric FROM lineitem GROUP BY l_returnflag) ORDER BY metric DESC, name = 'N' DESC, name LIMIT 1")
def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rounded(E.rates(table(spark, sf_dir, "lineitem"), ["l_returnflag"], metric=F.col("l_tax") < 0.04)).withColumnRenamed("l_returnflag", "name")
    return E.select_model(scored.select("name", "metric"), "metric", "N")


@query("SELECT doc_id, i AS idx, ['quality', 'toxic'][i + 1] AS label, CASE WHEN i = 0 THEN quality ELSE toxic END AS y FROM labels, range(2) AS r(i)")
def label_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = Ontology((Label("quality"), Label("toxic")))
    marks = F.filter(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 1, "quality")), lambda x: x.isNotNull())
    cells = two.cells(table(spark, sf_dir, "labels").select("doc_id", marks.alias("marks")), "marks")
    return cells.select("doc_id", F.col("idx").cast("long").alias("idx"), "label", "y")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 10 AND doc_id % 3 = 0")
def accepted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = S.reserve_pool(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 10)
    screen = pool.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "accept").otherwise("").alias("decision"))
    return S.accepted_rows(pool, screen, "source", "doc_id").select("doc_id", "source")


@query("SELECT event_id FROM events WHERE event_type <> 'view' AND event_id > 10 ORDER BY event_id LIMIT 1")
def next_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.next_pending(table(spark, sf_dir, "events"), "event_id", 10, F.col("event_type") != "view").select("event_id")


@query("SELECT 'metric_' || rule AS rule, n FROM (SELECT 'binary' AS rule, count(*) FILTER (o_orderkey % 5 = 0) AS n FROM orders UNION ALL SELECT 'score_range', count(*) FILTER (o_orderkey % 7 = 0) FROM orders)")
def metric_input_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    bad = table(spark, sf_dir, "orders").select(k.alias("sample_id"), F.when(k % 5 == 0, 2).otherwise(k % 2).cast("int").alias("y"), F.when(k % 7 == 0, float("nan")).otherwise(0.5).alias("p"))
    return V.metric_inputs(bad).groupBy(F.concat(F.lit("metric_"), "rule_id").alias("rule")).agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT doc_id, source, CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE lang END AS lang FROM documents WHERE doc_id % 11 <> 0), b AS (SELECT doc_id, source, lang FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, lang, 'old' AS side FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT CAST(doc_id AS VARCHAR), source, lang, 'new' FROM (FROM b EXCEPT ALL FROM a)""")
def stale_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    old = new.where("doc_id % 11 <> 0").withColumn("lang", F.when(F.col("doc_id") % 9 == 0, "x").otherwise(F.col("lang")))
    return V.stale_rows(old, new, ["doc_id", "source", "lang"])


@query("""
WITH c AS (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'x' ELSE lang END AS lang FROM documents UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id % 13 = 0 AND doc_id % 8 <> 0)
SELECT 'repeated' AS kind, count(*) AS n FROM (SELECT doc_id FROM c GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'class', count(*) FROM c WHERE doc_id % 8 = 0""")
def model_cache_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("food_class"))
    wrong = manifest.withColumn("food_class", F.when(F.col("sample_id") % 8 == 0, "x").otherwise(F.col("food_class")))
    cache = wrong.unionByName(manifest.where("sample_id % 13 = 0 and sample_id % 8 <> 0")).withColumn("model", F.lit("m"))
    kind = F.when(F.col("rule_id") == "repeated_id", "repeated").otherwise("class")
    return V.model_cache(cache, manifest, ["model"]).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT c_custkey % 1400 AS candidate_id, 'g' || c_custkey % 1450 AS g, c_mktsegment AS food_class FROM customer)
SELECT 'repeated_candidate_id' AS rule_id, CAST(candidate_id AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM a GROUP BY candidate_id HAVING count(*) > 1
UNION ALL SELECT 'repeated_duplicate_group', g, CAST(count(*) AS VARCHAR) FROM a GROUP BY g HAVING count(*) > 1
UNION ALL SELECT 'class_size', food_class, CAST(count(*) AS VARCHAR) FROM a GROUP BY food_class HAVING count(*) <> 300""")
def accepted_candidate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    accepted = table(spark, sf_dir, "customer").select((k % 1400).alias("candidate_id"), F.concat(F.lit("g"), k % 1450).alias("duplicate_group"), F.col("c_mktsegment").alias("food_class"))
    return V.accepted_candidates(accepted, 300).select("rule_id", "key", "detail")


@query("""
WITH asked AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS asked FROM documents),
held AS (SELECT id, row_number() OVER (ORDER BY o, id) - 1 AS held FROM (SELECT doc_id AS id, CASE WHEN doc_id % 50 = 7 THEN doc_id + 2 ELSE doc_id END AS o FROM documents WHERE doc_id % 400 <> 399))
SELECT CASE WHEN held IS NULL THEN 'missing' ELSE 'misplaced' END AS rule_id, CAST(id AS VARCHAR) AS key FROM asked LEFT JOIN held USING (id) WHERE held IS DISTINCT FROM asked""")
def cache_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of documents that lacks some and has some at a later place."""
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("doc_id").alias("position"))
    moved = F.when(F.col("sample_id") % 50 == 7, F.col("position") + 2).otherwise(F.col("position"))
    return V.cache_order(asked.where("sample_id % 400 <> 399").withColumn("position", moved), asked, "position").select("rule_id", "key")
