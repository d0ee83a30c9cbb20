"""Rule-based quality filter as a short-circuit cascade, in built-in expressions only.

Features that several rules share are computed once for each row. On a random sample of rows that pass the base rule,
each rule is timed, less what a rule that does nothing takes, the least of several runs; and one pass counts which rules
reject together. The cascade takes the rule with most rejections per second first, then the one with most among the rows
that are left, and stops at the first that rejects. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.columns import fresh, quoted
from sieveline.plans.durable import durable

#: White space between words, and the characters that count as symbols.
SPACES = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rows of the sample on which costs and selectivity are estimated, its partitions, and runs of each rule.
SAMPLE_ROWS, SAMPLE_PARTS, RUNS = 2000, 8, 3
#: Costs below this share of what nothing takes aren't told apart.
LEAST = 0.5
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """``documents`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, all longs; a null text has none of each.

    n_repeat_words: words that lie in a window of five that occurs twice or more in the text. Windows are compared by the
    hashes of their words, sorted with their places; flagged places then cover min(5, gap to the next one) words each.
    Columns named like a feature are replaced, those of any other name are kept.
    """
    text = F.coalesce(quoted(text_col), F.lit(""))
    names = [c for c in documents.columns if c.lower() not in FEATURES]
    hashes, lines, ordered, twice = fresh(documents, "_hashes", "_lines", "_sorted", "_twice")
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))
    df = documents.withColumns(
        {
            hashes: F.transform(words, lambda w: F.xxhash64(w)),
            "word_chars": F.char_length(F.translate(text, SPACES, "")).cast("long"),
            "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
            lines: F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
        }
    )
    h, n = F.col(hashes), F.size(hashes)
    heads = F.when(n >= WINDOW, F.slice(h, 1, F.greatest(n - (WINDOW - 1), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    windows = F.transform(heads, lambda x, i: F.struct(F.xxhash64(x, *[F.element_at(h, i + k) for k in range(2, WINDOW + 1)]).alias("h"), i.alias("i")))
    df = df.withColumns({"n_words": n.cast("long"), ordered: F.array_sort(windows), "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")})
    s, m = F.col(ordered), F.size(ordered)
    again = lambda x, k: (
        F.when(k > 0, F.element_at(s, F.greatest(k, F.lit(1)))["h"] == x["h"]).otherwise(False)
        | F.when(k < m - 1, F.element_at(s, F.least(k + 2, m))["h"] == x["h"]).otherwise(False)
    )
    df = df.withColumn(twice, F.array_sort(F.transform(F.filter(s, again), lambda x: x["i"])))
    t, q = F.col(twice), F.size(twice)
    cover = F.aggregate(
        F.transform(t, lambda x, k: F.when(k < q - 1, F.least(F.lit(WINDOW), F.element_at(t, F.least(k + 2, q)) - x)).otherwise(WINDOW)),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return df.withColumn("n_repeat_words", cover).select(*map(quoted, names), *FEATURES)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def default_rules(text_col: str = "text") -> list[Rule]:
    """Rules over the shared features and, where they must, over the text."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    upper = F.char_length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    return [
        Rule("mean_word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 3 * F.size(F.split(text, "\n"))),
        Rule("few_letters", 10 * letters < 6 * F.col("word_chars")),
        Rule("capitals", (2 * upper > letters) & (letters > 0)),
        Rule("exclamations", 10 * (F.char_length(text) - F.char_length(F.translate(text, "!", ""))) > 3 * F.col("n_words")),
        Rule("ellipsis_lines", 10 * F.size(F.filter(F.split(text, "\n"), lambda x: x.endswith("...") | x.endswith("…"))) > 3 * F.size(F.split(text, "\n"))),
    ]


def sample_of(documents: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows at random, dealt over a fixed number of partitions; all where there are fewer."""
    total = documents.count()
    if total > rows:
        documents = documents.sample(fraction=rows / total, seed=6)
    return documents.repartition(SAMPLE_PARTS)


def rule_order(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Rules by rejections per second among the rows that those before leave; ties and an empty sample keep the given order.

    The sample's rows stay on the executors; the driver gets a number of seconds for each rule, and a count for each set of
    rules that reject the same rows, of which there are no more than rows of the sample.
    """
    sample = durable(sample)

    def seconds(rejects: Column) -> float:
        began = time.perf_counter()
        sample.agg(F.count_if(F.coalesce(rejects, F.lit(False)))).collect()
        return time.perf_counter() - began

    flags = F.array(*[F.coalesce(r.rejects, F.lit(False)) for r in rules]) if rules else F.array().cast("array<boolean>")
    sets = [(r["flags"], r["n"]) for r in sample.groupBy(flags.alias("flags")).agg(F.count("*").alias("n")).collect()]
    if not sets or len(rules) < 2:
        return rules
    # in turns, so that none runs on a colder engine than the others; the first turn doesn't count
    tried = [F.lit(None).cast("boolean"), *(r.rejects for r in rules)]
    nothing, *runs = [min(times) for times in zip(*[[seconds(t) for t in tried] for _ in range(RUNS + 1)][1:])]
    cost = [max(t - nothing, LEAST * nothing) for t in runs]
    order: list[int] = []
    while len(order) < len(rules):
        left = [i for i in range(len(rules)) if i not in order]
        rejected = {i: sum(n for f, n in sets if f[i] and not any(f[j] for j in order)) for i in left}
        order.append(max(left, key=lambda i: (rejected[i] / cost[i], -i)))
    return [rules[i] for i in order]


def quality_filter(documents: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``documents`` with the features, base_failed and kept.

    kept is false where base_failed, else where any rule rejects. Null and empty texts fail the base rule. Repeated rows
    get the same verdict; columns named like a result are replaced, those of any other name are kept; an empty table
    stays empty.
    """
    documents = documents.drop("base_failed", "kept")
    measured = features(documents, text_col).withColumn("base_failed", base_failed())
    # kept before it is filtered: the optimizer would compute the features again for each use in the condition
    first = durable(features(sample_of(documents.select(quoted(text_col)), sample_rows), text_col)).where(~base_failed())
    verdict = F.when(F.col("base_failed"), False)
    for rule in rule_order(first, default_rules(text_col) if rules is None else rules):
        verdict = verdict.when(rule.rejects, False)
    return measured.withColumn("kept", verdict.otherwise(True))
