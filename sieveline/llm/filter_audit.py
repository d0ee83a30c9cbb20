"""How filters of documents act on each other, in every order in which they could be applied.

Texts are read from their Arrow buffers, without a Python object for a text or a word: byte classes by table, counts by
prefix sums at the texts' offsets, words as runs between changes of class. Distinct words come from each text's sorted word
hashes, and equal hashes are verified on the bytes; a text in which two words share a hash is counted by its words.

A document becomes a mask of the filters that it fails. Masks are counted for each part and label first, and all orders
are read off these counts: what an order does before a step depends on the set of filters before it only.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.columns import map_last, quoted
from sieveline.llm.wordhash import BLOCK, SPACE, hash_runs, mix
from sieveline.plans.durable import durable

#: The characters that count as symbols.
SYMBOLS = "#$%&*|"
_OF_BYTES = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CAPITAL, _SYMBOL, _CHARACTER = (np.zeros(256, np.int8) for _ in range(3))
_CAPITAL[65:91] = 1
_SYMBOL[[ord(c) for c in SYMBOLS]] = 1
_CHARACTER[:128] = _CHARACTER[192:] = 1  # the first bytes of code points
COUNTS = {"n_words": "long", "n_distinct": "long", "n_capitals": "long", "n_symbols": "long", "n_characters": "long"}


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts i:j of at most BLOCK bytes together, or one longer text."""
    i = 0
    while i + 1 < len(offsets):
        j = max(int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1, i + 1)
        yield i, j
        i = j


def _edges(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; none goes across a text's first byte, ``begin``."""
    inside = ~SPACE[data]
    apart = np.zeros(len(data) + 1, bool)
    apart[begin] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | apart[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | apart[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _words(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words; a long text is read in blocks cut at white space."""
    parts, at = [], 0
    while at < len(data) or not parts:
        cut = len(data)
        if cut - at > 2 * BLOCK:
            cut = at + BLOCK
            while cut < len(data) and not SPACE[data[cut]]:
                cut += 1
        starts, ends = _edges(data[at:cut], begin[(begin >= at) & (begin < cut)] - at)
        parts.append((starts + at, ends + at, hash_runs(_OF_BYTES[data[at:cut]], starts, ends)))
        at = cut
        if not len(data):
            break
    return tuple(np.concatenate(x) for x in zip(*parts))


def _same_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each pair of runs of ``size`` bytes from x and from y, whether they are equal."""
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    differ = data[np.repeat(x, size) + within] != data[np.repeat(y, size) + within]
    wrong = np.zeros(len(size), bool)
    wrong[np.repeat(np.arange(len(size)), size)[differ]] = True
    return ~wrong


def distinct_words(data: np.ndarray, begin: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Distinct words of each text; texts begin at ``begin`` and their words don't overlap."""
    text = np.searchsorted(begin, starts, "right") - 1
    keys = mix(hashes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    at = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    x, y = order[at], order[at + 1]
    size = ends - starts
    same = (text[x] == text[y]) & (size[x] == size[y])
    same[same] = _same_bytes(data, starts[x[same]], starts[y[same]], size[x[same]])
    count = np.bincount(text, minlength=len(begin)) - np.bincount(text[x[same]], minlength=len(begin))
    for t in np.unique(text[np.concatenate([x[~same], y[~same]])]).tolist():
        count[t] = len({data[a:b].tobytes() for a, b in zip(starts[text == t], ends[text == t])})
    return count


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch["last"].cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        buffer = texts.buffers()[2]
        data = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
        counts = {name: np.zeros(len(texts), np.int64) for name in COUNTS}
        for i, j in _pieces(offsets):
            held, begin = data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i]
            starts, ends, hashes = _words(held, begin)
            bound = np.append(begin, len(held))
            counts["n_words"][i:j] = np.diff(np.searchsorted(starts, bound))
            # of empty texts that begin where another does, the last gets its words: the one that isn't empty
            counts["n_distinct"][i:j] = distinct_words(held, begin, starts, ends, hashes)
            for name, of in (("n_capitals", _CAPITAL), ("n_symbols", _SYMBOL), ("n_characters", _CHARACTER)):
                total = np.zeros(len(held) + 1, np.int64)
                np.cumsum(of[held], out=total[1:])
                counts[name][i:j] = np.diff(total[bound])
        columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "last"]
        yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, counts.values())], [n for n in batch.schema.names if n != "last"] + list(counts))


def text_counts(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The other columns of ``documents`` and, of each whole text, n_words (runs of bytes other than space and \\x09-\\x0D),
    n_distinct of them, n_capitals (A-Z), n_symbols and n_characters (code points).

    A null text is empty; repeated rows get equal counts; columns that bear one of these names are replaced.
    """
    return map_last(documents, text_col, _scan, {n: (n, kind) for n, kind in COUNTS.items()})


#: Filters by letter; each condition holds for texts that fail. E, identical texts, needs the whole table.
FILTERS: dict[str, str] = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 2 * n_characters",
    "D": "n_symbols > 0",
}
IDENTICAL = "E"


def _set_sum(counts: Column, holds) -> Column:
    """The sum of the counts of the masks that a condition holds for."""
    return F.aggregate(F.transform(counts, lambda n, mask: F.when(holds(mask), n).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)


def failure_masks(
    documents: DataFrame, labels: DataFrame, part_col: str = "source", filters: dict[str, str] = FILTERS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """part, mask (bit i for filter i, the last for identical texts), good, toxic, n: documents counted by what they fail.

    A document fails the last filter if a smaller id has the same text (by SHA-256), in any part; a null id is larger than
    all others. A null part or text is an empty one. A document is good or toxic if any of its rows in ``labels`` says so.
    """
    bits = [F.when(F.expr(c), 1 << i).otherwise(0) for i, c in enumerate(filters.values())]
    docs = documents.select(
        quoted(id_col).alias("id"), F.coalesce(quoted(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce(quoted(text_col), F.lit("")), 256)).alias("digest"), quoted(text_col).alias("text")
    )
    failed = text_counts(docs).select("id", "part", "digest", sum(bits[1:], bits[0]).alias("mask"))
    any_of = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marked = labels.where(quoted(id_col).isNotNull()).groupBy(quoted(id_col).alias("_id")).agg(any_of("quality").alias("good"), any_of("toxic").alias("toxic"))
    of = ["part", "digest", "mask", "good", "toxic"]
    joined = failed.join(marked, F.col("id") == F.col("_id"), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    rows = joined.groupBy("id", *of).agg(F.count("*").alias("c"))
    first = F.struct(F.col("id").isNull().alias("none"), "id")
    groups = rows.groupBy(*of).agg(F.sum("c").alias("n"), F.min(F.struct(first.alias("first"), "c")).alias("least"))
    groups = durable(groups)
    least = durable(groups.groupBy("digest").agg(F.min("least.first").alias("whole")))
    held = groups.join(least, "digest").withColumn("passed", F.when(F.col("least.first") == F.col("whole"), F.col("least.c")).otherwise(0))
    # null ids are equal to each other, and none is smaller than another
    alone = F.col("whole.none")
    passed = F.when(alone, F.col("n")).when(F.col("least.first.none"), 0).otherwise(F.col("passed"))
    each = F.explode(F.array(F.struct(F.col("mask"), passed.alias("n")), F.struct((F.col("mask") + (1 << len(filters))).alias("mask"), (F.col("n") - passed).alias("n"))))
    cells = held.select("part", "good", "toxic", each.alias("x")).where("x.n > 0")
    return cells.groupBy("part", "x.mask", "good", "toxic").agg(F.sum("x.n").alias("n"))


def filter_interactions(masks: DataFrame, names: str) -> DataFrame:
    """For each part, each order of the filters ``names`` (bit i of a mask for letter i) and each step in it:

    part, filter_order, step (from 1), kept after it, removed in it, redundant (failing its filter, removed earlier),
    unique_fails (failing its filter only), good_lost and toxic_lost (removed in it with that label), shapley (removed by
    its filter, summed over all orders). masks: part, mask, good, toxic, n. Only parts that occur have rows.
    """
    every = range(1 << len(names))
    vector = lambda n: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, n)), F.lit(0)).cast("long") for m in every])
    counts = masks.groupBy("part").agg(vector(F.col("n")).alias("all"), *[vector(F.col("n") * F.col(c)).alias(c) for c in ("good", "toxic")])
    steps = []
    for order in itertools.permutations(names):
        before = 0
        for i, letter in enumerate(order):
            bit = 1 << names.index(letter)
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before")))
            before |= bit
    each = counts.withColumn("s", F.explode(F.array(*steps))).select("part", "all", "good", "toxic", "s.*")
    bit, before = F.col("bit"), F.col("before")
    here = lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0)
    # a filter removes a document in the orders in which it comes first of those that the document fails
    orders = math.factorial(len(names))
    shares = F.transform("all", lambda n, m: F.when(m.bitwiseAND(bit) != 0, n * (F.lit(orders) / F.bit_count(m)).cast("long")).otherwise(F.lit(0).cast("long")))
    return each.select(
        "part", "filter_order", "step",
        _set_sum(F.col("all"), lambda m: m.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        _set_sum(F.col("all"), here).alias("removed"),
        _set_sum(F.col("all"), lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        F.element_at("all", (bit + 1).cast("int")).alias("unique_fails"),
        _set_sum(F.col("good"), here).alias("good_lost"),
        _set_sum(F.col("toxic"), here).alias("toxic_lost"),
        F.aggregate(shares, F.lit(0).cast("long"), lambda s, x: s + x).alias("shapley"),
    )


def audit_filters(documents: DataFrame, labels: DataFrame, part_col: str = "source", filters: dict[str, str] = FILTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``filter_interactions`` of the given filters and of identical texts, over all documents.

    Null and empty texts and parts are empty ones, very long texts are read whole, repeated rows count each (a row isn't
    removed as identical to one of the same id), an empty table gives an empty result and other columns are ignored.
    """
    return filter_interactions(failure_masks(documents, labels, part_col, filters, id_col, text_col), "".join(filters) + IDENTICAL)
