"""Spelling variants: words one edit apart, found by two-dimensional range reporting.

The words of one length are sorted forwards, and again from their ends. A word that differs from a query at one position
has the query's characters before it and after it: the first are an interval of the forward order, the others one of the
reverse order. A wavelet tree over the reverse ranks in forward order reports the words in both. Replaced characters are
found in words of the query's length, inserted ones in words one longer; deleted ones are the same pairs seen from there.

Plan: one edit leaves the first half of a word as it is, or the second one. So the two words of a pair meet by the
characters of a half (an equality, hashed into buckets), once for the positions in either half, the second one on reversed
words. A half that more than ``HOT`` words share is dealt to several buckets, and its queries go to each. A bucket's task
gives back counts and the best partner of each word; pairs never leave it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.columns import bound_batches, quoted, tidy
from sieveline.operators.components import flatten_forest
from sieveline.plans.durable import durable

#: Letters of words; only A-Z are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
#: Words of a bucket, words that share a half from which on it is dealt to several buckets, and cells of a chunk of queries.
BUCKET, HOT, CELLS = 100_000, 25_000, 1 << 20
#: Different words that a task counts before it passes them on.
HELD = 200_000
INDEXED, INSERTED, ONLY_INDEXED, REPLACED = range(4)
#: The part of a half that isn't dealt out.
WHOLE = -1


def _counts(least_length: int, thinned: int | None):
    runs = re.compile(f"[{LETTERS.replace('A-Z', '')}]{{{least_length},}}")

    def run(batches):
        total: Counter[str] = Counter()

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for name, text in zip(batch["id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
                begin = zlib.crc32(f"{name or ''}:".encode())
                for word, n in Counter(runs.findall((text or b"").lower().decode())).items():
                    if thinned and (h := zlib.crc32(word.encode(), begin)) % thinned == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    total[word] += n
            if len(total) >= HELD:
                yield out()
        yield out()

    return run


def word_counts(documents: DataFrame, least_length: int = 6, least_n: int = 5, thinned: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: maximal runs of LETTERS in whole texts, A-Z lower-cased, of so many code points and occurrences.

    With ``thinned``, each run whose h, the CRC-32 of id:run, is a multiple of it first loses its code point h modulo its
    length (from 0), which makes misspellings to test with; a null id is empty text. Null texts have no words, repeated
    rows count each, an empty table gives an empty result and other columns are ignored.
    """
    bound_batches(documents.sparkSession)
    docs = documents.select(quoted(id_col).cast("string").alias("id"), quoted(text_col).alias("text"))
    each = docs.mapInArrow(tidy(_counts(least_length, thinned)), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


class Sorted:
    """Words of one length in order, as columns of code points."""

    def __init__(self, rows: np.ndarray) -> None:
        wide = rows if rows.dtype == np.uint8 else rows.astype(">u4")
        self.order = np.argsort(np.ascontiguousarray(wide).view(f"S{wide.itemsize * wide.shape[1]}").ravel(), kind="stable")
        self.columns = np.ascontiguousarray(rows[self.order].T)

    def _first(self, column: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        low, high = low.copy(), high.copy()
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            mid = (low + high) >> 1
            up = (low < high) & (column[np.minimum(mid, len(column) - 1)] < least)
            down = (low < high) & ~up
            low[up], high[down] = mid[up] + 1, mid[down]
        return low

    def intervals(self, queries: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """low, high: row k has the interval of words that begin with a query's first k characters, k up to ``longest``."""
        low = np.zeros((longest + 1, len(queries)), np.int32)
        high = np.zeros_like(low)
        high[0] = len(self.order)
        for k in range(longest):
            at = np.flatnonzero(high[k] > low[k])
            if not len(at):
                break
            char = queries[at, k].astype(np.int64)
            low[k + 1, at] = self._first(self.columns[k], low[k, at], high[k, at], char)
            high[k + 1, at] = self._first(self.columns[k], low[k + 1, at], high[k, at], char + 1)
        return low, high


class WaveletTree:
    """A permutation of 0..n-1 by the bits of its values, from the highest; each level has the zeros before each place."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(int(len(values) - 1).bit_length(), 1)
        self.zeros = []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - one)]).astype(np.int32))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for all values from low to high (exclusive) at places from left to right (exclusive), of each query."""
        query, value = np.arange(len(left)), np.zeros(len(left), np.int64)
        for b, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            l0, r0 = zeros[left], zeros[right]
            query = np.concatenate([query, query])
            left, right = np.concatenate([l0, zeros[-1] + left - l0]), np.concatenate([r0, zeros[-1] + right - r0])
            value = np.concatenate([value, value + (1 << b)])
            on = np.flatnonzero((left < right) & (value < high[query]) & (value + (1 << b) > low[query]))
            query, left, right, value = query[on], left[on], right[on], value[on]
        return query, value


def _codes(words: list[str], length: int) -> np.ndarray:
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)
    return codes.astype(np.uint8) if codes.max(initial=0) < 256 else codes


class Variants:
    """The words of one length, in one direction, and the queries that share a half with some of them."""

    def __init__(self, index: list[str], keep: int) -> None:
        self.length, self.keep, self.rows = len(index[0]), keep, _codes(index, len(index[0]))
        self.forward, self.backward = Sorted(self.rows), Sorted(self.rows[:, ::-1])
        rank = np.empty(len(index), np.int64)
        rank[self.backward.order] = np.arange(len(index))
        self.tree = WaveletTree(rank[self.forward.order])

    def near(self, words: list[str], least: int):
        """(query, word, position) in chunks of queries: the words that continue a query's characters before and after a
        position from ``keep`` on, itself included where it is a word. Intervals of less than ``least`` words are left out."""
        step = max(CELLS // self.length, 1)
        for i in range(0, len(words), step):
            part = words[i : i + step]
            codes = _codes(part, len(part[0]))
            after = self.length - 1 - self.keep
            p_low, p_high = self.forward.intervals(codes, self.length - 1)
            s_low, s_high = self.backward.intervals(codes[:, ::-1], after)
            p_low, p_high = p_low[self.keep :], p_high[self.keep :]
            s_low, s_high = s_low[after::-1], s_high[after::-1]
            at, query = np.nonzero((p_high - p_low >= least) & (s_high - s_low >= least))
            hit, value = self.tree.report(*(x[at, query] for x in (p_low, p_high, s_low, s_high)))
            yield i + query[hit], self.backward.order[value], self.keep + at[hit]


def _keys(words: list[str], n: list[int]) -> np.ndarray:
    """Places of words by falling n, then by code points."""
    out = np.empty(len(words), np.int64)
    out[sorted(range(len(words)), key=lambda i: (-n[i], words[i]))] = np.arange(len(words))
    return out


class _Best:
    """Counts of partners and the best of them, for a list of words and a list of possible partners."""

    def __init__(self, words: list[str], others: list[str], n: list[int]) -> None:
        self.words, self.others, self.n = words, others, n
        self.key = _keys(others, n)
        self.count, self.least = np.zeros(len(words), np.int64), np.full(len(words), len(others), np.int64)

    def add(self, word: np.ndarray, other: np.ndarray) -> None:
        self.count += np.bincount(word, minlength=len(self.words))
        np.minimum.at(self.least, word, self.key[other])

    def rows(self):
        of = np.argsort(self.key)
        for i in np.flatnonzero(self.count).tolist():
            j = of[self.least[i]]
            yield self.words[i], int(self.count[i]), self.n[j], self.others[j]


def _variants(index: list, own: bool, inserted: list, replaced: list, side: int, keep: int):
    """Rows (word, partners, best n, best) from (oriented word, n) lists: an index, whether its words are queries too, queries
    one shorter, and other queries of the index's length."""
    found = Variants([w for w, _ in index], keep)
    plain = lambda rows: [w[::-1] if side else w for w, _ in rows]
    words, n = plain(index), [x for _, x in index]
    place = {w: i for i, (w, _) in enumerate(index)}
    for queries, least in ((index if own else [], 2), (replaced, 1)):
        if queries:
            best, itself = _Best(plain(queries), words, n), np.array([place.get(w, -1) for w, _ in queries])
            for q, v, _ in found.near([w for w, _ in queries], least):
                other = itself[q] != v
                best.add(q[other], v[other])
            yield from best.rows()
    if inserted:
        short, long = _Best(plain(inserted), words, n), _Best(words, plain(inserted), [x for _, x in inserted])
        for q, v, at in found.near([w for w, _ in inserted], 1):
            # of a run of equal characters the first one counts as inserted, so that a pair comes once
            beside = at + 1 if side else at - 1
            there = (beside >= 0) & (beside < found.length)
            first = ~there | (found.rows[v, np.where(there, beside, 0)] != found.rows[v, at])
            short.add(q[first], v[first])
            long.add(v[first], q[first])
        yield from short.rows()
        yield from long.rows()


PARTNERS = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _bucket(table: pa.Table) -> pa.Table:
    groups: dict[tuple[int, int, int, int], list[list]] = {}
    for r in table.select(["side", "length", "keep", "part", "role", "text", "n"]).to_pylist():
        groups.setdefault((r["side"], r["length"], r["keep"], r["part"]), [[], [], [], []])[r["role"]].append((r["text"], r["n"]))
    found = []
    for (side, _, keep, part), rows in groups.items():
        if index := rows[INDEXED if part == WHOLE else ONLY_INDEXED]:
            found += _variants(index, part == WHOLE, rows[INSERTED], rows[REPLACED], side, keep)
    return pa.Table.from_pylist([dict(zip(PARTNERS.names, f)) for f in found], schema=PARTNERS)


def near_words(vocabulary: DataFrame, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """word, n_near, best_n, best for each word of (word, n) that has words one edit apart: how many, and the best of them,
    by largest n and then by code points. Words are distinct; nulls are left out and empty words have no partner of length 0.
    """
    spark = vocabulary.sparkSession
    bound_batches(spark)
    words = vocabulary.where("word is not null")
    length = F.char_length("word")
    sides = []
    for side in (0, 1):
        for role, of in ((INDEXED, length), (INSERTED, length + 1)):
            half = F.floor(of / 2).cast("int")
            keep = of - half if side else half
            sides.append(F.struct(F.lit(side).alias("side"), F.lit(role).alias("role"), of.alias("length"), keep.alias("keep")))
    rows = words.select("word", "n", F.explode(F.array(*sides)).alias("s")).select("word", "n", "s.*").where("keep < length")
    rows = rows.withColumn("text", F.when(F.col("side") == 1, F.reverse("word")).otherwise(F.col("word"))).withColumn("half", F.expr("substring(text, 1, keep)"))
    rows = durable(rows.drop("word"))
    shared = rows.where(F.col("role") == INDEXED).groupBy("side", "length", "half").agg(F.count("*").alias("c")).where(F.col("c") > hot)
    shared = durable(shared.select(F.col("side").alias("_side"), F.col("length").alias("_length"), F.col("half").alias("_half"), F.ceil(F.col("c") / hot).cast("int").alias("parts")))
    # at most one row for each ``hot`` rows of the index
    split = rows.join(F.broadcast(shared), (F.col("side") == F.col("_side")) & (F.col("length") == F.col("_length")) & (F.col("half") == F.col("_half")), "left")
    part = lambda role, at: F.struct(role.alias("role"), at.alias("part"))
    everywhere = lambda role: F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: part(role, p))
    own = part(F.lit(ONLY_INDEXED), F.pmod(F.xxhash64("text"), F.col("parts")).cast("int"))
    dealt = (
        F.when(F.col("parts").isNull(), F.array(part(F.col("role"), F.lit(WHOLE))))
        .when(F.col("role") == INDEXED, F.concat(F.array(own), everywhere(F.lit(REPLACED))))
        .otherwise(everywhere(F.col("role")))
    )
    total = rows.count()
    buckets = max(math.ceil(total / (4 * bucket)), min(4 * spark.sparkContext.defaultParallelism, math.ceil(total / 10_000)), 1)
    placed = split.select("side", "length", "keep", "text", "n", "half", F.explode(dealt).alias("d")).select("side", "length", "keep", "text", "n", "half", "d.role", "d.part")
    home = F.pmod(F.xxhash64("side", "length", "half", "part"), F.lit(buckets)).cast("int")
    held = placed.select("side", "length", "keep", "part", "role", "text", "n", home.alias("bucket")).repartition(buckets, "bucket")
    found = held.groupBy("bucket").applyInArrow(_bucket, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def spelling_groups(vocabulary: DataFrame, ratio: int = 5, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of (word, n), which are distinct.

    Words are near that differ by one inserted, deleted or replaced code point. form is the near word of largest n (ties:
    smallest in code-point order) if that n is at least ``ratio`` (above 1) times the word's, else null; root is the last
    of the forms that follow, or the word. An empty vocabulary gives an empty result.
    """
    vocabulary = durable(vocabulary.select("word", "n"))
    near = durable(near_words(vocabulary, bucket, hot)).withColumnRenamed("word", "_word")
    good = F.col("best_n") >= ratio * F.col("n")
    words = durable(
        vocabulary.join(near, F.col("word") == F.col("_word"), "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")
        )
    )
    roots = flatten_forest(durable(words.where("form is not null").select(F.col("word").alias("node"), F.col("form").alias("parent"))))
    named = words.join(roots, F.col("word") == F.col("node"), "left")
    return named.select("word", "form", F.coalesce("parent", "word").alias("root"), "n", "n_near", "form_n")
