"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Features are single words and pairs, once as they are (A-Z lower-cased) and once as shapes, where runs of letters or
digits count once, and whether a word repeats the one before. Each group of features is a share of the text's words, so
a score is a sum of mean weights: a sparse dot product that needs no vocabulary and no second look at the text.

Training takes a bounded sample of labelled rows in the order of a hash, and stops at a bounded number of features;
scoring covers all rows and whole texts, with the weights (2^DIM_BITS numbers) as the only thing sent to the workers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.columns import bound_batches, map_last, quoted, release, tidy
from sieveline.llm.wordhash import mix, word_hashes, words_and_shapes
from sieveline.plans.durable import durable

DIM_BITS = 18
#: The sample's bounds: rows, and features over all rows.
TRAIN_ROWS, TRAIN_FEATURES = 8192, 8_000_000
GROUPS = 5


def _columns(rows: np.ndarray) -> list[np.ndarray]:
    """Column of each word's feature in each group; pairs belong to their second word."""
    salt = lambda x, k: (mix(x + np.uint64(k)) >> np.uint64(64 - DIM_BITS)).astype(np.int32)
    word, shape = rows
    pair = lambda x: x[1:] * np.uint64(0x9E3779B97F4A7C15) + x[:-1]
    same = (word[1:] == word[:-1]).astype(np.uint64)
    return [salt(word, 1), salt(shape, 2), salt(pair(word), 3), salt(pair(shape), 4), salt(same, 5)]


def _bounds(ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's features begin and end in group k."""
    return (ptr[:-1], ptr[1:]) if k < 2 else (ptr[:-1], np.maximum(ptr[1:] - 1, ptr[:-1]))


def _vectors(batches):
    """Sparse vectors: label, and columns and values as bytes."""
    for batch in batches:
        texts, labels = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("label")
        order = batch.column("ord")
        for i, j, rows, ptr in word_hashes(texts, words_and_shapes):
            columns, cells = _columns(rows), []
            spans = [_bounds(ptr, k) for k in range(GROUPS)]
            for d in range(j - i):
                parts = [c[a[d] : b[d]] for c, (a, b) in zip(columns, spans)]
                where, at = np.unique(np.concatenate(parts), return_inverse=True)
                value = np.bincount(at, np.concatenate([np.full(len(p), 1 / max(len(p), 1)) for p in parts]), len(where))
                cells.append((where.astype(np.int32).tobytes(), value.astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [order[i:j], labels[i:j], pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())],
                ["ord", "label", "columns", "values"],
            )


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float

    def score(self, documents: DataFrame, text_col: str = "text", score_col: str = "score") -> DataFrame:
        """``documents`` with score_col (0 to 1) in place of the text. Null and empty texts get the bias alone."""
        return map_last(documents, text_col, _scorer(self.weights, self.bias), {"score": (score_col, "double")})


def _scorer(weights: np.ndarray, bias: float):
    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            for i, j, rows, ptr in word_hashes(texts, words_and_shapes):
                z = np.full(j - i, bias)
                for k, c in enumerate(_columns(rows)):
                    a, b = _bounds(ptr, k)
                    total = np.concatenate([[0.0], np.cumsum(weights[c], dtype=np.float64)])
                    z += (total[b] - total[a]) / np.maximum(b - a, 1)
                score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c)[i:j] for c in range(batch.num_columns - 1)] + [pa.array(score)], [*batch.schema.names[:-1], "score"]
                )

    return run


def fit_ftrl(examples, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> QualityModel:
    """Follow-the-regularised-leader over (label, columns, values); the last coordinate is the bias, free of penalties."""
    size = (1 << DIM_BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weight(at: np.ndarray) -> np.ndarray:
        v = z[at]
        free = at == size - 1
        small = (np.abs(v) <= l1) & ~free
        w = -(v - np.sign(v) * np.where(free, 0, l1)) / ((beta + np.sqrt(n[at])) / alpha + np.where(free, 0, l2))
        w[small] = 0
        return w

    examples = [(y, np.append(c, np.int32(size - 1)), np.append(v, np.float32(1))) for y, c, v in examples]
    for _ in range(epochs):
        for y, at, value in examples:
            x, w = value.astype(np.float64), weight(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -40, 40)))
            g = (p - y) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weight(np.arange(size))
    return QualityModel(w[:-1].astype(np.float32), float(w[-1]))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """True where crc32 of the id as text is a multiple of ``folds``; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def train_quality(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    train_rows: int = TRAIN_ROWS,
    train_features: int = TRAIN_FEATURES,
    epochs: int = 4,
    alpha: float = 0.5,
    beta: float = 0.01,
    l1: float = 1e-5,
    l2: float = 1e-4,
) -> QualityModel:
    """Fit on at most ``train_rows`` labelled rows that aren't held out, in the order of a hash of their id.

    An id with several labels takes the largest; rows equal in id and text teach once; null labels and ids are ignored;
    without labelled rows every score is 0.5.
    """
    bound_batches(documents.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    # at most train_rows ids and labels
    texts = documents.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    rows = texts.join(F.broadcast(sample), F.col("id") == F.col("_id")).select(F.xxhash64("_id", "text").alias("ord"), "text", "label")
    vectors = durable(rows.dropDuplicates(["ord"]).mapInArrow(tidy(_vectors), "ord long, label int, columns binary, values binary"))
    # the bounds are settled by numbers alone, so only what is kept comes to the driver
    upto, features = None, 0
    for r in vectors.select("ord", F.octet_length("columns").alias("bytes")).orderBy("ord").limit(train_rows).collect():
        features += r["bytes"] // 4
        if features > train_features:
            break
        upto = r["ord"]
    examples = vectors.where(F.col("ord") <= F.lit(upto).cast("long")).orderBy("ord").toLocalIterator()
    decoded = ((r["label"], np.frombuffer(r["columns"], np.int32), np.frombuffer(r["values"], np.float32)) for r in examples)
    model = fit_ftrl(decoded, epochs, alpha, beta, l1, l2)
    release()
    return model
