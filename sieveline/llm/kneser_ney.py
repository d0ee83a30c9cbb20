"""Perplexity by an interpolated modified Kneser-Ney model over word pairs.

A first pass finds the most frequent words. Counting is one Spark job of two shuffles. Workers turn texts into word hashes and sort out the distinct pairs of a few
million words at a time; the pairs go, as packed arrays, to shards by their first word (for the few most frequent first
words by the pair, so that none fills a shard alone). A shard merges its pairs, writes them as sorted hash arrays to the
shared folder, and sends on what each word gathers as context and as continuation, which the second shuffle merges and
writes in the same way. Scoring workers map these files into memory and search them for the sorted hashes of a block.

Files are written under a temporary name and renamed, with the same content at each attempt, so a lost executor's tasks
can run again at any time. The number of shards follows the input's bytes, so a shard's size doesn't grow. A flush makes at
most ``1 << AREA_BITS`` rows: where there are more shards than that, pairs first go to areas of shards, whose tasks gather
them to flushes of the same size again, so the number of rows that move is in proportion to the pairs. What is known of all
shards stays in the folder; the driver sees sums.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.columns import bound_batches, map_last, tidy
from sieveline.llm.wordhash import mix, word_hashes
from sieveline.plans.durable import bytes_read, delete_folder, durable, shared_folder

#: Words gathered before their distinct pairs are sorted out, and before the frequent ones among them are; input bytes of a
#: shard, and partitions of one where bytes aren't known; a flush's rows, as bits; files that a worker holds mapped, and bytes
#: of those among them that it had to fetch.
FLUSH, SHARD_BYTES, SHARD_PARTITIONS, AREA_BITS, MAPPED, FETCHED = 4_000_000, 8 << 20, 16, 12, 512, 1 << 30
BEGIN, END = (mix(np.array([x], np.uint64))[0] for x in (0xB0B0B0B0, 0xE0E0E0E0))
PAIRS, WORDS = 1, 2


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0xD6E8FEB86659FD93) + second)


def _shard(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _home(first: np.ndarray, pair: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    """Shard of each pair."""
    at = _shard(first, bits)
    if len(hot):
        spread = np.isin(first, hot)
        at[spread] = _shard(pair[spread], bits)
    return at


def _tokens(hashes: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second word of each pair, with the marks of beginning and end, and where each text's pairs begin."""
    n = len(ptr) - 1
    starts = ptr + np.arange(n + 1)
    second = np.empty(len(hashes) + n, np.uint64)
    last = np.zeros(len(second), bool)
    last[starts[1:] - 1] = True
    second[last], second[~last] = END, hashes
    first = np.empty_like(second)
    first[1:] = second[:-1]
    first[starts[:-1]] = BEGIN
    return first, second, starts


def _packed(first: np.ndarray, second: np.ndarray, counts: np.ndarray, home: np.ndarray):
    """Pairs in order of their first word as rows (shard, a, b, c, d), one for each home: first words, pairs of each, second words, counts."""
    order = np.argsort(home, kind="stable")
    first, second, counts, home = first[order], second[order], counts[order].astype(np.uint32), home[order]
    edges = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1], [True]]))
    for k in range(0, len(edges) - 1, 64):
        rows = []
        for a, b in zip(edges[k : k + 64], edges[k + 1 : k + 65]):
            f = first[a:b]
            new = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
            runs = np.diff(np.append(new, len(f))).astype(np.uint32)
            rows.append((int(home[a]), f[new].tobytes(), runs.tobytes(), second[a:b].tobytes(), counts[a:b].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 4))], ["shard", "a", "b", "c", "d"])


def _count(folder: str, bits: int):
    """Distinct pairs with counts, one row for each flush and shard, or area of shards."""

    def flush(seconds: list, begins: list):
        second = np.concatenate(seconds)
        seconds.clear()
        words, at = np.unique(second, return_inverse=True)
        keys = at.astype(np.uint64)
        keys[1:] |= keys[:-1] << np.uint64(32)  # the word before, but for a text's first
        keys[np.concatenate(begins)] &= np.uint64(0xFFFFFFFF)
        keys[np.concatenate(begins)] |= np.uint64(len(words)) << np.uint64(32)
        del second, at
        keys, counts = np.unique(keys, return_counts=True)
        words = np.append(words, BEGIN)
        first, second = words[(keys >> np.uint64(32)).astype(np.int64)], words[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        home = _home(first, _pair(first, second), _get(folder, HOT, np.uint64), bits)
        yield from _packed(first, second, counts, home >> max(bits - AREA_BITS, 0))

    def run(batches):
        seconds, begins, size = [], [], 0
        for batch in batches:
            for _, _, hashes, ptr in word_hashes(batch.column(0).cast(pa.binary()).to_pylist()):
                _, second, starts = _tokens(hashes, ptr)
                seconds.append(second)
                begins.append(starts[:-1] + size)
                size += len(second)
                if size >= FLUSH:
                    yield from flush(seconds, begins)
                    seconds, begins, size = [], [], 0
        if size:
            yield from flush(seconds, begins)

    return run


def _spread(folder: str, bits: int, level: int):
    """Rows of areas, of ``level`` bits, to rows of the areas of AREA_BITS more within, gathered to flushes of pairs again.

    An area's rows come together, as rows are sorted by area; a flush holds rows of one or of several.
    """
    shift = max(bits - level - AREA_BITS, 0)

    def flush(held: list[tuple]):
        first = np.concatenate([np.repeat(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32)) for a, b, _, _ in held])
        second, counts = (np.concatenate([np.frombuffer(h[i], kind) for h in held]) for i, kind in ((2, np.uint64), (3, np.uint32)))
        held.clear()
        pair = _pair(first, second)
        order = np.lexsort((pair, first))
        pair = pair[order]
        new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        first, second, counts = first[order][new], second[order][new], np.add.reduceat(counts[order].astype(np.int64), new)
        home = _home(first, pair[new], _get(folder, HOT, np.uint64), bits)
        yield from _packed(first, second, np.minimum(counts, 0xFFFFFFFF), home >> shift)

    def run(batches):
        held, size, area, areas = [], 0, None, 0
        for batch in batches:
            for shard, *row in zip(*(batch[c].to_pylist() for c in ("shard", "a", "b", "c", "d"))):
                areas += shard != area
                # many small areas in a flush would make many small rows
                if held and shard != area and (size >= FLUSH or areas > 1):
                    yield from flush(held)
                    size, areas = 0, 1
                area = shard
                held.append(row)
                size += len(row[3]) // 4
                if size >= FLUSH:
                    yield from flush(held)
                    size, areas = 0, 1
        if held:
            yield from flush(held)

    return run


def _blobs(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in column.to_pylist())])


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], *(np.add.reduceat(v[order], new) if len(keys) else v for v in values)


def _put(folder: str, name: str, data: np.ndarray) -> None:
    """Write an array whole or not at all."""
    if folder.startswith("file:") or folder.startswith("/"):
        path = f"{folder.removeprefix('file://')}/{name}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        own = f"{path}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            data.tofile(f)
        os.replace(own, path)
        return
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    own = f"{root}/{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as f:
        f.write(data.tobytes())
    system.move(own, f"{root}/{name}")


#: Words whose pairs are dealt to shards one by one.
HOT = "hot"
_mapped: dict[tuple[str, str], np.ndarray] = {}
_fetched: dict[tuple[str, str], int] = {}


def _get(folder: str, name: str, kind) -> np.ndarray:
    """Map a file into memory, none where there is no such file. From a store that can't be mapped it is fetched first. The
    oldest maps are given up beyond MAPPED, and beyond FETCHED bytes of fetched ones."""
    if (folder, name) in _mapped:
        return _mapped[folder, name]
    path = own = None
    if folder.startswith("file:") or folder.startswith("/"):
        path = f"{folder.removeprefix('file://')}/{name}"
        path = path if os.path.exists(path) else None
    else:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        if system.get_file_info(f"{root}/{name}").type == fs.FileType.File:
            own = tempfile.mkdtemp()
            path = f"{own}/{name}"
            fs.copy_files(f"{root}/{name}", path, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
    size = os.path.getsize(path) if path else 0
    _mapped[folder, name] = np.memmap(path, kind, "r") if size else np.zeros(0, kind)
    if own:
        shutil.rmtree(own)  # the mapping stays, and the space goes with it
        _fetched[folder, name] = size
    while len(_mapped) > MAPPED or sum(_fetched.values()) > FETCHED and len(_mapped) > 1:
        oldest = next(iter(_mapped))
        del _mapped[oldest]
        _fetched.pop(oldest, None)
    return _mapped[folder, name]


def _merge_pairs(folder: str, bits: int):
    """Write a shard's pairs; send on what its words gather, and how many pairs have count 1, 2, 3 and 4."""

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        first = np.repeat(_blobs(table["a"], np.uint64), _blobs(table["b"], np.uint32))
        second, counts = _blobs(table["c"], np.uint64), _blobs(table["d"], np.uint32).astype(np.int64)
        pair = _pair(first, second)
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        first, second, pair, counts = first[order][new], second[order][new], pair[new], np.add.reduceat(counts[order], new)
        _put(folder, f"pairs-{shard}", pair)
        _put(folder, f"counts-{shard}", np.minimum(counts, 0xFFFFFFFF).astype(np.uint32))
        one = [(counts == k).astype(np.int64) for k in (1, 2)] + [(counts >= 3).astype(np.int64)]
        context = _sums(first, counts, *one)
        after = _sums(second, np.ones(len(second), np.int64))
        words = np.concatenate([context[0], after[0]])
        zero, none = np.zeros(len(after[0]), np.int64), np.zeros(len(context[0]), np.int64)
        columns = [np.concatenate([c, zero]) for c in context[1:]] + [np.concatenate([none, after[1]])]
        word, *columns = _sums(words, *columns)
        home = _shard(word, bits)
        edges = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1], [True]]))  # words are in order, so are their shards
        small = np.stack([c.astype(np.uint32) for c in columns[1:]])
        rows = [(int(home[a]), word[a:b].tobytes(), columns[0][a:b].tobytes(), small[:, a:b].tobytes(), None) for a, b in zip(edges[:-1], edges[1:])]
        rows.append((shard, None, None, None, np.array([(counts == k).sum() for k in (1, 2, 3, 4)], np.int64).tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 4))], ["shard", "a", "b", "c", "d"])

    return run


def _merge_words(folder: str):
    """Write a shard's words with count, numbers of continuations of count 1, 2 and more, and number of words before."""

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        stats = np.zeros(4, np.int64)
        parts: list[list[np.ndarray]] = [[] for _ in range(6)]
        for a, b, c, d in zip(*(table[k].to_pylist() for k in "abcd")):
            if d is not None:
                stats += np.frombuffer(d, np.int64)
                continue
            word = np.frombuffer(a, np.uint64)
            small = np.frombuffer(c, np.uint32).reshape(4, len(word)).astype(np.int64)
            for p, x in zip(parts, (word, np.frombuffer(b, np.int64), *small)):
                p.append(x)
        word, *columns = _sums(*(np.concatenate([np.zeros(0, np.uint64 if i == 0 else np.int64), *p]) for i, p in enumerate(parts)))
        _put(folder, f"words-{shard}", word)
        _put(folder, f"uses-{shard}", columns[0])
        _put(folder, f"traits-{shard}", np.stack([c.astype(np.uint32) for c in columns[1:]], axis=1))
        before = columns[4]
        predicted = word != BEGIN
        return pa.table(
            {
                "shard": [shard],
                "tokens": [int(columns[0].sum())],
                "begun": [int(columns[0][~predicted].sum())],
                "words": [int(predicted.sum())],
                "before": [int(before.sum())],
                "pairs": [stats.tolist()],
                "singles": [[int((before == k).sum()) for k in (1, 2, 3, 4)]],
            }
        )

    return run


STATS = "shard long, tokens long, begun long, words long, before long, pairs array<long>, singles array<long>"


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Of counts 0, 1, 2 and more; each within its count, and a half where too few counts are known to tell."""
    if not (n1 and n2):
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([d[0], *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d[1:], 1))])


@dataclass
class PairModel:
    """Where the arrays are, in how many shards, and the sums over all of them."""

    folder: str
    bits: int
    tokens: int = 0
    texts: int = 0
    words: int = 0
    before: int = 0
    pair_discounts: np.ndarray = field(default_factory=lambda: discounts(0, 0, 0, 0))
    word_discounts: np.ndarray = field(default_factory=lambda: discounts(0, 0, 0, 0))
    spread: float = 1.0

    def score(self, documents: DataFrame, text_col: str = "text") -> DataFrame:
        """``documents`` with n_tokens, n_known, base_score and score in place of the text.

        base_score: log10 of additively smoothed single words; score: log10 of the model, both summed over the text's
        tokens, its end among them. Null and empty texts are their end alone; an untrained model knows no token.
        """
        kinds = {"n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double"}
        return map_last(documents, text_col, _scorer(self), {name: (name, kind) for name, kind in kinds.items()})


def _find(arrays: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(arrays, wanted), max(len(arrays) - 1, 0))
    return at, (arrays[at] == wanted) if len(arrays) else np.zeros(len(wanted), bool)


def _by_shard(home: np.ndarray, hashes: np.ndarray):
    """(shard, places) with the hashes of the places in order."""
    order = np.lexsort((hashes, home))
    home = home[order]
    edges = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1], [True]]))
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(home[a]), order[a:b]


def _scorer(m: PairModel):
    def words(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, and the four traits) of each word."""
        uses, traits = np.zeros(len(h), np.int64), np.zeros((len(h), 4), np.int64)
        if m.tokens:
            for shard, places in _by_shard(_shard(h, m.bits), h):
                at, hit = _find(_get(m.folder, f"words-{shard}", np.uint64), h[places])
                places, at = places[hit], at[hit]
                uses[places] = _get(m.folder, f"uses-{shard}", np.int64)[at]
                traits[places] = _get(m.folder, f"traits-{shard}", np.uint32).reshape(-1, 4)[at]
        return uses, traits

    def pairs(first: np.ndarray, second: np.ndarray, known: np.ndarray) -> np.ndarray:
        counts = np.zeros(len(first), np.int64)
        ask = np.flatnonzero(known)
        if m.tokens and len(ask):
            pair = _pair(first[ask], second[ask])
            for shard, places in _by_shard(_home(first[ask], pair, _get(m.folder, HOT, np.uint64), m.bits), pair):
                at, hit = _find(_get(m.folder, f"pairs-{shard}", np.uint64), pair[places])
                counts[ask[places[hit]]] = _get(m.folder, f"counts-{shard}", np.uint32)[at[hit]]
        return counts

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            for i, j, hashes, ptr in word_hashes(texts):
                first, second, starts = _tokens(hashes, ptr)
                known, at = np.unique(np.concatenate([first, second]), return_inverse=True)
                uses, traits = words(known)
                one, two = at[: len(first)], at[len(first) :]
                count = np.where(known == END, m.texts, np.where(known == BEGIN, 0, uses))
                base = np.log10((count + 0.1) / (m.tokens + 0.1 * (m.words + 1)))
                before = traits[:, 3]
                single = np.full(len(known), m.spread / (m.words + 1))
                if m.before:
                    single += np.maximum(before - m.word_discounts[np.minimum(before, 3)], 0) / m.before
                left = traits[:, :3] @ m.pair_discounts[1:]
                c = pairs(first, second, (uses[one] > 0) & (before[two] > 0))
                total = uses[one]
                seen = np.maximum(total, 1)
                p = np.where(total > 0, np.maximum(c - m.pair_discounts[np.minimum(c, 3)], 0) / seen + left[one] / seen * single[two], single[two])
                sums = lambda x: np.add.reduceat(x, starts[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k)[i:j] for k in range(batch.num_columns - 1)]
                    + [
                        pa.array(np.diff(starts)),
                        pa.array(sums((count[two] > 0).astype(np.int64))),
                        pa.array(sums(base[two])),
                        pa.array(sums(np.log10(p))),
                    ],
                    [*batch.schema.names[:-1], "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def _frequent(texts: DataFrame, bits: int) -> DataFrame:
    """w: words that would fill a good part of a shard, from all documents. This lays pairs out; it changes no count.

    Each flush sends on the words above half of that share, so a word above the whole of it over all documents is never
    missed, and at most 4 << bits words are found.
    """

    def flush(parts: list, size: int):
        words, counts = np.unique(np.concatenate(parts), return_counts=True)
        some = counts * (4 << bits) > size
        w, c = words[some].view(np.int64), counts[some].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([*w.tolist(), None], pa.int64()), pa.array([*c.tolist(), size], pa.int64())], ["w", "c"])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for _, _, hashes, _ in word_hashes(batch.column(0).cast(pa.binary()).to_pylist()):
                parts.append(hashes)
                size += len(hashes)
                if size >= FLUSH:
                    yield flush(parts, size)
                    parts, size = [], 0
        if size:
            yield flush(parts, size)

    sums = durable(texts.mapInArrow(tidy(run), "w long, c long").groupBy("w").agg(F.sum("c").alias("c")))
    size = sums.where("w is null").agg(F.max("c").alias("size")).first()["size"] or 0
    return sums.where(F.col("w").isNotNull() & (F.col("c") * (4 << bits) > size)).select("w")


def _write_hot(folder: str):
    def run(batches):
        words = np.sort(np.concatenate([np.zeros(0, np.int64), *(b["w"].to_numpy() for b in batches)]).view(np.uint64))
        _put(folder, HOT, words)
        yield pa.RecordBatch.from_arrays([pa.array([len(words)])], ["n"])

    return run


STATS_SUMS = ("tokens", "begun", "words", "before")


def train_pairs(documents: DataFrame, text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> PairModel:
    """Count all pairs of all whole texts of ``documents``. A null text counts as an empty one, which is its end alone."""
    spark = documents.sparkSession
    bound_batches(spark)
    texts = documents.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shards = max(-(-bytes_read(texts) // shard_bytes), -(-texts._jdf.queryExecution().toRdd().getNumPartitions() // SHARD_PARTITIONS), 1)
    bits = (shards - 1).bit_length()
    folder = shared_folder(spark, "pairs")
    atexit.register(_forget, spark, folder)
    durable(_frequent(texts, bits).repartition(1).mapInArrow(_write_hot(folder), "n long"))
    packed = "shard long, a binary, b binary, c binary, d binary"
    counted = texts.mapInArrow(tidy(_count(folder, bits)), packed)
    for level in range(AREA_BITS, bits, AREA_BITS):
        counted = counted.repartition("shard").sortWithinPartitions("shard").mapInArrow(_spread(folder, bits, level), packed)
    gathered = counted.groupBy("shard").applyInArrow(_merge_pairs(folder, bits), packed)
    stats = durable(gathered.groupBy("shard").applyInArrow(_merge_words(folder), STATS))
    sums = [F.sum(c).alias(c) for c in STATS_SUMS] + [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("pairs", "singles") for i in range(4)]
    whole = stats.agg(*sums).first()
    if whole["tokens"] is None:
        return PairModel(folder, bits)
    pair_counts, word_counts = ([whole[f"{c}{i}"] for i in range(4)] for c in ("pairs", "singles"))
    tokens, texts_seen, words, before = (whole[c] for c in STATS_SUMS)
    d = discounts(*word_counts)
    n3 = words - word_counts[0] - word_counts[1]
    spread = float(d[1] * word_counts[0] + d[2] * word_counts[1] + d[3] * n3) / before
    return PairModel(folder, bits, tokens, texts_seen, words, before, discounts(*pair_counts), d, spread)


def _forget(spark, folder: str) -> None:
    try:
        delete_folder(spark, folder)
    except Exception:  # the session is gone; the folder is then the cluster's to clear
        return
