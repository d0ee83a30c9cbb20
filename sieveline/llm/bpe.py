"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition.

Texts are cut into pieces by the tokenizer's pattern. Pieces that are a token are looked up; each other distinct piece
becomes token-position rows of a recursive query: the rows join the merge table, every piece contracts its leftmost pair
of least rank, and pieces without a pair drop out, until none is left. The query is keyed by place, so it holds each
place once, whatever the number of steps. Decoding selects the ids from the vocabulary and joins their bytes. Blocks of
pieces and of ids are bounded, so memory doesn't grow with the partition or with a piece, and a bounded memory of pieces
serves later texts.

The query begins by contracting at once all pairs of bytes that no other merge can come before: none of lower rank joins
their right byte with what begins by the next byte, or their left byte with what ends by the byte before (where that one's
rank must not be equal either, as the leftmost comes first). Such a pair stays as it is until its turn, and so it may have
its turn now, if its token isn't joined at a lower rank than its own with what begins or ends so, either.

A piece longer than ``WINDOW`` bytes is cut into windows that overlap, which are contracted side by side, and two windows
are spliced at a token that both have at the same place. That gives the piece's own ids: a row of tokens is what contraction
yields exactly if no merge joins any two neighbours of it contracted on their own (the first merge across a border would
have come in those two as well), and each two neighbours of the spliced row are neighbours in one of the windows. Windows
without a common token, as in a long run of one character, are done over as one stretch, in windows of ``LARGE`` bytes that
begin at a token of the one before; there a step contracts all places of the least pair at once, up to one whose new token
would come first with a neighbour.
"""

from __future__ import annotations

import base64
import itertools
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.columns import map_last, release

#: Pieces and bytes in a recursive query, bytes of pieces that go together, remembered pieces of each of two generations,
#: ids decoded at once, pieces of one long text at once, and memory of a query.
PIECES, PIECE_BYTES, SHORT, REMEMBERED, DECODED, AT_ONCE, MEMORY = 20_000, 1 << 17, 64, 400_000, 1_000_000, 100_000, 400 << 20
#: Bytes of a generation's pieces and ids, and of those at hand as Python's objects, by an estimate from above for each
#: piece and each of its characters.
REMEMBERED_BYTES, HELD, A_PIECE, A_CHARACTER = 16 << 20, 24 << 20, 160, 16
#: Bytes of a window, from one to the next, and of a window in stretches without a common token. More than MEMORY is used
#: only where such a window has to grow: so much for each byte.
WINDOW, STEP, LARGE, MEMORY_A_BYTE = 160, 96, 1 << 15, 1024
IDS, BYTES = {"ids": ("ids", "array<int>")}, {"decoded": ("decoded", "binary")}

PAIRS = """
     FROM t a JOIN t b ON a.w = b.w AND a.e = b.p JOIN merges m ON m.pair = CAST(a.tok AS BIGINT) * 65536 + b.tok
     WHERE a.tok >= 0 AND b.tok >= 0"""
#: A place whose byte went into the token before it has tok -1, or is left out if it did so at the beginning.
CONTRACT = f"""
WITH RECURSIVE safe AS MATERIALIZED (
  SELECT i, w, p, id FROM bytes_in JOIN byte_pairs USING (pair)
  ANTI JOIN early_right r ON r.k = bytes_in.right_k ANTI JOIN early_left l ON l.k = bytes_in.left_k),
t(w, p, e, tok) USING KEY (w, p) AS (
  (SELECT w, p, p + 2, id FROM safe
   UNION ALL SELECT w, p, p + 1, tok FROM bytes_in ANTI JOIN (SELECT unnest([i, i + 1]) AS i FROM safe) USING (i))
  UNION ALL
  (WITH pairs AS (SELECT a.w, b.p AS rp, b.e AS re, (CAST(m.id AS BIGINT) << 32) + a.p AS k {PAIRS}),
   best AS (SELECT w, min(k) AS k, arg_min(rp, k) AS rp, arg_min(re, k) AS re FROM pairs GROUP BY w)
   SELECT t.w, t.p, CASE WHEN t.p = k & 4294967295 THEN re ELSE t.e END,
          CASE WHEN t.p = k & 4294967295 THEN CAST(k >> 32 AS INT) WHEN t.p = rp THEN -1 ELSE t.tok END
   FROM t JOIN best USING (w) WHERE tok >= 0))
SELECT w, tok FROM t WHERE tok >= 0 ORDER BY w, p
"""
#: Of places that overlap, every other one, from the left; none after one whose new token has a pair of lower rank.
CONTRACT_MANY = f"""
WITH RECURSIVE t(w, p, e, tok) USING KEY (w, p) AS (
  SELECT w, p, p + 1, tok FROM bytes_in
  UNION ALL
  (WITH pairs AS (SELECT a.w, a.p, b.p AS rp, b.e AS re, m.id {PAIRS}),
   best AS (SELECT w, min(id) AS id FROM pairs GROUP BY w),
   places AS (
     SELECT w, p, rp, re, id, row_number() OVER o AS n, lag(rp) OVER o IS DISTINCT FROM p AS apart
     FROM pairs SEMI JOIN best USING (w, id) WINDOW o AS (PARTITION BY w ORDER BY p)),
   runs AS (SELECT *, max(CASE WHEN apart THEN n END) OVER (PARTITION BY w ORDER BY p) AS first FROM places),
   chosen AS (
     SELECT w, p, rp, re, id, n, lag(re) OVER (PARTITION BY w ORDER BY p) IS NOT DISTINCT FROM p AS follows
     FROM runs WHERE (n - first) % 2 = 0),
   unsafe AS (SELECT chosen.* FROM chosen SEMI JOIN low_merges ON chosen.id = low_merges.part),
   stop AS (
     SELECT c.w, min(c.n) AS n
     FROM unsafe c LEFT JOIN t l ON l.w = c.w AND l.e = c.p AND l.tok >= 0 LEFT JOIN t r ON r.w = c.w AND r.p = c.re AND r.tok >= 0
     JOIN low_merges m ON m.part = c.id AND m.id < c.id
      AND m.pair IN (CAST(CASE WHEN follows THEN c.id ELSE l.tok END AS BIGINT) * 65536 + c.id, CAST(c.id AS BIGINT) * 65536 + r.tok)
     GROUP BY c.w),
   kept AS (SELECT c.* FROM chosen c LEFT JOIN stop USING (w) WHERE stop.n IS NULL OR c.n <= stop.n),
   change AS (SELECT w, p, re AS e, id AS tok FROM kept UNION ALL SELECT w, rp, NULL, -1 FROM kept)
   SELECT t.w, t.p, coalesce(c.e, t.e), coalesce(c.tok, t.tok)
   FROM t SEMI JOIN best USING (w) LEFT JOIN change c ON c.w = t.w AND c.p = t.p WHERE t.tok >= 0))
SELECT w, tok FROM t WHERE tok >= 0 ORDER BY w, p
"""
#: Merges whose token has a lower rank than one of its parts, by that part.
LOW_MERGES = """
CREATE TABLE low_merges AS
SELECT DISTINCT part, pair, id FROM (SELECT pair // 65536 AS part, * FROM merges UNION ALL SELECT pair % 65536, * FROM merges) WHERE id < part
"""
#: Pairs of bytes that are a token, and the bytes after and before such a pair (with it as one number) that let another
#: merge come first.
BYTE_PAIRS = """
CREATE TABLE byte_pairs AS
SELECT pair, id, pair // 65536 AS a, pair % 65536 AS b FROM merges
WHERE a IN (SELECT tok FROM byte_tokens) AND b IN (SELECT tok FROM byte_tokens);
CREATE TABLE early_right AS
SELECT q.pair * 256 + m.after AS k FROM byte_pairs q JOIN merges m ON m.pair // 65536 = q.b AND m.id < q.id
UNION SELECT q.pair * 256 + m.after FROM byte_pairs q JOIN merges m ON m.pair // 65536 = q.id AND m.id < q.id;
CREATE TABLE early_left AS
SELECT q.pair * 256 + m.before AS k FROM byte_pairs q JOIN merges m ON m.pair % 65536 = q.a AND m.id <= q.id
UNION SELECT q.pair * 256 + m.before FROM byte_pairs q JOIN merges m ON m.pair % 65536 = q.id AND m.id < q.id;
"""
DECODE = """
SELECT array_to_string(list_select(h, ids), '') AS bytes FROM ids_in, vocabulary ORDER BY d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Part:
    """Ids of a stretch of a piece, from a byte of it on."""

    def __init__(self, begin: int, ids: np.ndarray) -> None:
        self.begin, self.ids = begin, ids

    def ends(self, sizes: np.ndarray) -> np.ndarray:
        return self.begin + np.cumsum(sizes[self.ids])

    def spans(self, sizes: np.ndarray) -> np.ndarray:
        """Where each token ends and how long it is, as one number."""
        return (self.ends(sizes) << 20) + sizes[self.ids]


class Remembered:
    """Ids of pieces in arrays by hash: some 40 bytes for a piece, of which Python's objects take four times as much."""

    def __init__(self) -> None:
        self.hashes, self.places, self.data = np.zeros(0, np.int64), np.zeros((3, 0), np.int32), b""

    def find(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of those pieces that are here."""
        if not len(self.hashes):
            return {}
        wanted, out = _hashes(pieces), {}
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        same = np.flatnonzero(self.hashes[at] == wanted)
        for i, begin, middle, end in zip(same.tolist(), *self.places[:, at[same]].tolist()):
            if self.data[begin:middle] == pieces[i].encode():
                out[pieces[i]] = self.data[middle:end]
        return out

    def add(self, ids: dict[str, bytes]) -> None:
        """Further pieces, none of which is here."""
        cells = [x for piece, i in ids.items() for x in (piece.encode(), i)]
        ends = len(self.data) + np.cumsum(np.fromiter(map(len, cells), np.int64, len(cells)))
        places = np.stack([np.append(len(self.data), ends)[:-1:2], ends[::2], ends[1::2]])
        hashes = _hashes(list(ids))
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.places = np.insert(self.hashes, at, hashes[order]), np.insert(self.places, at, places[:, order], axis=1)
        self.data += b"".join(cells)


def _hashes(pieces: list[str]) -> np.ndarray:
    return np.fromiter(map(hash, pieces), np.int64, len(pieces))


class Coder:
    """One for each worker process; holds the vocabulary and a DuckDB connection with bounded memory."""

    kept: dict[tuple[str, str], Coder] = {}

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY >> 20}MiB", "temp_directory": ""})
        splits = [(a * 65536 + b, v, t[i - 1], t[i]) for t, v in self.ranks.items() for i in range(1, len(t)) if (a := self.ranks.get(t[:i])) is not None and (b := self.ranks.get(t[i:])) is not None]
        # before and after: the last byte of the left part and the first one of the right part
        self._table("merges", **{name: pa.array([x[k] for x in splits], kind) for k, (name, kind) in enumerate([("pair", pa.int64()), ("id", pa.int32()), ("before", pa.int32()), ("after", pa.int32())])})
        self.con.execute(LOW_MERGES)
        self._table("byte_tokens", tok=self.byte)
        self.con.execute(BYTE_PAIRS)
        names: list[str | None] = [None] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            names[rank] = token.decode("latin-1")
        self._table("vocabulary", h=pa.array([names], pa.list_(pa.string())))
        self.known: dict[str, bytes] = {}
        for token, rank in self.ranks.items():
            try:
                self.known[token.decode()] = np.int32(rank).tobytes()
            except UnicodeDecodeError:
                continue
        self.fixed, self.held, self.fresh = len(self.known), 0, {}
        self.young, self.older = Remembered(), Remembered()
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.sizes[list(self.ranks.values())] = [len(t) for t in self.ranks]

    @classmethod
    def get(cls, path: str, pattern: str) -> Coder:
        if (path, pattern) not in cls.kept:
            cls.kept[path, pattern] = cls(path, pattern)
        return cls.kept[path, pattern]

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.con.register("_new", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM _new")
        self.con.unregister("_new")

    def _contract(self, pieces: list[bytes], query: str = CONTRACT) -> list[np.ndarray]:
        """Ids of each piece, by one recursive query."""
        sizes = np.array([len(x) for x in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        w = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        p = (np.arange(len(data)) - (np.cumsum(sizes) - sizes)[w]).astype(np.int32)
        memory = max(MEMORY, MEMORY_A_BYTE * len(data))
        if memory > MEMORY:
            self.con.execute(f"SET memory_limit = '{memory >> 20}MiB'")
        tok = self.byte[data]
        last = np.cumsum(sizes[sizes > 0]) - 1
        pair = np.full(len(data), -1, np.int64)
        pair[:-1] = tok[:-1].astype(np.int64) * 65536 + tok[1:]
        pair[last] = -1
        right, left = pair * 256, pair * 256
        right[:-2] += data[2:]
        left[1:] += data[:-1]
        right[last - 1] = left[last - sizes[sizes > 0] + 1] = -1  # nothing there; a piece of one byte has no pair
        i = np.arange(len(data), dtype=np.int32)
        self.con.register("bytes_in", pa.table({"i": i, "w": w, "p": p, "tok": tok, "pair": pair, "right_k": right, "left_k": left}))
        out = self.con.sql(query).to_arrow_table()
        self.con.unregister("bytes_in")
        if memory > MEMORY:
            self.con.execute(f"SET memory_limit = '{MEMORY >> 20}MiB'")
        at = np.searchsorted(out["w"].to_numpy(), np.arange(len(pieces) + 1))
        flat = out["tok"].to_numpy().astype(np.int32)
        return [flat[a:b] for a, b in zip(at[:-1], at[1:])]

    def _contracted(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, in blocks; the pieces are in order of length."""
        out, part, size = [], [], 0
        for i, raw in enumerate(pieces):
            part.append(raw)
            size += len(raw)
            # pieces of up to SHORT bytes apart, for their fewer steps
            if i + 1 == len(pieces) or len(part) == PIECES or size + len(pieces[i + 1]) > PIECE_BYTES or len(raw) <= SHORT < len(pieces[i + 1]):
                out += self._contract(part)
                part, size = [], 0
        return out

    def _common(self, a: Part, b: Part) -> tuple[int, int] | None:
        """Places of the first token that both parts have at the same bytes."""
        _, i, j = np.intersect1d(a.spans(self.sizes), b.spans(self.sizes), assume_unique=True, return_indices=True)
        return (int(i[0]), int(j[0])) if len(i) else None

    def _stretch(self, raw: bytes, begin: int, end: int) -> Part:
        """The part begin:end of a piece in windows of LARGE bytes or more, each from a token of the one before on."""
        done: list[np.ndarray] = []
        at, size, held = begin, LARGE, None
        while True:
            [ids] = self._contract([raw[at : min(at + size, end)]], CONTRACT_MANY)
            now = Part(at, ids)
            if held is not None:
                common = self._common(held, now)
                if common is None:  # go back, and further at once
                    at, size, held = held.begin, 2 * size, None
                    continue
                done.append(held.ids[: common[0] + 1])
                now = Part(int(now.ends(self.sizes)[common[1]]), now.ids[common[1] + 1 :])
            if at + size >= end:
                return Part(begin, np.concatenate([*done, now.ids]))
            starts = now.ends(self.sizes) - self.sizes[now.ids]
            at = int(starts[min(np.searchsorted(starts, at + 3 * size // 4), len(starts) - 1)])
            held = now

    def _spliced(self, raw: bytes, parts: list[Part]) -> np.ndarray:
        """The ids of a piece from those of its windows."""
        while True:
            common = [self._common(a, b) for a, b in zip(parts, parts[1:])]
            if None not in common:
                break
            joined, i = [], 0
            while i < len(parts):
                j = i
                while j < len(common) and common[j] is None:
                    j += 1
                end = int(parts[j].ends(self.sizes)[-1])
                joined.append(parts[i] if i == j else self._stretch(raw, parts[i].begin, end))
                i = j + 1
            parts = joined
        first = [0, *(j + 1 for _, j in common)]
        last = [*(i + 1 for i, _ in common), len(parts[-1].ids)]
        return np.concatenate([p.ids[a:b] for p, a, b in zip(parts, first, last)])

    def _learn(self, pieces: Iterable[str]) -> None:
        wanted = list(set(pieces).difference(self.known))
        self.held += A_PIECE * len(wanted) + A_CHARACTER * sum(map(len, wanted))
        here = self.young.find(wanted)
        wanted = [p for p in wanted if p not in here]
        again = self.older.find(wanted)
        new = sorted((p.encode() for p in wanted if p not in again), key=len)
        short = [x for x in new if len(x) <= WINDOW]
        again.update(zip([x.decode() for x in short], [x.tobytes() for x in self._contracted(short)]))
        self.fresh.update(again)
        self.known.update(here)
        self.known.update(again)
        for raw in new[len(short) :]:
            starts = range(0, max(len(raw) - WINDOW, 0) + STEP, STEP)
            windows = [raw[a : a + WINDOW] for a in starts]
            different = sorted(set(windows), key=len)
            ids = dict(zip(different, self._contracted(different)))
            self.known[raw.decode()] = self._spliced(raw, [Part(a, ids[w]) for a, w in zip(starts, windows)]).tobytes()

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        pieces = list(map(self.pattern.findall, texts))
        self._learn(itertools.chain.from_iterable(pieces))
        find = self.known.__getitem__
        return (b"".join(map(find, p)) for p in pieces)

    def _encode_long(self, text: str) -> bytes:
        """A text of any length: so many pieces at a time."""
        found, out = (m[0] for m in self.pattern.finditer(text)), []
        while part := list(itertools.islice(found, AT_ONCE)):
            self._tidy()
            self._learn(part)
            out.append(b"".join(map(self.known.__getitem__, part)))
        return b"".join(out)

    def _tidy(self) -> None:
        """Pieces that two generations of texts don't use again are forgotten.

        Pieces at hand go to the arrays from time to time, and what is free then goes back to the machine.
        """
        if self.held <= HELD:
            return
        if len(self.young.hashes) > REMEMBERED or len(self.young.data) > REMEMBERED_BYTES:
            self.young, self.older = Remembered(), self.young
        self.young.add(self.fresh)
        self.known, self.held, self.fresh = dict(itertools.islice(self.known.items(), self.fixed)), 0, {}
        release()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as 32-bit numbers side by side."""
        self._tidy()
        if len(texts) == 1 and len(texts[0]) > GROUP:
            return [self._encode_long(texts[0])]
        return list(self._encode(texts))

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of each list of ids."""
        out: list[list[bytes]] = [[] for _ in ids]
        ends = np.cumsum([0, *map(len, ids)])
        flat = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)
        for i in range(0, len(flat), DECODED):
            part = np.maximum(flat[i : i + DECODED], -1) + 1  # lists count from 1, and nothing is at 0
            lists = pa.ListArray.from_arrays(pa.array(np.clip(ends - i, 0, len(part)).astype(np.int32)), pa.array(part))
            self.con.register("ids_in", pa.table({"d": np.arange(len(ids), dtype=np.int32), "ids": lists}))
            got = self.con.sql(DECODE).to_arrow_table()
            self.con.unregister("ids_in")
            for k, b in enumerate(got["bytes"].to_pylist()):
                out[k].append((b or "").encode("latin-1"))  # a character stands for a byte
        return [b"".join(x) for x in out]


#: Characters of the texts that are encoded together; a longer text is alone.
GROUP = 1 << 19


def _groups(texts: list[str], most: int = GROUP) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= most):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def _id_lists(parts: list[bytes]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _both(path: str, pattern: str, decode: bool):
    def run(batches):
        coder = Coder.get(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for i, j in _groups(texts):
                parts = coder.encode(texts[i:j])
                columns = [batch.column(k)[i:j] for k in range(batch.num_columns - 1)] + [_id_lists(parts)]
                names = batch.schema.names[:-1] + ["ids"]
                if decode:
                    columns.append(pa.array(coder.decode([np.frombuffer(x, np.int32) for x in parts]), pa.binary()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _decoded(path: str, pattern: str):
    def run(batches):
        coder = Coder.get(path, pattern)
        for batch in batches:
            lists = [np.array(x or (), np.int32) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(batch.num_columns - 1)] + [pa.array(coder.decode(lists), pa.binary())],
                batch.schema.names[:-1] + ["decoded"],
            )

    return run


def encode(documents: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``documents`` with ids, an array of ints, in place of the text.

    No special tokens. A null or empty text has no ids; repeated rows get equal ids; columns named ids or decoded are
    replaced; an empty table gives an empty result. ``path`` must be readable on the workers.
    """
    return map_last(documents, text_col, _both(os.fspath(path), pattern, False), IDS)


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with decoded, the bytes of the ids, in place of them; null and empty lists give empty bytes."""
    return map_last(tokens, ids_col, _decoded(os.fspath(path), pattern), BYTES)


def encode_and_decode(documents: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Both in one pass over the texts: ids and decoded in place of the text."""
    return map_last(documents, text_col, _both(os.fspath(path), pattern, True), IDS | BYTES)


def bpe_digests() -> list[Column]:
    """n_tokens, ids_sha256 (of the ids in decimal, joined by commas) and decoded_sha256, from ids and decoded."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    ]
