"""Web evidence as a Spark data source, ``spark.read.format("evidence")`` and ``readStream``: searches are its partitions.

A client does a search; it is named by an import path, so that workers can make it. Here is one that reads answers from a
folder of JSON lines, which stands in for a service: ROOT/round=N/query=Q/*.json with title, snippet, url and
optionally rank and collected_at_utc. A round is one collection of all queries; a stream's offset is the number of rounds
seen, so a restarted stream goes on with the next one, and a batch reads the rounds that are there.
"""

from __future__ import annotations

import importlib
import json
import urllib.parse
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from sieveline.functions.text import domain, evidence_hash
from sieveline.operators.duplicates import keep_first

SCHEMA = "food_class string, query string, round int, rank int, title string, snippet string, url string, collected_at_utc string"
#: Partitions that a read is dealt to, if there are as many searches.
PARTITIONS = 64


class Client(Protocol):
    """What a source asks; it is made from the source's options in every task."""

    def __init__(self, options: dict[str, str]) -> None: ...

    def rounds(self) -> int:
        """How many rounds can be read."""

    def search(self, query: str, round_: int) -> Iterator[dict]:
        """The answers to a query in a round, best first."""


class FolderClient:
    def __init__(self, options: dict[str, str]) -> None:
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(options["path"])

    def _names(self, path: str) -> list[str]:
        from pyarrow import fs

        return sorted(f.path for f in self.fs.get_file_info(fs.FileSelector(path, allow_not_found=True)))

    def rounds(self) -> int:
        """Rounds from 0 on without a gap."""
        there = {p.rsplit("=", 1)[-1] for p in self._names(self.root) if "/round=" in p}
        n = 0
        while str(n) in there:
            n += 1
        return n

    def search(self, query: str, round_: int) -> Iterator[dict]:
        folder = f"{self.root}/round={round_}/query={urllib.parse.quote(query, safe='')}"
        answers = []
        for path in self._names(folder):
            if path.endswith(".json"):
                with self.fs.open_input_stream(path) as f:
                    answers += [json.loads(line) for line in f.read().decode().splitlines() if line.strip()]
        yield from sorted(answers, key=lambda a: a.get("rank", 0))


class Searches(InputPartition):
    def __init__(self, searches: list[tuple[str, str, int]]) -> None:
        super().__init__(None)
        self.searches = searches


def _client(options: dict[str, str]) -> Client:
    module, _, name = options.get("client", f"{__name__}:FolderClient").partition(":")
    return getattr(importlib.import_module(module), name)(dict(options))


class _Reading:
    """What batch and stream have in common: searches dealt to partitions, and a partition's rows."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)
        self.queries = [(c, q) for c, q in json.loads(self.options["queries"])]

    def deal(self, rounds: range) -> list[Searches]:
        every = [(c, q, r) for r in rounds for c, q in self.queries]
        n = max(1, min(len(every), int(self.options.get("partitions", PARTITIONS))))
        return [Searches(every[i::n]) for i in range(n)]

    def rows(self, partition: Searches) -> Iterator[tuple]:
        client = _client(self.options)
        for food_class, query, round_ in partition.searches:
            now = datetime.now(timezone.utc).isoformat()
            for rank, a in enumerate(client.search(query, round_), 1):
                yield food_class, query, round_, rank, a.get("title") or "", a.get("snippet") or "", a.get("url") or "", a.get("collected_at_utc") or now


class EvidenceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.reading = _Reading(options)

    def partitions(self) -> list[Searches]:
        return self.reading.deal(range(_client(self.reading.options).rounds()))

    def read(self, partition: Searches) -> Iterator[tuple]:
        return self.reading.rows(partition)


class EvidenceStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.reading = _Reading(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"rounds": 0}

    def latestOffset(self, *_) -> dict:  # noqa: N802
        return {"rounds": _client(self.reading.options).rounds()}

    def partitions(self, start: dict, end: dict) -> list[Searches]:
        return self.reading.deal(range(start["rounds"], end["rounds"]))

    def read(self, partition: Searches) -> Iterator[tuple]:
        return self.reading.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is held for rounds that were seen."""


class EvidenceSource(DataSource):
    """Options: queries (JSON list of [food_class, query]), client (module:name), partitions, and the client's own."""

    @classmethod
    def name(cls) -> str:
        return "evidence"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EvidenceReader:
        return EvidenceReader(self.options)

    def streamReader(self, schema) -> EvidenceStream:  # noqa: N802
        return EvidenceStream(self.options)


def _options(queries: list[tuple[str, str]], options: dict[str, str]) -> dict[str, str]:
    return {"queries": json.dumps([list(q) for q in queries]), **options}


def told_apart(found: DataFrame) -> DataFrame:
    """With each answer's domain and hash."""
    return found.withColumns({"domain": domain(F.col("url")), "evidence_hash": evidence_hash(F.col("title"), F.col("snippet"), F.col("url"))})


def collect_evidence(spark: SparkSession, queries: list[tuple[str, str]], **options: str) -> DataFrame:
    """The answers to (food_class, query) pairs, each (url, evidence_hash) once: by query, round and rank the first."""
    spark.dataSource.register(EvidenceSource)
    found = told_apart(spark.read.format("evidence").options(**_options(queries, options)).load())
    return keep_first(found, ["url", "evidence_hash"], ["query", "round", "rank", "food_class"])


def stream_evidence(spark: SparkSession, queries: list[tuple[str, str]], **options: str) -> DataFrame:
    """The same answers as a stream of rounds, with domain and hash, not yet told apart: a ``BucketedStore`` can do that."""
    spark.dataSource.register(EvidenceSource)
    return told_apart(spark.readStream.format("evidence").options(**_options(queries, options)).load())
