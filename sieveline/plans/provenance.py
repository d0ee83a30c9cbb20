"""Digests, locks, run manifests and the result page."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import platform
import subprocess
from collections.abc import Iterator
from datetime import datetime, timezone
from importlib import metadata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sieveline.plans import commit
from sieveline.plans.folds import ordered_digests


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def json_digest(value: object) -> str:
    """SHA-256 of compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def csv_digest(df: DataFrame, key: str) -> str:
    """SHA-256 of the table as CSV in the order of its key, as one data frame would write it.

    The driver reads the text a partition at a time and keeps the digest's state only. A whole-number column with nulls is
    written as decimals, as it would be in a frame.
    """
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, IntegralType)]
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in whole]).first() if whole else ()
    wide = df.withColumns({c: F.col(c).cast("double") for c, n in zip(whole, nulls) if n})

    def text(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"text": [frame.to_csv(index=False, header=False, lineterminator="\n")]})

    digest = hashlib.sha256(pd.DataFrame(columns=df.columns).to_csv(index=False, lineterminator="\n").encode())
    for row in wide.orderBy(key).mapInPandas(text, "text string").toLocalIterator():
        digest.update(row.text.encode())
    return digest.hexdigest()


def row_text(columns: list[str]) -> Column:
    """A row as text that no other row has: each cell as its length in bytes, a colon and its text, or - for a null."""
    cells = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.concat(*cells)


def table_digest(df: DataFrame) -> DataFrame:
    """rows, digest whatever the order, size and partitions: sums of parts of each row's MD5, as hex text joined by -."""
    row = F.md5(row_text(df.columns))
    part = lambda i: F.sum(F.conv(F.substring(row, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.concat_ws("-", *[part(i) for i in range(4)]), F.lit("")).alias("digest"))


def _leaf(key: str, levels: int) -> Column:
    return F.substring(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256), 1, levels)


def digest_leaves(df: DataFrame, key: str, levels: int = 2) -> DataFrame:
    """leaf, rows, digest: the leaves of a hash tree of ``levels`` levels of 16 branches.

    A row's leaf is the beginning of its key's SHA-256, so it doesn't hang on partitions or on other rows; a leaf's digest
    is that of its rows in the order of the key, then of the row, carried over as many as there are.
    """
    rows = df.select(_leaf(key, levels).alias("leaf"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), row_text(df.columns).alias("row"))
    return ordered_digests(rows, "leaf", ["key", "row"], "row").withColumnRenamed("n", "rows")


def digest_tree(leaves: DataFrame, levels: int = 2) -> DataFrame:
    """node, rows, digest of all inner nodes: a node's name is what its leaves begin with, the root's is empty."""
    nodes, level = [], leaves.withColumnRenamed("leaf", "node")
    for depth in range(levels - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))  # at most 16
        text = F.array_join(F.transform(children, lambda c: F.concat(c["node"], F.lit(":"), c["digest"])), "\n")
        level = level.groupBy(F.substring("node", 1, depth).alias("up")).agg(F.sum("rows").alias("rows"), F.sha2(text, 256).alias("digest")).withColumnRenamed("up", "node")
        nodes.append(level)
    return functools.reduce(DataFrame.unionByName, nodes)


def tree_root(df: DataFrame, key: str, levels: int = 2) -> DataFrame:
    """rows, digest: equal for tables with equal columns and rows, in whatever order and partitions; no row for an empty table."""
    head = F.lit("".join(f"{len(c.encode())}:{c}" for c in df.columns))
    root = digest_tree(digest_leaves(df, key, levels), levels).where("node = ''")
    return root.select("rows", F.sha2(F.concat(head, F.lit("\n"), F.col("digest")), 256).alias("digest"))


def differing_leaves(left: DataFrame, right: DataFrame, key: str, levels: int = 2) -> DataFrame:
    """leaf, left_rows, right_rows of the leaves in which two tables with equal columns differ."""
    a, b = (digest_leaves(df.select(*left.columns), key, levels).select("leaf", F.col("rows").alias(f"{n}_rows"), F.col("digest").alias(n)) for df, n in ((left, "left"), (right, "right")))
    joined = a.join(b, "leaf", "full").where(~F.col("left").eqNullSafe(F.col("right")))
    return joined.select("leaf", *[F.coalesce(f"{n}_rows", F.lit(0)).cast("long").alias(f"{n}_rows") for n in ("left", "right")])


def rows_of_leaves(df: DataFrame, key: str, leaves: DataFrame) -> DataFrame:
    """The rows of ``df`` in leaves of a tree, whose names tell its levels."""
    first = leaves.select(F.char_length("leaf")).first()
    if first is None:
        return df.limit(0)
    held = df.withColumn("_leaf", _leaf(key, first[0]))
    return held.join(leaves.select(F.col("leaf").alias("_leaf")), "_leaf", "left_semi").drop("_leaf")


def protocol_digest(root: str, files: list[str]) -> str:
    """SHA-256 over the sorted files' names and bytes."""
    h = hashlib.sha256()
    for name in sorted(files):
        with open(os.path.join(root, name), "rb") as f:
            h.update(name.encode() + b"\0" + f.read() + b"\0")
    return h.hexdigest()


def _git(root: str, *args: str) -> str | None:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
    return done.stdout.strip() if done.returncode == 0 else None


def run_manifest(spark: SparkSession, root: str, artifacts: dict[str, str], packages: tuple[str, ...] = ("pyspark", "pandas", "numpy", "pyarrow")) -> dict:
    """When, where and from what a run was made."""
    version = lambda p: metadata.version(p)
    conf = {k: v for k, v in spark.sparkContext.getConf().getAll() if k.startswith("spark.sql.")}
    return {
        "created_at_utc": datetime.now(timezone.utc).isoformat(),
        "python": platform.python_version(),
        "packages": {p: version(p) for p in packages},
        "spark": {"version": spark.version, "conf": conf},
        "git_commit": _git(root, "rev-parse", "HEAD"),
        "git_dirty": bool(_git(root, "status", "--porcelain")),
        "artifacts": {name: file_digest(path) for name, path in sorted(artifacts.items()) if os.path.exists(path)},
    }


def lock(manifest: DataFrame, key: str, digests: dict[str, str], **facts: object) -> dict:
    """A sealed manifest's digest, counts by class and split, and what it was made from."""
    counts = lambda c: {r[c]: r["count"] for r in manifest.groupBy(c).count().orderBy(c).collect()}
    return {"manifest_sha256": csv_digest(manifest, key), "rows": manifest.count(), "class_counts": counts("food_class"), "split_counts": counts("split"), "digests": digests, **facts}


class Sealed(RuntimeError):
    """There is a sealed manifest, or another writer came first."""


def _seals(spark: SparkSession, folder: str) -> list[str]:
    return [n for n in commit.names(spark, f"{folder}/seals") if n.endswith(".json")]


def sealed(spark: SparkSession, folder: str) -> dict | None:
    """The newest sealed manifest of a folder."""
    known = _seals(spark, folder)
    return json.loads(commit.read_text(spark, f"{folder}/seals/{known[-1]}")) if known else None


def prepare(spark: SparkSession, folder: str, tables: dict[str, DataFrame], force: bool = False) -> None:
    """Write a folder's tables. Never beside a sealed manifest; over older tables only with ``force``."""
    if _seals(spark, folder):
        raise Sealed(f"{folder} is sealed")
    there = [n for n in tables if commit.exists(spark, f"{folder}/{n}")]
    if there and not force:
        raise FileExistsError(f"{folder} has {', '.join(sorted(there))}")
    for name, table in tables.items():
        table.write.mode("overwrite" if force else "errorifexists").parquet(f"{folder}/{name}")


def seal(spark: SparkSession, folder: str, manifest: dict, force: bool = False) -> None:
    """Seal a folder with a lock. Of writers at the same time one wins, and the others get ``Sealed``.

    A sealed folder is sealed again only with ``force``, and only if the older lock's digests are those of the new one.
    """
    known = _seals(spark, folder)
    if known and not force:
        raise Sealed(f"{folder} is sealed")
    if known and (wrong := changed(sealed(spark, folder), manifest.get("digests", {}))):
        raise Sealed(f"{folder} was sealed with other digests of {', '.join(wrong)}")
    try:
        commit.put_if_absent(spark, f"{folder}/seals/{len(known):06d}.json", json.dumps(manifest, sort_keys=True))
    except commit.AlreadyThere:
        raise Sealed(f"{folder} was sealed by another writer") from None


def changed(lock: dict, digests: dict[str, str]) -> list[str]:
    """Names whose digest isn't the locked one."""
    return sorted(k for k, v in lock["digests"].items() if digests.get(k) != v)


def sealed_test_gate(required: dict[str, str], frozen: dict[str, str], confirmed: bool) -> list[str]:
    """Why the sealed test may not be opened: artifacts missing or changed, or no explicit consent."""
    out = [f"missing {n}" for n, p in sorted(required.items()) if not os.path.exists(p)]
    out += [f"changed {n}" for n, d in sorted(frozen.items()) if n in required and os.path.exists(required[n]) and file_digest(required[n]) != d]
    return out + ([] if confirmed else ["not confirmed"])


def render_results(metrics: dict) -> str:
    """The result page; only why it is blocked unless the metrics are complete."""
    if metrics.get("status") != "complete":
        return f"# Results\n\nStatus: **blocked**\n\n{metrics.get('reason', 'No complete run is recorded.')}\n"
    table = lambda head, rows: "\n".join(["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(map(str, r)) + " |" for r in rows)])
    f = lambda x: f"{x:.4f}" if isinstance(x, float) else "-" if x is None else str(x)
    names = ["micro_f1", "macro_f1_supported", "sample_f1", "exact_match"]
    systems = [[s["name"], *(f(s.get(n)) for n in names), f"[{f(s.get('ci_lower'))}, {f(s.get('ci_upper'))}]"] for s in metrics["systems"]]
    parts = ["# Results", table(["system", *names, "95% interval of micro F1"], systems)]
    if paired := metrics.get("paired"):
        parts.append(f"Paired difference: {f(paired['estimate'])} [{f(paired['ci_lower'])}, {f(paired['ci_upper'])}], p = {f(paired['p_value'])} ({paired['method']}).")
    for title in ("selection", "agreement", "vlm_quality", "counts"):
        if values := metrics.get(title):
            parts += [f"## {title.replace('_', ' ').capitalize()}", table(["measure", "value"], [[k, f(v)] for k, v in values.items()])]
    return "\n\n".join(parts) + "\n"
