"""Tables as CSV, JSON and Parquet: blanks stay blanks, writes don't replace by accident, JSON files are replaced whole."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, line_breaks: bool = True) -> DataFrame:
    """CSV files with a header; a blank cell is a blank text, quotes are doubled, a cell may hold line breaks.

    One task reads a whole file then; without ``line_breaks`` large files are split among tasks.
    """
    reader = spark.read.options(header=True, multiLine=line_breaks, escape='"', emptyValue="", nullValue="\0")
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str, replace: bool = False, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite" if replace else "errorifexists").options(header=True, escape='"', emptyValue="").csv(path)


def write_table(df: DataFrame, path: str, replace: bool = False) -> None:
    """Parquet; an existing table is kept unless ``replace``."""
    df.write.mode("overwrite" if replace else "errorifexists").parquet(path)


def write_json(value: object, path: str) -> None:
    """Write beside the file and rename, so a reader sees the old text or the new one."""
    own = f"{path}.{uuid.uuid4().hex}"
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(own, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False, sort_keys=True)
        f.write("\n")
    os.replace(own, path)


def read_json(path: str) -> object:
    with open(path, encoding="utf-8") as f:
        return json.load(f)

