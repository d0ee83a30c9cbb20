"""Recipe tables: which file, which image, which labels, which group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.ontology import Ontology
from sieveline.functions.text import slug
from sieveline.operators.records import item_list
from sieveline.sources.tables import read_csv


def largest_csv(spark: SparkSession, root: str) -> str:
    """The path of the largest CSV file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.lower("path").endswith(".csv"))
    path = files.agg(F.max_by("path", "length").alias("p")).first()["p"]
    if path is None:
        raise FileNotFoundError(f"no CSV file below {root}")
    return path


def _name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def image_index(paths: DataFrame, path: str = "path") -> DataFrame:
    """key, path: lower-case names and stems that stand for one path only."""
    name = _name(F.col(path))
    keys = paths.select(F.explode(F.array_distinct(F.array(name, _stem(name)))).alias("key"), F.col(path).alias("path"))
    return keys.groupBy("key").agg(F.min("path").alias("path"), F.max("path").alias("_z")).where(F.col("path") == F.col("_z")).drop("_z")


def resolve_images(recipes: DataFrame, paths: DataFrame, reference: str, path: str = "path") -> DataFrame:
    """``recipes`` with image_path: the exact relative path, else an unambiguous name, else an unambiguous stem, else null."""
    wanted = F.regexp_replace(F.trim(F.coalesce(reference, F.lit(""))), r"\\", "/")
    index = image_index(paths, path)
    named = recipes.withColumns({"_e": wanted, "_n": _name(wanted)}).withColumn("_s", _stem(F.col("_n")))
    exact = paths.select(F.col(path).alias("_p0")).distinct()
    by_name, by_stem = (index.select(F.col("key").alias(f"_k{i}"), F.col("path").alias(f"_p{i}")) for i in (1, 2))
    out = named.join(exact, F.col("_e") == F.col("_p0"), "left").join(by_name, F.col("_n") == F.col("_k1"), "left").join(by_stem, F.col("_s") == F.col("_k2"), "left")
    found = F.when(F.col("_e") != "", F.coalesce("_p0", "_p1", "_p2"))
    return out.select(*recipes.columns, found.alias("image_path"))


def prepare(recipes: DataFrame, paths: DataFrame, ontology: Ontology, title: str = "Title", items: str = "Ingredients", image: str = "Image_Name") -> DataFrame:
    """``recipes`` with labels, image_path and group_id, for rows that have an image and a label; fails if none has."""
    labelled = recipes.withColumn("labels", ontology.of_items(item_list(F.col(items))))
    out = resolve_images(labelled, paths, image).where("image_path is not null and size(labels) > 0")
    out = out.withColumn("group_id", slug(F.col(title), F.col(image)))
    if out.isEmpty():
        raise ValueError("no recipe has both an image and a label")
    return out


def read_recipes(spark: SparkSession, root: str) -> DataFrame:
    return read_csv(spark, largest_csv(spark, root))
