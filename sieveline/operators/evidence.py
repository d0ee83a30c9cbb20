"""Votes of independent sources for labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.ontology import Ontology


def source_votes(evidence: DataFrame, ontology: Ontology, minimum: int = 2) -> DataFrame:
    """food_class, label, independent_sources, accepted: in how many domains' titles and snippets a label of a class occurs.

    Rows with a blank domain don't vote; a label is accepted from ``minimum`` domains on.
    """
    said = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))
    voting = evidence.where(F.trim(F.coalesce("domain", F.lit(""))) != "")
    votes = voting.select("food_class", "domain", F.explode(ontology.extract(said)).alias("label")).distinct()
    counted = votes.groupBy("food_class", "label").agg(F.count("*").alias("independent_sources"))
    return counted.withColumn("accepted", F.col("independent_sources") >= minimum)
