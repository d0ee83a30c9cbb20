"""Label ontologies: alias tables, phrase extraction and the reading and writing of label cells.

An ontology is a driver-side parameter; its size is that of a label list, so its maps and patterns stand in the plan.
"""

from __future__ import annotations

import functools
import json
import operator
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import normalize


def _plain(text: str) -> str:
    import unicodedata

    return " ".join(unicodedata.normalize("NFKC", text).lower().translate({95: 32, 45: 32}).split())


#: Keys of an answer (fixed values), as the parser of answers wants them, and what they hold.
ANSWER_KEYS = {
    "food_name": "text, a name or unknown",
    "visible_ingredients": "list of ids that can be seen",
    "uncertain_ingredients": "list of other ids that may be there",
    "abstain": "true, with empty lists, if there is nothing to assess, else false",
    "reason": "text, one sentence",
}


@dataclass(frozen=True)
class Label:
    id: str
    category: str = ""
    aliases: tuple[str, ...] = ()
    hint: str = ""


@dataclass(frozen=True)
class Ontology:
    """Labels in their canonical order. Ids must be unique and no alias may stand for two of them."""

    labels: tuple[Label, ...]
    version: str = ""
    scope: str = ""
    by_alias: dict[str, str] = field(init=False, compare=False)

    def __post_init__(self) -> None:
        if len({x.id for x in self.labels}) < len(self.labels):
            raise ValueError("label ids repeat")
        pairs = {(_plain(a), x.id) for x in self.labels for a in (x.id, *x.aliases)}
        clash = sorted(a for a in {a for a, _ in pairs} if len({i for b, i in pairs if b == a}) > 1) if len(dict(pairs)) < len(pairs) else []
        if clash:
            raise ValueError(f"aliases of several labels: {clash}")
        object.__setattr__(self, "by_alias", dict(sorted(pairs)))

    @classmethod
    def read(cls, path: str) -> Ontology:
        """From JSON with version, scope and labels of id, category, aliases and hint."""
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        return cls(tuple(Label(x["id"], x["category"], tuple(x["aliases"]), x["hint"]) for x in data["labels"]), data["version"], data["scope"])

    @property
    def ids(self) -> list[str]:
        return [x.id for x in self.labels]

    @property
    def pattern(self) -> str:
        """Longest alias first, between characters other than small ASCII letters and digits."""
        longest = sorted(self.by_alias, key=lambda a: (-len(a), a))
        return "(?<![a-z0-9])(" + "|".join(re.escape(a) for a in longest) + ")(?![a-z0-9])"

    def _map(self) -> Column:
        return F.create_map(*[F.lit(x) for pair in self.by_alias.items() for x in pair])

    def ordered(self, ids: Column) -> Column:
        """Distinct known ids in canonical order."""
        return F.array_intersect(F.array(*map(F.lit, self.ids)), ids)

    def extract(self, text: Column, normalised: bool = False) -> Column:
        """Labels whose aliases occur in the text; blank for null."""
        plain = F.coalesce(text if normalised else normalize(text), F.lit(""))
        hits = F.regexp_extract_all(plain, F.lit(self.pattern), F.lit(1))
        return self.ordered(F.transform(F.array_distinct(hits), lambda a: F.element_at(self._map(), a)))

    def of_items(self, items: Column) -> Column:
        """Labels in a list of texts; an alias never spans two of them."""
        return self.extract(F.array_join(items, " ; "))

    def canonical(self, value: Column) -> Column:
        """The id of an alias, or null."""
        return F.try_element_at(self._map(), normalize(value))

    def parse_cell(self, cell: Column) -> Column:
        """Struct of labels (canonical order) and unknown (parts without a label) of a cell separated by |, comma or semicolon."""
        text = F.trim(F.coalesce(cell, F.lit("")))
        blank = (text == "") | (F.lower(text) == "nan")
        parts = F.filter(F.transform(F.split(text, r"[|,;]"), lambda x: F.trim(x)), lambda x: x != "")
        parts = F.when(blank, F.array().cast("array<string>")).otherwise(parts)
        known = F.transform(parts, lambda x: self.canonical(x))
        return F.struct(
            self.ordered(F.filter(known, lambda x: x.isNotNull())).alias("labels"),
            F.filter(parts, lambda x: self.canonical(x).isNull()).alias("unknown"),
        )

    def serialize(self, ids: Column) -> Column:
        """Known ids joined by | in canonical order; fails on an unknown one."""
        unknown = F.array_except(ids, F.array(*map(F.lit, self.ids)))
        checked = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown labels: "), F.array_join(unknown, ",")))).otherwise(F.lit(True))
        return F.when(checked, F.array_join(self.ordered(ids), "|"))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, x.id, x.category, x.hint) for i, x in enumerate(self.labels)], "idx int, label string, category string, hint string")

    def prompt(self, task: str, rules: tuple[str, ...] = (), version: str = "", hints: bool = False) -> str:
        """Instructions for a model: the task, the answer's keys, the only ids allowed (by category, with hints if asked for), rules."""
        parts = [task]
        if rules or version or hints:
            parts += ["The answer is one JSON object with these keys and no others:", *(f"  {key}: {what}" for key, what in ANSWER_KEYS.items())]
        parts.append(f"Allowed ids: {', '.join(self.ids)}")
        if hints:
            for category in dict.fromkeys(x.category for x in self.labels):
                parts.append(f"  {category or 'other'}: " + "; ".join(f"{x.id} ({x.hint})" if x.hint else x.id for x in self.labels if x.category == category))
        parts += [f"- {rule}" for rule in rules]
        return "\n".join(parts + ([f"Version: {version}"] if version else []))

    def cells(self, samples: DataFrame, labels_col: str) -> DataFrame:
        """The label matrix in long form: one row for each sample and label, with y."""
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(x).alias("label")) for i, x in enumerate(self.ids)]))
        return samples.withColumn("_l", each).select(
            "*", F.col("_l.idx").alias("idx"), F.col("_l.label").alias("label"), F.coalesce(F.array_contains(labels_col, F.col("_l.label")), F.lit(False)).cast("int").alias("y")
        ).drop("_l")


def names_match(name: Column, of_class: Column, aliases: dict[str, list[str]]) -> Column:
    """Whether a name is an alias of its class; a class without aliases has its own name only."""
    plain = normalize(name)
    cases = [(of_class == k) & plain.isin(*sorted({_plain(a) for a in [k, *v]})) for k, v in aliases.items()]
    own = ~of_class.isin(*aliases) if aliases else F.lit(True)
    return functools.reduce(operator.or_, cases, own & (plain == normalize(of_class)))
