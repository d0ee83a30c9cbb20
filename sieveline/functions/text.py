"""Scalar text expressions: normalising, coercing, hashing, slugs and domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as true and as false in a sheet, and the host prefixes of which one is dropped.
TRUE, FALSE = ("true", "1", "yes", "y"), ("false", "0", "no", "n", "")
HOST_PREFIX = r"^(?:www|m|amp)\."


def normalize_ascii(c: Column) -> Column:
    """``normalize`` for text that is in compatibility form already."""
    return F.trim(F.regexp_replace(F.lower(F.translate(c, "_-", "  ")), r"(?U)\s+", " "))


def nfkc(c: Column) -> Column:
    """Unicode's compatibility form, by the normaliser in the JVM that Spark brings along for its collations."""
    form = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    return F.when(c.rlike(r"[^\x00-\x7f]"), form).otherwise(c)


def normalize(c: Column) -> Column:
    """In compatibility form, lower case, _ and - as spaces, white space collapsed and stripped."""
    return normalize_ascii(nfkc(c))


def parse_boolean(c: Column) -> Column:
    """True or false by the fixed words, null for anything else (a null counts as blank)."""
    word = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)


def tidy(c: Column) -> Column:
    """Trimmed, lower case, blank for null."""
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def hash_bits(hex16: Column) -> Column:
    """A 64-bit pattern from 16 hex characters."""
    return F.conv(hex16, 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit patterns."""
    return F.bit_count(a.bitwiseXOR(b))


def short_id(sha: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.substring(sha, 1, 16))


def slug(title: Column, fallback: Column) -> Column:
    """Words of the title, or of the fallback where it is blank, joined by -; the normalised fallback where none is left."""
    of = F.coalesce(F.nullif(F.trim(title), F.lit("")), fallback)
    made = F.regexp_replace(F.regexp_replace(normalize(of), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(made, F.lit("")), normalize(fallback))


def domain(url: Column) -> Column:
    """Lower-case host without outer points and without one prefix; blank where there is none."""
    host = F.btrim(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), F.lit("."))
    return F.regexp_replace(host, HOST_PREFIX, "")


def evidence_hash(title: Column, snippet: Column, url: Column) -> Column:
    """SHA-256 of the normalised title and snippet and the trimmed url, a line each."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.concat_ws("\n", normalize(blank(title)), normalize(blank(snippet)), F.trim(blank(url))), 256)


def special_status(unreadable: Column, non_food: Column, no_label: Column) -> Column:
    """The first flag that is set, by precedence; blank if none."""
    return F.when(unreadable, "unreadable").when(non_food, "non_food").when(no_label, "no_visible_ontology_label").otherwise("")


def column_slug(name: str) -> str:
    """A system's name as part of a column's name."""
    return name.lower().replace(" ", "_").replace("-", "_")


def loss_mask(ids: Column, attention: Column, start: Column, ignored: int = -100) -> Column:
    """ids from ``start`` on where attention is 1, else ``ignored``; null for lengths that differ or other attention values."""
    fits = (F.size(ids) == F.size(attention)) & (start >= 0) & (start <= F.size(ids)) & F.forall(attention, lambda a: a.isin(0, 1))
    kept = F.transform(F.arrays_zip(ids.alias("t"), attention.alias("a")), lambda x, i: F.when((i >= start) & (x["a"] == 1), x["t"]).otherwise(ignored))
    return F.when(fits, kept)
