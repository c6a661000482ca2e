"""Scalar cleaning and text features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vireo.functions.vectors import let


def strip(c: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def identifier(c: Column) -> Column:
    """Stripped text; blank or missing ids are null."""
    s = strip(c.cast("string"))
    return F.when(s != "", s)


def venue(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))


def year(c: Column) -> Column:
    """Integer part of a number between 1000 and 2100, else null."""
    y = strip(c.cast("string")).try_cast("double")
    whole = F.when(y > 0, F.floor(y))
    return F.when(whole.between(1000, 2100), whole.cast("int"))


def epoch(c: Column) -> Column:
    """Seconds: blank is 0, then a number, then ISO-8601 in UTC, else a hash below 1e9."""
    s = strip(c.cast("string"))
    iso = F.try_to_timestamp(s)
    return F.coalesce(
        F.when(s.isNull() | (s == ""), F.lit(0.0)),
        s.try_cast("double"),
        F.unix_micros(iso) / 1e6,
        F.pmod(F.xxhash64(s), F.lit(1_000_000_000)).cast("double"),
    )


def keywords(c: Column) -> Column:
    """List of words to one string; blanks go."""
    return F.array_join(F.filter(F.transform(c, strip), lambda x: x != ""), " ")


def number(c: Column) -> Column:
    """Blank or missing is 0; otherwise the number, or null if it is none or not finite."""
    s = strip(c.cast("string"))
    x = s.try_cast("double")
    return F.when(s.isNull() | (s == ""), F.lit(0.0)).when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def bucket(token: Column, dim: int) -> Column:
    """Little-endian first four bytes of the MD5 digest, mod ``dim``."""
    h = F.md5(token.cast("binary"))
    little = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return (F.conv(little, 16, 10).cast("long") % dim).cast("int")


def hash_features(c: Column, dim: int) -> Column:
    """Token counts in ``dim`` hash buckets, as a dense array."""
    places = F.transform(tokens(c), lambda t: bucket(t, dim))
    return let(places, lambda own: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.size(F.filter(own, lambda p: p == j)).cast("double")))


def statistics(c: Column) -> Column:
    """(words, chars, log1p of words) of a text."""
    words = F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.struct(words.alias("words"), F.length(F.coalesce(c, F.lit(""))).alias("chars"), F.log1p(words.cast("double")).alias("log_words"))
