"""Text columns: stripping, case tests and token estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; only the ends are looked at."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def tokens(c: Column) -> Column:
    """Estimated tokens: a quarter of the characters, at least 1 unless empty."""
    n = F.length(c)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("bigint")


def all_upper(c: Column) -> Column:
    """At least one upper-case letter and no lower-case one."""
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}")


def starts_upper(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}")


def starts_lower(c: Column) -> Column:
    return c.rlike(r"^\p{Ll}")


def word_count(c: Column) -> Column:
    return F.size(F.array_remove(F.split(c, r"\s+"), "")).cast("bigint")


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, r"\s+"), "")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def sanitize(c: Column, limit: int = 1000) -> Column:
    """HTML-escaped, without control characters, stripped, cut at ``limit``."""
    clean = F.regexp_replace(html_escape(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.substring(strip(clean), 1, limit)


def token_set(c: Column) -> Column:
    """Distinct words of a text in lower case without punctuation."""
    kept = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", "")
    return F.array_distinct(words(kept))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Shared share of two sets given as arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).otherwise(F.size(F.array_intersect(a, b)) / union)
