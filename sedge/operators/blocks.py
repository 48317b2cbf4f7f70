"""Filters and cleaners of blocks: rules are ordered cases over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# Patterns of the filter, in the order in which they are tried.
PATTERNS = (
    ("toc_heading", "toc", r"(?i)^table\s+of\s+contents\s*$"),
    ("toc_heading_short", "toc", r"(?i)^contents\s*$"),
    ("toc_dotleader", "toc", r"(?i)^.*\.{3,}\s*\d+\s*$"),
    ("index_heading", "index", r"(?i)^index\s*$"),
    ("index_alpha", "index", r"(?i)^alphabetical\s+index\s*$"),
    ("distro_statement", "distribution", r"(?i)^distribution\s+statement"),
    ("distro_approved", "distribution", r"(?i)approved\s+for\s+public\s+release"),
    ("distro_unlimited", "distribution", r"(?i)distribution\s+is\s+unlimited"),
    ("intentionally_blank", "boilerplate", r"(?i)this\s+page\s+intentionally\s+left\s+blank"),
    ("fouo", "boilerplate", r"(?i)^for\s+official\s+use\s+only"),
    ("proprietary", "boilerplate", r"(?i)proprietary.*confidential"),
)
CATEGORIES = ("toc", "index", "distribution", "boilerplate", "page_header", "page_footer", "repetition")
#: Document types whose index entries are content.
KEEP_INDEX = ("PARTS_CATALOG", "PARTS_LIST")
# What the cleaner replaces by what.
CHARACTERS = (
    ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "--"), ("…", "..."), (" ", " "),
)
# Page markers and continuation marks.
PAGE_MARKERS = (r"(?i)^\s*page\s+\d+\s*(?:of\s+\d+)?\s*$", r"^\s*-\s*\d+\s*-\s*$", r"^\s*\d+\s*$")
CONTINUED = r"(?im)\s*\(?continued\.?\)?\.?\s*$"
CONTINUED_FROM = r"(?i)^\s*\(?continued\s+(?:from|on)\s+(?:page\s+)?\d+\)?\.?\s*"
ARTIFACT_LINE = r"(?m)^\s*[.\-=_*~#]{3,}\s*$"

KEY_LENGTH, SIMILARITY, SHORTEST = 100, 0.85, 5
MARGIN, MARGIN_WORDS = 0.10, 15


def ruleset(doc_types: DataFrame) -> DataFrame:
    """Active categories of each document type."""
    every = F.array(*map(F.lit, CATEGORIES))
    active = F.when(F.upper("doc_type").isin(*KEEP_INDEX), F.array_remove(every, "index")).otherwise(every)
    name = (
        F.when(F.upper("doc_type").isin(*KEEP_INDEX), "parts_catalog")
        .when(F.upper("doc_type").isin("TECHNICAL_MANUAL", "MAINTENANCE_MANUAL"), "technical_manual").otherwise("default")
    )
    return doc_types.select("doc_type", name.alias("ruleset"), F.array_sort(active).alias("categories"))


def pattern_rule(content: Column) -> Column:
    """The name of the first pattern that a block's text meets."""
    c, out = strip(content), None
    for name, _, pattern in PATTERNS:
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out


def category_of(rule: Column) -> Column:
    return F.create_map(*[F.lit(x) for n, k, _ in PATTERNS for x in (n, k)])[rule]


def type_category(kind: Column) -> Column:
    return F.when(kind == "header", "page_header").when(kind == "footer", "page_footer")


def positional_category(content: Column, bbox: Column) -> Column:
    """A short block at the top: its upper edge within a tenth of its lower."""
    few = F.size(F.array_remove(F.split(content, r"\s+"), "")) <= MARGIN_WORDS
    return F.when(bbox.isNotNull() & (bbox["y2"] > 0) & few & (bbox["y1"] / bbox["y2"] < MARGIN), "page_header")


def filter_blocks(blocks: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Stamps ``qa_filtered``, ``qa_category`` and ``qa_rule`` on every block.

    A block repeats an earlier kept one if the first 100 characters of both are
    equal but for case and spaces; the similarity of a text and its first 100
    characters depends on its length only, so the threshold is a length."""
    rule = pattern_rule(F.col("content"))
    rows = blocks.withColumns(
        {
            "__rule": rule,
            "__type": type_category(F.col("type")),
            "__place": positional_category(F.col("content"), F.col("bbox")),
            "__norm": strip(F.regexp_replace(F.lower("content"), r"\s+", " ")),
        }
    )
    first = F.coalesce("__type", category_of(F.col("__rule")), "__place")
    longest = int(2 * KEY_LENGTH / threshold - KEY_LENGTH)
    able = first.isNull() & (F.length("__norm") >= SHORTEST)
    w = Window.partitionBy("doc_id", F.when(able, F.substring("__norm", 1, KEY_LENGTH))).orderBy("pos")
    rows = rows.withColumns({"__first": first, "__able": able})
    seen = F.row_number().over(w) > 1
    repeat = F.when(F.col("__able") & seen & (F.length("__norm") <= longest), "repetition")
    rows = rows.withColumn("qa_category", F.coalesce("__first", repeat))
    name = (
        F.when(F.col("__type").isNotNull(), "block_type").when(F.col("__rule").isNotNull(), F.col("__rule"))
        .when(F.col("__place").isNotNull(), "positional").when(F.col("qa_category").isNotNull(), "repetition")
    )
    return rows.withColumns({"qa_filtered": F.col("qa_category").isNotNull(), "qa_rule": name}).drop("__rule", "__type", "__place", "__norm", "__first", "__able")


def filter_log(filtered: DataFrame) -> DataFrame:
    return filtered.where("qa_filtered").select("doc_id", "block_id", "qa_category", "qa_rule", F.substring("content", 1, 80).alias("preview"))


def filter_summary(filtered: DataFrame) -> DataFrame:
    n = F.count_if("qa_filtered")
    return filtered.groupBy("doc_id").agg(F.count("*").alias("total"), n.alias("filtered"), (F.count("*") - n).alias("passed"), (n / F.count("*")).alias("ratio"))


def normalize_chars(c: Column) -> Column:
    for a, b in CHARACTERS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def repair_hyphenation(c: Column) -> Column:
    return F.regexp_replace(c, r"([\p{L}\p{N}_])-\n([a-z])", "$1$2")


def remove_continuations(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, CONTINUED, ""), CONTINUED_FROM, "")


def remove_artifacts(c: Column) -> Column:
    return F.regexp_replace(c, ARTIFACT_LINE, "")


def normalize_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


CLEANERS = (
    ("normalize_chars", normalize_chars), ("repair_hyphenation", repair_hyphenation), ("remove_continuations", remove_continuations),
    ("remove_artifacts", remove_artifacts), ("normalize_whitespace", normalize_whitespace),
)


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """``cleaned`` and the names of the operations that changed a text."""
    rows, before = blocks.withColumn("__c0", F.col("content")), "__c0"
    for k, (_, f) in enumerate(CLEANERS, 1):
        rows = rows.withColumn(f"__c{k}", f(F.col(before)))
        before = f"__c{k}"
    ops = F.array_compact(F.array(*[F.when(F.col(f"__c{k}") != F.col(f"__c{k - 1}"), n) for k, (n, _) in enumerate(CLEANERS, 1)]))
    return rows.withColumns({"cleaned": F.col(before), "operations": ops}).drop(*[f"__c{k}" for k in range(len(CLEANERS) + 1)])


def clean_summary(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(F.explode("operations").alias("operation")).groupBy("operation").agg(F.count("*").alias("blocks"))


def is_page_marker(c: Column) -> Column:
    out = F.lit(False)
    for p in PAGE_MARKERS:
        out = out | c.rlike(p)
    return out
