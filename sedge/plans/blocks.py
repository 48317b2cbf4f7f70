"""Queries over blocks: conversion, filters, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B
from ..sources import tables
from .catalog import query
from .sql import STRIP, TOKENS, WORDS, statement

_CASES = " ".join(f"WHEN regexp_matches({STRIP.format('content')}, '{p}') THEN '{n}'" for n, _, p in B.PATTERNS)
_CATEGORY = " ".join(f"WHEN '{n}' THEN '{k}'" for n, k, _ in B.PATTERNS)
_QA = rf"""SELECT *, CASE WHEN tc IS NOT NULL THEN 'block_type' WHEN rule IS NOT NULL THEN rule WHEN place IS NOT NULL THEN 'positional' WHEN category IS NOT NULL THEN 'repetition' END AS qa_rule FROM (
  SELECT *, coalesce(first, CASE WHEN able AND row_number() OVER (PARTITION BY doc_id, CASE WHEN able THEN substr(norm, 1, 100) END ORDER BY pos) > 1 AND length(norm) <= {int(200 / B.SIMILARITY - 100)} THEN 'repetition' END) AS category FROM (
  SELECT *, coalesce(tc, CASE rule {_CATEGORY} END, place) AS first, coalesce(tc, CASE rule {_CATEGORY} END, place) IS NULL AND length(norm) >= 5 AS able FROM (
  SELECT *, CASE type WHEN 'header' THEN 'page_header' WHEN 'footer' THEN 'page_footer' END AS tc, CASE {_CASES} END AS rule,
  CASE WHEN len({WORDS.format('content')}) <= 15 AND y1 / (y1 + 50) < 0.1 THEN 'page_header' END AS place, {STRIP.format(r"regexp_replace(lower(content), '\s+', ' ', 'g')")} AS norm FROM decorated)))"""


def _qa(final: str) -> str:
    return statement(f", qa AS ({_QA})\n{final}", "decorated")


@query(
    "a3_text_metadata",
    rf"SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '' AND length(x) < 100)[1] AS title, CAST(len({WORDS.format('text')}) AS BIGINT) AS word_count, CAST(1 AS INTEGER) AS page_count FROM documents",
)
def text_metadata(spark, sf_dir):
    lines = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda x: (x != "") & (F.length(x) < 100))
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.get(lines, 0).alias("title"), T.word_count(F.col("text")).alias("word_count"), F.lit(1).alias("page_count"))


@query("a4_text_to_blocks", statement("SELECT doc_id, pos, block_id, type, content, heading_level, page FROM typed", "typed"))
def text_to_blocks(spark, sf_dir):
    return tables.blocks(spark, sf_dir)


@query(
    "b1_ruleset",
    "SELECT doc_type, CASE WHEN upper(doc_type) IN ('PARTS_CATALOG', 'PARTS_LIST') THEN 'parts_catalog' WHEN upper(doc_type) IN ('TECHNICAL_MANUAL', 'MAINTENANCE_MANUAL') THEN 'technical_manual' ELSE 'default' END AS ruleset, "
    "CASE WHEN upper(doc_type) IN ('PARTS_CATALOG', 'PARTS_LIST') THEN ['boilerplate', 'distribution', 'page_footer', 'page_header', 'repetition', 'toc'] ELSE ['boilerplate', 'distribution', 'index', 'page_footer', 'page_header', 'repetition', 'toc'] END AS categories "
    "FROM (SELECT DISTINCT ['parts_catalog', 'Technical_Manual', 'PARTS_LIST', 'report'][CAST(doc_id % 4 + 1 AS INTEGER)] AS doc_type FROM documents)",
)
def ruleset(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("parts_catalog", "Technical_Manual", "PARTS_LIST", "report")))
    docs = tables.table(spark, sf_dir, "documents").select(F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")).alias("doc_type")).distinct()
    return B.ruleset(docs)


@query("b2_qa_pattern", _qa("SELECT doc_id, pos, rule FROM qa WHERE rule IS NOT NULL"))
def qa_pattern(spark, sf_dir):
    rows = tables.decorated_blocks(spark, sf_dir)
    return rows.select("doc_id", "pos", B.pattern_rule(F.col("content")).alias("rule")).where("rule IS NOT NULL")


@query("b3_qa_block_type", _qa("SELECT doc_id, pos, tc AS category FROM qa WHERE tc IS NOT NULL"))
def qa_block_type(spark, sf_dir):
    rows = tables.decorated_blocks(spark, sf_dir)
    return rows.select("doc_id", "pos", B.type_category(F.col("type")).alias("category")).where("category IS NOT NULL")


@query("b4_qa_positional", _qa("SELECT doc_id, pos, place AS category FROM qa WHERE place IS NOT NULL"))
def qa_positional(spark, sf_dir):
    rows = tables.decorated_blocks(spark, sf_dir)
    return rows.select("doc_id", "pos", B.positional_category(F.col("content"), F.col("bbox")).alias("category")).where("category IS NOT NULL")


@query("b5_qa_repetition", _qa("SELECT doc_id, pos FROM qa WHERE category = 'repetition'"))
def qa_repetition(spark, sf_dir):
    return B.filter_blocks(tables.decorated_blocks(spark, sf_dir)).where("qa_category = 'repetition'").select("doc_id", "pos")


@query("b6_qa_filter", _qa("SELECT doc_id, pos, category IS NOT NULL AS qa_filtered, category AS qa_category, qa_rule FROM qa"))
def qa_filter(spark, sf_dir):
    return B.filter_blocks(tables.decorated_blocks(spark, sf_dir)).select("doc_id", "pos", "qa_filtered", "qa_category", "qa_rule")


@query("b7_qa_log", _qa("SELECT doc_id, block_id, category AS qa_category, qa_rule, substr(content, 1, 80) AS preview FROM qa WHERE category IS NOT NULL"))
def qa_log(spark, sf_dir):
    return B.filter_log(B.filter_blocks(tables.decorated_blocks(spark, sf_dir)))


@query("b8_qa_summary", _qa("SELECT doc_id, count(*) AS total, count(category) AS filtered, count(*) - count(category) AS passed, count(category) / count(*) AS ratio FROM qa GROUP BY doc_id"))
def qa_summary(spark, sf_dir):
    return B.filter_summary(B.filter_blocks(tables.decorated_blocks(spark, sf_dir)))


@query("b9_drop_filtered", _qa("SELECT doc_id, block_id FROM qa WHERE category IS NULL"))
def drop_filtered(spark, sf_dir):
    return B.filter_blocks(tables.decorated_blocks(spark, sf_dir)).where("NOT qa_filtered").select("doc_id", "block_id")


_CHARS = "content"
for _a, _b in B.CHARACTERS:
    _CHARS = f"replace({_CHARS}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"
_HYPHEN = r"regexp_replace({0}, '([\p{{L}}\p{{N}}_])-\n([a-z])', '\1\2', 'g')"
_CONT = r"regexp_replace(regexp_replace({0}, '(?im)\s*\(?continued\.?\)?\.?\s*$', '', 'g'), '(?i)^\s*\(?continued\s+(?:from|on)\s+(?:page\s+)?\d+\)?\.?\s*', '')"
_ART = r"regexp_replace({0}, '(?m)^\s*[.\-=_*~#]{{3,}}\s*$', '', 'g')"
_WS = STRIP.format(r"regexp_replace(regexp_replace({0}, '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
_CLEAN = f"""(SELECT *, {_WS.format('c4')} AS c5 FROM (SELECT *, {_ART.format('c3')} AS c4 FROM (SELECT *, {_CONT.format('c2')} AS c3 FROM
  (SELECT *, {_HYPHEN.format('c1')} AS c2 FROM (SELECT *, {_CHARS} AS c1 FROM decorated)))))"""


def _single(name: str, f, sql: str):
    @query(name, statement(f"SELECT doc_id, pos, {sql} AS cleaned FROM decorated", "decorated"))
    def plan(spark, sf_dir):
        return tables.decorated_blocks(spark, sf_dir).select("doc_id", "pos", f(F.col("content")).alias("cleaned"))


_single("b10_normalize_chars", B.normalize_chars, _CHARS)
_single("b11_repair_hyphenation", B.repair_hyphenation, _HYPHEN.format("content"))
_single("b12_remove_continuations", B.remove_continuations, _CONT.format("content"))
_single("b13_remove_artifacts", B.remove_artifacts, _ART.format("content"))
_single("b14_normalize_whitespace", B.normalize_whitespace, _WS.format("content"))
_OPS = "list_filter([" + ", ".join(f"CASE WHEN c{k} <> {'content' if k == 1 else f'c{k - 1}'} THEN '{n}' END" for k, (n, _) in enumerate(B.CLEANERS, 1)) + "], lambda x: x IS NOT NULL)"


@query("b15_clean_blocks", statement(f"SELECT doc_id, pos, c5 AS cleaned, array_to_string({_OPS}, ',') AS operations FROM {_CLEAN}", "decorated"))
def clean_blocks(spark, sf_dir):
    rows = B.clean_blocks(tables.decorated_blocks(spark, sf_dir))
    return rows.select("doc_id", "pos", "cleaned", F.array_join("operations", ",").alias("operations"))


@query("b16_clean_summary", statement(f"SELECT operation, count(*) AS blocks FROM (SELECT unnest({_OPS}) AS operation FROM {_CLEAN}) GROUP BY operation", "decorated"))
def clean_summary(spark, sf_dir):
    return B.clean_summary(B.clean_blocks(tables.decorated_blocks(spark, sf_dir)))


@query(
    "b17_is_page_marker",
    statement("SELECT doc_id, pos FROM decorated WHERE " + " OR ".join(f"regexp_matches(content, '{p}')" for p in B.PAGE_MARKERS), "decorated"),
)
def is_page_marker(spark, sf_dir):
    return tables.decorated_blocks(spark, sf_dir).where(B.is_page_marker(F.col("content"))).select("doc_id", "pos")


@query(
    "b18_sanitize_text",
    "SELECT page_id, substr("
    + STRIP.format(r"regexp_replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')").replace('\\"', '"')
    + ", 1, 1000) AS clean FROM pages",
)
def sanitize_text(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select("page_id", T.sanitize(F.col("html")).alias("clean"))


@query("c1_token_count", f"SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents")
def token_count(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))
