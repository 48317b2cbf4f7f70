"""Queries over sections and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks as C
from ..operators import sections as S
from ..sources import tables
from .catalog import query
from .sql import STRIP, TOKENS, statement

_REFS = " OR ".join(f"regexp_matches(lower(content), '{p}')" for p in C.ORPHAN_REFERENCES)
_STRIPPED = STRIP.format("content")
def _scores(table: str) -> str:
    return rf"""SELECT *, round(token_range * 0.25 + sentences * 0.2 + hierarchy * 0.25 + tables * 0.15 + "references" * 0.15, 6) AS overall FROM (SELECT *,
  CASE WHEN token_count BETWEEN 200 AND 500 THEN 1.0 WHEN token_count < 100 THEN greatest(0.3, token_count / 100) WHEN token_count < 200 THEN 0.8 WHEN token_count <= 600 THEN 0.85
    ELSE greatest(0.3, 1.0 - least(0.5, (token_count - 600) / 500)) END::DOUBLE AS token_range,
  CASE WHEN {_STRIPPED} = '' THEN 1.0 ELSE greatest(0.3, round(1.0 - CASE WHEN regexp_matches({_STRIPPED}, '^(\p{{Lu}}|["''(\[])') THEN 0.0 ELSE 0.3 END
    - CASE WHEN regexp_matches({_STRIPPED}, '[.!?:"'')\]]$') THEN 0.0 ELSE 0.3 END - CASE WHEN regexp_matches({_STRIPPED}, '^({"|".join(C.BAD_STARTS)})') THEN 0.2 ELSE 0.0 END, 6)) END::DOUBLE AS sentences,
  CASE WHEN last_type = 'heading' THEN 0.4 WHEN has_heading AND NOT has_content THEN 0.5 ELSE 1.0 END::DOUBLE AS hierarchy, CASE WHEN has_broken_table THEN 0.7 ELSE 1.0 END::DOUBLE AS tables,
  CASE WHEN {_REFS} THEN 0.6 ELSE 1.0 END::DOUBLE AS "references" FROM {table})"""


_SCORES = _scores("chunks")


def scored_sql(final: str) -> str:
    """A statement over the scored chunks."""
    return statement(f", scored AS ({_SCORES})\n{final}", "chunks")


@query(
    "entry_report",
    scored_sql(
        "SELECT source, lang, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, sum(CAST(round(overall * 1000000) AS BIGINT)) / count(*) / 1000000 AS quality, count(*) FILTER (overall < 0.7) AS problems "
        "FROM scored JOIN documents USING (doc_id) GROUP BY source, lang"
    ),
)
def report(spark, sf_dir):
    """From texts to blocks, sections, chunks and quality, by source and language."""
    scored = C.quality(tables.chunks(spark, sf_dir)).select("doc_id", "token_count", "overall")
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return scored.join(docs, "doc_id").groupBy("source", "lang").agg(
        F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), C.mean_score().alias("quality"), F.count_if(F.col("overall") < 0.7).alias("problems")
    )


WINDOW_TOKENS, FIRST_TOKENS = 100, 50


@query("c2_split_by_tokens", f"SELECT doc_id, k AS part, substr(text, CAST({4 * WINDOW_TOKENS} * k + 1 AS BIGINT), {4 * WINDOW_TOKENS}) AS content FROM (SELECT doc_id, text, unnest(range(greatest((length(text) + {4 * WINDOW_TOKENS - 1}) // {4 * WINDOW_TOKENS}, 1))) AS k FROM documents)")
def split_by_tokens(spark, sf_dir):
    return C.split_by_tokens(tables.table(spark, sf_dir, "documents"), WINDOW_TOKENS)


@query("c2_truncate_tokens", f"SELECT doc_id, substr(text, 1, {4 * FIRST_TOKENS}) AS content FROM documents")
def truncate_tokens(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", C.truncate_tokens(F.col("text"), FIRST_TOKENS).alias("content"))


@query("c3_assign_sections", statement("SELECT doc_id, pos, section_no FROM sectioned", "sectioned"))
def assign_sections(spark, sf_dir):
    return S.assign_sections(tables.outline_blocks(spark, sf_dir)).select("doc_id", "pos", "section_no")


@query("c4_hierarchy_path", statement("SELECT doc_id, pos, array_to_string(path, ' > ') AS hierarchy_path, CAST(len(path) AS BIGINT) AS depth, CASE WHEN len(path) > 1 THEN path[-2] END AS parent FROM pathed", "pathed"))
def hierarchy_path(spark, sf_dir):
    return S.with_paths(tables.outline_blocks(spark, sf_dir)).select("doc_id", "pos", "hierarchy_path", "depth", "parent")


_TOC = "toc AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq, heading_level AS level, content AS title, page FROM outline WHERE type = 'heading' AND heading_level <= 2)"


def _toc(spark, sf_dir):
    from pyspark.sql import Window

    rows = tables.outline_blocks(spark, sf_dir).where("type = 'heading' AND heading_level <= 2")
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return rows.select("doc_id", seq.alias("seq"), F.col("heading_level").alias("level"), F.col("content").alias("title"), "page")


@query(
    "c5_outline_match",
    statement(
        f", {_TOC}, t AS (SELECT doc_id, {STRIP.format('lower(title)')} AS k, arg_max(level, seq) AS toc_level FROM toc GROUP BY ALL)\n"
        f"SELECT o.doc_id, pos, coalesce(toc_level, heading_level, 1) AS level FROM outline o LEFT JOIN t ON o.doc_id = t.doc_id AND {STRIP.format('lower(o.content)')} = t.k WHERE type = 'heading'",
        "outline",
    ),
)
def outline_match(spark, sf_dir):
    key = lambda c: T.strip(F.lower(c))
    toc = _toc(spark, sf_dir).groupBy("doc_id", key("title").alias("k")).agg(F.max_by("level", "seq").alias("toc_level"))
    rows = tables.outline_blocks(spark, sf_dir).where("type = 'heading'").select("doc_id", "pos", "heading_level", key("content").alias("k"))
    return rows.join(toc, ["doc_id", "k"], "left").select("doc_id", "pos", F.coalesce("toc_level", "heading_level", F.lit(1)).alias("level"))


@query("c6_outline_page_ends", statement(f", {_TOC}\nSELECT doc_id, seq, level, page, greatest(page, lead(page) OVER (PARTITION BY doc_id, level ORDER BY seq) - 1) AS page_end FROM toc", "outline"))
def outline_page_ends(spark, sf_dir):
    return S.outline_page_ends(_toc(spark, sf_dir)).select("doc_id", "seq", "level", "page", "page_end")


def _key(c: str) -> str:
    bare = STRIP.format(f"lower({c})")
    return f"regexp_replace(regexp_replace({bare}, '^\\d+(\\.\\d+)*\\.?\\s*', ''), '\\s+', ' ', 'g')"


@query(
    "c7_blocks_to_outline",
    statement(
        f""", {_TOC}, entries AS (SELECT *, coalesce(lead(level) OVER (PARTITION BY doc_id ORDER BY seq) > level, false) AS inner_entry FROM toc),
met AS (SELECT t.doc_id, t.seq, t.inner_entry, o.pos, o.block_id, o.type = 'heading' AND {_key('o.content')} = {_key('t.title')} AS bears FROM entries t JOIN outline o ON t.doc_id = o.doc_id AND t.page = o.page),
marked AS (SELECT *, coalesce(pos = min(pos) FILTER (bears) OVER (PARTITION BY doc_id, seq), false) AS is_heading FROM met)
SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id, seq ORDER BY is_heading DESC, pos) AS place, block_id, is_heading FROM marked WHERE is_heading OR NOT inner_entry""",
        "outline",
    ),
)
def blocks_to_outline(spark, sf_dir):
    return S.blocks_to_outline(_toc(spark, sf_dir), tables.outline_blocks(spark, sf_dir))


@query(
    "c8_heading_confidence",
    statement(r"SELECT doc_id, pos, least(1.0, round(0.5 + CASE WHEN heading_level IS NOT NULL THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(content, '^\d+(\.\d+)*\s') THEN 0.2 ELSE 0 END + CASE WHEN length(content) < 100 THEN 0.1 ELSE 0 END + CASE WHEN pos % 10 = 5 THEN 0.1 ELSE 0 END, 6))::DOUBLE AS confidence "
              "FROM (SELECT * REPLACE (CASE WHEN pos % 3 = 0 THEN pos || '.1 ' || content ELSE content END AS content, CASE WHEN pos % 4 > 0 THEN heading_level END AS heading_level) FROM outline) WHERE type = 'heading'", "outline"),
)
def heading_confidence(spark, sf_dir):
    """Some headings with numbers, in bold, or without a level."""
    pos = F.col("pos")
    content = F.when(pos % 3 == 0, F.concat("pos", F.lit(".1 "), "content")).otherwise(F.col("content"))
    rows = tables.outline_blocks(spark, sf_dir)
    return S.heading_confidence(rows.withColumns({"content": content, "bold": pos % 10 == 5, "heading_level": F.when(pos % 4 > 0, F.col("heading_level"))}))


@query(
    "c9_section_id",
    statement(
        r"SELECT doc_id, pos, coalesce(nullif(regexp_extract(trim(t), '^(\d+(?:\.\d+)*)', 1), ''), nullif(regexp_extract(trim(t), '^([A-Z]\.\d+(?:\.\d+)*)', 1), ''), trim(regexp_replace(substr(trim(t), 1, 50), '[<>:\"/\\|?*]', '', 'g'))) AS section_id "
        "FROM (SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN pos || '.2 ' || content WHEN 1 THEN 'A.' || pos || ' ' || content ELSE content END AS t FROM outline WHERE type = 'heading')",
        "outline",
    ),
)
def section_ids(spark, sf_dir):
    k = F.col("pos") % 3
    t = F.when(k == 0, F.concat("pos", F.lit(".2 "), "content")).when(k == 1, F.concat(F.lit("A."), "pos", F.lit(" "), "content")).otherwise(F.col("content"))
    return tables.outline_blocks(spark, sf_dir).where("type = 'heading'").select("doc_id", "pos", S.section_id(t).alias("section_id"))


def _sections(spark, sf_dir):
    return S.section_table(tables.outline_blocks(spark, sf_dir))


@query("c10_sections", statement("SELECT doc_id, section_no, heading, level, path, depth, content, tokens, n_content, start_page, end_page, block_ids, parent_no, child_count FROM sections", "sections"))
def sections(spark, sf_dir):
    return _sections(spark, sf_dir).withColumn("block_ids", F.array_join("block_ids", ","))


@query(
    "c11_repair_orphans",
    statement(
        """, r AS (SELECT *, type = 'heading' AND coalesce(lead(type) OVER w = 'heading' AND lead(heading_level) OVER w <= heading_level, lead(type) OVER w IS NULL) AS repaired,
  last_value(CASE WHEN type = 'heading' AND heading_level = 1 THEN section_no END IGNORE NULLS) OVER w AS s1,
  last_value(CASE WHEN type = 'heading' AND heading_level = 2 THEN section_no END IGNORE NULLS) OVER w AS s2 FROM sectioned WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, block_id, CASE WHEN repaired THEN 'text' ELSE type END AS type, repaired, CAST(CASE WHEN NOT repaired THEN section_no
  ELSE greatest(CASE WHEN heading_level > 1 THEN coalesce(s1, 0) ELSE 0 END, CASE WHEN heading_level > 2 THEN coalesce(s2, 0) ELSE 0 END) END AS BIGINT) AS section_no FROM r""",
        "sectioned",
    ),
)
def repair_orphans(spark, sf_dir):
    return S.repair_orphans(tables.outline_blocks(spark, sf_dir)).select("doc_id", "pos", "block_id", "type", "repaired", "section_no")


def _stats_sql(table: str) -> str:
    return f"""SELECT doc_id, count(*) FILTER (section_no > 0) AS nodes, count(*) FILTER (section_no > 0 AND n_content > 0) AS with_content, count(*) FILTER (section_no > 0 AND child_count > 0) AS with_children,
  greatest(count(*) FILTER (section_no > 0 AND child_count = 0), 1) AS leaves, coalesce(max(depth) FILTER (section_no > 0), 0) AS max_depth, coalesce(min(tokens) FILTER (section_no > 0 AND n_content > 0), 0) AS min_tokens,
  coalesce(max(tokens) FILTER (section_no > 0 AND n_content > 0), 0) AS max_tokens, coalesce(avg(tokens) FILTER (section_no > 0 AND n_content > 0), 0) AS avg_tokens FROM {table} GROUP BY doc_id"""


_TREES = f"""stats AS ({_stats_sql('sections')}), issues AS (
  SELECT doc_id, section_no, i.issue AS issue, i.severity AS severity FROM (SELECT doc_id, section_no, unnest([CASE WHEN n_content = 0 AND child_count = 0 THEN {{'issue': 'orphan_heading', 'severity': 'warning'}} END,
    CASE WHEN n_content > 0 AND tokens > 2000 THEN {{'issue': 'oversized_section', 'severity': 'warning'}} WHEN n_content > 0 AND child_count = 0 AND tokens < 10 THEN {{'issue': 'undersized_section', 'severity': 'info'}} END]) AS i
    FROM sections WHERE section_no > 0) WHERE i IS NOT NULL
  UNION ALL SELECT doc_id, NULL, 'too_deep', 'warning' FROM sections WHERE section_no > 0 GROUP BY doc_id HAVING max(depth) > 8
  UNION ALL SELECT doc_id, NULL, 'too_flat', 'info' FROM sections WHERE section_no > 0 GROUP BY doc_id HAVING max(depth) = 1
  UNION ALL SELECT doc_id, NULL, 'imbalanced', 'info' FROM sections WHERE section_no > 0 AND child_count = 0 GROUP BY doc_id HAVING max(depth) - min(depth) > 4),
counts AS (SELECT s.*, coalesce(n.warnings, 0) AS warnings, coalesce(n.issues, 0) AS issues, with_content / nullif(nodes, 0) AS ratio FROM stats s
  LEFT JOIN (SELECT doc_id, count(*) FILTER (severity = 'warning') AS warnings, count(*) AS issues FROM issues GROUP BY doc_id) n ON s.doc_id = n.doc_id),
scored_trees AS (SELECT *, round(greatest(0.0, least(1.0, 1.0 - 0.05 * warnings + CASE WHEN max_depth BETWEEN 2 AND 5 THEN 0.1 WHEN max_depth > 8 THEN -0.1 ELSE 0 END
  + CASE WHEN ratio > 0.7 THEN 0.1 WHEN ratio < 0.3 THEN -0.1 ELSE 0 END)), 6)::DOUBLE AS score FROM counts)"""


def _trees(final: str) -> str:
    return statement(f", {_TREES}\n{final}", "sections")


@query(
    "c12_tree_stats",
    _trees("SELECT s.*, levels FROM stats s LEFT JOIN (SELECT doc_id, string_agg(level || ':' || n, ',' ORDER BY level) AS levels FROM (SELECT doc_id, level, count(*) AS n FROM sections WHERE level IS NOT NULL GROUP BY ALL) GROUP BY doc_id) l ON s.doc_id = l.doc_id"),
)
def tree_stats(spark, sf_dir):
    levels = F.array_join(F.transform(F.array_sort(F.map_entries("levels")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return S.tree_stats(_sections(spark, sf_dir)).withColumn("levels", levels)


def _issues(spark, sf_dir):
    return S.tree_issues(_sections(spark, sf_dir))


@query("c13_tree_issues", _trees("SELECT * FROM issues"))
def tree_issues(spark, sf_dir):
    return _issues(spark, sf_dir)


def _tree_quality(spark, sf_dir):
    return S.tree_quality(S.tree_stats(_sections(spark, sf_dir)), _issues(spark, sf_dir))


@query("c14_tree_quality", _trees("SELECT doc_id, score, warnings FROM scored_trees"))
def tree_quality(spark, sf_dir):
    return _tree_quality(spark, sf_dir).select("doc_id", "score", "warnings")


@query(
    "c15_tree_recommendations",
    _trees(
        "SELECT doc_id, advice FROM (SELECT doc_id, unnest([CASE WHEN max_depth >= 2 AND with_content > 10 THEN 'chunk by sections' END, CASE WHEN max_depth = 1 THEN 'flat: chunk by size' END, CASE WHEN avg_tokens > 800 THEN 'large sections' END, "
        "CASE WHEN avg_tokens < 100 THEN 'small sections' END, CASE WHEN coalesce(ratio, 0) < 0.5 THEN 'headings without content' END, CASE WHEN issues = 0 THEN 'no issues' END]) AS advice FROM scored_trees) WHERE advice IS NOT NULL"
    ),
)
def tree_recommendations(spark, sf_dir):
    return S.tree_recommendations(_tree_quality(spark, sf_dir))


@query(
    "c15_compare_trees",
    statement(
        f", a AS ({_stats_sql('sections')}), upper_part AS (SELECT * FROM sections WHERE coalesce(depth, 0) <= 2), b AS ({_stats_sql('upper_part')})\n"
        "SELECT doc_id, b.nodes - a.nodes AS node_diff, b.max_depth - a.max_depth AS depth_diff, round(b.avg_tokens - a.avg_tokens, 6) AS token_diff FROM a JOIN b USING (doc_id)",
        "sections",
    ),
)
def compare_trees(spark, sf_dir):
    """The whole tree against its two upper levels."""
    rows = _sections(spark, sf_dir)
    return S.compare_trees(S.tree_stats(rows), S.tree_stats(rows.where(F.coalesce("depth", F.lit(0)) <= 2)))


# Headings get numbers, some of them twice, with gaps, or none.
_NUMBER = "CASE WHEN section_no % 7 = 3 THEN section_no - 1 ELSE section_no END + 2 * (section_no // 9)"
_NUMBERED = rf"""numbered AS (SELECT doc_id, section_no, coalesce(d, l) AS number, d IS NOT NULL AS decimal FROM (SELECT doc_id, section_no, nullif(regexp_extract(t, '{S.DECIMAL}', 1), '') AS d, nullif(regexp_extract(t, '{S.LETTERED}', 1), '') AS l
  FROM (SELECT doc_id, section_no, {STRIP.format('h')} AS t FROM (SELECT doc_id, section_no, CASE CAST((section_no + doc_id) % 5 AS INTEGER) WHEN 0 THEN CAST({_NUMBER} AS BIGINT) || ' ' || heading WHEN 1 THEN CAST({_NUMBER} AS BIGINT) || '.1 ' || heading
  WHEN 2 THEN 'A.' || section_no || ' ' || heading WHEN 3 THEN heading ELSE CAST({_NUMBER} AS BIGINT) || ' ' || heading END AS h FROM sections WHERE section_no > 0))))"""


def _numbered(spark, sf_dir):
    n = F.col("section_no")
    number = (F.when(n % 7 == 3, n - 1).otherwise(n) + 2 * F.floor(n / 9)).cast("bigint")
    k = (n + F.col("doc_id")) % 5
    heading = (
        F.when(k == 1, F.concat(number, F.lit(".1 "), "heading")).when(k == 2, F.concat(F.lit("A."), n, F.lit(" "), "heading")).when(k == 3, F.col("heading"))
        .otherwise(F.concat(number, F.lit(" "), "heading"))
    )
    return _sections(spark, sf_dir).withColumn("heading", heading)


@query(
    "c16_numbering_scheme",
    statement(
        f", {_NUMBERED}, c AS (SELECT doc_id, count(*) AS headings, count(*) FILTER (decimal) AS decimals, count(number) - count(*) FILTER (decimal) AS letters, coalesce(max(len(string_split(number, '.'))), 0) AS max_depth FROM numbered GROUP BY doc_id)\n"
        "SELECT *, CASE WHEN decimals + letters = 0 THEN 'unnumbered' WHEN letters > decimals THEN 'letter_prefix' WHEN (decimals + letters) / headings >= 0.5 THEN 'decimal' ELSE 'mixed' END AS scheme FROM c",
        "sections",
    ),
)
def numbering_scheme(spark, sf_dir):
    return S.numbering(_numbered(spark, sf_dir))


@query(
    "c17_numbering_issues",
    statement(
        f""", {_NUMBERED}, w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, number ORDER BY section_no) AS r, CASE WHEN NOT contains(number, '.') THEN CAST(number AS BIGINT) END AS top,
  2 * count(number) OVER (PARTITION BY doc_id) > count(*) OVER (PARTITION BY doc_id) AS mostly FROM numbered),
v AS (SELECT *, last_value(top IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w)
SELECT doc_id, section_no, issue FROM (SELECT doc_id, section_no, unnest([CASE WHEN number IS NOT NULL AND r > 1 THEN 'duplicate_number' END, CASE WHEN top > before + 1 THEN 'numbering_gap' END, CASE WHEN number IS NULL AND mostly THEN 'unnumbered_in_numbered_doc' END]) AS issue FROM v) WHERE issue IS NOT NULL""",
        "sections",
    ),
)
def numbering_issues(spark, sf_dir):
    return S.numbering_issues(_numbered(spark, sf_dir))


@query("c18_chunk_fixed")
def chunk_fixed(spark, sf_dir):
    return C.fixed_chunks(tables.outline_blocks(spark, sf_dir))


@query("c18_chunk_fixed_by_words")
def chunk_fixed_by_words(spark, sf_dir):
    """Packed by a registered token counter."""
    return C.fixed_chunks(tables.outline_blocks(spark, sf_dir), counter="words")


@query("c21_chunk_recursive_by_pieces")
def chunk_recursive_by_pieces(spark, sf_dir):
    """Cut by a counter that is a vectorised model."""
    return C.recursive_chunks(tables.outline_blocks(spark, sf_dir), counter="pieces")


@query("c1_count_words", statement(r"SELECT block_id, CAST(len(list_filter(regexp_split_to_array(content, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS BIGINT) AS tokens FROM outline", "outline"))
def count_words(spark, sf_dir):
    """Tokens by the name of a counter."""
    return C.counted(tables.outline_blocks(spark, sf_dir), "words").select("block_id", "tokens")


@query("c19_chunk_hierarchy")
def chunk_hierarchy(spark, sf_dir):
    return C.hierarchy_chunks(tables.outline_blocks(spark, sf_dir))


@query("c19_chunk_sections", statement("SELECT doc_id, chunk_pos, chunk_id, content, token_count, block_count, block_ids, hierarchy_path, start_page, end_page, last_type, has_heading, has_content, has_broken_table FROM chunks", "chunks"))
def chunk_sections(spark, sf_dir):
    return tables.chunks(spark, sf_dir).withColumn("block_ids", F.array_join("block_ids", ","))


@query("c20_split_sentences", r"SELECT doc_id, CAST(len(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS BIGINT) AS sentences FROM documents")
def split_sentences(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.size(C.split_sentences(F.col("text"))).cast("bigint").alias("sentences"))


@query("c20_sentences", r"SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN pos < n - 1 THEN sentence || ' ' ELSE sentence END AS sentence FROM (SELECT doc_id, len(s) AS n, unnest(s) AS sentence, unnest(range(len(s))) AS pos FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents))")
def sentences(spark, sf_dir):
    """The sentences themselves, with the blank behind each."""
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.split_sentences(F.col("text"))).alias("pos", "sentence"))


@query("c21_chunk_recursive")
def chunk_recursive(spark, sf_dir):
    return C.recursive_chunks(tables.outline_blocks(spark, sf_dir))


@query("c22_add_overlap")
def add_overlap(spark, sf_dir):
    return C.add_overlap(tables.chunks(spark, sf_dir)).select("chunk_id", "overlapped")


@query("c23_merge_small")
def merge_small(spark, sf_dir):
    return C.merge_small(tables.chunks(spark, sf_dir))


for _name, _score in (("c24_score_token_range", "token_range"), ("c25_score_sentences", "sentences"), ("c26_score_hierarchy", "hierarchy"), ("c28_score_references", "references")):

    @query(_name, scored_sql(f'SELECT chunk_id, "{_score}" FROM scored'))
    def _one(spark, sf_dir, score=_score):
        return C.quality(tables.chunks(spark, sf_dir)).select("chunk_id", score)


@query("c27_score_tables", scored_sql("SELECT chunk_id, tables FROM scored"))
def score_tables(spark, sf_dir):
    return C.quality(tables.chunks(spark, sf_dir)).select("chunk_id", "tables")


@query("c29_quality_report", scored_sql("SELECT doc_id, count(*) AS chunks, sum(CAST(round(overall * 1000000) AS BIGINT)) / count(*) / 1000000 AS average, count(*) FILTER (overall < 0.7) AS problems, count(*) FILTER (overall >= 0.7 AND overall < 0.85) AS warnings FROM scored GROUP BY doc_id"))
def quality_report(spark, sf_dir):
    return C.quality_report(C.quality(tables.chunks(spark, sf_dir)))


@query(
    "c30_quality_suggestions",
    scored_sql(
        rf"""SELECT chunk_id, suggestion FROM (SELECT chunk_id, unnest([CASE WHEN token_range < 0.8 AND token_count < 200 THEN 'merge' END, CASE WHEN token_range < 0.8 AND token_count >= 200 THEN 'split' END,
  CASE WHEN sentences < 0.8 AND {_STRIPPED} <> '' AND NOT regexp_matches({_STRIPPED}, '^\p{{Lu}}') THEN 'starts mid-sentence' END, CASE WHEN sentences < 0.8 AND {_STRIPPED} <> '' AND NOT regexp_matches({_STRIPPED}, '[.!?:"'')\]]$') THEN 'ends mid-sentence' END,
  CASE WHEN hierarchy < 0.8 AND last_type = 'heading' THEN 'heading at end' END, CASE WHEN "references" < 0.8 THEN 'orphan references' END]) AS suggestion FROM scored) WHERE suggestion IS NOT NULL"""
    ),
)
def quality_suggestions(spark, sf_dir):
    return C.suggestions(C.quality(tables.chunks(spark, sf_dir)))


_BOTH = f"scored_sections AS ({_SCORES}), scored_pages AS ({_scores('page_chunks')}), both_ AS (SELECT 'sections' AS strategy, * FROM scored_sections UNION ALL BY NAME SELECT 'pages' AS strategy, * FROM scored_pages)"
_METRICS = """SELECT strategy, count(*) AS chunks, CAST(sum(block_count) AS BIGINT) AS blocks, avg(token_count) AS avg_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens, max(CASE WHEN r = n // 2 THEN token_count END) AS median_tokens,
  sum(CAST(round(overall * 1000000) AS BIGINT)) / count(*) / 1000000 AS avg_quality, count(*) FILTER (hierarchy_path <> '') / count(*) AS preservation,
  count(*) FILTER (token_count < 100) AS under_100, count(*) FILTER (token_count BETWEEN 100 AND 500) AS from_100_to_500, count(*) FILTER (token_count > 500) AS over_500 FROM
  (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY token_count, doc_id, chunk_pos) - 1 AS r, count(*) OVER (PARTITION BY strategy) AS n FROM both_) GROUP BY strategy"""


def _strategies(spark, sf_dir):
    """The scored chunks of two chunkers."""
    blocks = tables.outline_blocks(spark, sf_dir)
    made = [C.quality(chunker(blocks)).withColumn("strategy", F.lit(name)) for name, chunker in (("sections", S.section_chunks), ("pages", S.page_chunks))]
    return made[0].unionByName(made[1])


@query("c31_chunk_metrics", statement(f", {_BOTH}\n{_METRICS}", "chunks", "page_chunks"))
def chunk_metrics(spark, sf_dir):
    return C.metrics(_strategies(spark, sf_dir))


@query(
    "c32_compare_strategies",
    statement(
        f""", {_BOTH}, m AS ({_METRICS}), s AS (SELECT *, round(40 * preservation + 30 * avg_quality + CASE WHEN avg_tokens BETWEEN 300 AND 600 THEN 20 WHEN avg_tokens BETWEEN 200 AND 800 THEN 10 ELSE 0 END + CASE WHEN chunks < 1000 THEN 10 ELSE 0 END, 6) AS score FROM m),
b AS (SELECT *, row_number() OVER (ORDER BY score DESC, strategy) = 1 AS best FROM s), g AS (SELECT *, round(avg_quality - min(avg_quality) FILTER (NOT best) OVER (), 6) AS gap FROM b)
SELECT strategy, score, best, CASE WHEN best THEN array_to_string(list_filter([CASE WHEN preservation > 0.8 THEN 'keeps the structure' END, CASE WHEN avg_quality > 0.9 THEN 'high quality' END,
  CASE WHEN avg_tokens BETWEEN 300 AND 600 THEN 'good size' END, CASE WHEN preservation > 0.9 THEN 'has paths' END], lambda x: x IS NOT NULL), ', ') END AS reasons, CASE WHEN best AND gap > 0.1 THEN gap END AS gap FROM g""",
        "chunks", "page_chunks",
    ),
)
def compare_strategies(spark, sf_dir):
    return C.compare_strategies(C.metrics(_strategies(spark, sf_dir)))


@query("c33_token_histogram", statement(f", {_BOTH}\nSELECT strategy, CASE WHEN token_count < 50 THEN 0 WHEN token_count < 100 THEN 50 WHEN token_count < 200 THEN 100 WHEN token_count < 300 THEN 200 WHEN token_count < 500 THEN 300 ELSE 500 END AS bucket, count(*) AS chunks FROM both_ GROUP BY ALL", "chunks", "page_chunks"))
def token_histogram(spark, sf_dir):
    t = F.col("token_count")
    bucket = F.when(t < 50, 0).when(t < 100, 50).when(t < 200, 100).when(t < 300, 200).when(t < 500, 300).otherwise(500)
    return _strategies(spark, sf_dir).groupBy("strategy", bucket.alias("bucket")).agg(F.count("*").alias("chunks"))


@query(
    "c34_path_rollup",
    statement(
        "SELECT doc_id, path, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, count(*) FILTER (path = hierarchy_path) AS own_chunks, CAST(coalesce(sum(token_count) FILTER (path = hierarchy_path), 0) AS BIGINT) AS own_tokens FROM "
        "(SELECT doc_id, hierarchy_path, token_count, array_to_string(string_split(hierarchy_path, ' > ')[1:k], ' > ') AS path FROM (SELECT *, unnest(range(1, len(string_split(hierarchy_path, ' > ')) + 1)) AS k FROM chunks WHERE hierarchy_path <> '')) GROUP BY doc_id, path",
        "chunks",
    ),
)
def path_rollup(spark, sf_dir):
    return C.path_rollup(tables.chunks(spark, sf_dir))


@query("c35_block_type_summary", statement("SELECT type, count(*) AS blocks, round(avg(tokens), 6) AS avg_tokens, round(count(*) / count(DISTINCT doc_id), 6) AS per_document FROM outline GROUP BY type", "outline"))
def block_type_summary(spark, sf_dir):
    per = tables.outline_blocks(spark, sf_dir).groupBy("type", "doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    n = F.sum("n")
    return per.groupBy("type").agg(n.alias("blocks"), F.round(F.sum("t") / n, 6).alias("avg_tokens"), F.round(n / F.count("*"), 6).alias("per_document")).orderBy(F.desc("blocks"), "type")


@query(
    "c36_merge_chunks",
    statement(
        f""", asked AS (SELECT *, doc_id || ':' || chunk_pos // 2 AS g FROM chunks WHERE doc_id % 10 = 0),
m AS (SELECT doc_id, min(chunk_pos) AS chunk_pos, arg_min(chunk_id, chunk_pos) AS chunk_id, string_agg(content, chr(10) || chr(10) ORDER BY chunk_pos) AS content, string_agg(block_ids, ',' ORDER BY chunk_pos) AS block_ids,
  coalesce(arg_min(nullif(hierarchy_path, ''), chunk_pos) FILTER (hierarchy_path <> ''), '') AS hierarchy_path, arg_max(last_type, chunk_pos) AS last_type, bool_or(has_heading) AS has_heading, bool_or(has_content) AS has_content, bool_or(has_broken_table) AS has_broken_table
  FROM asked GROUP BY doc_id, g),
u0 AS (SELECT * FROM m UNION ALL BY NAME SELECT doc_id, chunk_pos, chunk_id, content, block_ids, hierarchy_path, last_type, has_heading, has_content, has_broken_table FROM chunks WHERE doc_id % 10 <> 0),
u AS (SELECT *, {TOKENS.format('content')} AS token_count FROM u0)
SELECT doc_id, chunk_pos, chunk_id, content, token_count, block_ids, hierarchy_path, overall FROM ({_scores('u')})""",
        "chunks",
    ),
)
def merge_chunks(spark, sf_dir):
    rows = tables.chunks(spark, sf_dir)
    asked = rows.where("doc_id % 10 = 0").select("chunk_id", F.concat_ws(":", "doc_id", F.floor(F.col("chunk_pos") / 2)).alias("request_id"))
    out = C.merge_requested(rows, asked)
    return out.select("doc_id", "chunk_pos", "chunk_id", "content", "token_count", F.array_join("block_ids", ",").alias("block_ids"), "hierarchy_path", "overall")


_HALVES = f"SELECT *, {STRIP.format('substr(content, 1, cut)')} AS l, {STRIP.format('substr(content, cut + 1)')} AS r FROM (SELECT *, CAST(length(content) // 2 AS INTEGER) AS cut FROM chunks)"


@query("c37_split_chunks", statement(f", h AS ({_HALVES})\nSELECT doc_id, chunk_id || '-a' AS chunk_id, l AS content FROM h WHERE cut > 0 AND l <> '' AND r <> '' UNION ALL SELECT doc_id, chunk_id || '-b', r FROM h WHERE cut > 0 AND l <> '' AND r <> ''", "chunks"))
def split_chunks(spark, sf_dir):
    rows = tables.chunks(spark, sf_dir)
    return C.split_requested(rows, rows.select("chunk_id", F.floor(F.length("content") / 2).cast("int").alias("at")))[0]


@query(
    "c38_update_chunks",
    statement(
        "SELECT chunk_id, CASE WHEN doc_id % 2 = 0 THEN 'seen' ELSE 'old' END AS notes, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 ELSE false END AS is_locked, CASE WHEN doc_id % 5 = 0 THEN 'a,' || chunk_pos ELSE 'old' END AS tags, "
        "CASE WHEN doc_id % 7 = 0 THEN hierarchy_path END AS hierarchy_hint, CASE WHEN chunk_pos % 2 = 0 THEN 'x' ELSE 'none' END AS custom FROM chunks",
        "chunks",
    ),
)
def update_chunks(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = tables.chunks(spark, sf_dir).withColumns({"notes": F.lit("old"), "is_locked": F.lit(False), "tags": F.array(F.lit("old")), "hierarchy_hint": none, "custom": F.create_map(F.lit("k"), F.lit("none"))})
    even, third = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0
    patches = rows.select(
        "chunk_id", F.when(even, "seen").alias("notes"), F.when(third, even).alias("is_locked"), F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("a"), F.col("chunk_pos").cast("string"))).alias("tags"),
        F.when(F.col("doc_id") % 7 == 0, F.col("hierarchy_path")).alias("hierarchy_hint"), F.when(F.col("chunk_pos") % 2 == 0, F.create_map(F.lit("k"), F.lit("x"))).alias("custom"),
    )
    return C.update_chunks(rows, patches).select("chunk_id", "notes", "is_locked", F.array_join("tags", ",").alias("tags"), "hierarchy_hint", F.col("custom")["k"].alias("custom"))


@query("c39_rechunk_keep_locked", statement("SELECT 'new' AS origin, chunk_id, content, token_count FROM page_chunks UNION ALL SELECT 'locked', chunk_id, content, token_count FROM chunks WHERE doc_id % 4 = 0", "chunks", "page_chunks"))
def rechunk_keep_locked(spark, sf_dir):
    """Documents cut anew by page; chunks of sections that are locked stay."""
    old = tables.chunks(spark, sf_dir).withColumn("is_locked", F.col("doc_id") % 4 == 0)
    return C.rechunk(tables.outline_blocks(spark, sf_dir), old, S.page_chunks).select("origin", "chunk_id", "content", "token_count")
