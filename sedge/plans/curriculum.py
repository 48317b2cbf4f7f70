"""Queries over enrichment, coverage, consistency and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import curriculum as C
from ..sources import tables
from .catalog import query
from .sql import STRIP, statement

_TYPES = ("TECHNICAL_MANUAL", "MAINTENANCE_PROCEDURE", "PARTS_CATALOG", "REGULATION", "REPORT")
_EXTRA = (
    " NSN 1234-56-789-0123", " LIN: T12345 unit level maintenance", " Figure 3-4 SMR: PAOZZ", " WP 0001 00 Section 2.1", " P/N: AB-123 CAGE: 12345 effective 12 June 2021",
    " AR 25-50 para 3-4 Table 2-1 for the Main Pump, so",
)
_DECOR = "CASE WHEN doc_id % 3 > 0 THEN 'TM 9-' || (2000 + doc_id % 500) || '-' || (doc_id % 300) ELSE '' END || CASE CAST(chunk_pos % 6 AS INTEGER) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_EXTRA)) + " END || ' ' || content"


def _found(name: str) -> str:
    one = lambda c: f"CASE WHEN regexp_extract({c}, '{C.FIELDS[name]}', 0) <> '' THEN {{'field': '{name}', 'value': {STRIP.format(f'regexp_extract({c}, {chr(39)}{C.FIELDS[name]}{chr(39)}, 1)')}, 'source': '{c}', 'share': length(regexp_extract({c}, '{C.FIELDS[name]}', 0)) / length({c})}} END"
    return f"coalesce({one('content')}, {one('hierarchy_path')})" if name in C.IN_PATHS else one("content")


def _profile(which: int) -> str:
    of = lambda held: "[" + ", ".join(f"'{f}'" for f in held[which]) + "]::VARCHAR[]"
    return "CASE doc_type " + " ".join(f"WHEN '{t}' THEN {of(held)}" for t, held in C.PROFILES.items()) + f" ELSE {of(C.DEFAULT_PROFILE)} END"


_VALID = "CASE f.field " + " ".join(f"WHEN '{n}' THEN regexp_matches(f.value, '{p}')" for n, p in C.FORMATS.items()) + " ELSE true END"
_ROUNDED = "floor(round(({0}) * 1000000::DOUBLE) / 1000::DOUBLE + 0.5::DOUBLE) / 1000::DOUBLE"
_FIELDS = f"""enriched AS MATERIALIZED (SELECT doc_id, chunk_id, {_DECOR} AS content, CASE WHEN chunk_pos % 6 = 1 THEN 'Chapter 7 > ' || hierarchy_path ELSE hierarchy_path END AS hierarchy_path, {list(_TYPES)}[CAST(doc_id % 5 + 1 AS INTEGER)] AS doc_type FROM chunks),
fields AS MATERIALIZED (SELECT doc_id, chunk_id, doc_type, f.field AS field, f.value AS value, f.source AS source, CASE WHEN f.share < 0.3 THEN 0.9 WHEN f.share < 0.6 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence, {_VALID} AS valid
  FROM (SELECT doc_id, chunk_id, doc_type, unnest([{', '.join(map(_found, C.FIELDS))}]) AS f FROM enriched) WHERE f IS NOT NULL AND list_contains({_profile(0)}, f.field)),
per AS (SELECT chunk_id, list(field) AS have, string_agg(field || '=' || value, ';' ORDER BY field) AS fields, count(*) AS n, count(*) FILTER (valid) AS valid, sum(CAST(confidence * 10 AS INTEGER)) AS sure FROM fields GROUP BY chunk_id),
scored AS (SELECT doc_id, e.chunk_id, doc_type, fields, fields IS NOT NULL AS applied, {_ROUNDED.format(f"0.5 * CASE WHEN len({_profile(1)}) = 0 THEN 1 ELSE len(list_intersect({_profile(1)}, coalesce(have, []))) / len({_profile(1)}) END + CASE WHEN n > 0 THEN 0.3 * valid / n + 0.2 * sure / n / 10 ELSE 0.3 END")} AS quality
  FROM enriched e LEFT JOIN per ON e.chunk_id = per.chunk_id)"""


def _enriched(spark, sf_dir):
    """Chunks with what the rules look for, and types of documents in turn."""
    d, k = F.col("doc_id"), F.col("chunk_pos") % 6
    extra = F.element_at(F.array(*map(F.lit, _EXTRA)), (k + 1).cast("int"))
    content = F.concat(F.when(d % 3 > 0, F.concat(F.lit("TM 9-"), 2000 + d % 500, F.lit("-"), d % 300)).otherwise(""), extra, F.lit(" "), F.col("content"))
    path = F.when(k == 1, F.concat(F.lit("Chapter 7 > "), "hierarchy_path")).otherwise(F.col("hierarchy_path"))
    rows = tables.chunks(spark, sf_dir).withColumns({"content": content, "hierarchy_path": path})
    return rows.withColumn("doc_type", F.element_at(F.array(*map(F.lit, _TYPES)), (d % 5 + 1).cast("int")))


def _fields(spark, sf_dir):
    return C.extract_fields(_enriched(spark, sf_dir))


def _sql(final: str) -> str:
    return statement(f", {_FIELDS}\n{final}", "chunks")


@query("f1_extract_fields", _sql("SELECT chunk_id, doc_type, field, value, source FROM fields"))
def extract_fields(spark, sf_dir):
    return _fields(spark, sf_dir).select("chunk_id", "doc_type", "field", "value", "source")


@query("f2_field_confidence", _sql("SELECT chunk_id, field, confidence FROM fields"))
def field_confidence(spark, sf_dir):
    return _fields(spark, sf_dir).select("chunk_id", "field", "confidence")


@query("f3_validate_fields", _sql("SELECT field, count(*) AS n, count(*) FILTER (valid) AS valid FROM fields GROUP BY field"))
def validate_fields(spark, sf_dir):
    return _fields(spark, sf_dir).groupBy("field").agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"))


def _quality(spark, sf_dir):
    chunks = _enriched(spark, sf_dir)
    return C.enrichment_quality(chunks, C.extract_fields(chunks))


@query("f4_enrich_quality", _sql("SELECT doc_id, chunk_id, applied, fields, quality FROM scored"))
def enrich_quality(spark, sf_dir):
    stamp = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return _quality(spark, sf_dir).select("doc_id", "chunk_id", "applied", F.when(F.col("applied"), stamp).alias("fields"), "quality")


@query("f4_document_quality", _sql(f"SELECT doc_id, count(*) AS chunks, count(*) FILTER (applied) AS enriched, {_ROUNDED.format('sum(CAST(round(quality * 1000) AS BIGINT)) / count(*) / 1000')} AS quality FROM scored GROUP BY doc_id"))
def document_quality(spark, sf_dir):
    return C.document_quality(_quality(spark, sf_dir))


@query(
    "f5_field_coverage",
    _sql(
        f"""SELECT w.doc_id, w.field, coalesce(h.n, 0) AS chunks, round(coalesce(h.n, 0) / w.n, 6) AS share FROM (SELECT doc_id, n, unnest({_profile(0)}) AS field FROM (SELECT doc_id, doc_type, count(*) AS n FROM enriched GROUP BY ALL)) w
LEFT JOIN (SELECT doc_id, field, count(*) AS n FROM fields GROUP BY ALL) h ON w.doc_id = h.doc_id AND w.field = h.field"""
    ),
)
def field_coverage(spark, sf_dir):
    chunks = _enriched(spark, sf_dir)
    return C.field_coverage(chunks, C.extract_fields(chunks))


_FIRST = STRIP.format("string_split(content, '.')[1]")
_TOPIC = "lower(CASE WHEN length(s) <= 80 THEN s WHEN instr(substr(s, 1, 80), ' ') > 0 THEN substr(s, 1, 80 - instr(reverse(substr(s, 1, 80)), ' ')) ELSE substr(s, 1, 80) END)"


@query(
    "f6_scaffold_candidates",
    statement(
        f"SELECT chunk_id, CASE WHEN hierarchy_path <> '' THEN 'What does the section ' || chr(39) || string_split(hierarchy_path, ' > ')[-1] || chr(39) || ' say?' ELSE 'What is known of ' || {_TOPIC} || '?' END AS question, "
        "CASE WHEN instr(e, '.') > 0 AND length(e) - instr(reverse(e), '.') > 50 THEN substr(e, 1, length(e) - instr(reverse(e), '.') + 1) ELSE e END AS answer, "
        "'Source: corpus/' || doc_id || ' | Page: ' || start_page || '-' || end_page || CASE WHEN hierarchy_path <> '' THEN ' | Section: ' || hierarchy_path ELSE '' END || ' | Chunk: ' || chunk_id AS provenance, "
        f"0.5::DOUBLE + CASE WHEN hierarchy_path <> '' THEN 0.5 ELSE 0 END AS confidence FROM (SELECT *, {STRIP.format('substr(content, 1, 500)')} AS e, {_FIRST} AS s FROM chunks) WHERE token_count BETWEEN 50 AND 2000",
        "chunks",
    ),
)
def scaffold_candidates(spark, sf_dir):
    return C.scaffold(tables.chunks(spark, sf_dir))


_WORDS = lambda c: f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z]+')), lambda x: x NOT IN {C.STOP_WORDS})"


@query(
    "f7_suggest_competency",
    statement(
        f""", side AS (SELECT competency, unnest({_WORDS("name || ' ' || description")}) AS w FROM competencies), n AS (SELECT chunk_id, competency, count(*) AS n FROM (SELECT chunk_id, unnest({_WORDS("content || ' ' || hierarchy_path")}) AS w FROM chunks) JOIN side USING (w) GROUP BY ALL)
SELECT c.chunk_id, competency, coalesce(n, 0) AS shared FROM chunks c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC, competency) AS r FROM n) b ON c.chunk_id = b.chunk_id AND r = 1""",
        "chunks", "competencies",
    ),
)
def suggest_competency(spark, sf_dir):
    return C.suggest(tables.chunks(spark, sf_dir), tables.competencies(spark, sf_dir))


@query("f8_accept_candidates", statement("SELECT example_id, CASE WHEN turn % 3 = 0 THEN 'edited: ' || question ELSE question END AS question, answer || '|provenance:' || conv_id AS context, conv_id AS provenance FROM examples WHERE review_status = 'pending'", "examples"))
def accept_candidates(spark, sf_dir):
    rows = tables.examples(spark, sf_dir).where("review_status = 'pending'")
    edits = rows.where("turn % 3 = 0").select("example_id", F.concat(F.lit("edited: "), "question").alias("edit"))
    context = F.concat("answer", F.lit("|provenance:"), "conv_id")
    out = rows.join(edits, "example_id", "left").select("example_id", F.coalesce("edit", "question").alias("question"), context.alias("context"))
    return out.withColumn("provenance", F.substring_index("context", "|provenance:", -1).cast("bigint"))


_COVER = "covered AS (SELECT c.*, coalesce(n, 0) AS n, coalesce(tests, 0) AS tests, round(CASE WHEN target = 0 THEN 1 ELSE coalesce(n, 0) / target END, 6) AS ratio, greatest(target - coalesce(n, 0), 0) AS gap, coalesce(n, 0) >= target AS met FROM competencies c LEFT JOIN (SELECT competency, count(*) FILTER (NOT is_test_set) AS n, count(*) FILTER (is_test_set) AS tests FROM examples GROUP BY competency) e ON c.competency = e.competency)"


def _cover(spark, sf_dir):
    return C.coverage(tables.competencies(spark, sf_dir), tables.examples(spark, sf_dir))


def _covered(final: str) -> str:
    return statement(f", {_COVER}\n{final}", "competencies", "examples")


@query("f9_coverage_report", _covered("SELECT competency, name, target, n, met FROM covered"))
def coverage_report(spark, sf_dir):
    return _cover(spark, sf_dir).select("competency", "name", "target", "n", "met")


@query("f9_coverage_totals", _covered("SELECT discipline, CAST(sum(n) AS BIGINT) AS total_examples, CAST(sum(tests) AS BIGINT) AS total_tests, coalesce(string_agg(CASE WHEN NOT met THEN name END, ', ' ORDER BY competency), '') AS gaps, bool_and(met) AS complete FROM covered GROUP BY discipline"))
def coverage_totals(spark, sf_dir):
    return C.coverage_report(_cover(spark, sf_dir))


@query("f10_coverage_snapshot", _covered("SELECT discipline, CAST(sum(least(n, target)) AS BIGINT) AS filled, CAST(sum(target) AS BIGINT) AS target, sum(least(n, target)) / sum(target) AS ratio, count(*) FILTER (met) AS met FROM covered GROUP BY discipline"))
def coverage_snapshot(spark, sf_dir):
    filled = F.sum(F.least("n", "target"))
    return _cover(spark, sf_dir).groupBy("discipline").agg(filled.alias("filled"), F.sum("target").alias("target"), (filled / F.sum("target")).alias("ratio"), F.count_if("met").alias("met"))


_HAVE = "CAST(floor(round(ratio * 1000000) / 10000 + 0.5) AS INTEGER) || '% (' || n || '/' || target || ')'"


@query(
    "f11_coverage_recommendations",
    _covered(
        "SELECT competency, priority, CAST(row_number() OVER (PARTITION BY discipline ORDER BY priority, gap DESC, competency) AS INTEGER) AS rank, reason FROM "
        f"(SELECT *, CASE WHEN n = 0 THEN 1 WHEN ratio < 0.5 THEN 2 ELSE 3 END AS priority, CASE WHEN n = 0 THEN 'none yet' WHEN ratio < 0.5 THEN 'only ' || {_HAVE} ELSE 'nearly: ' || {_HAVE} END AS reason FROM covered WHERE NOT met)"
    ),
)
def coverage_recommendations(spark, sf_dir):
    return C.recommendations(_cover(spark, sf_dir)).select("competency", "priority", "rank", "reason")


# Competencies have two levels; documents by halved ids make a tall tree.
_HALVES = "halves AS (SELECT doc_id AS competency, CASE WHEN doc_id > 1 THEN doc_id // 2 END AS parent FROM documents WHERE doc_id > 0)"
_TREE = """t AS (SELECT competency, 0 AS depth, competency AS root, CAST(competency AS VARCHAR) AS path, [competency] AS line FROM {0} WHERE parent IS NULL OR parent NOT IN (SELECT competency FROM {0})
  UNION ALL SELECT c.competency, t.depth + 1, t.root, t.path || '/' || c.competency, list_append(t.line, c.competency) FROM {0} c JOIN t ON c.parent = t.competency),
below AS (SELECT competency, count(*) AS n FROM (SELECT unnest(line[:-2]) AS competency FROM t) GROUP BY competency)
SELECT t.competency, CAST(depth AS INTEGER) AS depth, root, path, false AS cycle, coalesce(n, 0) AS descendants FROM t LEFT JOIN below ON t.competency = below.competency"""


@query("f12_competency_tree", statement(f", {_TREE.format('competencies')}", "competencies").replace("WITH ", "WITH RECURSIVE ", 1))
def competency_tree(spark, sf_dir):
    return C.tree(tables.competencies(spark, sf_dir))


@query("f12_tall_tree", f"WITH RECURSIVE {_HALVES}, {_TREE.format('halves')}")
def tall_tree(spark, sf_dir):
    """A tree of all documents, each below the one of half its id."""
    d = F.col("doc_id")
    return C.tree(tables.table(spark, sf_dir, "documents").where("doc_id > 0").select(d.alias("competency"), F.when(d > 1, F.floor(d / 2)).alias("parent")))


@query(
    "f13_map_summary",
    _covered(
        "SELECT discipline, count(*) AS competencies, count(*) FILTER (parent IS NULL) AS roots, count(parent) AS children, CAST(sum(target) AS BIGINT) AS target, "
        "coalesce(string_agg(CASE WHEN NOT met THEN name END, ', ' ORDER BY competency), '') AS gaps, CAST(sum(gap) AS BIGINT) AS needed FROM covered GROUP BY discipline"
    ),
)
def map_summary(spark, sf_dir):
    return C.map_summary(_cover(spark, sf_dir))


_SEEDS = "seeds AS (SELECT discipline, competency, parent, name, CASE WHEN competency % 3 = 1 THEN ' ' || name ELSE description END AS description, target - 20 AS target FROM competencies)"


@query(
    "f13_map_violations",
    statement(
        f""", {_SEEDS}
SELECT discipline, competency, violation FROM (SELECT discipline, competency, unnest([CASE WHEN {STRIP.format('name')} = {STRIP.format('description')} THEN 'name is the description' END, CASE WHEN target <= 0 THEN 'no target' END]) AS violation FROM seeds) WHERE violation IS NOT NULL
UNION ALL SELECT discipline, NULL, 'too few roots' FROM seeds GROUP BY discipline HAVING count(*) FILTER (parent IS NULL) < 3""",
        "competencies",
    ),
)
def map_violations(spark, sf_dir):
    """Some competencies are described by their name, or lack a target."""
    description = F.when(F.col("competency") % 3 == 1, F.concat(F.lit(" "), "name")).otherwise(F.col("description"))
    return C.map_violations(tables.competencies(spark, sf_dir).withColumns({"description": description, "target": F.col("target") - 20}))


def _removed(spark, sf_dir):
    """Every third competency is to go: its children to the first one, if it is odd."""
    rows = tables.competencies(spark, sf_dir).select("competency", "parent")
    c = F.col("competency")
    return C.remove_competencies(rows, rows.where("competency % 3 = 1 OR competency = 2").select("competency", F.when(c % 2 == 1, F.lit(0).cast("bigint")).alias("to_parent")))


_REQUESTS = "asked AS (SELECT competency, CASE WHEN competency % 2 = 1 THEN 0 END AS to_parent FROM competencies WHERE competency % 3 = 1 OR competency = 2), bad AS (SELECT * FROM asked WHERE to_parent IS NULL AND competency IN (SELECT parent FROM competencies WHERE parent IS NOT NULL)), good AS (SELECT * FROM asked WHERE competency NOT IN (SELECT competency FROM bad))"


@query("f14_reparent_and_remove", statement(f", {_REQUESTS}\nSELECT c.competency, CASE WHEN g.competency IS NOT NULL THEN g.to_parent ELSE c.parent END AS parent FROM competencies c LEFT JOIN good g ON c.parent = g.competency WHERE c.competency NOT IN (SELECT competency FROM good)", "competencies"))
def reparent_and_remove(spark, sf_dir):
    return _removed(spark, sf_dir)[0]


@query("f14_rejected_removals", statement(f", {_REQUESTS}\nSELECT competency FROM bad", "competencies"))
def rejected_removals(spark, sf_dir):
    return _removed(spark, sf_dir)[1].select("competency")


def _names(spark, sf_dir):
    """Contributors with even numbers have names."""
    rows = tables.memberships(spark, sf_dir).select("contributor").distinct().where("contributor % 2 = 0")
    return rows.withColumn("name", F.concat(F.lit("contributor "), "contributor"))


@query(
    "f15_review_queue",
    statement(
        "SELECT m.contributor AS reviewer, example_id, CASE WHEN e.contributor % 2 = 0 THEN 'contributor ' || e.contributor ELSE CAST(e.contributor AS VARCHAR) END AS contributor_name, coalesce(c.name, CAST(e.competency AS VARCHAR)) AS competency_name "
        "FROM examples e JOIN memberships m ON e.discipline = m.discipline LEFT JOIN competencies c ON c.competency = e.competency WHERE review_status = 'pending' AND (len(areas) = 0 OR list_contains(areas, e.competency))",
        "examples", "memberships", "competencies",
    ),
)
def review_queue(spark, sf_dir):
    return C.review_queue(tables.examples(spark, sf_dir), tables.memberships(spark, sf_dir), _names(spark, sf_dir), tables.competencies(spark, sf_dir))


# Three decisions for each pending example, by members in turn.
_LOG = """log AS (SELECT example_id, discipline, context, k AS seq, CASE WHEN k = 3 THEN 90 ELSE (conv_id + k) % 5 END AS reviewer, ['approve', 'reject', 'revise'][CAST((turn + k) % 3 + 1 AS INTEGER)] AS decision, CASE WHEN (turn + k) % 2 = 0 THEN 'note ' || k ELSE '' END AS notes,
  TIMESTAMP '2024-01-01' + to_days(CAST(k AS INTEGER)) AS decided FROM (SELECT *, CASE WHEN turn % 4 = 0 THEN '' ELSE 'about turn ' || turn END AS context FROM examples WHERE review_status = 'pending'), range(1, 4) AS r(k)),
judged AS (SELECT l.*, m.role IN ('lead', 'admin') AS able FROM log l LEFT JOIN memberships m ON m.contributor = l.reviewer AND m.discipline = l.discipline)"""


def _reviews(spark, sf_dir):
    turn, k = F.col("turn"), F.col("seq")
    rows = tables.examples(spark, sf_dir).where("review_status = 'pending'").withColumn("context", F.when(turn % 4 == 0, "").otherwise(F.concat(F.lit("about turn "), "turn")))
    log = rows.select("example_id", "conv_id", "turn", F.explode(F.array(*[F.lit(n).cast("bigint") for n in (1, 2, 3)])).alias("seq"))
    decision = F.element_at(F.array(*map(F.lit, ("approve", "reject", "revise"))), ((turn + k) % 3 + 1).cast("int"))
    log = log.select(
        "example_id", "seq", F.when(k == 3, F.lit(90).cast("bigint")).otherwise((F.col("conv_id") + k) % 5).alias("reviewer"), decision.alias("decision"),
        F.when((turn + k) % 2 == 0, F.concat(F.lit("note "), "seq")).otherwise("").alias("notes"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(seq as int))").alias("at"),
    )
    return C.apply_reviews(rows, log, tables.memberships(spark, sf_dir))


@query(
    "f16_apply_reviews",
    statement(
        f""", {_LOG}, per AS (SELECT example_id, any_value(context) AS context, arg_max(decision, seq) AS decision, arg_max(reviewer, seq) AS reviewed_by, arg_max(decided, seq) AS reviewed_at, string_agg(CASE WHEN notes <> '' THEN 'review: ' || notes END, ' | ' ORDER BY seq) AS notes FROM judged WHERE able GROUP BY example_id)
SELECT example_id, CASE decision WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'needs_revision' END AS review_status, reviewed_by, reviewed_at, context || CASE WHEN context <> '' AND notes IS NOT NULL THEN ' | ' ELSE '' END || coalesce(notes, '') AS context FROM per""",
        "examples", "memberships",
    ),
)
def apply_reviews(spark, sf_dir):
    return _reviews(spark, sf_dir)[0].select("example_id", "review_status", "reviewed_by", "reviewed_at", "context")


@query("f16_rejected_reviews", statement(f", {_LOG}\nSELECT example_id, seq, reviewer FROM judged WHERE able IS NOT TRUE", "examples", "memberships"))
def rejected_reviews(spark, sf_dir):
    return _reviews(spark, sf_dir)[1]


@query(
    "f17_contribution_stats",
    statement(
        """SELECT m.contributor, m.discipline, count(e.example_id) AS total, count(*) FILTER (review_status = 'approved') AS approved, count(*) FILTER (review_status = 'rejected') AS rejected, count(*) FILTER (review_status = 'pending') AS pending, any_value(c.by_competency) AS by_competency
FROM memberships m LEFT JOIN examples e ON m.contributor = e.contributor AND m.discipline = e.discipline
LEFT JOIN (SELECT contributor, discipline, string_agg(competency || ':' || n, ',' ORDER BY competency) AS by_competency FROM (SELECT contributor, discipline, competency, count(*) AS n FROM examples GROUP BY ALL) GROUP BY ALL) c ON m.contributor = c.contributor AND m.discipline = c.discipline
GROUP BY m.contributor, m.discipline""",
        "memberships", "examples",
    ),
)
def contribution_stats(spark, sf_dir):
    rows = C.contribution_stats(tables.examples(spark, sf_dir), tables.memberships(spark, sf_dir))
    return rows.withColumn("by_competency", F.array_join(F.transform(F.map_entries("by_competency"), lambda e: F.concat_ws(":", e["key"], e["value"])), ","))


@query(
    "f18_ownership",
    statement(
        "SELECT p.*, coalesce(len(areas) = 0 OR list_contains(areas, competency), false) AS owns FROM (SELECT DISTINCT contributor, competency, (discipline + CASE WHEN contributor = 1 THEN 1 ELSE 0 END) AS discipline FROM examples) p LEFT JOIN memberships m ON p.contributor = m.contributor AND p.discipline = m.discipline",
        "examples", "memberships",
    ),
)
def ownership(spark, sf_dir):
    """Some pairs ask about a discipline that there is not."""
    other = F.col("discipline") + F.when(F.col("contributor") == 1, 1).otherwise(0)
    pairs = tables.examples(spark, sf_dir).select("contributor", "competency", other.alias("discipline")).distinct()
    return C.ownership(pairs, tables.memberships(spark, sf_dir))


_REFERENCES = (
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("labels", "doc_id", "documents", "doc_id"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"), ("events", "user_id", "conversations", "conv_id"),
)
_KEYS = (("customer", ("c_custkey",)), ("orders", ("o_orderkey",)), ("documents", ("doc_id",)), ("conversations", ("conv_id", "turn")), ("labels", ("doc_id",)), ("lineitem", ("l_orderkey",)))
_FILLED = (("documents", "text"), ("documents", "source"), ("pages", "url"), ("events", "user_id"), ("conversations", "text"), ("labels", "quality"))
_AUDIT = " UNION ALL ".join(
    [f"SELECT 'orphans' AS audit, '{t}.{c}' AS subject, count(*) AS n FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {u} WHERE {k} IS NOT NULL)" for t, c, u, k in _REFERENCES]
    + [f"SELECT 'cascade', '{u}.{k} -> {t}', count(*) FROM {t} WHERE {c} IN (SELECT {k} FROM {u} WHERE {k} % 10 = 0)" for t, c, u, k in _REFERENCES]
    + [f"SELECT 'repeated', '{t}.{'+'.join(k)}', count(*) FROM (SELECT {', '.join(k)} FROM {t} GROUP BY ALL HAVING count(*) > 1)" for t, k in _KEYS]
    + [f"SELECT 'missing', '{t}.{c}', count(*) FROM {t} WHERE {c} IS NULL" for t, c in _FILLED]
)


@query("f19_integrity_audit", _AUDIT)
def integrity_audit(spark, sf_dir):
    """References without rows, rows that the removal of every tenth parent would
    take along, repeated keys and missing values."""
    t = lambda n: tables.table(spark, sf_dir, n)
    checks = [("orphans", f"{a}.{x}", C.orphans(t(a), x, t(b), y)) for a, x, b, y in _REFERENCES]
    checks += [("cascade", f"{b}.{y} -> {a}", t(a).join(t(b).where(F.col(y) % 10 == 0).select(F.col(y).alias(x)), x, "left_semi")) for a, x, b, y in _REFERENCES]
    checks += [("repeated", f"{a}.{'+'.join(k)}", t(a).groupBy(*k).agg(F.count("*").alias("n")).where("n > 1")) for a, k in _KEYS]
    checks += [("missing", f"{a}.{c}", t(a).where(F.col(c).isNull())) for a, c in _FILLED]
    parts = [rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("audit"), F.lit(name).alias("subject"), "n") for kind, name, rows in checks]
    return reduce(DataFrame.unionByName, parts)


_SEVEN = """contributors AS (SELECT DISTINCT conv_id % 5 AS id, CASE WHEN conv_id % 5 > 0 THEN 'c' || conv_id % 5 END AS name FROM conversations),
disciplines AS (SELECT DISTINCT discipline AS id, 'd' || discipline AS name, 'a discipline' AS description, discipline * 7 AS created_by FROM competencies),
comps AS (SELECT competency AS id, name, CASE WHEN competency <> 4 THEN 'of it' END AS description, CASE WHEN competency = 6 THEN 9 ELSE discipline END AS discipline_id, parent AS parent_id FROM competencies),
exs AS (SELECT example_id AS id, question, CASE WHEN conv_id % 13 > 0 THEN answer END AS ideal_answer, competency AS competency_id, contributor AS contributor_id, CASE WHEN conv_id % 11 = 0 THEN 9 ELSE discipline END AS discipline_id, review_status FROM examples
  UNION ALL SELECT example_id, question, answer, competency, contributor, discipline, review_status FROM examples WHERE conv_id % 17 = 0),
members AS (SELECT discipline AS discipline_id, contributor AS contributor_id, CASE WHEN contributor <> 3 THEN role END AS role FROM memberships),
versions AS (SELECT 'v' || competency AS id, discipline AS discipline_id, competency // 3 AS version_number, competency AS created_by FROM competencies),
sessions AS (SELECT DISTINCT 's' || conv_id % 9 AS id, CASE WHEN conv_id % 9 <> 2 THEN 'talk' END AS discipline_name, conv_id % 9 AS contributor_id FROM conversations)"""
_NAMED = {"contributors": "contributors", "disciplines": "disciplines", "competencies": "comps", "examples": "exs", "discipline_contributors": "members", "curriculum_versions": "versions", "discovery_sessions": "sessions"}
_AUDITED = " UNION ALL ".join(
    q
    for t, (key, filled, refs) in C.CURRICULUM.items()
    for q in [
        *[f"SELECT 'orphans' AS audit, '{t}.{c}' AS subject, count(*) AS n FROM {_NAMED[t]} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT id FROM {_NAMED[u]})" for c, u, _ in refs],
        f"SELECT 'repeated' AS audit, '{t}.{'+'.join(key)}' AS subject, count(*) AS n FROM (SELECT {', '.join(key)} FROM {_NAMED[t]} GROUP BY ALL HAVING count(*) > 1)",
        *[f"SELECT 'missing' AS audit, '{t}.{c}' AS subject, count(*) AS n FROM {_NAMED[t]} WHERE {c} IS NULL" for c in filled],
    ]
)


def _curriculum(spark, sf_dir):
    """The seven tables of a curriculum, with faults in each."""
    conv = tables.table(spark, sf_dir, "conversations")
    comps, ex = tables.competencies(spark, sf_dir), tables.examples(spark, sf_dir)
    c, k = F.col("competency"), F.col("conv_id")
    again = ex.where(k % 17 == 0).select(F.col("example_id").alias("id"), "question", F.col("answer").alias("ideal_answer"), c.alias("competency_id"), F.col("contributor").alias("contributor_id"), F.col("discipline").alias("discipline_id"), "review_status")
    own = ex.select(
        F.col("example_id").alias("id"), "question", F.when(k % 13 > 0, F.col("answer")).alias("ideal_answer"), c.alias("competency_id"), F.col("contributor").alias("contributor_id"),
        F.when(k % 11 == 0, 9).otherwise(F.col("discipline")).alias("discipline_id"), "review_status",
    )
    return {
        "contributors": conv.select((k % 5).alias("id")).distinct().withColumn("name", F.when(F.col("id") > 0, F.concat(F.lit("c"), "id"))),
        "disciplines": comps.select(F.col("discipline").alias("id")).distinct().select("id", F.concat(F.lit("d"), "id").alias("name"), F.lit("a discipline").alias("description"), (F.col("id") * 7).alias("created_by")),
        "competencies": comps.select(c.alias("id"), "name", F.when(c != 4, "of it").alias("description"), F.when(c == 6, 9).otherwise(F.col("discipline")).alias("discipline_id"), F.col("parent").alias("parent_id")),
        "examples": own.unionByName(again),
        "discipline_contributors": tables.memberships(spark, sf_dir).select(F.col("discipline").alias("discipline_id"), F.col("contributor").alias("contributor_id"), F.when(F.col("contributor") != 3, F.col("role")).alias("role")),
        "curriculum_versions": comps.select(F.concat(F.lit("v"), c).alias("id"), F.col("discipline").alias("discipline_id"), F.floor(c / 3).alias("version_number"), c.alias("created_by")),
        "discovery_sessions": conv.select((k % 9).alias("contributor_id")).distinct().select(F.concat(F.lit("s"), "contributor_id").alias("id"), F.when(F.col("contributor_id") != 2, "talk").alias("discipline_name"), "contributor_id"),
    }


@query("f19_curriculum_audit", statement(f", {_SEVEN}\n{_AUDITED}", "examples", "competencies", "memberships"))
def curriculum_audit(spark, sf_dir):
    """Faults of the seven tables."""
    return C.audit(_curriculum(spark, sf_dir))


@query(
    "f19_removal",
    statement(
        f""", {_SEVEN}, gone AS (SELECT id FROM disciplines WHERE id = 0), gc AS (SELECT DISTINCT id FROM comps WHERE discipline_id IN (SELECT id FROM gone)), ge AS (SELECT DISTINCT id FROM exs WHERE discipline_id IN (SELECT id FROM gone) OR competency_id IN (SELECT id FROM gc))
SELECT 'disciplines' AS "table", 'removed' AS effect, count(*) AS n FROM gone UNION ALL SELECT 'competencies', 'removed', count(*) FROM gc UNION ALL SELECT 'competencies.parent_id', 'emptied', count(*) FROM comps WHERE id NOT IN (SELECT id FROM gc) AND parent_id IN (SELECT id FROM gc)
UNION ALL SELECT 'examples', 'removed', count(*) FROM ge UNION ALL SELECT 'discipline_contributors', 'removed', count(*) FROM (SELECT DISTINCT discipline_id, contributor_id FROM members WHERE discipline_id IN (SELECT id FROM gone)) UNION ALL SELECT 'curriculum_versions', 'removed', count(*) FROM versions WHERE discipline_id IN (SELECT id FROM gone)""",
        "examples", "competencies", "memberships",
    ),
)
def removal(spark, sf_dir):
    """What the removal of a discipline takes along."""
    held = _curriculum(spark, sf_dir)
    return C.removal(held, "disciplines", held["disciplines"].where("id = 0"))


_OPS = "CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'delete' WHEN event_type = 'signup' THEN 'insert' ELSE 'update' END"


@query(
    "f20_apply_changes",
    f"""WITH log AS (SELECT user_id AS id, event_id AS seq, {_OPS} AS op, CASE WHEN event_id % 3 > 0 THEN value END AS value, CASE WHEN event_id % 4 = 0 THEN event_type END AS label, event_id AS started FROM events),
live AS (SELECT l.* FROM log l LEFT JOIN (SELECT id, max(seq) AS gone FROM log WHERE op = 'delete' GROUP BY id) g ON l.id = g.id WHERE op <> 'delete' AND (gone IS NULL OR seq > gone))
SELECT id, arg_max(value, seq) FILTER (value IS NOT NULL) AS value, arg_max(label, seq) FILTER (label IS NOT NULL) AS label, arg_min(started, seq) AS started, max(seq) AS seq FROM live GROUP BY id""",
)
def apply_changes(spark, sf_dir):
    """Events as changes of users: some fields are left as they are, one is kept."""
    i, e = F.col("event_id"), F.col("event_type")
    op = F.when((e == "error") & (i % 5 == 0), "delete").when(e == "signup", "insert").otherwise("update")
    log = tables.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), i.alias("seq"), op.alias("op"), F.when(i % 3 > 0, F.col("value")).alias("value"), F.when(i % 4 == 0, e).alias("label"), i.alias("started")
    )
    return C.apply_changes(log, ["value", "label", "started"], ["started"])


@query(
    "f21_curriculum_version",
    statement(
        """, old AS (SELECT discipline, contributor + 1 AS version FROM examples WHERE contributor < 3 GROUP BY ALL), train AS (SELECT * FROM examples WHERE NOT is_test_set),
snap AS (SELECT t.discipline, o.version, 'published' AS status FROM train t JOIN old o ON t.discipline = o.discipline AND t.contributor < o.version
  UNION ALL SELECT t.discipline, coalesce(n.last, 0) + 1, 'draft' FROM train t LEFT JOIN (SELECT discipline, max(version) AS last FROM old GROUP BY discipline) n ON t.discipline = n.discipline),
h AS (SELECT discipline, version, status, count(*) AS example_count FROM snap GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY discipline ORDER BY version DESC) AS place, coalesce(version = max(version) FILTER (status = 'published') OVER (PARTITION BY discipline), false) AS is_latest FROM h""",
        "examples",
    ),
)
def curriculum_version(spark, sf_dir):
    """Published versions by contributors so far, and the next one's draft."""
    rows = tables.examples(spark, sf_dir)
    old = rows.where("contributor < 3").select("discipline", (F.col("contributor") + 1).alias("version")).distinct()
    published = rows.where("NOT is_test_set").join(old, "discipline").where("contributor < version").select("discipline", "version", F.lit("published").alias("status"))
    draft = C.new_version(rows, old).select("discipline", "version", F.lit("draft").alias("status"))
    return C.version_history(published.union(draft))


def _split(name: str, keys: tuple, marked: bool):
    by = ", ".join(keys)
    m = "turn % 9 = 0" if marked else "false"
    want = "CASE WHEN n >= 5 THEN greatest(ceil(n * 0.2::DOUBLE), 1) ELSE 0 END"

    @query(
        name,
        statement(
            f""", e AS (SELECT *, {m} AS m, md5('42:' || example_id) AS h FROM examples), s AS (SELECT {by}, n, greatest({want} - k, 0) AS quota FROM (SELECT {by}, count(*) AS n, count(*) FILTER (m) AS k FROM e GROUP BY {by})),
r AS (SELECT *, row_number() OVER (PARTITION BY {by}, m ORDER BY h, example_id) AS r FROM e)
SELECT example_id, m OR r.r <= s.quota AS is_test FROM r JOIN s ON {' AND '.join(f'r.{k} = s.{k}' for k in keys)}""",
            "examples",
        ),
    )
    def plan(spark, sf_dir):
        rows = tables.examples(spark, sf_dir).withColumn("marked", F.col("turn") % 9 == 0)
        return C.split_stratified(rows, keys, marked="marked" if marked else None).select("example_id", "is_test")


_split("f22_split_stratified", ("competency",), False)
_split("f23_split_random", ("discipline",), False)
_split("f24_split_challenge_first", ("competency",), True)


@query("f25_split_summary", statement("SELECT competency, count(*) AS total, count(*) FILTER (is_test_set) AS tests, count(*) FILTER (NOT is_test_set) AS training, count(*) FILTER (is_test_set AND turn % 9 = 0) AS challenge FROM examples GROUP BY competency", "examples"))
def split_summary(spark, sf_dir):
    test = F.col("is_test_set")
    return tables.examples(spark, sf_dir).groupBy("competency").agg(F.count("*").alias("total"), F.count_if(test).alias("tests"), F.count_if(~test).alias("training"), F.count_if(test & (F.col("turn") % 9 == 0)).alias("challenge"))


@query("f26_train_val_split", statement("SELECT example_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || example_id), example_id) <= floor(count(*) OVER () * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM examples", "examples"))
def train_val_split(spark, sf_dir):
    return C.train_val_split(tables.examples(spark, sf_dir))


@query("f27_length_outliers", statement("SELECT example_id, CASE WHEN l < 0.5 * m THEN 'short' ELSE 'long' END AS issue FROM (SELECT example_id, length(answer) AS l, avg(length(answer)) OVER (PARTITION BY competency) AS m, count(*) OVER (PARTITION BY competency) AS n FROM examples) WHERE n >= 5 AND (l < 0.5 * m OR l > 2 * m)", "examples"))
def length_outliers(spark, sf_dir):
    return C.length_outliers(tables.examples(spark, sf_dir))


_VOCABULARY = ("thing", "edon", "ation")


_GAPS = "SELECT example_id FROM examples WHERE NOT (" + " OR ".join(f"contains(lower(question || ' ' || answer), '{w}')" for w in _VOCABULARY) + ")"


@query("f28_terminology_gaps", statement(_GAPS, "examples"))
def terminology_gaps(spark, sf_dir):
    return C.terminology_gaps(tables.examples(spark, sf_dir), _VOCABULARY)


_CITED = r"cited AS (SELECT example_id, question, CASE turn % 4 WHEN 0 THEN answer || ' TM 9-23-' || conv_id % 9 || '1' WHEN 2 THEN answer || ' TM9-23-' || conv_id % 9 || '1' ELSE answer END AS answer FROM examples), forms AS (SELECT example_id, form, replace(form, ' ', '') AS key FROM (SELECT example_id, unnest(list_distinct(regexp_extract_all(question || ' ' || answer, '\b[A-Z]{2,4}\s*\d[\d-]+\d\b'))) AS form FROM cited)), odd AS (SELECT key, example_id, form FROM forms WHERE key IN (SELECT key FROM forms GROUP BY key HAVING count(DISTINCT form) > 1))"


@query("f29_citation_inconsistency", statement(f", {_CITED}\nSELECT key, example_id, form FROM odd", "examples"))
def citation_inconsistency(spark, sf_dir):
    k, n = F.col("turn") % 4, F.concat(F.col("conv_id") % 9, F.lit("1"))
    answer = F.when(k == 0, F.concat("answer", F.lit(" TM 9-23-"), n)).when(k == 2, F.concat("answer", F.lit(" TM9-23-"), n)).otherwise(F.col("answer"))
    return C.citation_forms(tables.examples(spark, sf_dir).withColumn("answer", answer)).select("key", "example_id", "form")


_QTOK = r"list_sort(list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')))"
_J = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 1 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"
_NEAR = f"""copies AS (SELECT example_id, discipline, question, answer FROM examples UNION ALL SELECT example_id || '*', discipline, question || ' more', reverse(answer) FROM examples WHERE conv_id % 9 = 0),
sets AS MATERIALIZED (SELECT example_id, discipline, {_QTOK.format('question')} AS q, {_QTOK.format('answer')} AS w FROM copies),
classes AS MATERIALIZED (SELECT discipline, q, w, min(example_id) AS class_id FROM sets GROUP BY ALL),
pairs AS (SELECT x.discipline, x.class_id FROM classes x JOIN classes y ON x.discipline = y.discipline AND x.class_id <> y.class_id WHERE {_J.format('x.q', 'y.q')} >= 0.7 AND {_J.format('x.w', 'y.w')} < 0.7),
linked AS (SELECT discipline, class_id, count(*) AS n FROM pairs GROUP BY ALL),
clashes AS (SELECT s.example_id, c.class_id, coalesce(l.n, 0) AS links FROM sets s JOIN classes c ON s.discipline = c.discipline AND s.q = c.q AND s.w = c.w LEFT JOIN linked l ON l.discipline = c.discipline AND l.class_id = c.class_id)"""


def _copies(spark, sf_dir):
    rows = tables.examples(spark, sf_dir).select("example_id", "discipline", "question", "answer", "conv_id")
    again = rows.where("conv_id % 9 = 0").select(F.concat("example_id", F.lit("*")), "discipline", F.concat("question", F.lit(" more")), F.reverse("answer"), "conv_id")
    return rows.union(again)


@query("f30_conflicts", statement(f", {_NEAR}\nSELECT example_id, class_id, links FROM clashes", "examples"))
def conflicts(spark, sf_dir):
    """Each example with its class and the number of classes that it clashes with."""
    return C.conflicts(_copies(spark, sf_dir))


@query("f31_check_new_examples", statement(f", {_NEAR}\nSELECT example_id, class_id, links FROM clashes WHERE ends_with(example_id, '*')", "examples"))
def check_new_examples(spark, sf_dir):
    """The rows that are new, marked by a star, as a batch against an index of the others."""
    rows, new = _copies(spark, sf_dir), F.col("example_id").endswith("*")
    return C.check_batch(C.index_examples(rows.where(~new)), rows.where(new))


@query(
    "f31_check_new_lengths",
    statement(
        "SELECT example_id, CASE WHEN l < 0.5 * m THEN 'short' ELSE 'long' END AS issue FROM (SELECT example_id, turn, length(answer) AS l, avg(length(answer)) OVER (PARTITION BY competency) AS m, count(*) OVER (PARTITION BY competency) AS n FROM examples) WHERE n >= 5 AND (l < 0.5 * m OR l > 2 * m) AND turn % 4 = 0",
        "examples",
    ),
)
def check_new_lengths(spark, sf_dir):
    """The new rows' lengths, in a pool with the old ones."""
    rows = tables.examples(spark, sf_dir)
    return C.length_outliers(rows).join(rows.where("turn % 4 = 0").select("example_id"), "example_id", "left_semi")


_CHECKS = {
    "length_outlier": "SELECT example_id FROM (SELECT example_id, length(answer) AS l, avg(length(answer)) OVER (PARTITION BY competency) AS m, count(*) OVER (PARTITION BY competency) AS n FROM examples) WHERE n >= 5 AND (l < 0.5 * m OR l > 2 * m)",
    "terminology": _GAPS, "citation_format": "SELECT example_id FROM odd", "conflict": "SELECT example_id FROM clashes WHERE links > 0",
}
_REPORTED = " UNION ALL ".join(f"SELECT '{k}' AS issue, '{C.ISSUES[k][0]}' AS severity, count(*) AS n, count(DISTINCT example_id) AS examples, '{C.ISSUES[k][1].replace(chr(39), chr(39) * 2)}' AS fix FROM ({q})" for k, q in _CHECKS.items())


@query("f32_consistency_report", statement(f", {_CITED}, {_NEAR}\nSELECT *, bool_or(severity = 'error' AND n > 0) OVER () AS has_errors FROM ({_REPORTED})", "examples"))
def consistency_report(spark, sf_dir):
    clashes = conflicts(spark, sf_dir).where("links > 0").select("example_id")
    return C.consistency_report(length_outliers(spark, sf_dir), terminology_gaps(spark, sf_dir), citation_inconsistency(spark, sf_dir), clashes)


_DRAFTS = "drafts AS (SELECT example_id, CASE WHEN turn % 7 = 0 THEN '  ' WHEN turn % 5 = 0 THEN substr(question, 1, 8) ELSE question END AS question, CASE WHEN turn % 6 = 2 THEN substr(answer, 1, 9) ELSE answer END AS answer, CASE WHEN conv_id % 11 > 0 THEN competency END AS competency, turn % 7 AS difficulty, turn, conv_id FROM examples)"


def _drafts(spark, sf_dir):
    turn = F.col("turn")
    q = F.when(turn % 7 == 0, "  ").when(turn % 5 == 0, F.substring("question", 1, 8)).otherwise(F.col("question"))
    a = F.when(turn % 6 == 2, F.substring("answer", 1, 9)).otherwise(F.col("answer"))
    rows = tables.examples(spark, sf_dir)
    return rows.withColumns({"question": q, "answer": a, "competency": F.when(F.col("conv_id") % 11 > 0, F.col("competency")), "difficulty": turn % 7})


@query(
    "f33_validate_drafts",
    statement(
        f""", {_DRAFTS}
SELECT example_id, error FROM (SELECT example_id, unnest([CASE WHEN {STRIP.format('question')} = '' THEN 'no question' END, CASE WHEN {STRIP.format('answer')} = '' THEN 'no answer' END, CASE WHEN competency IS NULL THEN 'no competency' END,
  CASE WHEN length(question) < 10 THEN 'short question' END, CASE WHEN length(answer) < 10 THEN 'short answer' END, CASE WHEN difficulty < 1 OR difficulty > 5 THEN 'difficulty' END]) AS error FROM drafts) WHERE error IS NOT NULL""",
        "examples",
    ),
)
def validate_drafts(spark, sf_dir):
    return C.validate_drafts(_drafts(spark, sf_dir))


@query(
    "f33_draft_context",
    statement(
        f""", {_DRAFTS}
SELECT example_id, array_to_string(list_filter([CASE WHEN turn % 4 > 0 THEN 'turn ' || turn END, CASE WHEN conv_id % 3 = 1 THEN 'reasoning_pattern: steps' END, CASE WHEN conv_id % 5 = 2 THEN 'equipment: pump ' || conv_id END,
  CASE WHEN turn % 8 = 2 THEN 'procedure_ref: 3-' || turn END, CASE WHEN difficulty <> 3 THEN 'difficulty: ' || difficulty END, CASE WHEN conv_id % 2 = 0 THEN 'tags: a, b' END], lambda x: x IS NOT NULL), ' | ') AS context FROM drafts""",
        "examples",
    ),
)
def draft_context(spark, sf_dir):
    c, turn = F.col("conv_id"), F.col("turn")
    tags = F.when(c % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    context = C.draft_context(
        F.when(turn % 4 > 0, F.concat(F.lit("turn "), "turn")), F.when(c % 3 == 1, "steps"), F.when(c % 5 == 2, F.concat(F.lit("pump "), "conv_id")), F.when(turn % 8 == 2, F.concat(F.lit("3-"), "turn")), F.col("difficulty"), tags
    )
    return _drafts(spark, sf_dir).select("example_id", context.alias("context"))


_ASKED = """turns AS (SELECT conv_id AS session, conv_id % 7 % 2 AS discipline, turn, role, text FROM conversations),
catalog AS (SELECT discipline, turn AS question, turn // 4 AS phase, turn % 4 < 2 AS required FROM turns WHERE role = 'user' GROUP BY ALL)"""


@query(
    "f34_discovery_progress",
    f"""WITH {_ASKED}, needed AS (SELECT discipline, list(question ORDER BY question) AS qs FROM catalog WHERE required GROUP BY discipline),
got AS (SELECT session, discipline, coalesce(list(turn - 1) FILTER (role = 'assistant'), []) AS answered FROM turns GROUP BY ALL),
r AS (SELECT session, coalesce(qs, []) AS qs, list_filter(coalesce(qs, []), lambda q: NOT list_contains(answered, q)) AS missing FROM got LEFT JOIN needed ON got.discipline = needed.discipline)
SELECT session, CAST(len(qs) - len(missing) AS BIGINT) AS answered_required, CAST(len(qs) AS BIGINT) AS required, CASE WHEN len(qs) > 0 THEN round((len(qs) - len(missing)) / len(qs), 6) ELSE 0 END AS completion,
  coalesce(array_to_string(missing, ','), '') AS unanswered_required,
  coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(qs, lambda q: q // 4), lambda p: NOT list_contains(list_transform(missing, lambda m: m // 4), p)))), ','), '') AS phases_complete, CAST(2 * len(missing) AS BIGINT) AS minutes_remaining FROM r""",
)
def discovery_progress(spark, sf_dir):
    """Conversations as sessions: a user's turn is a question of the discipline's
    catalog, the assistant's next turn its answer."""
    turns = tables.table(spark, sf_dir, "conversations").withColumn("discipline", F.col("conv_id") % 7 % 2)
    asked = turns.where("role = 'user'").select("discipline", F.col("turn").alias("question"), F.floor(F.col("turn") / 4).alias("phase"), (F.col("turn") % 4 < 2).alias("required"))
    answered = F.collect_list(F.when(F.col("role") == "assistant", F.col("turn") - 1)).alias("answered")
    return C.discovery_progress(turns.groupBy(F.col("conv_id").alias("session"), "discipline").agg(answered), asked.distinct())


_LISTS = """, numbered AS (SELECT conv_id AS session, string_split(answer, ' ') AS items, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM examples)"""


def _list(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return tables.examples(spark, sf_dir).select(F.col("conv_id").alias("session"), F.split("answer", " ").alias("items"), k.alias("k"))


def _items(k: int):
    return F.coalesce(F.max(F.when(F.col("k") == k, F.col("items"))), F.expr("cast(array() as array<string>)"))


@query(
    "f35_seed_competencies",
    statement(
        f"""{_LISTS}, per AS (SELECT session, max(items) FILTER (k = 1) AS items, coalesce(max(items) FILTER (k = 2), []) AS safety FROM numbered GROUP BY session),
e AS (SELECT session, CAST(unnest(range(len(items))) AS BIGINT) AS place, unnest(items) AS name, list_transform(safety, lambda x: {STRIP.format('lower(x)')}) AS s FROM per)
SELECT session, place, name, CASE WHEN list_contains(s, {STRIP.format('lower(name)')}) THEN 'SAFETY CRITICAL: ' || name ELSE name END AS description, CAST(25 AS BIGINT) AS coverage_target FROM e""",
        "examples",
    ),
)
def seed_competencies(spark, sf_dir):
    """A session's first answer lists competencies, its second the critical."""
    return C.seed_competencies(_list(spark, sf_dir).groupBy("session").agg(_items(1).alias("items"), _items(2).alias("safety")))


@query(
    "f35_discipline_vocabulary",
    statement(
        f"""{_LISTS}, w AS (SELECT session, k, CAST(unnest(range(len(items))) AS BIGINT) AS i, unnest(items) AS word FROM numbered WHERE k IN (3, 4)),
f AS (SELECT session, word, row_number() OVER (PARTITION BY session, word ORDER BY k, i) AS r, k, i FROM w)
SELECT session, string_agg(word, ' ' ORDER BY k, i) AS vocabulary, count(*) AS n_words FROM f WHERE r = 1 GROUP BY session""",
        "examples",
    ),
)
def discipline_vocabulary(spark, sf_dir):
    """The third and fourth lists, each word once, in order."""
    rows = _list(spark, sf_dir).where("k IN (3, 4)").groupBy("session").agg(F.array_distinct(F.concat(_items(3), _items(4))).alias("v"))
    return rows.select("session", F.array_join("v", " ").alias("vocabulary"), F.size("v").cast("bigint").alias("n_words"))


@query("f36_curriculum_stats", statement("SELECT competency, discipline, count(*) AS n, CAST(sum(length(question)) AS BIGINT) AS question_chars, CAST(sum(length(answer)) AS BIGINT) AS answer_chars FROM examples GROUP BY GROUPING SETS ((competency), (discipline), ())", "examples"))
def curriculum_stats(spark, sf_dir):
    rows = tables.examples(spark, sf_dir)
    sets = [[F.col("competency")], [F.col("discipline")], []]
    return rows.groupingSets(sets, F.col("competency"), F.col("discipline")).agg(F.count("*").alias("n"), F.sum(F.length("question")).alias("question_chars"), F.sum(F.length("answer")).alias("answer_chars"))
