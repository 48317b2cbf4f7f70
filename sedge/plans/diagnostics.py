"""Queries over diagnostics, questions and fixes of chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics as D
from ..operators.retrieval import keyword_search
from ..sources import tables
from ..sources.shared import stored
from .catalog import query
from .retrieval import hits_sql
from .sql import STRIP, TOKENS, statement

_ANY = lambda c, ps: "(" + " OR ".join(f"regexp_matches({c}, '(?i){p}')" for p in ps) + ")"
_C = STRIP.format("content")
_CONN = "(" + " OR ".join(f"starts_with(lower({_C}), '{w}')" for w in D.CONNECTIVES) + ")"
_ASK_CONN = "(" + " OR ".join(f"starts_with(lower({_C}), '{w}')" for w in D.ASK_CONNECTIVES) + ")"
_LONG = f"length(x) > {D.LIST_DIGITS}"
_NUMS = rf"list_transform(list_transform(regexp_extract_all(content, '{D.LIST_NUMBER}', 1), lambda x: coalesce(nullif(ltrim(x, '0'), ''), '0')), lambda x: CASE WHEN {_LONG} THEN CAST('1{'0' * D.LIST_DIGITS}' AS HUGEINT) ELSE CAST(x AS HUGEINT) END)"
_MARKS = "len(list_filter(string_split(content, chr(10)), lambda x: contains(x, '|') OR contains(x, chr(9) || chr(9)) OR contains(x, '────')))"
_RULES = {
    "size_small": "CASE WHEN token_count < 10 THEN 'high' WHEN token_count < 20 THEN 'medium' END",
    "size_large": "CASE WHEN token_count > 800 THEN 'high' WHEN token_count > 500 THEN 'medium' END",
    "lowercase_start": rf"CASE WHEN regexp_matches({_C}, '^\p{{Ll}}') THEN 'high' END",
    "connective": f"CASE WHEN {_CONN} THEN 'medium' END",
    "incomplete_end": f"CASE WHEN length({_C}) > 50 AND NOT regexp_matches({_C}, '[.!?]$') THEN 'medium' END",
    "forward_ref": f"CASE WHEN {_ANY('content', D.FORWARD)} THEN 'medium' END",
    "backward_ref": f"CASE WHEN {_ANY('content', D.BACKWARD)} THEN 'low' END",
    "list_start": "CASE WHEN len(nums) > 0 AND list_min(nums) > 1 THEN 'high' END",
    "list_gaps": "CASE WHEN len(nums) > 0 AND list_max(nums) - list_min(nums) + 1 > len(list_distinct(nums)) THEN 'medium' END",
    "table_partial": "CASE WHEN marks BETWEEN 1 AND 2 THEN 'medium' END",
}
_TYPE = "CASE p.kind " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in D.TYPES.items()) + " END"


def _problems_of(rows: str, prefix: str = "") -> str:
    """Steps that find the problems of chunks (doc_id, chunk_pos, chunk_id, content)."""
    kinds = ", ".join(f"{{'kind': '{k}', 'severity': {v}, 'rule': {n}}}" for n, (k, v) in enumerate(_RULES.items()))
    return f"""{prefix}around AS (SELECT *, {TOKENS.format('content')} AS token_count, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id FROM {rows} WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_pos)),
{prefix}counted AS MATERIALIZED (SELECT *, {_NUMS} AS nums, {_MARKS} AS marks FROM {prefix}around),
{prefix}problems AS MATERIALIZED (SELECT doc_id, chunk_id, chunk_pos, token_count, prev_id, next_id, content, 'problem_' || chunk_id || '_' || p.kind AS problem_id, p.kind AS kind, {_TYPE} AS problem_type, p.severity AS severity, p.rule AS rule
  FROM (SELECT *, unnest([{kinds}]) AS p FROM {prefix}counted) WHERE p.severity IS NOT NULL)"""


# Numbered lines and headings are put into some chunks, which have none.
_LISTED = f"""listed0 AS (SELECT doc_id, chunk_pos, chunk_id, CASE CAST(chunk_pos % 6 AS INTEGER) WHEN 1 THEN '3. ' || content || chr(10) || '5) end' WHEN 2 THEN 'However, ' || content || ' as noted above'
  WHEN 3 THEN content || ' | see table 4' WHEN 4 THEN '1. a' || chr(10) || '2. b' || chr(10) || '20000. c' || chr(10) || content WHEN 5 THEN replace(content, chr(10) || chr(10), chr(10) || '2.1 part' || chr(10)) ELSE content END AS content FROM chunks),
{_problems_of('listed0')}, listed AS (SELECT * FROM counted)"""


def _sql(final: str) -> str:
    return statement(f", {_LISTED}\n{final}", "chunks")


def listed(spark, sf_dir):
    from ..functions.text import tokens

    k, c = F.col("chunk_pos") % 6, F.col("content")
    content = (
        F.when(k == 1, F.concat(F.lit("3. "), c, F.lit("\n5) end"))).when(k == 2, F.concat(F.lit("However, "), c, F.lit(" as noted above")))
        .when(k == 3, F.concat(c, F.lit(" | see table 4"))).when(k == 4, F.concat(F.lit("1. a\n2. b\n20000. c\n"), c))
        .when(k == 5, F.replace(c, F.lit("\n\n"), F.lit("\n2.1 part\n"))).otherwise(c)
    )
    rows = tables.chunks(spark, sf_dir).select("doc_id", "chunk_pos", "chunk_id", content.alias("content"))
    return rows.withColumn("token_count", tokens(F.col("content")))


def _group(name: str, kinds: tuple):
    listed_kinds = ", ".join(f"'{k}'" for k in kinds)

    @query(name, _sql(f"SELECT problem_id, chunk_id, kind, severity FROM problems WHERE kind IN ({listed_kinds})"))
    def plan(spark, sf_dir):
        return D.diagnose(listed(spark, sf_dir), kinds).select("problem_id", "chunk_id", "kind", "severity")


_group("d1_diag_size", ("size_small", "size_large"))
_group("d2_diag_sentence", ("lowercase_start", "connective", "incomplete_end"))
_group("d3_diag_references", ("forward_ref", "backward_ref"))
_group("d4_diag_structure", ("list_start", "list_gaps", "table_partial"))


@query("d5_diagnose", _sql("SELECT problem_id, doc_id, chunk_id, problem_type, severity FROM problems"))
def diagnose(spark, sf_dir):
    return D.diagnose(listed(spark, sf_dir)).select("problem_id", "doc_id", "chunk_id", "problem_type", "severity")


@query(
    "d6_diag_stats",
    _sql(
        "SELECT doc_id, 'all' AS facet, 'all' AS value, count(*) AS problems, count(DISTINCT chunk_id) AS chunks FROM problems GROUP BY doc_id UNION ALL SELECT doc_id, 'type', problem_type, count(*), count(DISTINCT chunk_id) FROM problems GROUP BY doc_id, problem_type "
        "UNION ALL SELECT doc_id, 'severity', severity, count(*), count(DISTINCT chunk_id) FROM problems GROUP BY doc_id, severity"
    ),
)
def diag_stats(spark, sf_dir):
    return D.problem_stats(D.diagnose(listed(spark, sf_dir)))


_W = r"list_filter(string_split_regex(content, '\s+'), lambda x: x <> '')"
_HEAD = r"list_filter(string_split_regex(substr(content, 1, 100), '\s+'), lambda x: x <> '')"
_CAP = rf"list_filter({_HEAD}, lambda x: regexp_matches(x, '^\p{{Lu}}') AND lower(x) NOT IN {D.NO_SUBJECT})"
_TOPICS = f"len(list_distinct(regexp_extract_all(substr(content, 1, 500), '{D.TOPIC}')))"
_Q = f"""asked0 AS (SELECT *, {_W} AS w, {_HEAD} AS head, {_CAP} AS cap, {_C} AS stripped FROM counted),
asked1 AS (SELECT *, CASE WHEN len(cap) > 0 THEN array_to_string(cap[1:3], ' ') WHEN len(head) >= 5 THEN array_to_string(head[1:5], ' ') ELSE substr(content, 1, 30) END AS subject, array_to_string(w[greatest(len(w) - 4, 1):], ' ') AS tail FROM asked0),
questions AS MATERIALIZED (SELECT doc_id, chunk_id, q.t AS question_type, q.x AS question, list_filter(q.e, lambda x: x IS NOT NULL) AS expected FROM (SELECT *, unnest([
  CASE WHEN {_ASK_CONN} THEN {{'t': 'boundary_start', 'x': 'What led to: ' || subject || '?', 'e': [prev_id, chunk_id]}} END,
  CASE WHEN stripped <> '' AND NOT regexp_matches(stripped, '[.!?]$') AND len(w) >= 5 AND next_id IS NOT NULL THEN {{'t': 'boundary_end', 'x': 'What follows after ' || chr(39) || tail || chr(39) || '?', 'e': [chunk_id, next_id]}} END,
  CASE WHEN {_ANY('content', D.ASK_FORWARD)} THEN {{'t': 'reference_forward', 'x': 'What does the text on ' || subject || ' refer to?', 'e': [chunk_id]}} END,
  CASE WHEN {_ANY('content', D.ASK_BACKWARD)} THEN {{'t': 'reference_backward', 'x': 'What was said before about ' || subject || '?', 'e': [chunk_id]}} END,
  CASE WHEN len(nums) > 0 AND list_min(nums) > 1 THEN {{'t': 'structure_list', 'x': 'Which items precede number ' || list_min(nums) || '?', 'e': [prev_id, chunk_id]}} END,
  CASE WHEN len(nums) > 0 AND list_max(nums) >= 5 AND NOT ends_with(stripped, '.') THEN {{'t': 'structure_more', 'x': 'Which items follow number ' || list_max(nums) || '?', 'e': [chunk_id, next_id]}} END,
  CASE WHEN {_ANY('content', D.PROCEDURES)} THEN {{'t': 'structure_procedure', 'x': 'What are the steps for ' || subject || '?', 'e': [chunk_id]}} END,
  CASE WHEN token_count > 500 AND {_TOPICS} > 10 THEN {{'t': 'coherence_large', 'x': 'What is the main topic of ' || subject || '?', 'e': [chunk_id]}} END,
  CASE WHEN token_count < 20 THEN {{'t': 'coherence_small', 'x': 'What is meant by ' || chr(39) || substr(stripped, 1, 50) || chr(39) || '?', 'e': [chunk_id]}} END]) AS q FROM asked1) WHERE q IS NOT NULL)"""
for _name, _kind in (("d7_gen_boundary_questions", "boundary"), ("d8_gen_reference_questions", "reference"), ("d9_gen_structural_questions", "structure"), ("d10_gen_coherence_questions", "coherence")):

    @query(_name, _sql(f", {_Q}\nSELECT chunk_id, question_type, question, array_to_string(expected, ',') AS expected FROM questions WHERE starts_with(question_type, '{_kind}')"))
    def _asked(spark, sf_dir, kind=_kind):
        rows = D.questions(listed(spark, sf_dir), kind)
        return rows.select("chunk_id", "question_type", "question", F.array_join("expected", ",").alias("expected"))


def _results(spark, sf_dir):
    """The questions of every twentieth document, against all chunks."""
    chunks = stored(listed(spark, sf_dir), "listed")
    asked = D.questions(chunks).where("doc_id % 20 = 0").withColumn("question_id", F.concat_ws("|", "chunk_id", "question_type"))
    asked = stored(asked, "questions")
    hits = keyword_search(chunks, asked.select(F.col("question_id").alias("query_id"), F.col("question").alias("query")), 5)
    return D.question_results(asked, hits.withColumnRenamed("query_id", "question_id"))


_TESTED = f"""{_Q}, asked AS (SELECT chunk_id || '|' || question_type AS query_id, question AS query FROM questions WHERE doc_id % 20 = 0), {hits_sql('listed', 5)},
got AS (SELECT query_id, list(chunk_id ORDER BY rank) AS ids FROM hits GROUP BY query_id),
tested0 AS (SELECT q.*, query_id AS question_id, coalesce(ids, []) AS ids FROM (SELECT *, chunk_id || '|' || question_type AS query_id FROM questions WHERE doc_id % 20 = 0) q LEFT JOIN got USING (query_id)),
tested AS (SELECT *, list_filter(expected, lambda x: NOT list_contains(ids, x)) AS missing FROM tested0),
results AS (SELECT *, CASE WHEN len(missing) = 0 THEN 'pass' WHEN len(missing) < len(expected) THEN 'partial' ELSE 'fail' END AS status FROM tested)"""


@query("d11_question_test", _sql(f", {_TESTED}\nSELECT question_id, status, array_to_string(missing, ',') AS missing, array_to_string(list_transform(expected, lambda x: coalesce(list_position(ids, x), 0)), ',') AS ranks FROM results"))
def question_test(spark, sf_dir):
    return _results(spark, sf_dir).select("question_id", "status", F.array_join("missing", ",").alias("missing"), F.array_join(F.transform("ranks", lambda r: r.cast("string")), ",").alias("ranks"))


_STATES = "count(*) AS questions, " + ", ".join(f'count(*) FILTER (status = \'{s}\') AS "{s}"' for s in ("pass", "partial", "fail"))


@query(
    "d12_question_report",
    _sql(
        f""", {_TESTED}, per AS (SELECT doc_id, chunk_id AS name, {_STATES} FROM results GROUP BY ALL)
SELECT 'type' AS facet, NULL AS doc_id, question_type AS name, {_STATES} FROM results GROUP BY question_type
UNION ALL SELECT 'chunk', doc_id, name, questions, "pass", partial, fail FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY partial + fail DESC, name) AS r FROM per WHERE partial + fail > 0) WHERE r <= 10"""
    ),
)
def question_report(spark, sf_dir):
    return D.question_report(_results(spark, sf_dir))


_PIECES = f"string_split_regex(content, '{D.HEADING_LINE}')"
_HEADINGS = f"regexp_extract_all(content, '{D.HEADING_LINE}')"
_PLANS = f"""merges AS (SELECT doc_id, chunk_pos, rule, problem_id, 'merge' AS action, CASE WHEN "to" = prev_id THEN ["to", chunk_id] ELSE [chunk_id, "to"] END AS chunk_ids, CASE WHEN kind IN ('forward_ref', 'backward_ref') THEN 0.6 WHEN kind = 'list_start' AND token_count >= 20 THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence FROM (SELECT *,
  CASE WHEN meaning AND token_count < 20 THEN coalesce(next_id, prev_id) WHEN kind IN ('connective', 'lowercase_start', 'list_start') THEN prev_id WHEN kind = 'incomplete_end' THEN next_id WHEN meaning THEN coalesce(next_id, prev_id)
    WHEN kind = 'forward_ref' THEN next_id WHEN kind = 'backward_ref' THEN prev_id END AS "to" FROM (SELECT *, problem_type IN ('semantic_incomplete', 'structural_breakage') AS meaning FROM problems)) WHERE "to" IS NOT NULL),
cutlist AS (SELECT *, string_split(content, chr(10) || chr(10)) AS parts, {_PIECES} AS pieces, {_HEADINGS} AS heads FROM problems WHERE kind = 'size_large'),
ends AS (SELECT *, len(heads) // 2 AS mid, list_filter(range(1, len(parts)), lambda k: list_sum(list_transform(parts[1:k], lambda p: {TOKENS.format('p')})) >= token_count // 2 * 0.4)[1] AS e FROM cutlist),
splits AS (SELECT doc_id, chunk_pos, rule, problem_id, 'split' AS action, [chunk_id] AS chunk_ids, CASE WHEN len(parts) >= 3 THEN 0.7 WHEN len(heads) >= 2 THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence,
  CAST(CASE WHEN len(parts) >= 3 THEN length(array_to_string(parts[1:coalesce(e, 1)], chr(10) || chr(10)))
    WHEN len(heads) >= 2 THEN list_sum(list_transform(pieces[1:mid + 1], lambda p: length(p))) + coalesce(list_sum(list_transform(heads[1:mid], lambda p: length(p))), 0) ELSE length(content) // 2 END AS INTEGER) AS cut FROM ends),
actions AS MATERIALIZED (SELECT doc_id, chunk_pos, rule, problem_id, action, chunk_ids, confidence, NULL AS cut FROM merges UNION ALL SELECT * FROM splits),
losers AS (SELECT DISTINCT problem_id FROM (SELECT problem_id, row_number() OVER (PARTITION BY chunk ORDER BY confidence DESC, action, chunk_pos, rule) AS r FROM (SELECT *, unnest(chunk_ids) AS chunk FROM actions)) WHERE r > 1),
kept AS MATERIALIZED (SELECT * FROM actions WHERE problem_id NOT IN (SELECT problem_id FROM losers))"""


def _diagnosed(spark, sf_dir):
    """Chunks, their problems and the actions planned, each derived once."""
    chunks = stored(listed(spark, sf_dir), "listed")
    problems = stored(D.diagnose(chunks), "problems")
    return chunks, problems, D.plan_fixes(problems)


def _plan_query(name: str, where: str):
    @query(name, _sql(f", {_PLANS}\nSELECT problem_id, action, array_to_string(chunk_ids, ',') AS chunk_ids, confidence, CAST(cut AS INTEGER) AS cut FROM actions WHERE {where}"))
    def plan(spark, sf_dir):
        rows = _diagnosed(spark, sf_dir)[2].where(where)
        return rows.select("problem_id", "action", F.array_join("chunk_ids", ",").alias("chunk_ids"), "confidence", F.col("at").alias("cut"))


_plan_query("d13_plan_merge", "action = 'merge' AND confidence > 0.6")
_plan_query("d14_plan_split", "action = 'split'")
_plan_query("d15_plan_reference_merge", "action = 'merge' AND confidence = 0.6")


@query(
    "d16_plan_fixes",
    _sql(
        f""", {_PLANS}, n AS (SELECT doc_id, count(*) AS problems FROM problems GROUP BY doc_id), a AS (SELECT doc_id, count(*) AS planned FROM actions GROUP BY doc_id), k AS (SELECT doc_id, count(*) AS kept FROM kept GROUP BY doc_id),
c AS (SELECT doc_id, count(*) FILTER (n > 1) AS conflicts FROM (SELECT doc_id, chunk, count(*) AS n FROM (SELECT doc_id, unnest(chunk_ids) AS chunk FROM actions) GROUP BY ALL) GROUP BY doc_id)
SELECT n.doc_id, problems, coalesce(planned, 0) AS planned, coalesce(k.kept, 0) AS kept, coalesce(conflicts, 0) AS conflicts, round(least(1.0::DOUBLE, coalesce(k.kept, 0) / problems * 0.7::DOUBLE), 6) AS improvement FROM n LEFT JOIN a ON n.doc_id = a.doc_id LEFT JOIN k ON n.doc_id = k.doc_id LEFT JOIN c ON n.doc_id = c.doc_id"""
    ),
)
def plan_fixes(spark, sf_dir):
    _, problems, actions = _diagnosed(spark, sf_dir)
    return D.plan_summary(problems, actions)


@query("d17_resolve_conflicts", _sql(f", {_PLANS}\nSELECT problem_id, action FROM kept"))
def resolve_conflicts(spark, sf_dir):
    return D.resolve_conflicts(_diagnosed(spark, sf_dir)[2]).select("problem_id", "action")


@query("d18_order_actions", _sql(f", {_PLANS}\nSELECT problem_id, action, confidence FROM kept"))
def order_actions(spark, sf_dir):
    """By confidence, merges first, later chunks first."""
    return D.resolve_conflicts(_diagnosed(spark, sf_dir)[2]).orderBy(F.desc("confidence"), "action", F.desc("place"), "doc_id").select("problem_id", "action", "confidence")


_FIXED = f"""named AS (SELECT doc_id, problem_id, action, cut, unnest(chunk_ids) AS chunk_id FROM kept),
m AS (SELECT l.doc_id, n.problem_id, min(chunk_pos) AS chunk_pos, 0 AS half, string_agg(content, chr(10) || chr(10) ORDER BY chunk_pos) AS content FROM listed l JOIN named n USING (chunk_id) WHERE n.action = 'merge' GROUP BY ALL),
s AS (SELECT l.doc_id, chunk_pos, half, CASE half WHEN 0 THEN substr(content, 1, cut) ELSE substr(content, cut + 1) END AS content FROM listed l JOIN named n USING (chunk_id), (VALUES (0), (1)) AS v(half) WHERE n.action = 'split'),
allrows AS (SELECT doc_id, chunk_pos, half, content FROM m UNION ALL SELECT * FROM s UNION ALL SELECT doc_id, chunk_pos, 0, content FROM listed WHERE chunk_id NOT IN (SELECT chunk_id FROM named)),
fixed AS MATERIALIZED (SELECT doc_id, chunk_pos, doc_id || '+' || chunk_pos AS chunk_id, content FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_pos, half) - 1 AS chunk_pos, {STRIP.format('content')} AS content FROM allrows))"""


@query("d19_apply_fixes", _sql(f", {_PLANS}, {_FIXED}\nSELECT doc_id, CAST(chunk_pos AS INTEGER) AS chunk_pos, content, {TOKENS.format('content')} AS token_count FROM fixed"))
def apply_fixes(spark, sf_dir):
    chunks, _, actions = _diagnosed(spark, sf_dir)
    return D.apply_fixes(chunks, D.resolve_conflicts(actions)).select("doc_id", "chunk_pos", "content", "token_count")


@query(
    "d20_fix_report",
    _sql(
        f""", {_PLANS}, {_FIXED}, {_problems_of('fixed', 'new_')}, b AS (SELECT doc_id, count(*) AS n FROM problems GROUP BY doc_id), a AS (SELECT doc_id, count(*) AS n FROM new_problems GROUP BY doc_id), k AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id),
r AS (SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after FROM b FULL JOIN a ON b.doc_id = a.doc_id), t AS (SELECT r.*, coalesce(k.n, 0) AS applied FROM r LEFT JOIN k ON r.doc_id = k.doc_id)
SELECT *, round(CASE WHEN before > 0 THEN (before - after) / before ELSE 0 END, 6) AS reduction, applied > 0 AND after > applied AS validation_failed FROM t"""
    ),
)
def fix_report(spark, sf_dir):
    chunks, problems, actions = _diagnosed(spark, sf_dir)
    kept = stored(D.resolve_conflicts(actions), "actions")
    return D.fix_report(problems, D.diagnose(D.apply_fixes(chunks, kept)), kept)
