"""SQL forms of the derived tables, as named steps of a WITH clause."""

from __future__ import annotations

STEPS: dict[str, tuple[list[str], str]] = {}


def step(name: str, body: str, *needs: str) -> None:
    STEPS[name] = (list(needs), body)


def statement(final: str, *names: str) -> str:
    """``final`` behind the steps that it needs, each once and in order."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for n in STEPS[name][0]:
                add(n)
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({STEPS[n][1]})" for n in order) + "\n" + final


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
TOKENS = "CAST(CASE WHEN length({0}) = 0 THEN 0 ELSE greatest(1, length({0}) // 4) END AS BIGINT)"
WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda x: x <> '')"
TOKEN_SET = r"list_distinct(list_filter(string_split_regex(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+'), lambda x: x <> ''))"
JACCARD = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN {2} ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"

step("lines", "SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents")
step("stripped", f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, {STRIP.format('raw')} AS content FROM lines", "lines")
step(
    "blocks",
    r"""SELECT doc_id, pos, doc_id || ':' || pos AS block_id, content, CAST(pos // 8 + 1 AS INTEGER) AS page,
  CASE WHEN length(content) < 80 AND NOT regexp_matches(content, '[.,;:!?]$')
    THEN CASE WHEN regexp_matches(content, '\p{Lu}') AND NOT regexp_matches(content, '\p{Ll}') THEN 1 WHEN regexp_matches(content, '^\p{Lu}') THEN 2 END END AS heading_level
  FROM stripped WHERE content <> ''""",
    "stripped",
)
step("typed", "SELECT *, CASE WHEN heading_level IS NULL THEN 'text' ELSE 'heading' END AS type FROM blocks", "blocks")
step(
    "outline",
    f"""SELECT *, {TOKENS.format('content')} AS tokens FROM (SELECT doc_id, pos, block_id, page,
  CASE WHEN pos % 5 = 0 THEN 'heading' WHEN pos % 11 = 7 THEN 'table' WHEN pos % 13 = 9 THEN 'code' ELSE 'text' END AS type,
  CASE WHEN pos % 5 = 0 THEN CAST(1 + (pos // 5 + doc_id) % 3 AS INTEGER) END AS heading_level,
  CASE WHEN pos % 5 = 0 THEN {STRIP.format('substr(content, 1, 40)')} WHEN pos % 11 = 7 THEN CASE WHEN pos % 2 = 0 THEN content || chr(10) || '|---|' ELSE '| a |' || chr(10) || '|---|' || chr(10) || content END
    ELSE content END AS content FROM blocks)""",
    "blocks",
)
step(
    "decorated",
    r"""SELECT doc_id, pos, block_id, page, CASE k WHEN 10 THEN 'header' WHEN 11 THEN 'footer' ELSE type END AS type, CAST(4 + 60 * k AS DOUBLE) AS y1,
  CASE k WHEN 0 THEN substr(content, 1, 30) || ' ..... ' || page WHEN 1 THEN 'Page ' || page || ' of 9' WHEN 2 THEN 'Distribution Statement A: ' || content
    WHEN 3 THEN content || ' (continued)' WHEN 4 THEN '-----' || chr(10) || content WHEN 5 THEN '“' || content || '” — it’s…' WHEN 6 THEN content || ' wo-' || chr(10) || 'rd'
    WHEN 7 THEN '  ' || replace(content, ' ', '  ') || repeat(chr(10), 4) || 'end' WHEN 8 THEN 'For Official Use Only' WHEN 9 THEN 'The same running title' ELSE content END AS content
  FROM (SELECT *, pos % 12 AS k FROM typed)""",
    "typed",
)
step(
    "sectioned",
    "SELECT *, CAST(sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS section_no FROM outline",
    "outline",
)
_H = ", ".join(
    f"last_value(CASE WHEN type = 'heading' AND heading_level = {k} THEN pos END IGNORE NULLS) OVER w AS p{k}, last_value(CASE WHEN type = 'heading' AND heading_level = {k} THEN content END IGNORE NULLS) OVER w AS h{k}"
    for k in range(1, 4)
)
step("heads", f"SELECT *, {_H} FROM sectioned WINDOW w AS (PARTITION BY doc_id ORDER BY pos)", "sectioned")
step(
    "pathed",
    """SELECT *, list_filter([CASE WHEN p1 IS NOT NULL THEN h1 END, CASE WHEN p2 > coalesce(p1, -1) THEN h2 END,
  CASE WHEN p3 > coalesce(p1, -1) AND p3 > coalesce(p2, -1) THEN h3 END], lambda x: x IS NOT NULL) AS path FROM heads""",
    "heads",
)
step(
    "sections0",
    f"""SELECT doc_id, section_no, max(CASE WHEN type = 'heading' THEN content END) AS heading, max(CASE WHEN type = 'heading' THEN heading_level END) AS level,
  max(CASE WHEN type = 'heading' THEN array_to_string(path, ' > ') END) AS path, max(CASE WHEN type = 'heading' THEN CAST(len(path) AS BIGINT) END) AS depth,
  coalesce(string_agg(CASE WHEN type <> 'heading' THEN content END, chr(10) || chr(10) ORDER BY pos), '') AS content, CAST(sum({TOKENS.format('content')}) AS BIGINT) AS tokens,
  count(CASE WHEN type <> 'heading' THEN 1 END) AS n_content, min(page) AS start_page, max(page) AS end_page,
  coalesce(string_agg(CASE WHEN type <> 'heading' THEN block_id END, ',' ORDER BY pos), '') AS block_ids, max(CASE WHEN type = 'heading' THEN pos END) AS hpos,
  max(CASE WHEN type = 'heading' THEN CASE heading_level WHEN 2 THEN p1 WHEN 3 THEN greatest(p1, p2) END END) AS ppos FROM pathed GROUP BY doc_id, section_no""",
    "pathed",
)
step(
    "sections",
    """SELECT s.*, p.section_no AS parent_no, coalesce(c.n, 0) AS child_count FROM sections0 s LEFT JOIN sections0 p ON s.doc_id = p.doc_id AND s.ppos = p.hpos
  LEFT JOIN (SELECT doc_id, ppos, count(*) AS n FROM sections0 WHERE ppos IS NOT NULL GROUP BY ALL) c ON s.doc_id = c.doc_id AND s.hpos = c.ppos""",
    "sections0",
)
_BROKEN = "type = 'table' AND len(string_split(content, chr(10))) >= 2 AND (NOT contains(string_split(content, chr(10))[1], '|') OR NOT contains(string_split(content, chr(10))[2], '---'))"
_CHUNK = f"""string_agg(content, chr(10) || chr(10) ORDER BY pos) AS content, count(*) AS block_count, string_agg(block_id, ',' ORDER BY pos) AS block_ids, min(page) AS start_page, max(page) AS end_page,
  arg_max(type, pos) AS last_type, bool_or(type = 'heading') AS has_heading, bool_or(type IN ('text', 'list', 'table')) AS has_content, bool_or({_BROKEN}) AS has_broken_table"""
step(
    "chunks0",
    f"""SELECT doc_id, section_no AS chunk_pos, doc_id || '-' || section_no AS chunk_id, coalesce(max(CASE WHEN type = 'heading' THEN array_to_string(path, ' > ') END), '') AS hierarchy_path,
  {_CHUNK} FROM pathed GROUP BY doc_id, section_no""",
    "pathed",
)
step("chunks", f"SELECT *, {TOKENS.format('content')} AS token_count FROM chunks0", "chunks0")
step("pages0", f"SELECT doc_id, CAST(page - 1 AS BIGINT) AS chunk_pos, doc_id || '-p' || page AS chunk_id, '' AS hierarchy_path, {_CHUNK} FROM outline GROUP BY doc_id, page", "outline")
step("page_chunks", f"SELECT *, {TOKENS.format('content')} AS token_count FROM pages0", "pages0")
step(
    "examples",
    """SELECT u.conv_id || ':' || u.turn AS example_id, u.conv_id, u.turn, u.text AS question, a.text AS answer, u.conv_id % 7 AS competency, u.conv_id % 7 % 2 AS discipline,
  u.conv_id % 5 AS contributor, ['approved', 'pending', 'rejected', 'approved'][CAST((u.conv_id + u.turn) % 4 + 1 AS INTEGER)] AS review_status, u.turn % 6 = 0 AS is_test_set
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""",
)
step(
    "competencies",
    """SELECT DISTINCT conv_id % 7 AS competency, conv_id % 7 % 2 AS discipline, 'competency ' || conv_id % 7 AS name, 10 + 5 * (conv_id % 7) AS target,
  CASE WHEN conv_id % 7 >= 3 THEN conv_id % 7 // 3 END AS parent, coalesce(description, '') AS description FROM conversations LEFT JOIN (SELECT doc_id, substr(text, 1, 200) AS description FROM documents WHERE doc_id < 7) ON doc_id = conv_id % 7""",
)
step(
    "memberships",
    """SELECT contributor, discipline, ['lead', 'member', 'admin'][CAST(contributor % 3 + 1 AS INTEGER)] AS role, CASE WHEN contributor % 2 = 0 THEN [] ELSE [1, 3, 5] END AS areas FROM
  (SELECT DISTINCT conv_id % 5 AS contributor, conv_id % 7 % 2 AS discipline FROM conversations UNION ALL SELECT DISTINCT 90, conv_id % 7 % 2 FROM conversations)""",
)
step(
    "evals",
    """SELECT r.run, example_id, competency, discipline, answer AS expected, CASE WHEN conv_id % 17 = 0 THEN '' ELSE
  array_to_string(string_split(answer, ' ')[1:CAST(floor(len(string_split(answer, ' ')) * ((conv_id + r.run - 1) % 5 + 1) / 5) AS INTEGER)], ' ') END AS response
  FROM examples, (VALUES (CAST(1 AS BIGINT)), (CAST(2 AS BIGINT))) AS r(run)""",
    "examples",
)
step(
    "graded",
    f"""SELECT *, CASE WHEN trim(response) = '' THEN 'no_response' WHEN s >= 0.7 THEN 'correct' WHEN s >= 0.4 THEN 'partially_correct' ELSE 'incorrect' END AS quality FROM
  (SELECT *, {JACCARD.format('a', 'b', '0')} AS s FROM (SELECT *, {TOKEN_SET.format('expected')} AS a, {TOKEN_SET.format('response')} AS b FROM evals))""",
    "evals",
)
step(
    "scores",
    """SELECT run, competency, discipline, count(*) AS total, count(*) FILTER (quality = 'correct') AS correct, count(*) FILTER (quality = 'partially_correct') AS partial,
  count(*) FILTER (quality = 'incorrect') AS incorrect, count(*) FILTER (quality = 'no_response') AS no_response,
  count(*) FILTER (quality = 'correct') / count(*) AS share FROM graded GROUP BY ALL""",
    "graded",
)
step(
    "metrics",
    """SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value / 100 AS train_loss,
  CASE WHEN event_id % 2 = 0 THEN value / 100 * 1.2 END AS val_loss, value AS gradient_norm FROM events""",
)
step(
    "signals",
    """SELECT event_id AS signal_id, CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'click' THEN 'citation_clicked' WHEN 'view' THEN 'no_result'
  WHEN 'error' THEN CASE WHEN event_id % 3 > 0 THEN 'rejected' ELSE 'flagged_error' END ELSE CASE WHEN event_id % 2 = 0 THEN 'follow_up' ELSE 'rephrased' END END AS signal_type,
  user_id AS conversation_id, 'q' || event_id % 40 AS query, CASE WHEN user_id % 3 > 0 THEN 'd' || user_id % 3 END AS discipline_id, ts, (event_id % 10) / 10 AS citation_score FROM events""",
)
