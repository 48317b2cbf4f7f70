"""Queries over markup, exports, sinks and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as C
from ..operators import documents as D
from ..operators.registry import register_strategy, strategy
from ..sources import readers, tables
from ..sources.shared import BROADCAST_IDS, shared_folder, small, stored
from ..streaming.runs import exported
from .catalog import SQL, query
from .chunks import scored_sql
from .sql import STRIP, statement

# Markdown made of the corpus: front matter, headings, fences, lists, tables, quotes.
_MD = r"""md AS (SELECT doc_id, '---' || chr(10) || 'title: Doc ' || doc_id || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
  CASE i % 8 WHEN 1 THEN '## ' || substr(x, 1, 30) || chr(10) WHEN 2 THEN '* ' || x || chr(10) || '  + more' WHEN 3 THEN '| ' || substr(x, 1, 10) || ' |b' || chr(10) || '|:--|---|' || chr(10) || '|c| d |' WHEN 4 THEN '```' || chr(10) || x || chr(10) || '```'
  WHEN 5 THEN '4. ' || x || chr(10) || '7) end' WHEN 6 THEN '>' || x || chr(10) || '> said' ELSE x || chr(10) END), chr(10)) AS text FROM documents)"""


def markdown(spark, sf_dir):
    nl = F.lit("\n")
    k = lambda i: (i + 1) % 8
    line = lambda x, i: (
        F.when(k(i) == 1, F.concat(F.lit("## "), F.substring(x, 1, 30), nl)).when(k(i) == 2, F.concat(F.lit("* "), x, F.lit("\n  + more")))
        .when(k(i) == 3, F.concat(F.lit("| "), F.substring(x, 1, 10), F.lit(" |b\n|:--|---|\n|c| d |"))).when(k(i) == 4, F.concat(F.lit("```\n"), x, F.lit("\n```")))
        .when(k(i) == 5, F.concat(F.lit("4. "), x, F.lit("\n7) end"))).when(k(i) == 6, F.concat(F.lit(">"), x, F.lit("\n> said"))).otherwise(F.concat(x, nl))
    )
    body = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    text = F.concat(F.lit("---\ntitle: Doc "), "doc_id", F.lit("\nlang: "), "lang", F.lit("\n---\n\n"), body)
    return tables.table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


_CELLS = f"list_transform(ls, lambda l: list_transform(string_split(regexp_replace({STRIP.format('l')}, '^\\||\\|$', '', 'g'), '|'), lambda c: trim(c)))"
_LISTED = r"array_to_string(list_transform(ls, lambda l, i: CASE WHEN regexp_matches(ls[1], '^\s*\d') THEN i || '. ' ELSE '- ' END || regexp_replace(l, '^\s*([-*+]|\d+[.)])\s+', '')), chr(10))"
_QUOTED = r"array_to_string(list_transform(ls, lambda l: '> ' || regexp_replace(l, '^>\s*', '')), chr(10))"
_TABLE = "array_to_string(list_transform(body, lambda r, i: '| ' || array_to_string(r, ' | ') || ' |' || CASE WHEN i = 1 THEN chr(10) || '| ' || array_to_string(list_transform(r, lambda c: '---'), ' | ') || ' |' ELSE '' END), chr(10))"
_LINES = rf"""lines0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line FROM md),
lines1 AS (SELECT *, sum(CASE WHEN regexp_matches(raw, '^\s*```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS fences FROM lines0),
lines2 AS (SELECT *, CASE WHEN fences % 2 = 1 OR regexp_matches(raw, '^\s*```') THEN 'code' WHEN {STRIP.format('raw')} = '' THEN 'blank' WHEN regexp_matches(raw, '^#{{1,6}}\s') THEN 'heading' WHEN regexp_matches(raw, '^\s*\|') THEN 'table'
  WHEN regexp_matches(raw, '^\s*([-*+]|\d+[.)])\s') THEN 'list' WHEN regexp_matches(raw, '^>') THEN 'quote' ELSE 'text' END AS kind FROM lines1),
lines3 AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM (SELECT *, kind <> coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY line), '') OR kind = 'heading' OR (regexp_matches(raw, '^\s*```') AND fences % 2 = 1) AS new FROM lines2)),
mdb0 AS (SELECT doc_id, CAST(min(line) AS INTEGER) AS line, kind AS type, list(raw ORDER BY line) AS ls, CAST(count(*) AS INTEGER) AS lines FROM lines3 WHERE kind <> 'blank' GROUP BY doc_id, block, kind),
mdb1 AS (SELECT *, array_to_string(ls, chr(10)) AS t, CASE WHEN type = 'table' THEN list_filter({_CELLS}, lambda r: len(list_filter(r, lambda c: NOT regexp_matches(c, '^:?-+:?$'))) > 0) END AS body FROM mdb0),
mdb AS (SELECT doc_id, line, type, lines, CASE type WHEN 'heading' THEN regexp_replace(t, '^#{{1,6}}\s+', '') WHEN 'list' THEN {_LISTED} WHEN 'quote' THEN {_QUOTED} WHEN 'table' THEN {_TABLE} ELSE t END AS content,
  CASE WHEN type = 'heading' THEN CAST(length(regexp_extract(t, '^(#{{1,6}})', 1)) AS INTEGER) END AS heading_level, CASE WHEN type = 'list' THEN regexp_matches(ls[1], '^\s*\d') END AS ordered,
  CAST(CASE type WHEN 'list' THEN lines WHEN 'table' THEN len(body) END AS INTEGER) AS item_count FROM mdb1)"""
_MDB = f"WITH {_MD}, {_LINES}\n"


@query("a5_markdown_to_blocks", _MDB + "SELECT doc_id, line, type, content, heading_level FROM mdb")
def markdown_to_blocks(spark, sf_dir):
    return D.markdown_blocks(markdown(spark, sf_dir)).select("doc_id", "line", "type", "content", "heading_level")


@query("a6_markdown_lists_tables", _MDB + "SELECT doc_id, line, type, lines, content, ordered, item_count FROM mdb WHERE type IN ('list', 'table', 'quote')")
def markdown_lists_tables(spark, sf_dir):
    return D.markdown_blocks(markdown(spark, sf_dir)).where("type IN ('list', 'table', 'quote')").select("doc_id", "line", "type", "lines", "content", "ordered", "item_count")


@query("a7_front_matter", "SELECT doc_id, 'title' AS key, 'Doc ' || doc_id AS value FROM documents UNION ALL SELECT doc_id, 'lang', lang FROM documents")
def front_matter(spark, sf_dir):
    return D.front_matter(markdown(spark, sf_dir))


_DROPPED = "html"
for _t in ("script", "style", "nav", "head", "footer"):
    _DROPPED = f"regexp_replace({_DROPPED}, '(?s)<{_t}\\b.*?</{_t}>', ' ', 'g')"
_DROPPED = f"regexp_replace({_DROPPED}, '(?s)<!--.*?-->', ' ', 'g')"
_CELLS_OF = r"regexp_replace(regexp_replace(raw, '<tr\b[^>]*>', chr(1), 'g'), '<t[dh]\b[^>]*>', ' | ', 'g')"
_BARE = STRIP.format(rf"regexp_replace(regexp_replace(regexp_replace({_CELLS_OF}, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'), ' ?\x01 ?', chr(10), 'g')")
for _a, _b in D.ENTITIES:
    _BARE = f"replace({_BARE}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"


@query(
    "a8_html_to_blocks",
    rf"""WITH cut AS (SELECT page_id, string_split(regexp_replace({_DROPPED}, '<(h[1-6]|p|li|pre|table)\b([^>]*>)', chr(2) || '<\1\2', 'g'), chr(2))[2:] AS parts FROM pages),
b AS (SELECT page_id, unnest(parts) AS raw, CAST(unnest(range(len(parts))) AS INTEGER) AS pos FROM cut), t AS (SELECT page_id, pos, lower(regexp_extract(raw, '^<([a-zA-Z0-9]+)', 1)) AS tag, {_BARE} AS content FROM b)
SELECT page_id, pos, CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN 'heading' ELSE CASE tag WHEN 'p' THEN 'text' WHEN 'li' THEN 'list_item' WHEN 'pre' THEN 'code' ELSE 'table' END END AS type, content, CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN CAST(substr(tag, 2, 1) AS INTEGER) END AS heading_level
  FROM t WHERE content <> ''""",
)
def html_to_blocks(spark, sf_dir):
    return D.html_blocks(tables.table(spark, sf_dir, "pages"))


@query("a13_validate_curriculum", statement("SELECT example_id, error FROM (SELECT example_id, unnest([CASE WHEN trim(q) = '' THEN 'blank question' END, CASE WHEN trim(answer) = '' THEN 'blank answer' END, CASE WHEN competency IS NULL THEN 'no competency' END]) AS error FROM (SELECT *, CASE WHEN turn % 4 = 0 THEN '' ELSE question END AS q FROM examples)) WHERE error IS NOT NULL", "examples"))
def validate_curriculum(spark, sf_dir):
    rows = tables.examples(spark, sf_dir).withColumn("q", F.when(F.col("turn") % 4 == 0, "").otherwise(F.col("question")))
    errors = F.array(F.when(F.trim("q") == "", "blank question"), F.when(F.trim("answer") == "", "blank answer"), F.when(F.col("competency").isNull(), "no competency"))
    return rows.select("example_id", F.explode(F.array_compact(errors)).alias("error"))


_GIVEN = """given AS (SELECT s.*, source, 'text' AS source_type, CAST(s.doc_id AS VARCHAR) AS document_id, CASE WHEN s.doc_id % 5 = 0 THEN ['a', 'b c'] ELSE [] END AS tags, CASE WHEN chunk_pos % 3 = 0 THEN 'seen' END AS notes, CASE WHEN chunk_pos % 4 = 1 THEN 'top' END AS hint,
  CASE WHEN s.doc_id % 4 = 0 THEN CAST(chunk_pos AS VARCHAR) END AS custom, CASE WHEN chunk_pos % 2 = 0 THEN 'TM 9-' || s.doc_id % 9 END AS tm, CASE WHEN s.doc_id % 7 > 0 THEN start_page END AS page_start, CASE WHEN s.doc_id % 7 > 0 THEN end_page END AS page_end
  FROM scored s JOIN (SELECT doc_id, source FROM documents) d ON s.doc_id = d.doc_id)"""


def _given(final: str) -> str:
    return scored_sql(f", {_GIVEN}\n{final}")


def _record(spark, sf_dir):
    """Scored chunks with what users gave and enrichment found for some; some have no
    pages."""
    d, pos = F.col("doc_id"), F.col("chunk_pos")
    paged = lambda c: F.when(d % 7 > 0, F.col(c))
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = C.quality(tables.chunks(spark, sf_dir)).join(docs, "doc_id")
    return D.export_record(rows.withColumns({
        "source_type": F.lit("text"), "tags": F.when(d % 5 == 0, F.array(F.lit("a"), F.lit("b c"))), "notes": F.when(pos % 3 == 0, "seen"), "hierarchy_hint": F.when(pos % 4 == 1, "top"),
        "custom": F.when(d % 4 == 0, F.create_map(F.lit("k"), pos.cast("string"))), "fields": F.when(pos % 2 == 0, F.create_map(F.lit("tm_number"), F.concat(F.lit("TM 9-"), d % 9))),
        "start_page": paged("start_page"), "end_page": paged("end_page"),
    }))


def _flat_sql(pairs: dict[str, str]) -> str:
    """Entries 'key=value' in the order of their keys; values that are null are out."""
    return "array_to_string(list_filter([" + ", ".join(f"'{k}=' || {v}" for k, v in sorted(pairs.items())) + "], lambda x: x IS NOT NULL), chr(10))"


def _entries(column):
    """A map as 'key=value' lines in the order of its keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat_ws("=", e["key"], e["value"])), "\n")


_USER = {"hierarchy_hint": "hint", "notes": "notes", "custom_k": "custom"}
_TAGS = "nullif(array_to_string(tags, '; '), '')"
_ABOUT = {"source": "source", "source_type": "source_type", "document_id": "document_id", "hierarchy_path": "hierarchy_path", "quality_score": "CAST(overall AS VARCHAR)", "token_count": "CAST(token_count AS VARCHAR)"}
_PAGES = {"page_start": "CAST(page_start AS VARCHAR)", "page_end": "CAST(page_end AS VARCHAR)"}


@query(
    "a14_export_record",
    _given(
        "SELECT '1.1' AS schema_version, chunk_id AS id, content, token_count, hierarchy_path, overall AS quality_score, source, source_type, document_id, page_start, page_end, coalesce('tm_number=' || tm, '') AS enrichment_fields, "
        f"array_to_string(tags, ',') AS tags, {_flat_sql(_USER)} AS user_metadata, {_flat_sql({'block_count': 'block_count', 'last_type': 'last_type'})} AS system_metadata FROM given"
    ),
)
def export_record(spark, sf_dir):
    maps = {c: _entries(c) for c in ("enrichment_fields", "user_metadata", "system_metadata")}
    return _record(spark, sf_dir).withColumns({**maps, "tags": F.array_join("tags", ",")})


def _written(df, kind: str, **options):
    path = shared_folder(df.sparkSession, "sink")
    df.write.format(kind).options(**options).save(path)
    return path


_LINE = {"source": "source", "source_type": "source_type", "page": _PAGES["page_start"], "page_end": _PAGES["page_end"], "hierarchy_path": "hierarchy_path", "quality_score": _ABOUT["quality_score"], "token_count": _ABOUT["token_count"]}


@query("a15_sink_jsonl", _given(f"SELECT chunk_id AS id, content AS text, {_flat_sql({**_LINE, **_USER, 'tags': _TAGS})} AS metadata FROM given"))
def sink_jsonl(spark, sf_dir):
    rows = D.jsonl_record(_record(spark, sf_dir))
    return spark.read.schema(rows.schema).json(_written(rows, "json")).withColumn("metadata", _entries("metadata"))


@query(
    "a16_sink_json_nested",
    _given("SELECT document_id AS id, '1.1' AS version, source, source_type, 'tables' AS loader, 'sections' AS chunker, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, string_agg(chunk_id, ',' ORDER BY page_start NULLS FIRST, chunk_id) AS ids, count(notes) AS notes FROM given GROUP BY document_id, source, source_type"),
)
def sink_json_nested(spark, sf_dir):
    rows = D.nested_documents(_record(spark, sf_dir))
    back = spark.read.schema(rows.schema).json(_written(rows, "json"))
    total = F.aggregate("chunks", F.lit(0).cast("bigint"), lambda a, x: a + x["token_count"])
    noted = F.size(F.filter("chunks", lambda x: x["user_metadata"]["notes"].isNotNull())).cast("bigint")
    return back.select(
        "id", "version", "source", "source_type", "processing.loader", "processing.chunker", F.size("chunks").cast("bigint").alias("chunks"), total.alias("tokens"),
        F.array_join(F.transform("chunks", lambda x: x["id"]), ",").alias("ids"), noted.alias("notes"),
    )


@query(
    "a17_sink_csv",
    _given("SELECT chunk_id, source AS document, content, token_count, floor(round(overall * 1000000) / 1000 + 0.5) / 1000 AS quality_score, page_start, page_end, hierarchy_path, array_to_string(tags, '; ') AS tags, coalesce(notes, '') AS notes FROM given"),
)
def sink_csv(spark, sf_dir):
    rows = D.csv_rows(_record(spark, sf_dir))
    form = {"header": "true", "quoteAll": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "nullValue": "\\N", "emptyValue": ""}
    return spark.read.schema(rows.schema).options(**form, multiLine="true").csv(_written(rows, "csv", **form))


@query("a18_to_chromadb", _given(f"SELECT chunk_id AS id, content AS document, {_flat_sql({**_ABOUT, **_PAGES, 'enrichment_tm_number': 'tm', 'tags': _TAGS})} AS metadata FROM given"))
def to_chromadb(spark, sf_dir):
    rows = D.to_chromadb(_record(spark, sf_dir))
    return rows.withColumn("metadata", _entries(F.from_json("metadata", "map<string,string>")))


@query(
    "a19_to_qdrant",
    _given(
        f"SELECT chunk_id AS id, content, {_flat_sql(_ABOUT)} AS about, page_start, page_end, coalesce('tm_number=' || tm, '') AS enrichment, {_flat_sql(_USER)} AS user_metadata, array_to_string(tags, ',') AS tags, true AS keeps_nulls FROM given"
    ),
)
def to_qdrant(spark, sf_dir):
    rows = D.to_qdrant(_record(spark, sf_dir))
    form = "content string, source string, source_type string, document_id string, hierarchy_path string, quality_score double, token_count bigint, page_start int, page_end int, enrichment map<string,string>, user_metadata map<string,string>, tags array<string>"
    p = rows.select("id", F.contains("payload", F.lit('"page_start":')).alias("keeps_nulls"), F.from_json("payload", form).alias("p")).select("id", "keeps_nulls", "p.*")
    about = F.create_map(*[x for c in sorted(_ABOUT) for x in (F.lit(c), F.col(c).cast("string"))])
    return p.select("id", "content", _entries(about).alias("about"), "page_start", "page_end", _entries("enrichment").alias("enrichment"), _entries("user_metadata").alias("user_metadata"), F.array_join("tags", ",").alias("tags"), "keeps_nulls")


_CAMEL = {
    "content": "content", "chunkId": "chunk_id", "source": "source", "sourceType": "source_type", "documentId": "document_id", "hierarchyPath": "hierarchy_path", "qualityScore": _ABOUT["quality_score"],
    "tokenCount": _ABOUT["token_count"], "pageStart": f"coalesce({_PAGES['page_start']}, '')", "pageEnd": f"coalesce({_PAGES['page_end']}, '')", "enrichment_tm_number": "tm",
}


@query("a20_to_weaviate", _given(f"SELECT chunk_id AS id, 'Chunk' AS class, {_flat_sql(_CAMEL)} AS properties FROM given"))
def to_weaviate(spark, sf_dir):
    rows = D.to_weaviate(_record(spark, sf_dir))
    held = F.transform_values(F.from_json("properties", "map<string,string>"), lambda k, v: F.coalesce(v, F.lit("")))
    return rows.select("id", "class", _entries(held).alias("properties"))


@query("a21_to_pinecone", _given(f"SELECT chunk_id AS id, {_flat_sql({**_ABOUT, **_PAGES, 'content': 'content', 'enrichment_tm_number': 'tm'})} AS metadata, array_to_string(tags, ',') AS tags FROM given"))
def to_pinecone(spark, sf_dir):
    rows = D.to_pinecone(_record(spark, sf_dir))
    return rows.select("id", _entries(F.from_json("metadata", "map<string,string>")).alias("metadata"), F.array_join(F.from_json("tags", "array<string>"), ",").alias("tags"))


@query("a22_export_training_split", statement("SELECT question AS instruction, answer AS output, CASE WHEN is_test_set THEN 'test' ELSE 'train' END AS split FROM examples", "examples"))
def export_training_split(spark, sf_dir):
    split = F.when(F.col("is_test_set"), "test").otherwise("train")
    rows = tables.examples(spark, sf_dir).select(F.col("question").alias("instruction"), F.col("answer").alias("output"), split.alias("split"))
    path = shared_folder(spark, "split")
    rows.write.partitionBy("split").json(path)
    return spark.read.schema("instruction string, output string, split string").json(path)


@query("a23_export_signals", statement("SELECT signal_id, signal_type, query FROM signals", "signals"))
def export_signals(spark, sf_dir):
    rows = tables.signals(spark, sf_dir).select("signal_id", "signal_type", "query")
    return spark.read.schema(rows.schema).json(_written(rows, "json"))


@query("a23_export_signals_stream", statement("SELECT signal_id, signal_type, query FROM signals", "signals"))
def export_signals_stream(spark, sf_dir):
    """As a stream, each batch written once."""
    return exported(tables.signals(spark, sf_dir, True).select("signal_id", "signal_type", "query"), "signals-export")


@query("a10_read_training_jsonl", statement("SELECT question AS instruction, answer AS output FROM examples WHERE turn % 4 <> 0", "examples"))
def read_training_jsonl(spark, sf_dir):
    q = F.when(F.col("turn") % 4 == 0, "").otherwise(F.col("question"))
    rows = tables.examples(spark, sf_dir).select(q.alias("instruction"), F.col("answer").alias("output"))
    return readers.read_jsonl(spark, _written(rows, "json"), "instruction string, output string", ["instruction", "output"])[0]


@query("a11_read_eval_cases", statement("SELECT example_id, competency FROM examples WHERE turn % 4 <> 0", "examples"))
def read_eval_cases(spark, sf_dir):
    case = F.when(F.col("turn") % 4 != 0, F.col("example_id"))
    rows = tables.examples(spark, sf_dir).select(case.alias("example_id"), "competency")
    return readers.read_jsonl(spark, _written(rows, "json"), "example_id string, competency bigint", ["example_id", "competency"])[0]


@query(
    "a12_validate_jsonl",
    statement(
        "SELECT reason, count(*) AS n, (SELECT count(*) FROM examples) AS lines FROM (SELECT CASE CAST(turn % 4 AS INTEGER) WHEN 0 THEN 'not an object' ELSE 'missing: output' END AS reason FROM examples WHERE turn % 8 IN (0, 2, 4)) GROUP BY reason",
        "examples",
    ),
)
def validate_jsonl(spark, sf_dir):
    """Lines that are no JSON, and those that lack a field, with their numbers."""
    good = F.to_json(F.struct(F.col("question").alias("instruction"), F.col("answer").alias("output")))
    line = F.when(F.col("turn") % 4 == 0, "{broken").when(F.col("turn") % 8 == 2, F.to_json(F.struct(F.col("question").alias("instruction")))).otherwise(good)
    lines = readers.numbered_lines(spark, _written(tables.examples(spark, sf_dir).select(line.alias("value")), "text"))
    bad = readers.validate_jsonl(lines, ["instruction", "output"]).groupBy("reason").agg(F.count("*").alias("n"))
    total = lines.groupBy("file").agg(F.max("line").alias("n")).agg(F.sum("n").alias("lines"))
    return bad.join(F.broadcast(total))


@query("a1_scan_files", "SELECT 'txt' AS extension, 'text' AS format, NULL AS rejected, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents UNION ALL SELECT 'parquet', NULL, 'unknown extension', NULL")
def scan_files(spark, sf_dir):
    """Documents as text files, and the table's own files."""
    texts = _written(tables.table(spark, sf_dir, "documents").select("text"), "text", maxRecordsPerFile=1000)
    found = readers.scan_files(spark, texts).unionByName(readers.scan_files(spark, f"{sf_dir}/documents.parquet"))
    bytes_ = F.sum(F.when(F.col("rejected").isNull(), F.col("length"))).alias("bytes")
    return found.groupBy("extension", "format", "rejected").agg(bytes_)


_COUNT = lambda p: f"length(text) - length(regexp_replace(text, '{p}', '', 'g'))"
_SHARE = lambda c: f"CASE WHEN n > 0 THEN round({c} / n, 6) ELSE 0 END AS {c}_share"
_L, _ND, _LU = r"\p{L}", r"\p{Nd}", r"\p{Lu}"
_CHARS = (
    f"SELECT *, {', '.join(map(_SHARE, ('letters', 'digits', 'punctuation', 'blanks', 'special')))}, CASE WHEN letters > 0 THEN round(upper / letters, 6) ELSE 0 END AS upper_share FROM (SELECT *, greatest(n - letters - digits - blanks - punctuation, 0) AS special FROM "
    rf"(SELECT doc_id, length(text) AS n, {_COUNT(_L)} AS letters, {_COUNT(_ND)} AS digits, {_COUNT(D.BLANKS)} AS blanks, {_COUNT(D.PUNCTUATION)} AS punctuation, {_COUNT(_LU)} AS upper FROM documents))"
)


@query("i1_char_features", _CHARS)
def char_features(spark, sf_dir):
    return D.char_features(tables.table(spark, sf_dir, "documents"))


_BOXES = """, boxes AS (SELECT doc_id, pos, page, content, type, 72 + CASE WHEN doc_id % 2 = 1 AND pos % 2 = 1 THEN 270.0::DOUBLE ELSE 0 END AS x1,
  CASE WHEN doc_id % 2 = 1 AND pos % 2 = 0 THEN 270.0::DOUBLE ELSE 540 END AS x2, y1, y1 + 50 AS y2, 612.0::DOUBLE AS page_width, 720.0::DOUBLE + page % 3 AS page_height FROM decorated)"""


def _boxes(spark, sf_dir, docs=None):
    """Blocks with boxes; documents of odd ids are set in two columns."""
    odd, pos = F.col("doc_id") % 2 == 1, F.col("pos") % 2
    x1, x2 = 72 + F.when(odd & (pos == 1), 270.0).otherwise(0.0), F.when(odd & (pos == 0), 270.0).otherwise(540.0)
    rows = tables.decorated_blocks(spark, sf_dir, docs)
    return rows.select("doc_id", "pos", "page", "content", "type", x1.alias("x1"), x2.alias("x2"), "bbox.y1", "bbox.y2", F.lit(612.0).alias("page_width"), (F.lit(720.0) + F.col("page") % 3).alias("page_height"))


@query(
    "i2_repetition_features",
    statement(
        f"""{_BOXES}, t AS (SELECT *, {STRIP.format('content')} AS c, row(y1, pos) AS o FROM boxes),
p AS (SELECT doc_id, page, arg_min(c, o) FILTER (y1 < 0.08::DOUBLE * page_height) AS top, arg_max(c, o) FILTER (y2 > (1 - 0.08::DOUBLE) * page_height) AS bottom, arg_min(c, o) FILTER (y1 >= 0.08::DOUBLE * page_height) AS first FROM t GROUP BY ALL),
n AS (SELECT *, TRY_CAST(nullif(regexp_extract(bottom, '[0-9]+', 0), '') AS DECIMAL(38,0)) AS number, count(*) OVER (PARTITION BY doc_id, top) AS st, count(*) OVER (PARTITION BY doc_id, bottom) AS sb FROM p),
f AS (SELECT *, number = 1 + last_value(number IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS follows,
  count(top) OVER w AS ti, count(bottom) OVER w AS bi FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
hits AS (SELECT doc_id, count(DISTINCT i) AS hits FROM (SELECT doc_id, ti AS i FROM f WHERE top IS NOT NULL AND st > 1 UNION ALL SELECT doc_id, bi FROM f WHERE regexp_matches(bottom, '^[0-9\\s.-]+$')) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS pages, count(top) >= 2 AND max(st) FILTER (top IS NOT NULL) >= 0.5 * count(top) AS h, count(bottom) >= 2 AND max(sb) FILTER (bottom IS NOT NULL) >= 0.5 * count(bottom) AS l,
  count(number) >= 2 AND count(*) FILTER (follows) >= 0.5 * count(number) AS k, CASE WHEN count(first) > 0 THEN count(DISTINCT first) / count(first) ELSE 0 END AS d FROM f GROUP BY doc_id)
SELECT g.doc_id, pages, pages > 1 AND coalesce(h, false) AS has_headers, pages > 1 AND coalesce(l, false) AS has_footers, pages > 1 AND k AS has_page_numbers,
  round(CASE WHEN pages > 1 THEN coalesce(hits, 0) / pages ELSE 0 END, 6) AS repetition_ratio, round(CASE WHEN pages > 1 THEN d ELSE 1 END, 6) AS first_line_diversity FROM g LEFT JOIN hits ON g.doc_id = hits.doc_id""",
        "decorated",
    ),
)
def repetition_features(spark, sf_dir):
    return D.repetition_features(_boxes(spark, sf_dir))


_PER = ", ".join(f"round(count(*) FILTER (type = '{k}') / count(DISTINCT page), 6) AS {k}s" for k in ("heading", "table", "image", "list", "code"))


@query(
    "i3_rhythm_features",
    statement(
        f"""SELECT doc_id, count(DISTINCT page) AS pages, {_PER}, count(heading_level) > 0 AS has_outline, CAST(coalesce(max(heading_level), 0) AS BIGINT) AS outline_depth,
  count(DISTINCT heading_level) AS heading_sizes, CAST(sum(len(regexp_extract_all(content, 'https?://'))) AS BIGINT) AS links FROM outline GROUP BY doc_id""",
        "outline",
    ),
)
def rhythm_features(spark, sf_dir):
    return D.rhythm_features(tables.outline_blocks(spark, sf_dir))


@query(
    "i4_font_features",
    statement(
        f""", s AS (SELECT doc_id, content, 8.0::DOUBLE + length(content) % 7 AS size, 'f' || pos % 3 AS font, type IN ('heading', 'header') AS bold, pos % 9 = 0 AS italic, pos % 13 = 9 AS mono FROM decorated)
SELECT doc_id, count(*) AS spans, count(DISTINCT font) AS font_count, min(size) AS size_min, max(size) AS size_max, round(avg(size), 6) AS size_mean, round(stddev_pop(size), 6) AS size_std, median(size) AS size_median,
  count(DISTINCT round(size, 1)) AS distinct_sizes, round(count(*) FILTER (bold) / count(*), 6) AS bold_ratio, round(count(*) FILTER (italic) / count(*), 6) AS italic_ratio, round(count(*) FILTER (mono) / count(*), 6) AS mono_ratio
  FROM s WHERE {STRIP.format('content')} <> '' GROUP BY doc_id""",
        "decorated",
    ),
)
def font_features(spark, sf_dir, docs=None):
    """Blocks as spans, with sizes and styles by their lengths and places."""
    pos = F.col("pos")
    rows = tables.decorated_blocks(spark, sf_dir, docs)
    return D.font_features(rows.select(
        "doc_id", "content", (F.lit(8.0) + F.length("content") % 7).alias("size"), F.concat(F.lit("f"), pos % 3).alias("font"),
        F.col("type").isin("heading", "header").alias("bold"), (pos % 9 == 0).alias("italic"), (pos % 13 == 9).alias("mono"),
    ))


_EVEN = "round(CASE WHEN avg({0}) > 0 THEN greatest(0, 1 - stddev_pop({0}) / avg({0})) ELSE 1 END, 6)"


@query(
    "i4_font_layout_features",
    statement(
        f"""{_BOXES}, p AS (SELECT doc_id, page, page_width, page_height, greatest(0, min(x1)) AS ml, greatest(0, min(y1)) AS mt, greatest(0, page_width - max(x2)) AS mr, greatest(0, page_height - max(y2)) AS mb,
  count(*) AS n, count(*) FILTER ((x1 + x2) / 2 < 0.3::DOUBLE * page_width) AS l, count(*) FILTER ((x1 + x2) / 2 > 0.7::DOUBLE * page_width) AS r FROM boxes GROUP BY doc_id, page, page_width, page_height),
q AS (SELECT *, CASE WHEN l > 0 AND r > 0 AND n - l - r <= 0.2::DOUBLE * n THEN 2 ELSE 1 END AS columns, page_width - ml - mr AS tw, page_height - mt - mb AS th FROM p)
SELECT doc_id, median(page_width) AS page_width, median(page_height) AS page_height, {_EVEN.format('page_width')} AS width_consistency, {_EVEN.format('page_height')} AS height_consistency,
  median(ml) AS margin_left, median(mr) AS margin_right, median(mt) AS margin_top, median(mb) AS margin_bottom,
  round(avg(CASE WHEN page_width * page_height > 0 AND tw > 0 AND th > 0 THEN tw * th / (page_width * page_height) ELSE 0 END), 6) AS text_area_ratio,
  CAST(CASE WHEN count(*) FILTER (columns = 2) > count(*) FILTER (columns = 1) THEN 2 WHEN count(*) FILTER (columns = 2) < count(*) FILTER (columns = 1) THEN 1 ELSE arg_min(columns, page) END AS BIGINT) AS estimated_columns
  FROM q GROUP BY doc_id""",
        "decorated",
    ),
)
def font_layout_features(spark, sf_dir):
    return D.layout_features(_boxes(spark, sf_dir))


@query(
    "i5_sample_pages",
    statement(
        ", p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS page, count(*) OVER (PARTITION BY doc_id) AS n FROM outline), s AS (SELECT *, greatest(1, (n - 5) // 45) AS step FROM p)\n"
        "SELECT doc_id, page FROM s WHERE n <= 50 OR page <= 3 OR page > n - 2 OR (page >= 4 AND (page - 4) % step = 0 AND (page - 4) / step < 45)",
        "outline",
    ),
)
def sample_pages(spark, sf_dir):
    """Blocks as pages, as documents are short."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id")
    pages = tables.outline_blocks(spark, sf_dir).select("doc_id", F.row_number().over(w.orderBy("pos")).alias("page"), F.count("*").over(w).alias("n"))
    return D.sampled_pages(pages).select("doc_id", "page")


def _fingerprints(spark, sf_dir, docs=None):
    """Vectors of all documents, or of ``docs`` alone."""
    docs = tables.table(spark, sf_dir, "documents") if docs is None else docs
    blocks, boxes = tables.blocks(spark, sf_dir, docs), _boxes(spark, sf_dir, docs)
    groups = {
        "byte": D.byte_features(docs, blocks), "font": font_features(spark, sf_dir, docs), "layout": D.layout_features(boxes), "char": D.char_features(docs), "rep": D.repetition_features(boxes),
        "rhythm": D.rhythm_features(tables.outline_blocks(spark, sf_dir, docs)),
    }
    return stored(D.fingerprints(groups, docs), "fingerprints")


_BYTES = statement(
    "SELECT d.doc_id, strlen(text) AS file_size, 0 AS pdf_version, n AS object_count, 0 AS stream_count, source IS NOT NULL AS has_metadata, 0 AS has_xmp_metadata, pages AS page_count, 0 AS encrypted, 0 AS has_acroform FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, max(page) AS pages FROM typed GROUP BY doc_id) b ON d.doc_id = b.doc_id",
    "typed",
)
_GROUPS = {"byte": _BYTES, "font": SQL["i4_font_features"], "layout": SQL["i4_font_layout_features"], "char": _CHARS, "rep": SQL["i2_repetition_features"], "rhythm": SQL["i3_rhythm_features"]}
_VECTOR = "array_to_string([" + ", ".join(f"CAST(round(coalesce(CAST({g}.{c} AS DOUBLE), 0) * 1000) AS BIGINT)" for g, cs in D.FEATURES.items() for c in cs) + "], ',')"


@query("i6_fingerprint_vector", f"SELECT d.doc_id, {_VECTOR} AS features FROM documents d " + " ".join(f"LEFT JOIN ({q}) {g} ON d.doc_id = {g}.doc_id" for g, q in _GROUPS.items()))
def fingerprint_vector(spark, sf_dir):
    """All features in order, in whole thousandths."""
    whole = F.transform("features", lambda x: F.round(x * 1000).cast("bigint").cast("string"))
    return _fingerprints(spark, sf_dir).select("doc_id", F.array_join(whole, ",").alias("features"))


def _labels(spark, sf_dir):
    """Quality and toxicity make four classes."""
    return tables.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("label"))


def _labelled(spark, sf_dir):
    """Vectors of all documents, and those with labels."""
    rows = _fingerprints(spark, sf_dir)
    return rows, rows.join(_labels(spark, sf_dir), "doc_id")


def _labelled_only(spark, sf_dir):
    """Vectors of the documents with labels, the only ones that are made."""
    labels = _labels(spark, sf_dir)
    docs = tables.table(spark, sf_dir, "documents").join(small(labels.select("doc_id").distinct(), BROADCAST_IDS), "doc_id", "left_semi")
    return _fingerprints(spark, sf_dir, stored(docs, "labelled-documents")).join(labels, "doc_id")


@query("i7_synthetic_corpus")
def synthetic_corpus(spark, sf_dir):
    """Feature rows drawn around the mean of each label, with ratios clipped."""
    rows = D.char_features(tables.table(spark, sf_dir, "documents")).join(tables.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    means = rows.groupBy("label").agg(F.avg("upper_share").alias("m"), F.coalesce(F.stddev_pop("upper_share"), F.lit(0.0)).alias("s"))
    draw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("m") + F.col("s") * F.randn(42)))
    return F.broadcast(means).join(spark.range(40), F.lit(True)).select("label", "id", draw.alias("upper_share"))


@query("i9_predict_type")
def predict_type(spark, sf_dir):
    """Every document, by a model of the labelled ones."""
    rows, labelled = _labelled(spark, sf_dir)
    return D.predicted(D.fitted(labelled), rows)


@query("i10_feature_importance")
def feature_importance(spark, sf_dir):
    """The features of the model in the order of their weight."""
    model = D.fitted(_labelled_only(spark, sf_dir))
    ranked = sorted(zip(D.NAMES, map(float, model.featureImportances.toArray())), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(n, w, k) for k, (n, w) in enumerate(ranked, 1)], "feature string, importance double, place int")


@query("i11_cross_validate")
def cross_validate(spark, sf_dir):
    return D.cross_validated(_labelled_only(spark, sf_dir))


@query("i11_fold_report")
def fold_report(spark, sf_dir):
    return D.fold_report(cross_validate(spark, sf_dir))


@query("i12_unknown_queue")
def unknown_queue(spark, sf_dir):
    rows, labelled = _labelled(spark, sf_dir)
    return D.unknown_queue(D.predicted(D.fitted(labelled), rows))


_LOGGED = "SELECT doc_id, ['bad', 'good', 'odd', NULL][CAST(CASE WHEN doc_id % 11 = 0 THEN 3 WHEN doc_id % 13 = 0 THEN 4 ELSE quality + 1 END AS INTEGER)] AS label FROM labels"


def _label_lines(spark, sf_dir):
    """The folder of a log of labels; some lines are cut, some name no class."""
    d = F.col("doc_id")
    name = F.when(d % 11 == 0, "odd").otherwise(F.when(F.col("quality") == 1, "good").otherwise("bad"))
    line = F.to_json(F.struct("doc_id", name.alias("label")))
    cut = F.when((d % 11 != 0) & (d % 13 == 0), F.substring(line, 1, 9)).otherwise(line)
    return _written(tables.table(spark, sf_dir, "labels").select(cut.alias("value")), "text")


def _label_log(spark, sf_dir):
    return D.manual_labels(spark.read.text(_label_lines(spark, sf_dir)), ["good", "bad"])


@query("i13_manual_labels", f"SELECT label, count(*) AS n FROM ({_LOGGED}) WHERE label IN ('good', 'bad') GROUP BY label")
def manual_labels(spark, sf_dir):
    return _label_log(spark, sf_dir)[0].groupBy("label").agg(F.count("*").alias("n"))


@query("i13_manual_labels_stream", f"SELECT label, count(*) AS n FROM ({_LOGGED}) WHERE label IN ('good', 'bad') GROUP BY label")
def manual_labels_stream(spark, sf_dir):
    """The log as a stream that is appended to the table of labels."""
    lines = spark.readStream.schema("value string").text(_label_lines(spark, sf_dir))
    return exported(D.manual_labels(lines, ["good", "bad"])[0], "manual-labels").groupBy("label").agg(F.count("*").alias("n"))


@query("i13_rejected_labels", f"SELECT CASE WHEN label = 'odd' THEN 'unknown class' ELSE 'corrupt' END AS reason, count(*) AS n FROM ({_LOGGED}) WHERE label IS NULL OR label = 'odd' GROUP BY 1")
def rejected_labels(spark, sf_dir):
    return _label_log(spark, sf_dir)[1].groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "i14_retrain_plan",
    """WITH m AS (SELECT quality AS label, doc_id AS seq FROM labels), t AS (SELECT max(seq) AS last FROM m WHERE seq % 10 = 0),
c AS (SELECT CAST(doc_id % 2 AS INTEGER) AS label, 'synthetic' AS origin, NULL AS seq FROM documents UNION ALL SELECT label, 'manual', seq FROM m),
r AS (SELECT label, count(*) FILTER (origin = 'synthetic') AS synthetic, count(*) FILTER (origin = 'manual') AS manual, count(*) FILTER (origin = 'manual' AND (last IS NULL OR seq > last)) AS since FROM c, t GROUP BY label)
SELECT *, CAST(sum(since) OVER () AS BIGINT) AS new_labels, sum(since) OVER () >= 5 OR (SELECT last FROM t) IS NULL AS due FROM r""",
)
def retrain_plan(spark, sf_dir):
    """Labels as manual ones; a model was trained at every tenth id."""
    manual = tables.table(spark, sf_dir, "labels").select(F.col("quality").alias("label"), F.col("doc_id").alias("seq"))
    synthetic = tables.table(spark, sf_dir, "documents").select((F.col("doc_id") % 2).cast("int").alias("label"))
    return D.retrain_plan(synthetic, manual, manual.where("seq % 10 = 0").select(F.col("seq").alias("trained_at")))


@query(
    "i15_upgrade_candidates",
    statement(
        f"""{_BOXES}, p AS (SELECT doc_id, page, count(*) FILTER (type = 'table') AS t, sum(length({STRIP.format('content')})) AS c FROM boxes GROUP BY ALL), s AS (SELECT doc_id, sum(t) AS t, min(c) FILTER (page <= 5) AS c FROM p GROUP BY doc_id),
x AS (SELECT doc_id, count(DISTINCT floor(x1 / 50 + 0.5)) AS n FROM boxes WHERE page <= 5 GROUP BY doc_id)
SELECT doc_id, reason FROM (SELECT s.doc_id, unnest([CASE WHEN t >= 5 THEN 'tables' END, CASE WHEN c < 100 THEN 'scanned' END, CASE WHEN n >= 2 THEN 'columns' END]) AS reason FROM s LEFT JOIN x ON s.doc_id = x.doc_id) WHERE reason IS NOT NULL""",
        "decorated",
    ),
)
def upgrade_candidates(spark, sf_dir):
    return D.upgrade_candidates(_boxes(spark, sf_dir))


@query("u1_register_strategy", statement("SELECT chunk_id, token_count FROM chunks", "chunks"))
def register(spark, sf_dir):
    """A chunker taken by name."""
    from ..operators.sections import section_chunks

    register_strategy("chunker", "sections", section_chunks)
    register_strategy("chunker", "fixed", C.fixed_chunks)
    return strategy("chunker", "sections")(tables.outline_blocks(spark, sf_dir)).select("chunk_id", "token_count")


@query("u1_custom_scorer", scored_sql("SELECT chunk_id, round(0.5 * sentences + 0.5 * CASE WHEN regexp_matches(content, '[0-9]') THEN 0.0 ELSE 1.0 END, 6) AS overall FROM scored"))
def custom_scorer(spark, sf_dir):
    """A scorer of one's own beside one that is there, each by its name."""
    register_strategy("scorer", "no_digits", lambda: F.when(F.col("content").rlike("[0-9]"), 0.0).otherwise(1.0))
    return C.quality(tables.chunks(spark, sf_dir), {"sentences": 0.5, "no_digits": 0.5}).select("chunk_id", "overall")


@query("a2_read_text_docs", "SELECT CAST(sum(length(text) + 1) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS warnings FROM documents")
def read_text_docs(spark, sf_dir):
    """Documents written as text files, found again and decoded."""
    # Files of a bounded number of documents; larger ones are read by lines.
    path = _written(tables.table(spark, sf_dir, "documents").select("text"), "text", maxRecordsPerFile=1000)
    texts = readers.read_texts(readers.scan_files(spark, path))
    return texts.agg(F.sum(F.length("text")).alias("chars"), F.count("warning").alias("warnings"))


@query("a9_project_to_tables", statement("SELECT doc_id, chunk_id AS id, token_count FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, chunk_id, token_count FROM chunks)", "chunks"))
def project_to_tables(spark, sf_dir):
    """A project for each document, written as JSON, to its table of chunks."""
    chunks = tables.chunks(spark, sf_dir)
    item = F.struct(F.col("chunk_id").alias("id"), F.array().cast("array<string>").alias("block_ids"), "content", "token_count")
    docs = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("chunks"))
    doc = F.struct(F.col("doc_id").cast("string").alias("id"), F.lit("corpus").alias("source_path"), "chunks")
    projects = docs.select(F.concat(F.lit("p"), "doc_id").alias("id"), F.array(doc).alias("documents"))
    # One project a line; a file of its own takes the same reader's multiLine.
    whole = spark.read.schema(readers.PROJECT).json(_written(projects, "json"))
    return readers.project_tables(whole)["chunks"].select("doc_id", "id", "token_count")


@query("i8_train_classifier")
def train_classifier(spark, sf_dir):
    """Boosted trees: what models of two thirds of the labelled documents say of the
    others."""
    found = D.cross_validated(_labelled_only(spark, sf_dir), 3, lambda rows: D.boosted(rows, 6))
    right = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0))
    return found.groupBy("label").agg(F.sum("n").alias("n"), (right / F.sum("n")).alias("accuracy"))


@query("i14_retrain_report")
def retrain_report(spark, sf_dir):
    """The models of the first half of the labels and of all of them."""
    rows = _labelled_only(spark, sf_dir)
    return D.retrain_report(rows, F.col("doc_id") % 2 == 0, shared_folder(spark, "models"))
