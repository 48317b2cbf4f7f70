"""Queries over search, validation, suites and context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..functions.text import strip
from ..operators.retrieval import hashed_terms  # noqa: F401
from ..operators.sections import section_and_page_chunks
from ..sources import tables
from ..sources.shared import small, stored
from .catalog import query
from .sql import STRIP, TOKENS, statement

# Queries: the benchmark's items.
_ASKED = "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
_TERMS = "list_filter(regexp_extract_all(lower({0}), '[a-z]+'), lambda x: length(x) > 1)"


def hits_sql(chunks: str, k: int, prefix: str = "") -> str:
    return f"""{prefix}qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TERMS.format('query')}) AS term FROM asked) GROUP BY ALL),
{prefix}ct AS (SELECT chunk_id, len, term, count(*) AS tf FROM (SELECT chunk_id, len({_TERMS.format('content')}) AS len, unnest({_TERMS.format('content')}) AS term FROM {chunks}) WHERE term IN (SELECT term FROM {prefix}qt) GROUP BY ALL),
{prefix}dfs AS (SELECT term, count(*) AS df FROM {prefix}ct GROUP BY term),
{prefix}raws AS (SELECT query_id, chunk_id, sum(times * tf / len * (ln(((SELECT count(*) FROM {chunks}) + 1) / (df * times + 1)) + 1)) AS raw FROM {prefix}ct JOIN {prefix}dfs USING (term) JOIN {prefix}qt USING (term) GROUP BY ALL),
{prefix}hits AS MATERIALIZED (SELECT query_id, rank, chunk_id, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score, round(raw, 6) AS raw FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, chunk_id) AS rank FROM {prefix}raws WHERE raw > 0) WHERE rank <= {k})"""


def _sql(final: str, chunks: str = "chunks", k: int = 10, more: str = "") -> str:
    return statement(f", {_ASKED}{more}, {hits_sql(chunks, k)}\n{final}", "chunks")


def asked(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "benchmark")
    return rows.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _chunks(spark, sf_dir):
    """The chunks, derived once: they are indexed, and joined with hits."""
    rows = tables.chunks(spark, sf_dir)
    return stored(rows.select("doc_id", "chunk_id", "content", "token_count", "hierarchy_path", "start_page"), "chunks")


@query("e1_keyword_search", _sql("SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM hits"))
def keyword_search(spark, sf_dir):
    return _hits(spark, sf_dir).drop("raw")


def _hits(spark, sf_dir, k: int = 10):
    return R.keyword_search(tables.chunks(spark, sf_dir), asked(spark, sf_dir), k)


_UNIT = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_VECS = f"vecs AS (SELECT vec_id, label, {_UNIT} AS e, greatest(sqrt(list_sum(list_transform({_UNIT}, lambda x: x * x))), 1e-10) AS n FROM embeddings)"
_COS = "list_dot_product(a.e, b.e) / (a.n * b.n)"


def _vectors(spark, sf_dir):
    """All vectors, and those of ids divisible by 20 as queries."""
    v = tables.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def _nearest(where: str) -> str:
    return (
        f"WITH {_VECS}, s AS (SELECT b.vec_id AS query_id, a.vec_id, {_COS} AS score FROM vecs a, vecs b WHERE b.vec_id % 20 = 0 AND {where}) SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM "
        "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 5"
    )


@query("e2_vector_search", _nearest("true"))
def vector_search(spark, sf_dir):
    return R.vector_search(*_vectors(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("e2_search_in_documents", _nearest("a.label % 2 = 0"))
def search_in_documents(spark, sf_dir):
    """Among the vectors of some documents only."""
    v, q = _vectors(spark, sf_dir)
    return R.vector_search(v.where("label % 2 = 0"), q).withColumn("score", F.round("score", 6))


@query("e3_embed")
def embed(spark, sf_dir):
    """By a registered embedder; a model is registered in the same way."""
    return R.embed(tables.chunks(spark, sf_dir), "hashed_terms", 256)


@query("e3_embed_by_model")
def embed_by_model(spark, sf_dir):
    """By a vectorised model that each worker loads once."""
    return R.embed(tables.chunks(spark, sf_dir), "letters", 64)


@query("e4_similar_chunks", f"WITH {_VECS} SELECT b.vec_id AS query_id, a.vec_id, round({_COS}, 6) AS score FROM vecs a, vecs b WHERE b.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND {_COS} >= 0.8 - 1e-12")
def similar_chunks(spark, sf_dir):
    return R.similar_to(*_vectors(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(
    "e5_similarity_pairs",
    f"WITH {_VECS}, c AS (SELECT min(vec_id) AS vec_id, e, any_value(n) AS n, count(*) AS k FROM vecs GROUP BY e) SELECT a.vec_id AS a, b.vec_id AS b, a.k AS n_a, b.k AS n_b, round({_COS}, 5) AS cosine FROM c a, c b WHERE a.vec_id < b.vec_id AND {_COS} >= 0.8 - 1e-9",
)
def similarity_pairs(spark, sf_dir):
    rows = R.similar_pairs(tables.table(spark, sf_dir, "embeddings"))
    return rows.select("a", "b", "n_a", "n_b", F.round("score", 5).alias("cosine"))


_CRITERIA = [("lang", "eq", "en"), ("source", "contains", "SRC1"), ("n_chars", "gt", "500"), ("text", "regex", "the|and"), ("lang", "exists", None)]


@query("e6_metadata_filter", "SELECT doc_id FROM documents WHERE lower(lang) = 'en' AND contains(lower(source), 'src1') AND n_chars > 500 AND regexp_matches(text, '(?i)the|and') AND trim(lang) <> ''")
def metadata_filter(spark, sf_dir):
    return R.metadata_filter(tables.table(spark, sf_dir, "documents"), _CRITERIA).select("doc_id")


_MAPPED = "mapped AS (SELECT doc_id, chunk_id, CASE WHEN chunk_pos % 2 = 0 THEN 'TM 9-' || doc_id % 9 ELSE '' END AS tm, CASE WHEN chunk_pos % 3 > 0 THEN CASE WHEN chunk_pos % 6 = 1 THEN 'none' ELSE CAST(chunk_pos AS VARCHAR) END END AS depth, CASE doc_id % 2 WHEN 0 THEN 'MANUAL' ELSE 'REPORT' END AS doc_type FROM chunks)"


@query("e6_enrichment_filter", statement(f", {_MAPPED}\nSELECT chunk_id FROM mapped WHERE doc_type = 'MANUAL' AND trim(tm) <> '' AND contains(lower(tm), 'tm 9') AND TRY_CAST(depth AS DOUBLE) < 9", "chunks"))
def enrichment_filter(spark, sf_dir):
    """By fields that were extracted and by the type of document; what is no number
    is not less than one."""
    pos = F.col("chunk_pos")
    tm = F.when(pos % 2 == 0, F.concat(F.lit("TM 9-"), F.col("doc_id") % 9)).otherwise("")
    depth = F.when(pos % 3 > 0, F.when(pos % 6 == 1, "none").otherwise(pos.cast("string")))
    fields = F.map_filter(F.create_map(F.lit("tm"), tm, F.lit("depth"), depth), lambda k, v: v.isNotNull())
    rows = tables.chunks(spark, sf_dir).select("chunk_id", fields.alias("fields"), F.when(F.col("doc_id") % 2 == 0, "MANUAL").otherwise("REPORT").alias("doc_type"))
    criteria = [("fields.tm", "exists", None), ("fields.tm", "contains", "tm 9"), ("fields.depth", "lt", "9")]
    return R.metadata_filter(rows.where("doc_type = 'MANUAL'"), criteria).select("chunk_id")


@query("e7_filter_reduction", "SELECT source, round(1 - count(*) FILTER (lang = 'en') / count(*), 3) AS reduction FROM documents GROUP BY source")
def filter_reduction(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").groupBy("source").agg(F.round(1 - F.count_if(F.col("lang") == "en") / F.count("*"), 3).alias("reduction"))


_VALID = """SELECT query_id, chunk_id, validation, floor(round(score * 1e6::DOUBLE) * validation + 0.5::DOUBLE) / 1e6::DOUBLE AS adjusted FROM (SELECT *, (CASE WHEN length(content) >= 200 THEN 1.0 ELSE 0 END + CASE WHEN hierarchy_path <> '' THEN 2.0 ELSE 0 END + CASE WHEN regexp_matches(content, '(?i)the') THEN 1.0 ELSE 0 END)::DOUBLE / 4.0 AS validation
  FROM hits JOIN (SELECT chunk_id, content, hierarchy_path FROM chunks) USING (chunk_id)) WHERE validation >= 0.5"""


def _validated(hits, chunks):
    rows = small(hits).join(chunks.select("chunk_id", "content", "hierarchy_path"), "chunk_id")
    rules = [("length", F.length("content") >= 200, 1.0), ("path", F.col("hierarchy_path") != "", 2.0), ("content", F.col("content").rlike("(?i)the"), 1.0)]
    return R.validate_hits(rows, rules, 0.5)


@query("e8_validate_hits", _sql(_VALID))
def validate_hits(spark, sf_dir):
    return _validated(_hits(spark, sf_dir), tables.chunks(spark, sf_dir)).select("query_id", "chunk_id", "validation", "adjusted")


@query(
    "e9_retrieve",
    _sql(f"SELECT query_id, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM pre) AS filtered, h AS hits, v AS valid FROM (SELECT query_id, count(*) AS h FROM hits GROUP BY query_id) LEFT JOIN (SELECT query_id, count(*) AS v FROM ({_VALID}) GROUP BY query_id) USING (query_id)", "pre", 10, ", pre AS (SELECT * FROM chunks WHERE token_count > 100)").replace("count(*) AS v", "count(*) AS v"),
)
def retrieve(spark, sf_dir):
    """Filter, search and validation, with the counts of each stage."""
    every = _chunks(spark, sf_dir)
    pre = every.where("token_count > 100")
    hits = stored(R.keyword_search(pre, asked(spark, sf_dir)), "hits")
    valid = _validated(hits, pre).groupBy("query_id").agg(F.count("*").alias("valid"))
    sizes = every.agg(F.count("*").alias("chunks"), F.count_if(F.col("token_count") > 100).alias("filtered"))
    per = hits.groupBy("query_id").agg(F.count("*").alias("hits")).join(valid, "query_id", "left")
    return per.join(F.broadcast(sizes)).select("query_id", "chunks", "filtered", "hits", "valid")


_SUITE = "suite AS (SELECT item_id AS query_id, chunk_id, doc_id % 40 = item_id % 40 AS expected FROM benchmark LEFT JOIN chunks ON chunk_pos = 1 AND (doc_id % 40 = item_id % 40 OR doc_id % 40 = (item_id + 1) % 40))"


def _suite(spark, sf_dir):
    """Of each query, how many chunks it expects (the first sections of the documents
    whose ids leave its own remainder), and its hits with what it says of them."""
    firsts = tables.chunks(spark, sf_dir).where("chunk_pos = 1").select("chunk_id", (F.col("doc_id") % 40).alias("k"))
    counts = firsts.groupBy("k").agg(F.count("*").alias("expected"))
    items = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("k"), ((F.col("item_id") + 1) % 40).alias("not_k"))
    sizes = items.join(counts, "k", "left").select("query_id", F.coalesce("expected", F.lit(0)).alias("expected"))
    named = _hits(spark, sf_dir).select("query_id", "chunk_id").join(firsts.withColumnRenamed("k", "own"), "chunk_id").join(items, "query_id")
    said = F.when(F.col("own") == F.col("k"), True).when(F.col("own") == F.col("not_k"), False)
    return sizes, named.select("query_id", "chunk_id", said.alias("expected"))


_RUN = "results AS (SELECT query_id, count(*) FILTER (chunk_id IS NOT NULL AND expected AND NOT got) AS missing, count(*) FILTER (chunk_id IS NOT NULL AND NOT expected AND got) AS wrong FROM (SELECT s.*, h.chunk_id IS NOT NULL AS got FROM suite s LEFT JOIN hits h ON s.query_id = h.query_id AND s.chunk_id = h.chunk_id) GROUP BY query_id)"


@query("e10_run_suite", _sql(f", {_SUITE}, {_RUN}\nSELECT *, missing = 0 AND wrong = 0 AS passed FROM results"))
def run_suite(spark, sf_dir):
    return R.suite_by_rule(*_suite(spark, sf_dir))


@query("e10_suite_report", _sql(f", {_SUITE}, {_RUN}\nSELECT count(*) FILTER (missing = 0 AND wrong = 0) AS passed, count(*) FILTER (missing > 0 OR wrong > 0) AS failed, round(count(*) FILTER (missing = 0 AND wrong = 0) / count(*), 6) AS pass_rate FROM results"))
def suite_report(spark, sf_dir):
    return R.suite_report(run_suite(spark, sf_dir))


_PER = "(SELECT doc_id, c.chunk_id, n FROM chunks c LEFT JOIN (SELECT chunk_id, count(DISTINCT query_id) AS n FROM hits GROUP BY chunk_id) h ON c.chunk_id = h.chunk_id)"


@query("e11_suite_coverage", _sql(f"SELECT doc_id, count(*) AS chunks, count(n) AS retrieved, count(*) FILTER (n >= 3) AS often, round(count(n) / count(*), 6) AS rate FROM {_PER} GROUP BY doc_id"))
def suite_coverage(spark, sf_dir):
    return R.suite_coverage(tables.chunks(spark, sf_dir), _hits(spark, sf_dir))[0]


@query("e11_never_retrieved", _sql(f"SELECT doc_id, chunk_id FROM {_PER} WHERE n IS NULL"))
def never_retrieved(spark, sf_dir):
    return R.suite_coverage(tables.chunks(spark, sf_dir), _hits(spark, sf_dir))[1]


_COMPARED = f"""{_ASKED}, {hits_sql('chunks', 3, 's')}, {hits_sql('page_chunks', 3, 'p')}, per AS (SELECT strategy, query_id, count(*) AS hits, arg_min(chunk_id, rank) AS top, max(raw) AS top_score
  FROM (SELECT 'sections' AS strategy, * FROM shits UNION ALL SELECT 'pages', * FROM phits) GROUP BY ALL)"""


def _compared(spark, sf_dir):
    """Both strategies' chunks are corpora of one index."""
    chunks = section_and_page_chunks(tables.outline_blocks(spark, sf_dir))
    return R.compare_strategies(R.keyword_search(chunks, asked(spark, sf_dir), 3, "strategy"))


@query("e12_strategy_query_compare", statement(f", {_COMPARED}\nSELECT * FROM per", "chunks", "page_chunks"))
def strategy_query_compare(spark, sf_dir):
    return _compared(spark, sf_dir)[0]


@query(
    "e12_strategy_means",
    statement(f", {_COMPARED}, m AS (SELECT strategy, round(sum(CAST(round(top_score * 1000000) AS BIGINT)) / count(*)) / 1000000 AS mean_top FROM per GROUP BY strategy)\nSELECT *, row_number() OVER (ORDER BY mean_top DESC, strategy) = 1 AS best FROM m", "chunks", "page_chunks"),
)
def strategy_means(spark, sf_dir):
    return _compared(spark, sf_dir)[1]


_PACK = f"""blocksof AS (SELECT query_id, rank, chunk_id, '[Source ' || rank || ']' || chr(10) || CASE WHEN hierarchy_path <> '' THEN hierarchy_path || ' | ' ELSE '' END || 'page ' || start_page || ' | (Document ' || doc_id || ')' || chr(10) || content AS block
  FROM hits JOIN chunks USING (chunk_id) WHERE rank <= 5),
packed AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context, CAST(max(s) AS BIGINT) AS tokens, count(*) AS sources FROM (SELECT *, sum({TOKENS.format('block')}) OVER (PARTITION BY query_id ORDER BY rank) AS s FROM blocksof) WHERE s <= 1500 GROUP BY query_id)"""


def _found(spark, sf_dir):
    """Hits with their chunks' contents, sections, pages and titles."""
    title = F.concat(F.lit("Document "), "doc_id")
    every = _chunks(spark, sf_dir)
    chunks = every.select("chunk_id", "content", F.col("hierarchy_path").alias("section"), F.col("start_page").alias("page"), title.alias("title"))
    hits = stored(R.keyword_search(every, asked(spark, sf_dir)), "hits")
    return small(hits).join(chunks, "chunk_id")


def _packed(spark, sf_dir):
    return R.pack_context(_found(spark, sf_dir))


@query("e13_pack_context", _sql(f", {_PACK}\nSELECT query_id, context, tokens, sources FROM packed"))
def pack_context(spark, sf_dir):
    return _packed(spark, sf_dir)


@query("e14_build_prompt", _sql(f", {_PACK}\nSELECT query_id, replace(replace('{R.PROMPT.replace(chr(10), chr(1))}', '{{context}}', context), '{{query}}', query) AS prompt FROM packed JOIN asked USING (query_id)").replace(chr(1), "' || chr(10) || '"))
def build_prompt(spark, sf_dir):
    rows = _packed(spark, sf_dir).join(asked(spark, sf_dir), "query_id")
    return rows.select("query_id", R.build_prompt(F.col("context"), F.col("query")).alias("prompt"))


@query(
    "e15_citations",
    _sql("SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, CASE WHEN doc_id % 10 = 0 THEN 'Unknown Document' ELSE 'Document ' || doc_id END AS title, hierarchy_path AS section, start_page AS page, score FROM hits JOIN chunks USING (chunk_id)"),
)
def citations(spark, sf_dir):
    """Some documents have no title."""
    title = F.when(F.col("doc_id") % 10 > 0, F.concat(F.lit("Document "), "doc_id"))
    every = _chunks(spark, sf_dir)
    chunks = every.select("chunk_id", title.alias("title"), F.col("hierarchy_path").alias("section"), F.col("start_page").alias("page"))
    hits = stored(R.keyword_search(every, asked(spark, sf_dir)), "hits")
    # Only chunks that are hit meet the hits.
    named = chunks.join(small(hits.select("chunk_id").distinct()), "chunk_id", "left_semi")
    rows = hits.join(named, "chunk_id", "left")
    return rows.select(
        "query_id", "rank", F.coalesce("chunk_id", F.lit("unknown")).alias("chunk_id"), F.coalesce("title", F.lit("Unknown Document")).alias("title"), F.coalesce("section", F.lit("")).alias("section"), "page",
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


@query("e16_citation_snippets", _sql("SELECT query_id, CAST(rank AS INTEGER) AS rank, CASE WHEN rank > 5 THEN '' WHEN length(t) > 200 THEN substr(t, 1, 200) || '...' ELSE t END AS snippet FROM (SELECT *, trim(content) AS t FROM hits JOIN (SELECT chunk_id, content FROM chunks) USING (chunk_id))"))
def citation_snippets(spark, sf_dir):
    hits = _found(spark, sf_dir).withColumn("t", F.trim("content"))
    cut = F.when(F.col("rank") > 5, "").when(F.length("t") > 200, F.concat(F.substring("t", 1, 200), F.lit("..."))).otherwise(F.col("t"))
    return hits.select("query_id", "rank", cut.alias("snippet"))


@query(
    "e17_batch_rag",
    _sql(
        f", {_PACK}\nSELECT query_id, replace(replace('{R.PROMPT.replace(chr(10), chr(1))}', '{{context}}', context), '{{query}}', query) AS prompt, sources, regexp_extract(content, '^([^.!?]*[.!?]?)', 1) AS answer FROM packed JOIN asked USING (query_id) JOIN hits USING (query_id) JOIN (SELECT chunk_id, content FROM chunks) USING (chunk_id) WHERE rank = 1"
    ).replace(chr(1), "' || chr(10) || '"),
)
def batch_rag(spark, sf_dir):
    """Answers by the default in place of a model."""
    hits = _found(spark, sf_dir)
    return R.batch_answers(R.pack_context(hits), asked(spark, sf_dir), hits.where("rank = 1"))


@query("e17_batch_rag_by_model")
def batch_rag_by_model(spark, sf_dir):
    """Answers by a vectorised model, by name."""
    hits = _found(spark, sf_dir)
    return R.batch_answers(R.pack_context(hits), asked(spark, sf_dir), hits.where("rank = 1"), "closest_sentence")


_SLOTS = "slotted AS (SELECT lang AS slot, chunk_id, content FROM chunks JOIN documents USING (doc_id))"
_BY_SLOT = f"""qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TERMS.format('query')}) AS term FROM asked) GROUP BY ALL),
ct AS (SELECT slot, chunk_id, len, term, count(*) AS tf FROM (SELECT slot, chunk_id, len({_TERMS.format('content')}) AS len, unnest({_TERMS.format('content')}) AS term FROM slotted) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
dfs AS (SELECT slot, term, count(*) AS df FROM ct GROUP BY ALL), ns AS (SELECT slot, count(*) AS n FROM slotted GROUP BY slot),
raws AS (SELECT slot, query_id, chunk_id, sum(times * tf / len * (ln((n + 1) / (df * times + 1)) + 1)) AS raw FROM ct JOIN dfs USING (slot, term) JOIN qt USING (term) JOIN ns USING (slot) GROUP BY ALL)"""


@query(
    "e18_fan_out_queries",
    statement(
        f", {_ASKED}, {_SLOTS}, {_BY_SLOT}\nSELECT slot, query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(raw / max(raw) OVER (PARTITION BY slot, query_id), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY slot, query_id ORDER BY round(raw, 9) DESC, chunk_id) AS rank FROM raws WHERE raw > 0) WHERE rank <= 5",
        "chunks",
    ),
)
def fan_out_queries(spark, sf_dir):
    """Every query against the corpus of each language."""
    slots = tables.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("slot"))
    chunks = tables.chunks(spark, sf_dir).select("doc_id", "chunk_id", "content").join(slots, "doc_id")
    return R.keyword_search(chunks, asked(spark, sf_dir), 5, "slot").drop("raw")


@query("e19_search_documents", "SELECT doc_id, title FROM (SELECT doc_id, string_split(text, chr(10))[1] AS title FROM documents) WHERE contains(lower(title), 'the') ORDER BY doc_id LIMIT 10")
def search_documents(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "documents").select("doc_id", F.get(F.split("text", "\n"), 0).alias("title"))
    return rows.where(F.lower("title").contains("the")).orderBy("doc_id").limit(10)


@query(
    "e20_conversation_rollup",
    f"""SELECT conv_id, CASE WHEN t IS NULL OR t = '' THEN 'New conversation' WHEN length(t) > 80 THEN substr(t, 1, 77) || '...' ELSE t END AS title, turns, n FROM (SELECT conv_id, {STRIP.format("arg_min(text, turn) FILTER (role = 'user')")} AS t,
  string_agg(turn || ':' || role, ',' ORDER BY turn, role) AS turns, count(*) AS n FROM conversations GROUP BY conv_id)""",
)
def conversation_rollup(spark, sf_dir):
    """Titles from first questions, and the turns in order; the newest first."""
    rows = tables.table(spark, sf_dir, "conversations")
    user = F.when(F.col("role") == "user", F.struct("turn", "text"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    per = rows.groupBy("conv_id").agg(strip(F.min(user)["text"]).alias("t"), F.array_join(F.transform(turns, lambda x: F.concat_ws(":", x["turn"], x["role"])), ",").alias("turns"), F.count("*").alias("n"))
    title = F.when(F.coalesce("t", F.lit("")) == "", "New conversation").when(F.length("t") > 80, F.concat(F.substring("t", 1, 77), F.lit("..."))).otherwise(F.col("t"))
    return per.select("conv_id", title.alias("title"), "turns", "n").orderBy(F.desc("conv_id"))


@query(
    "e21_document_catalog",
    statement(
        f"SELECT doc_id, source, any_value(title) AS title, 'text' AS type, count(*) AS chunks, max(end_page) AS pages FROM chunks JOIN (SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '' AND length(x) < 100)[1] AS title FROM documents) USING (doc_id) GROUP BY doc_id, source",
        "chunks",
    ),
)
def document_catalog(spark, sf_dir):
    per = tables.chunks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("end_page").alias("pages"))
    lines = F.filter(F.transform(F.split("text", "\n"), strip), lambda x: (x != "") & (F.length(x) < 100))
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "source", F.get(lines, 0).alias("title"), F.lit("text").alias("type"))
    return per.join(docs, "doc_id").select("doc_id", "source", "title", "type", "chunks", "pages")
