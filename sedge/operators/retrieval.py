"""Keyword and vector search for many queries at once, validation, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.shared import small, stored
from .keyword_index import MANY, Index, build_index, first_ranked, search
from .registry import Model, dimension_of, register_model, register_strategy, strategy

#: Terms of a block of queries that is put to an index; blocks from which on, and rows up
#: to which, queries meet the postings by term instead; and terms of all corpora together.
CELLS, BLOCKS, MET, CORPUS_TERMS = 400_000, 8, 20_000_000, 2_000_000
NORM_FLOOR = 1e-10


def terms(c: Column) -> Column:
    """Lower-case words of two letters or more."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x) > 1)


def keyword_search(chunks: DataFrame, queries: DataFrame, k: int = 10, by: str | None = None) -> DataFrame:
    """Top ``k`` chunks of each query (query_id, query) by term frequency times
    inverse document frequency; ``score`` is the share of the query's best, ``raw``
    the sum itself.  With ``by``, a column of the chunks, each of its values is a
    corpus of its own that every query is put to.

    The chunks are indexed first (``keyword_index``); to search an index that is there,
    use ``search_index``."""
    return search_index(build_index(chunks, by), queries, k)


def search_index(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` chunks of each query by an index, in as many blocks of ``CELLS`` query
    terms as it takes, one after the other; of many queries those of the same terms are
    one.  More than ``BLOCKS`` blocks of rare terms, and queries to more corpora than
    ``CORPUS_TERMS`` allow, meet the postings by term."""
    asked = queries.select("query_id", F.explode(terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked, keys, same = stored(asked, "asked"), index.keys, None
    if asked.select("query_id").distinct().limit(MANY).count() == MANY:
        asked, same = _told_apart(asked)
    size = asked.agg(F.countDistinct("term").alias("t"), F.countDistinct("query_id").alias("q"), F.count("*").alias("n")).first()
    blocks = max(1, min(size.q, int(-(-size.n // CELLS))))
    if (not keys or index.sizes().count() * size.t <= CORPUS_TERMS) and (blocks <= BLOCKS or _met(index, asked) > MET):
        scores = search(index, asked, k, blocks)
    else:
        scores = _by_terms(index, asked)
    top = first_ranked(scores, keys, k)
    best = F.max("raw").over(Window.partitionBy(*keys, "query_id"))
    top = top.select(*keys, "query_id", "rank", "chunk_id", F.round(F.col("raw") / best, 6).alias("score"), F.round("raw", 6).alias("raw"))
    if same is None:
        return top
    top = top.withColumnRenamed("query_id", "__first")
    return top.join(same, F.col("__first").eqNullSafe(F.col("first"))).select(*keys, "query_id", "rank", "chunk_id", "score", "raw")


def _told_apart(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries (query_id, term, times) of different terms, and for each query (query_id,
    first) the one that has its terms."""
    bags = asked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "times"))).alias("bag"))
    same = stored(bags.join(bags.groupBy("bag").agg(F.min("query_id").alias("first")), "bag").select("query_id", "first"), "same-queries")
    firsts = same.where("query_id <=> first").select(F.col("first").alias("__first"))
    return stored(asked.join(firsts, F.col("query_id").eqNullSafe(F.col("__first")), "left_semi"), "asked"), same


def _met(index: Index, asked: DataFrame) -> int:
    """The rows that ``_by_terms`` makes: terms that a chunk and a query share."""
    per = asked.groupBy("term").agg(F.count("*").cast("double").alias("q"))
    return index.postings().groupBy("term").agg(F.sum("n").alias("df")).join(per, "term").agg(F.coalesce(F.sum(F.col("df") * F.col("q")), F.lit(0.0))).first()[0]


def _by_terms(index: Index, asked: DataFrame) -> DataFrame:
    """Scores by joins on terms: a row for each term that a chunk and a query share."""
    keys = index.keys
    rows = index.postings().join(small(asked.select("term").distinct()), "term", "left_semi")
    df = rows.groupBy(*keys, "term").agg(F.sum("n").alias("df"))
    met = rows.select(*keys, "shard", "term", F.explode(F.arrays_zip("places", "shares")).alias("p")).select(*keys, "shard", "term", "p.places", "p.shares")
    scored = met.join(df, [*keys, "term"]).join(small(asked), "term")
    scored = scored.join(small(index.sizes()), keys) if keys else scored.join(F.broadcast(index.sizes()))
    idf = F.log((F.col("n") + 1) / (F.col("df") * F.col("times") + 1)) + 1
    sums = scored.groupBy(*keys, "query_id", "shard", "places").agg(F.sum(F.col("times") * F.col("shares") * idf).alias("raw"))
    named = index.rows.where("term IS NULL").select("shard", "chunks")
    return sums.join(named, "shard").select(*keys, "query_id", F.get("chunks", F.col("places")).alias("chunk_id"), "raw")


# ------------------------------------------------------------------- vectors

#: Vectors in one block; a pair of blocks is one product in one task.
BLOCK_ROWS = 4096
#: Queries that are multiplied at once, and vectors of a block that they meet.
SLICE, SEARCH_ROWS = 256, 1024


def packed(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, ids, units): unit vectors in blocks of about ``rows``, as matrices."""
    import pyarrow as pa

    from ..shipping import bounded_batches

    bounded_batches(vectors.sparkSession)
    n = -(-vectors.count() // rows) or 1

    def pack(key, table):
        import numpy as np

        m = np.array(table["v"].to_pylist(), np.float64).reshape(table.num_rows, -1)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), NORM_FLOOR)
        ids = pa.array([table["i"].to_pylist()], pa.list_(pa.int64()))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "ids": ids, "units": pa.array([m.tobytes()], pa.binary())})

    dealt = vectors.select(F.pmod(F.xxhash64(id_column), F.lit(n)).cast("int").alias("block"), F.col(id_column).alias("i"), F.col(vector_column).alias("v"))
    return dealt.groupBy("block").applyInArrow(pack, "block int, ids array<bigint>, units binary")


def _products(pairs: DataFrame, take, names: tuple[str, str]) -> DataFrame:
    """(left, right, score) of pairs of blocks; ``take`` picks places of a product."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(c) for c in ("ids", "units", "ids2", "units2")]
            for row in range(batch.num_rows):
                a, u, b, v = (x[row] for x in columns)
                a, b = (x.values.to_numpy() for x in (a, b))
                u, v = (np.frombuffer(x.as_buffer()).reshape(n, -1) for x, n in ((u, len(a)), (v, len(b))))
                for at in range(0, len(a), SLICE):
                    part = a[at : at + SLICE]
                    s = u[at : at + SLICE] @ v.T
                    x, y = take(part, b, s)
                    yield pa.RecordBatch.from_arrays([pa.array(part[x], pa.int64()), pa.array(b[y], pa.int64()), pa.array(s[x, y], pa.float64())], names=[*names, "score"])

    return pairs.select("ids", "units", "ids2", "units2").mapInArrow(run, f"{names[0]} bigint, {names[1]} bigint, score double")


def _against(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Each block of a stated query set beside each block of the vectors."""
    q = packed(queries, "query_id", "query_vector").select("ids", "units")
    v = stored(packed(vectors, rows=SEARCH_ROWS), "blocks").select(F.col("ids").alias("ids2"), F.col("units").alias("units2"))
    return v.crossJoin(small(stored(q, "query-blocks"), 64))


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Top ``k`` vectors (vec_id, embedding) of each query (query_id,
    query_vector) by cosine; only the best of each block leave it."""

    def take(a, b, s):
        import numpy as np

        key, rows, columns = np.round(s, 9), [], []
        least = np.partition(key, len(b) - k, axis=1)[:, len(b) - k] if len(b) > k else np.full(len(a), -np.inf)
        for r in range(len(a)):
            best = np.flatnonzero(key[r] >= least[r])
            best = best[np.lexsort((b[best], -key[r][best]))][:k]
            rows += [r] * len(best)
            columns += best.tolist()
        return rows, columns

    scored = _products(_against(vectors, queries), take, ("query_id", "vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Vectors that pivots are chosen of, and pivots, at most.
PIVOT_SAMPLE, PIVOTS = 4096, 256


def pivots_of(vectors: DataFrame, n: int):
    """Up to ``n`` unit vectors far from each other, of a bounded sample: each is the
    one that is farthest from those before it.  They only decide which vectors lie in
    a block together, never what is found."""
    import numpy as np

    rows = vectors.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect()
    if not rows:
        return np.zeros((0, 0))
    m = np.array([r.embedding for r in rows], np.float64).reshape(len(rows), -1)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), NORM_FLOOR)
    chosen, apart = [], np.full(len(m), np.inf)
    while len(chosen) < min(n, len(m)) and apart.max(initial=0) > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((m - m[chosen[-1]]) ** 2).sum(1))
    return m[chosen]


def near_blocks(vectors: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, ids, units, centre, radius): unit vectors in blocks of about ``rows``
    that lie about the same pivot, with the ball that holds them."""
    import pyarrow as pa

    from ..shipping import bounded_batches

    spark = vectors.sparkSession
    bounded_batches(spark)
    n = vectors.count()
    pivots = spark.sparkContext.broadcast(pivots_of(vectors, min(PIVOTS, -(-2 * n // rows) or 1)))

    def assign(batches):
        import numpy as np

        for batch in batches:
            m = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), NORM_FLOOR)
            own = (m @ pivots.value.T).argmax(1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in m], pa.binary()), pa.array(own, pa.int32())], names=["i", "unit", "pivot"])

    def pack(key, table):
        import numpy as np

        m = np.frombuffer(b"".join(table["unit"].to_pylist())).reshape(table.num_rows, -1)
        centre = m.mean(0)
        radius = float(np.sqrt(((m - centre) ** 2).sum(1)).max())
        ids = pa.array([table["i"].to_pylist()], pa.list_(pa.int64()))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "ids": ids, "units": pa.array([m.tobytes()], pa.binary()), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius])})

    units = stored(vectors.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(assign, "i bigint, unit binary, pivot int"), "units")
    sizes = units.groupBy("pivot").agg(F.count("*").alias("n"))
    parts = F.broadcast(sizes.select("pivot", F.ceil(F.col("n") / rows).alias("parts")))
    dealt = units.join(parts, "pivot").select((F.col("pivot") * F.lit(1 << 32) + F.pmod(F.xxhash64("i"), F.col("parts"))).alias("block"), "i", "unit")
    return dealt.groupBy("block").applyInArrow(pack, "block bigint, ids array<bigint>, units binary, centre array<double>, radius double")


def reach_of(threshold: float) -> float:
    """How far apart vectors of length one or less are at most if their product is
    ``threshold`` or more: |u - v|^2 = |u|^2 + |v|^2 - 2uv <= 2 - 2uv."""
    return max(0.0, 2 - 2 * threshold) ** 0.5


_BALL = ["block", "ids", "units", "centre", "radius"]


def block_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(block, block2): the pairs of blocks that can hold a pair of similar vectors.  By
    the triangle inequality the others' balls are too far apart.

    Only centres and radii meet here, a row for each block."""
    centres = stored(left.select("block", "centre", "radius"), "centres")
    other = stored(right.select(F.col("block").alias("block2"), F.col("centre").alias("centre2"), F.col("radius").alias("radius2")), "centres")
    apart = F.sqrt(F.aggregate(F.zip_with("centre", "centre2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    met = centres.crossJoin(small(other))
    return met.where(apart - F.col("radius") - F.col("radius2") <= reach_of(threshold) + 1e-6).select("block", "block2")


def _verified(left: DataFrame, right: DataFrame, pairs: DataFrame, threshold: float, slack: float, halves: bool) -> DataFrame:
    """(l, r, score) of the similar vectors of pairs of blocks; a row meets the other
    block only if it is near enough to the ball around that.  With ``halves`` both sides
    are one table, and of a block with itself each pair is given once."""
    reach = reach_of(threshold) + 1e-6

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(c)[k].as_py() for c, name in enumerate(batch.schema.names)}
                a, b = np.array(row["ids"]), np.array(row["ids2"])
                u, v = np.frombuffer(row["units"]).reshape(len(a), -1), np.frombuffer(row["units2"]).reshape(len(b), -1)
                own = halves and row["block"] == row["block2"]
                if not own:
                    near = np.sqrt(((u - row["centre2"]) ** 2).sum(1)) <= reach + row["radius2"]
                    near2 = np.sqrt(((v - row["centre"]) ** 2).sum(1)) <= reach + row["radius"]
                    a, u, b, v = a[near], u[near], b[near2], v[near2]
                s = u @ v.T
                x, y = np.nonzero(s >= threshold - slack)
                keep = a[x] < b[y] if own else a[x] != b[y]
                x, y = x[keep], y[keep]
                yield pa.RecordBatch.from_arrays([pa.array(a[x], pa.int64()), pa.array(b[y], pa.int64()), pa.array(s[x, y], pa.float64())], names=["l", "r", "score"])

    other = right.select(*[F.col(c).alias(f"{c}2") for c in _BALL])
    met = left.join(small(pairs), "block").join(other, "block2")
    return met.select(*_BALL, *[f"{c}2" for c in _BALL]).mapInArrow(run, "l bigint, r bigint, score double")


def similar_to(vectors: DataFrame, queries: DataFrame, threshold: float = 0.8, rows: int = BLOCK_ROWS) -> DataFrame:
    """Vectors with a cosine of ``threshold`` or more to a query, itself left out; by
    blocks about pivots, as in ``similar_pairs``."""
    asked = stored(near_blocks(queries.select(F.col("query_id").alias("vec_id"), F.col("query_vector").alias("embedding")), rows), "query-blocks")
    blocks = stored(near_blocks(vectors, rows), "blocks")
    met = _verified(asked, blocks, stored(block_pairs(asked, blocks, threshold), "block-pairs"), threshold, 1e-12, False)
    return met.withColumnsRenamed({"l": "query_id", "r": "vec_id"})


def similar_pairs(vectors: DataFrame, threshold: float = 0.8, rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, n_a, n_b, score): pairs of different vectors with a cosine of
    ``threshold`` or more, each named by the smallest id of its equals, with their
    numbers; copies make no pairs.

    Blocks hold vectors about one pivot.  Pairs of blocks whose balls are too far apart
    are passed over before any vector moves, and so are, in the others, the rows that
    are too far from the other ball; what is left is multiplied.  Blocks have a fixed
    number of rows, so memory does not grow with the table."""
    classes = stored(vectors.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")), "classes")
    blocks = stored(near_blocks(classes, rows), "blocks")
    near = stored(block_pairs(blocks, blocks, threshold).where("block <= block2"), "block-pairs")
    met = _verified(blocks, blocks, near, threshold, 1e-9, True)
    met = met.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"), "score")
    sizes = classes.select("vec_id", "n")
    met = met.join(sizes.select(F.col("vec_id").alias("a"), F.col("n").alias("n_a")), "a")
    return met.join(sizes.select(F.col("vec_id").alias("b"), F.col("n").alias("n_b")), "b").select("a", "b", "n_a", "n_b", "score")


def metadata_filter(rows: DataFrame, criteria: list[tuple[str, str, str | None]]) -> DataFrame:
    """Rows that meet every (field, operation, value): eq, contains and regex
    without case, exists, not_exists, gt and lt as numbers."""
    keep = F.lit(True)
    for name, op, value in criteria:
        c = F.col(name).cast("string")
        number = c.try_cast("double") if hasattr(c, "try_cast") else F.expr(f"try_cast(`{name}` AS double)")
        test = {
            "eq": lambda: F.lower(c) == F.lit(value).cast("string"),
            "contains": lambda: F.lower(c).contains(str(value).lower()),
            "regex": lambda: c.rlike(f"(?i){value}"),
            "exists": lambda: F.coalesce(F.trim(c), F.lit("")) != "",
            "not_exists": lambda: F.coalesce(F.trim(c), F.lit("")) == "",
            "gt": lambda: number > float(value),
            "lt": lambda: number < float(value),
        }[op]()
        keep = keep & F.coalesce(test, F.lit(False))
    return rows.where(keep)


def validate_hits(hits: DataFrame, rules: list[tuple[str, Column, float]], threshold: float = 0.0) -> DataFrame:
    """Scores times the weighted share of rules (name, test, weight) that a hit
    passes; hits under ``threshold`` go."""
    total = sum(w for _, _, w in rules)
    if not rules:
        return hits.withColumns({"validation": F.lit(1.0), "adjusted": F.col("score")})
    passed = sum((F.when(F.coalesce(t, F.lit(False)), F.lit(w)).otherwise(0.0) for _, t, w in rules), F.lit(0.0))
    rows = hits.withColumn("validation", passed / total)
    # Rounded half up on whole millionths, as the scores are.
    adjusted = F.floor(F.round(F.col("score") * 1e6) * F.col("validation") + 0.5) / 1e6
    return rows.withColumn("adjusted", adjusted).where(F.col("validation") >= threshold)


def suite_results(wanted: DataFrame, hits: DataFrame) -> DataFrame:
    """Missing expected and retrieved excluded chunks of each query.

    ``wanted`` has a row (query_id, chunk_id, expected) for each chunk that a query
    names; a query that names none has one without a chunk."""
    got = hits.select("query_id", "chunk_id", F.lit(True).alias("__got")).distinct()
    rows = wanted.join(got, ["query_id", "chunk_id"], "left")
    named, met = F.col("chunk_id").isNotNull(), F.col("__got").isNotNull()
    per = rows.groupBy("query_id").agg(F.count_if(named & F.col("expected") & ~met).alias("missing"), F.count_if(named & ~F.col("expected") & met).alias("wrong"))
    return per.withColumn("passed", (F.col("missing") == 0) & (F.col("wrong") == 0))


def suite_by_rule(sizes: DataFrame, hits: DataFrame) -> DataFrame:
    """The same of suites that name chunks by a rule: ``sizes`` (query_id, expected) has
    how many chunks a query expects, ``hits`` (query_id, chunk_id, expected) its hits,
    true or false where the query names them.  What a suite names is never listed."""
    met = hits.where("expected IS NOT NULL").dropDuplicates(["query_id", "chunk_id"]).groupBy("query_id")
    met = met.agg(F.count_if("expected").alias("right"), F.count_if(~F.col("expected")).alias("wrong"))
    per = sizes.join(met, "query_id", "left").fillna(0, ["right", "wrong"]).select("query_id", (F.col("expected") - F.col("right")).alias("missing"), "wrong")
    return per.withColumn("passed", (F.col("missing") == 0) & (F.col("wrong") == 0))


def suite_report(results: DataFrame) -> DataFrame:
    """Queries that pass and fail, and their rate."""
    n = F.count_if("passed")
    return results.agg(n.alias("passed"), (F.count("*") - n).alias("failed"), F.round(n / F.count("*"), 6).alias("pass_rate"))


def suite_coverage(chunks: DataFrame, hits: DataFrame, often: int = 3) -> tuple[DataFrame, DataFrame]:
    """Of each document: chunks, those retrieved, those of ``often`` queries and the
    coverage rate; and the chunks that no query retrieves."""
    per = hits.groupBy("chunk_id").agg(F.countDistinct("query_id").alias("n"))
    rows = chunks.select("doc_id", "chunk_id").join(per, "chunk_id", "left")
    out = rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count("n").alias("retrieved"), F.count_if(F.col("n") >= often).alias("often"))
    return out.withColumn("rate", F.round(F.col("retrieved") / F.col("chunks"), 6)), rows.where("n IS NULL").select("doc_id", "chunk_id")


def compare_strategies(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each strategy and query the hits and the best one; and of each strategy the
    mean best score, and whether it is the highest."""
    per = hits.groupBy("strategy", "query_id").agg(F.count("*").alias("hits"), F.min_by("chunk_id", "rank").alias("top"), F.max("raw").alias("top_score"))
    mean = per.groupBy("strategy").agg((F.sum(F.round(F.col("top_score") * 1_000_000).cast("bigint")) / F.count("*")).alias("m"))
    mean = mean.select("strategy", (F.round("m") / 1_000_000).alias("mean_top"))
    return per, mean.withColumn("best", F.row_number().over(Window.partitionBy().orderBy(F.desc("mean_top"), "strategy")) == 1)


def pack_context(hits: DataFrame, limit: int = 1500, most: int = 5) -> DataFrame:
    """The first hits of a query as one text, each with a line of its section, page
    and title (where it has them), up to the first that overflows: every block has a
    token at least, so that is where the running sum passes."""
    given = lambda c: F.col(c) if c in hits.columns else F.lit(None).cast("string")
    about = F.concat_ws(" | ", F.nullif(given("section"), F.lit("")), F.concat(F.lit("page "), given("page")), F.concat(F.lit("("), given("title"), F.lit(")")))
    block = F.concat_ws("\n", F.concat(F.lit("[Source "), F.col("rank"), F.lit("]")), F.nullif(about, F.lit("")), F.col("content"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = hits.where(F.col("rank") <= most).withColumn("block", block)
    rows = rows.withColumn("sum", F.sum(tokens(F.col("block"))).over(w)).where(F.col("sum") <= limit)
    parts = F.array_sort(F.collect_list(F.struct("rank", "block")))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["block"]), "\n\n").alias("context"), F.max("sum").alias("tokens"), F.count("*").alias("sources"))


def first_sentence(prompt: Column, content: Column) -> Column:
    """The answer without a model: the first sentence of the best hit."""
    return F.regexp_extract(content, r"^([^.!?]*[.!?]?)", 1)


def batch_answers(packed_: DataFrame, queries: DataFrame, best: DataFrame, answer: str = "first_sentence") -> DataFrame:
    """Prompts and answers of all queries; ``answer`` names the registered model, of the
    prompt and the best hit's content."""
    answer = strategy("model", answer)
    rows = packed_.join(queries, "query_id").join(best.select("query_id", "content"), "query_id")
    rows = rows.withColumn("prompt", build_prompt(F.col("context"), F.col("query")))
    return rows.select("query_id", "prompt", "sources", answer(F.col("prompt"), F.col("content")).alias("answer"))


def _closest(_, prompts, contents):
    import re

    out = []
    for prompt, content in zip(prompts, contents):
        asked = set(re.findall(r"\w+", prompt.rpartition("\nQuestion: ")[2].lower()))
        said = [s for s in re.split(r"(?<=[.!?])\s+", content) if s]
        out.append(max(said, key=lambda s: len(asked & set(re.findall(r"\w+", s.lower()))), default=""))
    return out


register_strategy("model", "first_sentence", first_sentence)
#: The best hit's sentence that has most words of the question, the first of equals.
register_model("model", "closest_sentence", lambda: None, _closest)


def _projection():
    import numpy as np

    return np.random.default_rng(20240101).normal(size=(1024, LETTERS_DIMENSION))


def _letters(projection, texts):
    import zlib

    import numpy as np

    out = np.zeros((len(texts), LETTERS_DIMENSION))
    for k, t in enumerate(texts):
        low = t.lower()
        counts = np.bincount([zlib.crc32(low[j : j + 3].encode("utf-8", "surrogatepass")) % 1024 for j in range(len(low) - 2)], minlength=1024)
        v = counts @ projection
        out[k] = v / max(np.linalg.norm(v), NORM_FLOOR)
    return out.astype(np.float32)


LETTERS_DIMENSION = 64
#: Groups of three letters, hashed and projected.
register_model("embedder", "letters", _projection, _letters, LETTERS_DIMENSION)


def hashed_terms(chunks: DataFrame) -> DataFrame:
    """The embedding without a model: hashed term frequencies, scaled by rarity."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    rows = chunks.select("chunk_id", terms(F.col("content")).alias("terms"))
    tf = HashingTF(inputCol="terms", outputCol="tf", numFeatures=256).transform(rows)
    idf = IDF(inputCol="tf", outputCol="idf").fit(tf).transform(tf)
    out = Normalizer(inputCol="idf", outputCol="vector").transform(idf)
    return out.select("chunk_id", vector_to_array("vector").alias("embedding"))


hashed_terms.dimension = 256
register_strategy("embedder", "hashed_terms", hashed_terms)


def embed(chunks: DataFrame, name: str, dimension: int | None = None) -> DataFrame:
    """(chunk_id, embedding) of chunks by a registered embedder, of ``dimension`` if one
    is wanted: that and the name are checked when the query is planned."""
    dimension_of(name, dimension)
    made = strategy("embedder", name)
    if isinstance(made, Model):
        return chunks.select("chunk_id", made(F.col("content")).alias("embedding"))
    return made(chunks)


PROMPT = "Use the context to answer.\n\nContext:\n{context}\n\nQuestion: {query}\nAnswer:"


def build_prompt(context: Column, query: Column, template: str = PROMPT) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{context}"), context), F.lit("{query}"), query)
