"""Similarity joins that prune, stored indexes, plug-ins and streams."""

from __future__ import annotations

import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.operators import curriculum, keyword_index, retrieval, set_index
from sedge.sources.shared import stored


def unit_clusters(r, centres, each, width, spread):
    out = []
    for _ in range(centres):
        c = np.array([r.gauss(0, 1) for _ in range(width)])
        c /= np.linalg.norm(c)
        out += [(c + np.array([r.gauss(0, spread) for _ in range(width)])).tolist() for _ in range(each)]
    return out


@pytest.mark.parametrize("threshold", [0.8, 0.95, 0.2])
def test_pruned_pairs_equal_all_pairs(spark, threshold):
    r = random.Random(31)
    vectors = unit_clusters(r, 12, 40, 16, 0.08)
    vectors += [vectors[0]] * 30 + [[0.0] * 16, [1e-12] + [0.0] * 15, [3.0 * x for x in vectors[5]], [-x for x in vectors[7]]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(3)
    m = np.array(vectors)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), retrieval.NORM_FLOOR)
    classes: dict = {}
    for k, v in enumerate(vectors):
        classes.setdefault(tuple(v), []).append(k)
    heads = [ks[0] for ks in classes.values()]
    size = {ks[0]: len(ks) for ks in classes.values()}
    s = m @ m.T
    want = {(a, b): (size[a], size[b]) for a in heads for b in heads if a < b and s[a, b] >= threshold - 1e-9}
    got = {(x.a, x.b): (x.n_a, x.n_b) for x in retrieval.similar_pairs(df, threshold, rows=25).collect()}
    assert got == want and len(want) > 100
    assert retrieval.similar_pairs(df.limit(0), threshold).count() == 0


def test_work_grows_below_the_square_on_clustered_vectors(spark):
    """Clusters come with the table: pairs of blocks that meet grow as it does."""
    met, of = {}, {}
    for centres in (8, 32):
        df = spark.createDataFrame(list(enumerate(unit_clusters(random.Random(32), centres, 50, 24, 0.03))), "vec_id long, embedding array<double>")
        blocks = retrieval.stored(retrieval.near_blocks(df, 50), "blocks")
        met[centres], of[centres] = retrieval.block_pairs(blocks, blocks, 0.8).count(), blocks.count() ** 2
        print(f"{centres * 50} vectors: {of[centres] - met[centres]} of {of[centres]} pairs of blocks passed over")
    assert met[32] <= 8 * met[8] and met[32] < 0.2 * of[32]


def brute_hits(chunks, queries, k):
    """{(query, rank): chunk} by whole sums."""
    import math
    import re
    from collections import Counter

    split = lambda t: [w for w in re.findall("[a-z]+", (t or "").lower()) if len(w) > 1]
    words = {c: Counter(split(t)) for c, t in chunks}
    df = Counter(w for x in words.values() for w in x)
    out = {}
    for q, text in queries:
        asked, scores = Counter(split(text)), {}
        for c, x in words.items():
            n = x.total()
            s = sum(times * x[t] / n * (math.log((len(words) + 1) / (df[t] * times + 1)) + 1) for t, times in asked.items() if t in x)
            if s > 0:
                scores[c] = s
        for r, c in enumerate(sorted(scores, key=lambda c: (-round(scores[c], 9), c))[:k]):
            out[q, r + 1] = c
    return out


def zipf_text(r, n, kinds):
    return " ".join(f"w{''.join(chr(97 + int(d)) for d in str(int(kinds ** r.random())))}" for _ in range(n))


@pytest.mark.parametrize("shard,block", [(4096, 64), (40, 4)])
def test_index_gives_the_exact_best(spark, monkeypatch, shard, block):
    monkeypatch.setattr(keyword_index, "SHARD", shard)
    monkeypatch.setattr(keyword_index, "POSTINGS", block)
    r = random.Random(33)
    chunks = [(f"c{k:04d}", zipf_text(r, r.randint(0, 60), 900)) for k in range(600)] + [("d1", None), ("d2", "")] + [(f"e{k}", "same few words") for k in range(20)]
    queries = [(k, zipf_text(r, r.randint(0, 12), 900)) for k in range(40)] + [(90, "same words"), (91, "wb " * 9), (92, None)]
    df = spark.createDataFrame(chunks, "chunk_id string, content string").repartition(4)
    index = keyword_index.build_index(df)
    asked = spark.createDataFrame(queries, "query_id int, query string")
    got = {(x.query_id, x.rank): x.chunk_id for x in retrieval.search_index(index, asked, 5).collect()}
    assert got == brute_hits(chunks, queries, 5)
    assert retrieval.keyword_search(df.limit(0), asked, 5).count() == 0
    assert retrieval.search_index(index, asked.limit(0), 5).count() == 0


def test_index_is_written_once_and_stops_early(spark, tmp_path, monkeypatch):
    """Two query sets over one folder; postings behind the bounds are not read, in
    blocks of 16, as lists are short here."""
    monkeypatch.setattr(keyword_index, "POSTINGS", 16)
    r = random.Random(34)
    common = ["".join(r.choices("abcdefghij", k=4)) for _ in range(200)]
    topic = lambda k: "topic" + "".join(chr(97 + int(d)) for d in str(k % 500))
    chunks = [(f"c{k:05d}", " ".join([*r.sample(common, 40), *[topic(k)] * r.randint(3, 5)])) for k in range(4000)]
    df = spark.createDataFrame(chunks, "chunk_id string, content string").repartition(2)
    folder = f"file://{tmp_path}/index"
    keyword_index.build_index(df, folder=folder)
    index = keyword_index.open_index(spark, folder)
    for seed in (1, 2):
        q = random.Random(seed)
        queries = [(k, " ".join([topic(q.randrange(500)), *q.sample(common, 4)])) for k in range(15)]
        asked = spark.createDataFrame(queries, "query_id int, query string")
        got = {(x.query_id, x.rank): x.chunk_id for x in retrieval.search_index(index, asked, 3).collect()}
        assert got == brute_hits(chunks, queries, 3)
        weights = asked.select("query_id", F.explode(retrieval.terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        read, every = keyword_index.postings_read(index, weights, 3)
        print(f"{read} of {every} postings read")
        assert 0 < read < 0.6 * every


def sentence(r, n=6):
    return " ".join(r.choices("a b c d e f g h".split(), k=r.randint(0, n)))


def test_batches_against_an_index_equal_the_rebuild(spark, tmp_path):
    """Three batches, each added; copies, empty texts and new tokens among them."""
    r = random.Random(35)
    rows = [(f"e{k:03d}", k % 2, sentence(r), sentence(r)) for k in range(90)]
    rows += [(f"d{k:03d}", 0, "the same question here", f"answer {k} is {'x' * k}") for k in range(15)] + [("a000", 1, rows[3][2], rows[3][3]), ("b000", None, "q", "a")]
    schema = "example_id string, discipline int, question string, answer string"
    frame = lambda part: spark.createDataFrame(part, schema)
    parts = [rows[:60], rows[60:75], rows[75:100], rows[100:]]
    index = curriculum.index_examples(frame(parts[0]), folder=f"file://{tmp_path}/index")
    for k in (1, 2, 3):
        ids = [x[0] for x in parts[k]]
        want = curriculum.conflicts(frame([x for p in parts[: k + 1] for x in p]), new=F.col("example_id").isin(ids))
        got = curriculum.check_batch(index, frame(parts[k]), add=True)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert curriculum.check_batch(index, frame(rows).limit(0)).count() == 0
    empty = curriculum.index_examples(frame(rows).limit(0))
    assert sorted(map(tuple, curriculum.check_batch(empty, frame(rows)).collect())) == sorted(map(tuple, curriculum.conflicts(frame(rows)).collect()))


def test_a_batch_reads_its_buckets_only(spark, tmp_path):
    rows = spark.createDataFrame([(0, f"s{k}", [f"t{k}", f"u{k}", f"v{k}"]) for k in range(400)], "discipline int, cls string, tokens array<string>")
    index = set_index.build_sets(rows, ("discipline",), 0.7, f"file://{tmp_path}/sets")
    batch = spark.createDataFrame([(0, "new", ["t7", "u7", "v7"])], "discipline int, cls string, tokens array<string>")
    wanted = set_index._prefixes(index, batch).select(set_index.bucket_of("t").alias("bucket"))
    read = {f.rsplit("/", 2)[1] for f in index.prefixes(wanted).select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert len(read) <= wanted.distinct().count() < set_index.BUCKETS / 4
    assert {(x.cls, x.cls2) for x in set_index.near_sets(index, batch).collect()} == {("new", "s7"), ("new", "new")}


def test_an_index_leaves_its_own_folder_only_and_short_prefixes(spark, tmp_path):
    """Tables that the index was made of are gone, and so are shuffles; a prefix's row has no signature."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    rows = [(f"e{k:04d}", k % 2, f"what is thing {k} of {k % 50}", " ".join(f"w{(k * j) % 997}" for j in range(1, 40))) for k in range(600)]
    before = {p for p in shared.glob("*") if any(p.rglob("*.parquet"))} if shared.is_dir() else set()
    index = curriculum.index_examples(spark.createDataFrame(rows, "example_id string, discipline int, question string, answer string"), folder=f"file://{tmp_path}/index")
    after = {p for p in shared.glob("*") if any(p.rglob("*.parquet"))} if shared.is_dir() else set()
    assert after == before
    assert index.answers.sets().count() == 600
    size = lambda name: sum(p.stat().st_size for p in (tmp_path / "index/answers" / name).rglob("*.parquet"))
    every = index.answers.prefixes(spark.range(set_index.BUCKETS).select(F.col("id").cast("int").alias("bucket")))
    assert every.columns == ["discipline", "id", "t"] and every.count() > 5 * 600
    assert size("prefixes") < 2 * size("sets")


def test_near_questions_and_near_answers_make_no_product(spark):
    """A class with 1,000 near questions and 1,000 near answers."""
    base = [f"w{j}" for j in range(20)]
    rows = [("a0", 0, " ".join(base), " ".join(f"v{j}" for j in range(20)))]
    rows += [(f"q{k:04d}", 0, " ".join([*base, f"x{k}"]), f"answer number {k} is z{k}") for k in range(1000)]
    rows += [(f"r{k:04d}", 0, f"other question of y{k} and {k}", " ".join([*(f"v{j}" for j in range(20)), f"x{k}"])) for k in range(1000)]
    df = spark.createDataFrame(rows, "example_id string, discipline int, question string, answer string")
    classes = curriculum.stored(curriculum._with_ids(curriculum._classed(df, ("discipline",)), ("discipline",)), "classes")
    own = classes.where("class_id = 'a0'")
    near = [curriculum.stored(curriculum.similar_sets(curriculum._sets(own, c, t, ("discipline",)), curriculum._sets(classes, c, t, ("discipline",)), ("discipline",), 0.7), c) for c, t in (("qc", "q"), ("ac", "a"))]
    assert [x.count() for x in near] == [1001, 1001]
    links = curriculum._links(own.select("discipline", "qc", "ac", "class_id"), classes, classes, *near, ("discipline",))
    assert links.first().links == 1000
    made = _largest_join(spark, links)
    assert made <= 5000


def _largest_join(spark, df):
    """The most rows that a join of the finished plan gives."""
    df.write.format("noop").mode("overwrite").save()
    df = df.select("*")
    df.collect()
    plan, most = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if "Join" in name and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def test_signals_of_many_days_are_recorded_once(spark, tmp_path):
    """Days in any order, repeats in one batch, in later ones and long after."""
    from sedge.operators import feedback
    from sedge.sources import readers

    r = random.Random(36)
    base = [(k, f"2024-{1 + k % 12:02d}-{1 + k % 28:02d} 10:00:00") for k in range(400)] + [(None, "2024-05-05 00:00:00"), (1000, None)]
    sent = base + r.sample(base, 200) + base[:50]
    r.shuffle(sent)
    for k in range(10):
        part = spark.createDataFrame(sent[k::10], "signal_id long, ts string").select("signal_id", F.col("ts").cast("timestamp").alias("ts"))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = readers.stream_of(spark, f"{tmp_path}/in")
    got = feedback.recorded(stream, f"file://{tmp_path}/recorded")
    assert sorted(-1 if x.signal_id is None else x.signal_id for x in got.collect()) == sorted({x[0] if x[0] is not None else -1 for x in base})
    # No state store is left behind: what a run keeps is what it wrote.
    import os

    assert not os.path.isdir(f"{tmp_path}/recorded/offsets/state")


def test_a_batch_that_runs_again_writes_once(spark, tmp_path):
    from sedge.operators import feedback
    from sedge.sources import readers
    from sedge.streaming import runs

    for k in range(8):
        spark.createDataFrame([(k * 10 + j, j) for j in range(10)], "signal_id long, n int").select("signal_id", "n", F.lit("2024-01-01").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = readers.stream_of(spark, f"{tmp_path}/in")
    tries = []

    def fails(df, batch):
        runs.write_once(df, f"{tmp_path}/out", batch)
        tries.append(batch)
        if len(tries) == 2:
            raise RuntimeError("lost behind the write")

    with pytest.raises(Exception, match="lost behind the write"):
        runs.run_batches(stream, f"{tmp_path}", fails)
    runs.run_batches(stream, f"{tmp_path}", fails)
    assert tries.count(tries[1]) == 2
    rows = runs.read_batches(spark, f"{tmp_path}/out", "signal_id bigint, n int").collect()
    assert sorted(x.signal_id for x in rows) == list(range(80))
    # The same for recorded signals: a first run fails behind its second batch.
    held, once = feedback.write_once, []

    def breaks(*a, **b):
        held(*a, **b)
        once.append(1)
        if len(once) == 2:
            raise RuntimeError("lost behind the write")

    feedback.write_once = breaks
    try:
        with pytest.raises(Exception, match="lost behind the write"):
            feedback.recorded(stream, f"{tmp_path}/again")
    finally:
        feedback.write_once = held
    assert sorted(x.signal_id for x in feedback.recorded(stream, f"{tmp_path}/again").collect()) == list(range(80))


def test_suites_by_rule_equal_listed_ones(spark):
    r = random.Random(37)
    names = [f"c{k}" for k in range(60)]
    rows, wanted = [], []
    for q in range(25):
        expected, excluded = r.sample(names, r.randint(0, 6)), r.sample(names, r.randint(0, 6))
        excluded = [c for c in excluded if c not in expected]
        hits = r.sample(names, 8) + (expected if q % 3 else [])
        rows += [(q, c, c in expected if c in expected or c in excluded else None) for c in {*hits}]
        wanted += [(q, c, True) for c in expected] + [(q, c, False) for c in excluded] + ([(q, None, None)] if not expected and not excluded else [])
    hits = spark.createDataFrame(rows, "query_id int, chunk_id string, expected boolean")
    listed = spark.createDataFrame(wanted, "query_id int, chunk_id string, expected boolean")
    sizes = listed.groupBy("query_id").agg(F.count_if("expected").alias("expected"))
    key = lambda df: sorted((x.query_id, x.missing, x.wrong, x.passed) for x in df.collect())
    assert key(retrieval.suite_by_rule(sizes, hits)) == key(retrieval.suite_results(listed, hits))


def test_tables_of_html_are_one_block(spark):
    from sedge.operators import documents

    html = "<h1>T</h1><p>a<table class=x><tr><th>h &amp; i</th><th>j</th></tr>\n<tr><td>1<td>2 <b>3</b></tr></table><p>b"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = [(x.type, x.content) for x in documents.html_blocks(df).orderBy("pos").collect()]
    assert got == [("heading", "T"), ("text", "a"), ("table", "| h & i | j\n| 1 | 2 3"), ("text", "b")]


def test_streams_without_a_batch_are_empty(spark, tmp_path):
    from sedge.operators import feedback
    from sedge.streaming import runs

    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("signal_id long, ts timestamp").parquet(f"{tmp_path}/in")
    assert feedback.recorded(stream, f"file://{tmp_path}/none").count() == 0
    assert runs.exported(stream, "none", f"file://{tmp_path}/none-too").count() == 0


def test_sets_that_share_a_rare_token_only_part_where_they_meet(spark):
    """Each group of sets has one token in common, which makes no pairs; near sets are found."""
    r = random.Random(5)
    sets = [(0, f"g{g}-{k}", [f"a{g}", *(f"{r.random()}" for _ in range(60))]) for g in range(3) for k in range(40)]
    sets += [(0, f"n{k}", [*sets[k][2][:52], *(f"{k}/{j}" for j in range(9))]) for k in range(0, 120, 10)]
    df = spark.createDataFrame(sets, "discipline int, cls string, tokens array<string>")
    ordered = set_index.ordered_sets(df, ("discipline",), set_index.ranks_of(df, ("discipline",)))
    other = ordered.select(*[F.col(c).alias(f"{c}2") for c in ("cls", "n", *set_index.SIGNATURE)])
    met = {(x.cls, x.cls2) for x in ordered.crossJoin(other).where("cls < cls2").where(set_index.may_be_near(0.7)).collect()}
    near = {(a, b) for _, a, x in sets for _, b, y in sets if a < b and len({*x} & {*y}) >= 0.7 * len({*x} | {*y})}
    assert len(near) == 12 and near <= met and len(met) < 40
    got = curriculum.similar_sets(df, df, ("discipline",), 0.7).where("cls < cls2").collect()
    assert {(x.cls, x.cls2) for x in got} == near


def test_many_queries_at_once_equal_one_by_one():
    """Ties, weights below zero, unknown terms and fewer chunks than wanted."""
    r = np.random.default_rng(3)
    for n, k in ((500, 5), (3, 5), (40, 40)):
        postings = {}
        for j in range(30):
            places = np.flatnonzero(r.random(n) < (0.6 if j < 10 else 0.05))
            if len(places):
                shares = r.integers(1, 4, len(places)) / 8
                postings[f"t{j}"] = (places.astype(np.int32), shares, np.maximum.reduceat(shares, np.arange(0, len(places), 64)))
        plans = [[(f"t{j}", w) for j, w in zip(r.permutation(35)[:12].tolist(), r.integers(-1, 5, 12).tolist())] for _ in range(300)] + [[]]
        asked, places, raw = keyword_index.best_of_many(plans, postings, n, k)
        for q, plan in enumerate(plans):
            want = keyword_index.best_of([(t, w) for t, w in plan if t in postings], postings, n, k)
            assert places[asked == q].tolist() == want[0].tolist()
            assert np.allclose(raw[asked == q], want[1])


def test_many_queries_do_not_search_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(keyword_index, "MANY", 1)
    chunks = spark.createDataFrame([(0, "a b"), (1, ""), (2, None), (3, "Cat cat dog"), (4, "dog dog dog bird"), (5, "cat bird")], "chunk_id long, content string")
    queries = spark.createDataFrame([(7, "cat"), (8, "dog bird"), (9, "fish")], "query_id long, query string")
    many = sorted(map(tuple, retrieval.keyword_search(chunks, queries, 2).collect()))
    monkeypatch.setattr(keyword_index, "MANY", 1000)
    assert many == sorted(map(tuple, retrieval.keyword_search(chunks, queries, 2).collect()))
    assert [(x[0], x[2]) for x in many] == [(7, 3), (7, 5), (8, 4), (8, 5)]


def test_vector_search_multiplies_slices_and_keeps_ties(spark):
    """More queries than a slice, copies beyond the wanted number: the smallest ids win."""
    r = np.random.default_rng(8)
    vectors = np.vstack([np.tile(r.normal(size=8), (30, 1)), r.normal(size=(370, 8))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    blocks = retrieval.packed(df).collect()
    pairs = spark.createDataFrame([(b.ids, b.units, b.ids, b.units) for b in blocks], "ids array<bigint>, units binary, ids2 array<bigint>, units2 binary")
    made = {}
    retrieval._products(pairs, lambda a, b, s: ([], []) if len(a) <= retrieval.SLICE else 1 / 0, ("l", "r")).collect()
    for x in retrieval.vector_search(df, df.select(df.vec_id.alias("query_id"), df.embedding.alias("query_vector")), 4).collect():
        made.setdefault(x.query_id, {})[x.rank] = x.vec_id
    m = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    s = np.round(m @ m.T, 9)
    for q, got in made.items():
        assert [got[j] for j in range(1, 5)] == np.lexsort((np.arange(400), -s[q]))[:4].tolist()
    assert len(made) == 400


def test_tables_between_jobs_leave_no_shuffles(spark):
    """The files of the shuffle that made a stored table go with its job."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    spark._jvm.System.gc()
    time.sleep(1)
    before = disk.getAllFiles().size()
    out = stored(spark.range(1000).repartition(3, "id"), "dealt")
    for _ in range(50):
        if disk.getAllFiles().size() <= before:
            break
        time.sleep(0.1)
    assert disk.getAllFiles().size() <= before
    assert out.count() == 1000


@pytest.mark.parametrize("name", ["e9_retrieve", "e15_citations", "e16_citation_snippets"])
def test_chunks_are_derived_once(spark, sf_dir, name):
    """The plan of the result reads stored chunks, not the documents again."""
    from sedge.plans import load

    plan = load().QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "posexplode" not in plan


def test_strategies_are_corpora_of_one_index(spark, sf_dir, monkeypatch):
    """The chunks of both strategies, made of blocks that are dealt once, in one index."""
    from sedge.operators import sections
    from sedge.plans import retrieval as plans
    from sedge.sources import tables

    built, real = [], retrieval.build_index
    monkeypatch.setattr(retrieval, "build_index", lambda chunks, *more: built.append(chunks) or real(chunks, *more))
    plans.strategy_means(spark, sf_dir)
    assert len(built) == 1
    blocks = tables.outline_blocks(spark, sf_dir)
    want = [(s, x.chunk_id, x.content) for s, f in (("sections", sections.section_chunks), ("pages", sections.page_chunks)) for x in f(blocks).select("chunk_id", "content").collect()]
    assert sorted((x.strategy, x.chunk_id, x.content) for x in built[0].collect()) == sorted(want) and want


def test_many_queries_leave_the_best_of_a_task_not_of_a_shard(spark, monkeypatch):
    """Blocks of queries over many shards: the hits of one block, ties and copies of queries
    included, and rows by the tasks; no product of queries and chunks by term."""
    r = random.Random(12)
    words = "ab cd ef gh ij kl mn".split()
    chunks = spark.createDataFrame([(f"c{k:03d}", " ".join(r.choices(words, k=r.randint(0, 5)))) for k in range(200)], "chunk_id string, content string").repartition(2)
    queries = spark.createDataFrame([(f"q{k}", " ".join(r.choices(words, k=2))) for k in range(40)], "query_id string, query string")
    one_by_one = lambda: sorted(map(tuple, retrieval.keyword_search(chunks, queries, 3).collect()))
    monkeypatch.setattr(keyword_index, "MANY", 1000)
    monkeypatch.setattr(retrieval, "MANY", 1000)
    whole = one_by_one()
    for n in ("keyword_index", "retrieval"):
        monkeypatch.setattr(globals()[n], "MANY", 2)
    monkeypatch.setattr(keyword_index, "SHARD", 5)
    index = retrieval.build_index(chunks)
    assert index.rows.where("term IS NULL").count() >= 40
    asked = queries.select("query_id", F.explode(retrieval.terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    tasks = 2 * spark.sparkContext.defaultParallelism
    assert keyword_index.search(index, asked, 3).count() <= 3 * 40 * tasks
    monkeypatch.setattr(retrieval, "CELLS", 5)
    monkeypatch.setattr(retrieval, "MET", 0)
    monkeypatch.setattr(retrieval, "_by_terms", lambda *_: 1 / 0)
    assert sorted(map(tuple, retrieval.search_index(index, queries, 3).collect())) == whole
