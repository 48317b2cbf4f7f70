"""Plug-ins of all kinds, by name."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.operators import chunks as C
from sedge.operators import retrieval
from sedge.operators.registry import register_model, register_strategy, strategy
from sedge.sources import tables


def words(t):
    return len([w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w])


def pieces(t):
    return len(re.findall(r"\w+|[^\w\s]", t))


def test_counters_by_name(spark, sf_dir):
    rows = tables.outline_blocks(spark, sf_dir).limit(300).union(tables.outline_blocks(spark, sf_dir).limit(1).withColumn("content", F.lit("")))
    for name, count in (("words", words), ("pieces", pieces), ("estimate", lambda t: max(1, len(t) // 4) if t else 0)):
        got = rows.select("content", strategy("token_counter", name)(F.col("content")).alias("n")).collect()
        assert all(x.n == count(x.content) for x in got) and len(got) == 301
    with pytest.raises(KeyError, match="estimate, pieces, words"):
        strategy("token_counter", "none such")


@pytest.mark.parametrize("name,count", [("words", words), ("pieces", pieces)])
def test_fixed_chunks_by_a_counter_equal_a_plain_loop(spark, sf_dir, name, count):
    blocks = tables.outline_blocks(spark, sf_dir).where("doc_id < 25")
    got: dict = {}
    for x in C.fixed_chunks(blocks, 60, 45, 8, 10, counter=name).collect():
        got.setdefault(x.doc_id, {})[x.chunk_pos] = (x.content, x.tokens)
    docs: dict = {}
    for x in blocks.orderBy("doc_id", "pos").collect():
        docs.setdefault(x.doc_id, []).append((x.content, count(x.content), x.type in ("table", "code")))
    for doc, items in docs.items():
        groups, held = [], []
        size = lambda g: sum(x[1] for x in g)

        def kept(g):
            out = []
            for x in reversed(g):
                if size(out) + x[1] > 8:
                    break
                out.insert(0, x)
            return out

        for x in items:
            if x[2]:
                groups += [held] * bool(held) + [[x]]
                held = []
                continue
            if held and size(held) + x[1] > 60:
                groups.append(held)
                held = kept(held)
            held = [*held, x]
            if size(held) >= 45:
                groups.append(held)
                held = kept(held)
        if held and size(held) < 10 and groups and not items[-1][2]:
            groups[-1] = groups[-1] + [x for x in held if not any(x is y for y in groups[-1])]
        elif held:
            groups.append(held)
        assert got[doc] == {k: ("\n\n".join(x[0] for x in g), size(g)) for k, g in enumerate(groups)}


def test_recursive_chunks_by_a_counter(spark, sf_dir):
    blocks = tables.outline_blocks(spark, sf_dir).where("doc_id < 25")
    whole = {x.doc_id: x.t for x in blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "").alias("t")).collect()}
    alone = {x.content for x in blocks.where("type IN ('table', 'code')").collect()}
    got: dict = {}
    for x in C.recursive_chunks(blocks, 30, 5, 40, 0, counter="pieces").orderBy("doc_id", "chunk_pos").collect():
        assert x.token_count == pieces(x.content)
        assert x.token_count <= 40 or any(a in x.content for a in alone)
        got[x.doc_id] = got.get(x.doc_id, "") + x.content
    assert {d: re.sub(r"\s", "", t) for d, t in got.items()} == {d: re.sub(r"\s", "", t) for d, t in whole.items()}
    # A text without separators is cut where it has as many tokens as fit.
    one = spark.createDataFrame([(1, 0, "text", ",".join("abcdefghij") * 20)], "doc_id int, pos int, type string, content string")
    cut = [x.content for x in C.recursive_chunks(one, 30, 0, 30, 0, counter="pieces").orderBy("chunk_pos").collect()]
    assert "".join(cut) == ",".join("abcdefghij") * 20 and all(pieces(x) <= 30 for x in cut)


def loop_of_chunks(items, target, least, most, overlap, size):
    """Chunks of one document's (alone, content) in a plain loop."""
    chunks: list[str] = []
    for alone, content in items:
        for piece in [content] if alone else [p.strip() for p in C._recursive(content, target, 0, size) if p.strip()]:
            joined = f"{chunks[-1]}\n\n{piece}" if chunks else ""
            if chunks and size(chunks[-1]) < least and size(joined) <= most:
                chunks[-1] = joined
            else:
                chunks.append(piece)
    out, before = [], ""
    for chunk in chunks:
        tail, room = [], overlap
        for word in reversed(before.split()):
            room -= size(word)
            if room < 0:
                break
            tail.insert(0, word)
        out.append(" ".join(tail) + "\n\n" + chunk if tail else chunk)
        before = chunk
    return out


@pytest.mark.parametrize("name,size", [("estimate", C._size), ("words", words), ("pieces", pieces)])
def test_recursive_chunks_equal_a_plain_loop(spark, sf_dir, name, size):
    blocks = tables.outline_blocks(spark, sf_dir).where("doc_id < 30")
    docs: dict = {}
    for x in blocks.orderBy("doc_id", "pos").collect():
        docs.setdefault(x.doc_id, []).append((x.type in ("table", "code"), x.content))
    for target, least, most, overlap in ((150, 20, 200, 20), (12, 5, 30, 4), (30, 0, 40, 0)):
        got: dict = {}
        for x in C.recursive_chunks(blocks, target, least, most, overlap, name).orderBy("doc_id", "chunk_pos").collect():
            assert x.token_count == size(x.content)
            got.setdefault(x.doc_id, []).append(x.content)
        assert got == {d: loop_of_chunks(items, target, least, most, overlap, size) for d, items in docs.items()}


def test_embedders_are_checked(spark, sf_dir):
    chunks = tables.chunks(spark, sf_dir).limit(50)
    rows = retrieval.embed(chunks, "letters", 64).join(chunks, "chunk_id").collect()
    projection = np.random.default_rng(20240101).normal(size=(1024, 64))
    for x in rows:
        low = x.content.lower()
        v = np.zeros(1024)
        for j in range(len(low) - 2):
            v[zlib.crc32(low[j : j + 3].encode()) % 1024] += 1
        v = v @ projection
        assert np.allclose(x.embedding, v / max(np.linalg.norm(v), 1e-10), atol=1e-5)
    assert {len(x.embedding) for x in retrieval.embed(chunks, "hashed_terms", 256).collect()} == {256}
    with pytest.raises(ValueError, match="64 dimensions, not 65"):
        retrieval.embed(chunks, "letters", 65)
    with pytest.raises(ValueError, match="256 dimensions"):
        retrieval.embed(chunks, "hashed_terms", 3)
    with pytest.raises(KeyError, match="hashed_terms, letters"):
        retrieval.embed(chunks, "unknown")
    register_model("embedder", "wrong", lambda: None, lambda _, t: [[0.0] * 3] * len(t), 4)
    with pytest.raises(Exception, match="another dimension than 4"):
        retrieval.embed(chunks, "wrong").collect()


def test_default_embedding_equals_terms_counted_in_python(spark, sf_dir):
    """Hashed terms by their murmur hash, weighted by rarity, of all chunks."""
    from pyspark.ml.feature import HashingTF

    from sedge.plans.retrieval import hashed_terms

    chunks = tables.chunks(spark, sf_dir)
    place = HashingTF(numFeatures=256).indexOf
    texts = {x.chunk_id: [w for w in re.findall("[a-z]+", x.content.lower()) if len(w) > 1] for x in chunks.collect()}
    bucket = {w: place(w) for w in {w for t in texts.values() for w in t}}
    tf = {}
    for c, t in texts.items():
        tf[c] = np.bincount([bucket[w] for w in t], minlength=256).astype(float)
    m = np.array(list(tf.values()))
    idf = np.log((len(m) + 1) / ((m > 0).sum(0) + 1))
    m = m * idf
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    want = dict(zip(tf, np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)))
    for x in hashed_terms(chunks).collect():
        assert np.allclose(x.embedding, want[x.chunk_id], atol=1e-9)


def test_models_answer_in_batches(spark):
    hits = spark.createDataFrame([(1, "Cats sleep. The red fox ran home! Dogs bark."), (2, ""), (3, "One only")], "query_id int, content string")
    queries = spark.createDataFrame([(1, "where ran the fox"), (2, "x"), (3, "y")], "query_id int, query string")
    packed = hits.select("query_id", F.col("content").alias("context"), F.lit(1).alias("sources"))
    got = {x.query_id: x.answer for x in retrieval.batch_answers(packed, queries, hits, "closest_sentence").collect()}
    assert got == {1: "The red fox ran home!", 2: "", 3: "One only"}
    assert {x.answer for x in retrieval.batch_answers(packed, queries, hits).collect()} == {"Cats sleep.", "", "One only"}
    with pytest.raises(KeyError, match="closest_sentence, first_sentence"):
        retrieval.batch_answers(packed, queries, hits, "no model")


def test_scorers_by_name(spark, sf_dir):
    chunks = tables.chunks(spark, sf_dir)
    register_model("scorer", "short", lambda: 100, lambda most, t: [1.0 if len(x) <= most else 0.5 for x in t])
    rows = C.quality(chunks, {"sentences": 0.5, "short": 0.5}).collect()
    assert all(abs(x.overall - round(0.5 * x.sentences + (0.5 if len(x.content) <= 100 else 0.25), 6)) < 1e-9 for x in rows)
    with pytest.raises(KeyError, match="no scorer named"):
        C.quality(chunks, {"absent": 1.0})
    with pytest.raises(ValueError, match="unknown kind"):
        register_strategy("painter", "x", len)
    with pytest.raises(ValueError, match="dimension"):
        register_model("embedder", "x", len, len)


def test_counters_get_many_texts_at_once():
    """A batch of texts is cut with two calls for each separator at most, and one for
    the texts themselves; as text by text."""
    calls = []

    def many(texts):
        calls.append(len(texts))
        return [len(re.findall(C.PIECES, t)) for t in texts]

    texts = [" ".join(f"word{k % 7}{'.' * (k % 5 == 0)}{',' * (k % 3 == 0)}" for k in range(n)) for n in range(1, 200)]
    got = C._recursive_all(texts, 12, many)
    assert len(calls) <= 2 * len(C.SEPARATORS) + 2 and sum(calls) > 1000
    assert [[p for p, _ in x] for x in got] == [C._recursive(t, 12, 0, lambda t: len(re.findall(C.PIECES, t))) for t in texts]
    assert all(n == len(re.findall(C.PIECES, p)) <= 12 for x in got for p, n in x)
    assert ["".join(p for p, _ in x) for x in got] == texts
