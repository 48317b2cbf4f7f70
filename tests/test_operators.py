from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sedge.functions.text import strip
from sedge.operators import chunks as C
from sedge.operators import curriculum, diagnostics, documents, evaluation, feedback, retrieval, sections
from sedge.operators.registry import register_strategy, strategy
from sedge.sources import readers, tables
from sedge.streaming.runs import finished


def jaccard(a, b):
    a, b = set(re.findall(r"\w+", a.lower())), set(re.findall(r"\w+", b.lower()))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_conflicts_equal_all_pairs(spark):
    """Links of classes, of all examples and of new ones, with copies and texts
    without words."""
    r = random.Random(3)
    words = "a b c d e f g".split()
    rows = [(f"e{k:02d}", k % 2, " ".join(r.choices(words, k=r.randint(0, 5))), " ".join(r.choices(words, k=r.randint(0, 4)))) for k in range(80)]
    rows += [(f"f{k:02d}", 0, "one question for all", f"answer {k} {'x' * k}") for k in range(20)]
    df = spark.createDataFrame(rows, "example_id string, discipline int, question string, answer string")
    sets = lambda x: (x[1], frozenset(re.findall(r"\w+", x[2].lower())), frozenset(re.findall(r"\w+", x[3].lower())))
    classes: dict = {}
    for x in rows:
        classes.setdefault(sets(x), x)
    links = {k: sum(k != m and k[0] == m[0] and jaccard(x[2], y[2]) >= 0.7 and jaccard(x[3], y[3]) < 0.7 for m, y in classes.items()) for k, x in classes.items()}
    want = {x[0]: (classes[sets(x)][0], links[sets(x)]) for x in rows}
    assert {x.example_id: (x.class_id, x.links) for x in curriculum.conflicts(df).collect()} == want
    new = curriculum.conflicts(df, new=F.col("example_id").startswith("f")).collect()
    assert {x.example_id: (x.class_id, x.links) for x in new} == {i: v for i, v in want.items() if i.startswith("f")}


def greedy(items, most, target, overlap, least):
    """Chunks of (pos, tokens, alone) items, in plain Python."""
    out, held = [], []
    size = lambda: sum(t for _, t, _ in held)

    def tail():
        kept = []
        for x in reversed(held):
            if sum(t for _, t, _ in kept) + x[1] > overlap:
                break
            kept.insert(0, x)
        return kept if overlap else []

    for x in items:
        if x[2]:
            out += [[p for p, _, _ in held]] * bool(held) + [[x[0]]]
            held = []
            continue
        if held and size() + x[1] > most:
            out.append([p for p, _, _ in held])
            held = tail()
        held.append(x)
        if size() >= target:
            out.append([p for p, _, _ in held])
            held = tail()
    if held:
        if size() < least and out and not items[-1][2]:
            out[-1] = sorted({*out[-1], *(p for p, _, _ in held)})
        else:
            out.append([p for p, _, _ in held])
    return out


def test_packing_equals_a_plain_loop(spark):
    r = random.Random(4)
    docs = {d: [(p, r.randint(0, 60), r.random() < 0.1) for p in range(r.randint(1, 25))] for d in range(40)}
    rows = [(d, p, t, "table" if alone else "text") for d, items in docs.items() for p, t, alone in items]
    df = spark.createDataFrame(rows, "doc_id long, pos int, tokens long, type string").repartition(3)
    for most, target, overlap, least in ((120, 90, 0, 0), (100, 100, 25, 15), (60, 40, 30, 30)):
        got: dict = {}
        for x in C.pack(df, most, target, overlap=overlap, min_tokens=least).collect():
            got.setdefault(x.doc_id, {}).setdefault(x.group_no, []).append(x.pos)
        assert {d: [sorted(g[k]) for k in sorted(g)] for d, g in got.items()} == {d: greedy(items, most, target, overlap, least) for d, items in docs.items()}


def test_fixed_chunks_hold_their_blocks(spark, sf_dir):
    blocks = tables.outline_blocks(spark, sf_dir)
    text = {(x.doc_id, x.pos): x.content for x in blocks.select("doc_id", "pos", "content").collect()}
    groups: dict = {}
    for x in C.pack(blocks, 200, 150, overlap=20, min_tokens=20).collect():
        groups.setdefault((x.doc_id, x.group_no), []).append(x.pos)
    made = {(x.doc_id, x.chunk_pos): x.content for x in C.fixed_chunks(blocks).collect()}
    assert made == {k: "\n\n".join(text[k[0], p] for p in sorted(ps)) for k, ps in groups.items()}


def test_hierarchy_chunks_keep_words_and_limits(spark, sf_dir):
    blocks = tables.outline_blocks(spark, sf_dir)
    words = lambda rows: {d: sum((c.split() for _, c in sorted(v)), []) for d, v in rows.items()}
    whole: dict = {}
    for x in blocks.collect():
        whole.setdefault(x.doc_id, []).append((x.pos, x.content))
    made: dict = {}
    for x in C.hierarchy_chunks(blocks).collect():
        made.setdefault(x.doc_id, []).append((x.chunk_pos, x.content))
        assert x.token_count <= 400 + 2 or "|---|" in x.content or "\n\n" not in x.content
    assert words(made) == words(whole)


def test_recursive_pieces_hold_the_whole_text():
    r = random.Random(6)
    for _ in range(300):
        text = "".join(r.choice(["ab", "c. ", "d! ", " ", "\n", "\n\n", ", ", "x" * 30, "; "]) for _ in range(r.randint(0, 60)))
        pieces = C._recursive(text, 8)
        assert "".join("".join(pieces).split()) == "".join(text.split())
        # Pieces join while the sum of their rounded sizes fits.
        assert all(max(1, len(p) // 4) <= 16 for p in pieces)


def test_recursive_chunks_merge_and_overlap(spark):
    rows = [(1, 0, "text", "one two three. " * 6), (1, 1, "table", "| a | b |"), (1, 2, "text", "tiny"), (1, 3, "text", "more words here to follow the tiny one")]
    df = spark.createDataFrame(rows, "doc_id long, pos int, type string, content string")
    got = [x.content for x in C.recursive_chunks(df, target=10, min_tokens=4, max_tokens=30, overlap=3).orderBy("chunk_pos").collect()]
    line = "one two three. one two three. one two three."
    # The table is under the least size, so what follows joins it, and so does the next.
    tail = "| a | b |\n\ntiny\n\nmore words here to follow the tiny one"
    assert got == [line, f"one two three.\n\n{line}", f"one two three.\n\n{tail}"]
    plain = [x.content for x in C.recursive_chunks(df, target=10, min_tokens=0, max_tokens=30, overlap=0).orderBy("chunk_pos").collect()]
    assert plain[-3:] == ["| a | b |", "tiny", "more words here to follow the tiny one"]


def test_overlap_is_the_last_words_that_fit(spark, sf_dir):
    chunks = tables.chunks(spark, sf_dir)
    by: dict = {}
    for x in C.add_overlap(chunks, 20).select("doc_id", "chunk_pos", "content", "overlapped").collect():
        by.setdefault(x.doc_id, []).append(x)
    for rows in by.values():
        before = None
        for x in sorted(rows, key=lambda x: x.chunk_pos):
            tail, room = [], 20
            for w in reversed((before or "").split()):
                room -= max(1, len(w) // 4)
                if room < 0:
                    break
                tail.insert(0, w)
            assert x.overlapped == (" ".join(tail) + "\n\n" + x.content if tail else x.content)
            before = x.content


def test_merge_small_is_a_left_fold(spark):
    rows = [(1, k, t) for k, t in enumerate([5, 5, 30, 3, 400, 1])]
    got = [x.merged_no for x in C.merge_small(spark.createDataFrame(rows, "doc_id long, chunk_pos int, token_count long")).orderBy("chunk_pos").collect()]
    assert got == [0, 0, 0, 1, 2, 3]


def test_numbered_lists_of_any_width(spark):
    texts = {"wide": "1. a\n2. b\n20000. c", "long": "1. a\n12345678901. b", "even": "3. a\n4) b\n5. c", "same": "7. a\n7. b", "huge": f"1{'0' * 60}. a", "zeros": "01. a\n002. b", "none": "x 1. a"}
    df = spark.createDataFrame([(1, k, n, t, 99) for n, (k, t) in enumerate(texts.items())], "doc_id long, chunk_id string, chunk_pos int, content string, token_count long")
    got: dict = {}
    for x in diagnostics.diagnose(df, ("list_start", "list_gaps")).collect():
        got.setdefault(x.chunk_id, set()).add(x.kind)
    assert got == {"wide": {"list_gaps"}, "long": {"list_gaps"}, "even": {"list_start"}, "same": {"list_start"}, "huge": {"list_start"}}


def test_splits_at_headings_and_paragraphs(spark):
    texts = {"heads": "intro text\n1.1 first\nbody\n1.2 second\nmore\n1.3 third\nend", "caps": "PART ONE\nx\nPART TWO:\ny", "plain": "abcdefgh", "paras": "aaaa bbbb\n\ncccc dddd\n\neeee ffff\n\ngggg hhhh"}
    df = spark.createDataFrame([(k, t, max(1, len(t) // 4)) for k, t in texts.items()], "k string, content string, token_count long")
    at, sure = diagnostics.split_point(F.col("content"), F.col("token_count"))
    got = {x.k: (texts[x.k][x.at :].strip()[:8], x.sure) for x in df.select("k", at.alias("at"), sure.alias("sure")).collect()}
    assert got == {"heads": ("1.2 seco", 0.8), "caps": ("PART TWO", 0.8), "plain": ("efgh", 0.5), "paras": ("cccc ddd", 0.7)}


def test_trees_of_any_depth(spark):
    """Chains, cycles of many nodes and what hangs below them, missing parents, a hub."""
    chain, ring = [(1, None)] + [(k, k - 1) for k in range(2, 201)], [(1000 + k, 1000 + (k + 1) % 70) for k in range(70)]
    rows = chain + ring + [(2000, 1003), (3000, 9999), (5000, 5000)] + [(6000 + k, 3000) for k in range(40)]
    df = spark.createDataFrame(rows, "competency long, parent long")
    got = {x.competency: x for x in curriculum.tree(df).collect()}
    up = dict(rows)
    for node in up:
        line, seen = [node], {node}
        while up[line[-1]] in up and up[line[-1]] not in seen:
            line.append(up[line[-1]])
            seen.add(line[-1])
        cycle = up[line[-1]] in seen
        x = got[node]
        assert (x.depth, x.path, x.root, x.cycle) == (len(line) - 1, "/".join(map(str, reversed(line))), line[-1], cycle)
    assert got[1].descendants == 199 and got[3000].descendants == 40 and got[200].descendants == 0


def test_headings_of_deep_levels_have_paths(spark):
    rows = [(1, k, f"1:{k}", "heading", f"h{k}", k + 1, 1) for k in range(10)] + [(1, 10, "1:10", "text", "body", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, block_id string, type string, content string, heading_level int, page int")
    made = sections.section_table(df)
    assert {x.path for x in made.where("section_no = 10").collect()} == {" > ".join(f"h{k}" for k in range(10))}
    assert {(x.issue, x.severity) for x in sections.tree_issues(made).where("section_no IS NULL").collect()} == {("too_deep", "warning")}
    assert [x.child_count for x in made.orderBy("section_no").collect()] == [1] * 9 + [0]


def test_first_of_equals_sorting(spark, monkeypatch):
    """Groups of all sizes, quotas of none and of all, several rows a bucket."""
    from hashlib import md5

    monkeypatch.setattr(curriculum, "BUCKET_DIGITS", 1)
    r = random.Random(8)
    rows = [(f"e{k}", r.randrange(4)) for k in range(300)]
    quota = [(0, 0), (1, 7), (2, 60), (3, 999)]
    got = {x.example_id for x in curriculum.first_of(spark.createDataFrame(rows, "example_id string, g int"), ("g",), spark.createDataFrame(quota, "g int, quota long")).collect()}
    want = set()
    for g, n in quota:
        want |= set(sorted((i for i, k in rows if k == g), key=lambda i: (md5(f"42:{i}".encode()).hexdigest(), i))[:n])
    assert got == want


def test_plateau_needs_patience(spark):
    points = [(1, k, 1.0 if k > 3 else 5.0 - k, None, 1.0) for k in range(10)]
    df = spark.createDataFrame(points, "run_id int, idx int, train_loss double, val_loss double, gradient_norm double")
    assert [x.start for x in evaluation.plateaus(df).collect()] == [4]


def test_rejections_without_a_score_go_to_the_curriculum(spark):
    df = spark.createDataFrame([(1, "rejected", None), (2, "rejected", 0.4), (3, "rejected", 0.5), (4, "rephrased", None)], "signal_id int, signal_type string, citation_score double")
    got = {x.signal_id: (x.target, x.priority) for x in feedback.route(df).collect()}
    assert got == {1: ("curriculum", "medium"), 2: ("retrieval", "medium"), 3: ("curriculum", "medium"), 4: ("retrieval", "medium")}


def test_registry_names_what_there_is():
    register_strategy("scorer", "own", len)
    assert strategy("scorer", "own") is len
    with pytest.raises(KeyError, match="own"):
        strategy("scorer", "other")
    with pytest.raises(ValueError):
        register_strategy("toaster", "x", len)


def test_texts_fall_back_to_latin_1(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("café".encode("latin-1"))
    (tmp_path / "b.TXT").write_bytes("café".encode())
    (tmp_path / "c.pdf").write_bytes(b"no")
    files = readers.scan_files(spark, str(tmp_path))
    assert {x.rejected for x in files.where("format = 'pdf'").collect()} == {"not a PDF"}
    got = {x.path[-5:]: (x.text, x.warning) for x in readers.read_texts(files).collect()}
    assert got["a.txt"] == ("café", "decoded as Latin-1") and got["b.TXT"] == ("café", None)


def test_project_tables(spark, tmp_path):
    (tmp_path / "p.json").write_text(
        '{"id": "p", "documents": [{"id": "d", "source_path": "x", "blocks": [{"id": "b", "type": "text", "content": "c", "page": 1}], '
        '"chunks": [{"id": "k", "block_ids": ["b"], "content": "c", "token_count": 1}]}], "test_suites": [{"id": "s", "name": "n", "queries": [{"id": "q", "query": "?", "expected_chunk_ids": ["k"]}]}]}'
    )
    made = readers.read_project(spark, str(tmp_path))
    assert {k: v.count() for k, v in made.items()} == {"documents": 1, "blocks": 1, "chunks": 1, "queries": 1}


def test_orphans_join_the_section_above(spark):
    r = random.Random(5)
    rows, expected = [], {}
    for doc in range(60):
        stack, section, blocks = [], 0, []
        for pos in range(r.randint(1, 14)):
            kind = r.choice(("heading", "heading", "text"))
            blocks.append((doc, pos, f"{doc}:{pos}", kind, f"t{pos}", r.randint(1, 6) if kind == "heading" else None))
        for k, b in enumerate(blocks):
            if b[3] == "heading":
                section += 1
                while stack and stack[-1][0] >= b[5]:
                    stack.pop()
                after = blocks[k + 1] if k + 1 < len(blocks) else None
                orphan = after is None or (after[3] == "heading" and after[5] <= b[5])
                expected[b[2]] = ("text", True, stack[-1][1] if stack else 0) if orphan else ("heading", False, section)
                stack.append((b[5], section))
            else:
                expected[b[2]] = ("text", False, section)
        rows += blocks
    df = spark.createDataFrame(rows, "doc_id long, pos int, block_id string, type string, content string, heading_level int")
    got = {x.block_id: (x.type, x.repaired, x.section_no) for x in sections.repair_orphans(df).collect()}
    assert got == expected


def test_rollback_needs_two_versions(spark):
    rows = [("a", 1, True), ("b", 1, True), ("b", 2, False), ("b", 3, True), ("c", 1, False)]
    out = evaluation.active_versions(spark.createDataFrame(rows, "discipline string, version int, activated boolean")).collect()
    got = {(x.discipline, x.version): (x.active, x.active_after_rollback) for x in out}
    assert got == {("a", 1): (True, True), ("b", 1): (False, False), ("b", 2): (False, True), ("b", 3): (True, False), ("c", 1): (False, False)}


def test_retraining_is_due_without_a_model(spark):
    labels = spark.createDataFrame([(0, 1), (1, 2), (1, 3)], "label int, seq long")
    none = spark.createDataFrame([], "trained_at long")
    plan = lambda m: {x.label: (x.synthetic, x.manual, x.since, x.due) for x in documents.retrain_plan(labels.select("label"), labels, m).collect()}
    assert plan(none) == {0: (1, 1, 1, True), 1: (2, 2, 2, True)}
    assert plan(spark.createDataFrame([(2,)], "trained_at long")) == {0: (1, 1, 0, False), 1: (2, 2, 1, False)}


def test_pages_in_two_columns(spark):
    box = "doc_id long, page int, x1 double, x2 double, y1 double, y2 double, page_width double, page_height double"
    rows = [(1, 1, 10.0, 90.0, 0.0, 50.0, 300.0, 400.0), (1, 1, 220.0, 290.0, 0.0, 60.0, 300.0, 400.0), (2, 1, 10.0, 290.0, 5.0, 50.0, 300.0, 400.0)]
    got = {x.doc_id: (x.estimated_columns, x.margin_left, x.margin_right, x.margin_bottom) for x in documents.layout_features(spark.createDataFrame(rows, box)).collect()}
    assert got == {1: (2, 10.0, 10.0, 340.0), 2: (1, 10.0, 10.0, 350.0)}


def test_next_version_and_its_snapshot(spark):
    rows = spark.createDataFrame([("x", 0, False), ("y", 0, True), ("z", 1, False)], "example_id string, discipline int, is_test_set boolean")
    old = spark.createDataFrame([(0, 4), (0, 2)], "discipline int, version int")
    assert {(x.example_id, x.version) for x in curriculum.new_version(rows, old).collect()} == {("x", 5), ("z", 1)}


def test_keyword_search_counts_words_once(spark):
    chunks = spark.createDataFrame([("c1", "red red fox"), ("c2", "red hen"), ("c3", None), ("c4", "")], "chunk_id string, content string")
    queries = spark.createDataFrame([(1, "Red fox"), (2, "absent")], "query_id int, query string")
    got = [(x.query_id, x.chunk_id) for x in retrieval.keyword_search(chunks, queries).orderBy("query_id", "rank").collect()]
    assert got == [(1, "c1"), (1, "c2")]


def test_large_query_sets_meet_chunks_by_term(spark, monkeypatch):
    """Matrices, blocks of queries and joins give the same hits, ties included."""
    r = random.Random(9)
    words = "ab cd ef gh ij kl".split()
    chunks = spark.createDataFrame([(f"c{k:03d}", " ".join(r.choices(words, k=r.randint(0, 6))), k % 3) for k in range(150)], "chunk_id string, content string, slot int").repartition(5)
    queries = spark.createDataFrame([(k, " ".join(r.choices(words, k=r.randint(0, 4)))) for k in range(30)], "query_id int, query string")
    for by in (None, "slot"):
        run = lambda: sorted(map(tuple, retrieval.keyword_search(chunks, queries, 4, by).collect()), key=str)  # noqa: B023, E731
        monkeypatch.setattr(retrieval, "CELLS", 4_000_000)
        whole = run()
        monkeypatch.setattr(retrieval, "CELLS", 50)
        assert run() == whole
        monkeypatch.setattr(retrieval, "CELLS", 0.001)
        assert run() == whole


def test_vectors_in_small_blocks_equal_all_pairs(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 7)
    monkeypatch.setattr(retrieval.packed, "__defaults__", ("vec_id", "embedding", 7))
    monkeypatch.setattr(retrieval.near_blocks, "__defaults__", (7,))
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 5))
    rows = [(k, [float(x) for x in (base[k % 12] + rng.normal(0, 0.2, 5)).round(3)]) for k in range(60)] + [(100 + k, [1.0, 0.0, 0.0, 0.0, 0.0]) for k in range(9)] + [(200, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    unit = {i: np.float32(v).astype(float) for i, v in rows}
    unit = {i: v / max(np.linalg.norm(v), 1e-10) for i, v in unit.items()}
    lead: dict = {}
    for i, v in rows:
        lead.setdefault(tuple(v), []).append(i)
    want = {}
    for x, xs in lead.items():
        for y, ys in lead.items():
            if xs[0] < ys[0] and unit[xs[0]] @ unit[ys[0]] >= 0.8:
                want[xs[0], ys[0]] = (len(xs), len(ys))
    assert {(x.a, x.b): (x.n_a, x.n_b) for x in retrieval.similar_pairs(df).collect()} == want
    queries = df.where("vec_id % 20 = 0").withColumnsRenamed({"vec_id": "query_id", "embedding": "query_vector"})
    got = {(x.query_id, x.rank): x.vec_id for x in retrieval.vector_search(df, queries, 4).collect()}
    for q in (k for k, _ in rows if k % 20 == 0):
        order = sorted((i for i, _ in rows), key=lambda i: (-round(float(unit[q] @ unit[i]), 9), i))[:4]
        assert [got[q, n + 1] for n in range(4)] == order
    near = {(x.query_id, x.vec_id) for x in retrieval.similar_to(df, queries).collect()}
    assert near == {(q, i) for q, _ in rows if q % 20 == 0 for i, _ in rows if i != q and unit[q] @ unit[i] >= 0.8}


def test_embeddings_are_unit_vectors_of_terms(spark):
    from sedge.plans.retrieval import hashed_terms

    rows = [("a", "red fox"), ("b", "red fox red fox"), ("c", "blue hen"), ("d", "")]
    got = {x.chunk_id: x.embedding for x in hashed_terms(spark.createDataFrame(rows, "chunk_id string, content string")).collect()}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    assert norm(got["a"]) == pytest.approx(1) and norm(got["d"]) == 0 and got["a"] == pytest.approx(got["b"])
    assert sum(x * y for x, y in zip(got["a"], got["c"])) == pytest.approx(0)


def test_classifier_sees_every_document(spark, sf_dir):
    from sedge.plans import load

    q = load().QUERIES
    docs = {x.doc_id for x in tables.table(spark, sf_dir, "documents").select("doc_id").collect()}
    found = q["i9_predict_type"](spark, sf_dir).collect()
    assert {x.doc_id for x in found} == docs and len(found) == len(docs)
    for x in found:
        assert sum(x.probabilities) == pytest.approx(1) and x.confidence == max(x.probabilities)
        assert x.predicted == ("unknown" if x.confidence < 0.45 else str(x.probabilities.index(x.confidence)))
    for x in q["i12_unknown_queue"](spark, sf_dir).collect():
        assert x.confidence < 0.6 and [t.probability for t in x.top] == sorted((t.probability for t in x.top), reverse=True) and x.top[0].probability == x.confidence
    weights = q["i10_feature_importance"](spark, sf_dir).collect()
    assert len(weights) == 49 and sum(x.importance for x in weights) == pytest.approx(1) and [x.place for x in weights] == list(range(1, 50))
    assert {x.feature for x in weights} == set(documents.NAMES)


def test_every_labelled_document_is_in_one_fold(spark, sf_dir):
    from sedge.plans import load

    q = load().QUERIES
    labels = tables.table(spark, sf_dir, "labels").join(tables.table(spark, sf_dir, "documents").select("doc_id"), "doc_id").count()
    matrix = q["i11_cross_validate"](spark, sf_dir).collect()
    assert sum(x.n for x in matrix) == labels and {x.fold for x in matrix} == set(range(5))
    report = {x.label: x for x in documents.fold_report(spark.createDataFrame(matrix)).collect()}
    assert report[None].accuracy == pytest.approx(sum(x.n for x in matrix if x.label == x.predicted) / labels)
    assert sum(x.n for x in q["i8_train_classifier"](spark, sf_dir).collect()) == labels


def test_synthetic_rows_are_clipped(spark, sf_dir):
    from sedge.plans import load

    rows = load().QUERIES["i7_synthetic_corpus"](spark, sf_dir).collect()
    assert {x.label for x in rows} == {0, 1} and len(rows) == 80 and all(0 <= x.upper_share <= 1 for x in rows)


def test_a_share_of_labelled_rows_is_fitted(spark):
    rows = [(k, [float(k % 2), float(k % 5)], k % 2) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, features array<double>, label int")
    model = documents.fitted(df, trees=3, depth=2, most=100)
    assert all(x.predicted == str(x.doc_id % 2) for x in documents.predicted(model, df, 0.0).collect())


def test_lines_have_their_numbers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"q": "x", "a": "y"}\nnot json\n\n{"q": "x"}\n[1]\n')
    (tmp_path / "b.jsonl").write_text('{"q": "x", "a": " "}\n' * 3)
    lines = readers.numbered_lines(spark, str(tmp_path))
    assert sorted((x.file[-7], x.line) for x in lines.collect()) == [("a", k) for k in range(1, 6)] + [("b", k) for k in range(1, 4)]
    got = {(x.file[-7], x.line, x.reason) for x in readers.validate_jsonl(lines, ["q", "a"], 3).collect()}
    assert got == {("a", 2, "not an object"), ("a", 4, "missing: a"), ("a", 5, "not an object"), ("a", None, "too many records"), *(("b", k, "missing: a") for k in (1, 2, 3))}


def test_listing_does_not_read_contents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x" * 50)
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "c.PDF").write_bytes(b"no")
    (tmp_path / "d.pdf").write_bytes(b"no" * 40)
    (tmp_path / "e.bin").write_bytes(b"x")
    found = readers.scan_files(spark, str(tmp_path), 40).select("path", "format", "rejected")
    assert "content" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[-1].split("\n")[1]
    got = {x.path[-5:]: x.rejected for x in found.collect()}
    assert got == {"a.txt": "too large", "b.pdf": None, "c.PDF": "not a PDF", "d.pdf": "too large", "e.bin": "unknown extension"}


def test_a_shared_folder_is_needed_on_clusters(spark, monkeypatch):
    from sedge.sources import shared

    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: None)
    assert shared.shared_folder(spark, "x").startswith("file:///tmp/")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(spark, "x")


def test_large_texts_are_read_by_lines(spark, tmp_path):
    want = {"ended.txt": "one\ntwo é\n\nthree\r\n", "open.txt": "one\n\ntwo", "small.txt": "x"}
    for name, text in want.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "latin.txt").write_bytes("plain line\ncafé au lait\n".encode("latin-1"))
    want["latin.txt"] = "plain line\ncafé au lait\n"
    rows = readers.read_texts(readers.scan_files(spark, str(tmp_path), 5), 5).collect()
    got = {}
    for x in rows:
        got.setdefault(x.path.rsplit("/", 1)[1], []).append(x.text)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted([p for p in re.split(r"(?<=\n)", t) if p]) for k, t in want.items()}
    assert {x.path.rsplit("/", 1)[1] for x in rows if x.warning} == {"latin.txt"}


def test_stream_keeps_every_signal_in_any_order(spark, tmp_path):
    """Twelve files of four batches' worth, newest first, with late repeats."""
    path = str(tmp_path / "signals.parquet")
    for k in range(12):
        ids = [10 * k + j for j in range(10)] + ([3] if k == 9 else [])
        rows = spark.createDataFrame([(i, 30 - k) for i in ids], "signal_id long, day int")
        rows.selectExpr("signal_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, day) AS ts").coalesce(1).write.mode("append").parquet(path)
    out = finished(feedback.first_of_each_stream(readers.stream_of(spark, path)), "test_signals")
    assert sorted(x.signal_id for x in out.collect()) == list(range(120))


def test_sentences_are_cut_in_one_pass(spark):
    """As the definition says, and in time that does not grow with the square of the
    number of sentences."""
    texts = ["", " ", "a", "a.", "a. ", "a.\n\n b", "a... b?! c", " . . x", "a.b. c\t\td.  e", "no stop at all"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", C.split_sentences(F.col("t")).alias("s")).collect()
    for x in got:
        parts = re.split(r"(?<=[.!?])\s+", texts[x.k])
        assert x.s == [*(p + " " for p in parts[:-1]), parts[-1]]
    began = time.time()
    long = spark.range(1).select(F.repeat(F.lit("one sentence of some words, which ends here.  "), 20_000).alias("t"))
    assert long.select(F.size(C.split_sentences(F.col("t")))).first()[0] == 20_001
    assert time.time() - began < 20


def test_references_and_ends_of_texts(spark):
    """References are found in one scan as by each pattern, ends are stripped of what
    the pattern takes, and what rules share is made once."""
    texts = ["see below", "Belows", "xbelow", "As  noted", "it is AS NOTED: above", "previously", "seen section", "(see table  4)", "see table x", "\x0b\t a b \f\r\n", " x ", " \n ", "", "hence, so", " \n Hence", "Therefor"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    kinds = (diagnostics.FORWARD, diagnostics.BACKWARD, diagnostics.ASK_FORWARD, diagnostics.ASK_BACKWARD)
    rows = df.select("k", *[diagnostics.any_match(F.col("t"), p).alias(f"m{n}") for n, p in enumerate(kinds)], strip(F.col("t")).alias("s"), diagnostics.connective(strip(F.col("t"))).alias("w"))
    for x in rows.collect():
        t = texts[x.k]
        assert [x[f"m{n}"] for n in range(4)] == [any(re.search(f"(?ai){p}", t) for p in ps) for ps in kinds]
        assert x.s == re.sub(r"^\s+|\s+$", "", t, flags=re.A)
        assert x.w == x.s.lower().startswith(diagnostics.CONNECTIVES)
    chunks = spark.createDataFrame([(1, 0, "1-0", " 3. a text as noted", 5)], "doc_id long, chunk_pos int, chunk_id string, content string, token_count long")
    plan = diagnostics.questions(chunks, "reference")._jdf.queryExecution().optimizedPlan().toString()
    assert "What is the main topic" not in plan and plan.count("as noted") <= 2
