"""Hard negatives, SentencePiece ids and phrases against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from sedge.llm import negatives, phrases, pieces, queries

# ---------------------------------------------------------- hard negatives


def brute_negatives(rows, chosen, positives=5, negatives_=5, share=80):
    """``rows``: {id: (label, ints)}."""
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(rows[a][1], rows[b][1]))
    for a in filter(chosen, rows):
        ranked = sorted((-score(a, b), b) for b in rows if b != a)
        for s, p in [x for x in ranked if rows[x[1]][0] == rows[a][0]][:positives]:
            met = [(t, b) for t, b in ranked if rows[b][0] != rows[a][0] and share * -s <= 100 * -t <= 100 * -s]
            out += [(a, p, k + 1, b, -s, -t) for k, (t, b) in enumerate(met[:negatives_])]
    return sorted(out)


def clustered(r, n, width, labels):
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    out = []
    for i in range(n):
        label = r.randrange(labels)
        v = [c + r.gauss(0, 0.7) for c in centres[r.choice((label, r.randrange(labels)))]]
        norm = math.sqrt(sum(x * x for x in v))
        out.append((i, label, [x / norm for x in v]))
    return out


@pytest.mark.parametrize("rows,anchors,slice_", [(4096, 512, 8), (37, 5, 3), (100, 2, 1)])
def test_negatives_equal_brute_force(spark, monkeypatch, rows, anchors, slice_):
    monkeypatch.setattr(negatives, "ROWS", rows)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "SLICE", slice_)
    data = clustered(random.Random(7), 400, 12, 4)
    # Copies, zeros, opposite vectors and a label with few rows.
    data += [(400 + i, i % 3, data[0][2]) for i in range(60)] + [(500, 0, [0.0] * 12), (510, 9, data[3][2]), (520, 9, [-x for x in data[3][2]]), (530, 8, data[5][2])]
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<float>")
    whole = negatives.whole_rows(df, "vec_id", "embedding", F.col("label"))
    held = {i: (label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in data}
    assert {r.id: (r.label, r.v) for r in whole.collect()} == held
    got = sorted(map(tuple, negatives.mine(whole, F.col("id") % 10 == 0).collect()))
    assert got == brute_negatives(held, lambda i: i % 10 == 0)


def test_negatives_edges(spark):
    inf, nan = float("inf"), float("nan")
    data = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.85, 0.0]), (3, None, [1.0, 1.0]), (4, 2, None), (5, 2, [inf, 1.0]), (6, 2, [nan, 1.0]), (None, 2, [1.0, 0.0]), (8, 2, [None, 1.0]), (9, 2, [0.875]), (10, 2, [])]
    df = spark.createDataFrame([(*x, "own", 1.0) for x in data], "vec_id long, label int, embedding array<double>, id string, score double")
    whole = negatives.whole_rows(df, "vec_id", "embedding", F.col("label"))
    assert sorted(r.id for r in whole.collect()) == [0, 1, 2, 9, 10]
    got = sorted(map(tuple, negatives.mine(whole, F.col("id") == 0).collect()))
    assert got == [(0, 1, 1, 9, 256 * 230, 256 * 224), (0, 1, 2, 2, 256 * 230, 256 * 217)]
    assert negatives.mine(whole.limit(0), F.col("id") == 0).count() == 0
    assert negatives.mine(whole, F.col("id") == 77).count() == 0


def test_join_drops_no_pair_and_leaves_out_dimensions():
    r = np.random.default_rng(3)
    weights = np.linspace(1, 120, 24)
    a, b = ((r.normal(size=(n, 24)) * weights).astype(np.int64) for n in (30, 500))
    exact = a @ b.T
    for threshold in (np.quantile(exact, 0.99, axis=1), np.full(30, -1e18), np.full(30, 1e12)):
        i, j, s = negatives.candidates(a, b, threshold)
        assert {(x, y) for x, y in zip(i.tolist(), j.tolist())} == set(zip(*(x.tolist() for x in np.nonzero(exact >= threshold[:, None]))))
        assert (exact[i, j] == s).all()


def test_huge_components_are_exact_or_raise():
    a = np.array([[1 << 31, 3]])
    i, j, s = negatives.candidates(a, a, np.array([0.0]))
    assert s.tolist() == [(1 << 62) + 9]
    with pytest.raises(OverflowError):
        negatives.candidates(a * 4, a * 4, np.array([0.0]))


def test_negatives_equal_sql(spark, sf_dir, duck, same):
    same(queries.op11_hard_negatives(spark, sf_dir), duck, negatives.oracle_sql())


# ------------------------------------------------------------------- pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path(pieces.VOCABULARY))


@pytest.fixture(scope="module")
def coder():
    return pieces.Encoder(pieces.model(P.path(pieces.VOCABULARY)))


ALPHABETS = ["ab", "abc ", "aeiourstn", "abcdefghijklmnopqrstuvwxyz", "ABCDEFabcdef0123456789+/", "日本語中文字。の", "a ▁", " ", "=-*#", "é́ﬁ Ａ\x00\n\t ", "😀😁a ", "<s>0x41 "]


def test_pieces_equal_library(coder, library):
    r = random.Random(5)
    texts = ["", " ", "  a", "a  b ", "<s> </s> <unk> <0x41>", "﻿", "▁", "▁▁x"]
    for _ in range(300):
        own, n = r.choice(ALPHABETS), r.choice([1, 5, 30, 111, 113, 150, 400, 2000])
        t = "".join(r.choice(own) for _ in range(n))
        texts.append((t[: r.randint(1, 12)] * n)[:n] if r.random() < 0.3 else t)
    for t, got in zip(texts, coder.texts(texts)):
        ids = library.encode(t)
        assert got == ",".join(map(str, ids)), t
        assert coder.model.decode(ids) == library.decode(ids), t


def test_windows_do_not_matter(coder, library, monkeypatch):
    r = random.Random(6)
    for window, shared in ((24, 8), (33, 17), (64, 4)):
        monkeypatch.setattr(pieces, "WINDOW", window)
        monkeypatch.setattr(pieces, "SHARED", shared)
        for own in ALPHABETS:
            t = "".join(r.choice(own) for _ in range(700))
            for text in (t, (t[:7] * 200)):
                assert pieces.Encoder(coder.model).texts([text])[0] == ",".join(map(str, library.encode(text)))


@pytest.mark.parametrize("text", [" " * 200_000, "ab" * 100_000, "x" * 200_000, "".join(random.Random(8).choice("etaoinshrdlu+/=") for _ in range(200_000))])
def test_long_words(coder, library, text):
    assert coder.texts([text])[0] == ",".join(map(str, library.encode(text)))


def test_decoding_of_any_ids(coder, library):
    r = random.Random(9)
    for _ in range(300):
        ids = [r.randrange(3, 600) for _ in range(r.randint(0, 12))]
        assert coder.model.decode(ids) == library.decode(ids), ids


def test_piece_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "日本 \n x"), (5, "word " * 20_000)]
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = pieces.encode_documents(df, keep_ids=True)
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "")
        want[i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want
    assert Counter((r.doc_id, r.text) for r in pieces.decode_ids(got).collect()) == Counter((i, t or "") for i, t in rows)
    assert pieces.encode_documents(df.limit(0)).count() == 0


def test_models_that_normalise_raise(tmp_path):
    with pytest.raises(Exception):
        pieces.Model(str(tmp_path / "none.model"))


# ------------------------------------------------------------------ phrases


def brute_phrases(rows, least=10, most=2000, inside=50):
    counts, n = defaultdict(Counter), Counter()
    low = {c: c + 32 for c in range(65, 91)}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        kept = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= inside * a for q, b in candidates.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(kept)[:most])]
    return sorted(out)


SIZES = [phrases.Sizes(), phrases.Sizes(words=8, pairs=5, tile=4, held=20, codes=50, letters=200, langs=1), phrases.Sizes(words=500, pairs=3, tile=2, held=10, codes=9, letters=50, langs=2, bits=7), phrases.Sizes(words=0, pairs=0, bits=6)]


@pytest.mark.parametrize("sizes", SIZES)
def test_phrases_equal_brute_force(spark, sizes):
    r = random.Random(4)
    words = ["New", "york", "City", "the", "of", "a", "Straße", "É", "x y", "ice", "cream", "\x00", "😀"]
    seps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! ", "\x0b"]
    rows = [(r.choice(["en", "de", None, "und"]), "".join(r.choice(words) + r.choice(seps) for _ in range(r.randint(0, 60)))) for _ in range(150)]
    rows += [("en", "new york city " * 30), ("en", "new york city " * 30), ("fr", None), ("fr", ""), ("one", "same " * 3000), ("", "a b c. " * 12)]
    df = spark.createDataFrame([(*x, "own", 3) for x in rows], "lang string, text string, phrase string, f long")
    got = sorted(map(tuple, phrases.mine(df, sizes=sizes).collect()))
    assert got == brute_phrases(rows)
    assert phrases.mine(df.limit(0), sizes=sizes).count() == 0


def test_phrases_limits(spark):
    rows = [("en", "a b c d e. " * 20), ("en", "q r. " * 15)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, phrases.mine(df, least=12, most=2, inside=100).collect())) == brute_phrases(rows, 12, 2, 100)


def test_scores_pass_64_bits(spark):
    """Counts whose products are beyond 64 bits."""
    big = 3_000_000_019
    words = spark.createDataFrame([("en", "a", big), ("en", "b", big + 2)], "lang string, phrase string, f long")
    pairs = spark.createDataFrame([("en", "a b", big - 5)], "lang string, phrase string, f long")
    row = phrases._scored(words, pairs, pairs.limit(0)).first()
    assert row.score == 10**6 * (big - 5) ** 2 // (big * (big + 2))


def test_phrases_equal_sql(spark, sf_dir, duck, same):
    same(queries.op13_phrases(spark, sf_dir), duck, phrases.oracle_sql())
