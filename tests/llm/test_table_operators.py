"""Operators that shuffle: SimHash, mixing, archives, HTML, the pipeline."""

from __future__ import annotations

import random
import time
import re
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_pii
from xxhash import xxh64_intdigest

from sedge.llm import html_main, mixing, pii, queries, simhash, warc
from sedge.llm.components import components

# ------------------------------------------------------------------ SimHash


def brute_fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                up[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(7)
    base = [" ".join(r.choice(["alpha", "Beta", "gamma", "Delta", "eps"]) for _ in range(60)) for _ in range(12)]
    rows = [(1, None), (2, ""), (3, "\n "), (4, "One two"), (5, "one TWO"), (None, "one two"), (6, "z" * 20_000)]
    for k in range(150):
        words = r.choice(base).split()
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = r.choice(["alpha", "zeta", "x"])
        rows.append((k + 10, " ".join(words)))
    rows += rows[-5:]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = simhash.near_duplicates(df).collect()
    fps = [(i, brute_fingerprint(t or "")) for i, t in rows]
    roots = classes({f for _, f in fps}, lambda a, b: (a ^ b).bit_count() <= 3)
    least = defaultdict(lambda: None)
    for i, f in fps:
        if i is not None and (least[roots[f]] is None or i < least[roots[f]]):
            least[roots[f]] = i
    want = Counter((i, f"{f:016x}", least[roots[f]]) for i, f in fps)
    assert Counter(map(tuple, got)) == want


def test_one_row_of_each_component_stays(spark, monkeypatch):
    """Ids repeat, lack or belong to unrelated texts; whole rows repeat."""
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(1, words(0), "a"), (5, words(0), "b"), (5, words(1), "c"), (None, words(2), "d"), (None, words(2), "e"), (None, words(1), "f"), (7, words(3), "g"), (7, words(3), "h")]
    rows += [(9, words(4), "i")] * 40 + [(10, None, "j"), (11, "", "k")] * 2 + [(12, words(4), "l")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(5)
    best: dict = {}
    for row in rows:
        fp = brute_fingerprint(row[1] or "")
        best.setdefault(fp, []).append(row)
    for hot in (1000, 10):
        monkeypatch.setattr(simhash, "HOT", hot)
        kept = simhash.one_of_each(df)
        assert kept.columns == df.columns
        got = Counter(map(tuple, kept.collect()))
        assert len(got) == len(best) and set(got.values()) == {1}
        for row in got:
            group = best[brute_fingerprint(row[1] or "")]
            assert row in group and row[0] == min((x[0] for x in group if x[0] is not None), default=None)
    assert simhash.one_of_each(df.limit(0)).count() == 0 and simhash.near_duplicates(df.limit(0)).count() == 0


def test_links_at_every_distance(spark):
    """Fingerprints at one to four bits, in all segments, link up to three."""
    r = random.Random(8)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    fps = set()
    for _ in range(40):
        f = r.getrandbits(64)
        fps |= {f, *(f ^ sum(1 << b for b in r.sample(range(64), d)) for d in (1, 2, 3, 4))}
    df = spark.createDataFrame([(sign(f),) for f in fps], "fp long")
    near = components(simhash.near_links(df)).withColumnsRenamed({"node": "fp", "component": "near"})
    nodes = df.join(near, "fp", "left").select("fp", F.coalesce("near", "fp").alias("grp"))
    far = components(simhash.far_links(nodes)).withColumnsRenamed({"node": "grp", "component": "whole"})
    got = {x.fp: x.w for x in nodes.join(far, "grp", "left").select("fp", F.coalesce("whole", "grp").alias("w")).collect()}
    roots = classes(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    pairs = lambda m: {frozenset(k for k, v in m.items() if v == w) for w in set(m.values())}
    assert pairs({sign(k): v for k, v in roots.items()}) == pairs(got)


def test_components_of_long_paths(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1001)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(301)) and got[1001] == got[1000] == 1000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------- mixing


def test_raked_marginals_meet_targets(spark):
    r = random.Random(9)
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", float(r.randint(1, 900))) for i in range(5) for j in range(3) for k in range(2)], "__k0 string, __k1 string, __k2 string, w double")
    rows = mixing.raked(cells.coalesce(1), 3, cycles=16).collect()
    total = sum(x.w for x in rows)
    for n in range(3):
        before, after = Counter(), Counter()
        for x in rows:
            before[x[n]] += x.w
            after[x[n]] += x.w * x.f
        powers = {k: (v / total) ** mixing.TEMPER for k, v in before.items()}
        for k in before:
            assert after[k] / total == pytest.approx(powers[k] / sum(powers.values()), rel=1e-4)
    c = mixing.constant(mixing.raked(cells.coalesce(1), 3), 0.8)
    assert sum(x.w * min(1, x.f * c) for x in mixing.raked(cells.coalesce(1), 3).collect()) == pytest.approx(0.8 * total)


def test_given_targets(spark):
    cells = spark.createDataFrame([("a", 10.0), ("b", 90.0)], "__k0 string, w double")
    target = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "value string, share double")
    got = {x[0]: x.w * x.f for x in mixing.raked(cells.coalesce(1), 1, {0: target}).collect()}
    assert got == {"a": pytest.approx(50), "b": pytest.approx(50)}


def test_more_cells_than_one_task_takes(spark, monkeypatch):
    r = random.Random(11)
    rows = [(k, r.choice("aab"), r.choice("xyz"), float(r.randint(1, 50))) for k in range(200)] + [(None, None, "x", 5.0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n double")
    run = lambda: sorted((str(x.row.doc_id), round(x.factor, 9), round(x.probability, 9), x.in_sample) for x in mixing.sampled(df, "n", ("source", "lang")).collect())
    few = run()
    monkeypatch.setattr(mixing, "CELLS_AT_ONCE", 0)
    assert run() == few


def test_raking_goes_on_until_targets_are_met(spark):
    """Cells that are far from the targets need many cycles; targets that no
    weights meet end with a warning."""
    cells = spark.createDataFrame([("a", "x", 92.0), ("a", "y", 2.0), ("b", "x", 2.0), ("b", "y", 4.0)], "__k0 string, __k1 string, w double")
    half = lambda a, b: spark.createDataFrame([(a, 0.5), (b, 0.5)], "value string, share double")
    got = mixing.raked(cells.coalesce(1), 2, {0: half("a", "b"), 1: half("x", "y")}).collect()
    for k in (0, 1):
        for v in {x[k] for x in got}:
            assert sum(x.w * x.f for x in got if x[k] == v) / 100 == pytest.approx(0.5, abs=1e-8)
    line = spark.createDataFrame([("a", "x", 10.0), ("b", "y", 10.0)], "__k0 string, __k1 string, w double")
    odd = spark.createDataFrame([("x", 0.9), ("y", 0.1)], "value string, share double")
    with pytest.warns(UserWarning, match="off its target by 0.4"):
        mixing.raked(line.coalesce(1), 2, {0: half("a", "b"), 1: odd}, cycles=8).collect()


def test_mix_keeps_rows_whole(spark):
    rows = [(k, "one two " * (k % 9), f"s{k % 3}", "en", 5) for k in range(300)] + [(None, None, None, None, None), (1, "one two ", "s1", "en", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic int")
    out = mixing.mix(df)
    assert out.columns == df.columns
    got = Counter(map(tuple, out.collect()))
    assert not got - Counter(rows) and got == Counter(map(tuple, mixing.mix(df).collect()))
    assert mixing.mix(df.limit(0)).count() == 0
    clash = df.withColumnsRenamed({"topic": "__k0"}).withColumns({"key": F.lit(1), "row": F.lit(2), "factor": F.lit(3), "words": F.lit(4), "own": F.lit(5)})
    again = mixing.mix(clash)
    assert again.columns == clash.columns and Counter(tuple(x)[:5] for x in again.collect()) == got


# ----------------------------------------------------------------- archives


def test_archives_round_trip(spark):
    tricky = "a" + warc.CUT + "WARC-Type: response\r\n\r\nb\r\n\r\n"
    rows = [(1, "http://a/\r\nx", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "v", tricky), (6, "v", tricky), (None, "w", "same"), (None, "w", "alone"), (2, None, "same"), (7, "é", "\x00é😀" * 9000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    got = Counter((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in warc.deduplicated(df).collect())
    lead = {}
    for i, _, h in rows:
        if i is not None:
            lead[h or ""] = max(i, lead.get(h or "", i))
    want = Counter()
    for i, _, h in rows:
        data, top = (h or "").encode(), lead.get(h or "")
        first = top is None or i == top
        want[i, len(data), warc.digest(data), "response" if first else "revisit", None if first else top] += 1
    assert got == want
    assert warc.deduplicated(df.limit(0)).count() == 0


def test_written_headers_are_fresh(spark, tmp_path, monkeypatch):
    """Ids, dates and warcinfo records of captured and of written archives differ, and
    revisits name the response as it is written."""
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 4)
    rows = [(k, f"http://h/{k}", f"page {k % 5}") for k in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    warc.deduplicated(df, f"file://{tmp_path}/w", date="2025-02-03T04:05:06Z").count()
    held = {}
    for part in ("captured", "deduplicated"):
        lines = warc._lines(spark, f"file://{tmp_path}/w/{part}").collect()
        files: dict = {}
        for x in lines:
            files.setdefault(x.file, []).append(warc.parsed(x.value)[0])
        for records in files.values():
            assert len(records) <= 4 and records[0]["WARC-Type"] == "warcinfo"
            assert all(r["WARC-Warcinfo-ID"] == records[0]["WARC-Record-ID"] for r in records[1:])
        held[part] = [r for records in files.values() for r in records[1:]]
        assert len({r["WARC-Record-ID"] for r in held[part]}) == 30
    was, now = held["captured"], held["deduplicated"]
    assert not {r["WARC-Record-ID"] for r in was} & {r["WARC-Record-ID"] for r in now}
    assert {r["WARC-Date"] for r in was} == {warc.DATE} and {r["WARC-Date"] for r in now} == {"2025-02-03T04:05:06Z"}
    responses = {r["X-Page-Id"]: r for r in now if r["WARC-Type"] == "response"}
    assert len(responses) == 5
    for r in now:
        if r["WARC-Type"] == "revisit":
            to = responses[r["X-Refers-To-Page"]]
            assert r["WARC-Refers-To"] == to["WARC-Record-ID"] and r["WARC-Refers-To-Date"] == to["WARC-Date"] and r["WARC-Payload-Digest"] == to["WARC-Payload-Digest"]


def test_archives_in_sets_and_a_digest_on_most_pages(spark, monkeypatch):
    """Small archives, copied by sets of few revisits; ids are strings."""
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 7)
    monkeypatch.setattr(warc, "SETS_AT_ONCE", 3)
    rows = [(f"p:{k:03d} %\r\n", None, "hot" if k % 2 else f"own {k % 30}") for k in range(150)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string").repartition(4)
    got = {x.page_id: (x.record_type, x.refers_to) for x in warc.deduplicated(df, sent=4).collect()}
    lead = {h: max(i for i, _, g in rows if g == h) for _, _, h in rows}
    assert got == {i: ("response", None) if lead[h] == i else ("revisit", lead[h]) for i, _, h in rows}


def test_only_headers_are_shuffled(spark, tmp_path):
    df = spark.createDataFrame([(k, "u", "x" * 1000 + str(k % 5)) for k in range(40)], "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/w")
    verdicts = warc.resolved(warc.read_archives(spark, f"file://{tmp_path}/w"))
    assert "html" not in verdicts.columns and verdicts.where("record_type = 'response'").count() == 5


def test_payloads_come_back(spark, tmp_path):
    rows = [(1, "u", "text\r\n\r\nmore" + warc.CUT), (2, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    full = df.selectExpr("page_id", "url", "html", "'response' AS record_type", "CAST(NULL AS BIGINT) AS refers_to", "CAST(NULL AS STRING) AS refers_to_url")
    warc.write_archives(full, f"file://{tmp_path}/w")
    assert {(x.page_id, x.url, x.html) for x in warc.read_archives(spark, f"file://{tmp_path}/w", True).collect()} == set(rows)


def test_crowded_segments_and_a_hot_fingerprint(spark, monkeypatch):
    """Ten thousand fingerprints share a segment's value, by other look-ups than those
    without the split; and one fingerprint is on a third of all rows."""
    r = random.Random(51)
    values = {(0x1234ABCD << 32) | r.randrange(1 << 32) for _ in range(10_000)}
    base = list(values)[:300]
    for v in base:
        for bits in (1, 2, 3):
            values.add(v ^ sum(1 << k for k in r.sample(range(64), bits)))
    fps = [simhash._signed(v) for v in values]
    nodes = spark.createDataFrame([(x, x) for x in fps], "fp long, grp long")
    split = set(map(tuple, simhash.far_links(nodes, 2000).collect()))
    assert split == set(map(tuple, simhash.far_links(nodes, 10**9).collect())) and len(split) >= 900
    monkeypatch.setattr(simhash, "HOT_ROWS", 50)
    docs = [(k, "one text that a third of all rows have in common here" if k % 3 == 0 else f"text {k} is {k * 7} and {k * 11} of {k * 13}") for k in range(240)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(df).collect()}
    assert len(got) == 240 and {got[k][1] for k in range(0, 240, 3)} == {0}
    monkeypatch.setattr(simhash, "HOT_ROWS", 10**9)
    assert {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(df).collect()} == got


@pytest.mark.parametrize("crowd", [1, 2000])
def test_probes_are_not_broadcast(spark, crowd):
    """Spark sizes the 66 probes of a node as the node's file, which is small."""
    held = simhash.stored(spark.range(500).select(F.xxhash64("id").bitwiseAND(F.lit(~0xFF)).alias("fp")).selectExpr("fp", "fp AS grp"), "nodes")
    held = held.union(held.selectExpr("fp + 1 AS fp", "grp + 1 AS grp"))
    plan = simhash.far_links(held, crowd)._jdf.queryExecution().executedPlan().toString()
    # Only segments' values that many share are broadcast, after a count.
    assert plan.count("+- SortMergeJoin") + plan.count(":- SortMergeJoin") >= (2 if crowd == 1 else 1)
    assert "Inner, BuildRight" not in plan and "Inner, BuildLeft" not in plan


# --------------------------------------------------------------------- HTML


def test_articles_lose_their_chrome(spark):
    html = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a>Menu</a></nav><!-- <p>no</p> --><div class='cookie-notice'>Cookies</div>"
        "<article><header><h1>A &amp; B</h1></header><p>One <b>two</b><br>three<p>Four&nbsp;five</p><div class=\"comments\"><p>rude</p></div><form><p>Join</p></form></article>"
        "<aside>Side</aside><footer>&copy; me</footer>"
    )
    df = spark.createDataFrame([(1, "http://h/x", html, 3), (2, None, None, 3), (3, "u", "", 3)], "page_id long, url string, html string, text int")
    out = {x.page_id: x for x in html_main.main_text(df).collect()}
    assert out[1].text == "A & B\nOne two three\nFour five" and out[1].n_chars == len(out[1].text)
    assert out[2].text == out[3].text == "" and out[2].url is None


def test_hosts_repeat_and_unique_runs_stay(spark):
    shared = "this long line stands on every page of the host indeed"
    pages = [(k, f"http://{'h' if k < 4 else 'other' + str(k)}/p{k}", f"<p>{shared} own words number {k} alone</p><p>unique text {k}</p>") for k in range(6)]
    out = {x.page_id: x.text for x in html_main.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k in range(6):
        whole = f"{shared} own words number {k} alone\nunique text {k}"
        assert out[k] == (whole if k >= 4 else f"{k} alone\nunique text {k}")


def test_suffix_array_decides_within_articles(spark, monkeypatch):
    """What a host repeats goes from articles too; passages that two articles
    share, copies of a page and copied articles stay."""
    monkeypatch.setattr(html_main, "GROUP_CHARS", 1_500)
    monkeypatch.setattr(html_main, "GROUP_PAGES", 1)
    notice = "please read our house rules before you write to the editors of this paper"
    quote = "to be or not to be that is the question here"
    rows = []
    for k in range(20):
        own = " ".join(f"w{k}x{j}" for j in range(30))
        rows.append((k, f"http://h/{k}", f"<article><p>{own}</p><p>{notice}</p><p>{quote if k < 2 else ''} e{k}</p></article>"))
    rows += [(100 + k, f"http://h/copy{k}", "<article><p>one page that is sent again and again by the host</p></article>") for k in range(15)]
    # Most of a host's pages are near copies of one article.
    body = " ".join(f"b{j}" for j in range(40))
    rows += [(200 + k, f"http://near/{k}", f"<article><p>{body}</p><p>variant {k}</p></article>") for k in range(6)]
    # Shown as chrome by some pages, as part of the article by others.
    asked = "join our weekly letter and get all of the news by mail"
    for k in range(12):
        own = " ".join(f"v{k}x{j}" for j in range(30))
        side, inside = ("", asked) if k < 3 else (asked, "") if k < 6 else ("", "")
        rows.append((300 + k, f"http://c/{k}", f"<aside>{side}</aside><article><p>{own}</p><p>{inside}</p></article>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    out = {x.page_id: x.text for x in html_main.main_text(df).collect()}
    for k in range(20):
        own = " ".join(f"w{k}x{j}" for j in range(30))
        assert out[k] == f"{own}\n{quote + ' ' if k < 2 else ''}e{k}"
    assert {out[100 + k] for k in range(15)} == {"one page that is sent again and again by the host"}
    assert all(out[200 + k] == f"{body}\nvariant {k}" for k in range(6))
    assert all(out[300 + k] == " ".join(f"v{k}x{j}" for j in range(30)) for k in range(12))


def test_suffix_array_equals_sorting():
    import numpy as np

    r = random.Random(10)
    for n, kinds in ((1, 1), (2, 1), (7, 2), (64, 1), (200, 2), (300, 40)):
        tokens = [r.randrange(kinds) for _ in range(n)]
        order, depth = html_main.suffix_array(np.array(tokens))
        assert order.tolist() == sorted(range(n), key=lambda k: tokens[k:])
        for i in range(0, n, 3):
            for j in range(n):
                assert (depth[i] == depth[j]) == (tokens[i : i + 8] == tokens[j : j + 8])


def test_repeats_equal_brute_force():
    import numpy as np

    r = random.Random(12)
    for _ in range(20):
        streams = [[r.choice("ab") for _ in range(r.randint(0, 30))] for _ in range(r.randint(1, 7))]
        codes, own, starts, _ = html_main._hashes(streams)
        if not len(starts):
            continue
        flat = [w for s in streams for w in s]
        first, pages = html_main.repeats(codes, own, starts)
        got = {tuple(flat[k : k + 8]): n for k, n in zip(first.tolist(), pages.tolist())}
        want: dict = {}
        for k, s in enumerate(streams):
            for j in range(len(s) - 7):
                want.setdefault(tuple(s[j : j + 8]), set()).add(k)
        assert got == {w: len(ks) for w, ks in want.items()}


def test_boilerplate_equals_brute_force(spark, monkeypatch):
    """Which substrings go, against counts of all windows of each host's pages."""
    monkeypatch.setattr(html_main, "GROUP_CHARS", 900)
    monkeypatch.setattr(html_main, "GROUP_PAGES", 1)
    monkeypatch.setattr(html_main, "SENT", 0)
    r = random.Random(13)
    lines = [" ".join(f"l{k}t{j}" for j in range(9)) for k in range(8)]
    rows = []
    for k in range(60):
        body = " ".join([*(x for n, x in enumerate(lines) if r.random() < (n + 1) / 9), *(f"own{k}x{j}" for j in range(12))])
        side = " ".join(x for n, x in enumerate(lines) if r.random() < 0.3)
        rows.append((k, f"http://h{k % 2}/", f"<nav>{side}</nav><article><p>{body}</p></article>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    parsed = html_main.parsed(df)
    got = {x.host: len(x.windows) for x in html_main.boilerplate(parsed).collect()}
    want = Counter()
    for host in ("h0", "h1"):
        pages = [html_main.content_of(h) for _, u, h in rows if u == f"http://{host}/"]
        held: dict = {}
        for _, content, chrome in pages:
            for k, words in enumerate((" ".join(content).split(), " ".join(chrome).split())):
                for w in {tuple(words[j : j + 8]) for j in range(len(words) - 7)}:
                    held.setdefault(w, [0, 0])[k] += 1
        n = len(set(h for _, u, h in rows if u == f"http://{host}/"))
        want[host] = sum(a >= max(3, n * 0.5) or min(a, b) >= max(3, n * 0.1) for a, b in held.values())
    assert got == want
    covered = {x.page_id: x.n_covered for x in html_main.main_text(df).collect()}
    assert sum(covered.values()) > 0


def test_names_of_chrome_inside_articles(spark):
    """Classes that only contain a word of chrome keep their elements, and so does
    a button in a sentence; ids are strings, lack or repeat."""
    kept = ["related-work", "notice-period", "search-results", "social-history", "share-capital", "main-navigation-theory"]
    gone = ["comments", "comments-list", "cookie-notice", "ad", "ad-300x250", "social-share", "sidebar_widget", "newsletter signup"]
    parts = "".join(f"<section class='{c}'><p>{c.replace('-', ' ')} kept</p></section>" for c in kept) + "".join(f"<div class=\"x {c}\"><p>gone</p></div>" for c in gone)
    html = f"<article><p>Press <button>OK</button> to go on</p>{parts}<button>Share</button><p>end</p></article>"
    df = spark.createDataFrame([("a", "u", html), (None, "u", html), ("a", "u", html), ("b", "v", None)], "page_id string, url string, html string")
    want = "\n".join(["Press OK to go on", *(f"{c.replace('-', ' ')} kept" for c in kept), "end"])
    assert Counter((x.page_id, x.text) for x in html_main.main_text(df).collect()) == Counter([("a", want), (None, want), ("a", want), ("b", "")])
    assert html_main.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "html", ["<a " * 300_000, "<p a='" * 170_000, "<b>x</b>" + "<p a='" * 170_000 + "<!-- y", "<div>" * 100_000 + "</section>" * 50_000, "<p '\"" * 200_000 + ">", "<!-- a " * 100_000, "<script>" * 100_000, "&amp" * 200_000]
)
def test_broken_pages_are_read_in_linear_time(html):
    began = time.time()
    html_main.blocks(html)
    assert time.time() - began < 5


def test_tags_behind_the_last_end():
    text = lambda html: [t for _, t in html_main.blocks(html)]
    assert text("<p>a</p>b <i c") == ["a", "b <i c"]
    assert text("<p>a</p>b <!-- c <i d") == ["a", "b"] and text("<p>a</p><!-- c > d") == ["a"]
    assert text("x<!--> a <i ") == ["x"] and text("x<!-- a --> b") == ["x b"]
    assert text("x<script> a > b") == ["x"] and text("x<script> a </script> b <") == ["x b <"]
    assert text("x<div><p>y</section></div>z") == ["x", "y", "z"]


def test_long_pages_without_repeats_have_no_candidates(spark, monkeypatch):
    monkeypatch.setattr(html_main, "GROUP_CHARS", 20_000)
    r = random.Random(21)
    rows = [(k, f"http://h/{k}", "<article><p>" + " ".join(f"w{r.randrange(10**9)}" for _ in range(400)) + "</p></article>") for k in range(120)]
    parsed = html_main.parsed(spark.createDataFrame(rows, "page_id long, url string, html string"))
    dealt = parsed.select("host", F.lit(0).cast("bigint").alias("bucket"), F.lit(3).cast("bigint").alias("parts"), "digest", "content")
    streams = dealt.mapInArrow(html_main._streams, "host string, bucket bigint, parts bigint, digest binary, text binary")
    assert streams.groupBy("host", "bucket").applyInArrow(html_main._group, "host string, window bigint").count() == 0
    assert html_main.boilerplate(parsed).count() == 0


def test_sentences_go_whole(spark):
    shared = "All stories of this paper may be read again at any later time."
    rows = [(k, f"http://h/{k}", f"<article><p>Story {k} has words {k} of its own {k} and more {k}. {shared} Page {k} ends.</p></article>") for k in range(6)]
    out = {x.page_id: x.text for x in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {k: f"Story {k} has words {k} of its own {k} and more {k}. Page {k} ends." for k in range(6)}


def test_planted_boilerplate_is_found(spark):
    """Ten lines planted into nine tenths of a host's articles of fresh words."""
    r = random.Random(22)
    lines = [" ".join(f"p{n}q{r.randrange(999)}" for _ in range(12)) + "." for n in range(10)]
    rows, planted = [], 0
    for k in range(80):
        own = [" ".join(f"o{r.randrange(10**6)}" for _ in range(15)) + "." for _ in range(30)]
        mine = [x for x in lines if r.random() < 0.9]
        planted += len(mine)
        for x in mine:
            own.insert(r.randrange(len(own)), x)
        rows.append((k, f"http://h/{k}", f"<article><p>{' '.join(own)}</p></article>"))
    texts = [x.text for x in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    left = sum(t.count(x) for t in texts for x in lines)
    assert left <= 0.1 * planted and all(t.count("o") >= 15 * 30 for t in texts)


# ----------------------------------------------------------------- pipeline


def test_queries_with_sql(spark, sf_dir, duck, same):
    for name, sql in queries.oracle_sql().items():
        same(queries.queries()[name](spark, sf_dir), duck, sql)


def test_pipeline_equals_its_operators(spark, sf_dir):
    import corpus_pipeline

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.stored(stage(spark, rows, sf_dir), name)
        assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        at[name] = {r.doc_id: r for r in rows.collect()}
    assert set(at["quality_rules"]) <= set(docs)
    fps = {i: brute_fingerprint(r.text) for i, r in at["quality_rules"].items()}
    roots = classes(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i in sorted(fps):
        least.setdefault(roots[fps[i]], i)
    assert set(at["near_duplicates"]) == set(least.values())
    for i, r in at["personal_data"].items():
        # The corpus holds no spelt-out data: what goes is what the base finds.
        spans = brute_pii(docs[i].text)
        assert r.text == pii.masked(docs[i].text, spans) and r.n_chars == len(r.text)
    assert set(at["target_mix"]) == brute_mix(at["personal_data"].values())
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in out} == set(at["target_mix"]) and all(r.n_tokens == len(r.ids) for r in out)


def brute_mix(rows):
    """The ids that raking, calibration and the draw keep, in plain Python."""
    cells, at = Counter(), {}
    for r in rows:
        text = r.text or ""
        topic = next((n for n, words in mixing.TOPICS if any(w in text for w in words)), mixing.PROSE)
        at[r.doc_id] = (r.source or "(none)", r.lang or "(none)", topic)
        cells[at[r.doc_id]] += len(re.findall(r"[^\x20\x09-\x0D]+", text))
    total, factor = sum(cells.values()), dict.fromkeys(cells, 1.0)
    sums = lambda k, f: Counter({v: sum(w * f[c] for c, w in cells.items() if c[k] == v) for v in {c[k] for c in cells}})
    targets = []
    for k in range(3):
        powers = {v: (m / total) ** mixing.TEMPER for v, m in sums(k, factor).items()}
        targets.append({v: p / sum(powers.values()) for v, p in powers.items()})
    for _ in range(100):
        for k in range(3):
            now = sums(k, factor)
            factor = {c: f * targets[k][c[k]] * total / now[c[k]] if now[c[k]] else f for c, f in factor.items()}
    low, high = 0.0, 1e6
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if sum(w * min(1, factor[x] * c) for x, w in cells.items()) < mixing.SHARE * total else (low, c)
    draw = lambda i: int(md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
    return {i for i, x in at.items() if draw(i) < min(1, factor[x] * c)}


def test_stages_take_rows_of_any_kind(spark):
    """Nulls in every column, repeated rows, names that clash, empty tables."""
    import corpus_pipeline

    words = " ".join(f"word{k}" for k in range(80))
    rows = [(1, words, "en", "s", 5), (1, words, "en", "s", 5), (None, None, None, None, None), (2, "", "en", "s", 0), (3, words + " mail a@b.org", None, None, 9), (None, words[5:], "de", "t", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (df, df.limit(0), df.withColumns({"key": F.lit("k"), "id": F.lit(0), "fp": F.lit(1), "own": F.lit(2), "kept": F.lit(True), "spans": F.lit("x")})):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.stored(stage(spark, docs, ""), name)
            assert docs.columns == table.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
