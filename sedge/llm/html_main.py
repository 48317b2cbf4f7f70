"""HTML extraction: structure and a suffix array of each host, together.

A page's html is cut into blocks.  Blocks inside navigation, headers, footers,
sidebars, notices, adverts, forms, comments, scripts and styles are chrome;
blocks inside an article or main element are main; other blocks are open.  A class,
id or role makes an element chrome if it is made of words of chrome and of layout
only (``cookie-notice``, ``comments-list``), not if one of its parts is such a
word (``related-work``, ``notice-period``).  A button in a sentence is a part of
it.  The content of a page is its main blocks, or its open blocks where it has
none.  Structure alone drops the chrome; what the host repeats decides within
content:

* the content streams of a host's distinct pages are dealt by a digest of the
  page to groups of bounded size, of ``GROUP_PAGES`` pages on average at least, and
  concatenated; a suffix array of the group
  puts suffixes that begin alike next to each other.  Where neighbours share
  ``WINDOW`` tokens or more they are one interval, a substring that is repeated
  on so many distinct pages.  Longer repeats are covered by the intervals of
  their substrings of ``WINDOW`` tokens, so these are all that is handed on;
* a repeat on a share of a host's pages is on that share of one group at least:
  such substrings are candidates, and their distinct pages are then counted
  exactly over the whole host, in content and in chrome;
* a candidate is boilerplate if it stands in the content of ``SHARE`` of the
  host's distinct pages, or of ``CHROME_SHARE`` if it stands in the chrome of as
  many, and on ``MIN_PAGES`` in each case;
* tokens covered by boilerplate go, other runs stay; a sentence that ends with its
  stop goes whole or not at all.  A main text of which more than half would go is a
  copy of other articles and stays whole.

Pages are parsed once.  Copies of a page (equal html) count as one page.
Substrings of different groups are matched by 64-bit hashes.

Defined results: a null html is the empty page with the empty text; a null url
is a host of its own name; repeated rows give repeated rows; ids of any type keep
it, and rows without one are pages like others; other columns are not read; an
empty table gives an empty table.  Pages are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.retrieval import small
from .common import bounded_batches, map_rows, stored

#: Tokens of a repeated substring at least, a power of two.
WINDOW = 8
#: Shares of a host's distinct pages that make a repeat boilerplate: without and
#: with as many of them showing it in their chrome; pages at least.
SHARE, CHROME_SHARE, MIN_PAGES = 0.5, 0.1, 3
#: Substrings of all hosts that are broadcast at most (8 bytes each); more are
#: joined by shuffle.
SENT = 1_000_000
#: Characters of content in a group, about; and pages in a group of a host that is
#: cut, on average at least: with so many, no share of a group is a single page.
GROUP_CHARS, GROUP_PAGES = 2_000_000, 40

TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(?:.*?\]\]>|.*\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|math|object)\b[^>]*+>(?:.*?</\1\s*>|.*\Z)"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*?)>",
    re.S | re.I,
)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
#: Elements that hold blocks and are closed by their own end tags.
HOLDERS = frozenset(
    "article aside blockquote body details dialog div dl fieldset figure footer form head header main menu nav ol section table "
    "title ul button".split()
)
CHROME_TAGS = frozenset("nav footer aside form head title dialog menu button".split())
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices "
    "alert popup modal overlay sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar share sharing "
    "social related recommended newsletter subscribe subscription signup login search comment comments disqus respond replies widget "
    "pagination pager skip contentinfo complementary".split()
)
#: Words of layout, which say nothing of what an element holds.
LAYOUT_NAMES = frozenset(
    "area bar block body bottom box btn button buttons col column container content element fixed form group header heading holder icon icons inner item items left "
    "link links list main mobile module outer page panel post right row section side site slot sticky text thread title top unit wrap wrapper".split()
)
MAIN_TAGS, SPACE = frozenset(("article", "main")), re.compile(r"\s+")


def _chrome(name: str, attributes: str, in_main: bool) -> bool:
    if name in CHROME_TAGS or name == "header" and not in_main:
        return True
    if not attributes:
        return False
    return any(chrome_name(w) for m in NAMES.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").split())


def chrome_name(word: str) -> bool:
    """Whether a class, id or role names chrome as a whole."""
    parts = {p.rstrip("0123456789") for p in re.split(r"[^a-z0-9]+", word.lower())}
    parts = {p for p in parts if p.isalpha()}
    return not parts.isdisjoint(CHROME_NAMES) and parts <= CHROME_NAMES | LAYOUT_NAMES


#: What hides the rest of a page where no tag can end any more.
HIDDEN = re.compile(r"<!--|<!\[CDATA\[", re.I)


def tags(html: str) -> Iterator[re.Match]:
    """Tags, comments and hidden elements in order.  Behind the last ``>`` nothing is
    a tag, so it is not searched: what is tried in front of it is found."""
    end = html.rfind(">") + 1
    for m in TAG.finditer(html, 0, end):
        text = m[0]
        if m.end() == end < len(html) and (
            text.startswith("<!--") and not (text.endswith("-->") and len(text) > 6)
            or text[:9].upper() == "<![CDATA[" and not text.endswith("]]>")
            or m[1] and not re.search(rf"(?i)</{m[1]}\s*>\Z", text)
        ):
            # It is not closed: the whole page behind it is hidden.
            m = TAG.match(html, m.start())
        yield m


def blocks(html: str) -> list[tuple[str, str]]:
    """(region, text) of each block in page order; regions are main, chrome,
    title and open."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []

    def close() -> None:
        if parts:
            text = SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                # A title is the page's own, so it is no evidence of chrome.
                region = stack[-1][1] if stack else "open"
                out.append(("title" if stack and stack[-1][0] == "title" else region, text))
            parts.clear()

    at, inline, open_ = 0, False, Counter()
    for m in tags(html):
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
        elif name == "button" and (inline if m[2] else "".join(parts).strip()):
            # In the midst of a sentence: a part of it.
            inline = not m[2]
        elif name in BLOCKS or name in HOLDERS:
            close()
            inline = False
            if name not in HOLDERS:
                continue
            region = stack[-1][1] if stack else "open"
            if not m[2]:
                if not m[4].endswith("/"):
                    if region != "chrome" and _chrome(name, m[4], region == "main"):
                        region = "chrome"
                    elif region == "open" and (name in MAIN_TAGS or 'role="main"' in m[4]):
                        region = "main"
                    stack.append((name, region))
                    open_[name] += 1
            elif open_[name]:
                while (gone := stack.pop()[0]) != name:
                    open_[gone] -= 1
                open_[name] -= 1
    if at < len(html):
        parts.append(HIDDEN.split(html[at:], maxsplit=1)[0])
    close()
    return out


def _host():
    """The host of a url, a column."""
    url = F.coalesce("url", F.lit("(none)"))
    found = F.regexp_extract(url, r"^(?i)(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)
    named = F.when(url.rlike(r"^(?i)(?:[a-z][a-z0-9+.-]*:)?//"), F.lower(F.substring_index(found, "@", -1))).otherwise(url)
    return F.when(named == "", "(none)").otherwise(named)


def content_of(html: str | None) -> tuple[bool, list[str], list[str]]:
    """Whether a page has a main text, its content and its chrome."""
    found = blocks(html or "")
    main = [t for region, t in found if region == "main"]
    return bool(main), main or [t for region, t in found if region == "open"], [t for region, t in found if region == "chrome"]


def suffix_array(codes: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a stream of codes in order, by prefix doubling; and the rank
    of each by its first ``depth`` codes, a power of two.

    A suffix's rank is the place of the first suffix that begins like it.  Each
    round sorts only those that are not yet told apart."""
    n = len(codes)
    _, kind, counts = np.unique(codes, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[kind].astype(np.int64)
    left, width, at_depth = np.flatnonzero(counts[kind] > 1), 1, None
    while True:
        if width == depth:
            at_depth = rank.copy()
        if not len(left):
            break
        after = np.where(left + width < n, rank[np.minimum(left + width, n - 1)] + 1, 0)
        order = np.argsort(rank[left] * (n + 1) + after, kind="stable")
        left, after = left[order], after[order]
        own = rank[left]
        group = np.concatenate([[True], own[1:] != own[:-1]])
        part = group | np.concatenate([[True], after[1:] != after[:-1]])
        place = np.arange(len(left))
        rank[left] = own + np.maximum.accumulate(np.where(part, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        left = left[~(part & np.concatenate([part[1:], [True]]))]
        width *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, rank if at_depth is None else at_depth


def repeats(codes: np.ndarray, own: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place, distinct pages) of each interval of the suffix array whose
    suffixes share ``WINDOW`` tokens, all inside one page; ``own`` gives each
    token's page and ``starts`` the places with so many tokens before its end."""
    order, depth = suffix_array(codes)
    inside = np.zeros(len(codes), bool)
    inside[starts] = True
    order = order[inside[order]]
    interval = np.cumsum(np.concatenate([[0], depth[order][1:] != depth[order][:-1]]))
    n_pages = int(own.max()) + 1
    pages = np.bincount(np.unique(interval * n_pages + own[order]) // n_pages)
    first = order[np.unique(interval, return_index=True)[1]]
    return first, pages


def _hashes(streams: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated streams: token codes, each token's stream, the places
    where a window inside one stream starts, and the windows' hashes there."""
    from xxhash import xxh64_intdigest

    ids: dict[str, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for words in streams for w in words], np.int64)
    own = np.repeat(np.arange(len(streams)), [len(words) for words in streams])
    starts = np.flatnonzero(own[: len(own) - WINDOW + 1] == own[WINDOW - 1 :]) if len(own) >= WINDOW else np.zeros(0, np.int64)
    names = np.array([xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in ids], np.uint64)
    hashed = np.zeros(len(starts), np.uint64)
    for k in range(WINDOW if len(starts) else 0):
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + names[codes[starts + k]]
    return codes, own, starts, hashed.view(np.int64)


def _parsed():
    def step(ids, urls, hosts, digests, htmls):
        out = []
        for i, url, host, digest, html in zip(ids, urls, hosts, digests, htmls):
            is_main, content, chrome = content_of(html)
            out.append((i, url, host, digest, sum(map(len, content)), is_main, content, " ".join(chrome)))
        return out

    return step


def _streams(batches):
    """(host, bucket, parts, digest, text) of the content of each page, compressed;
    copies within a task go, so that a page's copies are few rows of its group."""
    import pyarrow as pa

    seen = set()
    for batch in batches:
        out = []
        for host, bucket, parts, digest, content in zip(*(c.to_pylist() for c in batch.columns)):
            if content and (host, digest) not in seen:
                seen.add((host, digest))
                out.append((host, bucket, parts, digest, zlib.compress(" ".join(content).encode("utf-8", "surrogatepass"), 1)))
        cols = list(zip(*out)) or [[], [], [], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["host", "bucket", "parts", "digest", "text"])


def _group(key, table):
    """The windows that may be boilerplate, of one group of a host's pages."""
    import pyarrow as pa

    pages = dict(zip(table["digest"].to_pylist(), table["text"].to_pylist()))
    whole = table["parts"][0].as_py() == 1
    found = np.zeros(0, np.int64)
    least = max(MIN_PAGES if whole else 1, int(np.ceil(CHROME_SHARE * len(pages) - 1e-9)))
    if len(pages) >= least:
        codes, own, starts, hashed = _hashes([zlib.decompress(t).decode("utf-8", "surrogatepass").split() for t in pages.values()])
        if len(starts):
            first, held = repeats(codes, own, starts)
            found = np.unique(hashed[np.searchsorted(starts, first[held >= least])])
    return pa.table({"host": pa.array([key[0].as_py()] * len(found), pa.string()), "window": pa.array(found, pa.int64())})


def _sought(hosts, column):
    """The windows looked for in each row; rows of one host share them."""
    held: dict[str, np.ndarray] = {}
    for k, host in enumerate(hosts):
        if host not in held:
            held[host] = np.sort(np.array(column[k].as_py() or [], np.int64))
        yield held[host]


def _counted(batches):
    """(host, window, digest, content, chrome): where a page has a candidate."""
    import pyarrow as pa

    for batch in batches:
        hosts, digests, contents, chromes = (batch.column(c).to_pylist() for c in ("host", "digest", "content", "chrome"))
        out = [[], [], [], [], []]
        for host, digest, content, chrome, sought in zip(hosts, digests, contents, chromes, _sought(hosts, batch.column("windows"))):
            _, own, starts, hashed = _hashes([" ".join(content).split(), chrome.split()])
            met = np.isin(hashed, sought)
            inside, where = hashed[met], own[starts[met]]
            main, side = set(inside[where == 0].tolist()), set(inside[where == 1].tolist())
            for w in main | side:
                for c, v in zip(out, (host, w, digest, int(w in main), int(w in side))):
                    c.append(v)
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["host", "window", "digest", "content", "chrome"])


#: The last word of a sentence.
STOP = re.compile(r"[.!?\u2026\u3002]+[\"'\u201d\u2019\u00bb)\]]*\Z")


def whole_sentences(block: list[str], gone: np.ndarray) -> np.ndarray:
    """``gone``, but of a sentence with its end only if all of it is; what no end
    closes is taken by words."""
    ends = np.array([STOP.search(w) is not None for w in block], bool)
    sentence = np.concatenate([[0], np.cumsum(ends)[:-1]])
    kept = np.bincount(sentence, ~gone)
    return np.where(sentence < ends.sum(), kept[sentence] == 0, gone)


def left_over(content: list[str], sought: np.ndarray, is_main: bool) -> tuple[list[str], int]:
    """The blocks of a content less what boilerplate covers, and the tokens that
    were covered, whole sentences only."""
    words = [t.split() for t in content]
    stream = [w for block in words for w in block]
    _, _, starts, hashed = _hashes([stream])
    at = starts[np.isin(hashed, sought)]
    if not len(at):
        return content, 0
    edge = np.zeros(len(stream) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    gone = np.cumsum(edge)[:-1] > 0
    k = 0
    for block in words:
        if block:
            gone[k : k + len(block)] = whole_sentences(block, gone[k : k + len(block)])
        k += len(block)
    covered = int(gone.sum())
    if is_main and covered * 2 > len(stream):
        return content, covered
    kept, k = [], 0
    for block in words:
        left = " ".join(w for w, g in zip(block, gone[k : k + len(block)]) if not g)
        k += len(block)
        if left:
            kept.append(left)
    return kept, covered


def _texts():
    def step(ids, urls, hosts, is_mains, contents, windows):
        held: dict[str, np.ndarray] = {}
        out = []
        for i, url, host, is_main, content, sought in zip(ids, urls, hosts, is_mains, contents, windows):
            covered = 0
            if sought:
                if host not in held:
                    held[host] = np.array(sought, np.int64)
                content, covered = left_over(content, held[host], is_main)
            text = "\n".join(content)
            out.append((i, url, text, len(text), covered))
        return out

    return step


def _joined(pages: DataFrame, windows: DataFrame, how: str = "inner") -> DataFrame:
    """``pages`` with their host's ``windows``, broadcast if they are few in all.

    A host has few: a candidate is on a share of a group's pages, so a group has no
    more of them than some pages' tokens."""
    n = windows.agg(F.sum(F.size("windows"))).first()[0] or 0
    return pages.join(F.broadcast(windows) if n <= SENT else windows, "host", how)


def boilerplate(pages: DataFrame) -> DataFrame:
    """(host, windows) of parsed ``pages``: each host's boilerplate."""
    bounded_batches(pages.sparkSession)
    distinct = pages.groupBy("host", "digest").agg(F.max("chars").alias("chars"))
    hosts = stored(distinct.groupBy("host").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")), "hosts")
    # Hosts of more than one group are few: so many groups hold so many characters.
    parts = F.least(F.ceil(F.col("chars") / GROUP_CHARS), F.floor(F.col("n") / GROUP_PAGES))
    large = small(hosts.select("host", parts.alias("parts")).where("parts > 1"))
    dealt = pages.join(large, "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
    dealt = dealt.select("host", F.pmod(F.xxhash64("digest"), F.col("parts")).alias("bucket"), "parts", "digest", "content")
    streams = dealt.mapInArrow(_streams, "host string, bucket bigint, parts bigint, digest binary, text binary")
    candidates = streams.groupBy("host", "bucket").applyInArrow(_group, "host string, window bigint").distinct()
    sought = stored(candidates.groupBy("host").agg(F.collect_set("window").alias("windows")), "candidates")
    met = _joined(pages.select("host", "digest", "content", "chrome"), sought)
    met = met.mapInArrow(_counted, "host string, window bigint, digest binary, content int, chrome int")
    once = met.groupBy("host", "window", "digest").agg(F.max("content").alias("content"), F.max("chrome").alias("chrome"))
    held = once.groupBy("host", "window").agg(F.sum("content").alias("content"), F.sum("chrome").alias("chrome")).join(hosts, "host")
    of = lambda share: F.greatest(F.lit(MIN_PAGES), F.ceil(F.lit(share) * F.col("n") - 1e-9))
    alike = F.least("content", "chrome") >= of(CHROME_SHARE)
    return stored(held.where((F.col("content") >= of(SHARE)) | alike).groupBy("host").agg(F.collect_list("window").alias("windows")), "boilerplate")


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, digest, chars, is_main, content, chrome) of each page."""
    digest = F.unhex(F.md5(F.coalesce("html", F.lit(""))))
    rows = pages.select("page_id", "url", _host().alias("host"), digest.alias("digest"), "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, host string, digest binary, chars bigint, is_main boolean, content array<string>, chrome string"
    return stored(map_rows(rows, ["page_id", "url", "host", "digest", "html"], schema, _parsed), "parsed", compression="zstd")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_covered) for each page; ``n_covered`` are
    the tokens of its content that the host's repeats cover."""
    rows = parsed(pages)
    found = boilerplate(rows)
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars bigint, n_covered bigint"
    return map_rows(_joined(rows, found, "left"), ["page_id", "url", "host", "is_main", "content", "windows"], schema, _texts)
