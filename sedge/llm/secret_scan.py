"""Secret scans: an Aho-Corasick keyword prefilter, anchored regular expressions
only near its hits, then validation of checksums embedded in tokens.

Base kinds (leftmost, not overlapping within a kind; a match that fails its
length test is dropped and still uses up its text):

=======  ==================================================================
assign   ``password = "..."`` and the like, value of 12 characters or more
access   ``AKIA...``, 18 characters or more
hex      16 lower-case hexadecimal digits or more
=======  ==================================================================

The method adds ``github`` and ``npm`` tokens whose last six base-62 digits are
the CRC-32 of the characters before them, and ``pem`` private-key header lines.

Defined results: a null text is the empty text; an empty text has no spans (the
hash of the empty string, an empty ``spans``); repeated rows give repeated
rows; other columns of the input are not read; an empty table gives an empty
table.  Texts are scanned whole, in time linear in their length.
"""

from __future__ import annotations

import re
import zlib
from hashlib import sha256

from pyspark.sql import DataFrame

from .common import map_rows

KINDS = ("assign", "access", "hex", "github", "npm", "pem")
BASE_KINDS = KINDS[:3]
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
TOKEN_HEADS = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
PEM_HEAD = "-----begin "
HEX = "0123456789abcdef"
#: Every run of hexadecimal digits that counts begins with one of these words.
HEX_WORDS = [a + b + c + d for a in HEX for b in HEX for c in HEX for d in HEX]

ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEXES = re.compile(r"[0-9a-f]+")
TOKEN = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_automaton = None


def crc_digits(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits, as token issuers embed it."""
    n, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits


def automaton():
    """The keyword automaton, built once in each worker process."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        made = ahocorasick.Automaton()
        for w in HEX_WORDS:
            made.add_word(w, (2, 4))
        for w in ASSIGN_WORDS:
            made.add_word(w, (0, len(w)))
        made.add_word("akia", (1, 4))
        for w in TOKEN_HEADS:
            made.add_word(w, (3, len(w)))
        made.add_word(PEM_HEAD, (5, len(PEM_HEAD)))
        made.make_automaton()
        _automaton = made
    return _automaton


def scan(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in order of start, then of kind."""
    # Only A-Z are folded, so positions in both texts agree.
    folded = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits = sorted((end - n + 1, k) for end, (k, n) in automaton().iter(folded))
    found, used = [], [0] * len(KINDS)
    for at, k in hits:
        if at < used[k]:
            continue
        if k == 0:
            if m := ASSIGN.match(text, at):
                used[0] = m.end()
                if len(m[2]) >= 12:
                    found.append((at, m.end(), 0))
        elif k == 1:
            if m := ACCESS.match(text, at):
                used[1] = m.end()
                if m.end() - at >= 18:
                    found.append((at, m.end(), 1))
        elif k == 2:
            if m := HEXES.match(text, at):
                used[2] = m.end()
                if m.end() - at >= 16:
                    found.append((at, m.end(), 2))
        elif k == 3:
            if (m := TOKEN.match(text, at)) and crc_digits(m[1]) == m[2]:
                used[3] = m.end()
                found.append((at, m.end(), KINDS.index(TOKEN_HEADS[text[at : at + 4]])))
        elif m := PEM.match(text, at):
            used[5] = m.end()
            found.append((at, m.end(), 5))
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _start():
    def step(ids, texts):
        out = []
        for i, text in zip(ids, texts):
            spans = scan(text or "")
            base = [s for s in spans if s[2] in BASE_KINDS]
            n = [sum(s[2] == k for s in spans) for k in KINDS]
            out.append((i, *n[:3], sha256(joined(base).encode()).hexdigest(), joined(spans), sum(n[3:])))
        return out

    return step


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each input row: counts by kind, digest and list of all spans."""
    schema = (
        f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, "
        "base_sha256 string, spans string, n_checked bigint"
    )
    return map_rows(docs, [id_column, text_column], schema, _start)
