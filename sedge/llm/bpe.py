"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece of bytes there is exactly one token that can be the
last of its encoding.  The table of these tokens is filled from left to right:
token ``t`` ending at ``j`` is the last one of prefix ``j`` if it may follow the
last token of the prefix before it, which a walk down the merges of both tokens
decides.  Following the table back from the end gives the encoding.  The table
of a prefix never changes when bytes are appended, so appends are exact.  After an
edit, prefixes are filled again from the edit on until last tokens have agreed
with the old ones over the longest token's length; what is behind stays.

Defined results: a null text is the empty text (no tokens); repeated rows give
repeated rows; other columns of the input are not read; an empty table gives an
empty table.  Texts are encoded whole; text without white space makes one long
piece, in time linear in its length.
"""

from __future__ import annotations

import base64
from hashlib import sha256
from itertools import chain

from pyspark.sql import DataFrame

from .common import map_rows

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces that a worker remembers; a full memory is emptied, never a wrong one.
REMEMBERED = 300_000
#: Prefixes that a worker remembers.
REMEMBERED_PREFIXES = 600_000
#: Longer pieces do not share the tables of their beginnings.
LONGEST_SHARED = 40
#: Token pairs that a worker remembers.
REMEMBERED_PAIRS = 300_000
#: Longer pieces are not remembered.
LONGEST_REMEMBERED = 200


class Merges:
    """The merges of a vocabulary: ids are the order in which pairs merge.

    Tokens are strings with one character for each smallest symbol; ``pair``
    gives two ids' merge, or None.
    """

    def __init__(self, tokens: dict[str, int], pair):
        self.ids, self.pair = tokens, pair
        self.symbols = {i: s for s, i in tokens.items()}
        self.longest = max(map(len, tokens), default=0)
        #: Every end of a token, with the token's id or None where it is none.
        self.tails: dict[str, int | None] = {}
        for s in tokens:
            for n in range(1, len(s)):
                self.tails.setdefault(s[n:], None)
        self.tails.update(tokens)
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.allowed: dict[tuple[int, int], bool] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge is ``token``; None for single symbols."""
        if token not in self.parts:
            ids = [self.ids[s] for s in self.symbols[token]]
            while len(ids) > 2:
                best = min(
                    ((m, k) for k in range(len(ids) - 1) if (m := self.pair(ids[k], ids[k + 1])) is not None and m < token),
                    default=None,
                )
                if best is None:
                    break
                ids[best[1] : best[1] + 2] = [best[0]]
            self.parts[token] = tuple(ids) if len(ids) == 2 else None
        return self.parts[token]

    def follows(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' symbols is just these two."""
        key = (left, right)
        held = self.allowed.get(key)
        if held is None:
            if len(self.allowed) >= REMEMBERED_PAIRS:
                self.allowed.clear()
            held = self.allowed[key] = self._follows(left, right)
        return held

    def _follows(self, left: int, right: int) -> bool:
        # A merge across the border spoils the pair if it comes before the
        # merge that made the side it would break; undo merges side by side.
        bound = float("inf")
        while True:
            merged = self.pair(left, right)
            if merged is not None and merged < bound:
                return False
            parts_l, parts_r = self.split(left), self.split(right)
            if parts_l is not None and (parts_r is None or left > right):
                bound, left = left, parts_l[1]
            elif parts_r is not None:
                bound, right = right + 1, parts_r[0]
            else:
                return True


class PrefixTable:
    """The last token of each prefix of ``data``, kept up to date by appends and
    edits.  ``last[j]`` belongs to the prefix of length ``j + 1``."""

    def __init__(self, merges: Merges, data: str = ""):
        self.merges, self.data, self.last = merges, "", []
        #: Prefixes filled so far.
        self.filled = 0
        self.append(data)

    def append(self, more: str) -> None:
        self.data += more
        self._fill(len(self.data))

    def _fill(self, stop: int) -> None:
        data, last = self.data, self.last
        tails, allowed, follows = self.merges.tails, self.merges.allowed, self.merges.follows
        self.filled += stop - len(last)
        for end in range(len(last) + 1, stop + 1):
            start = end - 1
            while True:
                token = tails.get(data[start:end], -1)
                if token is not None:
                    if token < 0:
                        raise ValueError(f"no token ends at symbol {end}")
                    if not start:
                        break
                    ok = allowed.get((before := last[start - 1], token))
                    if ok or ok is None and follows(before, token):
                        break
                start -= 1
                if start < 0:
                    raise ValueError(f"no token ends at symbol {end}")
            last.append(token)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace ``data[start:end]`` by ``new``.  Prefixes before it stay, and
        so do those behind a stretch of the longest token's length, all of it
        behind the edit, whose last tokens are the old ones."""
        old, shift, least = self.last[start:], len(new) - (end - start), start + len(new)
        self.data = self.data[:start] + new + self.data[end:]
        del self.last[start:]
        alike = 0
        while len(self.last) < len(self.data) and alike < self.merges.longest:
            self._fill(len(self.last) + 1)
            at = len(self.last)
            # The prefix of length ``least`` is the first without changed symbols behind it.
            same = at >= least and at - shift > start and self.last[-1] == old[at - shift - start - 1]
            alike = alike + 1 if same else 0
        if len(self.last) < len(self.data):
            self.last += old[len(self.last) - shift - start :]

    def tokens(self) -> tuple[int, ...]:
        out, end, symbols = [], len(self.last), self.merges.symbols
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(symbols[token])
        return tuple(out[::-1])


class SharedPrefixes:
    """The prefix tables of many short pieces as one tree: a node for each
    prefix met, with its last token.  A piece adds to the table of the longest
    beginning that was met before."""

    def __init__(self, merges: Merges):
        self.merges, self.lengths = merges, {i: len(s) for i, s in merges.symbols.items()}
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.last = [-1]

    def tokens(self, data: str) -> tuple[int, ...]:
        if len(data) > LONGEST_SHARED:
            return PrefixTable(self.merges, data).tokens()
        if len(self.last) >= REMEMBERED_PREFIXES:
            self.clear()
        children, last, lengths, node, path = self.children, self.last, self.lengths, 0, [0]
        for end, symbol in enumerate(map(ord, data)):
            key = node << 9 | symbol
            node = children.get(key)
            if node is None:
                token = self.token(data, end + 1, path)
                node = children[key] = len(last)
                last.append(token)
            path.append(node)
        out, end = [], len(data)
        while end:
            token = last[path[end]]
            out.append(token)
            end -= lengths[token]
        out.reverse()
        return tuple(out)

    def token(self, data: str, end: int, path: list[int]) -> int:
        tails, allowed, last, start = self.merges.tails, self.merges.allowed, self.last, end - 1
        while start >= 0:
            token = tails.get(data[start:end], -1)
            if token is not None:
                if token < 0:
                    break
                if not start:
                    return token
                before = last[path[start]]
                ok = allowed.get((before, token))
                if ok or ok is None and self.merges.follows(before, token):
                    return token
            start -= 1
        raise ValueError(f"no token ends at symbol {end}")


class Pieces(dict):
    """Encoded stretches by their text, as ids joined by spaces.

    A missing stretch is split by the vocabulary's pattern, and its pieces are
    encoded by prefix tables.  ``before`` is put in front of every key.
    """

    def __init__(self, codec: Codec, before: str = ""):
        super().__init__()
        self.codec, self.before = codec, before

    def __missing__(self, key: str) -> str:
        ids = chain.from_iterable(map(self.codec.piece, self.codec.pattern.findall(self.before + key)))
        made = " ".join(map(str, ids))
        if len(key) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = made
        return made


class Codec:
    """Encoder and decoder of one vocabulary file of ranked byte strings."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        symbols = {b.decode("latin-1"): i for b, i in ranks.items()}
        at = self.bytes_of
        self.merges = Merges(symbols, lambda a, b: ranks.get(at[a] + at[b]))
        #: No match of the pattern reaches over a space before other than white space.
        self.loose = regex.compile(r" (?:\s|$)")
        self.first, self.rest = Pieces(self), Pieces(self, " ")
        self.known: dict[str, tuple[int, ...]] = {}
        self.shared = SharedPrefixes(self.merges)
        self.bytes_of_digits = {str(i): b for b, i in ranks.items()}

    def piece(self, piece: str) -> tuple[int, ...]:
        known = self.known.get(piece)
        if known is None:
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            known = (whole,) if whole is not None else self.shared.tokens(data.decode("latin-1"))
            if len(piece) <= LONGEST_REMEMBERED:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = known
        return known

    def stretches(self, text: str) -> list[str]:
        """The encoded stretches of a text, in order."""
        if not text:
            return []
        if self.loose.search(text):
            # Where spaces meet other white space, cut before the spaces that
            # stand between two other characters only.
            out, at = [], 0
            words = text.split(" ")
            group = words[0]
            for w in words[1:]:
                if w and not w[0].isspace():
                    out.append(self._one(group, at))
                    group, at = w, 1
                else:
                    group += " " + w
            out.append(self._one(group, at))
            return out if group or at or len(out) > 1 else []
        head, *tail = text.split(" ")
        rest = map(self.rest.__getitem__, tail)
        return [self.first[head], *rest] if head else [*rest]

    def _one(self, group: str, at: int) -> str:
        return self.rest[group] if at else self.first[group]

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in " ".join(self.stretches(text)).split()]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a file, loaded once in each worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _starter(path: str, pattern: str, keep_ids: bool):
    def start():
        coder = codec(path, pattern)

        def step(ids, texts):
            out = []
            for i, text in zip(ids, texts):
                parts = coder.stretches(text or "")
                joined = " ".join(parts)
                tokens = joined.split()
                decoded = b"".join(map(coder.bytes_of_digits.__getitem__, tokens))
                row = (i, len(tokens), sha256(joined.encode()).hexdigest(), sha256(decoded).hexdigest())
                out.append((*row, list(map(int, tokens))) if keep_ids else row)
            return out

        return step

    return start


def encode_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    path: str | None = None,
    pattern: str | None = None,
    keep_ids: bool = False,
) -> DataFrame:
    """Encode each whole text, decode the ids again, and give digests of both;
    with ``keep_ids`` also the ids."""
    import public_tokenizers

    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    schema = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * keep_ids
    return map_rows(docs, [id_column, text_column], schema, _starter(path, pattern, keep_ids))
