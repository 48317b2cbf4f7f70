"""Token counts without tokens: a tokenizer compiled to a transducer.

The vocabulary's merges become a deterministic transducer over bytes, compiled
state by state as texts need them.  A state stands for what was read since the
word began; each transition carries the number of tokens that it adds to the
count (negative where a longer token takes the place of several).  The last
byte of a word has a symbol of its own and leads back to the start.

Texts of more than ``CHUNK`` characters are cut into chunks, which are rows of
their own, dealt over the cluster.  A cut may fall inside a word of any length.
What a cut's left side can leave behind is a small set of states: a last token
and how far before the cut it ends; or the start state, where a word ends at the
cut.  A chunk's map gives, for every state before it that its left neighbours
allow, the states behind it and the number of tokens between: plain numbers,
no text.  Maps compose associatively, by a join on the states at the border, and
a pairwise scan in chunk order joins those of a text.  The states of a chunk run
together within a few symbols: paths that have met share one label.

Defined results: a null text is the empty text (no tokens, no bytes); repeated
rows give repeated rows; other columns of the input are not read; an empty
table gives an empty table; special strings in a text count as one token.
Texts are counted whole, without truncation or padding.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.retrieval import small
from .bpe import LONGEST_REMEMBERED, REMEMBERED, REMEMBERED_PREFIXES, Merges
from .common import bounded_batches, map_rows, stored

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Characters in a chunk of a long text.
CHUNK = 1 << 16
WORD_END = 256
#: The start state; other states are (how far before the border, last token),
#: with -1 in place of a token where the word begins there.
START = (1, -1)
#: Maps of chunks: state before -> state behind -> tokens.
Map = dict[tuple[int, int], dict[tuple[int, int], int]]


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Transducer:
    """Counts tokens of words; ``emitted[state]`` is what the transition into a
    state adds, ``last[state]`` the last token of what was read."""

    def __init__(self, merges: Merges):
        self.merges, self.lengths = merges, {i: len(s) for i, s in merges.symbols.items()}
        self.clear()

    def clear(self) -> None:
        self.moves: dict[int, int] = {}
        self.last, self.emitted, self.total, self.parent = [-1], [0], [0], [0]

    def word(self, data: bytes) -> int:
        """The number of tokens of one word."""
        if len(self.last) >= REMEMBERED_PREFIXES:
            self.clear()
        state, count, moves, emitted, end = 0, 0, self.moves, self.emitted, len(data) - 1
        for at, byte in enumerate(data):
            symbol = byte if at < end else byte | WORD_END
            move = moves.get(state << 9 | symbol)
            if move is None:
                move = self.compile(state, symbol, data, at)
            state = move
            count += emitted[state]
        return count

    def compile(self, state: int, symbol: int, data: bytes, at: int) -> int:
        """Add the transition from ``state`` on ``symbol``."""
        read = data[:at].decode("latin-1") + chr(symbol)
        tails, before = self.merges.tails, state
        for start in range(at, -1, -1):
            token = tails.get(read[start:], -1)
            if token == -1:
                raise ValueError("no token ends here")
            if token is not None and (start == 0 or self.merges.follows(self.last[before], token)):
                break
            before = self.parent[before]
        else:
            raise ValueError("no token ends here")
        total = 1 + (self.total[before] if start else 0)
        new = self.moves[state << 9 | symbol] = len(self.last)
        self.last.append(token)
        self.total.append(total)
        self.emitted.append(total - self.total[state])
        self.parent.append(state)
        return new


def fragment_map(merges: Merges, before: str, body: str, ends: bool, begins: bool) -> Map:
    """The map of a stretch ``body`` inside one word.

    ``before`` are the word's symbols ahead of it, two longest tokens' length or
    back to the word's beginning (``begins``); ``ends`` says that the word ends
    with ``body``."""
    tails, follows, longest, at = merges.tails, merges.follows, merges.longest, len(before)
    data = before + body
    # Nodes of a place: token -> label, a pair of root and tokens since.  Roots
    # are states before the stretch, or places where several paths meet.
    places: dict[int, dict[int, tuple[int, int]]] = {}
    roots: list = []

    def root(of) -> tuple[int, int]:
        roots.append(of)
        return len(roots) - 1, 0

    for end in range(max(0, at - longest + 1), at + 1):
        held = places[end] = {}
        if begins and end == 0:
            held[-1] = root((-at, -1))
        for start in range(end - 1, max(-1, end - longest - 1), -1):
            token = tails.get(data[start:end], -1)
            if token == -1:
                break
            if token is not None:
                held[token] = root((end - at, token))
    for end in range(at + 1, len(data) + 1):
        held = {}
        for start in range(end - 1, max(-1, end - longest - 1), -1):
            token = tails.get(data[start:end], -1)
            if token == -1:
                break
            if token is None or start not in places:
                continue
            met = [label for last, label in places[start].items() if last == -1 or follows(last, token)]
            if len(met) == 1:
                held[token] = (met[0][0], met[0][1] + 1)
            elif met:
                held[token] = root([(r, n + 1) for r, n in met])
        places[end] = held
        places.pop(end - longest, None)
    resolved: dict[int, dict] = {}

    def states(r: int) -> dict:
        """The states before the stretch that lead to a root, and the tokens."""
        stack = [r]
        while stack:
            top = stack[-1]
            if top in resolved:
                stack.pop()
            elif isinstance(roots[top], tuple):
                resolved[top] = {roots[top]: 0}
            elif missing := [k for k, _ in roots[top] if k not in resolved]:
                stack += missing
            else:
                resolved[top] = {s: n + more for k, more in roots[top] for s, n in resolved[k].items()}
        return resolved[r]

    out: Map = {}
    for end, held in places.items():
        if ends and end < len(data) or end <= len(data) - longest:
            continue
        for token, (r, n) in held.items():
            for state, more in states(r).items():
                out.setdefault(state, {})[START if ends else (end - len(data), token)] = n + more
    return out


def composed(a: Map, b: Map) -> Map:
    """The map of two neighbouring chunks."""
    out: Map = {}
    for state, behind in a.items():
        for border, n in behind.items():
            for last, more in b.get(border, {}).items():
                out.setdefault(state, {})[last] = n + more
    return out


def scanned(maps: list[Map]) -> Map:
    """All maps joined, pair by pair."""
    while len(maps) > 1:
        maps = [composed(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
    return maps[0] if maps else {START: {START: 0}}


@lru_cache(1)
def joining() -> frozenset[str]:
    """Characters that may compose with one before them."""
    pairs = (unicodedata.decomposition(chr(k)).split() for k in range(0x110000))
    seconds = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
    return frozenset(seconds | set(map(chr, [*range(0x1161, 0x1176), *range(0x11A7, 0x11C3)])))


def folded(text: str) -> str:
    return "".join(map(str.lower, unicodedata.normalize("NFC", text)))


class Counter(dict):
    """Token counts of stretches between blanks; a missing one is counted."""

    def __init__(self, path: str):
        import regex

        super().__init__()
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        letters = byte_letters()
        suffix = held["model"]["end_of_word_suffix"]

        def symbols(token: str) -> str:
            ends = token.endswith(suffix)
            data = [letters[c] for c in (token.removesuffix(suffix) if ends else token)]
            return "".join(map(chr, data[:-1])) + chr(data[-1] | WORD_END * ends)

        # Ids in the order of the merges; single symbols come first.
        tokens = {chr(b): b for b in range(2 * WORD_END)}
        pairs: dict[tuple[int, int], int] = {}
        for merge in held["model"]["merges"]:
            a, b = map(symbols, merge.split(" ") if isinstance(merge, str) else merge)
            pairs.setdefault((tokens[a], tokens[b]), tokens.setdefault(a + b, len(tokens)))
        self.transducer = Transducer(Merges(tokens, lambda a, b: pairs.get((a, b))))
        split = next(p["pattern"]["Regex"] for p in held["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split)
        special = [t["content"] for t in held["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

        self.longest_special = max(map(len, special), default=1)
        self.classes = {k: regex.compile(p) for k, p in (("L", r"\p{L}+"), ("N", r"\p{N}"), ("O", r"[^\s\p{L}\p{N}]+"))}

    def __missing__(self, key: str) -> int:
        n = 0
        if self.special and (hits := len(self.special.findall(key))):
            n, parts = hits, self.special.split(key)
        else:
            parts = [key]
        for part in parts:
            if part:
                n += sum(map(self.word, self.pattern.findall(folded(part))))
        if len(key) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = n
        return n

    def word(self, word: str) -> int:
        return self.transducer.word(word.encode("utf-8"))

    def stretches(self, text: str) -> int:
        """The tokens of a text of whole stretches."""
        return sum(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def kind(self, c: str) -> str:
        return next((k for k, p in self.classes.items() if p.match(c)), "S")

    def border(self, text: str, at: int) -> str | None:
        """What a cut is: None where it could change words, a class where it
        falls inside a word of that class, else an empty text."""
        c, reach = text[at], self.longest_special
        if unicodedata.combining(c) or c in joining():
            return None
        if self.special and self.special.search(text[max(0, at - reach) : at + reach]):
            return None
        need = 2 * self.transducer.merges.longest
        left, right = folded(text[max(0, at - 2 * need) : at]), folded(text[at : at + 1])
        if not left:
            return None
        a, b = self.kind(left[-1]), self.kind(right[0])
        if a == b and a in "LO":
            run = left[-need:]
            whole = len(run) == need and self.classes[a].fullmatch(run)
            return a if whole else None
        return None if left[-1] == "'" and b == "L" else ""

    def chunks(self, text: str, size: int | None = None) -> list[tuple[str, str, str, bool]]:
        """(before, class, body, open): the chunks of a text.  ``before`` are the
        characters ahead of a cut inside a word of a class; ``open`` says that the
        chunk ends inside a word."""
        size, out, start, ahead = size or CHUNK, [], 0, ("", "")
        while start < len(text):
            at = start + size
            while at < len(text) and (kind := self.border(text, at)) is None:
                at += 1
            inside = at < len(text) and bool(kind)
            out.append((*ahead, text[start:at], inside))
            ahead = (text[max(0, at - 4 * self.transducer.merges.longest) : at], kind) if inside else ("", "")
            start = at
        return out

    def symbols(self, word: str, whole: bool) -> str:
        data = word.encode("utf-8").decode("latin-1")
        return data[:-1] + chr(ord(data[-1]) | WORD_END) if whole and data else data

    def chunk_map(self, before: str, kind: str, body: str, inside: bool) -> Map:
        """The map of one chunk."""
        merges = self.transducer.merges
        need = 2 * merges.longest
        cut = len(body)
        words: list[str] = []
        if inside:
            # The last word goes on behind the chunk: it begins in the last stretch.
            cut = max(body.rfind(" "), body.rfind("\n")) + 1
            words = self.pattern.findall(folded(body[cut:]))
        if not kind:
            if not inside:
                return {START: {START: self.stretches(body)}}
            first = {START: {START: self.stretches(body[:cut]) if cut else 0}}
        else:
            stop = min((k for k in (body.find(" "), body.find("\n")) if k >= 0), default=len(body))
            head = folded(self.special.split(body[:stop])[0] if self.special else body[:stop])
            run = self.classes[kind].match(head)[0]
            ahead = self.symbols(folded(before), False)[-need:]
            through = inside and stop == len(body) and len(run) == len(head) and len(head) == len(folded(body))
            if through:
                return fragment_map(merges, ahead, self.symbols(run, False), False, False)
            if inside and cut == 0:
                # Head and open tail share the only stretch.
                rest = self._pieces(body, len(run))
                middle, tail = sum(map(self.word, rest[:-1])) + self._specials(body), rest[-1]
                first = composed(fragment_map(merges, ahead, self.symbols(run, True), True, False), {START: {START: middle}})
                return composed(first, self._open(tail))
            rest = self._pieces(body[:stop], len(run))
            count = sum(map(self.word, rest)) + self._specials(body[:stop]) + (self.stretches(body[stop:cut]) if stop < cut else 0)
            first = composed(fragment_map(merges, ahead, self.symbols(run, True), True, False), {START: {START: count}})
            if not inside:
                return first
        pieces = self._pieces(body[cut:], 0)
        middle = sum(map(self.word, pieces[:-1])) + self._specials(body[cut:])
        return composed(first, composed({START: {START: middle}}, self._open(pieces[-1])))

    def _specials(self, stretch: str) -> int:
        return len(self.special.findall(stretch)) if self.special else 0

    def _pieces(self, stretch: str, skip: int) -> list[str]:
        """The words of a stretch, without the ``skip`` characters that end a word
        before it."""
        out = []
        for part in self.special.split(stretch) if self.special else [stretch]:
            out += self.pattern.findall(folded(part), skip)
            skip = 0
        return out

    def _open(self, word: str) -> Map:
        """The map from the start to the open end of a word."""
        found = fragment_map(self.transducer.merges, "", self.symbols(word, False), False, True)
        return {START: found[0, -1]}

    def count(self, text: str) -> int:
        if len(text) <= CHUNK:
            return self.stretches(text)
        return scanned([self.chunk_map(*c) for c in self.chunks(text)])[START][START]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of a vocabulary file, loaded once in each worker process."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _starter(path: str, limit: int):
    def start():
        held = counter(path)

        def step(ids, texts):
            out = []
            for i, text in zip(ids, texts):
                n = held.count(text or "")
                out.append((i, len((text or "").encode("utf-8", "surrogatepass")), n, n > limit))
            return out

        return step

    return start


def _cut(path: str):
    import pyarrow as pa

    def run(batches):
        held = None
        for batch in batches:
            held = held or counter(path)
            rows = [(d, k, *c) for d, t in zip(*(c.to_pylist() for c in batch.columns)) for k, c in enumerate(held.chunks(t))]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["digest", "no", "before", "kind", "body", "inside"])

    return run


def _mapped(path: str):
    def start():
        held = counter(path)

        def step(digests, numbers, before, kinds, bodies, inside):
            out = []
            for d, no, *chunk in zip(digests, numbers, before, kinds, bodies, inside):
                links = [(*s, *t, n) for s, behind in held.chunk_map(*chunk).items() for t, n in behind.items()]
                out.append((d, no, *map(list, zip(*links))))
            return out

        return step

    return start


def _joined(table):
    """The tokens of one text by its chunks' maps."""
    import pyarrow as pa

    rows = sorted(table.to_pylist(), key=lambda r: r["no"])
    maps = []
    for r in rows:
        held: Map = {}
        for a, s, b, t, n in zip(r["a"], r["s"], r["b"], r["t"], r["n"]):
            held.setdefault((a, s), {})[b, t] = n
        maps.append(held)
    return pa.table({"digest": pa.array([rows[0]["digest"]], pa.string()), "n_tokens": pa.array([scanned(maps)[START][START]], pa.int64())})


def count_tokens(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK
) -> DataFrame:
    """Bytes and tokens of each whole text, and whether it has over ``limit``.

    Texts of more than ``chunk`` characters are counted by chunks, once for
    equal texts."""
    import public_tokenizers

    path = path or public_tokenizers.path(VOCABULARY)
    schema = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    rows = docs.select(id_column, text_column)
    text = F.col(f"`{text_column}`")
    long = F.coalesce(F.length(text) > chunk, F.lit(False))
    whole = map_rows(rows.where(~long), [id_column, text_column], schema, _starter(path, limit))
    bounded_batches(docs.sparkSession)
    keyed = rows.where(long).select(F.col(f"`{id_column}`").alias("__id"), text.alias("__text"), F.md5(text).alias("digest"))
    cut = keyed.select("digest", "__text").mapInArrow(_cut(path), "digest string, no int, before string, kind string, body string, inside boolean")
    maps = map_rows(
        cut.dropDuplicates(["digest", "no"]), ["digest", "no", "before", "kind", "body", "inside"],
        "digest string, no int, a array<int>, s array<int>, b array<int>, t array<int>, n array<bigint>", _mapped(path),
    )
    totals = stored(maps.groupBy("digest").applyInArrow(_joined, "digest string, n_tokens bigint"), "long-texts")
    parts = keyed.select("__id", "digest", F.octet_length("__text").cast("bigint").alias("n_bytes")).join(small(totals), "digest")
    parts = parts.select(F.col("__id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    return whole.union(parts)
