"""SentencePiece encoding and decoding by vectorised merge rounds.

The words of a batch are one flat array of symbols.  A round finds the best pair
of each word (a segmented minimum of ranks), merges its occurrences from the left
all at once, takes the merged symbols out, and sets words without any pair aside;
rounds go on until no pair is left.  Where a merge may make a pair that is as good
as the one just merged, only its first occurrence is merged in that round, so the
order is that of one merge after another.

Blanks are marks at the beginning of words, and no piece of a vocabulary may hold
a mark behind another character (that is verified), so words are encoded apart.
Long words are cut into windows that overlap.  Two windows are joined at a
boundary of tokens that both have, if the tokens on its sides stay apart when they
are encoded together; a window without such a boundary is encoded again from an
earlier boundary on.

Defined results: a null text is the empty text (no ids); repeated rows give
repeated rows; other columns of the input are not read; an empty table gives an
empty table.  Texts are encoded whole, in time linear in their length.  Only
models of pairs without a normaliser of characters are taken: others raise.
"""

from __future__ import annotations

import re
from hashlib import sha256

from pyspark.sql import DataFrame

from .common import map_rows

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Words that a worker remembers; a full memory is emptied, never a wrong one.
REMEMBERED = 200_000
#: Longer words are not remembered.
LONGEST_REMEMBERED = 64
#: Symbols of a window, and of what two windows share.
WINDOW, SHARED = 112, 48
#: Symbols in one call of the rounds.
FLAT = 1 << 18
#: Rank of what is no pair.
NONE = 1 << 30


class Model:
    """Pieces of a model file as arrays: direct addresses of characters and the
    sorted pairs of symbols that merge, with ranks and merged symbols."""

    def __init__(self, path: str):
        import numpy as np
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.Normalize(" ﬁ  Ａ") != f"{MARK}{MARK}ﬁ{MARK}{MARK}Ａ":
            raise ValueError(f"{path} normalises characters or has no mark in front; such models are not taken")
        n = len(sp)
        names = sp.IdToPiece(list(range(n)))
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        pieces: dict[str, int] = {}
        for i, name in enumerate(names):
            if sp.IsByte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.bytes_of.append(bytes([int(name[3:5], 16)]))
            elif sp.IsControl(i) or sp.IsUnknown(i) or sp.IsUnused(i):
                self.bytes_of.append(b"" if sp.IsControl(i) else " ⁇ ".encode())
            else:
                pieces[name] = i
                self.bytes_of.append(name.replace(MARK, " ").encode())
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError(f"{path} has pieces with a mark behind other characters")
        if len(self.byte_ids) < 256:
            raise ValueError(f"{path} has no pieces for all bytes")
        self.size, self.longest = n, max(map(len, pieces))
        self.digits = [*map(str, range(n))]
        symbols = dict(pieces)
        for p in pieces:
            for c in p:
                symbols.setdefault(c, len(symbols) + n)
        #: What is no character of any piece has the last symbol.
        self.strange = n + len(symbols)
        self.char = np.full(0x110000, self.strange, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        by_score = {s: r for r, s in enumerate(sorted({sp.GetScore(i) for i in pieces.values()}, reverse=True))}
        rows = []
        for p, i in pieces.items():
            rank = by_score[sp.GetScore(i)]
            for k in range(1, len(p)):
                left, right = symbols.get(p[:k]), symbols.get(p[k:])
                if left is not None and right is not None:
                    rows.append((left << 20 | right, rank, i))
        pairs = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.merged = pairs[:, 0].copy(), pairs[:, 1].copy(), pairs[:, 2].copy()
        #: Merged symbols that take part in a pair as good as their own merge or better.
        best = np.full(self.strange + 1, NONE, np.int64)
        for side in (self.keys >> 20, self.keys & 0xFFFFF):
            np.minimum.at(best, side, self.ranks)
        own = np.full(self.strange + 1, -1, np.int64)
        own[self.merged] = self.ranks
        self.single = best <= own
        self.apart: dict[tuple[int, int], bool] = {}

    def pairs(self, left, right):
        """Ranks and merged symbols of pairs; ``NONE`` where there is none."""
        import numpy as np

        if not len(self.keys):
            return np.full(len(left), NONE, np.int64), np.zeros(len(left), np.int64)
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        met = self.keys[at] == key
        return np.where(met, self.ranks[at], NONE), self.merged[at]

    # ------------------------------------------------------------ merge rounds

    def rounds(self, symbols, word):
        """Merge ``symbols`` (flat, of words numbered by the ascending ``word``) until
        no pair is left: (word, symbol, place of its first character) of what stays,
        in order."""
        import numpy as np

        place = np.arange(len(symbols))
        rank, made = np.full(len(symbols), NONE, np.int64), np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            rank[:-1], made[:-1] = self.pairs(symbols[:-1], symbols[1:])
            rank[:-1][word[1:] != word[:-1]] = NONE
        done = []
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[first, len(symbols)])
            least = np.minimum.reduceat(rank, first)
            if (least == NONE).any():
                # Words that are ready leave the arrays.
                ready = np.repeat(least == NONE, sizes)
                done.append((word[ready], symbols[ready], place[ready]))
                stay = ~ready
                symbols, word, place, rank, made = symbols[stay], word[stay], place[stay], rank[stay], made[stay]
                sizes, least = sizes[least < NONE], least[least < NONE]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            # Of hits side by side every second one is left over: its left half is taken.
            begins = np.r_[True, np.diff(hit) != 1]
            run = np.maximum.accumulate(np.where(begins, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            # Words in which a merge may make a pair as good take the first hit only.
            alone = self.single[made[hit]]
            if alone.any():
                own = word[hit]
                later = np.r_[False, own[1:] == own[:-1]]
                careful = np.isin(own, own[alone])
                hit = hit[~(later & careful)]
            symbols[hit] = made[hit]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            at = hit - np.arange(len(hit))
            symbols, word, place, rank, made = symbols[stay], word[stay], place[stay], rank[stay], made[stay]
            for near in (at, at[at > 0] - 1):
                near = near[near + 1 < len(symbols)]
                r, m = self.pairs(symbols[near], symbols[near + 1])
                r[word[near] != word[near + 1]] = NONE
                rank[near], made[near] = r, m
            rank[-1] = NONE
        if not done:
            return word, symbols, place
        word, symbols, place = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place, kind="stable")
        return word[order], symbols[order], place[order]

    def words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word; marks stand for blanks."""
        import numpy as np

        out: list[list[int]] = [[] for _ in words]
        group, held = [], 0
        for n, w in enumerate(words):
            if len(w) > WINDOW:
                out[n] = self.long_word(np.frombuffer(w.encode("utf-32-le"), np.uint32))
                continue
            group.append(n)
            held += len(w)
            if held >= FLAT:
                self._group(words, group, out)
                group, held = [], 0
        self._group(words, group, out)
        return out

    def _group(self, words, group, out) -> None:
        import numpy as np

        if not group:
            return
        chars = np.frombuffer("".join(words[n] for n in group).encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(group)), [len(words[n]) for n in group])
        word, symbols, place = self.rounds(self.char[chars], word)
        ends = np.searchsorted(word, np.arange(len(group)), side="right")
        strange = np.flatnonzero(symbols >= self.size)
        flat = symbols.tolist()
        if len(strange):
            extra, whole, at = np.zeros(len(symbols), np.int64), [], 0
            for k in strange.tolist():
                made = self.ids(symbols[k : k + 1], place[k : k + 1], chars)
                whole += flat[at:k] + made
                extra[k], at = len(made) - 1, k + 1
            flat = whole + flat[at:]
            ends = ends + np.r_[0, np.cumsum(extra)][ends]
        at = 0
        for n, end in zip(group, ends.tolist()):
            out[n] = flat[at:end]
            at = end

    def ids(self, symbols, place, chars) -> list[int]:
        """Ids of symbols; what is no piece is given by its bytes."""
        got = symbols.tolist()
        if not (symbols >= self.size).any():
            return got
        ids: list[int] = []
        for s, p in zip(got, place.tolist()):
            if s < self.size:
                ids.append(s)
            else:
                ids += [self.byte_ids[b] for b in chr(chars[p]).encode("utf-8", "surrogatepass")]
        return ids

    def long_word(self, chars) -> list[int]:
        """The ids of a word by windows."""
        import numpy as np

        step = WINDOW - SHARED
        starts = np.arange(0, max(1, len(chars) - SHARED), step)
        parts = []
        for k in range(0, len(starts), FLAT // WINDOW):
            own = starts[k : k + FLAT // WINDOW]
            ends = np.minimum(own + WINDOW, len(chars))
            sizes = ends - own
            flat = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(own, sizes)
            word, symbols, place = self.rounds(self.char[chars[flat]], np.repeat(np.arange(len(own)), sizes))
            cuts = np.flatnonzero(np.diff(word)) + 1
            parts += list(zip(np.split(symbols, cuts), np.split(flat[place], cuts)))
        symbols, places = [parts[0][0]], [parts[0][1]]
        for n, (s, p) in enumerate(parts[1:], 1):
            self._join(symbols, places, s, p, min(int(starts[n]) + WINDOW, len(chars)), chars)
        return self.ids(np.concatenate(symbols), np.concatenate(places), chars)

    def _join(self, symbols: list, places: list, s, p, end: int, chars) -> None:
        """Put a window (symbols with places, up to ``end``) behind what is joined.

        Tokens that stay apart from their neighbours are an encoding, so a boundary
        that both sides have will do if the tokens around it stay apart."""
        import numpy as np

        a, at = symbols[-1], places[-1]
        _, i, j = np.intersect1d(at, p, assume_unique=True, return_indices=True)
        for x, y in zip(i.tolist(), j.tolist()):
            if x and self._apart(a, at, x - 1, int(at[x]), s, p, y, end, chars):
                symbols[-1], places[-1] = a[:x], at[:x]
                symbols.append(s[y:])
                places.append(p[y:])
                return
        # None: encode again from an earlier boundary of what is joined.
        back = 2 * self.longest
        while True:
            a, at = symbols[-1], places[-1]
            k = int(np.searchsorted(at, max(0, int(p[0]) - back)))
            if k == 0 and len(symbols) > 1:
                symbols[-2:], places[-2:] = [np.concatenate(symbols[-2:])], [np.concatenate(places[-2:])]
                continue
            begin = int(at[k]) if k < len(at) else int(p[0])
            flat = np.arange(begin, end)
            _, s2, p2 = self.rounds(self.char[chars[flat]], np.zeros(len(flat), np.int64))
            p2 = flat[p2]
            if not k or self._apart(a, at, k - 1, begin, s2, p2, 0, end, chars):
                symbols[-1], places[-1] = np.concatenate([a[:k], s2]), np.concatenate([at[:k], p2])
                return
            back *= 2

    def _apart(self, a, at, x: int, middle: int, s, p, y: int, end: int, chars) -> bool:
        """Whether token ``x`` of one part and ``y`` of the next stay apart."""
        import numpy as np

        key = (int(a[x]), int(s[y]))
        held = self.apart.get(key) if max(key) < self.strange else None
        if held is None:
            if len(self.apart) >= REMEMBERED:
                self.apart.clear()
            both = self.char[chars[int(at[x]) : int(p[y + 1]) if y + 1 < len(p) else end]]
            _, got, cut = self.rounds(both, np.zeros(len(both), np.int64))
            held = self.apart[key] = got.tolist() == [*key] and int(at[x]) + int(cut[1]) == middle
        return held

    # ---------------------------------------------------------------- decoding

    def decode(self, ids) -> str:
        """The text of ids: one mark in front goes, bytes that are no character each
        become the replacement character."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return plain(raw)


def plain(raw: bytes) -> str:
    text = decoded(raw)
    return text[1:] if text.startswith(" ") else text


def decoded(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            try:
                out.append(raw[at:].decode())
                break
            except UnicodeDecodeError as e:
                out += [raw[at : at + e.start].decode(), "�"]
                at += e.start + 1
        return "".join(out)


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """The model of a file, loaded once in each worker process."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


class Encoder:
    """Texts to ids with a bounded memory of words, each kept without the mark in front."""

    def __init__(self, m: Model):
        self.model, self.known = m, {}
        self.split = re.compile(f"{MARK}({MARK}*[^{MARK}]*)")

    def parts(self, text: str) -> list[str]:
        """The words of a text, less one mark in front of each."""
        if not text:
            return []
        if "  " in text or text[0] == " " or MARK in text:
            return self.split.findall(MARK + text.replace(" ", MARK))
        return text.split(" ")

    def texts(self, texts: list[str]) -> list[str]:
        """The ids of each text as decimal numbers joined by commas."""
        out, late, get = [], [], self.known.__getitem__
        for n, text in enumerate(texts):
            words = self.parts(text)
            try:
                out.append(",".join(map(get, words)))
            except KeyError:
                out.append("")
                late.append((n, words))
        if late:
            self._learn({w for _, words in late for w in words})
            for n, words in late:
                out[n] = ",".join(map(self.known.__getitem__, words))
            for w in self.long:
                del self.known[w]
        return out

    def _learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known, fresh = {}, list(words)
        name = self.model.digits.__getitem__
        self.known.update(zip(fresh, [",".join(map(name, ids)) for ids in self.model.words([MARK + w for w in fresh])]))
        self.long = [w for w in fresh if len(w) > LONGEST_REMEMBERED]


def _starter(path: str, keep_ids: bool):
    def start():
        coder = Encoder(model(path))
        raw = {str(i): b for i, b in enumerate(coder.model.bytes_of)}

        def step(ids, texts):
            out = []
            for at in range(0, len(ids), 64):
                own = [t or "" for t in texts[at : at + 64]]
                for i, joined in zip(ids[at : at + 64], coder.texts(own)):
                    tokens = joined.split(",") if joined else []
                    text = plain(b"".join(map(raw.__getitem__, tokens)))
                    row = (i, len(tokens), sha256(joined.encode()).hexdigest(), sha256(text.encode()).hexdigest())
                    out.append((*row, list(map(int, tokens))) if keep_ids else row)
            return out

        return step

    return start


def encode_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Encode each whole text, decode the ids again, and give digests of both; with
    ``keep_ids`` also the ids."""
    import public_tokenizers

    schema = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * keep_ids
    return map_rows(docs, [id_column, text_column], schema, _starter(path or public_tokenizers.path(VOCABULARY), keep_ids))


def decode_ids(rows: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text) of rows with arrays of ids; null ids are no ids."""
    import public_tokenizers

    file = path or public_tokenizers.path(VOCABULARY)

    def start():
        held = model(file)
        return lambda keys, ids: [(k, held.decode(i or [])) for k, i in zip(keys, ids)]

    return map_rows(rows, [id_column, ids_column], f"`{id_column}` {rows.schema[id_column].dataType.simpleString()}, text string", start)
