"""Personal data: exact base patterns, and a linear-chain conditional random
field over word shapes that adds what the patterns miss.

Base kinds (leftmost, not overlapping within a kind; a match that fails its
test is dropped and still uses up its text): ``email``, ``ip`` (parts at most
255), ``card`` (12 to 19 digits passing Luhn), ``phone`` (9 to 15 digits behind
a plus sign).

The field is trained when a query is planned, from a small table of labelled
lines (``pii_table.LINES``): numbers without a plus sign, spelt-out or bracketed
mail and network addresses, cards with other signs between their digits, and what
is taken for such.  Its features are shapes of whole words and of their
neighbours and a few cue words, never the word itself.  Only marked words can be
in a span: those with a digit or an ``@``, those with a bracketed ``at`` or dot,
and the neighbours of a word ``dot``.  That cuts texts into runs, which are decoded by
Viterbi in batches of equal length; a line end or more than ``GAP`` blanks end a
run, so no added span reaches over them.  A span is added if it
meets no base span and passes its kind's own test, with the spelling undone: an
address by the base pattern, network parts at most 255, a card's length and
check digit, 9 to 15 digits of a phone.

Defined results: a null text is the empty text (no spans, the hash of the empty
string); repeated rows give repeated rows; ``find_personal_data`` reads no
other column and ``redact`` keeps them all; an empty table gives an empty
table.  Texts are scanned whole, in time linear in their length; words of more
than ``LONGEST_REMEMBERED`` characters are not kept in a worker's tables.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache, wraps
from hashlib import sha256
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame

from .common import bounded_batches, map_rows
from .pii_table import LINES

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Words that can be part of a span: those with a digit or an @.
CANDIDATE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")

#: A bracketed at or dot, and the word dot: how addresses are spelt out.
SPELT = re.compile(r"[(\[{](?:at|dot|\.)[)\]}]|(?<!\S)dot(?!\S)", re.I)
AT_WORD = re.compile(r"[(\[{]?at[)\]}]?", re.I)

CUES = {
    "mail": {"mail", "email", "e-mail", "correo", "write", "contact", "send", "reach", "escribe", "schreib", "address"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone", "cell", "ring", "dial", "text", "hotline", "appelez", "llame", "rufen", "handy", "móvil", "portable", "whatsapp", "sms"},
    "card": {"card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta"},
    "ip": {"ip", "host", "server", "from", "blocked", "login"},
    "id": {
        "key", "token", "id", "order", "version", "v", "no", "nr", "page", "pages", "isbn", "hash", "commit", "year", "invoice", "ticket", "ref", "serial", "part", "sku", "case",
        "item", "batch", "model", "account", "tracking", "bestellung", "rechnung", "commande", "facture", "factura", "pedido", "release", "section", "chapter", "build", "lot", "zip",
        "rfc", "iso", "issue", "revision", "article", "patent", "file", "row", "rows", "count", "total", "seed", "sum", "reference", "referencia", "référence", "auftrag", "kunde", "parcel",
    },
    "number": {"number", "numero", "número", "numéro", "nummer", "is", "al", "le", "an", "sie", "to", "a", "me", "on", "us", "the", "for", "at", "or", "and", "our", "my", "her", "his"},
    "dot": {"dot"},
}
TAGS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])


# ---------------------------------------------------------------- base spans


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ to both sides, so that no stretch is read twice."""
    out, used, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > used and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, used := m.end()))
        at = text.find("@", max(at + 1, used))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if "@" in text:
        found += [(a, b, 0) for a, b in emails(text)]
    if "." in text:
        found += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
    if "+" in text:
        found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdecimal, m[0])) <= 15]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


# ------------------------------------------------------------ features, field


#: White space inside a run at most.
GAP = 4
#: Longer words are not remembered.
LONGEST_REMEMBERED = 64


def remembered(f):
    """Results of short words in a bounded table."""
    held = lru_cache(1 << 16)(f)

    @wraps(f)
    def of(word):
        return held(word) if len(word) <= LONGEST_REMEMBERED else f(word)

    return of


@remembered
def shape(word: str) -> str:
    """Letters as x, digits as their run length up to 5, the rest as it is."""
    out = re.sub("[^\\W\\d_]+", "x", word)
    return re.sub("\\d+", lambda m: str(min(len(m[0]), 5)), out)


@remembered
def cue(word: str) -> str:
    w = word.strip(".,:;()[]{}<>#\"'").lower()
    return next((k for k, words in CUES.items() if w in words), "-")


@remembered
def own_features(word: str) -> tuple[str, ...]:
    digits = sum(map(str.isdigit, word))
    s = shape(word.strip(EDGES))
    return (
        f"s={s}",
        f"p={s[:4]}",
        f"e={s[-3:]}",
        f"d={digits if digits < 20 else 'more'}",
        f"c={''.join(sorted({c for c in word if not c.isalnum()}))}",
        f"a={any(map(str.isalpha, word))}|{digits > 0}|{word[-1:] in ',;.'}",
        f"@={word.count('@')}|{'.' in word.partition('@')[2].strip('.')}",
        f"k={cue(word)}|{SPELT.search(word) is not None}",
        f"t={','.join(k for k in KINDS if plausible(word.strip('.,;:!?'), k))}",
    )


def features(before: list[str], words: list[str], after: list[str]) -> list[list[str]]:
    """Of each word of a run, with the words around the run."""
    line = [*["^"] * (2 - len(before)), *before, *words, *after, *["$"] * (2 - len(after))]
    near = [shape(w.strip(EDGES)) if has_mark(w) else "w" for w in line]
    cues = [cue(w) for w in line]
    # The last telling cue in front of each word.
    told = list(accumulate(cues, lambda held, k: held if k in ("-", "number") else k, initial="-"))
    return [
        [
            "bias",
            *own_features(line[at]),
            f"-s={near[at - 1]}",
            f"+s={near[at + 1]}",
            f"-c={cues[at - 1]}",
            f"-2c={cues[at - 2]}",
            f"+c={cues[at + 1]}",
            f"-cc={cues[at - 2]}|{cues[at - 1]}",
            f"--={told[at]}",
        ]
        for at in range(2, 2 + len(words))
    ]


def has_mark(word: str) -> bool:
    return "@" in word or any(map(str.isdigit, word))


#: Signs around a word that are not part of a span.
EDGES = ".,;:!?()[]{}<>\"'"


def labelled_table(lines: str = LINES) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans) of each line of a labelled table."""
    out = []
    for line in filter(None, lines.split("\n")):
        text, spans, at = "", [], 0
        for m in re.finditer(r"\[(email|ip|card|phone):((?:[^\[\]]|\[(?:at|dot|\.)\])*)\]", line):
            text += line[at : m.start()]
            spans.append((len(text), len(text) + len(m[2]), m[1]))
            text, at = text + m[2], m.end()
        out.append((text + line[at:], spans))
    return out


class Field:
    """Weights of a linear-chain conditional random field."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.names, self.emit, self.move, self.start = names, emit, move, start

    def scores(self, before: list[str], words: list[str], after: list[str]) -> np.ndarray:
        known = self.names.get
        return np.stack([self.emit[[k for f in own if (k := known(f)) is not None]].sum(0) for own in features(before, words, after)])

    def decode(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of runs of scores, batched by length."""
        out: list = [None] * len(runs)
        by_length: dict[int, list[int]] = {}
        for k, x in enumerate(runs):
            by_length.setdefault(len(x), []).append(k)
        for n, ks in by_length.items():
            x = np.stack([runs[k] for k in ks])
            best, back = self.start + x[:, 0], []
            for t in range(1, n):
                reach = best[:, :, None] + self.move
                back.append(reach.argmax(1))
                best = reach.max(1) + x[:, t]
            tags = np.empty((len(ks), n), np.int64)
            # The word behind a run is outside.
            tags[:, -1] = (best + self.move[:, 0]).argmax(1)
            for t in range(n - 2, -1, -1):
                tags[:, t] = np.take_along_axis(back[t], tags[:, t + 1, None], 1)[:, 0]
            for k, row in zip(ks, tags):
                out[k] = row
        return out


def train(table, rounds: int = 150, rate: float = 0.3, decay: float = 0.05) -> Field:
    """Full-batch gradient ascent (with per-weight steps) on the likelihood of
    the marked runs of the labelled lines."""
    names: dict[str, int] = {}
    runs = []
    for text, spans in table:
        for group in marked_runs(text):
            before, words, after = surroundings(text, group)
            tags = []
            for a, b in group:
                held = next(((x, k) for x, y, k in spans if a < y and x < b), None)
                tags.append(0 if held is None else TAGS.index(f"{'B' if a <= held[0] else 'I'}-{held[1]}"))
            rows = [[names.setdefault(f, len(names)) for f in own] for own in features(before, words, after)]
            runs.append((rows, tags))
    n, width = len(TAGS), len(runs[0][0][0])
    emit, move, start = np.zeros((len(names), n)), np.zeros((n, n)), np.zeros(n)
    # A span goes on only inside of one of its kind.
    barred = np.array([[b.startswith("I-") and a not in (b, "B" + b[1:]) for b in TAGS] for a in TAGS])
    move[barred] = -1e4
    start[barred[0]] = -1e4
    groups: dict[int, list] = {}
    for rows, tags in runs:
        groups.setdefault(len(rows), []).append((rows, tags))
    packed = [(np.array([x[0] for x in g]).reshape(len(g), k, width), np.array([x[1] for x in g])) for k, g in groups.items()]
    sums = [np.full_like(emit, 1e-8), np.full_like(move, 1e-8), np.full_like(start, 1e-8)]
    for _ in range(rounds):
        g_emit, g_move, g_start = -decay * emit, np.where(barred, 0, -decay * move), np.where(barred[0], 0, -decay * start)
        for rows, tags in packed:
            count, length = tags.shape
            x = emit[rows].sum(2)
            ahead, behind = [start + x[:, 0]], [np.zeros((count, n)) + move[:, 0]]
            for t in range(1, length):
                ahead.append(_lse(ahead[-1][:, :, None] + move, 1) + x[:, t])
                behind.append(_lse(move + (x[:, length - t] + behind[-1])[:, None, :], 2))
            behind.reverse()
            norm = _lse(ahead[-1] + move[:, 0], 1)
            want = np.eye(n)[tags]
            for t in range(length):
                p = np.exp(ahead[t] + behind[t] - norm[:, None])
                miss = want[:, t] - p
                np.add.at(g_emit, rows[:, t].ravel(), np.repeat(miss, width, 0))
                if t == 0:
                    g_start += miss.sum(0)
                else:
                    pair = np.exp(ahead[t - 1][:, :, None] + move + (x[:, t] + behind[t])[:, None, :] - norm[:, None, None])
                    g_move += np.einsum("ij,ik->jk", want[:, t - 1], want[:, t]) - pair.sum(0)
            end = np.exp(ahead[-1] + move[:, 0] - norm[:, None])
            g_move[:, 0] += (want[:, -1] - end).sum(0)
        g_move[barred], g_start[barred[0]] = 0, 0
        for weights, g, s in zip((emit, move, start), (g_emit, g_move, g_start), sums):
            s += g * g
            weights += rate * g / np.sqrt(s)
    return Field(names, emit, move, start)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


@lru_cache(1)
def trained() -> Field:
    return train(labelled_table())


# ------------------------------------------------------------------ scanning



def _word_before(text: str, at: int) -> tuple[int, int]:
    while at and text[at - 1].isspace():
        at -= 1
    start = at
    while start and not text[start - 1].isspace():
        start -= 1
    return start, at


def _word_after(text: str, at: int) -> tuple[int, int]:
    while at < len(text) and text[at].isspace():
        at += 1
    end = at
    while end < len(text) and not text[end].isspace():
        end += 1
    return at, end


LINE_END = re.compile(r"[\n\r\x0b\x0c\x85\u2028\u2029]")


def marked_runs(text: str) -> list[list[tuple[int, int]]]:
    """The places of marked words, in runs with only white space between."""
    places = {m.span() for m in CANDIDATE.finditer(text)}
    last = -1
    for m in SPELT.finditer(text):
        if m.start() < last:
            continue
        start, end = _word_before(text, m.end())[0], _word_after(text, m.start())[1]
        last = end
        places.add((start, end))
        for step, side in ((_word_before, start), (_word_after, end)):
            word = step(text, side)
            if word[0] < word[1]:
                places.add(word)
            beyond = step(text, word[0] if step is _word_before else word[1])
            if AT_WORD.fullmatch(text[beyond[0] : beyond[1]]):
                places.add(beyond)
                places.add(step(text, beyond[0] if step is _word_before else beyond[1]))
    runs: list[list[tuple[int, int]]] = []
    for place in sorted(p for p in places if p[0] < p[1]):
        gap = text[runs[-1][-1][1] : place[0]] if runs and place[0] - runs[-1][-1][1] <= GAP else ""
        if gap.isspace() and not LINE_END.search(gap):
            runs[-1].append(place)
        else:
            runs.append([place])
    return runs


def surroundings(text: str, group: list[tuple[int, int]]) -> tuple[list[str], list[str], list[str]]:
    """Up to two whole words before a run, its words, and up to two behind."""
    before, after = [], []
    start, end = group[0][0], group[-1][1]
    for _ in range(2):
        (start, stop), (first, end) = _word_before(text, start), _word_after(text, end)
        before, after = [text[start:stop], *before] if start < stop else before, [*after, text[first:end]] if first < end else after
    return before, [text[a:b] for a, b in group], after


def added_spans(texts: list[str], base: list[list[tuple[int, int, str]]], field: Field) -> list[list[tuple[int, int, str]]]:
    """For each text the field's spans that meet no base span."""
    runs, places = [], []
    for k, text in enumerate(texts):
        for group in marked_runs(text):
            runs.append(field.scores(*surroundings(text, group)))
            places.append((k, group))
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    firsts = [[a for a, _, _ in spans] for spans in base]
    reaches = [list(accumulate((b for _, b, _ in spans), max)) for spans in base]
    for tags, (k, group) in zip(field.decode(runs), places):
        at = 0
        while at < len(tags):
            tag = TAGS[tags[at]]
            if tag[0] != "B":
                at += 1
                continue
            end = at + 1
            while end < len(tags) and TAGS[tags[end]] == "I" + tag[1:]:
                end += 1
            a, b = trimmed(texts[k], group[at][0], group[end - 1][1])
            # Base spans that begin before the end, and how far these reach.
            met = bisect_left(firsts[k], b)
            if a < b and not (met and reaches[k][met - 1] > a) and plausible(texts[k][a:b], tag[2:]):
                out[k].append((a, b, tag[2:]))
            at = end
    return out


PAIRED = re.compile(r".[^()\[\]{}]*[)\]}].")


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A span without the signs around it; brackets that pair inside it stay."""
    while a < b and text[a] in EDGES and not (text[a] in "([{" and PAIRED.match(text, a, b)):
        a += 1
    while b > a and text[b - 1] in EDGES:
        b -= 1
    return a, b


def plausible(span: str, kind: str) -> bool:
    """Whether a span, with its spelling undone, passes the test of its kind."""
    plain = re.sub(r"(?i)\s*[(\[{]dot[)\]}]\s*|\s+dot\s+|[(\[{]\.[)\]}]", ".", span)
    digits = re.sub(r"\D", "", span)
    if kind == "email":
        plain = re.sub(r"(?i)\s*[(\[{]at[)\]}]\s*|\s+at\s+", "@", plain)
        return emails(plain) == [(0, len(plain))]
    if kind == "ip":
        return re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", plain) is not None and all(int(p) <= 255 for p in plain.split("."))
    if kind == "card":
        return re.fullmatch(r"[0-9](?:[ ./_-]?[0-9])+", span) is not None and 12 <= len(digits) <= 19 and luhn(digits)
    return re.fullmatch(r"\+?\(?[0-9][0-9 ()./-]*[0-9]", span) is not None and 9 <= len(digits) <= 15


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def all_spans(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """For each text its base spans and all its spans, in order."""
    base = [base_spans(t) for t in texts]
    more = added_spans(texts, base, field)
    order = lambda s: (s[0], KINDS.index(s[2]))
    return [(b, sorted([*b, *m], key=order)) for b, m in zip(base, more)]


def _starter(field: Field):
    def start():
        def step(ids, texts):
            out = []
            for i, (base, spans) in zip(ids, all_spans([t or "" for t in texts], field)):
                n = [sum(s[2] == k for s in base) for k in KINDS]
                out.append((i, *n, sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base), len(spans)))
            return out

        return step

    return start


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", field: Field | None = None) -> DataFrame:
    """One row for each input row: base counts, their digest, and all spans."""
    schema = (
        f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, n_email bigint, n_ip bigint, n_card bigint, "
        "n_phone bigint, base_sha256 string, spans string, n_added bigint, n_spans bigint"
    )
    return map_rows(docs, [id_column, text_column], schema, _starter(field or trained()))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or what spans cover together, put out by name."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_column: str = "text", length_column: str | None = "n_chars", field: Field | None = None) -> DataFrame:
    """The same rows and columns, with personal data put out by its kind's name
    and ``length_column``, where there is one, set to the new length; texts
    without personal data, null ones too, stay as they are."""
    import pyarrow as pa

    field = field or trained()
    at = docs.columns.index(text_column)
    length = docs.columns.index(length_column) if length_column in docs.columns else None
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            columns, texts = list(batch.columns), batch.column(at).to_pylist()
            new, sizes = list(texts), None if length is None else batch.column(length).to_pylist()
            for k, (_, spans) in enumerate(all_spans([t or "" for t in texts], field)):
                if spans:
                    new[k] = masked(texts[k], spans)
                    if sizes is not None:
                        sizes[k] = len(new[k])
            columns[at] = pa.array(new, columns[at].type)
            if sizes is not None:
                columns[length] = pa.array(sizes, columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
