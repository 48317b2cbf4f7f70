"""Phrase collocations by direct-address tiles of ranked word ids.

Words are counted and numbered by falling frequency within their language.  Ids of
the most frequent words (``Sizes.words``, a bound, whatever the corpus) travel to all
tasks; a task turns texts into flat arrays of ids and counts neighbouring ids: pairs
of the low numbers, where most pairs of a text fall, in a dense tile that is addressed
directly (``numpy.bincount``), the others as sorted coordinates.  Pairs found often
enough are ranked in their turn, and pair ids beside word ids are counted in tiles in
the same way: that gives the phrases of three words.

What has no id is counted by its words, in the same pass, if it can be part of a
candidate at all: words and pairs that are frequent enough but have no id are marked
in bitmaps of a fixed size by their hashes.  What is not marked is too rare; what is
marked by chance only costs a count.  So results are exact for corpora of any size.

A task's counts are sums that leave it whenever its tables are full, and meet by
phrase in a shuffle, so no word and no language is gathered in one task.

Defined results: null texts are empty, null languages ``und``; repeated rows count
each; other columns are not read; an empty table gives an empty table; equal scores
are ordered by count, then by the phrase's bytes.  Texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored

NO_LANG = "und"
#: Letters in lower case, tabs as blanks and the ends of pieces as line feeds.
TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256))
#: Ids of a blank's empty word, the end of a piece, words that are too rare for any
#: candidate, and other words without an id.
EMPTY, END, RARE, OTHER = -4, -3, -2, -1


@dataclass(frozen=True)
class Sizes:
    """Bounds of what a task holds; results are the same for any of them."""

    words: int = 150_000  # words with ids, of all languages
    pairs: int = 2_000_000  # pairs with ids, of all languages
    tile: int = 1024  # a side of the dense tile
    held: int = 300_000  # entries of a task's table of phrases
    codes: int = 2_000_000  # coordinates that are sorted at once
    bits: int = 27  # bitmaps have two to the power of this
    letters: int = 1 << 20  # bytes of texts taken at once
    langs: int = 16  # languages with tiles at once


def mine(docs: DataFrame, lang_column: str = "lang", text_column: str = "text", least: int = 10, most: int = 2000, inside: int = 50, sizes: Sizes = Sizes()) -> DataFrame:
    """Each language's first ``most`` phrases of two and three words with ``least``
    occurrences or more: lang, rank, phrase, a, l, r, n, score.

    A phrase goes if it lies inside a longer one with ``inside`` hundredths of its
    occurrences or more."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.coalesce(F.col(f"`{lang_column}`"), F.lit(NO_LANG)).alias("lang"), F.col(f"`{text_column}`").alias("text"))
    words = stored(_summed(texts.mapInArrow(_count_words(sizes), COUNTS)), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least)

    ids, rest = _word_ids(frequent, sizes.words)
    held = spark.sparkContext.broadcast((ids, _bitmap(rest.select(F.xxhash64("phrase").alias("h")), sizes)))
    pairs = _met(texts.mapInArrow(_count_pairs(held, sizes), COUNTS), least)
    pairs = stored(_named(pairs, held, None), "pairs")

    ranked, rest = _pair_ranks(pairs, sizes.pairs)
    marks = [_bitmap(x, sizes) for x in (_code_hashes(rest.where("code IS NOT NULL")), pairs.where("code IS NULL").select(F.xxhash64("phrase").alias("h")))]
    held_pairs = spark.sparkContext.broadcast((ranked, *marks))
    triples = _met(texts.mapInArrow(_count_triples(held, held_pairs, sizes), COUNTS), least)
    triples = stored(_named(triples, held, held_pairs), "triples")
    pairs, triples = (x.select("lang", "phrase", "f") for x in (pairs, triples))
    return _best(_outside(_scored(frequent, pairs, triples), pairs, triples, inside), totals, most)


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


#: Counts as they leave a task: by the language's number and the code of two ids, or
#: (without ids) by the language and the phrase itself.
COUNTS = "no int, code bigint, lang string, phrase string, f bigint"
_COUNTS = pa.schema([("no", pa.int32()), ("code", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def _met(counts: DataFrame, least: int) -> DataFrame:
    """The sums of what all tasks counted, of ``least`` and more.  A task's rows are
    sums already, so they are dealt out before they are added up."""
    keys = ["no", "code", "lang", "phrase"]
    return counts.repartition(*keys).groupBy(*keys).agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _named(counts: DataFrame, held, held_pairs) -> DataFrame:
    """Counts with the phrases of their codes."""

    def run(batches):
        ids, _ = held.value
        langs = sorted(ids)
        for batch in batches:
            no, code, lang, phrase, f = (c.to_pylist() for c in batch.columns)
            for k, c in enumerate(code):
                if c is not None:
                    lang[k] = langs[no[k]]
                    words, left, right = ids[lang[k]], c >> 32, c & 0xFFFFFFFF
                    if held_pairs is not None:
                        pair = int(held_pairs.value[0][no[k]][2][left])
                        phrase[k] = f"{words[pair >> 32]} {words[pair & 0xFFFFFFFF]} {words[right]}"
                    else:
                        phrase[k] = f"{words[left]} {words[right]}"
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(phrase, pa.string()), batch.column(4)], schema=_COUNTS)

    return counts.mapInArrow(run, COUNTS)


def _level(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The most frequent rows, ``most`` or fewer, and the others.

    Rows are taken by levels of frequency, a sixteenth of a power of two each."""
    level = F.floor(F.log2("f") * 16)
    taken, lowest = 0, 1 << 30
    for row in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if taken + row.n > most:
            break
        taken, lowest = taken + row.n, row.level
    return counts.where(level >= lowest), counts.where(level < lowest)


def _word_ids(counts: DataFrame, most: int) -> tuple[dict[str, list[str]], DataFrame]:
    """The words of each language that get ids, in the order of these; and the rest."""
    taken, rest = _level(counts, most)
    out: dict[str, list[str]] = {}
    for r in sorted(taken.collect(), key=lambda r: (-r.f, r.phrase)):
        out.setdefault(r.lang, []).append(r.phrase)
    return out, rest


def _pair_ranks(pairs: DataFrame, most: int) -> tuple[dict[int, tuple], DataFrame]:
    """By the languages' numbers: sorted codes of pairs, their ranks, codes by rank;
    and the pairs without a rank."""
    import numpy as np

    taken, rest = _level(pairs, most)
    table = taken.where("code IS NOT NULL").select("no", "code", "f").toArrow()
    no, code, f = (table.column(c).to_numpy() for c in ("no", "code", "f"))
    out = {}
    for n in np.unique(no).tolist():
        own = no == n
        by_rank = code[own][np.lexsort((code[own], -f[own]))]
        order = np.argsort(by_rank)
        out[n] = (by_rank[order], order.astype(np.int32), by_rank)
    return out, rest


def _mixed(codes):
    """Hashes of the codes of pairs."""
    import numpy as np

    h = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ h >> np.uint64(29)).view(np.int64)


def _code_hashes(pairs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_mixed(batch.column(0).to_numpy()), pa.int64())], names=["h"])

    return pairs.select("code").mapInArrow(run, "h bigint")


def _bitmap(hashes: DataFrame, sizes: Sizes):
    """Bits of the hashes ``h``, as 64-bit words; None where there are none."""
    import numpy as np

    place = F.col("h").bitwiseAND(F.lit((1 << sizes.bits) - 1))
    rows = hashes.select(F.shiftrightunsigned(place, 6).alias("word"), F.expr("shiftleft(1L, CAST(h & 63 AS INT))").alias("bit"))
    table = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    if not table.num_rows:
        return None
    out = np.zeros(1 << max(0, sizes.bits - 6), np.int64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return out


def _marked(bitmap, h):
    """Whether the bits of hashes are set."""
    import numpy as np

    if bitmap is None:
        return np.zeros(len(h), bool)
    place = h & (len(bitmap) * 64 - 1)
    return (bitmap[place >> 6] >> (h & 63)) & 1 > 0


# ----------------------------------------------------------------- in a task


def parts_of(texts: list[str]) -> list[bytes]:
    """Words in lower case with a line feed at each end of a piece; blanks side by
    side leave empty words."""
    joined = b"\n".join((t or "").encode("utf-8", "surrogatepass") for t in texts).translate(TABLE)
    return joined.replace(b"\n", b" \n ").split(b" ")


def _by_lang(batches, letters: int):
    """Texts of the batches as (lang, texts), a bounded number of bytes at once."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        held: dict[str, list[str]] = {}
        size: Counter = Counter()
        for lang, t in zip(langs, texts):
            if t:
                held.setdefault(lang, []).append(t)
                size[lang] += len(t)
                if size[lang] >= letters:
                    yield lang, held.pop(lang)
                    size[lang] = 0
        yield from held.items()


class Phrases:
    """Counts of phrases by language; leaves the task whenever it is full."""

    def __init__(self, most: int):
        self.most, self.by_lang, self.size = most, {}, 0

    def add(self, lang: str, phrases) -> None:
        own = self.by_lang.setdefault(lang, Counter())
        before = len(own)
        own.update(phrases)
        self.size += len(own) - before

    def full(self):
        return self.leave() if self.size > self.most else ()

    def leave(self):
        for lang, own in self.by_lang.items():
            n = len(own)
            words = pa.array([p.decode("utf-8", "surrogatepass") for p in own], pa.string())
            none = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([lang] * n, pa.string()), words, pa.array(own.values(), pa.int64())], schema=_COUNTS)
        self.by_lang, self.size = {}, 0


def _count_words(sizes: Sizes):
    def run(batches):
        counts = Phrases(sizes.held)
        for lang, texts in _by_lang(batches, sizes.letters):
            counts.add(lang, parts_of(texts))
            own = counts.by_lang[lang]
            for mark in (b"", b"\n"):
                counts.size -= own.pop(mark, None) is not None
            yield from counts.full()
        yield from counts.leave()

    return run


class Tiles:
    """Counts of neighbouring ids of one language: a dense tile for the low ids,
    sorted coordinates for the rest."""

    def __init__(self, no: int, sizes: Sizes):
        import numpy as np

        self.no, self.side, self.most = no, sizes.tile, sizes.codes
        self.dense = np.zeros(self.side * self.side, np.int64)
        self.codes, self.size = [], 0

    def add(self, a, b):
        """Count pairs; coordinates leave when there are too many."""
        import numpy as np

        low = (a < self.side) & (b < self.side)
        self.dense += np.bincount(a[low] * self.side + b[low], minlength=len(self.dense))
        self.codes.append(a[~low] << 32 | b[~low])
        self.size += len(self.codes[-1])
        if self.size > self.most:
            yield self._coordinates()

    def leave(self):
        import numpy as np

        met = np.flatnonzero(self.dense)
        yield self._batch(met // self.side << 32 | met % self.side, self.dense[met])
        yield self._coordinates()

    def _coordinates(self):
        import numpy as np

        codes, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *self.codes]), return_counts=True)
        self.codes, self.size = [], 0
        return self._batch(codes, counts)

    def _batch(self, codes, counts):
        n = len(codes)
        none = pa.nulls(n, pa.string())
        return pa.RecordBatch.from_arrays([pa.array([self.no] * n, pa.int32()), pa.array(codes, pa.int64()), none, none, pa.array(counts, pa.int64())], schema=_COUNTS)


class Numbers:
    """Texts of a language as ids, and what is counted of them."""

    def __init__(self, lang: str, held: tuple, no: int, sizes: Sizes):
        ids, self.frequent = held
        self.ids = {w.encode("utf-8", "surrogatepass"): n for n, w in enumerate(ids.get(lang, []))} | {b"": EMPTY, b"\n": END}
        self.tiles = Tiles(no, sizes)

    def of(self, texts):
        """(ids, words) of the texts in order, ends of pieces between them."""
        import numpy as np

        parts, get = parts_of(texts), self.ids.get
        ids = np.fromiter((get(p, RARE) for p in parts), np.int64, len(parts))
        full = np.flatnonzero(ids != EMPTY)
        ids, words = ids[full], [parts[k] for k in full.tolist()]
        if self.frequent is not None:
            rare = np.flatnonzero(ids == RARE)
            ids[rare[_marked(self.frequent, _hashed([words[k] for k in rare.tolist()]))]] = OTHER
        return ids, words


def _hashed(phrases: list[bytes]):
    """The hashes that Spark's ``xxhash64`` gives."""
    import numpy as np
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(p, 42) for p in phrases), np.uint64, len(phrases)).view(np.int64)


def _counting(held, sizes: Sizes, count):
    """Runs ``count(lang, numbers, texts, rest)`` over the texts, for a bounded number
    of languages at once."""

    def run(batches):
        places = {lang: n for n, lang in enumerate(sorted(held.value[0]))}
        numbers, rest = {}, Phrases(sizes.held)
        for lang, texts in _by_lang(batches, sizes.letters):
            if lang not in numbers:
                if len(numbers) >= sizes.langs:
                    yield from numbers.pop(next(iter(numbers))).tiles.leave()
                numbers[lang] = Numbers(lang, held.value, places.get(lang, -1), sizes)
            yield from count(lang, numbers[lang], texts, rest)
            yield from rest.full()
        for own in numbers.values():
            yield from own.tiles.leave()
        yield from rest.leave()

    return run


def _count_pairs(held, sizes: Sizes):
    def count(lang, own, texts, rest):
        ids, words = own.of(texts)
        a, b = ids[:-1], ids[1:]
        known = (a >= 0) & (b >= 0)
        yield from own.tiles.add(a[known], b[known])
        other = ((a >= OTHER) & (b >= OTHER) & ~known).nonzero()[0].tolist()
        rest.add(lang, [words[k] + b" " + words[k + 1] for k in other])

    return _counting(held, sizes, count)


def _count_triples(held, held_pairs, sizes: Sizes):
    """Both pairs of a candidate are frequent: they have a rank or are marked."""

    def count(lang, own, texts, rest):
        ids, words = own.of(texts)
        if len(ids) < 3:
            return
        ranked, by_code, by_phrase = held_pairs.value
        a, b = ids[:-1], ids[1:]
        pair = _ranks(a, b, ranked.get(own.tiles.no))
        maybe = pair >= 0
        left = ((a >= 0) & (b >= 0) & ~maybe).nonzero()[0] if by_code is not None else []
        if len(left):
            maybe[left] = _marked(by_code, _mixed(a[left] << 32 | b[left]))
        left = ((a >= OTHER) & (b >= OTHER) & ((a < 0) | (b < 0))).nonzero()[0] if by_phrase is not None else []
        if len(left):
            maybe[left] = _marked(by_phrase, _hashed([words[k] + b" " + words[k + 1] for k in left.tolist()]))
        first, second, third = pair[:-1], pair[1:], ids[2:]
        known = (first >= 0) & (second >= 0)
        yield from own.tiles.add(first[known], third[known])
        whole = maybe[:-1] & maybe[1:] & ~known
        rest.add(lang, [b" ".join(words[k : k + 3]) for k in whole.nonzero()[0].tolist()])

    return _counting(held, sizes, count)


def _ranks(a, b, held):
    """The rank of each pair of ids, or -1."""
    import numpy as np

    if held is None or not len(held[0]):
        return np.full(len(a), -1, np.int64)
    codes, ranks, _ = held
    key = np.where((a >= 0) & (b >= 0), a << 32 | b, -1)
    at = np.minimum(np.searchsorted(codes, key), len(codes) - 1)
    return np.where(codes[at] == key, ranks[at].astype(np.int64), -1)


# -------------------------------------------------------------------- scores


def _scored(words: DataFrame, pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, size, a, l, r, score) by their lowest-scoring cut."""
    cut = lambda k: F.struct(F.lit(k).alias("k"), F.array_join(F.slice("w", 1, k), " ").alias("head"), F.array_join(F.slice("w", k + 1, 3), " ").alias("tail"))
    known = words.union(pairs).select("lang", "phrase", "f")
    rows = pairs.withColumn("w", F.split("phrase", " ")).select("lang", "phrase", F.lit(2).alias("size"), F.col("f").alias("a"), F.explode(F.array(cut(1))).alias("c"))
    three = triples.withColumn("w", F.split("phrase", " ")).select("lang", "phrase", F.lit(3).alias("size"), F.col("f").alias("a"), F.explode(F.array(cut(1), cut(2))).alias("c"))
    rows = rows.union(three).select("lang", "phrase", "size", "a", "c.*")
    rows = rows.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    rows = rows.join(known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    # Exact: counts have up to 19 digits, products are decimals of 38.
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    rows = rows.withColumns({"over": (wide("a") * wide("a")).cast("decimal(38,0)"), "under": (wide("l") * wide("r")).cast("decimal(38,0)")})
    rows = rows.withColumn("score", F.expr("cast(over * cast(1000000 as decimal(7,0)) as decimal(38,0)) div under"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("b")
    return rows.groupBy("lang", "phrase", "size", "a").agg(best).select("lang", "phrase", "size", "a", "b.l", "b.r", "b.score")


def _outside(scored: DataFrame, pairs: DataFrame, triples: DataFrame, inside: int) -> DataFrame:
    """Without the pairs that a phrase of three words mostly covers."""
    w = F.split("phrase", " ")
    parts = triples.select("lang", F.explode(F.array(F.array_join(F.slice(w, 1, 2), " "), F.array_join(F.slice(w, 2, 2), " "))).alias("phrase"), "f")
    longest = parts.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    covered = pairs.join(longest, ["lang", "phrase"]).where(100 * F.col("longer").cast("decimal(25,0)") >= inside * F.col("f").cast("decimal(25,0)"))
    return scored.join(covered.select("lang", "phrase"), ["lang", "phrase"], "left_anti")


def _best(rows: DataFrame, totals: DataFrame, most: int) -> DataFrame:
    """The first of each language; parts of a language are cut before they meet."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    parts = Window.partitionBy("lang", "part").orderBy(*order)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    rows = rows.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= most)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= most)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = 10, most: int = 2000, inside: int = 50) -> str:
    """DuckDB SQL of ``mine`` over ``documents``."""
    return rf"""WITH pieces AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, phrase, count(*) AS f FROM (SELECT lang, unnest(w) AS phrase FROM listed) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM words GROUP BY lang),
two AS (SELECT lang, phrase, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM listed WHERE len(w) > 1) GROUP BY ALL HAVING count(*) >= {least}),
three AS (SELECT lang, phrase, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase FROM listed WHERE len(w) > 2) GROUP BY ALL HAVING count(*) >= {least}),
known AS (SELECT * FROM words WHERE f >= {least} UNION ALL SELECT * FROM two),
split AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM two UNION ALL SELECT lang, phrase, f, string_split(phrase, ' ') FROM three),
cuts AS (SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS k FROM split),
sided AS (SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, t.f AS r, (1000000::HUGEINT * c.a * c.a) // (h.f::HUGEINT * t.f) AS score FROM cuts c JOIN known h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:c.k], ' ') JOIN known t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[c.k + 1:], ' ')),
lowest AS (SELECT * FROM sided QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a AS longer FROM split WHERE len(w) = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM split WHERE len(w) = 3),
covered AS (SELECT DISTINCT t.lang, t.phrase FROM two t JOIN parts p USING (lang, phrase) WHERE 100 * p.longer >= {inside} * t.f)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest ANTI JOIN covered USING (lang, phrase)) JOIN totals USING (lang) WHERE rank <= {most}"""
