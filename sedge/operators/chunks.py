"""Chunkers, chunk quality, and changes to chunks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, tokens
from ..sources.shared import stored
from .registry import register_model, register_strategy, sizer, strategy

# References that point out of a chunk.
ORPHAN_REFERENCES = (
    r"\bsee above\b", r"\bsee below\b", r"\bas shown above\b", r"\bas shown below\b", r"\bas mentioned\b",
    r"\bthe following\b$", r"^the above\b", r"\brefer to\s*$",
)
# Words that a chunk should not begin with.
BAD_STARTS = ("and ", "or ", "but ", "however, ", "therefore, ")
#: Weights of the parts of a chunk's quality.
WEIGHTS = {"token_range": 0.25, "sentences": 0.20, "hierarchy": 0.25, "tables": 0.15, "references": 0.15}


def _size(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


def estimate(c: Column) -> Column:
    """The default token counter."""
    return tokens(c)


estimate.plain = _size


def count_words(c: Column) -> Column:
    """Words as tokens."""
    return F.size(F.filter(F.split(c, r"[ \t\n\x0B\f\r]+"), lambda x: x != "")).cast("bigint")


count_words.plain = lambda text: len([w for w in re.split(r"[ \t\n\x0B\f\r]+", text) if w])
#: Words and signs, as a vectorised model.
PIECES = r"\w+|[^\w\s]"
register_strategy("token_counter", "estimate", estimate)
register_strategy("token_counter", "words", count_words)
register_model("token_counter", "pieces", lambda: re.compile(PIECES), lambda pattern, texts: [len(pattern.findall(t)) for t in texts])


def counted(blocks: DataFrame, counter: str) -> DataFrame:
    """Blocks with their tokens by a registered counter."""
    return blocks if counter == "estimate" else blocks.withColumn("tokens", strategy("token_counter", counter)(F.col("content")).cast("bigint"))


def folded(rows: DataFrame, by: tuple, item: list[str], fold, schema: str) -> DataFrame:
    """Fold each group's rows in the order of their first field.

    ``fold`` takes a list of tuples of the fields ``item`` and returns tuples of
    ``schema``.  The order matters row by row, so it is one pass over a group's
    small tuples in Arrow batches of groups; texts pass through only where they
    are what is cut."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from ..shipping import bounded_batches

    bounded_batches(rows.sparkSession)
    groups = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*item))).alias("items"))
    keys = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in by)
    out = to_arrow_schema(StructType.fromDDL(f"{keys}, {schema}"))

    def run(batches):
        for batch in batches:
            *key_columns, items = (c.to_pylist() for c in batch.columns)
            made = [(*key, *row) for *key, held in zip(*key_columns, items) for row in fold([tuple(x[n] for n in item) for x in held])]
            columns = list(zip(*made)) or [[] for _ in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return groups.select(*by, "items").mapInArrow(run, f"{keys}, {schema}")


def pack(blocks: DataFrame, max_tokens: int, target: int | None = None, by: tuple = ("doc_id",), overlap: int = 0, min_tokens: int = 0) -> DataFrame:
    """Greedy packing of a document's blocks in order: ``group_no`` by block.

    Tables and code stand alone.  A group ends before it would pass
    ``max_tokens``, or when it has reached ``target``; the next one begins with
    the last blocks that have ``overlap`` tokens or fewer together.  A last group
    under ``min_tokens`` joins the one before, unless the last block stands
    alone."""
    target = target or max_tokens

    def fold(items):
        groups: list[list] = []
        held: list[tuple] = []
        size = 0

        def end() -> None:
            nonlocal held, size
            groups.append([x[0] for x in held])
            kept, size = [], 0
            for x in reversed(held):
                if size + x[1] > overlap:
                    break
                kept.append(x)
                size += x[1]
            held = kept[::-1] if overlap else []
            size = sum(x[1] for x in held)

        for x in items:
            if x[2]:
                if held:
                    groups.append([y[0] for y in held])
                groups.append([x[0]])
                held, size = [], 0
                continue
            if held and size + x[1] > max_tokens:
                end()
            held.append(x)
            size += x[1]
            if size >= target:
                end()
        if held:
            rest = [x[0] for x in held]
            if size < min_tokens and groups and not items[-1][2]:
                groups[-1] = sorted({*groups[-1], *rest})
            else:
                groups.append(rest)
        return [(pos, k) for k, group in enumerate(groups) for pos in group]

    kind = blocks.schema["pos"].dataType.simpleString()
    rows = blocks.select(*by, "pos", "tokens", F.col("type").isin("table", "code").alias("alone"))
    if kind.startswith("struct"):
        # Parts of blocks: places are pairs, packed as one number in their order.
        rows = rows.withColumn("pos", F.col("pos.pos").cast("bigint") * (1 << 24) + F.col("pos.part"))
        out = folded(rows, by, ["pos", "tokens", "alone"], fold, "pos bigint, group_no int")
        return out.withColumn("pos", F.struct(F.floor(F.col("pos") / (1 << 24)).cast("int").alias("pos"), (F.col("pos") % (1 << 24)).cast("int").alias("part")))
    return folded(rows, by, ["pos", "tokens", "alone"], fold, f"pos {kind}, group_no int")


def fixed_chunks(blocks: DataFrame, max_tokens: int = 200, target: int = 150, overlap: int = 20, min_tokens: int = 20, counter: str = "estimate") -> DataFrame:
    """Chunks of packed blocks that overlap by whole blocks; ``counter`` names the
    token counter."""
    blocks = counted(blocks, counter)
    groups = pack(blocks, max_tokens, target, overlap=overlap, min_tokens=min_tokens)
    rows = blocks.join(groups, ["doc_id", "pos"])
    parts = F.array_sort(F.collect_list(F.struct("pos", "content")))
    made = rows.groupBy("doc_id", F.col("group_no").alias("chunk_pos")).agg(
        parts.alias("parts"), F.sum("tokens").alias("tokens"), F.count("*").alias("block_count"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    )
    return made.select("doc_id", "chunk_pos", "tokens", "block_count", "first_pos", "last_pos", F.array_join(F.transform("parts", lambda x: x["content"]), "\n\n").alias("content"))


def split_sentences(c: Column) -> Column:
    """Sentences, each but the last with one blank behind it.

    White space behind a stop becomes one blank first, and the text is cut behind that:
    both are one pass, however many sentences there are."""
    return F.split(F.regexp_replace(c, r"(?<=[.!?])\s+", " "), r"(?<=[.!?] )")


def hierarchy_chunks(blocks: DataFrame, max_tokens: int = 400, target: int = 200, counter: str = "estimate") -> DataFrame:
    """A section that fits is one chunk; others are packed in groups by target,
    the heading with the first; blocks over the limit are cut at sentences.
    ``counter`` names the token counter."""
    from .sections import assign_sections

    blocks, tokens = counted(blocks, counter), strategy("token_counter", counter)

    rows = assign_sections(blocks).select("doc_id", "section_no", "pos", "type", "content", "tokens")
    long = (F.col("tokens") > max_tokens) & ~F.col("type").isin("table", "code")
    pieces = F.when(long, split_sentences(F.col("content"))).otherwise(F.array("content"))
    rows = rows.select("doc_id", "section_no", "pos", "type", F.posexplode(pieces).alias("part", "content"))
    rows = rows.withColumns({"tokens": tokens(F.col("content")), "pos": F.struct("pos", "part")})
    size = F.sum("tokens").over(Window.partitionBy("doc_id", "section_no"))
    rows = rows.withColumn("fits", (size <= max_tokens) & (F.col("section_no") > 0))
    groups = pack(rows.where("NOT fits"), max_tokens, target, ("doc_id", "section_no"))
    rows = rows.join(groups, ["doc_id", "section_no", "pos"], "left").withColumn("group_no", F.coalesce("group_no", F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct("pos", "content")))
    made = rows.groupBy("doc_id", "section_no", "group_no").agg(parts.alias("parts"))
    content = F.array_join(F.transform("parts", lambda x: x["content"]), "\n\n")
    made = made.select("doc_id", "section_no", "group_no", content.alias("content"), tokens(content).alias("token_count"))
    return made.withColumn("chunk_pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("section_no", "group_no")) - 1)


# Separators from the coarsest to the finest.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")


def _recursive(text: str, target: int, at: int = 0, size=_size) -> list[str]:
    """Pieces of ``target`` tokens or fewer, cut at the coarsest separators that do;
    what has none is cut by characters.  Pieces that fit together are joined."""
    return [p for p, _ in _recursive_all([text], target, lambda texts: [size(t) for t in texts], at, size is _size)[0]]


class _Part:
    """A text that is cut from the separator ``at`` on, and its pieces with sizes."""

    def __init__(self, text: str, at: int):
        self.text, self.at, self.parts, self.pieces = text, at, [], []

    def cut(self) -> list[_Part]:
        while self.at < len(SEPARATORS) and not self.parts:
            sep, self.at = SEPARATORS[self.at], self.at + 1
            *ended, last = self.text.split(sep)
            parts = [p for p in [*(p + sep for p in ended), last] if p.strip()]
            if len(parts) > 1:
                # A part ends with this separator, so finer ones cut it.
                self.parts = [_Part(p, self.at) for p in parts]
        return self.parts

    def join(self, target: int) -> list[int]:
        """Join the parts' pieces that fit together; the places of those without a size."""
        room, joined = -1, set()
        for piece, n in (q for p in self.parts for q in p.pieces):
            if n <= room:
                joined.add(len(self.pieces) - 1)
                self.pieces[-1] = (self.pieces[-1][0] + piece, None)
                room -= n
            else:
                self.pieces.append((piece, n))
                room = target - n
        return sorted(joined)


def _by_characters(text: str, target: int, many) -> list[str]:
    """The longest beginnings that fit, of one character at least."""
    out = []
    while text:
        low, high = 1, 2
        while high < len(text) and many([text[:high]])[0] <= target:
            low, high = high, 2 * high
        high = min(high, len(text))
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if many([text[:middle]])[0] <= target else (low, middle - 1)
        out.append(text[:low])
        text = text[low:]
    return out


def _recursive_all(texts: list[str], target: int, many, at: int = 0, estimated: bool = False) -> list[list[tuple[str, int]]]:
    """``_recursive`` of many texts, with the sizes of pieces.  ``many`` counts all texts
    of a level of separators at once, first on the way down and, of what was joined, on
    the way up."""
    roots = [_Part(t, at) for t in texts]
    levels, front = [], roots
    while front:
        levels.append(front)
        below = []
        for part, n in zip(front, many([p.text for p in front])):
            if n <= target:
                part.pieces = [(part.text, n)]
            elif part.cut():
                below += part.parts
            else:
                t = part.text
                cuts = [t[k : k + 4 * target] for k in range(0, len(t), 4 * target)] if estimated else _by_characters(t, target, many)
                part.pieces = list(zip(cuts, many(cuts)))
        front = below
    for level in reversed(levels):
        open_ = [(part, k) for part in level for k in part.join(target)]
        for (part, k), n in zip(open_, many([part.pieces[k][0] for part, k in open_])):
            part.pieces[k] = (part.pieces[k][0], n)
    return [part.pieces for part in roots]


def recursive_chunks(blocks: DataFrame, target: int = 150, min_tokens: int = 20, max_tokens: int = 200, overlap: int = 20, counter: str = "estimate") -> DataFrame:
    """Blocks cut at the coarsest separators that make pieces small enough; small
    pieces joined with the next, the last words of each put before the next.

    Tables and code stand alone.  Texts are cut block by block; only the sizes of a
    document's pieces are folded in order, and texts meet again chunk by chunk.
    ``counter`` names the token counter; of two texts with a blank line between it must
    count what it counts of each (the estimate is taken of characters)."""
    load = sizer(counter)
    kind = blocks.schema["pos"].dataType.simpleString()
    key = blocks.schema["doc_id"].dataType.simpleString()

    def cut(many):
        def step(docs, places, alone, texts):
            cuts = iter(_recursive_all([t for t, whole in zip(texts, alone) if not whole], target, many, 0, counter == "estimate"))
            rows = []
            for doc, pos, whole, text in zip(docs, places, alone, texts):
                pieces = [text] if whole else [p.strip() for p, _ in next(cuts) if p.strip()]
                rows += [(doc, pos, k, piece, len(piece)) for k, piece in enumerate(pieces)]
            return [(*row, n) for row, n in zip(rows, many([row[3] for row in rows]))]

        return step

    def fold(items):
        out, group, chars, held = [], -1, 0, 0
        for pos, part, n, tokens_ in items:
            whole = chars + 2 + n
            joined = max(1, whole // 4) if counter == "estimate" else held + tokens_
            if group >= 0 and held < min_tokens and joined <= max_tokens:
                chars, held = whole, joined
            else:
                group, chars, held = group + 1, n, tokens_
            out.append((pos, part, group))
        return out

    def lead(many):
        def step(docs, places, texts, before):
            last = [(b or "").split() for b in before]
            # Most tails end within as many words as they have tokens.
            near = list({w for words in last for w in words[-overlap - 1 :]})
            sizes = dict(zip(near, many(near)))
            rows = []
            for doc, pos, text, words in zip(docs, places, texts, last):
                tail, room = [], overlap
                for word in reversed(words):
                    if word not in sizes:
                        sizes[word] = many([word])[0]
                    room -= sizes[word]
                    if room < 0:
                        break
                    tail.append(word)
                rows.append((doc, pos, " ".join(reversed(tail)) + "\n\n" + text if tail else text))
            return [(*row, n) for row, n in zip(rows, many([row[2] for row in rows]))]

        return step

    rows = blocks.select("doc_id", "pos", F.col("type").isin("table", "code").alias("alone"), "content")
    pieces = _mapped(rows, load, cut, f"doc_id {key}, pos {kind}, part int, content string, chars bigint, tokens bigint")
    pieces = stored(pieces, "pieces")
    groups = folded(pieces, ("doc_id",), ["pos", "part", "chars", "tokens"], fold, f"pos {kind}, part int, chunk_pos int")
    parts = F.array_sort(F.collect_list(F.struct("pos", "part", "content")))
    made = pieces.join(groups, ["doc_id", "pos", "part"]).groupBy("doc_id", "chunk_pos").agg(F.array_join(F.transform(parts, lambda x: x["content"]), "\n\n").alias("content"))
    before = F.lag("content").over(Window.partitionBy("doc_id").orderBy("chunk_pos"))
    return _mapped(made.select("doc_id", "chunk_pos", "content", before.alias("before")), load, lead, f"doc_id {key}, chunk_pos int, content string, token_count bigint")


def _mapped(rows: DataFrame, load, make, schema: str) -> DataFrame:
    """Rows by ``make(many)`` of the columns of a batch, with a counter loaded once in a
    task that counts many texts at once."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from ..shipping import bounded_batches

    bounded_batches(rows.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        step = None
        for batch in batches:
            step = step or make(load())
            columns = list(zip(*step(*(c.to_pylist() for c in batch.columns)))) or [[] for _ in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return rows.mapInArrow(run, schema)


def add_overlap(chunks: DataFrame, overlap: int = 20) -> DataFrame:
    """The last words of the chunk before, up to ``overlap`` tokens, in front."""
    before = F.lag("content").over(Window.partitionBy("doc_id").orderBy("chunk_pos"))
    w = F.reverse(F.array_remove(F.split(before, r"\s+"), ""))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<string>").alias("out"), F.lit(True).alias("on"))

    def step(acc, x):
        n = acc["n"] + tokens(x)
        on = acc["on"] & (n <= overlap)
        return F.struct(F.when(on, n).otherwise(acc["n"]).alias("n"), F.when(on, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"), on.alias("on"))

    tail = F.array_join(F.reverse(F.aggregate(w, start, step)["out"]), " ")
    content = F.when(before.isNull() | (tail == ""), F.col("content")).otherwise(F.concat(tail, F.lit("\n\n"), F.col("content")))
    return chunks.withColumn("overlapped", content)


def merge_small(chunks: DataFrame, min_tokens: int = 20, max_tokens: int = 400) -> DataFrame:
    """Folds a chunk into the one before while that is under ``min_tokens`` and
    both fit: ``merged_no`` by chunk."""

    def fold(items):
        out, group, held = [], -1, 0
        for pos, n in items:
            if group >= 0 and held < min_tokens and held + n <= max_tokens:
                held += n
            else:
                group, held = group + 1, n
            out.append((pos, n, group))
        return out

    kind = chunks.schema["chunk_pos"].dataType.simpleString()
    return folded(chunks, ("doc_id",), ["chunk_pos", "token_count"], fold, f"chunk_pos {kind}, token_count bigint, merged_no int")


def score_token_range(t: Column) -> Column:
    return (
        F.when((t >= 200) & (t <= 500), 1.0).when(t < 100, F.greatest(F.lit(0.3), t / 100)).when(t < 200, 0.8).when(t <= 600, 0.85)
        .otherwise(F.greatest(F.lit(0.3), 1.0 - F.least(F.lit(0.5), (t - 600) / 500)))
    )


def score_sentences(content: Column) -> Column:
    c = strip(content)
    bad_start = F.when(c.rlike(r"""^(\p{Lu}|["'(\[])"""), 0.0).otherwise(0.3)
    bad_end = F.when(c.rlike(r"""[.!?:"')\]]$"""), 0.0).otherwise(0.3)
    joins = F.when(c.rlike("^(" + "|".join(BAD_STARTS) + ")"), 0.2).otherwise(0.0)
    return F.when(c == "", 1.0).otherwise(F.greatest(F.lit(0.3), F.round(1.0 - bad_start - bad_end - joins, 6)))


def score_hierarchy(last_type: Column, has_heading: Column, has_content: Column) -> Column:
    return F.when(last_type == "heading", 0.4).when(has_heading & ~has_content, 0.5).otherwise(1.0)


def broken_table(kind: Column, content: Column) -> Column:
    lines = F.split(content, "\n")
    bad = ~F.get(lines, 0).contains("|") | ~F.get(lines, 1).contains("---")
    return (kind == "table") & (F.size(lines) >= 2) & F.coalesce(bad, F.lit(False))


def score_references(content: Column) -> Column:
    c, out = F.lower(content), F.lit(False)
    for p in ORPHAN_REFERENCES:
        out = out | c.rlike(p)
    return F.when(out, 0.6).otherwise(1.0)


for _name, _scorer in {
    "token_range": lambda: score_token_range(F.col("token_count")),
    "sentences": lambda: score_sentences(F.col("content")),
    "hierarchy": lambda: score_hierarchy(F.col("last_type"), F.col("has_heading"), F.col("has_content")),
    "tables": lambda: F.when(F.col("has_broken_table"), 0.7).otherwise(1.0),
    "references": lambda: score_references(F.col("content")),
}.items():
    register_strategy("scorer", _name, _scorer)


def quality(chunks: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The scores of each chunk by registered scorers and their weighted sum.  A scorer
    gives a column of the chunk's columns; one that is a model gets the content."""
    made = {}
    for name in weights:
        scorer = strategy("scorer", name)
        made[name] = scorer(F.col("content")) if hasattr(scorer, "load") else scorer()
    overall = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
    return chunks.withColumns(made).withColumn("overall", F.round(overall, 6))


def mean_score(column: str = "overall") -> Column:
    """The mean of scores of six places, summed as whole millionths: the same
    in any order of summation."""
    return F.sum(F.round(F.col(column) * 1_000_000).cast("bigint")) / F.count("*") / 1_000_000


def quality_report(scored: DataFrame, by: str = "doc_id") -> DataFrame:
    return scored.groupBy(by).agg(
        F.count("*").alias("chunks"), mean_score().alias("average"), F.count_if(F.col("overall") < 0.7).alias("problems"),
        F.count_if((F.col("overall") >= 0.7) & (F.col("overall") < 0.85)).alias("warnings"),
    )


def suggestions(scored: DataFrame) -> DataFrame:
    """One row for each piece of advice on a chunk."""
    c = strip(F.col("content"))
    weak = F.col("sentences") < 0.8
    advice = F.array(
        F.when((F.col("token_range") < 0.8) & (F.col("token_count") < 200), "merge"),
        F.when((F.col("token_range") < 0.8) & (F.col("token_count") >= 200), "split"),
        F.when(weak & (c != "") & ~c.rlike(r"^\p{Lu}"), "starts mid-sentence"),
        F.when(weak & (c != "") & ~c.rlike(r"""[.!?:"')\]]$"""), "ends mid-sentence"),
        F.when((F.col("hierarchy") < 0.8) & (F.col("last_type") == "heading"), "heading at end"),
        F.when(F.col("references") < 0.8, "orphan references"),
    )
    return scored.select("chunk_id", F.explode(F.array_compact(advice)).alias("suggestion"))


def metrics(scored: DataFrame, by: tuple = ("strategy",)) -> DataFrame:
    """Sizes, quality and paths of a strategy's scored chunks.

    The median is the upper one, found in the counts of each size, which are few
    however many chunks there are."""
    t = F.col("token_count")
    out = scored.groupBy(*by).agg(
        F.count("*").alias("chunks"), F.sum("block_count").alias("blocks"), F.avg(t).alias("avg_tokens"), F.min(t).alias("min_tokens"), F.max(t).alias("max_tokens"),
        mean_score().alias("avg_quality"), (F.count_if(F.col("hierarchy_path") != "") / F.count("*")).alias("preservation"),
        F.count_if(t < 100).alias("under_100"), F.count_if((t >= 100) & (t <= 500)).alias("from_100_to_500"), F.count_if(t > 500).alias("over_500"),
    )
    sizes = scored.groupBy(*by, "token_count").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    sizes = sizes.withColumns({"upto": F.sum("n").over(w.orderBy("token_count")), "all": F.sum("n").over(w)})
    median = sizes.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(*by).agg(F.min("token_count").alias("median_tokens"))
    return out.join(median, list(by))


def compare_strategies(measured: DataFrame) -> DataFrame:
    """Points of each strategy, the best one, why, and how much better its quality
    is than the worst of the others'.  One row a strategy, of which there are few."""
    avg = F.col("avg_tokens")
    score = (
        40 * F.col("preservation") + 30 * F.col("avg_quality") + F.when(avg.between(300, 600), 20).when(avg.between(200, 800), 10).otherwise(0)
        + F.when(F.col("chunks") < 1000, 10).otherwise(0)
    )
    every = Window.partitionBy()
    rows = measured.withColumn("score", F.round(score, 6))
    rows = rows.withColumn("best", F.row_number().over(every.orderBy(F.desc("score"), "strategy")) == 1)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("preservation") > 0.8, "keeps the structure"), F.when(F.col("avg_quality") > 0.9, "high quality"),
            F.when(avg.between(300, 600), "good size"), F.when(F.col("preservation") > 0.9, "has paths"),
        )
    )
    worst = F.min(F.when(~F.col("best"), F.col("avg_quality"))).over(every)
    gap = F.round(F.col("avg_quality") - worst, 6)
    return rows.select("strategy", "score", "best", F.when(F.col("best"), F.array_join(reasons, ", ")).alias("reasons"), F.when(F.col("best") & (gap > 0.1), gap).alias("gap"))


def path_rollup(chunks: DataFrame, separator: str = " > ") -> DataFrame:
    """Chunks and tokens below each path, and on it."""
    parts = F.split("hierarchy_path", separator)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), separator))
    rows = chunks.where("hierarchy_path <> ''").select("doc_id", "hierarchy_path", "token_count", F.explode(prefixes).alias("path"))
    own = F.col("path") == F.col("hierarchy_path")
    return rows.groupBy("doc_id", "path").agg(
        F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.count_if(own).alias("own_chunks"),
        F.coalesce(F.sum(F.when(own, F.col("token_count"))), F.lit(0)).alias("own_tokens"),
    )


def merge_requested(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """Chunks named together by a request (request_id, chunk_id) become one, with
    all their blocks and the first path; all are scored; the others stay."""
    named = chunks.join(requests, "chunk_id")
    first = lambda c: F.min_by(c, "chunk_pos")
    parts = F.array_sort(F.collect_list(F.struct("chunk_pos", "content", "chunk_id", "block_ids")))
    made = named.groupBy("doc_id", "request_id").agg(
        parts.alias("p"), F.count("*").alias("n"), first(F.nullif("hierarchy_path", F.lit(""))).alias("path"), F.max_by("last_type", "chunk_pos").alias("last_type"),
        *[F.bool_or(c).alias(c) for c in ("has_heading", "has_content", "has_broken_table")],
    ).where("n >= 2")
    content = F.array_join(F.transform("p", lambda x: x["content"]), "\n\n")
    head = F.get("p", 0)
    merged = made.select(
        "doc_id", head["chunk_pos"].alias("chunk_pos"), head["chunk_id"].alias("chunk_id"), content.alias("content"), tokens(content).alias("token_count"),
        F.flatten(F.transform("p", lambda x: x["block_ids"])).alias("block_ids"), F.coalesce("path", F.lit("")).alias("hierarchy_path"),
        "last_type", "has_heading", "has_content", "has_broken_table",
    )
    gone = made.select(F.explode("p.chunk_id").alias("chunk_id"))
    return quality(merged.unionByName(chunks.join(gone, "chunk_id", "left_anti").select(*merged.columns)))


def split_requested(chunks: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks cut at a position (chunk_id, at), and the rejected requests."""
    rows = chunks.join(requests, "chunk_id")
    left, right = strip(F.substring("content", F.lit(1), F.col("at"))), strip(F.expr("substring(content, at + 1)"))
    ok = (F.col("at") > 0) & (F.col("at") < F.length("content")) & (left != "") & (right != "")
    halves = F.array(F.struct(F.lit("a").alias("half"), left.alias("content")), F.struct(F.lit("b").alias("half"), right.alias("content")))
    good = rows.where(ok).select("doc_id", "chunk_id", F.explode(halves).alias("h")).select("doc_id", F.concat_ws("-", "chunk_id", "h.half").alias("chunk_id"), "h.content")
    return good, rows.where(~ok).select("chunk_id", "at")


PATCHED = ("tags", "hierarchy_hint", "notes", "custom", "is_locked")


def update_chunks(chunks: DataFrame, patches: DataFrame) -> DataFrame:
    """Values of a patch (chunk_id and any of ``PATCHED``) over the old ones, where
    they are not null."""
    given = [c for c in PATCHED if c in patches.columns]
    rows = chunks.join(patches.select("chunk_id", *[F.col(c).alias(f"__{c}") for c in given]), "chunk_id", "left")
    return rows.withColumns({c: F.coalesce(f"__{c}", c) for c in given}).drop(*[f"__{c}" for c in given])


def rechunk(blocks: DataFrame, old: DataFrame, chunker) -> DataFrame:
    """New chunks by a chunker, and behind them the old ones that are locked."""
    new = chunker(blocks)
    columns = [c for c in new.columns if c in old.columns]
    return new.select(F.lit("new").alias("origin"), *columns).unionByName(old.where("is_locked").select(F.lit("locked").alias("origin"), *columns))


def truncate_tokens(c: Column, n: int) -> Column:
    """The first ``n`` tokens, at four characters each."""
    return F.substring(c, 1, 4 * n)


def split_by_tokens(docs: DataFrame, n: int) -> DataFrame:
    """Windows of ``n`` tokens of each text; an empty text has one."""
    parts = F.greatest(F.ceil(F.length("text") / (4 * n)), F.lit(1)) - 1
    rows = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("bigint"), parts)).alias("part"))
    return rows.select("doc_id", "part", F.substring("text", (4 * n * F.col("part") + 1).cast("int"), F.lit(4 * n)).alias("content"))
