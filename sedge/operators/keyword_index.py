"""A stored inverted index of chunks for keyword search.

Chunks are dealt to shards as they stream through the tasks that index them, without
a shuffle.  A row of the index is a term's postings in a shard: the places of its
chunks in the order of their ids, the term's share of each, and the largest share of
every ``POSTINGS`` of them.  A search reads the rows of its queries' terms only, and a
task answers all queries of a block for a shard, terms by falling impact: once what is
left of a query cannot bring a new chunk among the shard's best, only chunks that were
met are followed, and blocks of postings whose largest share is too low to keep one are
not read.  ``MANY`` queries and more share the work on their terms instead: frequent
terms are one product of matrices for all of them, and a task holds the best of all its
shards, so what leaves it is bounded by the queries.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder, stored

#: Chunks and postings of a shard, postings of a block.
SHARD, SHARD_POSTINGS, POSTINGS = 4096, 500_000, 64
#: Queries that are answered together, and a block of them.
MANY, TOGETHER = 32, 128
#: Scores are told apart by nine digits.
SLACK = 1e-8


@dataclass(frozen=True)
class Index:
    """``rows`` has a row for each term of a shard, and one (without a term) that names
    the shard's chunks; ``by`` is the column of corpora of their own."""

    rows: DataFrame
    by: str | None

    @property
    def keys(self) -> list[str]:
        return [self.by] if self.by else []

    def sizes(self) -> DataFrame:
        """The chunks of each corpus, with or without words."""
        return self.rows.where("term IS NULL").groupBy(*self.keys).agg(F.sum("n").alias("n"))

    def postings(self) -> DataFrame:
        return self.rows.where("term IS NOT NULL")


def build_index(chunks: DataFrame, by: str | None = None, folder: str | None = None) -> Index:
    """Index ``chunks`` (chunk_id, content and, with it, ``by``) into a folder."""
    from ..shipping import bounded_batches

    spark = chunks.sparkSession
    bounded_batches(spark)
    folder = folder or shared_folder(spark, "keyword-index")
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    slot = f"`{by}` {chunks.schema[by].dataType.simpleString()}, " if by else ""
    schema = f"{slot}shard bigint, term string, n bigint, chunks array<{kind}>, places array<int>, shares array<double>, tops array<double>"
    rows = chunks.select(*([by] if by else []), "chunk_id", "content").mapInArrow(_indexed(schema, bool(by)), schema)
    rows.write.parquet(folder)
    return open_index(spark, folder, by)


def open_index(spark: SparkSession, folder: str, by: str | None = None) -> Index:
    """The index that ``build_index`` left in a folder."""
    return Index(spark.read.parquet(folder), by)


def _indexed(schema: str, slotted: bool):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))
    postings = POSTINGS

    def run(batches):
        import re
        import uuid
        from itertools import chain

        import numpy as np
        import pyarrow as pa

        split, held, load, base, made = re.compile("[a-z]{2,}"), {}, Counter(), uuid.uuid4().int >> 65 & ~0xFFFFF, 0

        def shard(slot):
            """The rows of a corpus's chunks so far."""
            nonlocal made
            own = sorted((x for x in held.pop(slot)), key=lambda x: (x[0] is None, x[0]))
            load.pop(slot)
            number, made = base + made, made + 1
            yield batch([slot], number, [None], [len(own)], [[x[0] for x in own]], None, None, None)
            length = np.array([len(words) for _, words in own], np.int64)
            if not length.sum():
                return
            words = pa.array(chain.from_iterable(words for _, words in own), pa.string()).dictionary_encode()
            order = np.argsort(words.dictionary.to_numpy(zero_copy_only=False))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            # A posting for each term and place, by term and then by place.
            key, tf = np.unique(rank[words.indices.to_numpy()] * len(own) + np.repeat(np.arange(len(own)), length), return_counts=True)
            term, place = np.divmod(key, len(own))
            share = tf / length[place]
            start = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            n = np.diff(np.r_[start, len(key)])
            blocks = -(-n // postings)
            last = np.cumsum(blocks)
            top = np.maximum.reduceat(share, np.repeat(start, blocks) + (np.arange(last[-1]) - np.repeat(last - blocks, blocks)) * postings)
            ends, tops = np.r_[start, len(key)].astype(np.int32), np.r_[0, last].astype(np.int32)
            yield batch([slot] * len(n), number, words.dictionary.take(pa.array(order)), n, None, (ends, place.astype(np.int32)), (ends, share), (tops, top))

        def batch(slots, number, term, n, chunks, *lists):
            columns = [slots] * slotted + [[number] * len(n), term, n, chunks, *lists]
            arrays = []
            for c, f in zip(columns, out):
                if c is None:
                    arrays.append(pa.nulls(len(n), f.type))
                elif isinstance(c, tuple):
                    arrays.append(pa.ListArray.from_arrays(pa.array(c[0]), pa.array(c[1])).cast(f.type))
                else:
                    arrays.append(pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type))
            return pa.RecordBatch.from_arrays(arrays, schema=out)

        for b in batches:
            slots = b.column(0).to_pylist() if slotted else [None] * b.num_rows
            for slot, i, text in zip(slots, b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                words = split.findall((text or "").lower())
                held.setdefault(slot, []).append((i, words))
                load[slot] += len(set(words)) + 1
                if len(held[slot]) >= SHARD or load[slot] >= SHARD_POSTINGS:
                    yield from shard(slot)
                elif load.total() >= 2 * SHARD_POSTINGS:
                    yield from shard(load.most_common(1)[0][0])
        for slot in list(held):
            yield from shard(slot)

    return run


def search(index: Index, asked: DataFrame, k: int, blocks: int = 1) -> DataFrame:
    """([by,] query_id, chunk_id, raw): the best ``k`` of each task's shards for each
    query of ``asked`` (query_id, term, times), in ``blocks`` blocks of queries.

    Of several blocks one at a time is answered: its shuffles go with it, and of its
    rows only the best ``k`` of all shards are held."""
    if blocks <= 1:
        return _best(index, asked, k)
    number, out = F.pmod(F.xxhash64("query_id"), F.lit(blocks)), None
    for b in range(blocks):
        part = stored(first_ranked(_best(index, asked.where(number == b), k), index.keys, k).drop("rank"), "hits")
        out = part if out is None else out.union(part)
    return out


def first_ranked(scores: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best ``k`` rows of each query with their ``rank``."""
    order = Window.partitionBy(*keys, "query_id").orderBy(F.desc(F.round("raw", 9)), "chunk_id")
    return scores.where("raw > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def postings_read(index: Index, asked: DataFrame, k: int) -> tuple[int, int]:
    """Postings that a search reads, and those of its queries' terms."""
    held, _ = _weights(index, asked)
    row = _answers(index, asked, held, k, True).agg(F.sum("read"), F.sum("postings")).first()
    return row[0] or 0, row[1] or 0


def _best(index: Index, asked: DataFrame, k: int) -> DataFrame:
    held, n = _weights(index, asked)
    return _gathered(index, asked, held, k) if n >= MANY else _answers(index, asked, held, k, False)


def _weights(index: Index, asked: DataFrame):
    """A broadcast of {corpus: [(query, [(term, weight)])]}, and how many queries it has.

    What comes here is bounded by a block of queries and the corpora that it is put to."""
    import math

    spark, found = asked.sparkSession, {}
    wanted = F.broadcast(asked.select("term").distinct())
    for row in index.postings().join(wanted, "term", "left_semi").groupBy(*index.keys, "term").agg(F.sum("n").alias("df")).toLocalIterator():
        found.setdefault(row[0] if index.by else None, {})[row.term] = row.df
    sizes = {(row[0] if index.by else None): row.n for row in index.sizes().collect()}
    queries: dict = {}
    for r in asked.toLocalIterator():
        queries.setdefault(r.query_id, []).append((r.term, r.times))
    ids = sorted(queries, key=str)
    weights = {
        slot: [(q, [(t, n * (math.log((sizes.get(slot, 0) + 1) / (df[t] * n + 1)) + 1)) for t, n in sorted(queries[q]) if t in df]) for q in ids]
        for slot, df in found.items()
    }
    return spark.sparkContext.broadcast(weights), len(ids)


def _gathered(index: Index, asked: DataFrame, held, k: int) -> DataFrame:
    """([by,] query_id, chunk_id, raw): the best ``k`` of all shards that a task reads for
    each query.  Rows grow with the tasks, which are two a core, and not with the shards."""
    spark = asked.sparkSession
    query, kind = asked.schema["query_id"].dataType.simpleString(), index.rows.schema["chunks"].dataType.elementType.simpleString()
    slot = f"`{index.by}` {index.rows.schema[index.by].dataType.simpleString()}, " if index.by else ""
    schema = f"{slot}query_id {query}, chunk_id {kind}, raw double"
    wanted = F.broadcast(asked.select("term").distinct())
    columns = [*index.keys, "shard", "term", "chunks", "places", "shares"]
    rows = index.postings().join(wanted, "term", "left_semi").select(*columns).union(index.rows.where("term IS NULL").select(*columns))
    rows = rows.repartition(2 * spark.sparkContext.defaultParallelism, *index.keys, "shard")
    rows = rows.sortWithinPartitions(*index.keys, "shard", F.col("term").isNotNull())
    return rows.mapInArrow(_gathering(held, k, schema, bool(index.by)), schema)


def _gathering(held, k: int, schema: str, slotted: bool):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        shard, slot, names, postings, best = None, None, None, {}, None

        def add():
            if postings and best:
                best.add(names, *best_of_many(best.plans, postings, len(names), k, best.least))

        def answers():
            for q, ids, raw in best.batches() if best else ():
                yield pa.RecordBatch.from_arrays([*[pa.array([slot] * len(q), out.field(0).type)] * slotted, q, ids, pa.array(raw)], schema=out)

        for b in batches:
            slots = b.column(0).to_pylist() if slotted else [None] * b.num_rows
            number, term, chunks, places, shares = (b.column(c) for c in range(int(slotted), int(slotted) + 5))
            lists = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in (places, shares)]
            for i, (own, n, t) in enumerate(zip(slots, number.to_pylist(), term.to_pylist())):
                if t is None:
                    # A shard begins with the names of its chunks.
                    add()
                    if shard is None or own != slot:
                        yield from answers()
                        queries = held.value.get(own, [])
                        best = Best(queries, k, out.field("query_id").type, out.field("chunk_id").type) if queries else None
                    shard, slot, names, postings = n, own, chunks[i].values, {}
                    continue
                postings[t] = (*(values[at[i] : at[i + 1]] for at, values in lists), None)
        add()
        yield from answers()

    return run


class Best:
    """The best ``k`` chunks of each query among the shards so far."""

    def __init__(self, queries: list, k: int, query, kind):
        import numpy as np
        import pyarrow as pa

        self.k, self.plans = k, [weights for _, weights in queries]
        self.queries = pa.array([q for q, _ in queries], query)
        self.asked, self.raw, self.ids = np.empty(0, np.int64), np.empty(0), pa.array([], kind)
        #: Scores from which on a chunk can still be among the best.
        self.least = np.full(len(queries), -np.inf)

    def add(self, names, asked, places, raw) -> None:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(asked):
            return
        new = np.zeros(len(self.plans), bool)
        new[asked] = True
        again = new[self.asked]
        rest, own = np.flatnonzero(~again), np.flatnonzero(again)
        ids = pa.concat_arrays([self.ids.take(pa.array(own)), names.take(pa.array(places)).cast(self.ids.type)])
        asked, raw = np.r_[self.asked[own], asked], np.r_[self.raw[own], raw]
        rank = pc.rank(ids, null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((rank, -np.round(raw, 9), asked))
        place = np.arange(len(order)) - np.searchsorted(asked[order], asked[order])
        full = order[place == self.k - 1]
        self.least[asked[full]] = raw[full]
        order = order[place < self.k]
        self.asked, self.raw = np.r_[self.asked[rest], asked[order]], np.r_[self.raw[rest], raw[order]]
        self.ids = pa.concat_arrays([self.ids.take(pa.array(rest)), ids.take(pa.array(order))])

    def batches(self, rows: int = 10_000):
        import pyarrow as pa

        for at in range(0, len(self.asked), rows):
            yield self.queries.take(pa.array(self.asked[at : at + rows])), self.ids.slice(at, rows), self.raw[at : at + rows]


def _answers(index: Index, asked: DataFrame, held, k: int, counted: bool) -> DataFrame:
    query = asked.schema["query_id"].dataType.simpleString()
    slot = f"`{index.by}` {index.rows.schema[index.by].dataType.simpleString()}, " if index.by else ""
    schema = f"{slot}shard bigint, " + ("read bigint, postings bigint" if counted else f"query_id {query}, place int, raw double")
    wanted = F.broadcast(asked.select("term").distinct())
    rows = index.postings().join(wanted, "term", "left_semi").select(*index.keys, "shard", "term", "places", "shares", "tops")
    hits = rows.groupBy(*index.keys, "shard").applyInArrow(_searched(held, k, schema, bool(index.by), counted), schema)
    if counted:
        return hits
    named = index.rows.where("term IS NULL").select(*index.keys, "shard", "chunks")
    # A corpus may be null, which a shard's number alone tells as well.
    return hits.join(named.select("shard", "chunks"), "shard").select(*index.keys, "query_id", F.get("chunks", F.col("place")).alias("chunk_id"), "raw")


def _searched(held, k: int, schema: str, slotted: bool, counted: bool):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out, block = to_arrow_schema(StructType.fromDDL(schema)), POSTINGS

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        slot, number = (key[0].as_py(), key[1].as_py()) if slotted else (None, key[0].as_py())
        postings = {}
        for term, places, shares, tops in zip(*(table.column(c) for c in ("term", "places", "shares", "tops"))):
            postings[term.as_py()] = tuple(x.values.to_numpy(zero_copy_only=False) for x in (places, shares, tops))
        n = 1 + max(int(p[0][-1]) for p in postings.values())
        rows, read, every = [], 0, 0
        queries = held.value.get(slot, [])
        for query, weights in queries:
            plan = [(t, w) for t, w in weights if t in postings]
            places, raw, did = best_of(plan, postings, n, k, block)
            read += did
            every += sum(len(postings[t][0]) for t, _ in plan)
            if not counted:
                rows += [(*[slot] * slotted, number, query, p, r) for p, r in zip(places.tolist(), raw.tolist())]
        if counted:
            rows = [(*[slot] * slotted, number, read, every)]
        columns = list(zip(*rows)) or [[] for _ in out]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return run


def best_of_many(plans: list[list[tuple[str, float]]], postings: dict, n: int, k: int, floor=None):
    """(queries, places, scores) of the best ``k`` of ``n`` chunks for each query; with
    ``floor``, a score for each query, of those that reach it.

    Terms of an eighth of the chunks and more are rows of one matrix that all queries of
    a block are multiplied with; the others' postings are added query by query."""
    import numpy as np

    asked = {t for plan in plans for t, _ in plan if t in postings}
    often = {t: j for j, t in enumerate(sorted(t for t in asked if 8 * len(postings[t][0]) >= n))}
    dense = np.zeros((len(often), n))
    for t, j in often.items():
        dense[j, postings[t][0]] = postings[t][1]
    out = []
    for at in range(0, len(plans), TOGETHER):
        part = plans[at : at + TOGETHER]
        weights = np.zeros((len(part), len(often)))
        for r, plan in enumerate(part):
            for t, w in plan:
                if t in often:
                    weights[r, often[t]] = w
        score = weights @ dense
        for r, plan in enumerate(part):
            for t, w in plan:
                if t in postings and t not in often:
                    places, shares, _ = postings[t]
                    score[r, places] += w * shares
        least = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(part), -np.inf)
        if floor is not None:
            least = np.maximum(least, floor[at : at + TOGETHER])
        rows, places = np.nonzero((score > 0) & (score >= least[:, None] - SLACK))
        raw = score[rows, places]
        order = np.lexsort((places, -np.round(raw, 9), rows))
        rows, places, raw = rows[order], places[order], raw[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        out.append((rows[rank < k] + at, places[rank < k], raw[rank < k]))
    return tuple(np.concatenate(x) for x in zip(*out))


def best_of(plan: list[tuple[str, float]], postings: dict, n: int, k: int, block: int = POSTINGS):
    """(places, scores, postings read) of the best ``k`` of ``n`` chunks for one query."""
    import numpy as np

    plan = sorted(plan, key=lambda x: (-max(0.0, x[1] * float(postings[x[0]][2].max())), x[0]))
    top = np.array([w * float(postings[t][2].max()) for t, w in plan])
    # What the terms from each one on can add, and take away.
    more, less = (np.r_[np.cumsum(x[::-1])[::-1], 0.0] for x in (np.maximum(top, 0), np.minimum(top, 0)))
    score, met, followed, least, read = np.zeros(n), np.zeros(n, bool), None, -np.inf, 0
    for j, (term, w) in enumerate(plan):
        places, shares, tops = postings[term]
        if followed is None and more[j] < least - SLACK:
            # No chunk that was not met can be among the best any more.
            followed = np.flatnonzero(met)
        if followed is None:
            score[places] += w * shares
            met[places] = True
            read += len(places)
            # Before that no score can be above what is left.
            if more[0] - more[j + 1] > more[j + 1]:
                own = score[met]
                if len(own) >= k:
                    least = float(np.partition(own, len(own) - k)[len(own) - k]) + less[j + 1]
            continue
        followed = followed[score[followed] + more[j] >= least - SLACK]
        at = np.minimum(np.searchsorted(places, followed), len(places) - 1)
        # The largest share of the block decides whether it is read at all.
        keep = score[followed] + np.maximum(w * tops[at // block], 0) + more[j + 1] >= least - SLACK
        followed, at = followed[keep], at[keep]
        read += min(len(places), block * len(np.unique(at // block)))
        hit = places[at] == followed
        score[followed[hit]] += w * shares[at[hit]]
        if len(followed) >= k:
            least = max(least, float(np.partition(score[followed], len(followed) - k)[len(followed) - k]) + less[j + 1])
    places = np.flatnonzero(met) if followed is None else followed
    places = places[score[places] > 0]
    places = places[np.lexsort((places, -np.round(score[places], 9)))][:k]
    return places, score[places], read
