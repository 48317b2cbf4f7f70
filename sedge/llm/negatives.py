"""Hard negatives by threshold joins on vectors of whole numbers.

Each anchor asks for rows in windows of scores (inner products).  A join takes the
windows' lowest score as its threshold and works on blocks of rows and of anchors:

* Dimensions are put in the order of their rising weight in the table.  The leading
  dimensions of a row stay out of the index as long as their norm, times the
  anchor's, is under the threshold: rows that are left out whole cannot reach it.
* The index holds the others, a posting slice for some dimensions at a time (rows
  lie by the length of what they leave out, so the rows of a slice are neighbours).
  Partial scores are added up from the heaviest dimensions on, and a pair goes as
  soon as the norms of what remains of both cannot lift it to the threshold.
* Scores of the pairs that are left are computed whole.

Thresholds begin high and are lowered for those anchors only whose windows are not
full yet, first to find the best positives, then for the negatives under each of
them; the last threshold is the window's own end, so results are exact.  Only the
first few rows of a window leave a pair of blocks, whatever the number of copies.

Defined results: rows with a null id, label or vector, or with a null or non-finite
component take no part; rows that share an id count once, the smallest by label and
components; short vectors are filled with zeros; other columns are not read; empty
tables give empty tables.  Scores are whole numbers of 64 bits; larger ones raise.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import small
from .common import bounded_batches, stored

#: Rows and anchors of a block, components of a block at most, dimensions in a slice.
ROWS, ANCHORS, COMPONENTS, SLICE = 4096, 512, 1 << 21, 8
#: Thresholds for positives, as shares of the largest score that norms allow (the
#: last: every row), and for negatives, in hundredths of the positive's score.
LEVELS, STEPS = (0.7, 0.4, None), (95, 80)
#: Pairs that are left, of all, from which on they are followed one by one.
SPARSE = 0.1
LOWEST = -(1 << 62)


def whole_rows(vectors: DataFrame, id_column: str, vector_column: str, label: Column, scale: int = 256) -> DataFrame:
    """(id, label, v): the rows that take part, with components in whole numbers."""
    rows = vectors.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(f"`{vector_column}`").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", whole.alias("v"))).alias("r"))
    return rows.select("id", "r.label", "r.v")


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, share: int = STEPS[-1]) -> DataFrame:
    """Of each anchor (a row of ``rows`` (id, label, v) where ``anchors`` holds) and each
    of its best rows of the same label, the first rows of other labels whose score is
    ``share`` hundredths of the positive's or more, and no more than it: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score."""
    bounded_batches(rows.sparkSession)
    rows = stored(rows, "rows")
    index = stored(_packed(rows, ROWS), "row-blocks")
    weights = {r.pos: r.w for r in index.select(F.posexplode("squares").alias("pos", "w")).groupBy("pos").agg(F.sum("w").alias("w")).collect()}
    order = sorted(weights, key=lambda d: (weights[d], d))
    most = index.agg(F.max("norm")).first()[0] or 0.0
    asked = rows.where(anchors)

    found, left = None, asked
    for level in LEVELS:
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        low = F.lit(LOWEST) if level is None else F.ceil(norm * (level * most))
        windows = left.withColumn("windows", F.array(F.struct(low.cast("bigint").alias("low"), F.lit(-LOWEST).alias("high"))))
        met = stored(_first(join(index, windows, order, True, positives), ["anchor_id"], positives), "positives")
        full = met.groupBy("anchor_id").agg(F.count("*").alias("n")).where(F.col("n") >= (positives if level is not None else 0)).select("anchor_id")
        taken = met.join(full, "anchor_id", "left_semi")
        found = taken if found is None else found.union(taken)
        if level is None:
            break
        left = stored(left.join(full.withColumnRenamed("anchor_id", "id"), "id", "left_anti"), "anchors-left")
        if not left.limit(1).count():
            break
    found = found.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).where("positive_score >= 0")

    steps = [x for x in STEPS if x > share] + [share]
    out, left = None, stored(found, "windows")
    for step in steps:
        # The smallest whole score of the step's hundredths: a ceiling of exact numbers.
        low = (-F.floor(-F.col("positive_score").cast("decimal(20,0)") * step / 100)).cast("bigint")
        asked_for = left.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("positive_id", low.alias("low"), F.col("positive_score").alias("high")))).alias("windows"))
        windows = asked.join(asked_for.withColumnRenamed("anchor_id", "id"), "id")
        met = join(index, windows, order, False, negatives)
        met = stored(_first(met, ["anchor_id", "positive_id"], negatives), "negatives")
        full = met.groupBy("anchor_id", "positive_id").agg(F.count("*").alias("n")).where(F.col("n") >= (negatives if step > share else 0)).select("anchor_id", "positive_id")
        taken = met.join(full, ["anchor_id", "positive_id"], "left_semi")
        out = taken if out is None else out.union(taken)
        if step == share:
            break
        left = stored(left.join(full, ["anchor_id", "positive_id"], "left_anti"), "windows-left")
        if not left.limit(1).count():
            break
    return out.join(found, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _first(met: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# -------------------------------------------------------------------- blocks

_BLOCK = "ids array<bigint>, labels array<bigint>, width int, parts binary, norm double, squares array<double>"


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows in blocks of ``size`` or fewer, a matrix each."""

    def run(batches):
        held, width = [], 1
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (len(held) >= size or max(width, len(row[2])) * (len(held) + 1) > COMPONENTS):
                    yield block(held, width)
                    held, width = [], 1
                held.append(row)
                width = max(width, len(row[2]))
        if held:
            yield block(held, width)

    def block(held, width):
        import numpy as np

        m = np.zeros((len(held), width), np.int64)
        for k, (_, _, v) in enumerate(held):
            m[k, : len(v)] = v
        squares = m.astype(float) ** 2
        norm = float(np.sqrt(squares.sum(1).max()))
        columns = [[[h[0] for h in held]], [[h[1] for h in held]], [width], [m.tobytes()], [norm], [squares.sum(0).tolist()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.float64(), pa.list_(pa.float64())))], names=["ids", "labels", "width", "parts", "norm", "squares"])

    return rows.select("id", "label", "v").mapInArrow(run, _BLOCK)


def _asking(windows: DataFrame) -> DataFrame:
    """Anchors (id, label, v, windows) in blocks: ids, labels, components, windows."""
    blocks = -(-windows.count() // ANCHORS) or 1
    dealt = windows.select(F.struct("id", "label", "v", "windows").alias("a"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    # A block is about ANCHORS rows by the number of blocks.
    return dealt.groupBy("block").agg(F.collect_list("a").alias("asked")).select("asked")


def join(index: DataFrame, windows: DataFrame, order: list[int], same: bool, k: int) -> DataFrame:
    """(anchor_id, [positive_id,] vec_id, score): of each window (low, high) of each
    anchor the first ``k`` rows of each block, of its label or of others."""
    asked = stored(_asking(windows), "asked")
    keyed = not same
    schema = "anchor_id bigint, " + "positive_id bigint, " * keyed + "vec_id bigint, score bigint"
    pairs = index.select("ids", "labels", "width", "parts").crossJoin(small(asked, 64))

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(c)[n].as_py() for c, name in enumerate(batch.schema.names)}
                columns = _met(row, order, same, k)
                if len(columns[0]):
                    columns = columns if keyed else [columns[0], *columns[2:]]
                    names = ["anchor_id", *["positive_id"] * keyed, "vec_id", "score"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return pairs.mapInArrow(run, schema)


def _met(row: dict, order: list[int], same: bool, k: int) -> list:
    """Of one pair of blocks: anchor, positive, row and score of each window's first."""
    import numpy as np

    asked = row["asked"]
    width = len(order)
    anchors, rows = np.zeros((len(asked), width), np.int64), np.zeros((len(row["ids"]), width), np.int64)
    for n, a in enumerate(asked):
        anchors[n, : len(a["v"])] = a["v"]
    rows[:, : row["width"]] = np.frombuffer(row["parts"], np.int64).reshape(-1, row["width"])
    anchors, rows = anchors[:, order], rows[:, order]
    ids, labels = np.array(row["ids"]), np.array(row["labels"])
    own_ids, own_labels = np.array([a["id"] for a in asked]), np.array([a["label"] for a in asked])
    i, j, s = candidates(anchors, rows, np.array([min(w["low"] for w in a["windows"]) for a in asked], float))
    keep = (own_ids[i] != ids[j]) & ((own_labels[i] == labels[j]) == same)
    i, j, s = i[keep], j[keep], s[keep]
    out: list[list] = [[], [], [], []]
    for n in range(max(len(a["windows"]) for a in asked)):
        span = [a["windows"][n] if n < len(a["windows"]) else {"low": 1, "high": 0} for a in asked]
        low, high = (np.array([w[x] for w in span]) for x in ("low", "high"))
        met = np.flatnonzero((s >= low[i]) & (s <= high[i]))
        met = met[np.lexsort((ids[j[met]], -s[met], i[met]))]
        own = i[met]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
        rank = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)]))
        met = met[rank < k]
        positive = np.array([w.get("positive_id", 0) for w in span])
        for held, x in zip(out, (own_ids[i[met]], positive[i[met]], ids[j[met]], s[met])):
            held += x.tolist()
    return out


def candidates(anchors, rows, threshold):
    """(anchor, row, score) of all pairs with a score of the anchor's ``threshold`` or
    more, and of no other pair; dimensions lie by rising weight."""
    import numpy as np

    m, n, width = len(anchors), len(rows), anchors.shape[1]
    cuts = list(range(0, width, SLICE)) + [width]
    norms = [np.sqrt(np.cumsum(x.astype(float) ** 2, 1)) for x in (anchors, rows)]
    # Norms of the leading dimensions, up to each cut.
    lead = [np.concatenate([np.zeros((len(x), 1)), x[:, [c - 1 for c in cuts[1:]]]], 1) if width else np.zeros((len(x), 1)) for x in norms]
    exact = float(lead[0][:, -1].max(initial=0)) * float(lead[1][:, -1].max(initial=0)) < 2.0**52
    a, r = (anchors.astype(float), rows.astype(float)) if exact else (anchors.astype(object), rows.astype(object))
    slack = lambda x: x * (1 + 1e-9) + 1e-6
    # What every anchor's threshold leaves for a row's leading dimensions.
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(threshold > 0, threshold / lead[0][:, -1], 0).min(initial=np.inf)
    omitted = (slack(lead[1][:, 1:]) < least).sum(1)
    place = np.argsort(omitted, kind="stable")
    omitted, r, rest = omitted[place], r[place], lead[1][place]
    indexed = np.searchsorted(omitted, np.arange(len(cuts) - 1), side="right")
    live = int(indexed[-1]) if width else n
    partial, alive = np.zeros((m, live)), np.ones((m, live), bool)
    for c in range(len(cuts) - 2, -1, -1) if exact else ():
        own = int(indexed[c])
        if not own:
            break
        partial[:, :own] += a[:, cuts[c] : cuts[c + 1]] @ r[:own, cuts[c] : cuts[c + 1]].T
        alive[:, :own] &= partial[:, :own] + slack(lead[0][:, c, None] * rest[None, :own, c]) >= threshold[:, None]
        if alive.sum() <= SPARSE * m * n:
            break
    i, j = np.nonzero(alive)
    scores = np.zeros(len(i), np.int64)
    step = max(1, COMPONENTS // max(1, width))
    for at in range(0, len(i), step):
        x = (a[i[at : at + step]] * r[j[at : at + step]]).sum(1) if width else 0
        if not exact and len(x) and max(map(abs, x)) >= 1 << 63:
            raise OverflowError("a score is beyond 64 bits")
        scores[at : at + step] = x
    keep = scores >= threshold[i]
    return i[keep], place[j[keep]], scores[keep]


def oracle_sql() -> str:
    """DuckDB SQL of the registered query over ``embeddings``."""
    return """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT * FROM n WHERE rank <= 5"""
