"""SimHash near-duplicates by multi-index hashing.

Fingerprints link at three or fewer differing bits.  Cut into two segments of
32 bits, one segment of a linked pair differs in one bit at most: each
fingerprint looks up the ball of radius one around each of its segments in a
table of segments, and the complete distance of every match is checked.

Large groups of near copies would make that a list of all their pairs, so links
at one or two bits come first and by another way: two fingerprints differ in
two bits or fewer if and only if they have a neighbour at one bit or less in
common.  All fingerprints around such a neighbour (65 at most) point to the
smallest; that is 65 rows a fingerprint however large the group.  Only links of
three bits between different groups are left to the look-up.

Defined results: a null text is the empty text; texts without words have
fingerprint zero and link like any other; repeated rows give repeated rows and
share a component; rows with a null id take part, and a component without any
id gets a null id; other columns are not read; an empty table gives an empty
table.  Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.retrieval import small
from .common import map_rows, stored
from .components import components

BITS, SHINGLE, SEED, DISTANCE = 64, 3, 42, 3
#: Fingerprints that share a segment's value from which on the other segment splits
#: them, and rows of one fingerprint from which on these stay where they are.
CROWD, HOT_ROWS = 2000, 100_000
#: Repeats of a whole row from which it is set apart before rows are shuffled.
HOT = 1000


def fingerprint(text: str) -> int:
    """The signed 64-bit fingerprint of a text."""
    import numpy as np
    from xxhash import xxh64_intdigest

    # bytes.split cuts at blank and the controls from tab to carriage return.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        joined, ends, at = b" ".join(words), [], 0
        for w in words:
            at += len(w)
            ends.append(at)
            at += 1
        starts = [0, *[e + 1 for e in ends[: -SHINGLE]]]
        shingles = [joined[a:b] for a, b in zip(starts, ends[SHINGLE - 1 :])]
    h = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))
    return _majority(h)


def _majority(h) -> int:
    import numpy as np

    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 4096):
        ones += np.unpackbits(h[k : k + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">i8")[0])


def _start():
    def step(ids, texts):
        return [(i, fingerprint(t or "")) for i, t in zip(ids, texts)]

    return step


def _start_keyed():
    def step(keys, ids, texts):
        return [(k, i, fingerprint(t or "")) for k, i, t in zip(keys, ids, texts)]

    return step


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp): one row for each input row."""
    schema = f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, fp bigint"
    return map_rows(docs, [id_column, text_column], schema, _start)


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that join all fingerprints at one or two bits: every member
    of a ball of radius one points to the ball's smallest member."""
    masks = F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << k)).cast("bigint") for k in range(BITS)])
    balls = fps.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("centre"))
    # A ball, and so a window's partition, has 65 members at most.
    least = F.min("fp").over(Window.partitionBy("centre"))
    return balls.select(F.col("fp").alias("a"), least.alias("b")).where("a <> b").distinct()


def far_links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) of groups: ``nodes`` (fp, grp) of different groups whose
    fingerprints differ in ``DISTANCE`` bits or fewer.

    Where more than ``crowd`` fingerprints share a segment's value, the other segment is
    looked up too: of its four bytes one is equal, as three bits differ at most.

    Probes are 66 rows a node, but Spark sizes them as the nodes' files: without a hint
    it would broadcast them."""
    segment = lambda k: F.shiftrightunsigned("fp", 32 * k).bitwiseAND(F.lit(0xFFFFFFFF))
    table = nodes.select("fp", "grp", F.explode(F.array(*[F.struct(F.lit(k).alias("seg"), segment(k).alias("value")) for k in (0, 1)])).alias("s"))
    table = table.select("fp", "grp", "s.seg", "s.value")
    masks = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << k).cast("bigint") for k in range(32)])
    probes = table.select("fp", "grp", "seg", "value", F.explode(masks).alias("mask"))
    probes = probes.select(
        F.col("fp").alias("fp2"), F.col("grp").alias("grp2"), "seg", F.col("value").bitwiseXOR(F.col("mask")).alias("value")
    )
    crowded = stored(table.groupBy("seg", "value").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("seg", "value"), "crowded")
    keys = ["seg", "value"]
    if not crowded.limit(1).count():
        met = _apart(table.join(probes.hint("merge"), keys))
    else:
        crowded = small(crowded)
        met = _apart(table.join(crowded, keys, "left_anti").join(probes.join(crowded, keys, "left_anti").hint("merge"), keys))
        # The bytes of the other segment: those of the fingerprint from bit 32 on for the first.
        byte = lambda fp, j: F.when(F.col("seg") == 0, F.shiftrightunsigned(fp, 32 + 8 * j)).otherwise(F.shiftrightunsigned(fp, 8 * j)).bitwiseAND(F.lit(0xFF))
        bytes_of = lambda fp: F.explode(F.array(*[F.struct(F.lit(j).alias("j"), byte(fp, j).alias("byte")) for j in range(4)]))
        own = table.join(crowded, keys, "left_semi").select("*", bytes_of("fp").alias("x")).select("fp", "grp", *keys, "x.j", "x.byte")
        other = probes.join(crowded, keys, "left_semi").select("*", bytes_of("fp2").alias("x")).select("fp2", "grp2", *keys, "x.j", "x.byte")
        met = met.union(_apart(own.join(other.hint("merge"), [*keys, "j", "byte"])))
    return met.distinct()


def _apart(met: DataFrame) -> DataFrame:
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= DISTANCE
    return met.where((F.col("grp") < F.col("grp2")) & near).select(F.col("grp").alias("a"), F.col("grp2").alias("b"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def groups(known: DataFrame) -> DataFrame:
    """``known`` distinct fingerprints (fp, ...) with ``whole``, the smallest
    fingerprint reachable."""
    near = components(near_links(known.select("fp"))).withColumnsRenamed({"node": "fp", "component": "near"})
    nodes = stored(known.join(near, "fp", "left").withColumn("grp", F.coalesce("near", "fp")).drop("near"), "groups")
    joined = components(far_links(nodes.select("fp", "grp"))).withColumnsRenamed({"node": "grp", "component": "whole"})
    return nodes.join(joined, "grp", "left").withColumn("whole", F.coalesce("whole", "grp")).drop("grp")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for each input row."""
    rows = stored(fingerprints(docs, id_column, text_column), "fingerprints")
    known = stored(rows.groupBy("fp").agg(F.min(F.col(f"`{id_column}`")).alias("first_id"), F.count("*").alias("n")), "distinct")
    labels = groups(known)
    first = labels.groupBy("whole").agg(F.min("first_id").alias("component_id"))
    by_fp = stored(labels.join(first, "whole").select("fp", "component_id", "n"), "components")
    hot = by_fp.where(F.col("n") > HOT_ROWS)
    if hot.limit(1).count():
        # Rows of a fingerprint that many have are labelled without a shuffle; there is
        # one such fingerprint for HOT_ROWS rows at most.
        hot = small(hot)
        out = rows.join(hot, "fp", "left_anti").join(by_fp, "fp").unionByName(rows.join(hot, "fp"))
    else:
        out = rows.join(by_fp, "fp")
    return out.select(F.col(f"`{id_column}`"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_key(docs: DataFrame, text_column: str):
    """A digest of a whole row."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_column]
    text = F.coalesce(F.md5(F.col(f"`{text_column}`")), F.lit("-"))
    return F.concat(text, F.md5(F.to_json(F.struct(*rest)))) if rest else text


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component: that of the smallest id (rows without an id come
    last), and of rows that share it, that of the smallest digest.

    Only digests, ids and fingerprints go through the search; texts meet its
    verdict once, by digest.  Of a row that is repeated as a whole one is kept,
    by a streaming or partial aggregate."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(own.alias("own"), row_key(docs, text_column).alias("key"))
    searched = docs.select(row_key(docs, text_column).alias("key"), F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    kind = docs.schema[id_column].dataType.simpleString()
    rows = stored(map_rows(searched, ["key", "id", "text"], f"key string, id {kind}, fp bigint", _start_keyed), "fingerprints")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best")
    known = stored(rows.groupBy("fp").agg(best), "distinct")
    winners = groups(known).groupBy("whole").agg(F.min("best")["key"].alias("key"))
    repeats = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    winners = stored(winners.select("key").join(small(stored(repeats, "repeats")), "key", "left"), "winners")
    if not winners.where("n > 1").limit(1).count():
        return keyed.join(winners, "key", "left_semi").select("own.*")
    hot = small(winners.where(F.col("n") > HOT).select("key"))
    rest = keyed.join(hot, "key", "left_anti").join(winners, "key", "left_semi").dropDuplicates(["key"])
    return rest.union(keyed.join(hot, "key", "left_semi").dropDuplicates(["key"])).select("own.*")
