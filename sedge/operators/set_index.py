"""A stored prefix index of token sets, to which batches are held and added.

Ranks of tokens are frozen when the index is built: any fixed order gives exact
prefixes, and tokens without a rank come first.  Prefixes lie in folders by their
token's bucket and sets by their own, so a batch reads the buckets of its tokens and
of the sets that may be near, and no more.  A row of a prefix holds a token and its
set's hash, all else is with the set: a token costs little more than eight bytes.

Beside its tokens a set has a signature of ``SIGNATURE`` bits, each set by tokens of
that hash.  Sets differ in at least as many tokens as their signatures in bits, so most
that share no more than a rare token part where they meet, and are never written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import jaccard
from ..sources.shared import BROADCAST_IDS, scratch, shared_folder, shuffles_removed, small, stored

BUCKETS = 64
#: Columns of 64 bits of a signature; tokens that have ranks at most.
SIGNATURE, RANKED = ("s0", "s1", "s2", "s3"), 100_000


def bucket_of(c: Column | str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def id_of(c: Column | str) -> Column:
    """A set's hash, by which its bucket is found too."""
    return F.xxhash64(c)


def packed(c: Column | str) -> Column:
    """Tokens as one text, which moves in half the bytes of an array."""
    return F.to_json(c)


def unpacked(c: Column | str) -> Column:
    return F.from_json(c, "array<string>")


def save_by(rows: DataFrame, bucket: Column, path: str, mode: str = "error", order: tuple = ()) -> None:
    """Write rows in a folder for each bucket, sorted by ``order`` within a file."""
    _save(rows.withColumn("bucket", bucket).repartition("bucket"), path, mode, order)


def _save(dealt: DataFrame, path: str, mode: str, order: tuple = ()) -> None:
    with shuffles_removed(dealt.sparkSession):
        dealt.sortWithinPartitions("bucket", *order).write.mode(mode).option("compression", "zstd").partitionBy("bucket").parquet(path)


def load_by(spark: SparkSession, path: str, like: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Rows of ``like``'s columns, of the buckets that ``wanted`` (bucket) names; there
    are ``BUCKETS`` at most."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema) + ", bucket int"
    rows = spark.read.schema(schema).parquet(path)
    if wanted is not None:
        rows = rows.where(F.col("bucket").isin([r.bucket for r in wanted.select("bucket").distinct().collect()]))
    return rows


def ranks_of(sets: DataFrame, keys: tuple) -> DataFrame:
    """(keys, t, df): the most frequent tokens, ``RANKED`` at most.  The others come
    first in every set; which order it is only decides how many sets meet."""
    flat = sets.select(*keys, F.explode("tokens").alias("t"))
    return flat.groupBy(*keys, "t").agg(F.count("*").alias("df")).orderBy(F.desc("df"), *keys, "t").limit(RANKED)


def ordered_sets(sets: DataFrame, keys: tuple, ranks: DataFrame, dealt: tuple = ()) -> DataFrame:
    """(keys, cls, n, signature, tokens): sets (keys, cls, tokens) with their tokens from
    the rarest on; sets dealt by keys and class, or by columns of theirs that are kept
    in front (``dealt``), stay where they are."""
    flat = sets.select(*dealt, *keys, "cls", F.explode_outer("tokens").alias("t")).join(F.broadcast(ranks), [*keys, "t"], "left")
    width = 64 * len(SIGNATURE)
    # A shift takes a long's low six bits.
    at, one = F.pmod(F.xxhash64("t"), F.lit(width)), F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(t), {width}) AS INT))")
    bits = [F.bit_or(F.when(F.floor(at / 64) == k, one).otherwise(F.lit(0).cast("bigint"))).alias(c) for k, c in enumerate(SIGNATURE)]
    order = F.sort_array(F.collect_list(F.when(F.col("t").isNotNull(), F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t"))))
    rows = flat.groupBy(*dealt, *keys, "cls").agg(F.count("t").cast("int").alias("n"), *bits, order.alias("o"))
    return rows.select(*dealt, *keys, "cls", "n", *SIGNATURE, F.transform("o", lambda x: x["t"]).alias("tokens"))


def prefixes_of(ordered: DataFrame, keys: tuple, threshold: float) -> DataFrame:
    """(keys, cls, n, signature, t): each ordered set under its first (1 - t) n + 1 tokens."""
    first = F.slice("tokens", F.lit(1), (F.floor(F.col("n") * (1 - threshold) + 1e-9) + 1).cast("int"))
    return ordered.select(*keys, "cls", "n", *SIGNATURE, F.explode(first).alias("t"))


def may_be_near(threshold: float) -> Column:
    """Whether two sets (``n``, the signature; those of the other with a 2) can have a
    similarity of ``threshold``, by their sizes and by the bits in which they differ:
    |A - B| + |B - A| <= (1 - t) / (1 + t) (|A| + |B|)."""
    n, m = F.col("n"), F.col("n2")
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}2"))) for c in SIGNATURE), F.lit(0))
    return (m >= n * threshold - 1e-9) & (n >= m * threshold - 1e-9) & (apart <= (n + m) * ((1 - threshold) / (1 + threshold)) + 1e-6)


@dataclass(frozen=True)
class SetIndex:
    """The folder of an index of sets (keys, cls, tokens) for one threshold."""

    folder: str
    keys: tuple
    threshold: float
    like: DataFrame  # an empty table of sets

    @property
    def ranks(self) -> DataFrame:
        return self.like.sparkSession.read.parquet(f"{self.folder}/ranks")

    def prefixes(self, wanted: DataFrame) -> DataFrame:
        """(keys, id, t): the tokens of prefixes, with their sets' hashes."""
        like = self.like.select(*self.keys, F.lit(0).cast("bigint").alias("id"), F.lit("").alias("t"))
        return load_by(self.like.sparkSession, f"{self.folder}/prefixes", like, wanted).drop("bucket")

    def sets(self, wanted: DataFrame | None = None) -> DataFrame:
        return load_by(self.like.sparkSession, f"{self.folder}/sets", self.like, wanted)


def build_sets(sets: DataFrame, keys: tuple, threshold: float, folder: str | None = None, ranks: DataFrame | None = None) -> SetIndex:
    """An index of distinct sets (keys, cls, tokens); its ranks are those of now."""
    index = begin_sets(sets, keys, threshold, folder, ranks)
    index_prefixes(index)
    return index


def begin_sets(sets: DataFrame, keys: tuple, threshold: float, folder: str | None = None, ranks: DataFrame | None = None) -> SetIndex:
    """The sets and ranks of an index, which wants ``index_prefixes`` yet: that reads
    nothing but them."""
    spark = sets.sparkSession
    bits = [F.lit(0).cast("bigint").alias(c) for c in SIGNATURE]
    index = SetIndex(folder or shared_folder(spark, "set-index"), tuple(keys), threshold, sets.select(*keys, "cls", F.lit(0).alias("n"), *bits, "tokens").limit(0))
    with shuffles_removed(spark):
        (ranks_of(sets, keys) if ranks is None else ranks).write.parquet(f"{index.folder}/ranks")
    rows = sets.select(*keys, "cls", packed("tokens").alias("tokens"), bucket_of("cls").alias("bucket")).repartition("bucket")
    _save(ordered_sets(rows.withColumn("tokens", unpacked("tokens")), index.keys, index.ranks, ("bucket",)), f"{index.folder}/sets", "error")
    return index


def index_prefixes(index: SetIndex) -> None:
    """The prefixes of all sets of an index that has none."""
    _save_prefixes(index, index.sets(), "error")


def add_sets(index: SetIndex, batch: DataFrame) -> None:
    """Add those sets of a batch that the index has not got; ranks stay."""
    known = index.sets(batch.select(bucket_of("cls").alias("bucket"))).select(*index.keys, "cls")
    with scratch(batch.sparkSession, "added-sets") as hold:
        ordered = hold(ordered_sets(batch.join(known, [*index.keys, "cls"], "left_anti"), index.keys, index.ranks), "sets")
        save_by(ordered, bucket_of("cls"), f"{index.folder}/sets", "append")
        _save_prefixes(index, ordered, "append")


def _save_prefixes(index: SetIndex, ordered: DataFrame, mode: str) -> None:
    rows = prefixes_of(ordered, index.keys, index.threshold).select(*index.keys, id_of("cls").alias("id"), "t")
    save_by(rows, bucket_of("t"), f"{index.folder}/prefixes", mode, (*index.keys, "t"))


def _prefixes(index: SetIndex, sets: DataFrame) -> DataFrame:
    """Each set's prefix by the frozen ranks."""
    return prefixes_of(ordered_sets(sets, index.keys, index.ranks), index.keys, index.threshold)


def near_sets(index: SetIndex, batch: DataFrame) -> DataFrame:
    """Pairs (keys, cls, cls2): the sets of a batch with those of the index and of the
    batch that are near, each with itself too."""
    keys, threshold = index.keys, index.threshold
    held = stored(ordered_sets(batch, keys, index.ranks), "batch-sets")
    own = prefixes_of(held, keys, threshold)
    old = index.prefixes(own.select(bucket_of("t").alias("bucket"))).join(small(own.select(*keys, "t").distinct()), [*keys, "t"], "left_semi")
    # A hash may name more than one set; all of them meet, and tokens decide.
    there = index.sets(old.select(F.pmod("id", F.lit(BUCKETS)).cast("int").alias("bucket"))).select(*keys, "cls", "n", *SIGNATURE, id_of("cls").alias("id"))
    every = old.join(there, [*keys, "id"]).drop("id").unionByName(own)
    other = every.select(*keys, *[F.col(c).alias(f"{c}2") for c in ("cls", "n", *SIGNATURE)], "t")
    near = own.join(other, [*keys, "t"]).where(may_be_near(threshold))
    near = stored(near.where("cls <> cls2").select(*keys, "cls", "cls2").distinct(), "candidates")
    met = small(near.select(id_of("cls2").alias("id")).distinct(), BROADCAST_IDS)
    tokens = index.sets(near.select(bucket_of("cls2").alias("bucket"))).withColumn("id", id_of("cls")).join(met, "id", "left_semi")
    tokens = tokens.select(*keys, "cls", "tokens").unionByName(held.select(*keys, "cls", "tokens")).dropDuplicates([*keys, "cls"])
    both = near.join(held.select(*keys, "cls", "tokens"), [*keys, "cls"]).join(tokens.select(*keys, F.col("cls").alias("cls2"), F.col("tokens").alias("tokens2")), [*keys, "cls2"])
    alike = both.where(jaccard(F.col("tokens"), F.col("tokens2"), 1.0) >= threshold).select(*keys, "cls", "cls2")
    return alike.unionByName(batch.select(*keys, "cls", F.col("cls").alias("cls2")))
