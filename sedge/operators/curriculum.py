"""Enrichment, coverage, consistency and splits of a curriculum."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, strip
from ..sources.shared import BROADCAST_IDS, Rounds, scratch, shared_folder, small, stored
from .set_index import SIGNATURE, SetIndex, add_sets, begin_sets, bucket_of, index_prefixes, load_by, may_be_near, near_sets, ordered_sets, packed, prefixes_of, ranks_of, save_by, unpacked

# Metadata fields, their patterns, formats and profiles.
FIELDS = {
    "tm_number": r"(?i)(TM\s+\d+-\d+(?:-\d+)*)",
    "nsn": r"(\d{4}-\d{2}-\d{3}-\d{4})",
    "maintenance_level": r"(?i)(organizational|direct support|general support|depot|unit|intermediate|field)\s+(?:level\s+)?maintenance",
    "equipment_system": r"(?:for|of|on)\s+(?:the\s+)?([A-Z][A-Za-z0-9\s/-]{3,40}?)(?:\.|,|\n|$)",
    "work_package": r"(?i)(WP\s+\d{4}\s+\d{2})",
    "lin": r"LIN:\s*([A-Z]\d{5})",
    "smr_code": r"SMR(?:\s+CODE)?:\s*([A-Z]{4,6})",
    "section_number": r"(?i)(?:Section|Chapter|Part)\s+(\d+(?:\.\d+)*)",
    "paragraph_ref": r"(?i)(?:para(?:graph)?\.?\s*)(\d+(?:-\d+)*(?:\.\d+)*)",
    "figure_ref": r"(?i)(?:Fig(?:ure)?\.?\s*)(\d+(?:-\d+)*)",
    "table_ref": r"(?i)(?:Table\s+)(\d+(?:-\d+)*)",
    "regulation_number": r"(?i)((?:AR|DA PAM|FM|ATP|ADP|TC|STP|MIL-STD|MIL-SPEC)\s+\d+(?:-\d+)*(?:\.\d+)*)",
    "part_number": r"P/N:\s*([A-Za-z0-9-]{3,20})",
    "cage_code": r"CAGE:\s*(\d{5})",
    "effective_date": r"(?i)(?:effective|dated?)\s+(\d{1,2}\s+\w+\s+\d{4}|\w+\s+\d{1,2},?\s+\d{4})",
}
#: Fields that are looked for in a chunk's path if its content lacks them.
IN_PATHS = ("tm_number", "section_number", "regulation_number")
FORMATS = {
    "nsn": r"^\d{4}-\d{2}-\d{3}-\d{4}$",
    "tm_number": r"(?i)^TM\s+\d+-\d+(-\d+)*$",
    "lin": r"^[A-Z]\d{5}$",
    "smr_code": r"^[A-Z]{4,6}$",
    "work_package": r"(?i)^WP\s+\d{4}\s+\d{2}$",
    "maintenance_level": r"(?i)^(organizational|direct support|general support|depot|unit|intermediate|field)$",
}
#: Fields of each type of document, and those that it must have.
PROFILES = {
    "TECHNICAL_MANUAL": (
        ("tm_number", "nsn", "maintenance_level", "equipment_system", "work_package", "lin", "smr_code", "section_number", "figure_ref", "table_ref"), ("tm_number",)
    ),
    "MAINTENANCE_PROCEDURE": (
        ("tm_number", "nsn", "maintenance_level", "work_package", "smr_code", "equipment_system", "section_number", "figure_ref"), ("tm_number", "maintenance_level")
    ),
    "PARTS_CATALOG": (("tm_number", "nsn", "lin", "smr_code", "figure_ref", "part_number", "cage_code"), ("tm_number", "nsn")),
    "REGULATION": (("regulation_number", "section_number", "paragraph_ref", "effective_date"), ()),
}
DEFAULT_PROFILE = (("section_number", "paragraph_ref", "figure_ref", "table_ref"), ())
CITATION = r"\b[A-Z]{2,4}\s*\d[\d-]+\d\b"
# Words that do not tell competencies apart.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "is", "are", "in", "on", "of", "to", "for", "with", "by", "at", "from", "that", "this", "it", "be", "as", "do", "not", "but", "all",
    "can", "has", "have", "was", "were", "will", "would",
)


def profile_of(doc_type: Column, which: int, profiles: dict | None = None) -> Column:
    """The fields (0) or required fields (1) of a document's profile."""
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, held in (profiles or PROFILES).items():
        out = out.when(doc_type == name, F.array(*map(F.lit, held[which])).cast("array<string>"))
    return out.otherwise(F.array(*map(F.lit, DEFAULT_PROFILE[which])).cast("array<string>"))


def extract_fields(chunks: DataFrame, profiles: dict | None = None) -> DataFrame:
    """One row for each field of its document's profile that a chunk (doc_id,
    chunk_id, doc_type, content, hierarchy_path) has: value, source, the match's
    share of the text as confidence, and whether the value has its format."""

    def found(name: str, source: str) -> Column:
        whole = F.regexp_extract(source, FIELDS[name], 0)
        value = strip(F.regexp_extract(source, FIELDS[name], 1))
        return F.when(whole != "", F.struct(F.lit(name).alias("field"), value.alias("value"), F.lit(source).alias("source"), (F.length(whole) / F.length(source)).alias("share")))

    every = [F.coalesce(found(n, "content"), found(n, "hierarchy_path")) if n in IN_PATHS else found(n, "content") for n in FIELDS]
    wanted = profile_of(F.col("doc_type"), 0, profiles)
    rows = chunks.withColumns({"__wanted": wanted, "__found": F.array_compact(F.array(*every))})
    rows = rows.select("doc_id", "chunk_id", "doc_type", F.explode(F.filter("__found", lambda x: F.array_contains("__wanted", x["field"]))).alias("f")).select("doc_id", "chunk_id", "doc_type", "f.*")
    confidence = F.when(F.col("share") < 0.3, 0.9).when(F.col("share") < 0.6, 0.7).otherwise(0.5)
    return rows.withColumns({"confidence": confidence, "valid": valid_field(F.col("field"), F.col("value"))}).drop("share")


def valid_field(name: Column, value: Column) -> Column:
    """Values of fields without a format are valid."""
    return reduce(lambda out, x: out.when(name == x[0], value.rlike(x[1])), FORMATS.items(), F.when(F.lit(False), False)).otherwise(True)


def thousandths(x: Column) -> Column:
    """Rounded to three places, halves up, by way of whole millionths."""
    return F.floor(F.round(x * 1e6) / 1e3 + 0.5) / 1e3


def enrichment_quality(chunks: DataFrame, fields: DataFrame, profiles: dict | None = None) -> DataFrame:
    """Of each chunk: .5 required fields found, .3 share of valid values, .2 mean
    confidence; and its fields as a map."""
    per = fields.groupBy("chunk_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"), F.count("*").alias("n"), F.count_if("valid").alias("valid"), F.sum((F.col("confidence") * 10).cast("int")).alias("sure")
    )
    rows = chunks.select("doc_id", "chunk_id", "doc_type").join(per, "chunk_id", "left")
    required = profile_of(F.col("doc_type"), 1, profiles)
    have = F.when(F.size(required) == 0, 1.0).otherwise(F.size(F.array_intersect(required, F.coalesce(F.map_keys("fields"), F.array().cast("array<string>")))) / F.size(required))
    score = 0.5 * have + F.when(F.col("n") > 0, 0.3 * F.col("valid") / F.col("n") + 0.2 * F.col("sure") / F.col("n") / 10).otherwise(0.3)
    return rows.select("doc_id", "chunk_id", "doc_type", "fields", F.col("fields").isNotNull().alias("applied"), thousandths(score).alias("quality"))


def document_quality(chunks: DataFrame) -> DataFrame:
    """Chunks, enriched ones and the mean quality of each document."""
    mean = F.sum(F.round(F.col("quality") * 1000).cast("bigint")) / F.count("*") / 1000
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if("applied").alias("enriched"), thousandths(mean).alias("quality"))


def field_coverage(chunks: DataFrame, fields: DataFrame, profiles: dict | None = None) -> DataFrame:
    """The share of a document's chunks that have each field of its profile."""
    docs = chunks.groupBy("doc_id", "doc_type").agg(F.count("*").alias("n"))
    wanted = docs.select("doc_id", "n", F.explode(profile_of(F.col("doc_type"), 0, profiles)).alias("field"))
    hits = fields.groupBy("doc_id", "field").agg(F.count("*").alias("hits"))
    rows = wanted.join(hits, ["doc_id", "field"], "left").fillna(0, ["hits"])
    return rows.select("doc_id", "field", F.col("hits").alias("chunks"), F.round(F.col("hits") / F.col("n"), 6).alias("share"))


def plain_words(*columns: str) -> Column:
    """The distinct words of texts that are no stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", *columns)), F.lit("[a-z]+"), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, STOP_WORDS)))


def suggest(chunks: DataFrame, competencies: DataFrame) -> DataFrame:
    """The competency (competency, name, description) that shares most words with a
    chunk's content and path, ties to the first; null where none shares any."""
    sides = small(competencies.select("competency", F.explode(plain_words("name", "description")).alias("w")))
    worded = chunks.select("chunk_id", plain_words("content", "hierarchy_path").alias("ws"))
    n = worded.select("chunk_id", F.explode("ws").alias("w")).join(sides, "w").groupBy("chunk_id", "competency").agg(F.count("*").alias("n"))
    best = n.groupBy("chunk_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "competency")).alias("b"))
    return chunks.select("chunk_id").join(best, "chunk_id", "left").select("chunk_id", F.col("b.competency").alias("competency"), F.coalesce(-F.col("b.n"), F.lit(0)).alias("shared"))


def coverage(competencies: DataFrame, examples: DataFrame) -> DataFrame:
    """Training examples of each competency against its target."""
    n = examples.groupBy("competency").agg(F.count_if(~F.col("is_test_set")).alias("n"), F.count_if("is_test_set").alias("tests"))
    rows = competencies.join(n, "competency", "left").fillna(0, ["n", "tests"])
    ratio = F.when(F.col("target") == 0, 1.0).otherwise(F.col("n") / F.col("target"))
    return rows.withColumns({"ratio": F.round(ratio, 6), "gap": F.greatest(F.col("target") - F.col("n"), F.lit(0)), "met": F.col("n") >= F.col("target")})


def coverage_report(covered: DataFrame) -> DataFrame:
    """Totals of each discipline: training and test examples, competencies short of
    their targets, and whether none is."""
    short = F.array_sort(F.collect_list(F.when(~F.col("met"), F.struct("competency", "name"))))
    return covered.groupBy("discipline").agg(
        F.sum("n").alias("total_examples"), F.sum("tests").alias("total_tests"), F.array_join(F.transform(short, lambda x: x["name"]), ", ").alias("gaps"), F.bool_and("met").alias("complete")
    )


def recommendations(covered: DataFrame) -> DataFrame:
    """Where examples are needed, the empty first, then the largest gaps, and why."""
    priority = F.when(F.col("n") == 0, 1).when(F.col("ratio") < 0.5, 2).otherwise(3)
    have = F.concat(F.floor(F.round(F.col("ratio") * 1e6) / 1e4 + 0.5).cast("int"), F.lit("% ("), "n", F.lit("/"), "target", F.lit(")"))
    reason = F.when(F.col("n") == 0, "none yet").when(F.col("ratio") < 0.5, F.concat(F.lit("only "), have)).otherwise(F.concat(F.lit("nearly: "), have))
    w = Window.partitionBy("discipline").orderBy("priority", F.desc("gap"), "competency")
    return covered.where("NOT met").withColumns({"priority": priority, "reason": reason}).withColumn("rank", F.row_number().over(w))


def map_summary(covered: DataFrame) -> DataFrame:
    """Roots, children, targets and needs of each discipline's competencies."""
    short = F.array_sort(F.collect_list(F.when(~F.col("met"), F.struct("competency", "name"))))
    return covered.groupBy("discipline").agg(
        F.count("*").alias("competencies"), F.count_if(F.col("parent").isNull()).alias("roots"), F.count("parent").alias("children"), F.sum("target").alias("target"),
        F.array_join(F.transform(short, lambda x: x["name"]), ", ").alias("gaps"), F.sum("gap").alias("needed"),
    )


def map_violations(competencies: DataFrame, roots: int = 3) -> DataFrame:
    """(discipline, competency, violation): what keeps a map from being final."""
    few = competencies.groupBy("discipline").agg(F.count_if(F.col("parent").isNull()).alias("n")).where(F.col("n") < roots)
    own = F.array(F.when(strip(F.col("name")) == strip(F.col("description")), "name is the description"), F.when(F.col("target") <= 0, "no target"))
    rows = competencies.select("discipline", "competency", F.explode(F.array_compact(own)).alias("violation"))
    return rows.union(few.select("discipline", F.lit(None).cast("bigint"), F.lit("too few roots")))


def tree(competencies: DataFrame) -> DataFrame:
    """Depth, root, path and descendants of each node of a parent table, and whether
    its ancestors run in a cycle.  A parent that has no row makes a root.

    Ancestors are found by doubling: each round, a node takes over what the last of
    its known ancestors knows, until no node has one to ask; a chain of any length
    takes its logarithm in rounds.  Each round is written before the next."""
    known = competencies.select(F.col("competency").alias("parent"))
    up = F.col("parent").alias("next")
    rows = competencies.select("competency", "parent").join(known, "parent", "left_semi").select("competency", up)
    rows = rows.unionByName(competencies.select("competency").join(rows.select("competency"), "competency", "left_anti").withColumn("next", F.lit(None).cast(competencies.schema["parent"].dataType)))
    rows = rows.select("competency", "next", F.array("competency").alias("path"), F.lit(False).alias("cycle"))
    rounds = Rounds(competencies.sparkSession, "tree")
    rows = rounds.hold(rows)
    while rows.where("next IS NOT NULL").limit(1).count():
        other = rows.select(F.col("competency").alias("next"), F.col("next").alias("__next"), F.col("path").alias("__path"))
        both = rows.join(small(other), "next", "left")
        path = F.concat("path", F.coalesce("__path", F.array().cast(rows.schema["path"].dataType)))
        again = F.size(F.array_distinct(path)) < F.size(path)
        rows = rounds.hold(both.select("competency", F.when(again, None).otherwise(F.col("__next")).alias("next"), F.array_distinct(path).alias("path"), (F.col("cycle") | again).alias("cycle")))
    below = rows.where("NOT cycle").select(F.explode(F.slice("path", F.lit(2), F.size("path"))).alias("competency")).groupBy("competency").agg(F.count("*").alias("descendants"))
    out = rows.join(below, "competency", "left").fillna(0, ["descendants"])
    return out.select("competency", (F.size("path") - 1).alias("depth"), F.element_at("path", -1).alias("root"), F.array_join(F.reverse("path"), "/").alias("path"), "cycle", "descendants")


def remove_competencies(competencies: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Competencies without those of ``requests`` (competency, to_parent), their
    children moved; and the requests turned down, as their competency has children
    that no one takes."""
    parents = competencies.where("parent IS NOT NULL").select(F.col("parent").alias("competency")).distinct()
    bad = requests.where("to_parent IS NULL").join(parents, "competency", "left_semi")
    good = small(requests.join(bad.select("competency"), "competency", "left_anti"))
    rows = competencies.join(good.select("competency"), "competency", "left_anti")
    moved = rows.join(good.select(F.col("competency").alias("parent"), F.lit(True).alias("__gone"), "to_parent"), "parent", "left")
    return moved.select(*[c for c in competencies.columns if c != "parent"], F.when(F.col("__gone"), F.col("to_parent")).otherwise(F.col("parent")).alias("parent")), bad


def review_queue(examples: DataFrame, memberships: DataFrame, contributors: DataFrame, competencies: DataFrame) -> DataFrame:
    """Pending examples of each reviewer's areas (all, if none are named), with
    names, or ids where there is none."""
    pending = examples.where("review_status = 'pending'").select("example_id", "contributor", "competency", "discipline")
    reviewers = small(memberships.select(F.col("contributor").alias("reviewer"), "discipline", "areas"))
    rows = pending.join(reviewers, "discipline").where((F.size("areas") == 0) | F.array_contains("areas", F.col("competency")))
    rows = rows.join(small(contributors.select("contributor", F.col("name").alias("__who"))), "contributor", "left").join(small(competencies.select("competency", F.col("name").alias("__what"))), "competency", "left")
    named = lambda c, k: F.coalesce(c, F.col(k).cast("string"))
    return rows.select("reviewer", "example_id", named("__who", "contributor").alias("contributor_name"), named("__what", "competency").alias("competency_name"))


STATUS = {"approve": "approved", "reject": "rejected", "revise": "needs_revision"}


def apply_reviews(examples: DataFrame, log: DataFrame, memberships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviewed examples, and the decisions turned down.

    ``log`` has example_id, seq, reviewer, decision, notes and at.  Leads and admins
    of the example's discipline may decide; the last decision holds, and the notes of
    all are appended to the context in order."""
    able = small(memberships.where(F.col("role").isin("lead", "admin")).select(F.col("contributor").alias("reviewer"), "discipline", F.lit(True).alias("__able")))
    rows = log.join(examples.select("example_id", "discipline"), "example_id", "left").join(able, ["reviewer", "discipline"], "left")
    good = rows.where("__able")
    last = lambda c: F.max_by(c, "seq")
    notes = F.array_sort(F.collect_list(F.when(F.coalesce("notes", F.lit("")) != "", F.struct("seq", F.concat(F.lit("review: "), "notes").alias("t")))))
    per = good.groupBy("example_id").agg(last("decision").alias("decision"), last("reviewer").alias("reviewed_by"), last("at").alias("reviewed_at"), F.array_join(F.transform(notes, lambda x: x["t"]), " | ").alias("__notes"))
    status = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])[F.col("decision")]
    out = examples.drop("review_status").join(per, "example_id").withColumn("review_status", status)
    out = out.withColumn("context", F.concat_ws(" | ", F.nullif("context", F.lit("")), F.nullif("__notes", F.lit("")))).drop("decision", "__notes")
    return out, rows.where("__able IS NULL").select("example_id", "seq", "reviewer")


def contribution_stats(examples: DataFrame, memberships: DataFrame) -> DataFrame:
    """Of each member: examples by state and by competency, zeros for idle ones."""
    n = lambda s: F.sum(F.when(F.col("review_status") == s, F.col("k")).otherwise(0)).alias(s)
    per = examples.groupBy("contributor", "discipline", "competency", "review_status").agg(F.count("*").alias("k"))
    by = per.groupBy("contributor", "discipline", "competency").agg(F.sum("k").alias("k"))
    by = by.groupBy("contributor", "discipline").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("competency", "k")))).alias("by_competency"))
    counts = per.groupBy("contributor", "discipline").agg(F.sum("k").alias("total"), n("approved"), n("rejected"), n("pending"))
    rows = memberships.select("contributor", "discipline").join(counts, ["contributor", "discipline"], "left").join(by, ["contributor", "discipline"], "left")
    return rows.fillna(0, ["total", "approved", "rejected", "pending"])


def ownership(pairs: DataFrame, memberships: DataFrame) -> DataFrame:
    """Whether a contributor owns a competency (contributor, discipline, competency):
    members own the areas that they name, or all."""
    held = small(memberships.select("contributor", "discipline", "areas"))
    owns = (F.size("areas") == 0) | F.array_contains("areas", F.col("competency"))
    return pairs.join(held, ["contributor", "discipline"], "left").withColumn("owns", F.coalesce(owns, F.lit(False))).drop("areas")


def hash_order(*columns, seed: int = 42) -> Column:
    """A text by which rows are in a fixed random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *columns))


#: Leading hexadecimal digits of a hash that make its bucket.
BUCKET_DIGITS = 3


def first_of(rows: DataFrame, keys: tuple, quota: DataFrame, id_column: str = "example_id", seed: int = 42) -> DataFrame:
    """The first rows of each group in the order of hashes, as many as ``quota``
    (keys, quota) says.

    Rows are counted by bucket of their hash; whole buckets are in or out, and only
    the rows of a group's last bucket are ranked, so no task sorts a group."""
    marked = rows.withColumn("__h", hash_order(id_column, seed=seed))
    marked = marked.withColumn("__b", F.substring("__h", 1, BUCKET_DIGITS))
    by = list(keys)
    sizes = marked.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("__before", before).join(quota, by) if by else sizes.withColumn("__before", before).crossJoin(quota)
    sizes = sizes.where(F.col("__before") < F.col("quota")).select(*by, "__b", (F.col("quota") - F.col("__before")).alias("__room"), F.col("__n").alias("__size"))
    met = marked.join(small(sizes), [*by, "__b"])
    whole = met.where(F.col("__size") <= F.col("__room"))
    rank = F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__h", id_column))
    part = met.where(F.col("__size") > F.col("__room")).withColumn("__r", rank).where(F.col("__r") <= F.col("__room")).drop("__r")
    return whole.unionByName(part).drop("__h", "__b", "__room", "__size")


def split_stratified(examples: DataFrame, keys: tuple = ("competency",), share: float = 0.2, seed: int = 42, least: int = 5, marked: str | None = None) -> DataFrame:
    """``is_test`` for ceil(share) of each group of ``least`` or more, at least
    one, by the order of hashes; marked examples stay tests and count first."""
    own = F.count_if(F.col(marked)) if marked else F.lit(0)
    sizes = examples.groupBy(*keys).agg(F.count("*").alias("n"), own.alias("m"))
    want = F.when(F.col("n") >= least, F.greatest(F.ceil(F.col("n") * F.lit(share)), F.lit(1))).otherwise(0)
    quota = sizes.select(*keys, F.greatest(want - F.col("m"), F.lit(0)).cast("bigint").alias("quota"))
    free = examples.where(~F.col(marked)) if marked else examples
    taken = first_of(free.select("example_id", *keys), keys, quota, seed=seed).select("example_id", F.lit(True).alias("__t"))
    if marked:
        taken = taken.union(examples.where(F.col(marked)).select("example_id", F.lit(True)))
    return examples.join(taken, "example_id", "left").withColumn("is_test", F.coalesce("__t", F.lit(False))).drop("__t")


def train_val_split(rows: DataFrame, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """(example_id, split): the first int(n ratio) rows in the order of hashes are for
    validation."""
    quota = rows.agg(F.floor(F.count("*") * F.lit(ratio)).alias("quota"))
    val = first_of(rows.select("example_id"), (), quota, seed=seed)
    return rows.select("example_id").join(val.withColumn("__v", F.lit("val")), "example_id", "left").select("example_id", F.coalesce("__v", F.lit("train")).alias("split"))


def length_outliers(examples: DataFrame, keys: tuple = ("competency",), least: int = 5) -> DataFrame:
    """Answers under half or over twice their competency's mean length."""
    mean = examples.groupBy(*keys).agg(F.avg(F.length("answer")).alias("mean"), F.count("*").alias("n")).where(F.col("n") >= least)
    rows = examples.join(small(mean), list(keys))
    kind = F.when(F.length("answer") < 0.5 * F.col("mean"), "short").when(F.length("answer") > 2 * F.col("mean"), "long")
    return rows.select("example_id", kind.alias("issue")).where("issue IS NOT NULL")


def terminology_gaps(examples: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Examples that use none of the vocabulary."""
    text = F.lower(F.concat_ws(" ", "question", "answer"))
    return examples.where(~F.exists(F.array(*[F.lit(w.lower()) for w in vocabulary]), lambda w: text.contains(w))).select("example_id")


def question_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def set_class(c: Column) -> Column:
    """A key of a set of tokens."""
    return F.unhex(F.md5(F.to_json(F.sort_array(c))))


def similar_sets(left: DataFrame, right: DataFrame, keys: tuple, threshold: float, ranks: DataFrame | None = None) -> DataFrame:
    """Pairs (keys, cls, cls2) of sets (keys, cls, tokens) of the left table with those
    of the right whose Jaccard similarity is ``threshold`` or more, each with itself
    too.

    Exact join by prefixes: tokens ordered by rarity, each set indexed under its first
    (1 - t) n + 1 tokens, equal tokens met, sizes and signatures compared, pairs
    verified.  Where they meet tokens and sets are named by hashes; those join no others.
    Sets without tokens equal each other only."""
    ranks = stored(ranks_of(right, keys) if ranks is None else ranks, "ranks")
    all_sets = stored(ordered_sets(right, keys, ranks), "ordered-sets")
    asked = all_sets if left is right else stored(ordered_sets(left, keys, ranks), "ordered-sets")
    held = [F.xxhash64(*keys, "cls").alias("id"), "n", *SIGNATURE]

    def index(sets: DataFrame) -> DataFrame:
        return prefixes_of(sets, keys, threshold).select(F.xxhash64(*keys, "t").alias("h"), *held)

    def named(sets: DataFrame, ids: DataFrame, suffix: str) -> DataFrame:
        """The few sets that are in a pair."""
        rows = sets.select(held[0], *keys, "cls", "tokens").join(small(ids.distinct(), BROADCAST_IDS), "id", "left_semi")
        return rows.select(*[F.col(c).alias(f"{c}{suffix}") for c in ("id", *keys, "cls", "tokens")])

    x = index(asked)
    if left is right:
        # Tokens of one set meet nothing, so their rows stay where they are.
        met = x.groupBy("h").agg(F.count("*").alias("met")).where("met > 1")
        x = x.join(small(met.select("h"), BROADCAST_IDS), "h", "left_semi")
    y = (x if left is right else index(all_sets)).select("h", *[F.col(c).alias(f"{c}2") for c in ("id", "n", *SIGNATURE)])
    # Of one table each pair meets once.
    near = x.join(y, "h").where(may_be_near(threshold)).where("id < id2" if left is right else "id <> id2").select("id", "id2").distinct()
    near = stored(near, "candidates")
    both = near.join(named(asked, near.select("id"), ""), "id").join(named(all_sets, near.select(F.col("id2").alias("id")), "2"), "id2")
    for k in keys:
        both = both.where(F.col(k) == F.col(f"{k}2"))
    alike = both.where(jaccard(F.col("tokens"), F.col("tokens2"), 1.0) >= threshold).select(*keys, "cls", "cls2")
    if left is right:
        alike = stored(alike, "alike")
        alike = alike.union(alike.select(*keys, F.col("cls2").alias("cls"), F.col("cls").alias("cls2")))
    return alike.union(asked.select(*keys, "cls", F.col("cls").alias("cls2")))


def conflicts(examples: DataFrame, threshold: float = 0.7, keys: tuple = ("discipline",), new: Column | None = None) -> DataFrame:
    """(example_id, class_id, links): each example, the class of those with its words
    in question and answer (named by the smallest id), and the number of classes whose
    questions are alike and whose answers are not.

    With ``new``, only examples that meet it are asked about, against all."""
    rows = stored(_classed(examples, keys).withColumn("asked", F.lit(True) if new is None else new), "examples")
    by = [*keys, "qc", "ac"]
    classes = stored(rows.groupBy(*by).agg(F.min("example_id").alias("class_id"), F.max("asked").alias("asked")), "classes")
    asked = classes if new is None else classes.where("asked")

    def near(key: str, c: str) -> DataFrame:
        # Texts are not in the classes: sets and their ranks come from the rows.
        every = _sets(rows, key, c, keys)
        own = every if new is None else _sets(rows.where("asked"), key, c, keys)
        return stored(similar_sets(own, every, keys, threshold, ranks_of(rows.select(*keys, F.col(c).alias("tokens")), keys)), c)

    links = _links(asked.select(*by, "class_id"), classes, classes, near("qc", "q"), near("ac", "a"), keys)
    return rows.where("asked").select("example_id", *by).join(links, by).select("example_id", "class_id", "links")


def _classed(examples: DataFrame, keys: tuple) -> DataFrame:
    rows = examples.select("example_id", *keys, question_tokens(F.col("question")).alias("q"), question_tokens(F.col("answer")).alias("a"))
    return rows.withColumns({"qc": set_class(F.col("q")), "ac": set_class(F.col("a"))})


def _sets(of: DataFrame, key: str, c: str, keys: tuple) -> DataFrame:
    return of.groupBy(*keys, F.col(key).alias("cls")).agg(F.first(packed(c)).alias("tokens")).withColumn("tokens", unpacked("tokens"))


def _links(asked: DataFrame, by_question: DataFrame, by_answer: DataFrame, near_q: DataFrame, near_a: DataFrame, keys: tuple) -> DataFrame:
    """(keys, qc, ac, class_id, links) of the classes that are asked about: the classes
    with a question alike less those that have an answer alike as well.

    Those are counted from the side of a class that has fewer classes alike, of which
    each is a row that is looked up on the other side: near questions never meet near
    answers as a product.  ``by_question`` and ``by_answer`` hold all classes."""
    by = [*keys, "qc", "ac"]

    def alike(near: DataFrame, classes: DataFrame, side: str, name: str) -> DataFrame:
        counts = classes.groupBy(*keys, F.col(side).alias("cls2")).agg(F.count("*").alias("n"))
        return near.join(counts, [*keys, "cls2"]).groupBy(*keys, F.col("cls").alias(side)).agg(F.sum("n").alias(name))

    sized = asked.join(alike(near_q, by_question, "qc", "met"), [*keys, "qc"]).join(alike(near_a, by_answer, "ac", "met_a"), [*keys, "ac"])
    sized = stored(sized, "sized")

    def same(rows: DataFrame, near: DataFrame, other: DataFrame, classes: DataFrame, side: str, beyond: str) -> DataFrame:
        met = rows.select(*by).join(near.select(*keys, F.col("cls").alias(side), F.col("cls2").alias(f"{side}2")), [*keys, side])
        met = met.join(classes.select(*keys, F.col(side).alias(f"{side}2"), F.col(beyond).alias(f"{beyond}2")), [*keys, f"{side}2"])
        return met.join(other.select(*keys, F.col("cls").alias(beyond), F.col("cls2").alias(f"{beyond}2")), [*keys, beyond, f"{beyond}2"], "left_semi").select(*by)

    fewer = F.col("met") <= F.col("met_a")
    both = same(sized.where(fewer), near_q, near_a, by_question, "qc", "ac").union(same(sized.where(~fewer), near_a, near_q, by_answer, "ac", "qc"))
    both = both.groupBy(*by).agg(F.count("*").alias("same"))
    return sized.join(both, by).select(*by, "class_id", (F.col("met") - F.col("same")).alias("links"))


@dataclass(frozen=True)
class ConflictIndex:
    """Stored questions, answers and classes that batches are checked against."""

    questions: SetIndex
    answers: SetIndex
    folder: str
    like: DataFrame  # an empty table of classes

    def classes(self, side: str, near: DataFrame) -> DataFrame:
        """The classes in the buckets of the near sets of one side."""
        rows = load_by(self.like.sparkSession, f"{self.folder}/classes-{side}", self.like, near.select(bucket_of("cls2").alias("bucket")))
        return rows.drop("bucket")


def index_examples(examples: DataFrame, threshold: float = 0.7, keys: tuple = ("discipline",), folder: str | None = None) -> ConflictIndex:
    """An index of a corpus of examples, to check and add batches."""
    folder = folder or shared_folder(examples.sparkSession, "conflict-index")
    spark, sides = examples.sparkSession, (("qc", "q", "questions"), ("ac", "a", "answers"))
    with scratch(spark, "indexed-sets") as held:
        # Each table goes before the next larger one is made of it.
        with scratch(spark, "indexed") as hold:
            rows = hold(_classed(examples, keys), "examples")
            sets = {name: held(_sets(rows, key, c, keys), name) for key, c, name in sides}
            ranks = {name: held(ranks_of(rows.select(*keys, F.col(c).alias("tokens")), keys), f"{name}-ranks") for _, c, name in sides}
            classes = hold(rows.groupBy(*keys, "qc", "ac").agg(F.min("example_id").alias("class_id")), "classes")
            like = classes.limit(0)
            for side in ("qc", "ac"):
                save_by(classes, bucket_of(side), f"{folder}/classes-{side}")
        made = [begin_sets(sets[name], keys, threshold, f"{folder}/{name}", ranks[name]) for _, _, name in sides]
    for side in made:
        index_prefixes(side)
    return ConflictIndex(*made, folder, like)


def _with_ids(rows: DataFrame, keys: tuple) -> DataFrame:
    return rows.groupBy(*keys, "qc", "ac").agg(F.min("example_id").alias("class_id"), F.first("q").alias("q"), F.first("a").alias("a"))


def _save_classes(index: ConflictIndex, classes: DataFrame, mode: str) -> None:
    for side in ("qc", "ac"):
        save_by(classes.select(index.like.columns), bucket_of(side), f"{index.folder}/classes-{side}", mode)


def check_batch(index: ConflictIndex, examples: DataFrame, add: bool = False) -> DataFrame:
    """``conflicts`` of a batch of new examples against the index and the batch; with
    ``add`` the batch is then part of the index.

    Of the index only the buckets are read in which something near the batch can lie."""
    keys = index.questions.keys
    by = [*keys, "qc", "ac"]
    rows = stored(_classed(examples, keys), "batch")
    own = stored(_with_ids(rows, keys), "batch-classes")
    near_q = stored(near_sets(index.questions, _sets(own, "qc", "q", keys)), "questions")
    near_a = stored(near_sets(index.answers, _sets(own, "ac", "a", keys)), "answers")
    every = {side: _merged(index.classes(side, near).unionByName(own.select(index.like.columns)), by) for side, near in (("qc", near_q), ("ac", near_a))}
    asked = every["qc"].join(own.select(*by), by, "left_semi")
    links = _links(asked, every["qc"], every["ac"], near_q, near_a, keys)
    out = rows.join(links, by).select("example_id", "class_id", "links")
    if add:
        out = stored(out, "checked")
        add_sets(index.questions, _sets(own, "qc", "q", keys))
        add_sets(index.answers, _sets(own, "ac", "a", keys))
        # Classes that are there already come again, perhaps with a smaller id.
        _save_classes(index, own, "append")
    return out


def _merged(classes: DataFrame, by: list[str]) -> DataFrame:
    """Classes once, named by the smallest id."""
    return stored(classes.groupBy(*by).agg(F.min("class_id").alias("class_id")), "merged-classes")


def citation_forms(examples: DataFrame) -> DataFrame:
    """Citations written in more than one way, and who writes them."""
    rows = examples.select("example_id", F.explode(F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "question", "answer"), F.lit(CITATION), F.lit(0)))).alias("form"))
    rows = rows.withColumn("key", F.replace("form", F.lit(" "), F.lit("")))
    forms = rows.groupBy("key").agg(F.countDistinct("form").alias("forms")).where("forms > 1")
    return rows.join(forms, "key")


ISSUES = {
    "length_outlier": ("warning", "bring the answer nearer to its competency's mean length"), "terminology": ("info", "use words of the discipline's vocabulary"),
    "citation_format": ("warning", "write the citation as most examples do"), "conflict": ("error", "look at both answers and settle the conflict"),
}


def consistency_report(length: DataFrame, terms: DataFrame, citations: DataFrame, clashes: DataFrame) -> DataFrame:
    """(issue, severity, n, examples, fix): all checks, each of which has a row an
    issue (example_id)."""
    out = None
    for name, rows in zip(ISSUES, (length, terms, citations, clashes)):
        severity, fix = ISSUES[name]
        part = rows.agg(F.count("*").alias("n"), F.countDistinct("example_id").alias("examples")).select(F.lit(name).alias("issue"), F.lit(severity).alias("severity"), "n", "examples", F.lit(fix).alias("fix"))
        out = part if out is None else out.union(part)
    # Four rows.
    return out.withColumn("has_errors", F.max((F.col("severity") == "error") & (F.col("n") > 0)).over(Window.partitionBy()))


def validate_drafts(drafts: DataFrame) -> DataFrame:
    """One row for each error of a draft (question, answer, competency, difficulty)."""
    q, a, d = F.col("question"), F.col("answer"), F.col("difficulty")
    errors = F.array(
        F.when(strip(q) == "", "no question"), F.when(strip(a) == "", "no answer"), F.when(F.col("competency").isNull(), "no competency"),
        F.when(F.length(q) < 10, "short question"), F.when(F.length(a) < 10, "short answer"), F.when((d < 1) | (d > 5), "difficulty"),
    )
    return drafts.select("example_id", F.explode(F.array_compact(errors)).alias("error"))


def draft_context(context: Column, pattern: Column, equipment: Column, procedure: Column, difficulty: Column, tags: Column) -> Column:
    """What is known of a draft, as one text; the middle difficulty goes unsaid."""
    said = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws(
        " | ", F.nullif(context, F.lit("")), said("reasoning_pattern", pattern), said("equipment", equipment), said("procedure_ref", procedure),
        F.when(difficulty != 3, F.concat(F.lit("difficulty: "), difficulty)), said("tags", F.array_join(tags, ", ")),
    )


def apply_changes(log: DataFrame, fields: list[str], kept: list[str] | None = None, key: str = "id") -> DataFrame:
    """The present rows of a log (id, seq, op, fields): what came after a row's last
    deletion, each field by its last value that is not null, fields of ``kept`` by
    their first.  Aggregates only, so a busy row is no hot spot."""
    kept = kept or []
    gone = log.where("op = 'delete'").groupBy(key).agg(F.max("seq").alias("__gone"))
    rows = log.where("op <> 'delete'").join(gone, key, "left").where(F.col("__gone").isNull() | (F.col("seq") > F.col("__gone")))
    value = lambda c: F.when(F.col(c).isNotNull(), F.struct("seq", c))
    return rows.groupBy(key).agg(*[(F.min if c in kept else F.max)(value(c))[c].alias(c) for c in fields], F.max("seq").alias("seq"))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no row."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


#: The curriculum's tables: key, columns that must be filled, and references as (column,
#: table that it names, what a removal there does here).
CURRICULUM = {
    "contributors": (("id",), ("name",), ()),
    "disciplines": (("id",), ("name", "description", "created_by"), (("created_by", "contributors", "keep"),)),
    "competencies": (("id",), ("name", "description", "discipline_id"), (("discipline_id", "disciplines", "cascade"), ("parent_id", "competencies", "set null"))),
    "examples": (
        ("id",), ("question", "ideal_answer", "competency_id", "contributor_id", "discipline_id", "review_status"),
        (("competency_id", "competencies", "cascade"), ("contributor_id", "contributors", "keep"), ("discipline_id", "disciplines", "cascade")),
    ),
    "discipline_contributors": (("discipline_id", "contributor_id"), ("role",), (("discipline_id", "disciplines", "cascade"), ("contributor_id", "contributors", "cascade"))),
    "curriculum_versions": (("id",), ("discipline_id", "version_number", "created_by"), (("discipline_id", "disciplines", "cascade"), ("created_by", "contributors", "keep"))),
    "discovery_sessions": (("id",), ("discipline_name", "contributor_id"), (("contributor_id", "contributors", "keep"),)),
}


def audit(tables: dict[str, DataFrame], schema: dict = CURRICULUM) -> DataFrame:
    """(audit, subject, n): references without rows, repeated keys and missing values of
    tables; one row for each thing that can be wrong."""
    parts = []
    for name, (key, filled, references) in schema.items():
        rows = tables[name]
        parts += [("orphans", f"{name}.{c}", orphans(rows, c, tables[to], "id")) for c, to, _ in references]
        parts.append(("repeated", f"{name}.{'+'.join(key)}", rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")))
        parts += [("missing", f"{name}.{c}", rows.where(F.col(c).isNull())) for c in filled]
    made = [rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("audit"), F.lit(subject).alias("subject"), "n") for kind, subject, rows in parts]
    return reduce(DataFrame.unionByName, made)


def removal(tables: dict[str, DataFrame], name: str, gone: DataFrame, schema: dict = CURRICULUM) -> DataFrame:
    """(table, effect, n): the rows that the removal of ``gone`` rows of a table takes
    along, at any distance, those whose reference is emptied, and those that forbid it.

    The tables are taken in the order of their references, each once."""
    removed = {name: gone.select("id").distinct()}
    counts = [(name, "removed", gone)]
    for child, (key, _, references) in schema.items():
        met, rows = [(c, removed[to], effect) for c, to, effect in references if to in removed], tables[child]
        hit = lambda c, ids: rows.join(ids.select(F.col("id").alias(c)).distinct(), c, "left_semi").select(*rows.columns)  # noqa: B023, E731
        taken = [hit(c, ids) for c, ids, effect in met if effect == "cascade"]
        if taken and child != name:
            whole = reduce(DataFrame.unionByName, taken).dropDuplicates(list(key))
            counts.append((child, "removed", whole))
            if "id" in rows.columns:
                removed[child] = whole.select("id").distinct()
            # References within the table itself, of rows that stay.
            met += [(c, removed[child], effect) for c, to, effect in references if to == child]
        rest = rows.join(removed[child], "id", "left_anti") if child in removed else rows
        for c, ids, effect in met:
            if effect != "cascade":
                left = rest.join(ids.select(F.col("id").alias(c)).distinct(), c, "left_semi")
                counts.append((f"{child}.{c}", "emptied" if effect == "set null" else "forbidden", left))
    made = [rows.agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), F.lit(effect).alias("effect"), "n") for t, effect, rows in counts]
    return reduce(DataFrame.unionByName, made)


def scaffold(chunks: DataFrame, source: str = "corpus") -> DataFrame:
    """Question and answer candidates from chunks of 50 to 2000 tokens, with where
    they come from."""
    path = F.col("hierarchy_path")
    title = F.when(path != "", F.element_at(F.split("hierarchy_path", " > "), -1))
    first = strip(F.get(F.split("content", r"\."), 0))
    cut = F.substring(first, 1, 80)
    topic = F.lower(F.when(F.length(first) <= 80, first).when(F.instr(cut, " ") > 0, F.expr("substring({0}, 1, cast(length({0}) - instr(reverse({0}), ' ') as int))".format("__cut"))).otherwise(cut))
    rows = chunks.withColumn("__cut", cut)
    question = F.when(title.isNotNull(), F.concat(F.lit("What does the section '"), title, F.lit("' say?"))).otherwise(F.concat(F.lit("What is known of "), topic, F.lit("?")))
    rows = rows.withColumns({"question": question, "__e": strip(F.substring("content", 1, 500))})
    stop = F.when(F.instr("__e", ".") > 0, F.length("__e") - F.instr(F.reverse("__e"), ".")).otherwise(-1)
    answer = F.when(stop > 50, F.substring("__e", F.lit(1), (stop + 1).cast("int"))).otherwise(F.col("__e"))
    pages = F.concat_ws("-", "start_page", "end_page")
    provenance = F.concat_ws(
        " | ", F.concat(F.lit(f"Source: {source}/"), "doc_id"), F.when(pages != "", F.concat(F.lit("Page: "), pages)), F.when(path != "", F.concat(F.lit("Section: "), path)), F.concat(F.lit("Chunk: "), "chunk_id")
    )
    confidence = 0.25 + F.when(path != "", 0.5).otherwise(0.0) + F.when(F.col("start_page").isNotNull(), 0.25).otherwise(0.0)
    return rows.where(F.col("token_count").between(50, 2000)).select("chunk_id", "question", answer.alias("answer"), provenance.alias("provenance"), confidence.alias("confidence"))


def new_version(examples: DataFrame, versions: DataFrame) -> DataFrame:
    """The snapshot of each discipline's training examples under its next
    number, one above the largest of ``versions`` (discipline, version).

    Rows, to be written partitioned by discipline and version; a snapshot is
    never one value."""
    last = versions.groupBy("discipline").agg(F.max("version").alias("__last"))
    rows = examples.where("NOT is_test_set").join(last, "discipline", "left")
    return rows.withColumn("version", F.coalesce("__last", F.lit(0)) + 1).drop("__last")


def version_history(snapshots: DataFrame) -> DataFrame:
    """Versions of snapshot rows (discipline, version, status) with counts, the
    newest first, and the latest published one marked."""
    rows = snapshots.groupBy("discipline", "version", "status").agg(F.count("*").alias("example_count"))
    newest = Window.partitionBy("discipline").orderBy(F.desc("version"))
    published = F.max(F.when(F.col("status") == "published", F.col("version"))).over(Window.partitionBy("discipline"))
    return rows.select("*", F.row_number().over(newest).cast("bigint").alias("place"), F.coalesce(F.col("version") == published, F.lit(False)).alias("is_latest"))


def discovery_progress(responses: DataFrame, catalog: DataFrame) -> DataFrame:
    """Progress of each session.

    ``responses`` has session, discipline and ``answered`` (ids); ``catalog``
    question, phase and required, by discipline.  A phase is complete when all its
    required questions are answered; a missing one is two minutes."""
    needed = catalog.where("required").groupBy("discipline").agg(F.array_sort(F.collect_set(F.struct("question", "phase"))).alias("needed"))
    rows = responses.join(needed, "discipline", "left").withColumn("needed", F.coalesce("needed", F.expr("cast(array() as array<struct<question:bigint,phase:bigint>>)")))
    rows = rows.withColumn("open", F.filter("needed", lambda x: ~F.array_contains("answered", x["question"])))
    phases = lambda c: F.array_distinct(F.transform(c, lambda x: x["phase"]))
    n, missing = F.size("needed"), F.size("open")
    return rows.select(
        "session", (n - missing).cast("bigint").alias("answered_required"), n.cast("bigint").alias("required"),
        F.round(F.when(n > 0, (n - missing) / n).otherwise(0.0), 6).alias("completion"),
        F.array_join(F.transform("open", lambda x: x["question"].cast("string")), ",").alias("unanswered_required"),
        F.array_join(F.array_except(phases("needed"), phases("open")).cast("array<string>"), ",").alias("phases_complete"), (2 * missing).cast("bigint").alias("minutes_remaining"),
    )


def seed_competencies(lists: DataFrame, target: int = 25) -> DataFrame:
    """One competency for each of a session's ``items``, in order; those that the
    ``safety`` items name, blanks and case apart, are marked."""
    rows = lists.select("session", "items", F.transform("safety", lambda x: strip(F.lower(x))).alias("s")).select("session", "s", F.posexplode("items").alias("place", "name"))
    critical = F.coalesce(F.array_contains("s", strip(F.lower("name"))), F.lit(False))
    description = F.when(critical, F.concat(F.lit("SAFETY CRITICAL: "), "name")).otherwise(F.col("name"))
    return rows.select("session", F.col("place").cast("bigint").alias("place"), "name", description.alias("description"), F.lit(target).cast("bigint").alias("coverage_target"))
