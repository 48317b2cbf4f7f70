"""Section trees of blocks, as windows over the order of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, tokens

#: Heading levels that are told apart; deeper ones count as the last.
LEVELS = 12
# Punctuation that file names do not take, as section ids are made
# of titles; patterns of numbered headings; limits of a section tree.
DECIMAL, LETTERED = r"^(\d+(?:\.\d+)*)", r"^([A-Z](?:\.\d+)+)"
LARGE_SECTION, SMALL_SECTION, DEEP, UNEVEN = 2000, 10, 8, 4
SECTION_DROP = r'[<>:"/\\|?*]'


def _order() -> Window:
    return Window.partitionBy("doc_id").orderBy("pos")


def assign_sections(blocks: DataFrame) -> DataFrame:
    """``section_no``: every heading opens one; 0 comes before the first."""
    opens = F.when(F.col("type") == "heading", 1).otherwise(0)
    return blocks.withColumn("section_no", F.sum(opens).over(_order()))


def with_paths(blocks: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``hierarchy_path``, ``depth`` and ``parent`` of every block, and ``parent_pos``
    of every heading.

    The ancestor at a level is the last heading of that level, if it is later
    than the last heading of each higher level.  Headings deeper than ``levels`` count
    as of that level."""
    heading = F.col("type") == "heading"
    level = F.least("heading_level", F.lit(levels))
    last = [F.last(F.when(heading & (level == k), F.struct("pos", "content")), True).over(_order()) for k in range(1, levels + 1)]
    rows = blocks.withColumns({f"__h{k}": c for k, c in enumerate(last, 1)})
    parts = []
    for k in range(1, levels + 1):
        own = F.col(f"__h{k}")
        higher = [F.coalesce(F.col(f"__h{j}.pos"), F.lit(-1)) for j in range(1, k)]
        alive = own.isNotNull()
        for h in higher:
            alive = alive & (F.col(f"__h{k}.pos") > h)
        parts.append(F.when(alive, F.col(f"__h{k}.content")))
    path = F.array_compact(F.array(*parts))
    above = F.greatest(*[F.when(level > k, F.col(f"__h{k}.pos")) for k in range(1, levels + 1)], F.lit(None).cast("int"))
    rows = rows.withColumn("__path", path)
    return rows.withColumns(
        {
            "parent_pos": F.when(heading, above),
            "hierarchy_path": F.array_join("__path", " > "),
            "depth": F.size("__path").cast("bigint"),
            "parent": F.when(F.size("__path") > 1, F.element_at("__path", -2)),
        }
    ).drop("__path", *[f"__h{k}" for k in range(1, levels + 1)])


def section_table(blocks: DataFrame) -> DataFrame:
    """One row for each section: heading, level, content, its blocks, tokens, pages,
    the section above (null where there is none) and the number of those below."""
    rows = with_paths(assign_sections(blocks))
    body = F.when(F.col("type") != "heading", F.struct("pos", "content", "block_id"))
    parts = F.array_sort(F.collect_list(body))
    title = lambda c: F.max(F.when(F.col("type") == "heading", F.col(c)))
    made = rows.groupBy("doc_id", "section_no").agg(
        title("content").alias("heading"), title("heading_level").alias("level"), title("hierarchy_path").alias("path"),
        title("depth").alias("depth"), F.array_join(F.transform(parts, lambda x: x["content"]), "\n\n").alias("content"),
        F.transform(parts, lambda x: x["block_id"]).alias("block_ids"), F.sum(tokens(F.col("content"))).alias("tokens"), F.count(body).alias("n_content"),
        F.min("page").alias("start_page"), F.max("page").alias("end_page"), title("pos").alias("__pos"), title("parent_pos").alias("__parent"),
    )
    # Both joins keep to the document, as the rows are dealt.
    places = made.select("doc_id", F.col("__pos").alias("__parent"), F.col("section_no").alias("parent_no"))
    below = made.where("__parent IS NOT NULL").groupBy("doc_id", F.col("__parent").alias("__pos")).agg(F.count("*").alias("child_count"))
    out = made.join(places, ["doc_id", "__parent"], "left").join(below, ["doc_id", "__pos"], "left")
    return out.fillna(0, ["child_count"]).drop("__pos", "__parent")


def section_chunks(blocks: DataFrame) -> DataFrame:
    """One chunk for each section, heading first."""
    rows = with_paths(assign_sections(blocks))
    return chunks_of(rows.withColumn("chunk_pos", F.col("section_no")), F.concat_ws("-", "doc_id", "chunk_pos"))


def page_chunks(blocks: DataFrame) -> DataFrame:
    """One chunk for each page, without a path."""
    rows = blocks.withColumns({"chunk_pos": F.col("page").cast("bigint") - 1, "hierarchy_path": F.lit("")})
    return chunks_of(rows, F.concat_ws("-p", "doc_id", F.col("chunk_pos") + 1))


def section_and_page_chunks(blocks: DataFrame) -> DataFrame:
    """(strategy, chunk_id, content): the chunks of ``section_chunks`` and of
    ``page_chunks``.  Blocks are read and dealt once, by document, for both."""
    rows = assign_sections(blocks)
    kinds = (("sections", F.col("section_no")), ("pages", F.col("page").cast("bigint") - 1))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("strategy"), pos.alias("chunk_pos")) for name, pos in kinds]))
    rows = rows.select("doc_id", "pos", "content", each.alias("k")).select("doc_id", "pos", "content", "k.strategy", "k.chunk_pos")
    parts = F.array_sort(F.collect_list(F.struct("pos", "content")))
    made = rows.groupBy("doc_id", "strategy", "chunk_pos").agg(F.array_join(F.transform(parts, lambda x: x["content"]), "\n\n").alias("content"))
    chunk_id = F.when(F.col("strategy") == "sections", F.concat_ws("-", "doc_id", "chunk_pos")).otherwise(F.concat_ws("-p", "doc_id", F.col("chunk_pos") + 1))
    return made.select("strategy", chunk_id.alias("chunk_id"), "content")


def chunks_of(rows: DataFrame, chunk_id: Column) -> DataFrame:
    """The chunks of blocks by (doc_id, chunk_pos), with what their scores need."""
    from .chunks import broken_table

    parts = F.array_sort(F.collect_list(F.struct("pos", "block_id", "content")))
    made = rows.groupBy("doc_id", "chunk_pos").agg(
        parts.alias("parts"), F.min("page").alias("start_page"), F.max("page").alias("end_page"),
        F.coalesce(F.max(F.when(F.col("type") == "heading", F.col("hierarchy_path"))), F.lit("")).alias("hierarchy_path"),
        F.max_by("type", "pos").alias("last_type"), F.bool_or(F.col("type") == "heading").alias("has_heading"),
        F.bool_or(F.col("type").isin("text", "list", "table")).alias("has_content"), F.bool_or(broken_table(F.col("type"), F.col("content"))).alias("has_broken_table"),
    )
    content = F.array_join(F.transform("parts", lambda x: x["content"]), "\n\n")
    return made.select(
        "doc_id", "chunk_pos", chunk_id.alias("chunk_id"), content.alias("content"), tokens(content).alias("token_count"), F.size("parts").cast("bigint").alias("block_count"),
        F.transform("parts", lambda x: x["block_id"]).alias("block_ids"), "hierarchy_path", "start_page", "end_page", "last_type", "has_heading", "has_content", "has_broken_table",
    )


def section_id(title: Column) -> Column:
    """A leading number such as 1.2.3 or A.1, or the first 50 characters."""
    t = F.trim(title)
    number = F.regexp_extract(t, r"^(\d+(?:\.\d+)*)", 1)
    letter = F.regexp_extract(t, r"^([A-Z]\.\d+(?:\.\d+)*)", 1)
    return F.coalesce(F.nullif(number, F.lit("")), F.nullif(letter, F.lit("")), F.trim(F.regexp_replace(F.substring(t, 1, 50), SECTION_DROP, "")))


def heading_confidence(blocks: DataFrame) -> DataFrame:
    """How sure a heading is one: level, bold print (a column ``bold``, where there
    is one), a number in front, and shortness."""
    c = F.col("content")
    points = [(F.col("heading_level").isNotNull(), 0.2), (c.rlike(r"^\d+(\.\d+)*\s"), 0.2), (F.length(c) < 100, 0.1)]
    if "bold" in blocks.columns:
        points.append((F.col("bold"), 0.1))
    score = sum((F.when(met, p).otherwise(0.0) for met, p in points), F.lit(0.5))
    return blocks.where("type = 'heading'").select("doc_id", "pos", F.least(F.lit(1.0), F.round(score, 6)).alias("confidence"))


def tree_stats(sections: DataFrame) -> DataFrame:
    """Counts of a document's section tree, tokens over the sections with content,
    and the sections of each level.  A document without headings is its root."""
    node, content = F.col("section_no") > 0, (F.col("section_no") > 0) & (F.col("n_content") > 0)
    t = F.when(content, F.col("tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = sections.groupBy("doc_id").agg(
        F.count_if(node).alias("nodes"), F.count_if(content).alias("with_content"), F.count_if(node & (F.col("child_count") > 0)).alias("with_children"),
        F.greatest(F.count_if(node & (F.col("child_count") == 0)), F.lit(1)).alias("leaves"), zero(F.max(F.when(node, F.col("depth")))).alias("max_depth"),
        zero(F.min(t)).alias("min_tokens"), zero(F.max(t)).alias("max_tokens"), F.coalesce(F.avg(t), F.lit(0.0)).alias("avg_tokens"),
    )
    levels = sections.where("level IS NOT NULL").groupBy("doc_id", "level").agg(F.count("*").alias("n"))
    levels = levels.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("level", "n")))).alias("levels"))
    return out.join(levels, "doc_id", "left")


def tree_issues(sections: DataFrame) -> DataFrame:
    """(doc_id, section_no, issue, severity): the problems of sections, and of whole
    trees (without a section)."""
    full, leaf = F.col("n_content") > 0, F.col("child_count") == 0
    mark = lambda met, issue, severity: F.when(met, F.struct(F.lit(issue).alias("issue"), F.lit(severity).alias("severity")))
    s = sections.where("section_no > 0")
    large = F.col("tokens") > LARGE_SECTION
    own = F.array_compact(
        F.array(
            mark(~full & leaf, "orphan_heading", "warning"), mark(full & large, "oversized_section", "warning"),
            mark(full & ~large & leaf & (F.col("tokens") < SMALL_SECTION), "undersized_section", "info"),
        )
    )
    d = F.when(leaf, F.col("depth"))
    trees = s.groupBy("doc_id").agg(F.max("depth").alias("deepest"), (F.max(d) - F.min(d)).alias("range"))
    whole = F.array_compact(
        F.array(
            mark(F.col("deepest") > DEEP, "too_deep", "warning"), mark(F.col("deepest") == 1, "too_flat", "info"), mark(F.col("range") > UNEVEN, "imbalanced", "info")
        )
    )
    rows = s.select("doc_id", "section_no", F.explode(own).alias("i")).union(trees.select("doc_id", F.lit(None).cast("bigint"), F.explode(whole)))
    return rows.select("doc_id", "section_no", "i.*")


def tree_quality(stats: DataFrame, issues: DataFrame) -> DataFrame:
    """The score of each tree by its issues, depth and share of content."""
    n = issues.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count("*").alias("issues"))
    rows = stats.join(n, "doc_id", "left").fillna(0, ["errors", "warnings", "issues"])
    ratio = F.col("with_content") / F.col("nodes")
    score = (
        1.0 - 0.2 * F.col("errors") - 0.05 * F.col("warnings") + F.when(F.col("max_depth").between(2, 5), 0.1).when(F.col("max_depth") > 8, -0.1).otherwise(0.0)
        + F.when(F.col("nodes") == 0, 0.0).when(ratio > 0.7, 0.1).when(ratio < 0.3, -0.1).otherwise(0.0)
    )
    return rows.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6))


def tree_recommendations(quality: DataFrame) -> DataFrame:
    """One row for each piece of advice on a tree."""
    ratio = F.when(F.col("nodes") > 0, F.col("with_content") / F.col("nodes")).otherwise(0.0)
    advice = F.array(
        F.when((F.col("max_depth") >= 2) & (F.col("with_content") > 10), "chunk by sections"), F.when(F.col("max_depth") == 1, "flat: chunk by size"),
        F.when(F.col("avg_tokens") > 800, "large sections"), F.when(F.col("avg_tokens") < 100, "small sections"),
        F.when(ratio < 0.5, "headings without content"), F.when(F.col("issues") == 0, "no issues"),
    )
    return quality.select("doc_id", F.explode(F.array_compact(advice)).alias("advice"))


def compare_trees(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences of two trees of each document, the second less the first."""
    other = b.select("doc_id", *[F.col(c).alias(f"__{c}") for c in ("nodes", "max_depth", "avg_tokens")])
    diff = lambda c: F.col(f"__{c}") - F.col(c)
    return a.join(other, "doc_id").select("doc_id", diff("nodes").alias("node_diff"), diff("max_depth").alias("depth_diff"), F.round(diff("avg_tokens"), 6).alias("token_diff"))


def outline_page_ends(toc: DataFrame) -> DataFrame:
    """``page_end``: the page before the next entry of the same level begins."""
    w = Window.partitionBy("doc_id", "level").orderBy("seq")
    return toc.withColumn("page_end", F.greatest(F.col("page"), F.lead("page").over(w) - 1))


def title_key(c: Column) -> Column:
    """A title without case, leading number and repeated blanks."""
    return F.regexp_replace(F.regexp_replace(strip(F.lower(c)), r"^\d+(\.\d+)*\.?\s*", ""), r"\s+", " ")


def blocks_to_outline(toc: DataFrame, blocks: DataFrame) -> DataFrame:
    """The blocks of each outline entry (doc_id, seq, level, title, page).

    An entry without children has the heading on its page that bears its title,
    then the page's other blocks; an entry with children has that heading only."""
    inner = F.coalesce(F.lead("level").over(Window.partitionBy("doc_id").orderBy("seq")) > F.col("level"), F.lit(False))
    entries = toc.select("doc_id", "seq", "page", title_key(F.col("title")).alias("__key"), inner.alias("__inner"))
    rows = entries.join(blocks.select("doc_id", "page", "pos", "block_id", "type", "content"), ["doc_id", "page"])
    entry = Window.partitionBy("doc_id", "seq")
    bears = (F.col("type") == "heading") & (title_key(F.col("content")) == F.col("__key"))
    rows = rows.withColumn("is_heading", F.coalesce(F.col("pos") == F.min(F.when(bears, F.col("pos"))).over(entry), F.lit(False)))
    place = F.row_number().over(entry.orderBy(F.desc("is_heading"), "pos"))
    return rows.where("is_heading OR NOT __inner").select("doc_id", "seq", place.cast("bigint").alias("place"), "block_id", "is_heading")


def repair_orphans(blocks: DataFrame) -> DataFrame:
    """Blocks with their sections, where headings with neither content nor
    children are texts of the section above them (0 where none is above).

    The section above is that of the latest heading of a smaller level; the one
    that takes an orphan has content then, so one pass is enough."""
    order = _order()
    rows = assign_sections(blocks)
    heading, level = F.col("type") == "heading", F.least(F.coalesce("heading_level", F.lit(1)), F.lit(LEVELS))
    after = F.lead(F.struct(heading.alias("h"), level.alias("l"))).over(order)
    orphan = heading & (after.isNull() | (after["h"] & (after["l"] <= level)))
    last = [F.coalesce(F.last(F.when(heading & (level == k), F.col("section_no")), True).over(order), F.lit(0)) for k in range(1, LEVELS + 1)]
    rows = rows.withColumns({"repaired": orphan, **{f"__s{k}": c for k, c in enumerate(last, 1)}})
    above = [F.when(level > k, F.col(f"__s{k}")).otherwise(F.lit(0)) for k in range(1, LEVELS + 1)]
    rows = rows.withColumns({"section_no": F.when(F.col("repaired"), F.greatest(*above)).otherwise(F.col("section_no")), "type": F.when(F.col("repaired"), "text").otherwise(F.col("type"))})
    return rows.drop(*[f"__s{k}" for k in range(1, LEVELS + 1)])


def numbered(sections: DataFrame) -> DataFrame:
    """Sections with the ``number`` in front of their heading, and its kind."""
    t = strip(F.col("heading"))
    decimal, letter = F.nullif(F.regexp_extract(t, DECIMAL, 1), F.lit("")), F.nullif(F.regexp_extract(t, LETTERED, 1), F.lit(""))
    rows = sections.where("section_no > 0").select("doc_id", "section_no", F.coalesce(decimal, letter).alias("number"), decimal.isNotNull().alias("decimal"))
    return rows


def numbering(sections: DataFrame) -> DataFrame:
    """The numbering scheme of a document's headings, and its depth."""
    depth = F.size(F.split("number", r"\."))
    out = numbered(sections).groupBy("doc_id").agg(
        F.count("*").alias("headings"), F.count_if("decimal").alias("decimals"), (F.count("number") - F.count_if("decimal")).alias("letters"),
        F.coalesce(F.max(F.when(F.col("number").isNotNull(), depth)), F.lit(0)).cast("bigint").alias("max_depth"),
    )
    total = F.col("decimals") + F.col("letters")
    scheme = (
        F.when(total == 0, "unnumbered").when(F.col("letters") > F.col("decimals"), "letter_prefix").when(total / F.col("headings") >= 0.5, "decimal").otherwise("mixed")
    )
    return out.withColumn("scheme", scheme)


def numbering_issues(sections: DataFrame) -> DataFrame:
    """(doc_id, section_no, issue): repeated numbers, gaps between the whole numbers
    of top-level headings, and headings without a number where most have one."""
    doc = Window.partitionBy("doc_id")
    rows = numbered(sections)
    top = F.when(~F.col("number").contains("."), F.expr("try_cast(number AS decimal(38,0))"))
    rows = rows.withColumns(
        {
            "repeat": F.row_number().over(Window.partitionBy("doc_id", "number").orderBy("section_no")) > 1,
            "top": top,
            "before": F.last(top, True).over(doc.orderBy("section_no").rowsBetween(Window.unboundedPreceding, -1)),
            "mostly": F.count("number").over(doc) * 2 > F.count("*").over(doc),
        }
    )
    has = F.col("number").isNotNull()
    kinds = F.array(
        F.when(has & F.col("repeat"), "duplicate_number"), F.when(F.col("top") > F.col("before") + 1, "numbering_gap"), F.when(~has & F.col("mostly"), "unnumbered_in_numbered_doc")
    )
    return rows.select("doc_id", "section_no", F.explode(F.array_compact(kinds)).alias("issue"))
