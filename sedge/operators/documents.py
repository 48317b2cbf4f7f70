"""Markup to blocks, export records, and features of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.shared import small, stored


def markdown_lines(docs: DataFrame) -> DataFrame:
    """Lines of markdown with their kind: inside a fence or by first signs."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    w = Window.partitionBy("doc_id").orderBy("line")
    fence = F.col("raw").rlike(r"^\s*```")
    rows = rows.withColumn("fences", F.sum(F.when(fence, 1).otherwise(0)).over(w))
    inside = (F.col("fences") % 2 == 1) | fence
    kind = (
        F.when(inside, "code").when(strip(F.col("raw")) == "", "blank").when(F.col("raw").rlike(r"^#{1,6}\s"), "heading")
        .when(F.col("raw").rlike(r"^\s*\|"), "table").when(F.col("raw").rlike(r"^\s*([-*+]|\d+[.)])\s"), "list").when(F.col("raw").rlike(r"^>"), "quote").otherwise("text")
    )
    return rows.withColumn("kind", kind)


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of markdown: runs of lines of a kind, each heading for itself; lists
    numbered anew or with dashes, tables with one form of rows, quotes marked."""
    rows = markdown_lines(docs)
    w = Window.partitionBy("doc_id").orderBy("line")
    opens_fence = F.col("raw").rlike(r"^\s*```") & (F.col("fences") % 2 == 1)
    new = (F.col("kind") != F.coalesce(F.lag("kind").over(w), F.lit(""))) | (F.col("kind") == "heading") | opens_fence
    rows = rows.withColumn("block", F.sum(F.when(new, 1).otherwise(0)).over(w)).where("kind <> 'blank'")
    parts = F.array_sort(F.collect_list(F.struct("line", "raw")))
    made = rows.groupBy("doc_id", "block", "kind").agg(parts.alias("p"), F.min("line").alias("line"))
    lines = F.transform("p", lambda x: x["raw"])
    kind = F.col("kind")
    ordered = (kind == "list") & F.get(lines, 0).rlike(r"^\s*\d")
    items = F.transform(lines, lambda x: F.regexp_replace(x, r"^\s*([-*+]|\d+[.)])\s+", ""))
    listed = F.array_join(F.transform(items, lambda x, i: F.concat(F.when(ordered, F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("- "), x)), "\n")
    quoted = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("> "), F.regexp_replace(x, r"^>\s*", ""))), "\n")
    cells = F.transform(lines, table_cells)
    body = F.filter(cells, lambda r: ~F.forall(r, lambda c: c.rlike(r"^:?-+:?$")))
    row = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(body, 0), lambda c: F.lit("---")), " | "), F.lit(" |"))
    table = F.array_join(F.flatten(F.transform(body, lambda r, i: F.when(i == 0, F.array(row(r), rule)).otherwise(F.array(row(r))))), "\n")
    text = F.array_join(lines, "\n")
    content = F.when(kind == "heading", F.regexp_replace(text, r"^#{1,6}\s+", "")).when(kind == "list", listed).when(kind == "quote", quoted).when(kind == "table", table).otherwise(text)
    level = F.when(kind == "heading", F.length(F.regexp_extract(text, r"^(#{1,6})", 1)))
    count = F.when(kind == "list", F.size("p")).when(kind == "table", F.size(body))
    return made.select("doc_id", "line", kind.alias("type"), content.alias("content"), level.alias("heading_level"), F.size("p").alias("lines"), F.when(kind == "list", ordered).alias("ordered"), count.alias("item_count"))


def table_cells(line: Column) -> Column:
    """The trimmed cells of a table's line."""
    return F.transform(F.split(F.regexp_replace(strip(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))


def front_matter(docs: DataFrame) -> DataFrame:
    """Values of a leading block of ``key: value`` lines, one row each."""
    body = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---", 1)
    lines = F.filter(F.split(body, "\n"), lambda x: x.contains(":"))
    pair = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    return docs.select("doc_id", F.explode(pair).alias("p")).select("doc_id", "p.key", "p.value")


#: Character references that blocks decode, the ampersand's last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
KINDS = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "p": "text", "li": "list_item", "pre": "code", "table": "table"}


def html_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of pages: cut at opening tags, as closing ones may be missing.  A table is
    one block, its rows lines, its cells behind bars."""
    clean = F.regexp_replace("html", r"(?s)<(script|style|nav|head|footer)\b.*?</\1>|<!--.*?-->", " ")
    found = F.regexp_extract_all(clean, F.lit(r"(?s)<(h[1-6]|p|li|pre|table)\b[^>]*>((?:(?!<(?:h[1-6]|p|li|pre|table)\b).)*+)"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^<([a-zA-Z0-9]+)", 1))
    cells = F.regexp_replace(F.regexp_replace("raw", r"<tr\b[^>]*>", "\x01"), r"<t[dh]\b[^>]*>", " | ")
    bare = F.regexp_replace(F.regexp_replace(cells, r"<[^>]*>", ""), r"\s+", " ")
    text = strip(F.regexp_replace(bare, " ?\x01 ?", "\n"))
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    kind = F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])[tag]
    level = F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int"))
    return rows.select("page_id", "pos", kind.alias("type"), text.alias("content"), level.alias("heading_level")).where("content <> ''")


# -------------------------------------------------------------------- exports

SCHEMA_VERSION = "1.1"


def export_record(chunks: DataFrame) -> DataFrame:
    """The record of a scored chunk: pages, quality, source, what enrichment found
    (``fields``), what users gave (``tags``, ``hierarchy_hint``, ``notes`` and
    ``custom``, whose keys get a prefix) and what the system knows."""
    present = lambda m: F.map_filter(m, lambda k, v: F.coalesce(v, F.lit("")) != "")
    none = F.create_map().cast("map<string,string>")
    custom = F.transform_keys(F.coalesce("custom", none), lambda k, v: F.concat(F.lit("custom_"), k))
    user = F.map_concat(present(F.create_map(F.lit("hierarchy_hint"), "hierarchy_hint", F.lit("notes"), "notes")), custom)
    system = present(F.create_map(F.lit("block_count"), F.col("block_count").cast("string"), F.lit("last_type"), F.col("last_type")))
    return chunks.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("chunk_id").alias("id"), "content", "token_count", "hierarchy_path", F.col("overall").alias("quality_score"), "source", "source_type",
        F.col("doc_id").cast("string").alias("document_id"), F.col("start_page").alias("page_start"), F.col("end_page").alias("page_end"), F.coalesce("fields", none).alias("enrichment_fields"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), user.alias("user_metadata"), system.alias("system_metadata"),
    )


def _flat(r: DataFrame, columns: list[str], tags: bool) -> Column:
    """A map of texts: the columns that are not null, enrichment with a prefix, and
    the tags as one text."""
    own = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])
    found = F.transform_keys("enrichment_fields", lambda k, v: F.concat(F.lit("enrichment_"), k))
    more = F.when(F.size("tags") > 0, F.create_map(F.lit("tags"), F.array_join("tags", "; "))).otherwise(F.create_map().cast("map<string,string>"))
    whole = F.map_concat(own, found, more) if tags else F.map_concat(own, found)
    return F.map_filter(whole, lambda k, v: v.isNotNull())


ABOUT = ["source", "source_type", "document_id", "hierarchy_path", "quality_score", "token_count"]


def to_chromadb(r: DataFrame) -> DataFrame:
    """Flat metadata; pages that are null are left out, lists are texts."""
    return r.select("id", F.col("content").alias("document"), F.to_json(_flat(r, [*ABOUT, "page_start", "page_end"], True)).alias("metadata"))


def to_qdrant(r: DataFrame) -> DataFrame:
    """A nested payload that keeps nulls."""
    payload = F.struct("content", *ABOUT, "page_start", "page_end", F.col("enrichment_fields").alias("enrichment"), "user_metadata", "tags")
    return r.select("id", F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))


def to_weaviate(r: DataFrame, cls: str = "Chunk") -> DataFrame:
    """Properties named in camel case."""
    camel = {
        "content": "content", "id": "chunkId", "source": "source", "source_type": "sourceType", "document_id": "documentId", "hierarchy_path": "hierarchyPath", "quality_score": "qualityScore",
        "token_count": "tokenCount", "page_start": "pageStart", "page_end": "pageEnd",
    }
    own = F.create_map(*[x for c, n in camel.items() for x in (F.lit(n), F.col(c).cast("string"))])
    found = F.transform_keys("enrichment_fields", lambda k, v: F.concat(F.lit("enrichment_"), k))
    return r.select("id", F.lit(cls).alias("class"), F.to_json(F.map_concat(own, found), {"ignoreNullFields": "false"}).alias("properties"))


def to_pinecone(r: DataFrame) -> DataFrame:
    """Content inside the metadata; tags stay a list, kept beside the flat values."""
    flat = _flat(r, ["content", *ABOUT, "page_start", "page_end"], False)
    return r.select("id", F.to_json(flat).alias("metadata"), F.to_json(F.col("tags")).alias("tags"))


def jsonl_record(r: DataFrame) -> DataFrame:
    """One object for each chunk: id, text and metadata."""
    flat = F.map_concat(
        F.map_filter(
            F.create_map(*[x for n, c in (("source", "source"), ("source_type", "source_type"), ("page", "page_start"), ("page_end", "page_end"), ("hierarchy_path", "hierarchy_path"), ("quality_score", "quality_score"), ("token_count", "token_count")) for x in (F.lit(n), F.col(c).cast("string"))]),
            lambda k, v: v.isNotNull(),
        ),
        F.col("user_metadata"),
        F.when(F.size("tags") > 0, F.create_map(F.lit("tags"), F.array_join("tags", "; "))).otherwise(F.create_map().cast("map<string,string>")),
    )
    return r.select("id", F.col("content").alias("text"), flat.alias("metadata"))


def csv_rows(r: DataFrame) -> DataFrame:
    """The ten columns of a table of chunks."""
    score = F.floor(F.round(F.col("quality_score") * 1e6) / 1e3 + 0.5) / 1e3
    return r.select(
        F.col("id").alias("chunk_id"), F.col("source").alias("document"), "content", "token_count", score.alias("quality_score"), "page_start", "page_end", "hierarchy_path",
        F.array_join("tags", "; ").alias("tags"), F.coalesce(F.col("user_metadata")["notes"], F.lit("")).alias("notes"),
    )


def nested_documents(r: DataFrame, chunker: str = "sections") -> DataFrame:
    """One object for each document: how it was made, and its chunks in order."""
    place = lambda x: F.struct(x["page_start"], x["id"])
    before = lambda x, y: F.when(place(x) < place(y), -1).when(place(x) > place(y), 1).otherwise(0)
    fields = ("page_start", "id", "content", "token_count", "quality_score", "hierarchy_path", "page_end", "tags", "user_metadata", "system_metadata")
    items = F.array_sort(F.collect_list(F.struct(*fields)), before)
    made = r.groupBy("document_id", "source", "source_type").agg(items.alias("chunks"))
    processing = F.struct(F.lit("tables").alias("loader"), F.lit(chunker).alias("chunker"))
    return made.select(F.lit(SCHEMA_VERSION).alias("version"), F.col("document_id").alias("id"), "source", "source_type", processing.alias("processing"), "chunks")


# ------------------------------------------------------------------- features


# White space and ASCII punctuation as patterns.
BLANKS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def char_features(docs: DataFrame) -> DataFrame:
    """Counts of kinds of characters, and their shares; what is of none is special."""
    n = F.length("text")
    # Whole runs are taken out: a step a run, not a step a character.
    count = lambda p: n - F.length(F.regexp_replace("text", f"{p}++", ""))
    rows = docs.select(
        "doc_id", n.alias("n"), count(r"\p{L}").alias("letters"), count(r"\p{Nd}").alias("digits"), count(BLANKS).alias("blanks"), count(PUNCTUATION).alias("punctuation"), count(r"\p{Lu}").alias("upper")
    )
    special = F.col("n") - F.col("letters") - F.col("digits") - F.col("blanks") - F.col("punctuation")
    rows = rows.withColumn("special", F.greatest(special, F.lit(0)))
    share = lambda c: F.when(F.col("n") > 0, F.round(F.col(c) / F.col("n"), 6)).otherwise(0.0).alias(f"{c}_share")
    upper = F.when(F.col("letters") > 0, F.round(F.col("upper") / F.col("letters"), 6)).otherwise(0.0)
    return rows.select("*", *map(share, ("letters", "digits", "punctuation", "blanks", "special")), upper.alias("upper_share"))


def repetition_features(boxes: DataFrame, edge: float = 0.08) -> DataFrame:
    """What repeats over a document's pages (doc_id, page, page_height, pos,
    content, y1, y2).

    The top text of a page begins in its upper ``edge``, the bottom text ends in
    its lower one; the first line is the first below the upper edge.  Texts are
    headers or footers where one of them is on half of the pages that have any;
    page numbers where half of the bottoms' first numbers follow the one before.
    The ratio counts the k-th top if it repeats or the k-th bottom if it is a
    number.  A document of one page has no repetition and diversity 1."""
    h, order = F.col("page_height"), F.struct("y1", "pos")
    text = strip(F.col("content"))
    top, low, body = F.col("y1") < edge * h, F.col("y2") > (1 - edge) * h, F.col("y1") >= edge * h
    pick = lambda f, c: f(F.when(c, text), F.when(c, order))
    pages = boxes.groupBy("doc_id", "page").agg(pick(F.min_by, top).alias("top"), pick(F.max_by, low).alias("bottom"), pick(F.min_by, body).alias("first"))
    number = F.expr("try_cast(nullif(regexp_extract(bottom, '[0-9]+', 0), '') as decimal(38,0))")
    pages = pages.withColumns({"number": number, "same_top": F.count("*").over(Window.partitionBy("doc_id", "top")), "same_bottom": F.count("*").over(Window.partitionBy("doc_id", "bottom"))})
    before = F.last("number", True).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    pages = pages.withColumn("follows", F.col("number") == before + 1)
    listed = lambda c, v: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("page", v.alias("v"))))), lambda x: x["v"])
    half = lambda c, n: F.coalesce((F.count(c) >= 2) & (F.max(F.when(F.col(c).isNotNull(), F.col(n))) >= 0.5 * F.count(c)), F.lit(False))
    out = pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"), half("top", "same_top").alias("has_headers"), half("bottom", "same_bottom").alias("has_footers"),
        ((F.count("number") >= 2) & (F.count_if("follows") >= 0.5 * F.count("number"))).alias("has_page_numbers"),
        listed("top", F.col("same_top") > 1).alias("tops"), listed("bottom", F.col("bottom").rlike(r"^[\d\s.-]+$")).alias("lows"),
        F.when(F.count("first") > 0, F.countDistinct("first") / F.count("first")).otherwise(0.0).alias("diversity"),
    )
    hits = F.size(F.filter(F.arrays_zip("tops", "lows"), lambda x: F.coalesce(x["tops"], F.lit(False)) | F.coalesce(x["lows"], F.lit(False))))
    many = F.col("pages") > 1
    return out.select(
        "doc_id", "pages", *[(many & F.col(c)).alias(c) for c in ("has_headers", "has_footers", "has_page_numbers")],
        F.round(F.when(many, hits / F.col("pages")).otherwise(0.0), 6).alias("repetition_ratio"), F.round(F.when(many, F.col("diversity")).otherwise(1.0), 6).alias("first_line_diversity"),
    )


def rhythm_features(blocks: DataFrame) -> DataFrame:
    """Headings, tables, images, lists, codes and links a page, and the outline."""
    pages = F.countDistinct("page")
    per = lambda k: F.round(F.count_if(F.col("type") == k) / pages, 6)
    level = F.when(F.col("type") == "heading", F.col("heading_level"))
    return blocks.groupBy("doc_id").agg(
        pages.alias("pages"), per("heading").alias("headings"), per("table").alias("tables"), per("image").alias("images"), per("list").alias("lists"), per("code").alias("codes"),
        (F.count(level) > 0).alias("has_outline"), F.coalesce(F.max(level), F.lit(0)).cast("bigint").alias("outline_depth"), F.countDistinct(level).alias("heading_sizes"),
        F.sum(F.regexp_count("content", F.lit("https?://"))).alias("links"),
    )


def font_features(spans: DataFrame) -> DataFrame:
    """Sizes and styles of a document's spans (size, font, bold, italic, mono)
    that have a text."""
    n, share = F.count("*"), lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return spans.where(strip(F.col("content")) != "").groupBy("doc_id").agg(
        n.alias("spans"), F.countDistinct("font").alias("font_count"), F.min("size").alias("size_min"), F.max("size").alias("size_max"), F.round(F.avg("size"), 6).alias("size_mean"),
        F.round(F.stddev_pop("size"), 6).alias("size_std"), F.median("size").alias("size_median"), F.countDistinct(F.round("size", 1)).alias("distinct_sizes"),
        share("bold").alias("bold_ratio"), share("italic").alias("italic_ratio"), share("mono").alias("mono_ratio"),
    )


def layout_features(boxes: DataFrame) -> DataFrame:
    """Page sizes, margins, text area and columns of a document's boxes.

    A page has two columns if boxes have their centres left of 30 % and right of
    70 % of its width and at most 20 % between; a document has what most of its
    pages have, the first page's where they are even."""
    w, h = F.col("page_width"), F.col("page_height")
    centre = (F.col("x1") + F.col("x2")) / 2
    left, right = F.count_if(centre < 0.3 * w), F.count_if(centre > 0.7 * w)
    zero = F.lit(0.0)
    pages = boxes.groupBy("doc_id", "page", "page_width", "page_height").agg(
        F.greatest(zero, F.min("x1")).alias("ml"), F.greatest(zero, F.min("y1")).alias("mt"), F.max("x2").alias("x"), F.max("y2").alias("y"),
        F.when((left > 0) & (right > 0) & (F.count("*") - left - right <= 0.2 * F.count("*")), 2).otherwise(1).alias("columns"),
    )
    pages = pages.withColumns({"mr": F.greatest(zero, w - F.col("x")), "mb": F.greatest(zero, h - F.col("y"))})
    tw, th = w - F.col("ml") - F.col("mr"), h - F.col("mt") - F.col("mb")
    area = F.when((w * h > 0) & (tw > 0) & (th > 0), tw * th / (w * h)).otherwise(0.0)
    even = lambda c: F.round(F.when(F.avg(c) > 0, F.greatest(zero, 1 - F.stddev_pop(c) / F.avg(c))).otherwise(1.0), 6)
    two, one = F.count_if(F.col("columns") == 2), F.count_if(F.col("columns") == 1)
    return pages.groupBy("doc_id").agg(
        F.median("page_width").alias("page_width"), F.median("page_height").alias("page_height"), even("page_width").alias("width_consistency"), even("page_height").alias("height_consistency"),
        F.median("ml").alias("margin_left"), F.median("mr").alias("margin_right"), F.median("mt").alias("margin_top"), F.median("mb").alias("margin_bottom"),
        F.round(F.avg(area), 6).alias("text_area_ratio"),
        F.when(two > one, 2).when(two < one, 1).otherwise(F.min_by("columns", "page")).cast("bigint").alias("estimated_columns"),
    )


def sampled_pages(pages: DataFrame, most: int = 50) -> DataFrame:
    """The first three, the last two, and an even spread between: a feature of
    the profile, up to ``most`` pages a document (doc_id, page, n)."""
    n, p = F.col("n"), F.col("page") - 4
    step = F.greatest(F.lit(1), F.floor((n - 5) / (most - 5)))
    spread = (p >= 0) & (p % step == 0) & (p / step < most - 5)
    return pages.where((n <= most) | (F.col("page") <= 3) | (F.col("page") > n - 2) | spread)


def upgrade_candidates(boxes: DataFrame, tables: int = 5, chars: int = 100, first: int = 5, grid: int = 50) -> DataFrame:
    """Documents that need heavier extraction, and why: ``tables`` tables, a page
    among the ``first`` with under ``chars`` characters, or boxes in columns there."""
    early = F.col("page") <= first
    per = boxes.groupBy("doc_id", "page").agg(F.count_if(F.col("type") == "table").alias("t"), F.sum(F.length(strip(F.col("content")))).alias("c"))
    per = per.groupBy("doc_id").agg(F.sum("t").alias("tables"), F.min(F.when(early, F.col("c"))).alias("chars"))
    places = boxes.where(early).groupBy("doc_id").agg(F.countDistinct(F.floor(F.col("x1") / grid + 0.5)).alias("places"))
    reasons = F.array_compact(F.array(F.when(F.col("tables") >= tables, "tables"), F.when(F.col("chars") < chars, "scanned"), F.when(F.col("places") >= 2, "columns")))
    return per.join(places, "doc_id", "left").select("doc_id", F.explode(reasons).alias("reason"))


#: The features of a document, by group, in the order of its vector.
FEATURES = {
    "byte": ("file_size", "pdf_version", "object_count", "stream_count", "has_metadata", "has_xmp_metadata", "page_count", "encrypted", "has_acroform"),
    "font": ("font_count", "size_min", "size_max", "size_mean", "size_std", "size_median", "bold_ratio", "italic_ratio", "mono_ratio", "distinct_sizes"),
    "layout": (
        "page_width", "page_height", "width_consistency", "height_consistency", "margin_left", "margin_right", "margin_top", "margin_bottom", "text_area_ratio", "estimated_columns"
    ),
    "char": ("letters_share", "digits_share", "punctuation_share", "blanks_share", "special_share", "upper_share", "n"),
    "rep": ("has_page_numbers", "has_headers", "has_footers", "repetition_ratio", "first_line_diversity"),
    "rhythm": ("headings", "tables", "images", "lists", "has_outline", "outline_depth", "links", "heading_sizes"),
}
NAMES = tuple(f"{g}_{c}" for g, cs in FEATURES.items() for c in cs)


def byte_features(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """What the table of documents knows of a file: size, blocks, pages, and whether
    it names a source; what only a PDF has is 0."""
    per = blocks.groupBy("doc_id").agg(F.count("*").alias("object_count"), F.max("page").alias("page_count"))
    zero = {c: F.lit(0) for c in ("pdf_version", "stream_count", "has_xmp_metadata", "encrypted", "has_acroform")}
    rows = docs.select("doc_id", F.octet_length("text").alias("file_size"), F.col("source").isNotNull().alias("has_metadata"))
    return rows.join(per, "doc_id", "left").withColumns(zero)


def fingerprints(groups: dict[str, DataFrame], docs: DataFrame) -> DataFrame:
    """(doc_id, features): the vector of each document, by groups of features; what a
    document lacks is 0."""
    out = docs.select("doc_id")
    for g, columns in FEATURES.items():
        named = groups[g].select("doc_id", *[F.col(c).cast("double").alias(f"{g}_{c}") for c in columns])
        out = out.join(named, "doc_id", "left")
    return out.fillna(0.0, list(NAMES)).select("doc_id", F.array(*NAMES).alias("features"))


def fitted(rows: DataFrame, trees: int = 30, depth: int = 5):
    """A forest over all labelled vectors (doc_id, features, label)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    held = rows.select(array_to_vector("features").alias("v"), F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(featuresCol="v", numTrees=trees, maxDepth=depth, seed=42).fit(held)


def predicted(model, rows: DataFrame, least: float = 0.45) -> DataFrame:
    """The most probable class of each vector, or unknown below ``least``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    p = F.col("probabilities")
    top: Column = F.array_max(p)
    out = model.transform(rows.withColumn("v", array_to_vector("features")))
    held = F.col("probability") if isinstance(model, Boosted) else vector_to_array("probability")
    out = out.withColumn("probabilities", held)
    kept = [c for c in ("doc_id", "label", "fold") if c in rows.columns]
    return out.select(*kept, top.alias("confidence"), F.when(top < least, "unknown").otherwise((F.array_position(p, top) - 1).cast("string")).alias("predicted"), "probabilities")


#: Buckets of hashes in which rows are ranked.
FOLD_BUCKETS = 4096


def stratified_folds(rows: DataFrame, folds: int = 5, label: str = "label", id_column: str = "doc_id") -> DataFrame:
    """``rows`` with ``fold``: the rows of a label in the order of their hashes go to the
    folds in turn, so a label's folds differ by one row at most.

    Ranks come from counts by bucket of hashes and from ranks within a bucket, so no
    task sorts a label."""
    h = F.xxhash64(F.col(id_column), F.lit(7))
    rows = rows.withColumns({"__h": h, "__b": F.pmod(h, F.lit(FOLD_BUCKETS))})
    sizes = rows.groupBy(label, "__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col(label).alias("__l"), F.col("__b").alias("__b2"), F.coalesce(before, F.lit(0)).alias("__start"))
    placed = rows.withColumn("__r", F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", id_column)) - 1)
    placed = placed.join(small(starts), F.col(label).eqNullSafe(F.col("__l")) & (F.col("__b") == F.col("__b2")))
    return placed.withColumn("fold", ((F.col("__start") + F.col("__r")) % folds).cast("int")).drop("__h", "__b", "__l", "__b2", "__start", "__r")


class Boosted:
    """Boosted trees for many classes: of each class a model that tells it from the
    rest, fitted side by side."""

    def __init__(self, models: dict):
        self.models = models

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with the vector ``v``) and ``probability``, by class from 0."""
        from pyspark.ml.functions import vector_to_array

        top = max(self.models)
        kept = rows.columns
        for k, model in self.models.items():
            made = model.transform(rows)
            rows = made.select(*rows.columns, vector_to_array("probability")[1].alias(f"__p{k}"))
        raw = [F.col(f"__p{k}") if k in self.models else F.lit(0.0) for k in range(top + 1)]
        total = F.greatest(sum(raw, F.lit(0.0)), F.lit(1e-12))
        return rows.select(*kept, F.array(*[p / total for p in raw]).alias("probability"))

    def save(self, path: str) -> None:
        for k, model in self.models.items():
            model.write().overwrite().save(f"{path}/class={k}")


def boosted(rows: DataFrame, rounds: int = 10, depth: int = 3) -> Boosted:
    """Gradient-boosted trees over all labelled vectors (doc_id, features, label)."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    rows = rows.select(array_to_vector("features").alias("v"), F.col("label").cast("int").alias("label"))
    rows = stored(rows, "fit")
    classes = sorted(r.label for r in rows.select("label").distinct().collect())
    spark = rows.sparkSession

    def fit(k: int):
        own = rows.withColumn("own", (F.col("label") == k).cast("double"))
        return k, GBTClassifier(featuresCol="v", labelCol="own", maxIter=rounds, maxDepth=depth, seed=42).fit(own)

    with ThreadPoolExecutor(4) as pool:
        return Boosted(dict(pool.map(inheritable_thread_target(spark)(fit), classes)))


def load_model(path: str, classes: list[int] | None = None):
    """A stored model: a forest, or with ``classes`` the boosted trees of these."""
    from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel

    if classes is None:
        return RandomForestClassificationModel.load(path)
    return Boosted({k: GBTClassificationModel.load(f"{path}/class={k}") for k in classes})


def cross_validated(rows: DataFrame, folds: int = 5, fit=None) -> DataFrame:
    """(fold, label, predicted, n): the confusion matrix of each fold, predicted by a
    model (a forest, or what ``fit`` makes of rows) of the others.  Folds are
    stratified by label."""
    rows = stored(stratified_folds(rows, folds), "folds")
    out = None
    for k in range(folds):
        model = (fit or fitted)(rows.where(F.col("fold") != k))
        part = predicted(model, rows.where(F.col("fold") == k), 0.0)
        out = part if out is None else out.union(part)
    return out.groupBy("fold", F.col("label").cast("int").alias("label"), F.col("predicted").cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def retrain_report(rows: DataFrame, known: Column, folder: str, folds: int = 3, fit=None) -> DataFrame:
    """(model, label, n, accuracy, gain): the model of the labels that were ``known``
    and that of all labels, on the same folds, neither fitted on the fold that it is
    tried on; and both, fitted on all their rows, stored in the folder."""
    fit = fit or (lambda x: fitted(x, 10))
    rows = stored(stratified_folds(rows.withColumn("known", known), folds), "folds")
    out = None
    for name, own in (("before", rows.where("known")), ("after", rows)):
        fit(own).write().overwrite().save(f"{folder}/{name}")
        for k in range(folds):
            part = predicted(fit(own.where(F.col("fold") != k)), rows.where(F.col("fold") == k), 0.0).withColumn("model", F.lit(name))
            out = part if out is None else out.union(part)
    right = F.count_if(F.col("label").cast("int").cast("string") == F.col("predicted"))
    report = out.groupingSets([[F.col("model"), F.col("label")], [F.col("model")]], F.col("model"), F.col("label")).agg(F.count("*").alias("n"), (right / F.count("*")).alias("accuracy"))
    # Two rows a label.
    old = F.first(F.when(F.col("model") == "before", F.col("accuracy")), ignorenulls=True).over(Window.partitionBy("label"))
    return report.withColumn("gain", F.col("accuracy") - old)


def fold_report(confusion: DataFrame, baseline: float = 0.7) -> DataFrame:
    """Accuracy of each class and in all, over all folds, and whether it is enough."""
    right = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0))
    rows = confusion.groupingSets([[F.col("label")], []], F.col("label")).agg(F.sum("n").alias("n"), (right / F.sum("n")).alias("accuracy"))
    return rows.withColumn("enough", F.col("accuracy") >= baseline)


def unknown_queue(found: DataFrame, top: int = 3) -> DataFrame:
    """Documents of no known class with their most probable ones."""
    ranked = F.slice(F.reverse(F.array_sort(F.transform("probabilities", lambda x, i: F.struct(x.alias("p"), (-i).alias("c"))))), 1, top)
    return found.where("predicted = 'unknown'").select("doc_id", "confidence", F.transform(ranked, lambda x: F.struct((-x["c"]).alias("class"), x["p"].alias("probability"))).alias("top"))


def manual_labels(lines: DataFrame, classes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Labels of a log of JSON lines (doc_id, label), and the lines passed over: not
    JSON, without a class, or of an unknown one."""
    o = F.from_json("value", "doc_id bigint, label string")
    rows = lines.where(F.trim("value") != "").withColumn("o", o)
    good = F.coalesce(F.col("o.doc_id").isNotNull() & F.col("o.label").isin(*classes), F.lit(False))
    reason = F.when(F.col("o.label").isNull(), "corrupt").otherwise("unknown class")
    return rows.where(good).select("o.*"), rows.where(~good).select("value", reason.alias("reason"))


def retrain_plan(synthetic: DataFrame, manual: DataFrame, models: DataFrame, least: int = 5) -> DataFrame:
    """Whether a new model is due: there is none, or ``least`` labels came since
    the last (``models``: trained_at; ``manual``: label, seq), and the classes of
    the joint corpus."""
    last = models.agg(F.max("trained_at")).scalar()
    corpus = synthetic.select("label", F.lit(False).alias("own"), F.lit(None).cast("bigint").alias("seq")).unionByName(manual.select("label", F.lit(True).alias("own"), "seq"))
    corpus = corpus.withColumn("new", F.col("own") & (last.isNull() | (F.col("seq") > last)))
    rows = corpus.groupBy("label").agg(F.count_if(~F.col("own")).alias("synthetic"), F.count_if("own").alias("manual"), F.count_if("new").alias("since"))
    # One row a label from here on.
    total = F.sum("since").over(Window.partitionBy())
    return rows.select("label", "synthetic", "manual", "since", total.alias("new_labels"), ((total >= least) | last.isNull()).alias("due"))
