"""Readers of files: texts, JSON lines, projects and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import small, stored

#: Formats by lower-case extension.
FORMATS = {"pdf": "pdf", "docx": "docx", "md": "markdown", "markdown": "markdown", "mdown": "markdown", "txt": "text", "text": "text"}
MAX_BYTES = 100 * 1024 * 1024


def scan_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files below a folder with their format, and why one is turned down.

    ``content`` is read only where it is used: listing does not load it, and the
    first bytes are looked at in PDF files of ``max_bytes`` or less only.  Empty files
    have no row, as Spark passes them over."""
    read = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = read().load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])[extension]
    magic = F.substring("content", 1, 5) == F.lit(b"%PDF-")
    named = read().option("pathGlobFilter", "*.[pP][dD][fF]").load(path).where(F.col("length") <= max_bytes)
    wrong = small(named.where(~magic).select("path", F.lit(True).alias("__wrong")))
    reason = F.when(kind.isNull(), "unknown extension").when(F.col("length") > max_bytes, "too large").when(F.col("__wrong"), "not a PDF")
    return files.join(wrong, "path", "left").select("path", "length", extension.alias("extension"), kind.alias("format"), reason.alias("rejected"), "content")


def read_texts(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Decoded texts of scanned files: UTF-8, or Latin-1 with a warning.

    A file of ``max_bytes`` or less is one row.  A larger one comes as a row for
    each line, its line end included, so no task holds the whole of it."""
    files = files.where("format = 'text'")
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(good, F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    # The comparison reaches the scan: the content of larger files is not read.
    whole = files.where((F.col("length") <= max_bytes) & (F.col("rejected").isNull() | (F.col("rejected") == "too large")))
    whole = whole.select("path", text.alias("text"), F.when(~good, "decoded as Latin-1").alias("warning"))
    large = [x.path for x in files.where(F.col("length") > max_bytes).select("path").collect()]
    return whole.union(_lines(files.sparkSession, large)) if large else whole


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, text, warning) of each line of text files."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    path = F.regexp_replace("_metadata.file_path", "^file:///", "file:/")
    raw = spark.read.option("lineSep", "\n").text(paths)
    lines = raw.select(path.alias("path"), F.col("_metadata.file_size").alias("bytes"), at.alias("at"), "value")
    files = lines.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("good"), F.max("at").alias("last"),
        # The last line has no end if the file is one byte short.
        (F.sum(F.octet_length("value") + 1) > F.max("bytes")).alias("open_end"),
    )
    end = F.when(F.col("open_end") & (F.col("at") == F.col("last")), "").otherwise("\n")
    text = F.when(F.col("good"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    return lines.join(files, "path").select("path", F.concat(text, end).alias("text"), F.when(~F.col("good"), "decoded as Latin-1").alias("warning"))


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files of a table, old files included."""
    schema = spark.read.parquet(path).schema
    # As a pattern, a path may be a folder or one file.
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/{{{name}}}")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files with their numbers, from 1.

    Lines are written once with their places in their block; a block's first number
    is what the blocks before it hold, a small table."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = stored(spark.read.text(path).select(place.alias("p"), F.monotonically_increasing_id().alias("id"), "value").select("p.*", "id", "value"), "lines")
    blocks = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = small(blocks.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before")))
    return rows.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def validate_jsonl(lines: DataFrame, required: list[str], limit: int = 100_000) -> DataFrame:
    """(file, line, reason): lines that are no JSON object or lack a field, and files
    of more than ``limit`` records (without a line); blank lines are passed over."""
    held = F.from_json("value", "map<string,string>")
    fields = lines.where(F.trim("value") != "").withColumn("o", held)
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col("o")[c]), F.lit("")) == "", F.lit(c)) for c in required]))
    reason = F.when(F.col("o").isNull(), "not an object").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    bad = fields.select("file", "line", reason.alias("reason")).where("reason IS NOT NULL")
    large = fields.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return bad.union(large.select("file", F.lit(None).cast("bigint"), F.lit("too many records")))


def read_jsonl(spark: SparkSession, path: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose required fields are not blank, and the rejected lines."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in required]))
    marked = rows.withColumn("_missing", missing)
    good = marked.where(F.col("_bad").isNull() & (F.size("_missing") == 0)).drop("_bad", "_missing")
    reason = F.when(F.col("_bad").isNotNull(), "not JSON").otherwise(F.concat(F.lit("missing: "), F.array_join("_missing", ", ")))
    return good, marked.where(F.col("_bad").isNotNull() | (F.size("_missing") > 0)).select(F.col("_bad").alias("line"), reason.alias("reason"))


PROJECT = (
    "id string, documents array<struct<id string, source_path string, blocks array<struct<id string, type string, content string, page int>>, "
    "chunks array<struct<id string, block_ids array<string>, content string, token_count bigint>>>>, "
    "test_suites array<struct<id string, name string, queries array<struct<id string, query string, expected_chunk_ids array<string>>>>>"
)


def read_project(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables nested in project files."""
    return project_tables(spark.read.schema(PROJECT).option("multiLine", "true").json(path))


def project_tables(whole: DataFrame) -> dict[str, DataFrame]:
    """The tables nested in rows of projects."""
    docs = whole.select(F.col("id").alias("project_id"), F.explode("documents").alias("d"))
    suites = whole.select(F.col("id").alias("project_id"), F.explode("test_suites").alias("s"))
    return {
        "documents": docs.select("project_id", F.col("d.id").alias("doc_id"), "d.source_path"),
        "blocks": docs.select(F.col("d.id").alias("doc_id"), F.posexplode("d.blocks").alias("pos", "b")).select("doc_id", "pos", "b.*"),
        "chunks": docs.select(F.col("d.id").alias("doc_id"), F.posexplode("d.chunks").alias("chunk_pos", "c")).select("doc_id", "chunk_pos", "c.*"),
        "queries": suites.select(F.col("s.id").alias("suite_id"), F.explode("s.queries").alias("q")).select("suite_id", "q.*"),
    }
