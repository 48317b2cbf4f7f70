"""Tables that the engine's plans read, and those derived from them.

Each derived table has a DataFrame form and, in ``sedge.plans.sql``, a SQL form
by the same rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import all_upper, starts_upper, strip, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_to_blocks(docs: DataFrame, separator: str = "\n", per_page: int = 8) -> DataFrame:
    """Blocks of plain texts: short one-line blocks without an ending sign are
    headings, of level 1 if all in capitals, of 2 if they begin with one."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", separator)).alias("pos", "raw"))
    rows = rows.select("doc_id", "pos", strip(F.col("raw")).alias("content")).where("content <> ''")
    c = F.col("content")
    short = (F.length(c) < 80) & ~c.contains("\n") & ~c.rlike(r"[.,;:!?]$")
    level = F.when(short & all_upper(c), 1).when(short & starts_upper(c), 2)
    return rows.select(
        "doc_id",
        "pos",
        F.concat_ws(":", "doc_id", "pos").alias("block_id"),
        F.when(level.isNotNull(), "heading").otherwise("text").alias("type"),
        "content",
        level.alias("heading_level"),
        (F.floor(F.col("pos") / per_page) + 1).cast("int").alias("page"),
    )


def blocks(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Blocks of the documents, or of ``docs`` alone, as in the tables made of them."""
    return text_to_blocks(table(spark, sf_dir, "documents") if docs is None else docs)


def outline_blocks(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Blocks with an outline put on them: every fifth is a heading; tables get a
    rule, half of them without a header."""
    pos = F.col("pos")
    kind = F.when(pos % 5 == 0, "heading").when(pos % 11 == 7, "table").when(pos % 13 == 9, "code").otherwise("text")
    level = F.when(pos % 5 == 0, (1 + (F.floor(pos / 5) + F.col("doc_id")) % 3).cast("int"))
    rows = blocks(spark, sf_dir, docs).withColumns({"type": kind, "heading_level": level})
    table = F.when(pos % 2 == 0, F.concat("content", F.lit("\n|---|"))).otherwise(F.concat(F.lit("| a |\n|---|\n"), "content"))
    content = F.when(pos % 5 == 0, strip(F.substring("content", 1, 40))).when(F.col("type") == "table", table).otherwise(F.col("content"))
    return rows.withColumn("content", content).withColumn("tokens", tokens(F.col("content")))


def decorated_blocks(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Blocks with what the filters and cleaners look for put into them."""
    k, c = F.col("pos") % 12, F.col("content")
    content = (
        F.when(k == 0, F.concat(F.substring(c, 1, 30), F.lit(" ..... "), F.col("page")))
        .when(k == 1, F.concat(F.lit("Page "), F.col("page"), F.lit(" of 9")))
        .when(k == 2, F.concat(F.lit("Distribution Statement A: "), c))
        .when(k == 3, F.concat(c, F.lit(" (continued)")))
        .when(k == 4, F.concat(F.lit("-----\n"), c))
        .when(k == 5, F.concat(F.lit("“"), c, F.lit("” — it’s…")))
        .when(k == 6, F.concat(c, F.lit(" wo-\nrd")))
        .when(k == 7, F.concat(F.lit("  "), F.replace(c, F.lit(" "), F.lit("  ")), F.lit("\n\n\n\nend")))
        .when(k == 8, F.lit("For Official Use Only"))
        .when(k == 9, F.lit("The same running title"))
        .otherwise(c)
    )
    kind = F.when(k == 10, "header").when(k == 11, "footer").otherwise(F.col("type"))
    y1 = (4 + 60 * k).cast("double")
    return blocks(spark, sf_dir, docs).select(
        "doc_id", "pos", "block_id", "page", kind.alias("type"), content.alias("content"),
        F.struct(F.lit(72.0).alias("x1"), y1.alias("y1"), F.lit(540.0).alias("x2"), (y1 + 50).alias("y2")).alias("bbox"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each section of the outlined blocks."""
    from ..operators.sections import section_chunks

    return section_chunks(outline_blocks(spark, sf_dir))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer pairs: each user turn and the assistant's next."""
    turns = table(spark, sf_dir, "conversations")
    users = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    status = F.element_at(F.array(*map(F.lit, ("approved", "pending", "rejected", "approved"))), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    return users.join(answers, ["conv_id", "turn"]).select(
        F.concat_ws(":", "conv_id", "turn").alias("example_id"), "conv_id", "turn", "question", "answer",
        (F.col("conv_id") % 7).alias("competency"), (F.col("conv_id") % 7 % 2).alias("discipline"), (F.col("conv_id") % 5).alias("contributor"),
        status.alias("review_status"), (F.col("turn") % 6 == 0).alias("is_test_set"),
    )


def competencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The competencies that the examples name, with targets and parents; each is
    described by the beginning of a document."""
    ids = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 7).alias("competency")).distinct()
    said = table(spark, sf_dir, "documents").where("doc_id < 7").select(F.col("doc_id").alias("competency"), F.substring("text", 1, 200).alias("description"))
    c = F.col("competency")
    return ids.join(said, "competency", "left").select(
        "competency", (c % 2).alias("discipline"), F.concat(F.lit("competency "), c).alias("name"), F.coalesce("description", F.lit("")).alias("description"),
        (10 + 5 * c).alias("target"), F.when(c >= 3, F.floor(c / 3).cast("bigint")).alias("parent"),
    )


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who contributes to a discipline, with roles and areas (none: all); one member
    of each discipline is idle."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 5).alias("contributor"), (F.col("conv_id") % 7 % 2).alias("discipline")).distinct()
    idle = rows.select(F.lit(90).cast("bigint").alias("contributor"), "discipline").distinct()
    c, none = F.col("contributor"), F.array().cast("array<bigint>")
    return rows.union(idle).select(
        "contributor", "discipline", F.element_at(F.array(*map(F.lit, ("lead", "member", "admin"))), (c % 3 + 1).cast("int")).alias("role"),
        F.when(c % 2 == 0, none).otherwise(F.array(*map(F.lit, (1, 3, 5))).cast("array<bigint>")).alias("areas"),
    )


def eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of answers, cut after a share of their words by run."""
    rows = examples(spark, sf_dir).select("example_id", "conv_id", "competency", "discipline", F.col("answer").alias("expected"))
    runs = rows.crossJoin(spark.range(1, 3).select(F.col("id").alias("run")))
    w = F.split("expected", " ")
    keep = F.floor(F.size(w) * ((F.col("conv_id") + F.col("run") - 1) % 5 + 1) / 5).cast("int")
    response = F.when(F.col("conv_id") % 17 == 0, "").otherwise(F.array_join(F.slice(w, F.lit(1), keep), " "))
    return runs.select("run", "example_id", "competency", "discipline", "expected", response.alias("response"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training curves: a run for each user of the events, a point an event."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    loss = F.col("value") / 100
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), (F.row_number().over(order) - 1).alias("idx"), loss.alias("train_loss"),
        F.when(F.col("event_id") % 2 == 0, loss * 1.2).alias("val_loss"), F.col("value").alias("gradient_norm"),
    )


def signals(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Feedback signals made of the events."""
    from .readers import stream_of

    events = stream_of(spark, f"{sf_dir}/events.parquet") if stream else table(spark, sf_dir, "events")
    e, i = F.col("event_type"), F.col("event_id")
    kind = (
        F.when(e == "purchase", "accepted").when(e == "click", "citation_clicked").when(e == "view", "no_result")
        .when(e == "error", F.when(i % 3 > 0, "rejected").otherwise("flagged_error")).otherwise(F.when(i % 2 == 0, "follow_up").otherwise("rephrased"))
    )
    discipline = F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("d"), F.col("user_id") % 3))
    return events.select(
        i.alias("signal_id"), kind.alias("signal_type"), F.col("user_id").alias("conversation_id"), F.concat(F.lit("q"), i % 40).alias("query"),
        discipline.alias("discipline_id"), F.col("ts").cast("timestamp").alias("ts") if stream else F.col("ts"), ((i % 10) / 10).alias("citation_score"),
    )
