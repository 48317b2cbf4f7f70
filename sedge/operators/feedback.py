"""Feedback signals: routing, patterns and dashboards, batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from ..streaming.runs import read_batches, run_batches, write_once

TYPES = ("accepted", "rejected", "rephrased", "follow_up", "flagged_error", "citation_clicked", "no_result")
FAILURES = ("no_result", "rejected", "flagged_error")


def first_of_each(signals: DataFrame) -> DataFrame:
    """One row for each signal id, the earliest."""
    w = Window.partitionBy("signal_id").orderBy("ts")
    return signals.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def first_of_each_stream(signals: DataFrame) -> DataFrame:
    """One row for each signal id, the first seen.  Ids are kept for the whole
    run, without a watermark: files may come in any order of time."""
    return signals.dropDuplicates(["signal_id"])


def recorded(signals: DataFrame, folder: str | None = None, days: bool = True) -> DataFrame:
    """Record a stream of signals, each id once, in whatever order of time they come.

    No state is kept: the ids of a batch are held against those recorded on the same
    days (a signal that is sent again keeps its time; with ``days`` false, against all),
    which lie in folders by day.  A batch that runs again after a failure replaces what
    it wrote, and does not look at it."""
    spark = signals.sparkSession
    folder = folder or shared_folder(spark, "stream-recorded")
    out = f"{folder}/out"
    day = F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("none"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in signals.schema) + ", day string"

    def record(batch: DataFrame, number: int) -> None:
        rows = first_of_each(batch).withColumn("day", day)
        if number:
            met = [r.day for r in rows.select("day").distinct().collect()]
            old = read_batches(batch.sparkSession, out, schema).where(F.col("batch") < number)
            old = (old.where(F.col("day").isin(met)) if days else old).select(F.col("signal_id").alias("__old"))
            rows = rows.join(old, F.col("signal_id").eqNullSafe(F.col("__old")), "left_anti")
        write_once(rows, out, number, ("day",))

    run_batches(signals, folder, record)
    return read_batches(spark, out, schema).select(*signals.columns)


def filtered(signals: DataFrame, conversation=None, discipline=None, kind=None, start=None, end=None) -> DataFrame:
    """Signals of a conversation, a discipline, a type and a time, each if given."""
    for column, value in (("conversation_id", conversation), ("discipline_id", discipline), ("signal_type", kind)):
        if value is not None:
            signals = signals.where(F.col(column) == value)
    if start is not None:
        signals = signals.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    return signals if end is None else signals.where(F.col("ts") <= F.lit(end).cast("timestamp"))


def target() -> Column:
    t = F.col("signal_type")
    return (
        F.when(t.isin("accepted", "citation_clicked"), "none").when(t.isin("no_result", "rephrased", "follow_up"), "retrieval")
        .when(t == "flagged_error", "curriculum").when(F.col("citation_score") < 0.5, "retrieval").otherwise("curriculum")
    )


#: Why a signal is routed as it is, and what to do, by type (rejections by target).
REASONS = {
    "accepted": ("a good answer", "nothing to do"), "citation_clicked": ("a source was of use", "nothing to do"),
    "no_result": ("nothing was found", "add or index documents on the topic"), "rephrased": ("the first search missed", "look at how the query meets the chunks"),
    "follow_up": ("the sources may be incomplete", "look at the chunks' borders"), "flagged_error": ("an error was reported", "add corrective examples"),
    "rejected/retrieval": ("rejected with poor sources", "look at the retrieval of the query"), "rejected/curriculum": ("rejected in spite of good sources", "add examples of such reasoning"),
}


def route(signals: DataFrame) -> DataFrame:
    """Where a signal should be worked on, how soon, why and how: stateless."""
    t = F.col("signal_type")
    priority = F.when(t == "flagged_error", "high").when(t.isin("rejected", "no_result", "rephrased"), "medium").otherwise("low")
    rows = signals.withColumns({"target": target(), "priority": priority})
    key = F.when(t == "rejected", F.concat_ws("/", t, "target")).otherwise(t)
    said = lambda n: F.create_map(*[F.lit(x) for k, v in REASONS.items() for x in (k, v[n])])[key]
    return rows.withColumns({"reason": said(0), "action": said(1)})


def dashboard(signals: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Counts and rates of the last days of each discipline."""
    rows = signals.where(F.col("ts") >= F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS"))
    return counted(route(rows).groupBy(F.coalesce("discipline_id", F.lit("unknown")).alias("discipline")))


def counted(grouped) -> DataFrame:
    n = lambda c: F.count_if(c)
    accepted, rejected = n(F.col("signal_type") == "accepted"), n(F.col("signal_type") == "rejected")
    return grouped.agg(
        F.count("*").alias("total"), accepted.alias("accepted"), rejected.alias("rejected"), F.round(accepted / F.count("*"), 6).alias("acceptance_rate"), F.round(rejected / F.count("*"), 6).alias("rejection_rate"),
        n(F.col("signal_type") == "flagged_error").alias("flagged"), n(F.col("target") == "retrieval").alias("to_retrieval"), n(F.col("target") == "curriculum").alias("to_curriculum"),
    )


def repeated(signals: DataFrame, kinds: tuple, least: int = 3) -> DataFrame:
    """Queries with ``least`` signals of some kinds."""
    return signals.where(F.col("signal_type").isin(*kinds)).groupBy("query").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    ).where(F.col("n") >= least)


def low_acceptance(signals: DataFrame, least: int = 3) -> DataFrame:
    rows = signals.where("signal_type = 'rejected'").groupBy(F.coalesce("discipline_id", F.lit("unknown")).alias("discipline"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("query").alias("queries")).where(F.col("n") >= least)


def patterns(signals: DataFrame, least: int = 3) -> DataFrame:
    """What shows up ``least`` times: failing queries, disciplines that reject, and
    queries without results, with when, how often, and where the first signal (or,
    if that needs nothing, the commonest type) should be worked on.

    Patterns of one kind about the same queries are one, that seen first.  Sets of
    queries meet by size and sum of hashes; no group is gathered."""
    rows = route(signals).withColumn("at", F.struct("ts", "signal_id"))
    kinds = (("repeated_failure", FAILURES, "query"), ("low_acceptance", ("rejected",), None), ("missing_coverage", ("no_result",), "query"))
    subject = F.coalesce("discipline_id", F.lit("unknown"))
    tagged = None
    for place, (name, types, by) in enumerate(kinds):
        part = rows.where(F.col("signal_type").isin(*types)).withColumns({"pattern": F.lit(name), "subject": F.col(by) if by else subject, "place": F.lit(place)})
        tagged = part if tagged is None else tagged.union(part)
    keys = ["place", "pattern", "subject"]
    # By query first: what a subject has of queries and of types comes from these.
    per = tagged.groupBy(*keys, "query").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), *[F.min_by(c, "at").alias(c) for c in ("target", "priority", "action")])
    out = per.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.count("*").alias("queries"), F.sum(F.xxhash64("query").cast("decimal(20,0)")).alias("set"), F.min("first").alias("first"), F.max("last").alias("last"),
        *[F.min_by(c, "first").alias(c) for c in ("target", "priority", "action")],
    ).where(F.col("n") >= least)
    types = tagged.groupBy(*keys, "signal_type").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    top = types.groupBy(*keys).agg(F.min_by("signal_type", F.struct(-F.col("n"), "at")).alias("common"))
    out = out.join(top, keys)
    guess = F.when(F.col("common").isin("no_result", "rephrased", "follow_up"), "retrieval").when(F.col("common").isin("flagged_error", "rejected"), "curriculum").otherwise("none")
    same = Window.partitionBy("pattern", "queries", "set").orderBy("first")
    out = out.withColumns({"r": F.row_number().over(same), "target": F.when(F.col("target") == "none", guess).otherwise(F.col("target"))}).where("r = 1")
    return out.orderBy(F.desc("n"), "place", "first").select("pattern", "subject", "n", "queries", F.col("first.ts").alias("first_seen"), F.col("last.ts").alias("last_seen"), "target", "priority", "action")


def turn_feedback(signals: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signals (conv_id, turn, ...) of turns that exist, and the rejected rest."""
    known = turns.select("conv_id", "turn").distinct()
    return signals.join(known, ["conv_id", "turn"], "left_semi"), signals.join(known, ["conv_id", "turn"], "left_anti")


def sessions(signals: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Signals of a conversation no more than ``gap`` apart, and their types."""
    rows = signals.withWatermark("ts", delay) if signals.isStreaming else signals
    types = F.array_join(F.array_sort(F.collect_set("signal_type")), ",")
    out = rows.groupBy("conversation_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), types.alias("types"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return out.drop("w")


def hourly(signals: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Counts by type and hour."""
    rows = signals.withWatermark("ts", delay) if signals.isStreaming else signals
    out = rows.groupBy(F.window("ts", "1 hour").alias("w"), "signal_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("hour"), "signal_type", "n")


def sliding(signals: DataFrame, days: int = 30, delay: str = "1 hour") -> DataFrame:
    """The dashboard's counts for each day's last ``days`` days."""
    rows = route(signals)
    rows = rows.withWatermark("ts", delay) if signals.isStreaming else rows
    grouped = rows.groupBy(F.window("ts", f"{days} days", "1 day").alias("w"), F.coalesce("discipline_id", F.lit("unknown")).alias("discipline"))
    return counted(grouped).withColumn("until", F.col("w.end")).drop("w")
