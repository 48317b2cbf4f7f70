"""Grading of answers, competency scores, regressions, training curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, token_set

QUALITIES = ("correct", "partially_correct", "incorrect", "no_response")


def grade(results: DataFrame) -> DataFrame:
    """``similarity`` and ``quality`` of each response."""
    s = jaccard(token_set(F.col("expected")), token_set(F.col("response")))
    rows = results.withColumn("similarity", s)
    x = F.col("similarity")
    quality = F.when(F.trim("response") == "", "no_response").when(x >= 0.7, "correct").when(x >= 0.4, "partially_correct").otherwise("incorrect")
    return rows.withColumn("quality", quality)


def rating(share: Column) -> Column:
    return F.when(share >= 0.8, "strong").when(share >= 0.6, "adequate").when(share >= 0.4, "needs_improvement").otherwise("weak")


def competency_scores(graded: DataFrame) -> DataFrame:
    n = lambda q: F.count_if(F.col("quality") == q)
    rows = graded.groupBy("run", "competency", "discipline").agg(
        F.count("*").alias("total"), n("correct").alias("correct"), n("partially_correct").alias("partial"), n("incorrect").alias("incorrect"), n("no_response").alias("no_response")
    )
    rows = rows.withColumn("share", F.col("correct") / F.col("total"))
    return rows.withColumns({"rating": rating(F.col("share")), "summary": F.concat(F.concat_ws("/", "correct", "total"), F.lit(" correct"))})


def named(scores: DataFrame, names: DataFrame) -> DataFrame:
    """Scores with the competencies' names (competency, name), or their ids."""
    rows = scores.join(names.select("competency", "name"), "competency", "left")
    return rows.withColumn("name", F.coalesce("name", F.col("competency").cast("string")))


def report(scores: DataFrame) -> DataFrame:
    """Totals of each run, its strong and weak competencies, and all of it in
    words.  A run has a row a competency here."""
    line = F.concat(F.lit("  "), "name", F.lit(": "), "summary")
    pick = lambda kinds, c: F.transform(F.array_sort(F.collect_list(F.when(F.col("rating").isin(*kinds), F.struct("competency", F.col(c).alias("v"))))), lambda x: x["v"])
    every, strong, weak = ("strong", "adequate", "needs_improvement", "weak"), ("strong",), ("weak", "needs_improvement")
    rows = scores.withColumn("line", line).groupBy("run").agg(
        F.sum("total").alias("total"), F.sum("correct").alias("correct"), pick(every, "line").alias("lines"), pick(strong, "name").alias("strong"), pick(weak, "name").alias("weak")
    )
    rows = rows.withColumn("accuracy", F.col("correct") / F.col("total"))
    rows = rows.withColumn("rating", rating(F.col("accuracy")))
    head = F.concat(F.lit("Overall: "), "correct", F.lit("/"), "total", F.lit(" correct ("), F.replace("rating", F.lit("_"), F.lit(" ")), F.lit(")"))
    tail = [F.when(F.size(c) > 0, F.concat(F.lit(title), F.array_join(c, ", "))) for title, c in (("Strong areas: ", "strong"), ("Needs more examples: ", "weak"))]
    return rows.select(
        "run", "total", "correct", "accuracy", "rating", F.array_join("strong", ",").alias("strong"), F.array_join("weak", ",").alias("weak"),
        F.concat_ws("\n", head, F.array_join("lines", "\n"), *tail).alias("summary"),
    )


def compare(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Changes of each competency's share between two runs."""
    side = lambda rows, to: rows.groupBy("competency").agg(
        F.max("share").alias(to), F.sum("correct").alias(f"{to}_correct"), F.sum("total").alias(f"{to}_total"), F.max("name").alias(f"{to}_name")
    )
    rows = side(baseline, "before").join(side(current, "after"), "competency", "full_outer").fillna(0.0, ["before", "after"]).fillna(0, ["before_correct", "after_correct"])
    drop = F.col("before") - F.col("after")
    change = F.when(drop > 0, "regressed").when(drop < 0, "improved").otherwise("same")
    severity = F.when(drop >= 0.3, "critical").when(drop >= 0.2, "major").when(drop >= 0.1, "minor")
    rows = rows.withColumns({"change": change, "severity": severity, "name": F.coalesce("before_name", "after_name"), "cases": F.coalesce("after_total", "before_total")})
    return rows.drop("before_name", "after_name", "before_total", "after_total")


def comparison_summary(changes: DataFrame) -> DataFrame:
    """The competencies that gained and lost, and by how much accuracy moved: a
    model against another, or answers with context against those without."""
    pick = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("change") == kind, F.struct("competency", "name")))), lambda x: x["name"]), ", ")
    gain = (F.sum("after_correct") - F.sum("before_correct")) / F.sum("cases")
    return changes.agg(pick("improved").alias("improved"), pick("regressed").alias("regressed"), F.round(gain, 6).alias("accuracy_change"))


def verdict(changes: DataFrame) -> DataFrame:
    """Counts of regressions by severity, the verdict, and all of it in words."""
    n = lambda s: F.count_if(F.col("severity") == s)
    moved = F.concat(F.lit("  "), "name", F.lit(": "), "before_correct", F.lit("/"), "cases", F.lit(" -> "), "after_correct", F.lit("/"), "cases", F.lit(" correct"))
    bad = F.when(F.col("severity").isNotNull(), F.struct("competency", F.concat(moved, F.lit(" ("), "severity", F.lit(")")).alias("line")))
    good = F.when(F.col("change") == "improved", F.struct("competency", moved.alias("line")))
    lines = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["line"]), "\n")
    rows = changes.agg(n("critical").alias("critical"), n("major").alias("major"), n("minor").alias("minor"), lines(bad).alias("worse"), lines(good).alias("better"))
    rows = rows.withColumn("verdict", F.when((F.col("critical") > 0) | (F.col("major") > 0), "fail").when(F.col("minor") > 0, "warn").otherwise("pass"))
    part = lambda title, c: F.when(F.col(c) != "", F.concat(F.lit(f"{title}:\n"), F.col(c)))
    return rows.select("critical", "major", "minor", "verdict", F.concat_ws("\n", F.concat(F.lit("Verdict: "), "verdict"), part("Regressions", "worse"), part("Improvements", "better")).alias("summary"))


def trend(scores: DataFrame) -> DataFrame:
    """The points at which a competency's share rose, or fell by a tenth or more,
    against the run before."""
    before = F.lag("share").over(Window.partitionBy("competency", "discipline").orderBy("run"))
    rows = scores.withColumn("delta", F.col("share") - before)
    return rows.where("delta > 0 OR -delta >= 0.1").select("competency", "discipline", "run", "share", "delta")


# ------------------------------------------------------------ training curves


def _run(order: str = "idx") -> Window:
    return Window.partitionBy("run_id").orderBy(order)


def slopes(points: DataFrame, value: str) -> DataFrame:
    """Least-squares slope of a value over its index, nulls left out first."""
    rows = points.where(F.col(value).isNotNull()).withColumn("x", F.row_number().over(_run()) - 1)
    return rows.groupBy("run_id").agg(F.coalesce(F.regr_slope(value, "x"), F.lit(0.0)).alias("slope"))


def late_slopes(points: DataFrame, value: str, least: int = 2) -> DataFrame:
    """The slope of the second half of a value's points."""
    rows = points.where(F.col(value).isNotNull())
    rows = rows.withColumns({"x": F.row_number().over(_run()) - 1, "n": F.count("*").over(Window.partitionBy("run_id"))})
    rows = rows.where((F.col("n") >= least) & (F.col("x") >= F.floor(F.col("n") / 2)))
    return rows.groupBy("run_id").agg(F.coalesce(F.regr_slope(value, "x"), F.lit(0.0)).alias("slope"))


def plateaus(points: DataFrame, threshold: float = 0.001, patience: int = 5) -> DataFrame:
    """The first run of ``patience`` changes below ``threshold``."""
    change = F.abs(F.col("train_loss") - F.lag("train_loss").over(_run()))
    rows = points.withColumn("flat", F.coalesce(change < threshold, F.lit(False)))
    rows = rows.withColumn("island", F.sum(F.when(F.col("flat"), 0).otherwise(1)).over(_run()))
    found = rows.where("flat").groupBy("run_id", "island").agg(F.count("*").alias("n"), (F.min("idx") - 1).alias("start")).where(F.col("n") >= patience)
    return found.groupBy("run_id").agg(F.min("start").alias("start"))


def no_improvement(points: DataFrame, least: float = 0.05) -> DataFrame:
    rows = points.groupBy("run_id").agg(F.min_by("train_loss", "idx").alias("first"), F.max_by("train_loss", "idx").alias("last"))
    gain = (F.col("first") - F.col("last")) / F.greatest(F.abs("first"), F.lit(1e-8))
    return rows.withColumn("gain", gain).where(F.col("gain") < least)


def overfit_gaps(points: DataFrame, limit: float = 0.3) -> DataFrame:
    rows = points.where("val_loss IS NOT NULL")
    rows = rows.withColumns({"r": F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("idx"))), "n": F.count("*").over(Window.partitionBy("run_id"))})
    rows = rows.where(F.col("r") <= F.greatest(F.lit(3), F.floor(F.col("n") / 3)))
    return rows.groupBy("run_id").agg(F.max(F.col("val_loss") - F.col("train_loss")).alias("gap")).where(F.col("gap") >= limit)


def spikes(points: DataFrame, times: float = 2.0) -> DataFrame:
    before = F.avg("train_loss").over(_run().rowsBetween(-3, -1))
    rows = points.withColumn("before", before)
    return rows.where((F.col("idx") >= 3) & (F.col("before") > 0) & (F.col("train_loss") > F.col("before") * times))


def explosions(points: DataFrame, times: float = 10.0) -> DataFrame:
    """Runs whose largest gradient norm is over ``times`` the upper median."""
    w = Window.partitionBy("run_id").orderBy("gradient_norm", "idx")
    rows = points.where("gradient_norm IS NOT NULL").withColumns({"r": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("run_id"))})
    out = rows.where("n >= 2").groupBy("run_id").agg(F.max("gradient_norm").alias("top"), F.max(F.when(F.col("r") == F.floor(F.col("n") / 2), F.col("gradient_norm"))).alias("median"))
    return out.where((F.col("median") != 0) & (F.col("top") > F.col("median") * times))


#: Category, severity and place of each issue of a training report.
ISSUES = {
    "plateau": ("convergence", "warning"), "no_improvement": ("convergence", "warning"), "divergence": ("convergence", "critical"), "overfit_gap": ("overfitting", "critical"),
    "val_rising": ("overfitting", "warning"), "spike": ("stability", "warning"), "gradient_explosion": ("stability", "critical"),
    "too_few_examples": ("data_quality", "critical"), "few_examples": ("data_quality", "warning"), "one_sided": ("data_quality", "warning"), "uneven_lengths": ("data_quality", "warning"),
}
ADVICE = {
    "convergence": "add more diverse examples where the model is weak", "overfitting": "add other phrasings and scenarios to each competency",
    "stability": "look for unusual examples and lower the learning rate", "data_quality": "check balance, lengths and number of examples",
}
LEAST_POINTS = 3


def training_issues(points: DataFrame, plateau: tuple = (0.001, 5)) -> DataFrame:
    """(run_id, issue, n): what the curves of runs with ``LEAST_POINTS`` points show."""
    long = points.groupBy("run_id").agg(F.count("*").alias("__n")).where(F.col("__n") >= LEAST_POINTS).select("run_id")
    found = {
        "plateau": plateaus(points, *plateau), "no_improvement": no_improvement(points), "divergence": late_slopes(points, "train_loss", 3).where("slope > 0.05"),
        "overfit_gap": overfit_gaps(points), "val_rising": late_slopes(points, "val_loss", 4).where("slope > 0.01"), "spike": spikes(points), "gradient_explosion": explosions(points),
    }
    out = None
    for name, rows in found.items():
        part = rows.select("run_id", F.lit(name).alias("issue"))
        out = part if out is None else out.union(part)
    return out.join(long, "run_id", "left_semi").groupBy("run_id", "issue").agg(F.count("*").alias("n"))


def curriculum_health(examples: DataFrame) -> DataFrame:
    """Size, balance and evenness of each discipline's examples."""
    per = examples.groupBy("discipline", "competency").agg(F.count("*").alias("n"), F.sum(F.length("answer")).alias("s"), F.sum(F.pow(F.length("answer"), F.lit(2))).alias("s2"))
    rows = per.groupBy("discipline").agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.count("*").alias("competencies"), F.sum("s").alias("s"), F.sum("s2").alias("s2"))
    mean = F.col("s") / F.col("total")
    cv = F.when(mean > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("total") - mean * mean)) / mean)
    size = F.when(F.col("total") < 20, "critical").when(F.col("total") < 50, "warning").otherwise("ok")
    rows = rows.withColumns({"size": size, "cv": F.round(cv, 6), "dominated": (F.col("competencies") >= 2) & (F.col("top") / F.col("total") > 0.7)})
    uneven = F.coalesce((F.col("total") >= 5) & (F.col("cv") > 0.8), F.lit(False))
    return rows.select("discipline", "total", "size", "dominated", "cv", uneven.alias("uneven"))


def curriculum_issues(health: DataFrame) -> DataFrame:
    """(discipline, issue, n) of curricula."""
    names = F.array(
        F.when(F.col("size") == "critical", "too_few_examples").when(F.col("size") == "warning", "few_examples"), F.when(F.col("dominated"), "one_sided"), F.when(F.col("uneven"), "uneven_lengths")
    )
    return health.select("discipline", F.explode(F.array_compact(names)).alias("issue"), F.lit(1).cast("bigint").alias("n"))


def training_report(runs: DataFrame, issues: DataFrame) -> DataFrame:
    """Health of each run (run_id) by the worst of its issues (run_id, issue, n),
    their counts, and a recommendation for each category in order."""
    facts = F.create_map(*[F.lit(x) for k, (c, s) in ISSUES.items() for x in (k, F.struct(F.lit(list(ISSUES).index(k)).alias("k"), F.lit(c).alias("c"), F.lit(s).alias("s")))])
    rows = issues.withColumn("f", facts[F.col("issue")])
    name = F.when(F.col("n") > 1, F.concat("issue", F.lit(" x"), "n")).otherwise(F.col("issue"))
    count = lambda s: F.sum(F.when(F.col("f.s") == s, F.col("n")).otherwise(0))
    per = rows.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("f.k", name.alias("name"), F.col("f.c").alias("c")))).alias("found"), count("critical").alias("critical"), count("warning").alias("warnings")
    )
    advice = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    listed = F.array_distinct(F.transform("found", lambda x: x["c"]))
    out = runs.join(per, "run_id", "left").fillna(0, ["critical", "warnings"])
    health = F.when(F.col("critical") > 0, "critical").when(F.col("warnings") > 0, "warning").otherwise("healthy")
    none = F.lit("")
    return out.select(
        "run_id", health.alias("health"), "critical", "warnings", F.coalesce(F.array_join(F.transform("found", lambda x: x["name"]), ", "), none).alias("issues"),
        F.coalesce(F.array_join(F.transform(listed, lambda c: advice[c]), "; "), none).alias("recommendations"),
    )


def history(scores: DataFrame) -> DataFrame:
    """The reports of each discipline: accuracy of a run over all competencies,
    and which run is the latest."""
    reports = scores.groupBy("discipline", "run").agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"))
    latest = reports.groupBy("discipline").agg(F.max("run").alias("__latest"))
    accuracy = F.round(F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0), 6)
    return reports.join(latest, "discipline").select("discipline", "run", "total", accuracy.alias("accuracy"), (F.col("run") == F.col("__latest")).alias("is_latest"))


def active_versions(versions: DataFrame) -> DataFrame:
    """State of versions (discipline, version, activated), versions being in the
    order of their creation.

    One version of a discipline is active, the last activated; a rollback puts
    out the latest and activates the one before, or does nothing where there is
    none.  Two small aggregates a discipline and no window, as one discipline
    may hold most versions."""
    top = versions.groupBy("discipline").agg(F.max("version").alias("__last"), F.max(F.when(F.col("activated"), F.col("version"))).alias("__active"))
    rows = versions.join(top, "discipline")
    before = rows.where("version < __last").groupBy("discipline").agg(F.max("version").alias("__before"))
    rows = rows.join(before, "discipline", "left")
    v, active = F.col("version"), F.coalesce(F.col("version") == F.col("__active"), F.lit(False))
    target = F.coalesce(v == F.col("__before"), F.lit(False))
    rolled = F.when(F.col("__before").isNull(), active).otherwise(target | (active & (v != F.col("__last"))))
    return rows.select("discipline", "version", active.alias("active"), target.alias("rollback_target"), rolled.alias("active_after_rollback"))
