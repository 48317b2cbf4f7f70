"""Queries over grades, regressions and training curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators.retrieval import small
from ..sources import tables
from ..sources.shared import stored
from .catalog import query
from .sql import statement

_RATING = "CASE WHEN {0} >= 0.8 THEN 'strong' WHEN {0} >= 0.6 THEN 'adequate' WHEN {0} >= 0.4 THEN 'needs_improvement' ELSE 'weak' END"


def _graded(spark, sf_dir):
    return E.grade(tables.eval_results(spark, sf_dir))


def _scores(spark, sf_dir):
    return E.named(E.competency_scores(_graded(spark, sf_dir)), tables.competencies(spark, sf_dir))


_NAMED = "named AS (SELECT s.*, coalesce(c.name, CAST(s.competency AS VARCHAR)) AS name FROM scores s LEFT JOIN competencies c ON s.competency = c.competency)"


def _sql(final: str) -> str:
    return statement(f", {_NAMED}\n{final}", "scores", "competencies")


@query("g1_answer_similarity", statement("SELECT run, example_id, round(s, 6) AS similarity FROM graded", "graded"))
def answer_similarity(spark, sf_dir):
    return _graded(spark, sf_dir).select("run", "example_id", F.round("similarity", 6).alias("similarity"))


@query("g2_grade_answers", statement("SELECT run, example_id, quality FROM graded", "graded"))
def grade_answers(spark, sf_dir):
    return _graded(spark, sf_dir).select("run", "example_id", "quality")


@query("g3_competency_scores", _sql(f"SELECT *, {_RATING.format('share')} AS rating, correct || '/' || total || ' correct' AS summary FROM named"))
def competency_scores(spark, sf_dir):
    return _scores(spark, sf_dir)


_REPORT = f"""SELECT *, 'Overall: ' || correct || '/' || total || ' correct (' || replace(rating, '_', ' ') || ')' || chr(10) || lines || CASE WHEN strong <> '' THEN chr(10) || 'Strong areas: ' || replace(strong, ',', ', ') ELSE '' END
  || CASE WHEN weak <> '' THEN chr(10) || 'Needs more examples: ' || replace(weak, ',', ', ') ELSE '' END AS summary FROM (SELECT *, {_RATING.format('accuracy')} AS rating FROM (
  SELECT run, CAST(sum(total) AS BIGINT) AS total, CAST(sum(correct) AS BIGINT) AS correct, sum(correct) / sum(total) AS accuracy, string_agg('  ' || name || ': ' || correct || '/' || total || ' correct', chr(10) ORDER BY competency) AS lines,
  coalesce(string_agg(CASE WHEN share >= 0.8 THEN name END, ',' ORDER BY competency), '') AS strong, coalesce(string_agg(CASE WHEN share < 0.6 THEN name END, ',' ORDER BY competency), '') AS weak FROM named GROUP BY run))"""


@query("g4_evaluation_report", _sql(f"SELECT run, total, correct, accuracy, rating, strong, weak, summary FROM ({_REPORT})"))
def evaluation_report(spark, sf_dir):
    return E.report(_scores(spark, sf_dir))


_CHANGES = """changes AS (SELECT competency, before, after, before_correct, after_correct, cases, name, CASE WHEN before - after > 0 THEN 'regressed' WHEN before - after < 0 THEN 'improved' ELSE 'same' END AS change,
  CASE WHEN before - after >= 0.3 THEN 'critical' WHEN before - after >= 0.2 THEN 'major' WHEN before - after >= 0.1 THEN 'minor' END AS severity FROM
  (SELECT coalesce(a.competency, b.competency) AS competency, coalesce(a.share, 0) AS before, coalesce(b.share, 0) AS after, coalesce(a.correct, 0) AS before_correct, coalesce(b.correct, 0) AS after_correct,
    coalesce(b.total, a.total) AS cases, coalesce(a.name, b.name) AS name FROM (SELECT * FROM named WHERE run = 1) a FULL JOIN (SELECT * FROM named WHERE run = 2) b ON a.competency = b.competency))"""


def _changes(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    return E.compare(scores.where("run = 1"), scores.where("run = 2"))


@query("g5_compare_models", _sql(f", {_CHANGES}\nSELECT competency, name, before, after, change FROM changes"))
def compare_models(spark, sf_dir):
    return _changes(spark, sf_dir).select("competency", "name", "before", "after", "change")


@query(
    "g5_compare_with_context",
    _sql(
        f", {_CHANGES}\nSELECT coalesce(string_agg(CASE WHEN change = 'improved' THEN name END, ', ' ORDER BY competency), '') AS improved, coalesce(string_agg(CASE WHEN change = 'regressed' THEN name END, ', ' ORDER BY competency), '') AS regressed, "
        "round((sum(after_correct) - sum(before_correct)) / sum(cases), 6) AS accuracy_change FROM changes"
    ),
)
def compare_with_context(spark, sf_dir):
    """The second run as the one that answers with context."""
    return E.comparison_summary(_changes(spark, sf_dir))


@query(
    "g6_eval_history",
    statement(
        """, r AS (SELECT discipline, run, CAST(sum(total) AS BIGINT) AS total, round(sum(correct) / sum(total), 6) AS accuracy FROM scores GROUP BY ALL)
SELECT *, run = max(run) OVER (PARTITION BY discipline) AS is_latest FROM r""",
        "scores",
    ),
)
def eval_history(spark, sf_dir):
    return E.history(_scores(spark, sf_dir))


@query("g7_regressions", _sql(f", {_CHANGES}\nSELECT competency, before, after, severity FROM changes WHERE severity IS NOT NULL"))
def regressions(spark, sf_dir):
    return _changes(spark, sf_dir).where("severity IS NOT NULL").select("competency", "before", "after", "severity")


_MOVED = "'  ' || name || ': ' || before_correct || '/' || cases || ' -> ' || after_correct || '/' || cases || ' correct'"


@query(
    "g8_regression_verdict",
    _sql(
        f""", {_CHANGES}, n AS (SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'minor') AS minor,
  string_agg(CASE WHEN severity IS NOT NULL THEN {_MOVED} || ' (' || severity || ')' END, chr(10) ORDER BY competency) AS worse, string_agg(CASE WHEN change = 'improved' THEN {_MOVED} END, chr(10) ORDER BY competency) AS better FROM changes),
v AS (SELECT *, CASE WHEN critical > 0 OR major > 0 THEN 'fail' WHEN minor > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM n)
SELECT critical, major, minor, verdict, 'Verdict: ' || verdict || coalesce(chr(10) || 'Regressions:' || chr(10) || worse, '') || coalesce(chr(10) || 'Improvements:' || chr(10) || better, '') AS summary FROM v"""
    ),
)
def regression_verdict(spark, sf_dir):
    return E.verdict(_changes(spark, sf_dir))


@query("g9_accuracy_trend", statement("SELECT * FROM (SELECT competency, discipline, run, share, share - lag(share) OVER (PARTITION BY competency, discipline ORDER BY run) AS delta FROM scores) WHERE delta > 0 OR -delta >= 0.1", "scores"))
def accuracy_trend(spark, sf_dir):
    return E.trend(_scores(spark, sf_dir))


@query(
    "g10_active_version",
    """WITH v AS (SELECT DISTINCT conv_id % 7 % 2 AS discipline, conv_id AS version, conv_id % 3 = 0 AS activated FROM conversations),
s AS (SELECT *, coalesce(version = max(version) FILTER (activated) OVER (PARTITION BY discipline), false) AS active, row_number() OVER (PARTITION BY discipline ORDER BY version DESC) AS r,
  count(*) OVER (PARTITION BY discipline) AS n FROM v)
SELECT discipline, version, active, r = 2 AS rollback_target, CASE WHEN n < 2 THEN active ELSE r = 2 OR active AND r > 1 END AS active_after_rollback FROM s""",
)
def active_version(spark, sf_dir):
    """Each conversation as a version of its discipline; a third are activated."""
    c = F.col("conv_id")
    versions = tables.table(spark, sf_dir, "conversations").select((c % 7 % 2).alias("discipline"), c.alias("version"), (c % 3 == 0).alias("activated"))
    return E.active_versions(versions.distinct())


def _points(value: str) -> str:
    return f"(SELECT run_id, {value} AS v, row_number() OVER (PARTITION BY run_id ORDER BY idx) - 1 AS x, count(*) OVER (PARTITION BY run_id) AS n FROM metrics WHERE {value} IS NOT NULL)"


@query("g11_loss_slope", statement(f"SELECT run_id, round(coalesce(regr_slope(v, x), 0), 6) AS slope FROM {_points('train_loss')} GROUP BY run_id", "metrics"))
def loss_slope(spark, sf_dir):
    return E.slopes(tables.metrics(spark, sf_dir), "train_loss").withColumn("slope", F.round("slope", 6))


@query(
    "g12_plateau",
    statement(
        ", f AS (SELECT run_id, idx, coalesce(abs(train_loss - lag(train_loss) OVER w) < 0.5, false) AS flat FROM metrics WINDOW w AS (PARTITION BY run_id ORDER BY idx)), i AS (SELECT *, sum(CASE WHEN flat THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY idx) AS island FROM f)\n"
        "SELECT run_id, min(s) AS start FROM (SELECT run_id, min(idx) - 1 AS s FROM i WHERE flat GROUP BY run_id, island HAVING count(*) >= 3) GROUP BY run_id",
        "metrics",
    ),
)
def plateau(spark, sf_dir):
    return E.plateaus(tables.metrics(spark, sf_dir), 0.5, 3)


@query("g13_no_improvement", statement('SELECT run_id, "first", "last", ("first" - "last") / greatest(abs("first"), 1e-8) AS gain FROM (SELECT run_id, arg_min(train_loss, idx) AS "first", arg_max(train_loss, idx) AS "last" FROM metrics GROUP BY run_id) WHERE ("first" - "last") / greatest(abs("first"), 1e-8) < 0.05', "metrics"))
def no_improvement(spark, sf_dir):
    return E.no_improvement(tables.metrics(spark, sf_dir))


def _late(name: str, value: str, least: int, over: float):
    @query(name, statement(f"SELECT run_id, round(slope, 6) AS slope FROM (SELECT run_id, coalesce(regr_slope(v, x), 0) AS slope FROM {_points(value)} WHERE n >= {least} AND x >= n // 2 GROUP BY run_id) WHERE slope > {over}", "metrics"))
    def plan(spark, sf_dir):
        return E.late_slopes(tables.metrics(spark, sf_dir), value, least).where(F.col("slope") > over).withColumn("slope", F.round("slope", 6))


_late("g14_divergence", "train_loss", 3, 0.05)
_late("g16_val_rising", "val_loss", 4, 0.01)


@query("g15_overfit_gap", statement("SELECT run_id, max(val_loss - train_loss) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY idx DESC) AS r, count(*) OVER (PARTITION BY run_id) AS n FROM metrics WHERE val_loss IS NOT NULL) WHERE r <= greatest(3, n // 3) GROUP BY run_id HAVING max(val_loss - train_loss) >= 0.3", "metrics"))
def overfit_gap(spark, sf_dir):
    return E.overfit_gaps(tables.metrics(spark, sf_dir))


@query("g17_loss_spikes", statement("SELECT run_id, idx FROM (SELECT *, avg(train_loss) OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b FROM metrics) WHERE idx >= 3 AND b > 0 AND train_loss > b * 2", "metrics"))
def loss_spikes(spark, sf_dir):
    return E.spikes(tables.metrics(spark, sf_dir)).select("run_id", "idx")


@query("g18_gradient_explosion", statement("SELECT run_id, top, median FROM (SELECT run_id, max(gradient_norm) AS top, max(CASE WHEN r = n // 2 THEN gradient_norm END) AS median FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY gradient_norm, idx) - 1 AS r, count(*) OVER (PARTITION BY run_id) AS n FROM metrics WHERE gradient_norm IS NOT NULL) WHERE n >= 2 GROUP BY run_id) WHERE median <> 0 AND top > median * 10", "metrics"))
def gradient_explosion(spark, sf_dir):
    return E.explosions(tables.metrics(spark, sf_dir))


_HEALTH = """health AS (SELECT discipline, total, CASE WHEN total < 20 THEN 'critical' WHEN total < 50 THEN 'warning' ELSE 'ok' END AS size, n >= 2 AND top / total > 0.7 AS dominated, round(cv, 6) AS cv, coalesce(total >= 5 AND cv > 0.8, false) AS uneven
  FROM (SELECT discipline, CAST(sum(n) AS BIGINT) AS total, max(n) AS top, count(*) AS n FROM (SELECT discipline, competency, count(*) AS n FROM examples GROUP BY ALL) GROUP BY discipline)
  JOIN (SELECT discipline, stddev_pop(length(answer)) / nullif(avg(length(answer)), 0) AS cv FROM examples GROUP BY discipline) USING (discipline))"""


@query("g19_curriculum_health", statement(f", {_HEALTH}\nSELECT * FROM health", "examples"))
def curriculum_health(spark, sf_dir):
    return E.curriculum_health(tables.examples(spark, sf_dir))


_PLATEAU = (0.5, 3)
_PLACES = "CASE issue " + " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(E.ISSUES)) + " END"
_CATEGORY = "CASE issue " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, (c, _) in E.ISSUES.items()) + " END"
_SEVERITY = "CASE issue " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, (_, s) in E.ISSUES.items()) + " END"
_ADVICE = "CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.ADVICE.items()) + " END"
_SLOPE = lambda v, least: f"(SELECT run_id, coalesce(regr_slope(v, x), 0) AS slope FROM {_points(v)} WHERE n >= {least} AND x >= n // 2 GROUP BY run_id)"


@query(
    "g20_training_report",
    statement(
        f""", {_HEALTH}, f AS (SELECT run_id, idx, coalesce(abs(train_loss - lag(train_loss) OVER w) < {_PLATEAU[0]}, false) AS flat FROM metrics WINDOW w AS (PARTITION BY run_id ORDER BY idx)),
i AS (SELECT *, sum(CASE WHEN flat THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY idx) AS island FROM f), long AS (SELECT run_id FROM metrics GROUP BY run_id HAVING count(*) >= {E.LEAST_POINTS}),
found AS (SELECT DISTINCT run_id, 'plateau' AS issue, 1 AS n FROM (SELECT run_id FROM i WHERE flat GROUP BY run_id, island HAVING count(*) >= {_PLATEAU[1]})
  UNION ALL SELECT run_id, 'no_improvement', 1 FROM (SELECT run_id, arg_min(train_loss, idx) AS a, arg_max(train_loss, idx) AS b FROM metrics GROUP BY run_id) WHERE (a - b) / greatest(abs(a), 1e-8) < 0.05
  UNION ALL SELECT run_id, 'divergence', 1 FROM {_SLOPE('train_loss', 3)} WHERE slope > 0.05
  UNION ALL SELECT run_id, 'overfit_gap', 1 FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY idx DESC) AS r, count(*) OVER (PARTITION BY run_id) AS n FROM metrics WHERE val_loss IS NOT NULL) WHERE r <= greatest(3, n // 3) GROUP BY run_id HAVING max(val_loss - train_loss) >= 0.3
  UNION ALL SELECT run_id, 'val_rising', 1 FROM {_SLOPE('val_loss', 4)} WHERE slope > 0.01
  UNION ALL SELECT run_id, 'spike', count(*) FROM (SELECT *, avg(train_loss) OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b FROM metrics) WHERE idx >= 3 AND b > 0 AND train_loss > b * 2 GROUP BY run_id
  UNION ALL SELECT run_id, 'gradient_explosion', 1 FROM (SELECT run_id, max(gradient_norm) AS top, max(CASE WHEN r = n // 2 THEN gradient_norm END) AS median FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY gradient_norm, idx) - 1 AS r, count(*) OVER (PARTITION BY run_id) AS n
    FROM metrics WHERE gradient_norm IS NOT NULL) WHERE n >= 2 GROUP BY run_id) WHERE median <> 0 AND top > median * 10),
runs AS (SELECT DISTINCT run_id FROM metrics),
every AS (SELECT * FROM found WHERE run_id IN (SELECT run_id FROM long) UNION ALL SELECT run_id, issue, 1 FROM runs JOIN (SELECT discipline, unnest([CASE size WHEN 'critical' THEN 'too_few_examples' WHEN 'warning' THEN 'few_examples' END, CASE WHEN dominated THEN 'one_sided' END, CASE WHEN uneven THEN 'uneven_lengths' END]) AS issue FROM health) h
  ON run_id % 2 = h.discipline WHERE issue IS NOT NULL),
p AS (SELECT run_id, sum(CASE WHEN {_SEVERITY} = 'critical' THEN n ELSE 0 END) AS critical, sum(CASE WHEN {_SEVERITY} = 'warning' THEN n ELSE 0 END) AS warnings, string_agg(issue || CASE WHEN n > 1 THEN ' x' || n ELSE '' END, ', ' ORDER BY {_PLACES}) AS issues FROM every GROUP BY run_id),
a AS (SELECT run_id, string_agg({_ADVICE}, '; ' ORDER BY k) AS recommendations FROM (SELECT run_id, {_CATEGORY} AS c, min({_PLACES}) AS k FROM every GROUP BY ALL) GROUP BY run_id)
SELECT r.run_id, CASE WHEN critical > 0 THEN 'critical' WHEN warnings > 0 THEN 'warning' ELSE 'healthy' END AS health, CAST(coalesce(critical, 0) AS BIGINT) AS critical, CAST(coalesce(warnings, 0) AS BIGINT) AS warnings, coalesce(issues, '') AS issues, coalesce(recommendations, '') AS recommendations
  FROM runs r LEFT JOIN p ON r.run_id = p.run_id LEFT JOIN a ON r.run_id = a.run_id""",
        "metrics", "examples",
    ),
)
def training_report(spark, sf_dir):
    """All checks of a run, with the curriculum of the discipline it trains."""
    points = stored(tables.metrics(spark, sf_dir), "metrics")
    runs = points.select("run_id").distinct()
    own = small(E.curriculum_issues(E.curriculum_health(tables.examples(spark, sf_dir))))
    trained = runs.withColumn("discipline", F.col("run_id") % 2).join(own, "discipline").select("run_id", "issue", "n")
    return E.training_report(runs, E.training_issues(points, _PLATEAU).union(trained))
