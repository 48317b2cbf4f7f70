"""Quality rules: a table of thresholds compiled into one projection.

Words are runs of characters other than blank and the five control characters
from tab to carriage return.  Every measure is a column made of Spark's own
functions; the table of thresholds becomes boolean columns over the measures.

Defined results: a null text has no words and fails; an empty text too;
repeated rows give repeated rows; all other columns are kept by
``keep_documents`` and not read; an empty table gives an empty table.  Texts of
any length are measured whole: three-word windows are compared by 64-bit
hashes within their text, sorted, in time n log n.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

WORD = r"[^\x20\x09-\x0D]"
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Frequent words of the four languages of the corpus.
STOP_WORDS = {
    "en": "a an and are as at be by for from in is it of on or that the this to was were what when which with",
    "fr": "au avec dans de des du elle en est et la le les ne pas pour qui que se sur un une",
    "de": "auf aus das dem den der des die ein eine für im in ist mit nicht sich und von zu",
    "es": "al como con de del el en es la las lo los no para por que se su un una y",
}


@dataclass(frozen=True)
class Threshold:
    """``low <= 1000 * part / whole <= high``; a bound that is None is open."""

    rule: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None

    def passed(self) -> Column:
        part, whole = F.col(self.part) * 1000, F.col(self.whole)
        out = F.lit(True)
        if self.low is not None:
            out = out & (part >= whole * self.low)
        if self.high is not None:
            out = out & (part <= whole * self.high)
        return out

    def passed_sql(self) -> str:
        bounds = [f"{self.part} * 1000 >= {self.whole} * {self.low}"] * (self.low is not None)
        bounds += [f"{self.part} * 1000 <= {self.whole} * {self.high}"] * (self.high is not None)
        return f"({' AND '.join(bounds) or 'true'})"


#: Parts per thousand.
THRESHOLDS = (
    Threshold("word_length", "word_chars", "n_words", 2000, 12000),
    Threshold("symbols", "n_symbols", "n_words", None, 200),
    Threshold("stop_words", "n_stop_words", "n_words", 50, None),
    Threshold("dup_lines", "n_dup_lines", "n_lines", None, 500),
    Threshold("line_words", "n_lines", "n_words", None, 500),
)


def _repeated(starts: Column) -> Column:
    """Words covered by three-word windows that begin at the sorted ``starts``."""
    gap = lambda p, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - p, F.lit(3)))
    return F.aggregate(F.transform(starts, gap), F.lit(0), lambda a, b: a + b)


def measured(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with the measures added; columns of the same names give way."""
    t = text_of(text_column)
    words = F.array_remove(F.split(t, BLANKS), "")
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})
    octets = F.octet_length(t)
    symbols = sum((octets - F.octet_length(F.replace(t, F.lit(s))) for s in SYMBOLS), F.lit(0))
    held = [c for c in docs.columns if c.lower() not in MEASURES]
    out = docs.select(
        *[F.col(f"`{c}`") for c in held],
        words.alias("__words"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("__lines"),
        symbols.cast("bigint").alias("n_symbols"),
    )
    w, lines = F.col("__words"), F.col("__lines")
    out = out.withColumns(
        {
            "n_words": F.size(w).cast("bigint"),
            "word_chars": F.length(F.array_join(w, "")).cast("bigint"),
            "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(stops))).cast("bigint"),
            "n_lines": F.size(lines).cast("bigint"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
            "__hashes": F.transform(w, lambda x: F.xxhash64(x)),
        }
    )
    h = F.col("__hashes")
    windows = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    out = out.withColumn("__windows", F.slice(windows, 1, F.greatest(F.size(h) - 2, F.lit(0))))
    v = F.col("__windows")
    # Only texts that repeat a window at all are sorted.
    marked = F.when(
        F.size(F.array_distinct(v)) < F.size(v),
        F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("h"), i.alias("p")))),
    )
    out = out.withColumn("__marked", marked)
    m = F.col("__marked")
    twice = lambda x, j: (F.get(m, j + 1)["h"] == x["h"]) | ((j > 0) & (F.get(m, F.greatest(j - 1, F.lit(0)))["h"] == x["h"]))
    starts = F.sort_array(F.transform(F.filter(m, lambda x, j: F.coalesce(twice(x, j), F.lit(False))), lambda x: x["p"]))
    out = out.withColumn("__starts", F.when(m.isNotNull(), starts))
    repeated = F.when(F.col("__starts").isNull(), 0).otherwise(_repeated(F.col("__starts")))
    out = out.withColumn("n_repeat_words", repeated.cast("bigint"))
    # A filter on a measure must not be pushed below here: it would repeat the
    # measure's whole expression for each use.  None is pushed below a generator.
    return out.select(*[F.col(f"`{c}`") for c in held], F.stack(F.lit(1), *[F.col(m) for m in MEASURES]).alias(*MEASURES))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, text_column: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The measures, ``base_failed``, ``kept``, and the names of failed rules."""
    out = measured(docs, text_column)
    n = F.col("n_words")
    base = (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT)
    passed = F.lit(True)
    for t in thresholds:
        passed = passed & t.passed()
    failed = F.concat_ws(",", *[F.when(~t.passed(), F.lit(t.rule)) for t in thresholds])
    return out.withColumns({"base_failed": base, "kept": ~base & passed, "failed_rules": failed})


def keep_documents(docs: DataFrame, text_column: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The documents that pass, with their own columns only."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text_column).alias("__text"))
    return judged(named, "__text", thresholds).where("kept").select("__row.*")


def oracle_sql(thresholds=THRESHOLDS) -> str:
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})
    listed = ", ".join(f"'{w}'" for w in stops)
    passed = " AND ".join(t.passed_sql() for t in thresholds)
    failed = ", ".join(f"CASE WHEN NOT {t.passed_sql()} THEN '{t.rule}' END" for t in thresholds)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
e AS (SELECT rid, unnest(ws) AS x, unnest(range(len(ws))) AS p FROM w),
v AS (SELECT rid, p, x AS a, lead(x) OVER o AS b, lead(x, 2) OVER o AS c FROM e WINDOW o AS (PARTITION BY rid ORDER BY p)),
r AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM v WHERE c IS NOT NULL),
q AS (SELECT rid, count(DISTINCT p + o) AS n FROM r, (VALUES (0), (1), (2)) AS s(o) WHERE k > 1 GROUP BY rid),
m AS (SELECT w.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(len(list_filter(ws, lambda x: list_contains([{listed}], lower(x)))) AS BIGINT) AS n_stop_words,
        CAST(coalesce(q.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN q ON w.rid = q.rid),
b AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {passed}) AS kept, concat_ws(',', {failed}) AS failed_rules
FROM b"""
