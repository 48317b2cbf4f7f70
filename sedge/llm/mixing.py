"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed in cells, one for each source, language and topic met.  The
cells' weights are raked: scaled in turn so that each marginal meets its
targets, until none is off by more than ``TOLERANCE`` of all tokens, or for
``CYCLES`` cycles, as targets may contradict each other; what they are off by
then is warned of.  A document's inclusion probability is its cell's factor
times one constant, at most 1; the constant is set so that the expected share
of tokens is ``share``.  A document is in the sample if a number drawn from a
digest of the seed and its id is below its probability, so retries and reruns
agree.  Spark's own functions do all of it.

Without targets of its own, a marginal's target shares are its present shares
to the power ``temper``, scaled to 1: large sources weigh less, small ones more.

Defined results: nulls in a marginal are a value of their own, written
``(none)``; documents without tokens add nothing to any target and get their
cell's probability, all the same; rows with a null id are drawn by their text's
digest; repeated rows are drawn alike; other columns are kept, whatever their
names; an empty table gives an empty table.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.retrieval import small
from .common import Rounds, stored, text_of

MARGINALS = ("source", "lang", "topic")
TEMPER, SHARE, CYCLES, SEED = 0.7, 0.8, 200, "mix-1"
#: Share of all tokens that a marginal may be off by when raking ends.
TOLERANCE = 1e-9
#: Cycles between two cuts of the lineage, where the marginals are looked at.
CUT = 6
#: Up to so many cells one task rakes them and they are broadcast (some 100
#: bytes each); of more, marginals are aggregated by shuffle and joined back.
CELLS_AT_ONCE = 50_000
#: Topics by the first keyword found, tried in order; the rest is prose.
TOPICS = (
    ("licences", ("Licen", "licen", "LICEN", "Copyright", "copyright")),
    ("credentials", ("password", "passwd", "secret", "token", "api_key", "AKIA")),
    ("tables", (" | ",)),
)
PROSE = "prose"


def topic_of(text: Column) -> Column:
    out = None
    for name, words in TOPICS:
        met = F.lit(False)
        for w in words:
            met = met | F.contains(text, F.lit(w))
        out = F.when(met, name) if out is None else out.when(met, name)
    return out.otherwise(PROSE)


def words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def _keys(names) -> list[Column]:
    return [F.coalesce(F.col(f"`{m}`").cast("string"), F.lit("(none)")).alias(f"__k{i}") for i, m in enumerate(names)]


def cells_of(docs: DataFrame, weight: str, marginals=MARGINALS) -> DataFrame:
    """(__k0, __k1, ..., w): the tokens of each cell."""
    keyed = docs.select(*_keys(marginals), F.col(f"`{weight}`").cast("double").alias("w"))
    return keyed.groupBy(*[f"__k{i}" for i in range(len(marginals))]).agg(F.sum("w").alias("w"))


def raked(
    cells: DataFrame, n: int, targets: dict[int, DataFrame] | None = None, temper: float = TEMPER, cycles: int = CYCLES, tolerance: float = TOLERANCE, few: bool = True
) -> DataFrame:
    """``cells`` with ``f``, the factor of each.  ``targets`` gives, by the
    number of a marginal, a table (value, share) in place of tempered shares;
    values that it lacks keep no tokens.  ``few`` cells fit one task."""
    names = [f"__k{i}" for i in range(n)]
    total = cells.agg(F.sum("w")).first()[0] or 0.0
    if not total:
        return cells.withColumn("f", F.lit(1.0))
    out = cells
    for i in range(n):
        if targets and i in targets:
            given = targets[i].select(F.col("value").alias(names[i]), F.col("share").cast("double").alias(f"__t{i}"))
            out = out.join(small(given, CELLS_AT_ONCE), names[i], "left").fillna(0.0, [f"__t{i}"])
        else:
            out = _summed(out, names[i], F.col("w"), f"__m{i}", few)
            out = out.withColumn(f"__t{i}", F.pow(F.col(f"__m{i}") / total, F.lit(temper)))
    # Tempered shares sum to 1 over the values of a marginal, each counted once.
    own = [i for i in range(n) if not (targets and i in targets)]
    if own:
        once = [F.sum(F.when(F.col(f"__m{i}") > 0, F.col("w") / F.col(f"__m{i}") * F.col(f"__t{i}"))).alias(f"s{i}") for i in own]
        sums = out.agg(*once).first()
        for i in own:
            out = out.withColumn(f"__t{i}", F.col(f"__t{i}") / F.lit(sums[f"s{i}"])).drop(f"__m{i}")
    rounds, cycle = Rounds(cells.sparkSession, "raking"), 0
    out = out.withColumn("f", F.lit(1.0))
    while True:
        for _ in range(min(CUT, cycles - cycle)):
            for i in range(n):
                out = _summed(out, names[i], F.col("w") * F.col("f"), "__now", few)
                out = out.withColumn("f", F.when(F.col("__now") > 0, F.col("f") * F.col(f"__t{i}") * total / F.col("__now")).otherwise(F.col("f"))).drop("__now")
            cycle += 1
        held = rounds.hold(out)
        out = held.coalesce(1) if few else held
        off = residual(held, n, total)
        if off <= tolerance:
            break
        if cycle >= cycles:
            warnings.warn(f"after {cycle} cycles of raking a marginal is off its target by {off:.3g} of all tokens", stacklevel=2)
            break
    return out.select(*names, "w", "f")


def _summed(cells: DataFrame, name: str, value: Column, into: str, few: bool) -> DataFrame:
    """``cells`` with the sum of a value over those of the same marginal value: a
    window where one task holds all cells, else an aggregate that is joined back."""
    if few:
        return cells.withColumn(into, F.sum(value).over(Window.partitionBy(name)))
    sums = cells.groupBy(name).agg(F.sum(value).alias(into))
    return cells.join(small(stored(sums, "marginal"), CELLS_AT_ONCE), name)


def residual(cells: DataFrame, n: int, total: float) -> float:
    """The largest distance of a marginal value (of those with tokens) from its
    target, as a share of all tokens."""
    off = [
        cells.groupBy(f"__k{i}").agg(F.abs(F.sum(F.col("w") * F.col("f")) / total - F.max(f"__t{i}")).alias("off"), F.sum("w").alias("w")).where("w > 0").select("off")
        for i in range(n)
    ]
    every = off[0]
    for more in off[1:]:
        every = every.union(more)
    return every.agg(F.max("off")).first()[0] or 0.0


def constant(cells: DataFrame, share: float = SHARE) -> float:
    """The c for which tokens times min(1, c f) sum to ``share`` of all tokens.

    Every step is one aggregate: cells that the present c would take in whole
    stay so at the next, larger c; it ends when no more cells are whole."""
    total, reach = cells.agg(F.sum("w"), F.sum(F.col("w") * F.col("f"))).first()
    if not total or not reach:
        return 1.0
    c, whole = share * total / reach, -1
    while True:
        full = F.col("f") * F.lit(c) >= 1
        n, taken, rest = cells.agg(
            F.count(F.when(full, 1)), F.sum(F.when(full, F.col("w")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w") * F.col("f")))
        ).first()
        if n == whole or not rest:
            return c
        c, whole = max(c, (share * total - taken) / rest), n


def draw_key(id_column: str, text_column: str | None) -> Column:
    """What a row is drawn by: its id, or its text's digest."""
    key = F.col(f"`{id_column}`").cast("string")
    if text_column:
        key = F.coalesce(key, F.md5(F.col(f"`{text_column}`")))
    return F.coalesce(key, F.lit("null"))


def drawn(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the seed and a row's key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def sampled(
    docs: DataFrame,
    weight: str,
    marginals=MARGINALS,
    targets: dict[str, DataFrame] | None = None,
    share: float = SHARE,
    temper: float = TEMPER,
    cycles: int = CYCLES,
    seed: str = SEED,
    key_column: str = "doc_id",
) -> DataFrame:
    """(row, factor, probability, in_sample): each row of ``docs`` as a struct."""
    n = len(marginals)
    cells = stored(cells_of(docs, weight, marginals), "cells")
    few = cells.count() <= CELLS_AT_ONCE
    by_number = {list(marginals).index(m): t for m, t in (targets or {}).items()}
    factors = stored(raked(cells.coalesce(1) if few else cells, n, by_number, temper, cycles, few=few), "factors")
    c = constant(factors, share)
    names = [f"__k{i}" for i in range(n)]
    side = factors.select(*names, F.col("f").alias("factor"))
    keyed = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"), *_keys(marginals), draw_key(key_column, None).alias("key"))
    joined = keyed.join(F.broadcast(side) if few else side, names, "left")
    out = joined.withColumn("probability", F.least(F.lit(1.0), F.col("factor") * F.lit(c)))
    return out.select("row", "factor", "probability", (drawn(F.col("key"), seed) < F.col("probability")).alias("in_sample"))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", lang_column: str = "lang", **options) -> DataFrame:
    """The sampled documents with their own columns only."""
    t = text_of(text_column)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"),
        draw_key(id_column, text_column).alias("key"),
        F.col(source_column).alias("source"),
        F.col(lang_column).alias("lang"),
        topic_of(t).alias("topic"),
        words_of(t).alias("words"),
    )
    return sampled(rows, "words", key_column="key", **options).where("in_sample").select("row.own.*")


def oracle_sql(share: float = SHARE, temper: float = TEMPER, cycles: int = 24, seed: str = SEED) -> str:
    """The same in DuckDB, one statement of so many steps: cycles enough for the
    tables at hand to come within the tolerance."""
    cases = " ".join(f"WHEN {' OR '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in TOPICS)
    steps = [
        f"""d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
        text, CASE {cases} ELSE '{PROSE}' END AS topic, CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_words
        FROM (SELECT *, coalesce(text, '') AS t FROM documents))""",
        "g AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_words) AS DOUBLE) AS w FROM d GROUP BY ALL)",
        f"""m AS (SELECT *, pow(sum(w) OVER (PARTITION BY source) / sum(w) OVER (), {temper}) AS a, pow(sum(w) OVER (PARTITION BY lang) / sum(w) OVER (), {temper}) AS b,
        pow(sum(w) OVER (PARTITION BY topic) / sum(w) OVER (), {temper}) AS c, sum(w) OVER (PARTITION BY source) AS ma, sum(w) OVER (PARTITION BY lang) AS mb, sum(w) OVER (PARTITION BY topic) AS mc, sum(w) OVER () AS total FROM g)""",
        """f0 AS MATERIALIZED (SELECT source, lang, topic, w, total, a / sum(w / ma * a) OVER () AS a, b / sum(w / mb * b) OVER () AS b, c / sum(w / mc * c) OVER () AS c, CAST(1 AS DOUBLE) AS f FROM m)""",
    ]
    k = 0
    for _ in range(cycles):
        for key, t in (("source", "a"), ("lang", "b"), ("topic", "c")):
            steps.append(
                f"f{k + 1} AS MATERIALIZED (SELECT source, lang, topic, w, total, a, b, c, CASE WHEN sum(w * f) OVER (PARTITION BY {key}) > 0 THEN f * {t} * total / sum(w * f) OVER (PARTITION BY {key}) ELSE f END AS f FROM f{k})"
            )
            k += 1
    steps.append(f"c0 AS MATERIALIZED (SELECT {share} * max(total) / sum(w * f) AS c FROM f{k})")
    for j in range(12):
        steps.append(
            f"""c{j + 1} AS MATERIALIZED (SELECT CASE WHEN sum(CASE WHEN f * x.c >= 1 THEN 0 ELSE w * f END) > 0 THEN greatest(max(x.c), ({share} * max(total) - sum(CASE WHEN f * x.c >= 1 THEN w ELSE 0 END))
            / sum(CASE WHEN f * x.c >= 1 THEN 0 ELSE w * f END)) ELSE max(x.c) END AS c FROM f{k}, c{j} AS x)"""
        )
    draw = f"CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"
    return f"""WITH {", ".join(steps)}
SELECT doc_id, d.source, d.lang, d.topic, n_words, round(q.f, 6) AS factor, round(least(1.0, q.f * c12.c), 6) AS probability, {draw} < least(1.0, q.f * c12.c) AS sampled
FROM d JOIN f{k} AS q ON d.source = q.source AND d.lang = q.lang AND d.topic = q.topic, c12"""
