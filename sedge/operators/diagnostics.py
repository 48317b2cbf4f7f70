"""Diagnostics of chunks, generated questions, and fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, tokens, words

# References and connectives that point out of a chunk, in the order
# in which they are tried; those that questions are made of; and limits.
FORWARD = (r"\bas follows:?\b", r"\bbelow:?\b", r"\bsee table\s+\d+", r"\bsee figure\s+\d+")
BACKWARD = (r"\bas mentioned\b", r"\bas noted\b", r"\babove\b", r"\bprevious(?:ly)?\b", r"\bsee section\b")
CONNECTIVES = ("however", "therefore", "additionally", "furthermore", "moreover", "consequently", "thus", "hence")
ASK_FORWARD = (r"\bas follows:?\b", r"\bbelow:?\b", r"\bnext\b", r"\bsubsequent\b", r"\blater\b")
ASK_BACKWARD = (r"\bas mentioned\b", r"\bas noted\b", r"\babove\b", r"\bprevious(?:ly)?\b", r"\bearlier\b", r"\bsee (?:section|figure|table)\b")
ASK_CONNECTIVES = (*CONNECTIVES, "nevertheless")
PROCEDURES = (r"\bstep\s+\d+", r"\bfirst\b.*\bthen\b", r"\bshall\b", r"\bmust\b.*\bfollowing\b")
NO_SUBJECT = ("the", "a", "an", "in", "on", "at")
TABLE_MARKS = ("|", "\t\t", "────")
LIST_NUMBER = r"(?m)^\s*(\d+)[\.\)]\s+"
TOPIC = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"
HEADING_LINE = r"(?m)^#+\s+|^\d+\.\d+\s+|^[A-Z][A-Z\s]+:?$"
MERGED_BELOW = 20
#: Numbers of a list are exact up to so many digits; longer ones count as the next.
LIST_DIGITS = 37


def neighbours(chunks: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("chunk_pos")
    return chunks.withColumns({"prev_id": F.lag("chunk_id").over(w), "next_id": F.lead("chunk_id").over(w)})


def any_match(c: Column, patterns) -> Column:
    """Whether a pattern is met, in one scan; all begin at the edge of a word, with a
    letter that is looked at first."""
    bare = [p.removeprefix(r"\b") for p in patterns]
    return c.rlike(f"(?i)(?=[{''.join(sorted({p[0] for p in bare}))}])\\b(?:{'|'.join(bare)})")


def connective(stripped: Column, words_: tuple = CONNECTIVES) -> Column:
    """Whether a stripped text begins with one of the words."""
    return F.substring(stripped, 1, max(map(len, words_))).rlike(f"(?i)^(?:{'|'.join(words_)})")


def list_numbers(content: Column) -> Column:
    """The numbers of numbered lines, as whole decimals."""
    found = F.regexp_extract_all(content, F.lit(LIST_NUMBER), F.lit(1))
    bare = F.transform(found, lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    return F.transform(bare, lambda x: F.when(F.length(x) > LIST_DIGITS, F.lit("1" + "0" * LIST_DIGITS)).otherwise(x).cast("decimal(38,0)"))


def has_gaps(numbers: Column) -> Column:
    """Whether a number between the least and the largest is missing; the range is
    compared with the count, so its width does not matter."""
    return (F.size(numbers) > 0) & (F.array_max(numbers) - F.array_min(numbers) + 1 > F.size(F.array_distinct(numbers)))


def marked_lines(content: Column) -> Column:
    lines = F.split(content, "\n")
    return F.size(F.filter(lines, lambda x: x.contains(TABLE_MARKS[0]) | x.contains(TABLE_MARKS[1]) | x.contains(TABLE_MARKS[2])))


def problem_columns(t: Column, content: Column, c: Column, numbers: Column, lines: Column) -> list[tuple[str, Column]]:
    """(kind, severity or null) of each rule, in the order of reports, of a chunk's
    tokens, content, stripped content, list numbers and marked lines."""
    return [
        ("size_small", F.when(t < 20, F.when(t < 10, "high").otherwise("medium"))),
        ("size_large", F.when(t > 500, F.when(t > 800, "high").otherwise("medium"))),
        ("lowercase_start", F.when(c.rlike(r"^\p{Ll}"), "high")),
        ("connective", F.when(connective(c), "medium")),
        ("incomplete_end", F.when((F.length(c) > 50) & ~c.rlike(r"[.!?]$"), "medium")),
        ("forward_ref", F.when(any_match(content, FORWARD), "medium")),
        ("backward_ref", F.when(any_match(content, BACKWARD), "low")),
        ("list_start", F.when((F.size(numbers) > 0) & (F.array_min(numbers) > 1), "high")),
        ("list_gaps", F.when(has_gaps(numbers), "medium")),
        ("table_partial", F.when((lines > 0) & (lines < 3), "medium")),
    ]


TYPES = {
    "size_small": "semantic_incomplete", "size_large": "semantic_contamination", "lowercase_start": "semantic_incomplete", "connective": "semantic_incomplete",
    "incomplete_end": "semantic_incomplete", "forward_ref": "reference_orphaning", "backward_ref": "reference_orphaning", "list_start": "structural_breakage",
    "list_gaps": "structural_breakage", "table_partial": "structural_breakage",
}


def diagnose(chunks: DataFrame, kinds: tuple | None = None) -> DataFrame:
    """One row for each problem of a chunk, in the order ``seq``; large chunks with
    their content."""
    held = ["doc_id", "chunk_id", "chunk_pos", "token_count", "prev_id", "next_id"]
    # What more than one rule asks of is a column, and so is what a rule says: each is
    # made once.
    rows = neighbours(chunks).withColumns({"__c": strip(F.col("content")), "__numbers": list_numbers(F.col("content")), "__lines": marked_lines(F.col("content"))})
    rules = problem_columns(*[F.col(c) for c in ("token_count", "content", "__c", "__numbers", "__lines")])
    rules = [(n, k, s) for n, (k, s) in enumerate(rules) if kinds is None or k in kinds]
    made = [
        F.when(F.col(f"__{k}").isNotNull(), F.struct(F.lit(k).alias("kind"), F.lit(TYPES[k]).alias("problem_type"), F.col(f"__{k}").alias("severity"), F.lit(n).alias("rule")))
        for n, k, _ in rules
    ]
    rows = rows.withColumns({f"__{k}": s for _, k, s in rules})
    rows = rows.select(*held, "content", F.explode(F.array_compact(F.array(*made))).alias("p"))
    content = F.when(F.col("p.kind") == "size_large", F.col("content")).alias("content")
    seq = F.struct("chunk_pos", F.col("p.rule").alias("rule")).alias("seq")
    return rows.select(*held, content, seq, F.concat_ws("_", F.lit("problem"), "chunk_id", "p.kind").alias("problem_id"), "p.kind", "p.problem_type", "p.severity")


def problem_stats(problems: DataFrame) -> DataFrame:
    """Counts by type and by severity of each document, and in all."""
    by = F.explode(F.array(F.struct(F.lit("all").alias("facet"), F.lit("all").alias("value")), *[F.struct(F.lit(k).alias("facet"), F.col(c).alias("value")) for k, c in (("type", "problem_type"), ("severity", "severity"))]))
    rows = problems.select("doc_id", "chunk_id", by.alias("f")).select("doc_id", "chunk_id", "f.*")
    return rows.groupBy("doc_id", "facet", "value").agg(F.count("*").alias("problems"), F.countDistinct("chunk_id").alias("chunks"))


def questions(chunks: DataFrame, group: str = "") -> DataFrame:
    """Questions that a chunk's faults suggest, with the chunks expected; with ``group``
    those whose type begins with it."""
    # What more than one question asks of is a column, so it is made once.
    rows = neighbours(chunks).withColumns({"__c": strip(F.col("content")), "__w": words(F.col("content")), "__numbers": list_numbers(F.col("content"))})
    c, w, numbers = F.col("__c"), F.col("__w"), F.col("__numbers")
    capital = F.slice(F.filter(words(F.substring("content", 1, 100)), lambda x: x.rlike(r"^\p{Lu}") & ~F.lower(x).isin(*NO_SUBJECT)), 1, 3)
    head = words(F.substring("content", 1, 100))
    subject = F.when(F.size(capital) > 0, F.array_join(capital, " ")).when(F.size(head) >= 5, F.array_join(F.slice(head, 1, 5), " ")).otherwise(F.substring("content", 1, 30))
    tail = F.array_join(F.slice(w, F.greatest(F.size(w) - 4, F.lit(1)), F.lit(5)), " ")
    ask = lambda kind, when, text, expected: F.when(when, F.struct(F.lit(kind).alias("question_type"), text.alias("question"), expected.alias("expected")))
    own, around = F.array("chunk_id"), lambda other: F.array_compact(F.array(*other))
    procedure = F.lit(False)
    for p in PROCEDURES:
        procedure = procedure | F.col("content").rlike("(?i)" + p)
    topics = F.size(F.array_distinct(F.regexp_extract_all(F.substring("content", 1, 500), F.lit(TOPIC), F.lit(0))))
    low, high = F.array_min(numbers), F.array_max(numbers)
    made = [
        ask("boundary_start", connective(c, ASK_CONNECTIVES), F.concat(F.lit("What led to: "), subject, F.lit("?")), around(["prev_id", "chunk_id"])),
        ask("boundary_end", (c != "") & ~c.rlike(r"[.!?]$") & (F.size(w) >= 5) & F.col("next_id").isNotNull(), F.concat(F.lit("What follows after '"), tail, F.lit("'?")), around(["chunk_id", "next_id"])),
        ask("reference_forward", any_match(F.col("content"), ASK_FORWARD), F.concat(F.lit("What does the text on "), subject, F.lit(" refer to?")), own),
        ask("reference_backward", any_match(F.col("content"), ASK_BACKWARD), F.concat(F.lit("What was said before about "), subject, F.lit("?")), own),
        ask("structure_list", (F.size(numbers) > 0) & (low > 1), F.concat(F.lit("Which items precede number "), low.cast("string"), F.lit("?")), around(["prev_id", "chunk_id"])),
        ask("structure_more", (F.size(numbers) > 0) & (high >= 5) & ~c.endswith("."), F.concat(F.lit("Which items follow number "), high.cast("string"), F.lit("?")), around(["chunk_id", "next_id"])),
        ask("structure_procedure", procedure, F.concat(F.lit("What are the steps for "), subject, F.lit("?")), own),
        ask("coherence_large", (F.col("token_count") > 500) & (topics > 10), F.concat(F.lit("What is the main topic of "), subject, F.lit("?")), own),
        ask("coherence_small", F.col("token_count") < MERGED_BELOW, F.concat(F.lit("What is meant by '"), F.substring(c, 1, 50), F.lit("'?")), own),
    ]
    kinds = ("boundary_start", "boundary_end", "reference_forward", "reference_backward", "structure_list", "structure_more", "structure_procedure", "coherence_large", "coherence_small")
    made = F.array(*[q for kind, q in zip(kinds, made) if kind.startswith(group)])
    rows = rows.select("doc_id", "chunk_id", F.explode(F.array_compact(made)).alias("q"))
    return rows.select("doc_id", "chunk_id", "q.*")


def question_results(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """Status of each question (question_id, expected) by its hits
    (question_id, rank, chunk_id): pass, partial or fail."""
    found = hits.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("retrieved"))
    rows = asked.join(found, "question_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>")))
    met, missing = F.array_intersect("expected", "retrieved"), F.array_except("expected", "retrieved")
    status = F.when(F.size(missing) == 0, "pass").when(F.size(met) > 0, "partial").otherwise("fail")
    return rows.withColumns({"status": status, "missing": missing, "ranks": F.transform("expected", lambda x: F.array_position("retrieved", x))})


def question_report(results: DataFrame, worst: int = 10) -> DataFrame:
    """(facet, doc_id, name, questions, pass, partial, fail): results by type, and
    the ``worst`` chunks of each document by questions that did not pass.  A report
    of that many rows a document; all failures are the results themselves."""
    counts = [F.count("*").alias("questions"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pass", "partial", "fail")]]
    types = results.groupBy("question_type").agg(*counts).select(F.lit("type").alias("facet"), F.lit(None).cast("bigint").alias("doc_id"), F.col("question_type").alias("name"), "questions", "pass", "partial", "fail")
    per = results.groupBy("doc_id", "chunk_id").agg(*counts).where("partial + fail > 0")
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.col("partial") + F.col("fail")), "chunk_id")
    chunks = per.withColumn("r", F.row_number().over(order)).where(F.col("r") <= worst)
    return types.unionByName(chunks.select(F.lit("chunk").alias("facet"), "doc_id", F.col("chunk_id").alias("name"), "questions", "pass", "partial", "fail"))


def plan_fixes(problems: DataFrame) -> DataFrame:
    """One action for each problem that has one: merge with a neighbour, or
    split in two.  ``problems`` carry the content of large chunks."""
    k, small = F.col("kind"), F.col("token_count") < MERGED_BELOW
    meaning = F.col("problem_type").isin("semantic_incomplete", "structural_breakage")
    either = F.coalesce("next_id", "prev_id")
    to = (
        F.when(meaning & small, either).when(k.isin("connective", "lowercase_start", "list_start"), F.col("prev_id")).when(k == "incomplete_end", F.col("next_id"))
        .when(meaning, either).when(k == "forward_ref", F.col("next_id")).when(k == "backward_ref", F.col("prev_id"))
    )
    confidence = F.when(k.isin("forward_ref", "backward_ref"), 0.6).when((k == "list_start") & ~small, 0.9).otherwise(0.8)
    back = F.col("prev_id").isNotNull() & (to == F.col("prev_id"))
    pair = F.when(back, F.array(to, "chunk_id")).otherwise(F.array("chunk_id", to))
    first = F.when(back, F.col("chunk_pos") - 1).otherwise(F.col("chunk_pos"))
    merge = problems.where(to.isNotNull()).select(
        "doc_id", "problem_id", "seq", F.lit("merge").alias("action"), pair.alias("chunk_ids"), first.alias("place"), confidence.alias("confidence"), F.lit(None).cast("int").alias("at")
    )
    at, sure = split_point(F.col("content"), F.col("token_count"))
    split = problems.where("kind = 'size_large'").select("doc_id", "problem_id", "seq", F.lit("split"), F.array("chunk_id"), "chunk_pos", sure, at)
    return merge.union(split)


def split_point(content: Column, token_count: Column) -> tuple[Column, Column]:
    """Where to cut a long chunk, and how sure: behind the paragraph with which two
    fifths of half its tokens are reached, if it has three paragraphs; else at its
    middle heading, if it has two; else in its middle."""
    parts = F.split(content, "\n\n")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("at"))

    def step(acc: Column, p: Column) -> Column:
        n, i = acc["n"] + tokens(p), acc["i"] + 1
        return F.struct(i.alias("i"), n.alias("n"), F.when((acc["at"] == 0) & (n >= F.floor(token_count / 2) * 0.4), i).otherwise(acc["at"]).alias("at"))

    upto = F.greatest(F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step)["at"], F.lit(1))
    paragraph = F.length(F.array_join(F.slice(parts, F.lit(1), upto), "\n\n"))
    headings = F.regexp_extract_all(content, F.lit(HEADING_LINE), F.lit(0))
    middle = F.floor(F.size(headings) / 2).cast("int")
    rest = F.element_at(F.split(content, HEADING_LINE, middle + 2), -1)
    heading = F.length(content) - F.length(rest) - F.length(F.get(headings, middle))
    many, some = F.size(parts) >= 3, F.size(headings) >= 2
    at = F.when(many, paragraph).when(some, heading).otherwise(F.floor(F.length(content) / 2)).cast("int")
    return at, F.when(many, 0.7).when(some, 0.8).otherwise(0.5)


def plan_summary(problems: DataFrame, actions: DataFrame) -> DataFrame:
    """Of each document: problems, planned and kept actions, chunks in more than one
    action, and the improvement expected."""
    touched = actions.select("doc_id", F.explode("chunk_ids").alias("chunk")).groupBy("doc_id", "chunk").agg(F.count("*").alias("n"))
    clash = touched.groupBy("doc_id").agg(F.count_if(F.col("n") > 1).alias("conflicts"))
    planned = actions.groupBy("doc_id").agg(F.count("*").alias("planned"))
    kept = resolve_conflicts(actions).groupBy("doc_id").agg(F.count("*").alias("kept"))
    rows = problems.groupBy("doc_id").agg(F.count("*").alias("problems")).join(planned, "doc_id", "left").join(kept, "doc_id", "left").join(clash, "doc_id", "left")
    rows = rows.fillna(0, ["planned", "kept", "conflicts"])
    return rows.withColumn("improvement", F.round(F.least(F.lit(1.0), F.col("kept") / F.col("problems") * 0.7), 6))


def resolve_conflicts(actions: DataFrame) -> DataFrame:
    """Actions that are the best for every chunk they touch, by confidence, then
    merges, then the order of their problems."""
    touched = actions.select("doc_id", "problem_id", "confidence", "action", "seq", F.explode("chunk_ids").alias("chunk"))
    best = Window.partitionBy("doc_id", "chunk").orderBy(F.desc("confidence"), "action", "seq")
    losers = touched.withColumn("r", F.row_number().over(best)).where("r > 1").select("doc_id", "problem_id").distinct()
    return actions.join(losers, ["doc_id", "problem_id"], "left_anti")


def apply_fixes(chunks: DataFrame, actions: DataFrame) -> DataFrame:
    """All surviving actions at once: they are disjoint.  Every join and window is
    by document and chunk, or by document."""
    marked = actions.select("doc_id", "problem_id", "action", "at", F.explode("chunk_ids").alias("chunk_id"))
    rows = chunks.join(marked, ["doc_id", "chunk_id"], "left")
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.expr("substring(content, 1, at)").alias("content")), F.struct(F.lit(1).alias("half"), F.expr("substring(content, at + 1)").alias("content"))
    )
    whole = F.array(F.struct(F.lit(0).alias("half"), F.col("content").alias("content")))
    pieces = rows.select("doc_id", "chunk_pos", "problem_id", "action", F.explode(F.when(F.col("action") == "split", halves).otherwise(whole)).alias("h"))
    # What is merged meets under its problem; all else is for itself.
    key = F.when(F.col("action") == "merge", F.col("problem_id")).otherwise(F.concat_ws("/", "chunk_pos", "h.half"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_pos", "h.half", "h.content")))
    made = pieces.groupBy("doc_id", key.alias("key")).agg(parts.alias("p"))
    content = strip(F.array_join(F.transform("p", lambda x: x["content"]), "\n\n"))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.get("p", 0)["chunk_pos"], F.get("p", 0)["half"])) - 1
    out = made.select("doc_id", pos.alias("chunk_pos"), content.alias("content"))
    return out.select("doc_id", "chunk_pos", F.concat_ws("+", "doc_id", "chunk_pos").alias("chunk_id"), "content", tokens(F.col("content")).alias("token_count"))


def fix_report(before: DataFrame, after: DataFrame, applied: DataFrame) -> DataFrame:
    """Problems of each document before and after, the share that went, and whether
    more problems are left than actions were applied, which fails validation."""
    n = lambda rows, name: rows.groupBy("doc_id").agg(F.count("*").alias(name))
    rows = n(before, "before").join(n(after, "after"), "doc_id", "full_outer").join(n(applied, "applied"), "doc_id", "left").fillna(0)
    gone = F.when(F.col("before") > 0, (F.col("before") - F.col("after")) / F.col("before")).otherwise(0.0)
    failed = (F.col("applied") > 0) & (F.col("after") > F.col("applied"))
    return rows.withColumns({"reduction": F.round(gone, 6), "validation_failed": failed})
