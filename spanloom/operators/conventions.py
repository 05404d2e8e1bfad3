"""Conventions: which type a span should have, from proposals and from accepted tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.phrases import phrases_in_text
from spanloom.functions.text import stripped
from spanloom.operators.graph import numbered

# How sources begin that speak for an operator, the second by settling a dispute.
DECLARED, RESOLVED = "declared:", "dispute_resolved_by:"
#: Proposals of a span that are put in order in one task, at most.
RUN = 1 << 16


def by_operator(source: Column) -> Column:
    return source.startswith(DECLARED) | source.startswith(RESOLVED)


def from_proposals(proposals: DataFrame, run: int = RUN) -> DataFrame:
    """Folds the proposals of each span, in order of seq, into one convention: span_lower, type, status, source, evidence, n_tasks, locked.

    A proposal that repeats its predecessor's type, source and task doesn't count, but for settled disputes. What an operator last declared, or
    settled a dispute with, wins and locks the span; without that, the first type holds as long as no other is proposed, after which the
    span is disputed. Each seq of a span is one proposal; tasks may be null.

    Proposals are put in order in runs of at most `run` values of seq, and what a run leaves can be merged: its first and last proposal, by which
    repeats at the seams are found, and counts. So no task sorts all proposals of a frequent span.
    """
    w = Window.partitionBy("span_lower", "__run").orderBy("seq")
    same = lambda x, y: x["type"].eqNullSafe(y["type"]) & x["source"].eqNullSafe(y["source"]) & x["task_id"].eqNullSafe(y["task_id"]) & ~y["source"].startswith(RESOLVED)
    own = proposals.withColumn("__run", F.floor(F.col("seq") / run)).withColumn("__it", F.struct("type", "source", "task_id"))
    own = own.withColumns({"__before": F.lag("__it").over(w), "__after": F.lead("__it").over(w)})
    own = own.withColumn("__repeat", F.col("__before").isNotNull() & same(F.col("__before"), F.col("__it")))
    end = F.struct("seq", F.col("__before").isNull().alias("head"), F.col("__after").isNull().alias("tail"), F.col("__it").alias("it"))
    operator = F.when(by_operator(F.col("source")), F.col("seq"))
    folded = own.groupBy("span_lower").agg(
        F.min_by("type", "seq").alias("first_type"), F.max_by("type", operator).alias("operator_type"), F.countDistinct("type").alias("n_types"), F.count_if(~F.col("__repeat")).alias("n"),
        F.coalesce(F.max_by("source", operator), F.min_by("source", "seq")).alias("source"), F.countDistinct("task_id").alias("n_tasks"),
        F.collect_list(F.when(F.col("__before").isNull() | F.col("__after").isNull(), end)).alias("ends"),  # two for each run
    )
    ends = F.array_sort("ends")  # by seq
    seams = F.size(F.filter(F.zip_with(F.slice("ends", F.lit(1), F.size("ends") - 1), F.slice("ends", F.lit(2), F.size("ends") - 1), lambda x, y: x["tail"] & y["head"] & same(x["it"], y["it"])), lambda x: x))
    locked = F.col("operator_type").isNotNull()
    status = F.when(locked | (F.col("n_types") == 1), "active").otherwise("disputed")
    folded = folded.withColumn("ends", ends).withColumn("evidence", F.col("n") - F.when(F.size("ends") > 1, seams).otherwise(0))
    return folded.select("span_lower", F.coalesce("operator_type", "first_type").alias("type"), status.alias("status"), "source", "evidence", "n_tasks", locked.alias("locked"))


def without_spans(conventions: DataFrame, spans: DataFrame) -> DataFrame:
    """Conventions but for those of spans (span, as written) that an operator cancelled."""
    return conventions.join(spans.select(F.lower(stripped(F.col("span"))).alias("span_lower")), "span_lower", "left_anti")


def tally(votes: DataFrame) -> DataFrame:
    """From votes (span_lower, task_id, type): the dominant type (ties: the larger name), its count, distinct tasks and dispute."""
    counts = votes.groupBy("span_lower", "type").agg(F.count("*").alias("n"))
    best = counts.groupBy("span_lower").agg(F.max(F.struct("n", "type")).alias("b"), F.sum("n").alias("n_tasks"))
    return best.select("span_lower", F.col("b.type").alias("type"), F.col("b.n").alias("n_agree"), "n_tasks", (F.col("n_tasks") - F.col("b.n")).alias("n_dispute"), F.round((F.col("n_tasks") - F.col("b.n")) / F.col("n_tasks"), 6).alias("dispute_share"))


def tally_proposals(proposals: DataFrame) -> DataFrame:
    """tally() of each task's latest proposal that no operator made."""
    votes = proposals.where(~by_operator(F.col("source"))).groupBy("span_lower", "task_id").agg(F.max_by("type", "seq").alias("type"))
    return tally(votes)


def recount(decisions: DataFrame, conventions: DataFrame) -> DataFrame:
    """Existing conventions with tallies from accepted tasks, one vote per task (its largest type). Locked ones keep their type; without
    votes the tallies are 0."""
    votes = decisions.groupBy("span_lower", "task_id").agg(F.max("type").alias("type"))
    t = tally(votes).withColumnRenamed("type", "voted")
    joined = conventions.join(t.select("span_lower", "voted", F.col("n_tasks").alias("distinct_tasks"), "n_dispute"), "span_lower", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select("span_lower", F.when(F.col("locked") | F.col("voted").isNull(), F.col("type")).otherwise(F.col("voted")).alias("type"), "status", "locked", zero("distinct_tasks").alias("distinct_tasks"), zero("n_dispute").alias("n_dispute"))


def rebuild(decisions: DataFrame) -> DataFrame:
    """Conventions from accepted tasks alone, with how the tasks vote."""
    return tally(decisions.groupBy("span_lower", "task_id").agg(F.max("type").alias("type")))


def without_overridden(decisions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Decisions of tasks whose effective annotation isn't a human answer that overrides the annotators."""
    from spanloom.operators.parse import effective_annotation

    over = effective_annotation(artifacts).where("kind = 'human_review_answer'").select("task_id")
    return decisions.join(over, "task_id", "left_anti")


def injectable(recounted: DataFrame, least: int = 5, dispute: float = 0.20) -> DataFrame:
    """Active conventions that enough tasks back with little dispute, or that an operator declared."""
    calm = (F.col("distinct_tasks") >= least) & (F.col("n_dispute") < dispute * F.col("distinct_tasks"))
    return recounted.where((F.col("status") == "active") & (calm | F.col("locked"))).select("span_lower", "type", "distinct_tasks", "locked")


def convention_phrases(conventions: DataFrame, least_length: int) -> DataFrame:
    return conventions.where(F.length("span_lower") >= least_length).select(F.col("span_lower").alias("phrase"), F.col("type").alias("note"))


def row_hits(rows: DataFrame, conventions: DataFrame, least_length: int = 4) -> DataFrame:
    """task_id, row_index, span_lower, convention: each row with each convention (span_lower, type) of at least that many characters that its text
    holds. Rows may be a stream."""
    return phrases_in_text(rows, convention_phrases(conventions, least_length), F.col("input"), ["task_id", "row_index"], "convention").withColumnRenamed("phrase", "span_lower")


def found_in_text(rows: DataFrame, conventions: DataFrame, most: int = 50, least_length: int = 4) -> DataFrame:
    """Per task up to `most` conventions whose span its text holds, the longest first: as whole words, or, for spans of other characters than
    ASCII letters, digits, blanks and . - _ ', anywhere.

    Rows of a task that stand together are counted where they are read, which sends no more than `most` conventions; they go to their task once.
    """
    hits = phrases_in_text(rows, convention_phrases(conventions, least_length), F.col("input"), ["task_id"], "convention", most=most).withColumnRenamed("phrase", "span_lower")
    per = hits.repartition("task_id").groupBy("task_id", "span_lower", "convention").agg(F.sum("n_rows").alias("n_rows"))
    w = Window.partitionBy("task_id").orderBy(F.desc(F.length("span_lower")), "span_lower")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")


def backfill_proposals(final: DataFrame, prelabel: DataFrame, tasks: DataFrame, effective: DataFrame, touched: DataFrame) -> DataFrame:
    """Proposals (span_lower, seq, type, task_id, source) from accepted tasks that no arbiter touched (task_id) and whose effective annotation
    can be read: decisions of the final spans that differ from the prelabel's, labelled by who decided."""
    from spanloom.operators.repair import decision_diff

    able = effective.where("usable").select("task_id", "kind").join(tasks.where("status = 'accepted'").select("task_id"), "task_id", "left_semi").join(touched, "task_id", "left_anti")
    diff = decision_diff(final.join(able.select("task_id"), "task_id", "left_semi"), prelabel).join(able, "task_id")
    placed = numbered(diff, ["span_lower", "task_id"], "place")  # by ranges: a frequent span isn't sorted in one task
    starts = placed.groupBy("span_lower").agg(F.min("place").alias("start"))
    seq = (F.col("place") - F.col("start") + 1).cast("int")
    return placed.join(starts, "span_lower").select("span_lower", seq.alias("seq"), "type", "task_id", F.when(F.col("kind") == "human_review_answer", "hr_correction").otherwise("qc_consensus").alias("source"))


def backfill_counts(tasks: DataFrame, effective: DataFrame, touched: DataFrame) -> DataFrame:
    """One row: accepted tasks scanned, and those skipped because an arbiter touched them, no annotation is there, or it can't be read."""
    own = tasks.where("status = 'accepted'").select("task_id").join(touched.select("task_id", F.lit(True).alias("t")).distinct(), "task_id", "left").join(effective, "task_id", "left")
    free = F.col("t").isNull()
    return own.agg(F.count("*").alias("n_scanned"), F.count_if(~free).alias("n_touched"), F.count_if(free & F.col("kind").isNull()).alias("n_missing"), F.count_if(free & F.col("kind").isNotNull() & ~F.col("usable")).alias("n_unreadable"))


def past_experience(conventions: DataFrame, proposals: DataFrame, scores: DataFrame, k: int = 3, generic: float = 5.0, evidence: int = 5) -> DataFrame:
    """What is known of each span, a row for each proposed type: its convention, how often the type was proposed, up to k diverse examples of it
    (from the proposals' context), the words' frequency, and whether it is a generic word with little evidence."""
    from spanloom.operators.similarity import diverse_examples

    counts = proposals.groupBy("span_lower", "type").agg(F.count("*").alias("n"))
    shown = proposals.where(F.trim("context") != "").select("span_lower", "type", F.concat(F.lit("["), "task_id", F.lit("] "), "context").alias("text"))
    examples = diverse_examples(shown, ["span_lower", "type"], k).groupBy("span_lower", "type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x.text), " | ").alias("examples"))  # k at most
    known = conventions.select("span_lower", "status", F.col("type").alias("convention"), "evidence")
    out = counts.join(examples, ["span_lower", "type"], "left").join(known, "span_lower", "left").join(scores, "span_lower", "left")
    zipf = F.coalesce("score", F.lit(0.0))
    return out.select("span_lower", "type", "n", F.coalesce("examples", F.lit("")).alias("examples"), F.coalesce("status", F.lit("none")).alias("status"), "convention", F.coalesce("evidence", F.lit(0)).alias("evidence"), F.round(zipf, 3).alias("zipf"), ((zipf >= generic) & (F.coalesce("evidence", F.lit(0)) < evidence)).alias("generic_word"))


def policy_drift(decisions: DataFrame, conventions: DataFrame) -> DataFrame:
    """Per span: decisions of accepted tasks that differ from the active convention."""
    active = conventions.where("status = 'active'").select("span_lower", F.col("type").alias("convention"))
    off = decisions.join(active, "span_lower").where("type <> convention")
    return off.groupBy("span_lower", "convention").agg(F.countDistinct("task_id").alias("n_tasks"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"))


def conventions_page(conventions: DataFrame, status: str, limit: int, offset: int = 0) -> DataFrame:
    return conventions.where(F.col("status") == status).orderBy(F.desc("n_tasks"), F.desc("evidence"), "span_lower").offset(offset).limit(limit).select("span_lower", "type", "n_tasks", "evidence")
