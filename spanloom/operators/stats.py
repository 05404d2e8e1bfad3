"""Entity statistics over accepted tasks: counts, priors, contested spans, word frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import blank, stripped
from spanloom.operators.graph import written
from spanloom.operators.parse import span_decisions

SPAN_TYPE = ["span_lower", "type"]
MIN_TOTAL, DOMINANT, SECOND = 10, 0.80, 0.20


def accepted(frame: DataFrame, tasks: DataFrame) -> DataFrame:
    return frame.join(tasks.where("status = 'accepted'").select("task_id", "project_id"), "task_id")


def entity_statistics(spans: DataFrame, tasks: DataFrame) -> DataFrame:
    """project_id, span_lower, type, n: the distinct accepted tasks that decide so."""
    decided = accepted(span_decisions(spans), tasks).withColumn("span_lower", F.lower("span"))
    return decided.groupBy("project_id", *SPAN_TYPE).agg(F.countDistinct("task_id").alias("n"))


def recount_span(old: DataFrame, spans: DataFrame, tasks: DataFrame, span: str) -> DataFrame:
    """old with one span's counts replaced by fresh ones."""
    fresh = entity_statistics(spans.where(F.lower("span") == span), tasks)
    return old.where(F.col("span_lower") != span).unionByName(fresh)


def weighted_statistics(spans: DataFrame, tasks: DataFrame, effective: DataFrame, weight: int = 5) -> DataFrame:
    """As entity_statistics(), a task with a human answer counting weight times."""
    human = effective.select("task_id", (F.col("kind") == "human_review_answer").alias("human"))
    decided = accepted(span_decisions(spans), tasks).join(human, "task_id", "left").withColumn("span_lower", F.lower("span"))
    each = decided.groupBy("project_id", *SPAN_TYPE, "task_id").agg(F.max(F.coalesce("human", F.lit(False))).alias("human"))
    return each.groupBy("project_id", *SPAN_TYPE).agg(F.sum(F.when(F.col("human"), weight).otherwise(1)).alias("n"))


def add_counts(old: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """Counts of both, added by key."""
    return old.select(*key, "n").unionByName(delta.select(*key, "n")).groupBy(*key).agg(F.sum("n").alias("n"))


def by_span(statistics: DataFrame) -> DataFrame:
    """span_lower, type, n over all projects."""
    return statistics.groupBy(*SPAN_TYPE).agg(F.sum("n").alias("n"))


def distributions(statistics: DataFrame) -> DataFrame:
    """Per span: total, number of types, and its types with counts, most frequent first, as text."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "type")))
    grouped = by_span(statistics).groupBy("span_lower").agg(F.sum("n").alias("total"), F.count("*").alias("n_types"), order.alias("d"))
    return grouped.select("span_lower", "total", "n_types", F.array_join(F.transform("d", lambda x: F.concat_ws(":", x.type, (-x.m).cast("string"))), ",").alias("distribution"))


def summaries(statistics: DataFrame) -> DataFrame:
    """Per span: total, dominant type (ties: the larger name) and its share, the second type and its share."""
    counts = by_span(statistics)
    w = Window.partitionBy("span_lower").orderBy(F.desc("n"), F.desc("type"))
    ranked = counts.withColumn("rank", F.row_number().over(w))
    grouped = ranked.groupBy("span_lower").agg(F.sum("n").alias("total"), F.max(F.when(F.col("rank") == 1, F.struct("type", "n"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.struct("type", "n"))).alias("b"))
    return grouped.select("span_lower", "total", F.col("a.type").alias("top_type"), (F.col("a.n") / F.col("total")).alias("top_share"), F.col("b.type").alias("second_type"), F.coalesce(F.col("b.n") / F.col("total"), F.lit(0.0)).alias("second_share"))


def prior_check(decisions: DataFrame, summary: DataFrame) -> DataFrame:
    """Adds verdict to decisions (task_id, span_lower, type): cold_start under MIN_TOTAL, divergent where a dominant type differs, else agree."""
    joined = decisions.join(summary, "span_lower", "left")
    cold = F.coalesce("total", F.lit(0)) < MIN_TOTAL
    off = (F.col("top_share") >= DOMINANT) & (F.col("top_type") != F.col("type"))
    return joined.withColumn("verdict", F.when(cold, "cold_start").when(off, "divergent").otherwise("agree"))


def contested(summary: DataFrame) -> DataFrame:
    """Spans with enough tasks, no dominant type and a second one that weighs."""
    return summary.where((F.col("total") >= MIN_TOTAL) & (F.col("top_share") < DOMINANT) & (F.col("second_share") >= SECOND))


def type_entropy(statistics: DataFrame) -> DataFrame:
    """Per span the entropy of its types in bits."""
    w = Window.partitionBy("span_lower")
    share = by_span(statistics).withColumn("p", F.col("n") / F.sum("n").over(w))
    return share.groupBy("span_lower").agg(F.round(F.sum(-F.col("p") * F.log2("p")), 6).alias("entropy"))


def zipf_table(rows: DataFrame) -> DataFrame:
    """word, zipf: log10 of a word's occurrences in 10^9 words of the texts."""
    words = rows.select(F.explode(F.regexp_extract_all(F.lower("input"), F.lit(r"[a-z]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = written(words)  # read twice, so that texts are read once
    total = words.agg(F.sum("n").alias("total"))
    return words.crossJoin(F.broadcast(total)).select("word", F.log10(F.lit(1e9) * F.col("n") / F.col("total")).alias("zipf"))  # total is one row


def frequency_scores(spans: DataFrame, zipf: DataFrame) -> DataFrame:
    """Per distinct lower-case span the mean Zipf value of its words; unknown words count 0."""
    low = spans.select(F.lower("span").alias("span_lower")).distinct()
    words = low.select("span_lower", F.explode(F.regexp_extract_all("span_lower", F.lit(r"[a-z]+"), F.lit(0))).alias("word"))
    return words.join(zipf, "word", "left").groupBy("span_lower").agg(F.avg(F.coalesce("zipf", F.lit(0.0))).alias("score"))


def low_information(statistics: DataFrame, scores: DataFrame, least: float = 4.0) -> DataFrame:
    """Spans of the statistics whose words are that frequent."""
    total = statistics.groupBy("span_lower").agg(F.sum("n").alias("total"))
    return total.join(scores.where(F.col("score") >= least), "span_lower").select("span_lower", "total", F.round("score", 6).alias("score"))


def lower_decisions(spans: DataFrame) -> DataFrame:
    return spans.where(~blank(F.col("span"))).select("task_id", F.lower(stripped(F.col("span"))).alias("span_lower"), "type").distinct()


def posterior_audit(decisions: DataFrame, summary: DataFrame, conventions: DataFrame) -> DataFrame:
    """Decisions that differ from their span's expected type: an active convention's, else the dominant one's; those that match an active
    convention never count."""
    active = conventions.where("status = 'active'").select("span_lower", F.col("type").alias("convention"))
    checked = prior_check(decisions, summary).join(active, "span_lower", "left")
    expected = F.coalesce("convention", "top_type")
    return checked.where((F.col("verdict") == "divergent") & (F.col("type") != expected)).select("task_id", "span_lower", "type", expected.alias("expected"), F.col("convention").isNotNull().alias("by_convention"))


def task_deviations(decisions: DataFrame, summary: DataFrame, conventions: DataFrame) -> DataFrame:
    """posterior_audit() of every task as its review shows it, with the span's total and the dominant type's share."""
    return posterior_audit(decisions, summary, conventions).join(summary.select("span_lower", "total", "top_share"), "span_lower")


def confirmed_tasks(checked: DataFrame) -> DataFrame:
    """Tasks of which no span diverges and at least one agrees."""
    per = checked.groupBy("task_id").agg(F.count_if(F.col("verdict") == "divergent").alias("bad"), F.count_if(F.col("verdict") == "agree").alias("good"))
    return per.where("bad = 0 and good > 0").select("task_id", "good")


def disagreement_messages(checked: DataFrame) -> DataFrame:
    """A line of feedback for each divergent decision, with the share as a whole percent, rounded down."""
    percent = F.floor(F.round(F.col("top_share") * 100, 6)).cast("int")
    return checked.where("verdict = 'divergent'").select("task_id", "span_lower", "type", F.format_string("'%s' is %s in %d%% of tasks, here %s", "span_lower", "top_type", percent, "type").alias("message"))


def contested_by_type(summary: DataFrame, type_name: str, ranks: int = 2) -> DataFrame:
    """Contested spans whose first, or first or second, type is the given one."""
    hit = F.col("top_type") == type_name
    if ranks > 1:
        hit = hit | (F.col("second_type") == type_name)
    return contested(summary).where(hit)


def contested_against_convention(summary: DataFrame, conventions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Contested spans with an active convention, and the tasks that decide otherwise."""
    active = conventions.where("status = 'active'").select("span_lower", F.col("type").alias("convention"))
    spans = contested(summary).select("span_lower").join(active, "span_lower")
    return decisions.join(spans, "span_lower").where("type <> convention").groupBy("span_lower", "convention").agg(F.countDistinct("task_id").alias("n_tasks"))


def first_divergence(checked: DataFrame) -> DataFrame:
    """The first divergent decision of each task, in order of span."""
    return checked.where("verdict = 'divergent'").groupBy("task_id").agg(F.min(F.struct("span_lower", "type", "top_type")).alias("f")).select("task_id", "f.*")


def statistics_delta(new: DataFrame, old: DataFrame) -> DataFrame:
    """Pairs whose counts differ between two statistics, 0 where one lacks the pair."""
    a, b = by_span(new).withColumnRenamed("n", "n_new"), by_span(old).withColumnRenamed("n", "n_old")
    both = a.join(b, SPAN_TYPE, "full_outer").select(*SPAN_TYPE, F.coalesce("n_new", F.lit(0)).alias("n_new"), F.coalesce("n_old", F.lit(0)).alias("n_old"))
    return both.where("n_new <> n_old")


def type_statistics(spans: DataFrame) -> DataFrame:
    """Per field and type: occurrences and distinct tasks."""
    return spans.groupBy("field", "type").agg(F.count("*").alias("n"), F.countDistinct("task_id").alias("n_tasks"))


def statistics_page(statistics: DataFrame, search: str, limit: int, offset: int = 0) -> DataFrame:
    """Whole distributions of the spans that hold the text or have a type that does, the most frequent first; one page."""
    counts = by_span(statistics)
    hits = counts.where(F.contains("span_lower", F.lit(search)) | F.contains("type", F.lit(search))).select("span_lower").distinct()
    totals = counts.join(hits, "span_lower", "left_semi").groupBy("span_lower").agg(F.sum("n").alias("total"))
    page = totals.orderBy(F.desc("total"), "span_lower").offset(offset).limit(limit)
    return counts.join(page, "span_lower").select("span_lower", "total", "type", "n")


def knowledge_fingerprint(statistics: DataFrame, conventions: DataFrame) -> DataFrame:
    """Rows and distinct spans of both tables."""
    one = statistics.agg(F.count("*").alias("n_statistics"), F.countDistinct("span_lower").alias("n_spans"), F.sum("n").alias("n_total"))
    two = conventions.agg(F.count("*").alias("n_conventions"), F.count_if(F.col("status") == "active").alias("n_active"))
    return one.crossJoin(two)  # one row each


def table_states(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per table (frame and time column) its rows and latest time: what a reader compares to see whether it is up to date."""
    out = None
    for name, (frame, time_col) in tables.items():
        one = frame.agg(F.count("*").alias("n"), F.max(time_col).alias("latest")).select(F.lit(name).alias("table_name"), "n", "latest")
        out = one if out is None else out.unionByName(one)
    return out
