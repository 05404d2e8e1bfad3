"""Workflow analytics: boards, throughput, health, feedback, readiness, the state machine, and the rules in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The moves that the task state machine allows in these tables, in natural order.
ALLOWED = {
    "draft": ["pending"],
    "pending": ["annotating", "rejected"],
    "annotating": ["qc", "pending", "arbitrating"],
    "qc": ["accepted", "annotating", "arbitrating"],
    "arbitrating": ["accepted", "rejected", "annotating", "human_review"],
    "human_review": ["accepted", "rejected", "annotating"],
}
TERMINAL = ("accepted", "rejected")


def transitions(spark) -> DataFrame:
    rows = [(a, b) for a, bs in ALLOWED.items() for b in bs]
    return spark.createDataFrame(rows, "previous_status string, next_status string")


def board(tasks: DataFrame) -> DataFrame:
    """Tasks per project and status, per project, and over all (null stands for all)."""
    return tasks.rollup("project_id", "status").agg(F.count("*").alias("n"))


def board_columns(tasks: DataFrame) -> DataFrame:
    """Tasks by who has to act next and status, with the first of each."""
    column = F.when(F.col("status").isin("pending", "annotating", "qc", "arbitrating"), "machine").when(F.col("status") == "human_review", "person").otherwise("done")
    return tasks.groupBy(column.alias("board_column"), "status").agg(F.count("*").alias("n"), F.min("task_id").alias("first_task"))


def task_cards(tasks: DataFrame, attempts: DataFrame, feedback: DataFrame) -> DataFrame:
    """Per task with attempts: its latest one, attempts and feedback counted."""
    last = attempts.groupBy("task_id").agg(F.max_by(F.struct("stage", "status", "provider_id"), "seq").alias("l"), F.count("*").alias("n_attempts"))
    notes = feedback.groupBy("task_id").agg(F.count("*").alias("n_feedback"))
    return tasks.join(last, "task_id").join(notes, "task_id", "left").select("task_id", "l.stage", "l.status", "l.provider_id", "n_attempts", F.coalesce("n_feedback", F.lit(0)).alias("n_feedback"))


def provider_chains(attempts: DataFrame, stages: tuple[str, ...] = ("annotation", "qc", "arbitration")) -> DataFrame:
    """Per task the last provider of each stage, joined by ->; stages without one are left out."""
    last = attempts.groupBy("task_id").agg(*(F.max_by("provider_id", F.when(F.col("stage") == s, F.col("seq"))).alias(s) for s in stages))
    return last.select("task_id", F.concat_ws("->", *stages).alias("chain"))


def throughput(attempts: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Succeeded attempts per stage in the minutes before now, and their mean duration; those that took no time don't count."""
    recent = attempts.where((F.col("status") == "succeeded") & (F.col("dur_s") > 0) & (F.col("finished_at") <= now) & (F.col("finished_at") > now - F.make_dt_interval(mins=F.lit(minutes))))
    return recent.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg("dur_s"), 6).alias("mean_s"))


def accepted_since(events: DataFrame, since: Column) -> DataFrame:
    return events.where((F.col("next_status") == "accepted") & (F.col("ts") >= since)).agg(F.count("*").alias("n_accepted"))


def health(events: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row: tasks, accepted, terminal, accepted at their first QC, arbitrated, and mean attempts of tasks that have any."""
    per = events.groupBy("task_id").agg(F.max_by("next_status", "seq").alias("status"), F.count_if(F.col("next_status") == "arbitrating").alias("arb"), F.count_if(F.col("next_status") == "qc").alias("qc"))
    one = per.agg(
        F.count("*").alias("n_tasks"), F.count_if(F.col("status") == "accepted").alias("n_accepted"), F.count_if(F.col("status").isin(*TERMINAL)).alias("n_terminal"),
        F.count_if((F.col("status") == "accepted") & (F.col("qc") <= 1)).alias("n_first_pass"), F.count_if(F.col("arb") > 0).alias("n_arbitrated"),
    )
    calls = attempts.where("dur_s > 0").groupBy("task_id").agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 6).alias("mean_calls"))
    return one.crossJoin(calls)  # one row each


def rates(health_row: DataFrame) -> DataFrame:
    share = lambda c: F.when(F.col("n_tasks") > 0, F.round(F.col(c) / F.col("n_tasks"), 6))
    return health_row.select(share("n_accepted").alias("accepted_rate"), share("n_first_pass").alias("first_pass_rate"), share("n_arbitrated").alias("arbitration_rate"), (F.col("n_tasks") - F.col("n_terminal")).alias("n_remaining"))


def open_feedback(feedback: DataFrame, discussions: DataFrame) -> DataFrame:
    """Feedback without an entry that settles it."""
    return feedback.join(discussions.where("consensus").select("feedback_id"), "feedback_id", "left_anti")


def feedback_consensus(feedback: DataFrame, discussions: DataFrame) -> DataFrame:
    """Per task: feedback, settled, and whether all is settled."""
    settled = discussions.where("consensus").select("feedback_id").distinct().withColumn("done", F.lit(1))
    per = feedback.join(settled, "feedback_id", "left").groupBy("task_id").agg(F.count("*").alias("n_feedback"), F.count("done").alias("n_settled"))
    return per.withColumn("can_accept", F.col("n_feedback") == F.col("n_settled"))


def open_rounds(feedback: DataFrame, discussions: DataFrame) -> DataFrame:
    """Per task the distinct attempts with open feedback."""
    return open_feedback(feedback, discussions).groupBy("task_id").agg(F.countDistinct("attempt_no").alias("n_rounds"))


def readiness(tasks: DataFrame, exported: DataFrame, open_tasks: DataFrame) -> DataFrame:
    """Per project: tasks, accepted, not yet exported, with blockers, and the next action by priority."""
    joined = tasks.join(exported.select("task_id", F.lit(True).alias("out")), "task_id", "left").join(open_tasks.select("task_id", F.lit(True).alias("open")).distinct(), "task_id", "left")
    accepted = F.col("status") == "accepted"
    per = joined.groupBy("project_id").agg(F.count("*").alias("n_tasks"), F.count_if(accepted).alias("n_accepted"), F.count_if(accepted & F.col("out").isNull()).alias("n_exportable"), F.count_if(F.col("status") == "human_review").alias("n_review"), F.count_if(F.col("open").isNotNull()).alias("n_open"))
    action = F.when(F.col("n_review") > 0, "review").when(F.col("n_open") > 0, "resolve_feedback").when(F.col("n_exportable") > 0, "export").when(F.col("n_accepted") < F.col("n_tasks"), "annotate").otherwise("done")
    return per.withColumn("next_action", action)


def coordinator(tasks: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback by severity, with the share of all and the tasks it touches."""
    per = feedback.groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("task_id").alias("n_tasks"))
    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # a row per severity


def histogram(events: DataFrame, bins: int) -> DataFrame:
    """Events per bin and status in equal bins between the first and the last."""
    bounds = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("low"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("high"))
    at = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.col("low")) * bins / (F.col("high") - F.col("low"))), F.lit(bins - 1))).cast("int")
    return events.crossJoin(F.broadcast(bounds)).groupBy(at.alias("bin"), "next_status").agg(F.count("*").alias("n"))  # bounds is one row


def review_reasons(events: DataFrame, status: str = "arbitrating") -> DataFrame:
    """The latest event that moved each task into a status, and where it came from."""
    w = Window.partitionBy("task_id").orderBy(F.desc("seq"))
    last = events.where(F.col("next_status") == status).withColumn("k", F.row_number().over(w)).where("k = 1")
    reason = F.when(F.col("previous_status") == "qc", "disagreement").when(F.col("previous_status") == "annotating", "uncertain").otherwise("other")
    return last.select("task_id", "seq", reason.alias("reason"))


def illegal_moves(events: DataFrame, allowed: DataFrame) -> DataFrame:
    """Events whose move isn't allowed, or whose previous status isn't the one the event before left."""
    before = F.lag("next_status").over(Window.partitionBy("task_id").orderBy("seq"))
    chained = events.withColumn("broken", F.coalesce(before, F.lit("draft")) != F.col("previous_status"))
    marked = chained.join(allowed.withColumn("ok", F.lit(True)), ["previous_status", "next_status"], "left")
    return marked.where(F.col("broken") | F.col("ok").isNull()).select("task_id", "seq", "previous_status", "next_status", "broken")


def current_status(events: DataFrame, at: Column | None = None) -> DataFrame:
    """Each task's status by its last event, or by the last one up to a time."""
    own = events if at is None else events.where(F.col("ts") <= at)
    return own.groupBy("task_id").agg(F.max_by("next_status", "seq").alias("status"), F.max("seq").alias("seq"))


def pruned_pairs(events: DataFrame, start: str, recovery: str) -> DataFrame:
    """Events without the pairs of a start that a recovery follows at once."""
    w = Window.partitionBy("task_id").orderBy("seq")
    after, before = F.lead("next_status").over(w), F.lag("next_status").over(w)
    is_pair = ((F.col("next_status") == start) & F.coalesce(after == recovery, F.lit(False))) | ((F.col("next_status") == recovery) & F.coalesce(before == start, F.lit(False)))
    return events.withColumn("pair", is_pair).where("not pair").drop("pair")


def version_in_force(facts: DataFrame, time_col: str, versions: DataFrame) -> DataFrame:
    """facts with version: the last one created up to their time, null before the first.

    Each version stands for the days from its creation to the next one's, so that facts meet versions in an equi-join on the day; there are
    no more such rows than days and versions together.
    """
    last = facts.agg(F.max(F.col(time_col).cast("timestamp")).alias("newest"))
    until = F.lead("created_at").over(Window.orderBy("created_at", "version"))  # a row for each version
    spans = versions.select("version", F.col("created_at").alias("since"), until.alias("until")).where("until is null or until > since").crossJoin(last)  # one row
    day = lambda t: F.floor(F.unix_seconds(t.cast("timestamp")) / 86400)
    stop = F.coalesce(F.col("until").cast("timestamp"), F.greatest("newest", F.col("since").cast("timestamp")))
    days = spans.select("version", "since", "until", F.explode(F.sequence(day(F.col("since")), day(stop))).alias("__day"))
    t = F.col(time_col)
    dated = facts.withColumn("__day", day(t)).alias("f").join(days.alias("v"), (F.col("f.__day") == F.col("v.__day")) & (t >= F.col("since")) & (F.col("until").isNull() | (t < F.col("until"))), "left")
    return dated.select(*(F.col(f"f.`{c}`") for c in facts.columns), F.col("v.version").alias("version"))


def latest_version(versions: DataFrame) -> DataFrame:
    return versions.agg(F.max_by("version", F.struct("created_at", "version")).alias("version"))


def back_counts(events: DataFrame, status: str = "annotating") -> DataFrame:
    """How often tasks return to a status: tasks by number of returns, with their share."""
    back = events.where(F.col("seq") > 1).groupBy("task_id").agg(F.count_if(F.col("next_status") == status).alias("n_back"))
    dist = back.groupBy("n_back").agg(F.count("*").alias("n_tasks"))
    return dist.withColumn("share", F.round(F.col("n_tasks") / F.sum("n_tasks").over(Window.partitionBy()), 6))  # a row per number


def calls_per_accepted(events: DataFrame, attempts: DataFrame) -> DataFrame:
    """Attempts of accepted tasks: mean, least, most, and shares with up to 2, 4 and 6."""
    accepted = current_status(events).where("status = 'accepted'").select("task_id")
    per = attempts.join(accepted, "task_id", "left_semi").groupBy("task_id").agg(F.count("*").alias("n"))
    upto = lambda k: F.round(F.avg((F.col("n") <= k).cast("double")), 6).alias(f"upto_{k}")
    return per.agg(F.round(F.avg("n"), 6).alias("mean_calls"), F.min("n").alias("least"), F.max("n").alias("most"), upto(2), upto(4), upto(6))


def arbitration_rate(events: DataFrame, attempts: DataFrame) -> DataFrame:
    tasks = events.select("task_id").distinct()
    hit = tasks.join(attempts.where("stage = 'arbitration'").select("task_id").distinct().withColumn("arb", F.lit(1.0)), "task_id", "left")
    return hit.agg(F.round(F.avg(F.coalesce("arb", F.lit(0.0))), 6).alias("rate"))


def bail_rates(events: DataFrame, metadata: str = "props", key: str = "$.k") -> DataFrame:
    """Shares of rows whose metadata number is above 0, from 3 and from 5 on; rows without one count as 0."""
    n = F.coalesce(F.get_json_object(metadata, key).try_cast("int"), F.lit(0))
    share = lambda c, name: F.round(F.avg(c.cast("double")), 6).alias(name)
    return events.agg(share(n > 0, "any"), share(n >= 3, "from_3"), share(n >= 5, "from_5"))


def failure_rate(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("stage").agg(F.round(F.avg((F.col("status") == "failed").cast("double")), 6).alias("rate"))


def latency(attempts: DataFrame, limit: float) -> DataFrame:
    """Per stage: mean, median and 95th percentile of durations, and the share from a limit on."""
    return attempts.groupBy("stage").agg(
        F.round(F.avg("dur_s"), 6).alias("mean_s"), F.round(F.percentile("dur_s", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("dur_s", F.lit(0.95)), 6).alias("p95"), F.round(F.avg((F.col("dur_s") >= limit).cast("double")), 6).alias("slow_share")
    )


def backlog_change(events: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Tasks pending now and minutes ago."""
    then = now - F.make_dt_interval(mins=F.lit(minutes))
    count = lambda at, name: current_status(events, at).agg(F.count_if(F.col("status") == "pending").alias(name))
    return count(now, "n_now").crossJoin(count(then, "n_then"))  # one row each


def stale_runs(events: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Tasks in work whose last event is older than that."""
    last = events.groupBy("task_id").agg(F.max_by("next_status", "seq").alias("status"), F.max_by("ts", "seq").alias("at"))
    age = F.unix_seconds(now) - F.unix_seconds(F.col("at").cast("timestamp"))
    return last.where(~F.col("status").isin(*TERMINAL)).withColumn("age_s", age).where(F.col("age_s") > seconds).select("task_id", "status", "age_s")


def latest_rows(events: DataFrame, status: str, n: int) -> DataFrame:
    """The n tasks that reached a status last."""
    return current_status(events.where(F.col("next_status") == status)).join(events.select("task_id", "seq", "ts"), ["task_id", "seq"]).orderBy(F.desc("ts"), "task_id").limit(n).select("task_id", "ts")


def rewind_plan(reasons: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Where each task goes back to by its reason; reasons without a target stay."""
    to = F.element_at(F.create_map(*(F.lit(x) for kv in targets.items() for x in kv)), F.col("reason"))
    return reasons.select("task_id", "reason", to.alias("target")).where("target is not null")


def export_rows(tasks: DataFrame, artifacts: DataFrame, spans: DataFrame, masks: DataFrame) -> DataFrame:
    """Accepted tasks with what an export needs: chosen answer, unmasked spans, whether a person wrote it, and why it is excluded."""
    from spanloom.operators.parse import effective_annotation, without_masked

    counts = without_masked(spans, masks).groupBy("task_id").agg(F.count("*").alias("n_spans"))
    rows = tasks.where("status = 'accepted'").select("task_id", "project_id").join(effective_annotation(artifacts), "task_id", "left").join(counts, "task_id", "left")
    n = F.coalesce("n_spans", F.lit(0))
    errors = F.array_compact(F.array(F.when(F.col("kind").isNull(), "missing_result"), F.when(~F.coalesce("usable", F.lit(False)), "missing_payload"), F.when(n == 0, "no_spans")))
    return rows.select("task_id", "project_id", "seq", (F.col("kind") == "human_review_answer").alias("human"), n.alias("n_spans"), F.array_join(errors, ",").alias("errors"))


def manifest(exported: DataFrame) -> DataFrame:
    """Per project: rows in and out, and spans exported."""
    return exported.groupBy("project_id").agg(F.count_if(F.col("errors") == "").alias("n_included"), F.count_if(F.col("errors") != "").alias("n_excluded"), F.sum(F.when(F.col("errors") == "", F.col("n_spans")).otherwise(0)).alias("n_spans"))


def event_page(events: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Events newest first, one page."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).offset(offset).limit(limit).select("event_id", "task_id", "ts", "next_status")


def feedback_bundles(feedback: DataFrame, discussions: DataFrame, last: int = 3) -> DataFrame:
    """Per task its last open feedback items, ids in order, newest first."""
    w = Window.partitionBy("task_id").orderBy(F.desc("attempt_no"), "feedback_id")
    top = open_feedback(feedback, discussions).withColumn("k", F.row_number().over(w)).where(F.col("k") <= last)
    return top.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "feedback_id"))), lambda x: x.feedback_id), ",").alias("items"))


def detailed_cards(tasks: DataFrame, attempts: DataFrame, feedback: DataFrame, rows: DataFrame, now: Column, since: DataFrame) -> DataFrame:
    """task_cards() of tasks (task_id, project_id, status) with the last provider of each stage, rows, flags and age: blocked and retried tell of
    blocking feedback and of more than one attempt of the last stage; age counts seconds since the task's last event (task_id, ts)."""
    last = attempts.groupBy("task_id").agg(F.max_by(F.struct("stage", "status"), "seq").alias("l"), F.count("*").alias("n_attempts"))
    runs = attempts.groupBy("task_id", "stage").agg(F.count("*").alias("n_stage"))
    notes = feedback.groupBy("task_id").agg(F.count("*").alias("n_feedback"), F.count_if(F.col("severity") == "blocking").alias("n_blocking"))
    seen = since.groupBy("task_id").agg(F.max("ts").alias("at"))
    n_rows = rows.groupBy("task_id").agg(F.count("*").alias("n_rows"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = tasks.join(last, "task_id", "left").join(provider_chains(attempts), "task_id", "left").join(notes, "task_id", "left").join(n_rows, "task_id", "left").join(seen, "task_id", "left")
    out = out.withColumn("stage", F.col("l.stage")).join(runs, ["task_id", "stage"], "left")
    age = F.unix_seconds(now) - F.unix_seconds(F.col("at").cast("timestamp"))
    return out.select("task_id", "status", "stage", F.coalesce("chain", F.lit("")).alias("chain"), zero("n_attempts"), zero("n_feedback"), zero("n_rows"), (F.coalesce("n_blocking", F.lit(0)) > 0).alias("blocked"), (F.coalesce("n_stage", F.lit(0)) > 1).alias("retried"), age.alias("age_s"))


def flow_rates(events: DataFrame, attempts: DataFrame, now: Column, minutes: int) -> DataFrame:
    """One row: shares of tasks that were ever in review, that ended rejected, that passed at first; what is left; accepted per hour in the last
    minutes; and the hours that the rest takes at that rate, null where nothing was accepted."""
    per = events.groupBy("task_id").agg(F.max_by("next_status", "seq").alias("status"), F.count_if(F.col("next_status") == "qc").alias("qc"), F.count_if(F.col("next_status") == "arbitrating").alias("review"))
    n = F.count("*")
    one = per.agg(F.round(F.count_if(F.col("review") > 0) / n, 6).alias("review_rate"), F.round(F.count_if(F.col("status") == "rejected") / n, 6).alias("rejection_rate"), F.round(F.count_if((F.col("status") == "accepted") & (F.col("qc") <= 1)) / n, 6).alias("first_pass_rate"), F.count_if(~F.col("status").isin(*TERMINAL)).alias("n_remaining"))
    since = now - F.make_dt_interval(mins=F.lit(minutes))
    done = events.where((F.col("next_status") == "accepted") & (F.col("ts") > since) & (F.col("ts") <= now)).agg(F.count("*").alias("n_done"))
    rate = F.col("n_done") * 60.0 / minutes
    return one.crossJoin(done).withColumn("per_hour", F.round(rate, 6)).withColumn("eta_hours", F.when(rate > 0, F.round(F.col("n_remaining") / rate, 6))).drop("n_done")  # one row each


def readiness_report(tasks: DataFrame, exported: DataFrame, feedback: DataFrame, discussions: DataFrame, outbox: DataFrame) -> DataFrame:
    """Per project: tasks, accepted, exportable (accepted and not exported), in review, feedback by state (open; settled by consensus; closed: open
    but of a terminal task), pending and dead outbox records, whether all is ready, and the next action by priority."""
    settled = discussions.where("consensus").select("feedback_id").distinct().withColumn("done", F.lit(True))
    states = feedback.join(settled, "feedback_id", "left").join(tasks.select("task_id", "status"), "task_id").groupBy("task_id").agg(
        F.count_if(F.col("done").isNull() & ~F.col("status").isin(*TERMINAL)).alias("n_open"), F.count_if(F.col("done").isNotNull()).alias("n_settled"), F.count_if(F.col("done").isNull() & F.col("status").isin(*TERMINAL)).alias("n_closed")
    )
    sent = outbox.groupBy("task_id").agg(F.count_if(F.col("status") == "pending").alias("n_pending"), F.count_if(F.col("status") == "dead_letter").alias("n_dead"))
    joined = tasks.join(exported.select("task_id", F.lit(True).alias("out")).distinct(), "task_id", "left").join(states, "task_id", "left").join(sent, "task_id", "left")
    accepted = F.col("status") == "accepted"
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_open", "n_settled", "n_closed", "n_pending", "n_dead")]
    per = joined.groupBy("project_id").agg(F.count("*").alias("n_tasks"), F.count_if(accepted).alias("n_accepted"), F.count_if(accepted & F.col("out").isNull()).alias("n_exportable"), F.count_if(F.col("status") == "human_review").alias("n_review"), *sums)
    ready = (F.col("n_exportable") > 0) & (F.col("n_review") == 0) & (F.col("n_open") == 0) & (F.col("n_dead") == 0)
    action = F.when(F.col("n_review") > 0, "review").when(F.col("n_open") > 0, "resolve_feedback").when(F.col("n_dead") > 0, "mend_outbox").when(F.col("n_exportable") > 0, "export").when(F.col("n_accepted") < F.col("n_tasks"), "annotate").otherwise("done")
    return per.withColumn("ready", ready).withColumn("next_action", action)


def coordinator_report(tasks: DataFrame, feedback: DataFrame, discussions: DataFrame, outbox: DataFrame, ids: int = 5) -> DataFrame:
    """Per project: tasks by state, the first ids of those in review and of those with open blocking feedback, open feedback by severity, and the
    actions that follow, most urgent first."""
    blocking = open_feedback(feedback, discussions).groupBy("task_id").agg(*(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("blocking", "error", "warning")))
    dead = outbox.where("status = 'dead_letter'").groupBy("task_id").agg(F.count("*").alias("n_dead"))
    joined = tasks.join(blocking, "task_id", "left").join(dead, "task_id", "left")

    def first(own: DataFrame, name: str) -> DataFrame:  # a rank limit, which each task applies before the shuffle
        ranked = own.select("project_id", "task_id").withColumn("k", F.row_number().over(Window.partitionBy("project_id").orderBy("task_id"))).where(F.col("k") <= ids)
        return ranked.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "task_id"))), lambda x: x.task_id), ",").alias(name))

    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_blocking", "n_error", "n_warning", "n_dead")]
    per = joined.groupBy("project_id").agg(F.count("*").alias("n_tasks"), F.count_if(F.col("status") == "human_review").alias("n_review"), *sums)
    for own, name in ((joined.where("status = 'human_review'"), "review_ids"), (joined.where("n_blocking > 0"), "blocked_ids")):
        per = per.join(first(own, name), "project_id", "left").withColumn(name, F.coalesce(name, F.lit("")))
    actions = F.array(F.when(F.col("n_blocking") > 0, "settle_blocking"), F.when(F.col("n_review") > 0, "review"), F.when(F.col("n_dead") > 0, "mend_outbox"), F.when(F.col("n_error") + F.col("n_warning") > 0, "answer_feedback"))
    return per.withColumn("actions", F.array_join(F.array_compact(actions), ","))


def outbox_summary(outbox: DataFrame) -> DataFrame:
    """Records by status; statuses without any count 0."""
    return outbox.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("dead_letter", "pending", "sent")))


def outbox_due(outbox: DataFrame, at: Column) -> DataFrame:
    """Pending records to send by then: those without a time to retry, or whose time has come."""
    return outbox.where((F.col("status") == "pending") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= at))).select("record_id", "task_id", "retry_count")


def reaped_leases(leases: DataFrame, statuses: DataFrame, now: Column) -> DataFrame:
    """Tasks of expired leases: how many expire, and next_status, pending for a task that was being annotated; others resume where they are."""
    expired = leases.where(F.col("expires_at") < now).groupBy("task_id").agg(F.count("*").alias("n_leases"))
    return expired.join(statuses.select("task_id", "status"), "task_id").select("task_id", "n_leases", F.col("status").alias("previous_status"), F.when(F.col("status") == "annotating", "pending").alias("next_status"))


def liveness(runs: DataFrame, leases: DataFrame, outbox: DataFrame, statuses: DataFrame, now: Column, seconds: int, backlog: int) -> DataFrame:
    """rule, id: stale runs by heartbeat, expired leases, runs without a lease and leases without a run, retries that are due, and statuses with
    more tasks than the backlog allows."""
    row = lambda df, rule, c: df.select(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("id"))
    both = runs.select("lease_id", F.lit(True).alias("run")).join(leases.select("lease_id", F.lit(True).alias("lease")), "lease_id", "full_outer")
    full = statuses.where(~F.col("status").isin(*TERMINAL)).groupBy("status").agg(F.count("*").alias("n")).where(F.col("n") > backlog)
    parts = [
        row(runs.where(F.unix_seconds(now) - F.unix_seconds(F.col("heartbeat_at").cast("timestamp")) > seconds), "stale_run", "run_id"), row(leases.where(F.col("expires_at") < now), "expired_lease", "lease_id"),
        row(both.where("lease is null"), "run_without_lease", "lease_id"), row(both.where("run is null"), "lease_without_run", "lease_id"), row(outbox_due(outbox, now), "due_retry", "record_id"), row(full, "backlog", "status"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def last_alerts(lines: DataFrame, n: int) -> DataFrame:
    """The last n lines (line_no, line) of an alert log, newest first, n clamped to 1..500: those that are JSON objects, with kind and task."""
    last = lines.orderBy(F.desc("line_no")).limit(max(1, min(500, n)))
    read = F.from_json("line", "struct<kind: string, task: string>", {"mode": "PERMISSIVE"})
    return last.where(F.try_parse_json("line").isNotNull()).select("line_no", read.alias("a")).select("line_no", "a.kind", "a.task")


def unsent_feedback(feedback: DataFrame, discussions: DataFrame, sent: DataFrame, last: int = 3) -> DataFrame:
    """Items of the tasks' feedback bundles that the annotator hasn't got yet. sent: task_id, ids array<string>."""
    items = feedback_bundles(feedback, discussions, last).select("task_id", F.explode(F.split("items", ",")).alias("feedback_id"))
    return items.join(sent.select("task_id", F.explode("ids").alias("feedback_id")), ["task_id", "feedback_id"], "left_anti")


def classified_reasons(events: DataFrame, status: str, classes: dict[str, str]) -> DataFrame:
    """The latest event that moved each task into a status, and the first class whose text its reason holds, whatever the case."""
    last = events.where(F.col("next_status") == status).groupBy("task_id").agg(F.max_by(F.struct("seq", "ts", "reason"), "seq").alias("l")).select("task_id", "l.*")
    kind = F.coalesce(*(F.when(F.contains(F.lower("reason"), F.lit(text)), F.lit(name)) for name, text in classes.items()), F.lit("other"))
    return last.withColumn("reason_class", kind)


def rewind_targets(reasons: DataFrame, targets: dict[str, str], clear: dict[str, str], since: Column | None = None, allowed: DataFrame | None = None, status: str = "arbitrating") -> DataFrame:
    """Where each task goes back to by its reason_class, and the metadata keys to clear there; from a time on, and only by allowed moves."""
    pick = lambda m: F.element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), F.col("reason_class"))
    own = reasons if since is None else reasons.where(F.col("ts") >= since)
    out = own.select("task_id", "reason_class", pick(targets).alias("target"), F.coalesce(pick(clear), F.lit("")).alias("clear")).where("target is not null")
    if allowed is not None:
        out = out.join(allowed.where(F.col("previous_status") == status).select(F.col("next_status").alias("target")), "target", "left_semi")
    return out.select("task_id", "reason_class", "target", "clear")


def training_rows(tasks: DataFrame, artifacts: DataFrame, rows: DataFrame, spans: DataFrame, masks: DataFrame, versions: DataFrame) -> DataFrame:
    """Rows of accepted tasks as they are exported: task_id, row_index, n_spans, human, rules_version (in force when the answer was made), and
    errors: the codes missing_result, missing_payload, empty_input, no_spans and masked that keep a row out. artifacts carry created_at."""
    from spanloom.operators.parse import readable

    rank = F.when(F.col("kind") == "human_review_answer", 1).otherwise(0)
    best = artifacts.groupBy("task_id").agg(F.max_by(F.struct("kind", "payload", "created_at"), F.struct(rank, F.col("seq"))).alias("b")).select("task_id", "b.kind", readable(F.col("b.payload")).alias("usable"), "b.created_at")
    dated = version_in_force(best, "created_at", versions.select("version", F.col("created_at").alias("v_at")).withColumnRenamed("v_at", "created_at"))
    counts = spans.groupBy("task_id", "row_index").agg(F.count("*").alias("n_spans"))
    own = rows.join(tasks.where("status = 'accepted'").select("task_id", "project_id"), "task_id").join(dated, "task_id", "left").join(counts, ["task_id", "row_index"], "left")
    own = own.join(masks.select("task_id", "row_index", F.lit(True).alias("masked")).distinct(), ["task_id", "row_index"], "left")
    n = F.coalesce("n_spans", F.lit(0))
    codes = F.array(F.when(F.col("kind").isNull(), "missing_result"), F.when(F.col("kind").isNotNull() & ~F.col("usable"), "missing_payload"), F.when(F.coalesce(F.trim("input"), F.lit("")) == "", "empty_input"), F.when(n == 0, "no_spans"), F.when(F.col("masked"), "masked"))
    return own.select("task_id", "row_index", "project_id", n.alias("n_spans"), F.coalesce(F.col("kind") == "human_review_answer", F.lit(False)).alias("human"), F.col("version").alias("rules_version"), F.array_join(F.array_compact(codes), ",").alias("errors"))


def export_manifest(exported: DataFrame) -> DataFrame:
    """Per project: rows and tasks in, rows out, the rules versions of what goes in, and out-rows by error code."""
    good = F.col("errors") == ""
    code = lambda c: F.count_if(F.array_contains(F.split("errors", ","), c)).alias(f"n_{c}")
    return exported.groupBy("project_id").agg(
        F.count_if(good).alias("n_rows"), F.countDistinct(F.when(good, F.col("task_id"))).alias("n_tasks"), F.count_if(~good).alias("n_excluded"), F.array_join(F.sort_array(F.collect_set(F.when(good, F.col("rules_version")))), ",").alias("rules_versions"),
        *(code(c) for c in ("missing_result", "missing_payload", "empty_input", "no_spans", "masked")),
    )


def not_exported(tasks: DataFrame, manifests: DataFrame) -> DataFrame:
    """Accepted tasks that no manifest (included array<string>) holds."""
    return tasks.where("status = 'accepted'").select("task_id").join(manifests.select(F.explode("included").alias("task_id")), "task_id", "left_anti")


def first_round_passes(events: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row: accepted tasks, those accepted after one annotation attempt, and their share."""
    accepted = current_status(events).where("status = 'accepted'").select("task_id")
    tries = attempts.where("stage = 'annotation'").groupBy("task_id").agg(F.count("*").alias("n"))
    one = accepted.join(tries, "task_id", "left").agg(F.count("*").alias("n_accepted"), F.count_if(F.coalesce("n", F.lit(0)) <= 1).alias("n_first_round"))
    return one.withColumn("share", F.when(F.col("n_accepted") > 0, F.round(F.col("n_first_round") / F.col("n_accepted"), 6)))


def parse_failures(attempts: DataFrame, stage: str, error_col: str = "error") -> DataFrame:
    """One row: attempts of a stage, those whose error (JSON) has kind parse_failure, and their share."""
    kind = F.get_json_object(error_col, "$.kind")
    one = attempts.where(F.col("stage") == stage).agg(F.count("*").alias("n"), F.count_if(kind == "parse_failure").alias("n_failed"))
    return one.withColumn("rate", F.when(F.col("n") > 0, F.round(F.col("n_failed") / F.col("n"), 6)))


def completed_between(events: DataFrame, now: Column, minutes: int) -> DataFrame:
    """One row: distinct tasks that reached a terminal status in the minutes before now, and those accepted."""
    since = now - F.make_dt_interval(mins=F.lit(minutes))
    own = events.where((F.col("ts") > since) & (F.col("ts") <= now))
    return own.agg(F.countDistinct(F.when(F.col("next_status").isin(*TERMINAL), F.col("task_id"))).alias("n_completed"), F.countDistinct(F.when(F.col("next_status") == "accepted", F.col("task_id"))).alias("n_accepted"))
