"""Queries for workflow analytics and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanloom.fixtures import one_of
from spanloom.operators import parse, stats, workflow
from spanloom.operators.graph import shared_folder
from spanloom.plans.oracle import Registry
from spanloom.sources import tasks
from spanloom.streaming import live

R = Registry()
add = R.add

NOW, SINCE = "2024-01-20 00:00:00", "2024-01-15 00:00:00"


def streamed(t, df, schema, operator):
    """What a stream over files of df gives when it has read them all."""
    base = f"{shared_folder(t.spark)}/spanloom-{uuid.uuid4().hex}"
    df.write.json(f"{base}/in")
    for key, value in live.STATE_STORE.items():
        t.spark.conf.set(key, value)
    out = operator(live.row_stream(t.spark, f"{base}/in", schema))
    out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(out.schema).parquet(f"{base}/out")


def streamed_statistics(t):
    base = f"{shared_folder(t.spark)}/spanloom-{uuid.uuid4().hex}"
    stats.lower_decisions(t.spans).withColumn("ts", F.lit(NOW).cast("timestamp")).write.parquet(f"{base}/in")
    rows = t.spark.read.parquet(f"{base}/in")
    live.keep_statistics(t.spark.readStream.schema(rows.schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/state").awaitTermination()
    return live.read_statistics(t.spark, f"{base}/out")


#: States of each task: accepted with the first draft; rejected some time later, for some; accepted again with other spans, for some.
AGAIN, BACK = one_of("01234567", "concat(task_id, '|again')"), one_of("012345", "concat(task_id, '|back')")


def replaced(t):
    """The statistics that a stream of task states keeps, after two restarts and with a compaction between them."""
    base = f"{shared_folder(t.spark)}/spanloom-{uuid.uuid4().hex}"
    for key, value in live.STATE_STORE.items():
        t.spark.conf.set(key, value)
    decided = lambda spans: stats.lower_decisions(spans).groupBy("task_id").agg(F.collect_set(F.struct("span_lower", "type")).alias("decisions"))
    own = t.tasks.select("task_id", "project_id")
    first = own.join(decided(t.drafts.where("draft = 1")), "task_id", "left").withColumn("status", F.lit("accepted"))
    for version, states in enumerate([first, first.where(AGAIN).withColumn("status", F.lit("rejected")), own.where(BACK).join(decided(t.spans), "task_id", "left").withColumn("status", F.lit("accepted"))]):
        rows = states.select("task_id", F.lit(version).cast("long").alias("version"), "project_id", "status", "decisions")
        rows.write.mode("append").parquet(f"{base}/in")
        live.replace_statistics(t.spark.readStream.schema(rows.schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/state").awaitTermination()
        if version < 2:
            live.compact_statistics(t.spark, f"{base}/out")
    return live.replaced_statistics(t.spark, f"{base}/out")


def beats(t):
    """Heartbeats of runs, one for each user: their events, some of them twice."""
    own = t.source("events").select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("heartbeat_at"), "event_id")
    return own.unionByName(own.where("event_id % 5 = 0")).drop("event_id")


def stale(t, seconds, late):
    """Alerts of a stream that gets the heartbeats in three parts, in order of time but for late ones."""
    base = f"{shared_folder(t.spark)}/spanloom-{uuid.uuid4().hex}"
    for key, value in live.STATE_STORE.items():
        t.spark.conf.set(key, value)
    rows = beats(t)
    first, last = rows.agg(F.min(F.unix_millis("heartbeat_at")), F.max(F.unix_millis("heartbeat_at"))).first()
    # some heartbeats come as late as the watermark allows
    part = F.least(F.floor((F.unix_millis("heartbeat_at") + F.pmod(F.hash("run_id", "heartbeat_at"), F.lit(late * 1000 - 1)) - first) * 3 / (last + late * 1000 - first)), F.lit(2)).cast("int")
    for k in range(3):
        rows.where(part == k).write.mode("append").parquet(f"{base}/in")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        live.stale_alerts(stream, seconds, f"{late} seconds").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("run_id long, last_ms long").parquet(f"{base}/out")


def now():
    return F.lit(NOW).cast("timestamp")


MOVES = ", ".join(f"('{a}', '{b}')" for a, bs in workflow.ALLOWED.items() for b in bs)
STATUS = ", status AS (SELECT task_id, last(next_status ORDER BY seq) AS status, max(seq) AS seq FROM audit_events GROUP BY task_id)\n"
OPEN = "SELECT * FROM feedback WHERE feedback_id NOT IN (SELECT feedback_id FROM discussions WHERE consensus)"
EFF = ", eff AS (SELECT task_id, seq, kind, json_valid(regexp_extract(regexp_replace(payload, '(?is)<think>.*?</think>', '', 'g'), '(?s)\x7b.*\x7d')) AS usable FROM artifacts QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY (kind = 'human_review_answer') DESC, seq DESC) = 1)\n"
EXPORT = EFF + """, n AS (SELECT task_id, count(*) AS n_spans FROM spans ANTI JOIN row_masks USING (task_id, row_index) GROUP BY task_id),
export AS (SELECT task_id, project_id, seq, kind = 'human_review_answer' AS human, coalesce(n_spans, 0) AS n_spans, concat_ws(',', CASE WHEN kind IS NULL THEN 'missing_result' END, CASE WHEN NOT coalesce(usable, false) THEN 'missing_payload' END, CASE WHEN coalesce(n_spans, 0) = 0 THEN 'no_spans' END) AS errors FROM tasks LEFT JOIN eff USING (task_id) LEFT JOIN n USING (task_id) WHERE status = 'accepted')
"""


def event_tasks(t):
    return workflow.current_status(t.audit_events).select("task_id", "status", F.lit("p").alias("project_id"))


def exported(t):
    return workflow.export_rows(t.tasks, t.artifacts, t.spans, t.row_masks)


add("h01_board_columns", lambda t: workflow.board_columns(t.tasks), "SELECT CASE WHEN status IN ('pending', 'qc', 'arbitrating') THEN 'machine' WHEN status = 'human_review' THEN 'person' ELSE 'done' END AS board_column, status, count(*) AS n, min(task_id) AS first_task FROM tasks GROUP BY ALL")
add("h04_board", lambda t: workflow.board(t.tasks), "SELECT project_id, status, count(*) AS n FROM tasks GROUP BY ROLLUP (project_id, status)")
add(
    "h02_task_cards",
    lambda t: workflow.task_cards(event_tasks(t).select("task_id"), t.attempts, t.feedback),
    ", a AS (SELECT task_id, last(stage ORDER BY seq) AS stage, last(status ORDER BY seq) AS status, last(provider_id ORDER BY seq) AS provider_id, count(*) AS n_attempts FROM attempts GROUP BY task_id) SELECT a.*, coalesce(n, 0) AS n_feedback FROM a LEFT JOIN (SELECT task_id, count(*) AS n FROM feedback GROUP BY task_id) USING (task_id)",
)
add(
    "h03_provider_chains",
    lambda t: workflow.provider_chains(t.attempts),
    "SELECT task_id, concat_ws('->', last(provider_id ORDER BY seq) FILTER (stage = 'annotation'), last(provider_id ORDER BY seq) FILTER (stage = 'qc'), last(provider_id ORDER BY seq) FILTER (stage = 'arbitration')) AS chain FROM attempts GROUP BY task_id",
)
add("h05_throughput", lambda t: workflow.throughput(t.attempts, now(), 1440), f"SELECT stage, count(*) AS n, round(avg(dur_s), 6) AS mean_s FROM attempts WHERE status = 'succeeded' AND dur_s > 0 AND finished_at <= TIMESTAMP '{NOW}' AND finished_at > TIMESTAMP '{NOW}' - INTERVAL 1440 MINUTE GROUP BY stage")
add("h06_accepted_since", lambda t: workflow.accepted_since(t.audit_events, F.lit(SINCE).cast("timestamp")), f"SELECT count(*) AS n_accepted FROM audit_events WHERE next_status = 'accepted' AND ts >= TIMESTAMP '{SINCE}'")
HEALTH = """, per AS (SELECT task_id, last(next_status ORDER BY seq) AS status, count(*) FILTER (next_status = 'arbitrating') AS arb, count(*) FILTER (next_status = 'qc') AS qc FROM audit_events GROUP BY task_id),
health AS (SELECT count(*) AS n_tasks, count(*) FILTER (status = 'accepted') AS n_accepted, count(*) FILTER (status IN ('accepted', 'rejected')) AS n_terminal, count(*) FILTER (status = 'accepted' AND qc <= 1) AS n_first_pass, count(*) FILTER (arb > 0) AS n_arbitrated, (SELECT round(avg(n), 6) FROM (SELECT count(*) AS n FROM attempts WHERE dur_s > 0 GROUP BY task_id)) AS mean_calls FROM per)
"""
add("h07_health", lambda t: workflow.health(t.audit_events, t.attempts), HEALTH + "SELECT * FROM health")
add("h08_rates", lambda t: workflow.rates(workflow.health(t.audit_events, t.attempts)), HEALTH + "SELECT round(n_accepted / n_tasks, 6) AS accepted_rate, round(n_first_pass / n_tasks, 6) AS first_pass_rate, round(n_arbitrated / n_tasks, 6) AS arbitration_rate, n_tasks - n_terminal AS n_remaining FROM health")
add("h09_open_feedback", lambda t: workflow.open_feedback(t.feedback, t.discussions), OPEN)
add("h10_feedback_consensus", lambda t: workflow.feedback_consensus(t.feedback, t.discussions), "SELECT task_id, count(*) AS n_feedback, count(*) FILTER (feedback_id IN (SELECT feedback_id FROM discussions WHERE consensus)) AS n_settled, n_feedback = n_settled AS can_accept FROM feedback GROUP BY task_id")
add("h11_open_rounds", lambda t: workflow.open_rounds(t.feedback, t.discussions), f"SELECT task_id, count(DISTINCT attempt_no) AS n_rounds FROM ({OPEN}) GROUP BY task_id")
add(
    "h12_readiness",
    lambda t: workflow.readiness(t.tasks, exported(t).where("human"), t.artifacts.where("seq = 3").select("task_id")),
    EXPORT + """, x AS (SELECT project_id, count(*) AS n_tasks, count(*) FILTER (status = 'accepted') AS n_accepted, count(*) FILTER (status = 'accepted' AND task_id NOT IN (SELECT task_id FROM export WHERE human)) AS n_exportable, count(*) FILTER (status = 'human_review') AS n_review, count(*) FILTER (task_id IN (SELECT task_id FROM artifacts WHERE seq = 3)) AS n_open FROM tasks GROUP BY project_id)
SELECT *, CASE WHEN n_review > 0 THEN 'review' WHEN n_open > 0 THEN 'resolve_feedback' WHEN n_exportable > 0 THEN 'export' WHEN n_accepted < n_tasks THEN 'annotate' ELSE 'done' END AS next_action FROM x""",
)
add("h13_feedback_by_severity", lambda t: workflow.coordinator(t.tasks, t.feedback), "SELECT severity, count(*) AS n, count(DISTINCT task_id) AS n_tasks, round(count(*) / (SELECT count(*) FROM feedback), 6) AS share FROM feedback GROUP BY severity")
add(
    "h15_histogram",
    lambda t: workflow.histogram(t.audit_events, 24),
    "SELECT least(floor((epoch_us(ts) - lo) * 24 / (hi - lo)), 23)::INT AS bin, next_status, count(*) AS n FROM audit_events, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM audit_events) GROUP BY ALL",
)
REASONS = "SELECT task_id, seq, CASE previous_status WHEN 'qc' THEN 'disagreement' WHEN 'annotating' THEN 'uncertain' ELSE 'other' END AS reason FROM audit_events WHERE next_status = 'arbitrating' QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) = 1"
add("h16_review_reasons", lambda t: workflow.review_reasons(t.audit_events), REASONS)
add("h17_illegal_moves", lambda t: workflow.illegal_moves(t.audit_events, workflow.transitions(t.spark)), f"SELECT task_id, seq, previous_status, next_status, false AS broken FROM audit_events WHERE (previous_status, next_status) NOT IN (VALUES {MOVES})")
#: Events of which some are lost, so that others don't follow the status before.
GAPS = "event_id % 7 > 0"
add(
    "h17_broken_chains",
    lambda t: workflow.illegal_moves(t.audit_events.where(GAPS), workflow.transitions(t.spark)),
    f"SELECT * FROM (SELECT task_id, seq, previous_status, next_status, coalesce(lag(next_status) OVER (PARTITION BY task_id ORDER BY seq), 'draft') <> previous_status AS broken FROM audit_events WHERE {GAPS}) WHERE broken OR (previous_status, next_status) NOT IN (VALUES {MOVES})",
)
add("h18_current_status", lambda t: workflow.current_status(t.audit_events), STATUS + "SELECT * FROM status")
add(
    "h19_pruned_pairs",
    lambda t: workflow.pruned_pairs(t.audit_events, "annotating", "arbitrating").select("event_id", "task_id", "seq"),
    "SELECT event_id, task_id, seq FROM (SELECT *, lead(next_status) OVER w AS nx, lag(next_status) OVER w AS pv FROM audit_events WINDOW w AS (PARTITION BY task_id ORDER BY seq)) WHERE NOT ((next_status = 'annotating' AND coalesce(nx = 'arbitrating', false)) OR (next_status = 'arbitrating' AND coalesce(pv = 'annotating', false)))",
)
add("h20_version_in_force", lambda t: workflow.version_in_force(t.audit_events.select("event_id", "ts"), "ts", t.rules_versions).select("event_id", "version"), "SELECT event_id, version FROM audit_events e ASOF LEFT JOIN rules_versions v ON e.ts >= v.created_at")
add("h21_export_rows", exported, EXPORT + "SELECT * FROM export")
add("h22_exclusion_reasons", lambda t: exported(t).groupBy("errors").agg(F.count("*").alias("n")), EXPORT + "SELECT errors, count(*) AS n FROM export GROUP BY errors")
add("h23_manifest", lambda t: workflow.manifest(exported(t)), EXPORT + "SELECT project_id, count(*) FILTER (errors = '') AS n_included, count(*) FILTER (errors <> '') AS n_excluded, coalesce(sum(n_spans) FILTER (errors = ''), 0)::BIGINT AS n_spans FROM export GROUP BY project_id")
add("h24_back_counts", lambda t: workflow.back_counts(t.audit_events), ", b AS (SELECT task_id, count(*) FILTER (next_status = 'annotating') AS n_back FROM audit_events WHERE seq > 1 GROUP BY task_id) SELECT n_back, count(*) AS n_tasks, round(count(*) / (SELECT count(*) FROM b), 6) AS share FROM b GROUP BY n_back")
add(
    "h25_calls_per_accepted",
    lambda t: workflow.calls_per_accepted(t.audit_events, t.attempts),
    STATUS + ", p AS (SELECT task_id, count(*) AS n FROM attempts WHERE task_id IN (SELECT task_id FROM status WHERE status = 'accepted') GROUP BY task_id) SELECT round(avg(n), 6) AS mean_calls, min(n) AS least, max(n) AS most, round(avg((n <= 2)::INT), 6) AS upto_2, round(avg((n <= 4)::INT), 6) AS upto_4, round(avg((n <= 6)::INT), 6) AS upto_6 FROM p",
)
add("h26_arbitration_rate", lambda t: workflow.arbitration_rate(t.audit_events, t.attempts), "SELECT round(avg(a), 6) AS rate FROM (SELECT task_id, max((stage = 'arbitration')::INT) AS a FROM attempts GROUP BY task_id)")
add("h27_bail_rates", lambda t: workflow.bail_rates(t.source("events")), "SELECT round(avg((k > 0)::INT), 6) AS \"any\", round(avg((k >= 3)::INT), 6) AS from_3, round(avg((k >= 5)::INT), 6) AS from_5 FROM (SELECT coalesce(try_cast(json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.k') AS INT), 0) AS k FROM events)")
add("h28_failure_rates", lambda t: workflow.failure_rate(t.attempts), "SELECT stage, round(avg((status = 'failed')::INT), 6) AS rate FROM attempts GROUP BY stage")
add("h29_latency", lambda t: workflow.latency(t.attempts, 90.0), "SELECT stage, round(avg(dur_s), 6) AS mean_s, round(quantile_cont(dur_s, 0.5), 6) AS p50, round(quantile_cont(dur_s, 0.95), 6) AS p95, round(avg((dur_s >= 90)::INT), 6) AS slow_share FROM attempts GROUP BY stage")
add(
    "h30_backlog_change",
    lambda t: workflow.backlog_change(t.audit_events, now(), 1440),
    f", a AS (SELECT last(next_status ORDER BY seq) AS s FROM audit_events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY task_id), b AS (SELECT last(next_status ORDER BY seq) AS s FROM audit_events WHERE ts <= TIMESTAMP '{NOW}' - INTERVAL 1440 MINUTE GROUP BY task_id) SELECT (SELECT count(*) FROM a WHERE s = 'pending') AS n_now, (SELECT count(*) FROM b WHERE s = 'pending') AS n_then",
)
add(
    "h31_stale_runs",
    lambda t: workflow.stale_runs(t.audit_events, F.lit("2024-02-15 00:00:00").cast("timestamp"), 600),
    "SELECT task_id, last(next_status ORDER BY seq) AS status, (epoch(TIMESTAMP '2024-02-15 00:00:00') - floor(epoch(last(ts ORDER BY seq))))::BIGINT AS age_s FROM audit_events GROUP BY task_id HAVING status NOT IN ('accepted', 'rejected') AND age_s > 600",
)
add("h33_latest_accepted", lambda t: workflow.latest_rows(t.audit_events, "accepted", 20), "SELECT task_id, ts FROM audit_events WHERE next_status = 'accepted' QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) = 1 ORDER BY ts DESC, task_id LIMIT 20")
add("h34_rewind_plan", lambda t: workflow.rewind_plan(workflow.review_reasons(t.audit_events), {"disagreement": "qc", "uncertain": "pending"}), f"SELECT task_id, reason, CASE reason WHEN 'disagreement' THEN 'qc' ELSE 'pending' END AS target FROM ({REASONS}) WHERE reason <> 'other'")
add("t01_event_page", lambda t: workflow.event_page(t.audit_events, 50, 10), "SELECT event_id, task_id, ts, next_status FROM audit_events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 10")
add(
    "t03_feedback_bundles",
    lambda t: workflow.feedback_bundles(t.feedback, t.discussions),
    f"SELECT task_id, string_agg(feedback_id, ',' ORDER BY k) AS items FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY attempt_no DESC, feedback_id) AS k FROM ({OPEN})) WHERE k <= 3 GROUP BY task_id",
)
add(
    "t05_set_operations",
    lambda t: t.spans.select("type", "span").intersect(t.drafts.where("draft = 1").select("type", "span")),
    "SELECT type, span FROM spans INTERSECT SELECT type, span FROM drafts WHERE draft = 1",
)

for name, how in (("t05_gold_only", "subtract"), ("t05_predicted_only", "rsubtract")):
    add(
        name,
        lambda t, h=how: (lambda g, p: g.subtract(p) if h == "subtract" else p.subtract(g))(t.spans.select("type", "span"), t.drafts.where("draft = 1").select("type", "span")),
        "SELECT type, span FROM spans EXCEPT SELECT type, span FROM drafts WHERE draft = 1" if how == "subtract" else "SELECT type, span FROM drafts WHERE draft = 1 EXCEPT SELECT type, span FROM spans",
    )
add("t02_last_alerts", lambda t: workflow.last_alerts(t.alerts, 100), "SELECT line_no, json_extract_string(line, '$.kind') AS kind, json_extract_string(line, '$.task') AS task FROM (SELECT line_no, CASE WHEN json_valid(line) THEN line END AS line FROM (SELECT * FROM alerts ORDER BY line_no DESC LIMIT 100)) WHERE line IS NOT NULL")
SENT = "substr(md5(feedback_id), 1, 1) in ('0', '1', '2', '3', '4', '5')"
add(
    "t08_unsent_feedback",
    lambda t: workflow.unsent_feedback(t.feedback, t.discussions, t.feedback.where(SENT).groupBy("task_id").agg(F.collect_set("feedback_id").alias("ids"))),
    f"SELECT task_id, feedback_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY attempt_no DESC, feedback_id) AS k FROM ({OPEN})) WHERE k <= 3 AND NOT ({SENT})",
)
LATER = "2024-02-10 00:00:00"


def later():
    return F.lit(LATER).cast("timestamp")


def own_tasks(t):
    """Tasks of the event log, each in one of three projects."""
    return workflow.current_status(t.audit_events).select("task_id", "status", F.concat(F.lit("p"), (F.substring("task_id", 3, 9).cast("int") % 3).cast("string")).alias("project_id"))


def exported_ids(t):
    return t.leases.select("task_id").distinct()


OWN = STATUS + ", own AS (SELECT task_id, status, concat('p', (substr(task_id, 3)::INT % 3)::VARCHAR) AS project_id FROM status)\n"
add(
    "h02_detailed_cards",
    lambda t: workflow.detailed_cards(own_tasks(t), t.attempts, t.feedback, t.discussions.select("task_id"), later(), t.audit_events),
    OWN
    + f""", a AS (SELECT task_id, last(stage ORDER BY seq) AS stage, count(*) AS n_attempts, concat_ws('->', last(provider_id ORDER BY seq) FILTER (stage = 'annotation'), last(provider_id ORDER BY seq) FILTER (stage = 'qc'), last(provider_id ORDER BY seq) FILTER (stage = 'arbitration')) AS chain FROM attempts GROUP BY task_id),
s AS (SELECT task_id, stage, count(*) AS n_stage FROM attempts GROUP BY ALL), f AS (SELECT task_id, count(*) AS n_feedback, bool_or(severity = 'blocking') AS blocked FROM feedback GROUP BY task_id), d AS (SELECT task_id, count(*) AS n_rows FROM discussions GROUP BY task_id), e AS (SELECT task_id, max(ts) AS last_at FROM audit_events GROUP BY task_id)
SELECT task_id, status, a.stage, coalesce(chain, '') AS chain, coalesce(n_attempts, 0) AS n_attempts, coalesce(n_feedback, 0) AS n_feedback, coalesce(n_rows, 0) AS n_rows, coalesce(blocked, false) AS blocked, coalesce(n_stage, 0) > 1 AS retried, (epoch(TIMESTAMP '{LATER}') - floor(epoch(last_at)))::BIGINT AS age_s FROM own LEFT JOIN a USING (task_id) LEFT JOIN s ON s.task_id = own.task_id AND s.stage = a.stage LEFT JOIN f USING (task_id) LEFT JOIN d USING (task_id) LEFT JOIN e USING (task_id)""",
)
add(
    "h08_flow_rates",
    lambda t: workflow.flow_rates(t.audit_events, t.attempts, now(), 1440),
    f""", per AS (SELECT task_id, last(next_status ORDER BY seq) AS status, count(*) FILTER (next_status = 'qc') AS qc, count(*) FILTER (next_status = 'arbitrating') AS review FROM audit_events GROUP BY task_id),
r AS (SELECT (SELECT count(*) FROM audit_events WHERE next_status = 'accepted' AND ts > TIMESTAMP '{NOW}' - INTERVAL 1440 MINUTE AND ts <= TIMESTAMP '{NOW}') * 60.0::DOUBLE / 1440 AS rate)
SELECT round(count(*) FILTER (review > 0) / count(*), 6) AS review_rate, round(count(*) FILTER (status = 'rejected') / count(*), 6) AS rejection_rate, round(count(*) FILTER (status = 'accepted' AND qc <= 1) / count(*), 6) AS first_pass_rate, count(*) FILTER (status NOT IN ('accepted', 'rejected')) AS n_remaining, round(any_value(rate), 6) AS per_hour, CASE WHEN any_value(rate) > 0 THEN round(n_remaining / any_value(rate), 6) END AS eta_hours FROM per, r""",
)
STATES = """, f AS (SELECT task_id, count(*) FILTER (NOT s AND status NOT IN ('accepted', 'rejected')) AS n_open, count(*) FILTER (s) AS n_settled, count(*) FILTER (NOT s AND status IN ('accepted', 'rejected')) AS n_closed FROM (SELECT task_id, status, feedback_id IN (SELECT feedback_id FROM discussions WHERE consensus) AS s FROM feedback JOIN own USING (task_id)) GROUP BY task_id),
o AS (SELECT task_id, count(*) FILTER (status = 'pending') AS n_pending, count(*) FILTER (status = 'dead_letter') AS n_dead FROM outbox GROUP BY task_id)
"""
add(
    "h12_readiness_report",
    lambda t: workflow.readiness_report(own_tasks(t), exported_ids(t), t.feedback, t.discussions, t.outbox),
    OWN
    + STATES
    + """, x AS (SELECT project_id, count(*) AS n_tasks, count(*) FILTER (status = 'accepted') AS n_accepted, count(*) FILTER (status = 'accepted' AND task_id NOT IN (SELECT task_id FROM leases)) AS n_exportable, count(*) FILTER (status = 'human_review') AS n_review, coalesce(sum(n_open), 0)::BIGINT AS n_open, coalesce(sum(n_settled), 0)::BIGINT AS n_settled, coalesce(sum(n_closed), 0)::BIGINT AS n_closed, coalesce(sum(n_pending), 0)::BIGINT AS n_pending, coalesce(sum(n_dead), 0)::BIGINT AS n_dead FROM own LEFT JOIN f USING (task_id) LEFT JOIN o USING (task_id) GROUP BY project_id)
SELECT *, n_exportable > 0 AND n_review = 0 AND n_open = 0 AND n_dead = 0 AS ready, CASE WHEN n_review > 0 THEN 'review' WHEN n_open > 0 THEN 'resolve_feedback' WHEN n_dead > 0 THEN 'mend_outbox' WHEN n_exportable > 0 THEN 'export' WHEN n_accepted < n_tasks THEN 'annotate' ELSE 'done' END AS next_action FROM x""",
)
add(
    "h13_coordinator_report",
    lambda t: workflow.coordinator_report(own_tasks(t).withColumn("status", F.when(F.col("status") == "arbitrating", "human_review").otherwise(F.col("status"))), t.feedback, t.discussions, t.outbox),
    OWN
    + f""", mine AS (SELECT task_id, project_id, CASE WHEN status = 'arbitrating' THEN 'human_review' ELSE status END AS status FROM own), b AS (SELECT task_id, count(*) FILTER (severity = 'blocking') AS n_blocking, count(*) FILTER (severity = 'error') AS n_error, count(*) FILTER (severity = 'warning') AS n_warning FROM ({OPEN}) GROUP BY task_id), o AS (SELECT task_id, count(*) AS n_dead FROM outbox WHERE status = 'dead_letter' GROUP BY task_id),
j AS (SELECT * FROM mine LEFT JOIN b USING (task_id) LEFT JOIN o USING (task_id)),
x AS (SELECT project_id, count(*) AS n_tasks, count(*) FILTER (status = 'human_review') AS n_review, coalesce(array_to_string(list_sort(list(task_id) FILTER (status = 'human_review'))[1:5], ','), '') AS review_ids, coalesce(array_to_string(list_sort(list(task_id) FILTER (n_blocking > 0))[1:5], ','), '') AS blocked_ids, coalesce(sum(n_blocking), 0)::BIGINT AS n_blocking, coalesce(sum(n_error), 0)::BIGINT AS n_error, coalesce(sum(n_warning), 0)::BIGINT AS n_warning, coalesce(sum(n_dead), 0)::BIGINT AS n_dead FROM j GROUP BY project_id)
SELECT *, concat_ws(',', CASE WHEN n_blocking > 0 THEN 'settle_blocking' END, CASE WHEN n_review > 0 THEN 'review' END, CASE WHEN n_dead > 0 THEN 'mend_outbox' END, CASE WHEN n_error + n_warning > 0 THEN 'answer_feedback' END) AS actions FROM x""",
)
add("h14_outbox_summary", lambda t: workflow.outbox_summary(t.outbox), "SELECT count(*) FILTER (status = 'dead_letter') AS dead_letter, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'sent') AS sent FROM outbox")
add("h14_outbox_due", lambda t: workflow.outbox_due(t.outbox, now()), f"SELECT record_id, task_id, retry_count FROM outbox WHERE status = 'pending' AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '{NOW}')")
CLASSES = {"verbatim": "verbatim", "exhausted": "exhausted", "provider": "402", "uncertain": "uncertain"}
CLASSED = "SELECT task_id, seq, ts, reason, CASE WHEN contains(lower(reason), 'verbatim') THEN 'verbatim' WHEN contains(lower(reason), 'exhausted') THEN 'exhausted' WHEN contains(lower(reason), '402') THEN 'provider' WHEN contains(lower(reason), 'uncertain') THEN 'uncertain' ELSE 'other' END AS reason_class FROM reasons WHERE next_status = 'arbitrating' QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) = 1"
add("h16_classified_reasons", lambda t: workflow.classified_reasons(t.reasons, "arbitrating", CLASSES).select("task_id", "seq", "reason_class"), f"SELECT task_id, seq, reason_class FROM ({CLASSED})")
add(
    "h34_rewind_targets",
    lambda t: workflow.rewind_targets(workflow.classified_reasons(t.reasons, "arbitrating", CLASSES), {"verbatim": "annotating", "exhausted": "rejected", "provider": "pending"}, {"exhausted": "rounds,retries"}, F.lit(SINCE).cast("timestamp"), workflow.transitions(t.spark)),
    f"SELECT task_id, reason_class, CASE reason_class WHEN 'verbatim' THEN 'annotating' ELSE 'rejected' END AS target, CASE reason_class WHEN 'exhausted' THEN 'rounds,retries' ELSE '' END AS clear FROM ({CLASSED}) WHERE reason_class IN ('verbatim', 'exhausted') AND ts >= TIMESTAMP '{SINCE}'",
)


def dated_artifacts(t):
    return t.artifacts.withColumn("created_at", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(seq * 7)"))


TRAIN = """, best AS (SELECT task_id, kind, json_valid(regexp_extract(regexp_replace(payload, '(?is)<think>.*?</think>', '', 'g'), '(?s)\x7b.*\x7d')) AS usable, TIMESTAMP '2024-01-01 00:00:00' + to_days(seq * 7) AS created_at FROM artifacts QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY (kind = 'human_review_answer') DESC, seq DESC) = 1),
dated AS (SELECT b.*, v.version FROM best b ASOF LEFT JOIN rules_versions v ON b.created_at >= v.created_at), c AS (SELECT task_id, row_index, count(*) AS n FROM spans GROUP BY ALL), m AS (SELECT DISTINCT task_id, row_index, true AS masked FROM row_masks),
train AS (SELECT r.task_id, r.row_index, project_id, coalesce(n, 0) AS n_spans, coalesce(kind = 'human_review_answer', false) AS human, version AS rules_version, concat_ws(',', CASE WHEN kind IS NULL THEN 'missing_result' END, CASE WHEN kind IS NOT NULL AND NOT usable THEN 'missing_payload' END, CASE WHEN trim(input) = '' THEN 'empty_input' END, CASE WHEN coalesce(n, 0) = 0 THEN 'no_spans' END, CASE WHEN masked THEN 'masked' END) AS errors FROM src_rows r JOIN tasks t ON t.task_id = r.task_id AND status = 'accepted' LEFT JOIN dated d ON d.task_id = r.task_id LEFT JOIN c ON c.task_id = r.task_id AND c.row_index = r.row_index LEFT JOIN m ON m.task_id = r.task_id AND m.row_index = r.row_index)
"""


def trained(t):
    return workflow.training_rows(t.tasks, dated_artifacts(t), t.rows, t.spans, t.row_masks, t.rules_versions)


add("h21_training_rows", trained, TRAIN + "SELECT * FROM train")
add("h22_row_errors", lambda t: trained(t).where("errors <> ''").select("task_id", "row_index", F.explode(F.split("errors", ",")).alias("code")), TRAIN + "SELECT task_id, row_index, unnest(string_split(errors, ',')) AS code FROM train WHERE errors <> ''")
add(
    "h23_export_manifest",
    lambda t: workflow.export_manifest(trained(t)),
    TRAIN
    + "SELECT project_id, count(*) FILTER (errors = '') AS n_rows, count(DISTINCT task_id) FILTER (errors = '') AS n_tasks, count(*) FILTER (errors <> '') AS n_excluded, coalesce(string_agg(DISTINCT rules_version, ',' ORDER BY rules_version) FILTER (errors = ''), '') AS rules_versions, "
    + ", ".join(f"count(*) FILTER (list_contains(string_split(errors, ','), '{c}')) AS n_{c}" for c in ("missing_result", "missing_payload", "empty_input", "no_spans", "masked"))
    + " FROM train GROUP BY project_id",
)
add("h23_not_exported", lambda t: workflow.not_exported(t.tasks, t.artifacts.where("seq = 2").groupBy("seq").agg(F.collect_set("task_id").alias("included"))), "SELECT task_id FROM tasks WHERE status = 'accepted' AND task_id NOT IN (SELECT task_id FROM artifacts WHERE seq = 2)")
add("h25_first_round_passes", lambda t: workflow.first_round_passes(t.audit_events, t.attempts), STATUS + "SELECT count(*) AS n_accepted, count(*) FILTER (coalesce(n, 0) <= 1) AS n_first_round, round(n_first_round / n_accepted, 6) AS share FROM status LEFT JOIN (SELECT task_id, count(*) AS n FROM attempts WHERE stage = 'annotation' GROUP BY task_id) USING (task_id) WHERE status = 'accepted'")
FAILED = "case when dur_s > 80 then concat('{\"kind\": \"', case when dur_s > 90 then 'parse_failure' else 'timeout' end, '\"}') end"
add("h28_parse_failures", lambda t: workflow.parse_failures(t.attempts.withColumn("error", F.expr(FAILED)), "qc"), "SELECT count(*) AS n, count(*) FILTER (dur_s > 90) AS n_failed, round(n_failed / n, 6) AS rate FROM attempts WHERE stage = 'qc'")
add("h30_completed", lambda t: workflow.completed_between(t.audit_events, now(), 1440), f"SELECT count(DISTINCT task_id) FILTER (next_status IN ('accepted', 'rejected')) AS n_completed, count(DISTINCT task_id) FILTER (next_status = 'accepted') AS n_accepted FROM audit_events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 1440 MINUTE AND ts <= TIMESTAMP '{NOW}'")
add(
    "h31_liveness",
    lambda t: workflow.liveness(t.runs, t.leases, t.outbox, workflow.current_status(t.audit_events), later(), 600, 3),
    STATUS
    + f"""SELECT 'stale_run' AS rule, run_id::VARCHAR AS id FROM runs WHERE epoch(TIMESTAMP '{LATER}') - floor(epoch(heartbeat_at)) > 600 UNION ALL SELECT 'expired_lease', lease_id::VARCHAR FROM leases WHERE expires_at < TIMESTAMP '{LATER}'
UNION ALL SELECT 'run_without_lease', lease_id::VARCHAR FROM runs ANTI JOIN leases USING (lease_id) UNION ALL SELECT 'lease_without_run', lease_id::VARCHAR FROM leases ANTI JOIN runs USING (lease_id)
UNION ALL SELECT 'due_retry', record_id::VARCHAR FROM outbox WHERE status = 'pending' AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '{LATER}') UNION ALL SELECT 'backlog', status FROM status WHERE status NOT IN ('accepted', 'rejected') GROUP BY status HAVING count(*) > 3""",
)
add(
    "h32_reaped_leases",
    lambda t: workflow.reaped_leases(t.leases, workflow.current_status(t.audit_events), later()),
    STATUS + f"SELECT task_id, count(*) AS n_leases, any_value(status) AS previous_status, CASE WHEN any_value(status) = 'annotating' THEN 'pending' END AS next_status FROM leases JOIN status USING (task_id) WHERE expires_at < TIMESTAMP '{LATER}' GROUP BY task_id",
)

# --- sources ---------------------------------------------------------------------------------------------------------------


def batched(t):
    rows = t.documents.select("doc_id", "source", "lang")
    return tasks.batches(rows, 7, ["lang"], "doc_id")


BATCHED = ", c AS (SELECT doc_id, source, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 7 AS chunk, min(doc_id) OVER (PARTITION BY lang) AS first FROM documents), batched AS (SELECT *, dense_rank() OVER (ORDER BY first, chunk) - 1 AS task_no FROM c)\n"
add("a02_batches", lambda t: batched(t).select("doc_id", "task_no"), BATCHED + "SELECT doc_id, task_no FROM batched")
add(
    "a03_first_values",
    lambda t: tasks.task_attributes(batched(t).withColumn("modality", F.when(F.col("doc_id") % 3 > 0, F.concat("source", F.lit("!")))), "doc_id", "source", ("modality",)).select("task_no", "first_modality"),
    BATCHED + "SELECT task_no, first(concat(source, '!') ORDER BY doc_id) FILTER (doc_id % 3 > 0) AS first_modality FROM batched GROUP BY task_no",
)
OUTPUT = "case doc_id % 4 when 0 then '[1]' when 1 then 'none' when 2 then concat('{\"lang\": \"', lang, '\"}') else null end"
add(
    "a04_prelabelled",
    lambda t: tasks.prelabelled(t.documents.select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("input"), F.expr(OUTPUT).alias("output")), "doc_id", 10, 100),
    f"SELECT doc_id, source AS input, CASE WHEN doc_id % 4 = 2 THEN {OUTPUT} ELSE '{{}}' END AS output FROM documents WHERE doc_id % 5 > 0 ORDER BY doc_id LIMIT 100 OFFSET 10",
)
add("a03_task_attributes", lambda t: tasks.task_attributes(batched(t), "doc_id", "source"), BATCHED + "SELECT task_no, count(*) AS n_rows, min(doc_id) AS first_line, max(doc_id) AS last_line, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM batched GROUP BY task_no")
add("a04_import_collisions", lambda t: tasks.import_prelabelled(t.artifacts.select("task_id").distinct(), t.tasks.where("status = 'accepted'"), "task_id")[1], "SELECT DISTINCT task_id FROM artifacts WHERE task_id IN (SELECT task_id FROM tasks WHERE status = 'accepted')")
add(
    "a06_upsert_external",
    lambda t: tasks.upsert_external(t.tasks.select("task_id", F.col("status").alias("payload")), t.documents.select(F.col("source").alias("system"), F.col("doc_id").alias("item_id"), F.col("lang").alias("payload"))),
    "SELECT task_id, status AS payload FROM tasks UNION ALL SELECT concat('external-', substr(sha256(concat(source, ':', doc_id::VARCHAR)), 1, 16)), min(lang) FROM documents GROUP BY 1",
)
add("a09_scan", lambda t: tasks.scan(t.tasks, "p1", "accepted", t.artifacts.where("seq = 3")), "SELECT * FROM tasks WHERE project_id = 'p1' AND status = 'accepted' AND task_id IN (SELECT task_id FROM artifacts WHERE seq = 3)")
add(
    "a10_cascade_delete",
    lambda t: tasks.cascade_delete({"tasks": t.tasks, "spans": t.spans, "artifacts": t.artifacts}, t.tasks.where("project_id = 'p2'"))[1],
    "SELECT 'tasks' AS table_name, count(*) AS n_deleted FROM tasks WHERE project_id = 'p2' UNION ALL SELECT 'spans', count(*) FROM spans JOIN tasks USING (task_id) WHERE project_id = 'p2' UNION ALL SELECT 'artifacts', count(*) FROM artifacts JOIN tasks USING (task_id) WHERE project_id = 'p2'",
)
add(
    "a11_migrate",
    lambda t: tasks.migrate(t.tasks, parse.effective_annotation(t.artifacts), "v5"),
    EFF + ", g AS (SELECT task_id, concat('v5-', lpad((row_number() OVER (ORDER BY task_id))::VARCHAR, greatest(6, length((row_number() OVER (ORDER BY task_id))::VARCHAR))::INT, '0')) AS new_id FROM tasks JOIN eff USING (task_id) WHERE status = 'accepted' AND usable) SELECT task_id, new_id, CASE WHEN new_id IS NULL THEN 'no readable annotation' END AS error FROM tasks LEFT JOIN g USING (task_id) WHERE status = 'accepted'",
)
add(
    "a11_migrated_annotations",
    lambda t: tasks.migrate(t.tasks, parse.effective_annotation(t.artifacts, keep_payload=True), "v5").where("new_id is not null").select("task_id", "prelabel"),
    "SELECT task_id, payload AS prelabel FROM tasks JOIN (SELECT task_id, payload FROM artifacts QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY (kind = 'human_review_answer') DESC, seq DESC) = 1) USING (task_id) WHERE status = 'accepted' AND json_valid(regexp_extract(regexp_replace(payload, '(?is)<think>.*?</think>', '', 'g'), '(?s)\x7b.*\x7d'))",
)


def reread(t, df, schema, write, name=""):
    """What a sink wrote, read again as its source reads it."""
    path = f"{shared_folder(t.spark)}/spanloom-{uuid.uuid4().hex}"
    write(df, path)
    return tasks.read_jsonl(t.spark, f"{path}/{name}", schema)


add("a01_reread_rows", lambda t: reread(t, t.rows, "task_id string, row_index int, input string", tasks.write_training_data), "SELECT task_id, row_index, input FROM src_rows")
add("a08_reread_table", lambda t: reread(t, t.tasks, "task_id string, project_id string, status string", lambda df, path: tasks.write_tables({"tasks": df}, path), "tasks").select("task_id", "status"), "SELECT task_id, status FROM tasks")
add(
    "s01_streamed_rows",
    lambda t: streamed(t, t.rows, "task_id string, row_index int, input string", lambda s: s),
    "SELECT task_id, row_index, input FROM src_rows",
)
add(
    "s06_first_rows",
    lambda t: streamed(t, t.rows.withColumn("ts", F.lit(NOW).cast("timestamp")), "task_id string, row_index int, input string, ts timestamp", lambda s: live.first_rows(s, "ts")).groupBy("content_hash").agg(F.count("*").alias("n")),
    "SELECT DISTINCT sha256(input) AS content_hash, 1::BIGINT AS n FROM src_rows",
)
CONVENTIONS = "(select distinct lower(span) as span_lower, 'x' as type, 'active' as status from {spans} where substr(md5(span), 1, 2) = '00')"
add(
    "s07_convention_hits",
    lambda t: live.convention_hits(t.rows, t.sql("select * from " + CONVENTIONS, spans=t.spans)),
    ", conv AS (SELECT * FROM " + CONVENTIONS.format(spans="spans") + r"), w AS (SELECT DISTINCT task_id, row_index, unnest(regexp_extract_all(lower(input), '[\p{L}\p{N}_]+')) AS word FROM src_rows) SELECT span_lower, task_id, row_index, type AS convention FROM w JOIN conv ON regexp_extract(span_lower, '[\p{L}\p{N}_]+') = word JOIN src_rows r USING (task_id, row_index) WHERE span_lower = word OR (contains(lower(input), span_lower) AND regexp_matches(concat(' ', lower(input), ' '), concat('[^\p{L}\p{N}_]', regexp_escape(span_lower), '[^\p{L}\p{N}_]')))",
)
add(
    "s09_event_histogram",
    lambda t: live.event_histogram(t.audit_events, "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "next_status", "n"),
    "SELECT date_trunc('day', ts) AS start, next_status, count(*) AS n FROM audit_events GROUP BY ALL",
)
add(
    "s03_status_changes",
    lambda t: streamed(t, t.audit_events.select("task_id", "seq", "previous_status", "next_status"), "task_id string, seq long, previous_status string, next_status string", lambda s: live.status_changes(s, [(a, b) for a, bs in workflow.ALLOWED.items() for b in bs])),
    f"SELECT task_id, seq, previous_status, next_status, (previous_status, next_status) IN (VALUES {MOVES}) AS legal, true AS chained FROM audit_events",
)
add(
    "s03_broken_chains",
    lambda t: streamed(t, t.audit_events.where(GAPS).select("task_id", "seq", "previous_status", "next_status"), "task_id string, seq long, previous_status string, next_status string", lambda s: live.status_changes(s, [(a, b) for a, bs in workflow.ALLOWED.items() for b in bs])),
    f"SELECT task_id, seq, previous_status, next_status, (previous_status, next_status) IN (VALUES {MOVES}) AS legal, coalesce(lag(next_status) OVER (PARTITION BY task_id ORDER BY seq), 'draft') = previous_status AS chained FROM audit_events WHERE {GAPS}",
)
add(
    "s05_streamed_statistics",
    lambda t: streamed_statistics(t),
    "SELECT span_lower, type, count(*) AS n FROM (SELECT DISTINCT task_id, lower(span) AS span_lower, type FROM spans) GROUP BY ALL",
)
DECIDED = "(SELECT task_id, lower(trim(span)) AS span_lower, type FROM {} WHERE trim(span) <> '' GROUP BY ALL)"
add(
    "s05_replaced_statistics",
    lambda t: replaced(t),
    f""", first AS (SELECT * FROM {DECIDED.format("(SELECT * FROM drafts WHERE draft = 1)")}), last AS (SELECT * FROM {DECIDED.format("spans")}),
kept AS (SELECT * FROM first WHERE NOT {AGAIN} AND NOT {BACK} UNION ALL SELECT * FROM last WHERE {BACK})
SELECT project_id, span_lower, type, count(*) AS n FROM kept JOIN tasks USING (task_id) GROUP BY ALL""",
)
add(
    "s04_stale_alerts",
    lambda t: stale(t, 20_000, 3_000),
    """, beats AS (SELECT DISTINCT user_id AS run_id, epoch_us(ts) // 1000 AS ms FROM events), gaps AS (SELECT *, lead(ms) OVER (PARTITION BY run_id ORDER BY ms) AS following FROM beats)
SELECT run_id, ms AS last_ms FROM gaps WHERE (following IS NULL OR following > ms + 20000000) AND ms + 20000000 <= (SELECT max(ms) FROM beats) - 3000000""",
)
add(
    "s02_throughput_windows",
    lambda t: live.throughput(t.attempts, "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "stage", "n"),
    "SELECT date_trunc('day', finished_at) AS start, stage, count(*) AS n FROM attempts WHERE status = 'succeeded' AND dur_s > 0 GROUP BY ALL",
)
add(
    "s08_sessions",
    lambda t: live.sessions(t.attempts, "6 hours").select("task_id", F.col("start").cast("timestamp_ntz").alias("start"), "n"),
    "SELECT task_id, min(finished_at) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY task_id ORDER BY finished_at, seq) AS s FROM (SELECT *, CASE WHEN finished_at - lag(finished_at) OVER (PARTITION BY task_id ORDER BY finished_at, seq) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM attempts)) GROUP BY task_id, s",
)
