"""Annotation tables derived from the driver's tables by md5 rules, for Spark and, as common table expressions, for DuckDB.

The driver's tables hold no annotations. These rules give both engines the same tasks, spans, drafts, events and so on, skewed enough
to have settled, contested and cold spans, and with defects of every kind. Text written once serves both engines; {name} stands for a table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.graph import written
from spanloom.operators.parse import rebuild_payload
from spanloom.sources.tasks import dealt

#: Six digits at least, and ids beyond them whole.
TASK = "concat('doc-', lpad(cast(doc_id as string), cast(greatest(6, length(cast(doc_id as string))) as int), '0'))"
FIRST = "substr(md5({}), 1, 1)"


def one_of(chars: str, value: str, at: int = 1) -> str:
    return f"instr('{chars}', substr(md5({value}), {at}, 1)) > 0"


#: Spans of one word, or of two where the second begins with a to m.
RAW = "[A-Z][a-z]+(?: [a-m][a-z]+)?"

#: A span's type follows from its text and task, for some from its place as well, so that a row may hold it under two types.
SPANS = f"""select task_id, row_index, pos,
 case when {one_of("0123456789ab", "lower(raw)", 3)} then 'entities' else 'json_structures' end as field,
 case when {one_of("01", "concat(task_id, '|', lower(raw))")} or ({one_of("0123", "lower(raw)", 2)} and {one_of("01234567", "concat(task_id, '|', lower(raw))")}) or {FIRST.format("concat(task_id, '|', cast(row_index as string), '|', cast(pos as string))")} = '0' then 'other'
  else concat('type', {FIRST.format("lower(raw)")}) end as type,
 case {FIRST.format("concat(task_id, '|', cast(row_index as string), '|', raw, '|', 'v')")} when '0' then concat(raw, 'X') when '1' then concat(raw, '.') when '2' then replace(raw, ' ', '  ')
  when '3' then case when {FIRST.format("concat(raw, 'r')")} = '0' then '[redacted]' when {FIRST.format("concat(raw, 'r')")} = '1' then 'XXXX' else upper(raw) end else raw end as span
from {{raw_spans}}"""

TASKS = f"""select {TASK} as task_id, concat('p', cast(doc_id % 3 as string)) as project_id,
 case when {one_of("0123456789", TASK)} then 'accepted' when {one_of("ab", TASK)} then 'rejected' when {FIRST.format(TASK)} = 'c' then 'human_review'
  when {FIRST.format(TASK)} = 'd' then 'pending' when {FIRST.format(TASK)} = 'e' then 'qc' else 'arbitrating' end as status
from {{documents}}"""

ROW_MASKS = f"select task_id, row_index from {{src_rows}} where {FIRST.format("concat('m', '|', task_id, '|', cast(row_index as string))")} = '0'"

THREE = "(select 1 as k union all select 2 union all select 3)"

DRAFTS = f"""select draft, task_id, row_index, field, span, case when substr(h, 1, 1) = '3' then 'other' else type end as type
from (select k as draft, s.*, md5(concat(cast(k as string), '|', task_id, '|', cast(row_index as string), '|', span)) as h from {{spans}} s cross join {THREE} n) x
where instr('012', substr(h, 1, 1)) = 0"""

JUDGE_FAILURES = f"""select pass, id, span, case when c in ('0', '2') then 1 else 0 end as fp_delta, case when c in ('1', '2') then 1 else 0 end as fn_delta
from (select k as pass, concat(task_id, ':', cast(row_index as string)) as id, span, {FIRST.format("concat(cast(k as string), '|', 'j', '|', task_id, '|', span)")} as c from {{spans}} cross join {THREE} n) x
where c in ('0', '1', '2')"""

AUDIT_EVENTS = """select task_id, seq, coalesce(lag(next_status) over (partition by task_id order by seq), 'draft') as previous_status, next_status, ts, event_id
from (select event_id, ts, concat('u-', cast(user_id as string)) as task_id, row_number() over (partition by user_id order by ts, event_id) as seq,
 case event_type when 'view' then 'annotating' when 'click' then 'qc' when 'purchase' then 'accepted' when 'signup' then 'pending' else 'arbitrating' end as next_status from {events}) x"""

ATTEMPTS = """select concat('u-', cast(user_id as string)) as task_id, row_number() over (partition by user_id order by ts, event_id) as seq,
 case when event_type in ('view', 'signup') then 'annotation' when event_type = 'click' then 'qc' else 'arbitration' end as stage,
 case when event_type = 'error' then 'failed' else 'succeeded' end as status, ts as finished_at, value as dur_s, concat('m', cast(event_id % 4 as string)) as provider_id from {events}"""

FEEDBACK = f"""select concat('f-', cast(conv_id as string), '-', cast(turn as string)) as feedback_id, concat('u-', cast(conv_id % 150 as string)) as task_id, turn as attempt_no,
 case {FIRST.format("text")} when '0' then 'blocking' when '1' then 'warning' else 'error' end as severity, text as message from {{conversations}} where role = 'user'"""

DISCUSSIONS = f"""select concat('f-', cast(conv_id as string), '-', cast(turn - 1 as string)) as feedback_id, concat('u-', cast(conv_id % 150 as string)) as task_id,
 {one_of("01234567", "text")} as consensus, text as message from {{conversations}} where role = 'assistant'"""

RULES_VERSIONS = "select 'v1' as version, timestamp '2024-01-01 00:00:00' as created_at union all select 'v2', timestamp '2024-01-08 00:00:00' union all select 'v3', timestamp '2024-01-20 12:00:00'"

#: Up to three annotations and a human answer for each task: some bare, some in a fence after thoughts, some between sentences; some don't parse, some hold no rows.
ARTIFACTS = f"""select * from (select task_id, cast(k as int) as seq, case when k = 3 and {one_of("0123", "concat(task_id, 'h')")} then 'human_review_answer' else 'annotation_result' end as kind,
 case when {one_of("01", "concat(task_id, '|', cast(k as string))")} then '{{{{broken' when {one_of("2", "concat(task_id, '|', cast(k as string))")} then '{{{{"rows": []}}}}'
  when {one_of("345", "concat(task_id, '|', cast(k as string))")} then concat('<think>', cast(k as string), ' {{{{rows}}}} at most</think>', chr(10), '```json', chr(10), '{{{{"rows": [{{{{"row_index": ', cast(k as string), ', "output": {{{{"entities": {{{{"type1": ["a"]}}}}}}}}}}}}]}}}}', chr(10), '```')
  when {one_of("67", "concat(task_id, '|', cast(k as string))")} then concat('Sure! {{{{"rows": [{{{{"row_index": ', cast(k as string), '}}}}]}}}} Done.')
  when {one_of("8", "concat(task_id, '|', cast(k as string))")} then ''
  else concat('{{{{"rows": [{{{{"row_index": 0, "output": {{{{"entities": {{{{"type2": ["', cast(k as string), '"]}}}}}}}}}}}}]}}}}') end as payload from {{tasks}} cross join {THREE} n) x
where seq = 1 or {one_of("456789abcdef", "concat(task_id, '|', cast(seq as string), '|', 'a')")}"""

#: Proposals of a type for a span, in order within the span.
PROPOSALS = f"""select span_lower, row_number() over (partition by span_lower order by task_id, row_index, pos) as seq, type, task_id,
 case when {FIRST.format("concat(task_id, span_lower)")} = '0' then 'declared:operator' when {FIRST.format("concat(task_id, span_lower)")} in ('1', '2', '3') then 'arbiter_correction' else 'qc_consensus' end as source
from (select lower(span) as span_lower, type, task_id, row_index, pos from {{spans}}) x where {one_of("01234567", "concat(span_lower, task_id, 'p')")}"""

OUTBOX = """select event_id as record_id, concat('u-', cast(user_id as string)) as task_id, case event_type when 'purchase' then 'sent' when 'error' then 'dead_letter' else 'pending' end as status,
 cast(event_id % 5 as int) as retry_count, case when event_id % 3 = 0 then null else ts + interval '1' hour end as next_retry_at from {events}"""

LEASES = """select event_id as lease_id, concat('u-', cast(user_id as string)) as task_id, ts + interval '20' day as expires_at from {events} where event_id % 7 = 0"""

RUNS = """select event_id as run_id, concat('u-', cast(user_id as string)) as task_id, case when event_id % 2 = 0 then event_id else -event_id end as lease_id, ts as heartbeat_at from {events} where event_id % 7 in (0, 1)"""

#: Lines of an alert log; some aren't JSON.
ALERTS = """select event_id as line_no, case when event_id % 11 = 0 then 'not json' else concat('{{"kind": "', event_type, '", "task": "u-', cast(user_id as string), '"}}') end as line from {events}"""

#: Why tasks went to review, in words.
REASONS = """select task_id, seq, previous_status, next_status, ts, event_id, case event_id % 5 when 0 then 'arbiter uncertain about 3 rows' when 1 then 'Verbatim violation in row 2' when 2 then 'retries exhausted after 4 rounds' when 3 then 'provider error 402' else 'operator asked' end as reason from {audit_events}"""

ROWS_DUCK = f"select {TASK} as task_id, (i - 1)::int as row_index, l[i] as input from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, chr(10)) as l from documents))"
RAW_SPANS_DUCK = "select task_id, row_index, (i - 1)::int as pos, l[i] as raw from (select task_id, row_index, l, unnest(range(1, len(l) + 1)) as i from (select task_id, row_index, regexp_extract_all(input, '[A-Z][a-z]+(?: [a-m][a-z]+)?') as l from src_rows))"


class Tables:
    """The derived tables of one directory, each a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **tables: DataFrame) -> DataFrame:
        return self.spark.sql(text, **tables)

    @property
    def documents(self) -> DataFrame:
        return dealt(self.source("documents"))

    @property
    def rows(self) -> DataFrame:
        return self.documents.select(F.expr(TASK).alias("task_id"), F.posexplode(F.split("text", "\\n")).alias("row_index", "input"))

    @property
    def raw_spans(self) -> DataFrame:
        return self.rows.select("task_id", "row_index", F.posexplode(F.regexp_extract_all("input", F.lit(RAW), F.lit(0))).alias("pos", "raw"))

    @property
    def spans(self) -> DataFrame:
        return self.sql(SPANS, raw_spans=self.raw_spans)

    @property
    def tasks(self) -> DataFrame:
        return self.sql(TASKS, documents=self.documents)

    @property
    def row_masks(self) -> DataFrame:
        return self.sql(ROW_MASKS, src_rows=self.rows)

    @property
    def drafts(self) -> DataFrame:
        return self.sql(DRAFTS, spans=self.spans)

    @property
    def judge_failures(self) -> DataFrame:
        return self.sql(JUDGE_FAILURES, spans=self.spans)

    @property
    def audit_events(self) -> DataFrame:
        return self.sql(AUDIT_EVENTS, events=self.source("events"))

    @property
    def attempts(self) -> DataFrame:
        return self.sql(ATTEMPTS, events=self.source("events"))

    @property
    def feedback(self) -> DataFrame:
        return self.sql(FEEDBACK, conversations=self.source("conversations"))

    @property
    def discussions(self) -> DataFrame:
        return self.sql(DISCUSSIONS, conversations=self.source("conversations"))

    @property
    def rules_versions(self) -> DataFrame:
        return self.sql(RULES_VERSIONS)

    @property
    def artifacts(self) -> DataFrame:
        return self.sql(ARTIFACTS, tasks=self.tasks)

    @property
    def proposals(self) -> DataFrame:
        return self.sql(PROPOSALS, spans=self.spans)

    @property
    def outbox(self) -> DataFrame:
        return self.sql(OUTBOX, events=self.source("events"))

    @property
    def leases(self) -> DataFrame:
        return self.sql(LEASES, events=self.source("events"))

    @property
    def runs(self) -> DataFrame:
        return self.sql(RUNS, events=self.source("events"))

    @property
    def alerts(self) -> DataFrame:
        return self.sql(ALERTS, events=self.source("events"))

    @property
    def reasons(self) -> DataFrame:
        return self.sql(REASONS, audit_events=self.audit_events)

    @property
    def payloads(self) -> DataFrame:
        """task_id and the model text of its annotation: some bare, some in a fence after thoughts, some between sentences, some broken."""
        made = rebuild_payload(self.spans)
        kind = F.substring(F.md5(F.concat("task_id", F.lit("|wrap"))), 1, 1)
        fenced = F.concat(F.lit("<think>two {rows} at most</think>\n```json\n"), "payload", F.lit("\n```"))
        text = F.when(kind.isin("0", "1", "2"), fenced).when(kind.isin("3", "4", "5"), F.concat(F.lit("Sure! "), "payload", F.lit(" Done."))).when(kind == "6", F.lit('{"rows": [')).otherwise(F.col("payload"))
        return made.select("task_id", text.alias("payload"))

    @property
    def sources(self) -> DataFrame:
        """task_id and its rows as they were imported; some without an index."""
        index = F.when(F.substring(F.md5(F.concat_ws("|", "task_id", F.col("row_index").cast("string"), F.lit("i"))), 1, 1) != "0", F.col("row_index") + 100)
        return self.rows.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(F.col("row_index").alias("at"), index.alias("row_index"), "input"))).alias("rows")).select("task_id", F.transform("rows", lambda r: F.struct(r.row_index.alias("row_index"), r.input.alias("input"))).alias("rows"))

    @property
    def type_enum(self) -> DataFrame:
        field = F.explode(F.when(F.col("n") < 6, F.array(F.lit("entities"))).when(F.col("n") < 10, F.array(F.lit("entities"), F.lit("json_structures"))).otherwise(F.array(F.lit("json_structures"))))
        types = self.spark.range(16).select(F.col("id").alias("n"), F.concat(F.lit("type"), F.lower(F.hex("id"))).alias("type"))
        others = self.spark.range(1).select(F.explode(F.array(F.lit("entities"), F.lit("json_structures"))).alias("field"), F.lit("other").alias("type"))
        return types.select(field.alias("field"), "type").unionByName(others)


class HeldTables(Tables):
    """Tables whose spans are derived once and written, for queries that read them several times."""

    @cached_property
    def spans(self) -> DataFrame:
        return written(super().spans)


def held(t: Tables) -> HeldTables:
    return HeldTables(t.spark, t.sf_dir)


def duckdb_tables() -> str:
    """WITH ... of all derived tables, to put before a query."""
    same = {n: n for n in ("raw_spans", "src_rows", "spans", "tasks", "documents", "events", "conversations", "audit_events")}
    parts = {
        "src_rows": ROWS_DUCK,
        "raw_spans": RAW_SPANS_DUCK,
        "spans": SPANS.format(**same),
        "tasks": TASKS.format(**same),
        "row_masks": ROW_MASKS.format(**same),
        "drafts": DRAFTS.format(**same),
        "judge_failures": JUDGE_FAILURES.format(**same),
        "audit_events": AUDIT_EVENTS.format(**same),
        "attempts": ATTEMPTS.format(**same),
        "feedback": FEEDBACK.format(**same),
        "discussions": DISCUSSIONS.format(**same),
        "rules_versions": RULES_VERSIONS,
        "outbox": OUTBOX.format(**same),
        "leases": LEASES.format(**same),
        "runs": RUNS.format(**same),
        "alerts": ALERTS.format(**same),
        "reasons": REASONS.format(**same),
        "artifacts": ARTIFACTS.format(**same),
        "proposals": PROPOSALS.format(**same),
        "type_enum": "select unnest(case when n < 6 then ['entities'] when n < 10 then ['entities', 'json_structures'] else ['json_structures'] end) as field, concat('type', substr('0123456789abcdef', n + 1, 1)) as type from (select unnest(range(16))::int as n) x union all select 'entities', 'other' union all select 'json_structures', 'other'",
    }
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({text})" for name, text in parts.items())
