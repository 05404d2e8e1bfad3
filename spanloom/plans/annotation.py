"""Queries for parsing, defects, statistics, conventions and consensus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.fixtures import held, one_of
from spanloom.functions.text import first_tokens, snippet, without_thoughts
from spanloom.operators import consensus, conventions, defects, parse, similarity, stats
from spanloom.operators.graph import written
from spanloom.plans.oracle import Registry
from spanloom.sources import registry

R = Registry()
add = R.add

WS = r"'[ \t\n\x0B\f\r]+'"

# --- parsing ---------------------------------------------------------------------------------------------------------------

add(
    "b03_effective_annotation",
    lambda t: parse.effective_annotation(t.artifacts),
    "SELECT task_id, seq, kind, json_valid(regexp_extract(regexp_replace(payload, '(?is)<think>.*?</think>', '', 'g'), '(?s)\x7b.*\x7d')) AS usable FROM artifacts QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY (kind = 'human_review_answer') DESC, seq DESC) = 1",
)
add(
    "b03b_last_readable_annotation",
    lambda t: parse.last_readable_annotation(t.artifacts),
    "SELECT task_id, seq, kind FROM (SELECT *, json_valid(regexp_extract(regexp_replace(payload, '(?is)<think>.*?</think>', '', 'g'), '(?s)\x7b.*\x7d')) AS can FROM artifacts WHERE kind = 'human_review_answer' OR json_valid(regexp_extract(regexp_replace(payload, '(?is)<think>.*?</think>', '', 'g'), '(?s)\x7b.*\x7d')) QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY (kind = 'human_review_answer') DESC, seq DESC) = 1) WHERE can",
)
add(
    "b01_model_text",
    lambda t: t.rows.select("task_id", "row_index", without_thoughts(F.concat(F.lit("<think>"), "task_id", F.lit("\nso</think>\n```json\n"), "input", F.lit("\n```\n"))).alias("text")),
    r"SELECT task_id, row_index, regexp_replace(input, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text FROM src_rows",
)
PAYLOADS = ", wrapped AS (SELECT DISTINCT task_id, substr(md5(concat(task_id, '|wrap')), 1, 1) <> '6' AS ok FROM spans)\n"
add(
    "b02_parsed_annotations",
    lambda t: parse.parse_annotations(t.payloads).select("task_id", "ok", F.when(F.col("ok"), F.size("parsed.rows")).otherwise(0).alias("n_rows")),
    PAYLOADS + "SELECT task_id, ok, CASE WHEN ok THEN n ELSE 0 END::INT AS n_rows FROM wrapped JOIN (SELECT task_id, count(DISTINCT row_index) AS n FROM spans GROUP BY task_id) USING (task_id)",
)
add(
    "b04_span_items",  # the payloads hold each span once, in order of text
    lambda t: parse.explode_spans(parse.parse_annotations(t.payloads).where("ok")).select("task_id", "row_index", "field", "type", "pos", "span"),
    PAYLOADS + "SELECT task_id, row_index, field, type, (row_number() OVER (PARTITION BY task_id, row_index, field, type ORDER BY span) - 1)::INT AS pos, span FROM (SELECT DISTINCT task_id, row_index, field, type, span FROM spans JOIN wrapped USING (task_id) WHERE ok)",
)
add(
    "b08_row_inputs",
    lambda t: parse.row_inputs(t.sources),
    "SELECT task_id, CASE WHEN substr(md5(concat_ws('|', task_id, row_index::VARCHAR, 'i')), 1, 1) = '0' THEN row_index ELSE row_index + 100 END::INT AS row_index, arg_max(input, row_index) AS input FROM src_rows GROUP BY task_id, 2",
)
QC = """concat('{"category": "c', task_id, '", "severity": "error", "confidence": 0.5, "failures": [', case when attempt_no % 2 = 0 then '{"message": "one"}, {"severity": "warning", "message": "two"}' else '' end, ']}')"""
add(
    "b12_qc_feedback",
    lambda t: parse.qc_feedback(t.feedback.select(F.col("feedback_id").alias("task_id"), "attempt_no").select("task_id", F.expr(QC).alias("decision"))),
    """SELECT feedback_id AS task_id, k AS "at", concat('c', feedback_id) AS category, CASE WHEN even AND k = 1 THEN 'warning' ELSE 'error' END AS severity, CASE WHEN even THEN CASE k WHEN 0 THEN 'one' ELSE 'two' END END AS message, CASE WHEN k = 0 THEN 0.5::DOUBLE END AS confidence
FROM (SELECT *, attempt_no % 2 = 0 AS even FROM feedback), (SELECT 0 AS k UNION ALL SELECT 1) WHERE even OR k = 0""",
)
REPLY = """concat('{"discussion_replies": [{"feedback_id": "', feedback_id, '", "message": "top"}], "rows": [{"row_index": 0}, {"row_index": 1, "discussion_replies": [{"feedback_id": "', feedback_id, '", "message": "row"}, {"feedback_id": "none", "message": "x"}, {"feedback_id": "', feedback_id, '", "message": " "}]}]}')"""
add(
    "b13_discussion_replies",
    lambda t: parse.discussion_replies(parse.extracted_replies(t.feedback.select("task_id", F.expr(REPLY).alias("payload"))), t.feedback, t.feedback.where("attempt_no = 0").select("feedback_id", F.lit("top").alias("message"))),
    "SELECT task_id, feedback_id, r.message FROM feedback, (SELECT 'top' AS message UNION ALL SELECT 'row') r WHERE NOT (attempt_no = 0 AND r.message = 'top')",
)
PHRASES = """concat('["', task_id, '", {"text": "', type, '", "start": 1}, {"start": 2}, ""]')"""
add("b19_phrase_texts", lambda t: t.spans.select("task_id", "row_index", "pos", F.array_join(parse.phrase_text(F.expr(PHRASES)), "|").alias("phrases")), "SELECT task_id, row_index, pos, concat(task_id, '|', type) AS phrases FROM spans")
add("b05_span_decisions", lambda t: parse.span_decisions(t.spans), "SELECT DISTINCT task_id, span, type FROM spans WHERE trim(span) <> ''")
add(
    "b06_decisions_with_source",
    lambda t: parse.decisions_with_source(t.spans, t.rows),
    "SELECT s.task_id, span_lower, type, s.row_index, input AS content FROM (SELECT task_id, lower(span) AS span_lower, type, row_index FROM spans QUALIFY row_number() OVER (PARTITION BY task_id, lower(span), type ORDER BY row_index, pos) = 1) s LEFT JOIN src_rows r ON r.task_id = s.task_id AND r.row_index = s.row_index",
)
add("b07_span_counts", lambda t: parse.span_counts(t.spans), "SELECT task_id, row_index, count(*) AS n_raw, count(*) FILTER (trim(span) <> '') AS n_spans FROM spans GROUP BY ALL")
add("b09_task_text", lambda t: parse.task_text(t.rows, t.row_masks), "SELECT task_id, count(*)::INT AS n_rows, string_agg(coalesce(input, ''), chr(10) ORDER BY row_index) AS text FROM src_rows r WHERE NOT EXISTS (FROM row_masks m WHERE m.task_id = r.task_id AND m.row_index = r.row_index) GROUP BY task_id")
add("b10_without_masked", lambda t: parse.without_masked(t.rows, t.row_masks), "SELECT r.* FROM src_rows r ANTI JOIN row_masks m USING (task_id, row_index)")
add(
    "b11_rebuild_rows",
    lambda t: parse.rebuild_rows(t.spans).withColumn("spans", F.array_join("spans", "|")),
    "SELECT task_id, row_index, field, type, string_agg(DISTINCT span, '|' ORDER BY span) AS spans FROM spans GROUP BY ALL",
)
add(
    "b14_confidence_labels",
    lambda t: t.attempts.select("task_id", "seq", parse.confidence_label(F.col("dur_s") / 100).alias("label")),
    "SELECT task_id, seq, CASE WHEN c >= 0.85 THEN 'certain' WHEN c >= 0.65 THEN 'confident' WHEN c >= 0.40 THEN 'tentative' WHEN c IS NOT NULL THEN 'unsure' END AS label FROM (SELECT *, least(greatest(dur_s / 100, 0), 1) AS c FROM attempts)",
)
add(
    "b15_coerce_to_enum",
    lambda t: parse.coerce_to_enum(t.spans, t.type_enum).groupBy("field", "type", "outcome").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN outcome = 'moved' THEN (SELECT min(field) FROM type_enum e WHERE e.type = s.type) ELSE field END AS field, type, outcome, count(*) AS n FROM (SELECT field, type, CASE WHEN EXISTS (FROM type_enum e WHERE e.type = p.type AND e.field = p.field) THEN 'kept' WHEN EXISTS (FROM type_enum e WHERE e.type = p.type) THEN 'moved' ELSE 'dropped' END AS outcome FROM spans p) s GROUP BY ALL",
)
add("b16_distinct_in_row", lambda t: parse.distinct_in_row(t.spans), "SELECT task_id, row_index, field, type, span, min(pos) AS pos FROM spans GROUP BY ALL")
add("b17_missing_row_stubs", lambda t: parse.missing_row_stubs(t.rows, t.spans), "SELECT task_id, row_index, '{}' AS output FROM src_rows ANTI JOIN spans USING (task_id, row_index)")
add("b18_allowed_fields", lambda t: parse.allowed_fields(t.spans, ("entities",)), "SELECT * FROM spans WHERE field = 'entities'")
add(
    "b20_rename_types",
    lambda t: parse.rename_types(t.spans, {"typea": "type1", "typeb": "type1"}, ["type1", "type2", "other"]),
    "SELECT task_id, row_index, field, CASE WHEN type IN ('typea', 'typeb') THEN 'type1' ELSE type END AS type, span, min(pos) AS pos FROM spans WHERE type IN ('typea', 'typeb', 'type1', 'type2', 'other') GROUP BY ALL",
)
add("b21_first_tokens", lambda t: t.rows.select("task_id", "row_index", first_tokens(F.col("input"), 20).alias("head")), r"SELECT task_id, row_index, CASE WHEN regexp_matches(input, '^(\s*\S+){20}') THEN regexp_extract(input, '^(\s*\S+){20}') ELSE input END AS head FROM src_rows")
add(
    "b22_snippets",
    lambda t: t.spans.join(t.rows, ["task_id", "row_index"]).select("task_id", "row_index", "pos", snippet(F.col("input"), F.col("span"), 40).alias("snippet")),
    "SELECT task_id, row_index, pos, CASE WHEN hit > 0 THEN concat(CASE WHEN a > 1 THEN '…' ELSE '' END, substr(input, a, b - a + 1), CASE WHEN b < length(input) THEN '…' ELSE '' END) ELSE concat(substr(input, 1, 80), CASE WHEN length(input) > 80 THEN '…' ELSE '' END) END AS snippet FROM (SELECT *, greatest(hit - 40, 1) AS a, least(hit + length(span) + 39, length(input)) AS b FROM (SELECT s.task_id, s.row_index, pos, input, span, instr(lower(input), lower(span)) AS hit FROM spans s JOIN src_rows r ON r.task_id = s.task_id AND r.row_index = s.row_index))",
)

# --- defects ---------------------------------------------------------------------------------------------------------------

JOINED = "spans s JOIN src_rows r ON r.task_id = s.task_id AND r.row_index = s.row_index"
AT = "s.task_id, s.row_index, s.field, s.type, s.pos, s.span"
NON_VERBATIM = f"SELECT {AT} FROM {JOINED} WHERE instr(input, span) = 0"
TRIMMED = "trim(regexp_replace(span, '[.,;:!?。，；：！？]+$', ''))"
TRAILING = f"SELECT {AT}, {TRIMMED} AS trimmed FROM {JOINED} WHERE {TRIMMED} <> span AND {TRIMMED} <> '' AND instr(input, {TRIMMED}) > 0"
REPEATED = "SELECT task_id, row_index, field, type, pos, span FROM spans QUALIFY row_number() OVER (PARTITION BY task_id, row_index, field, type, span ORDER BY pos) > 1"
COLLIDE = "SELECT task_id, row_index, field, type, pos, span, first_type FROM (SELECT *, first_value(type) OVER (PARTITION BY task_id, row_index, span ORDER BY pos) AS first_type FROM spans WHERE field = 'entities') WHERE type <> first_type"
SHARED = f"SELECT {AT}, CASE WHEN instr(span, ' ') > 0 THEN 'json_structures' ELSE 'entities' END AS should FROM spans s WHERE type IN (SELECT type FROM type_enum GROUP BY type HAVING count(DISTINCT field) = 2) AND field <> CASE WHEN instr(span, ' ') > 0 THEN 'json_structures' ELSE 'entities' END"
MISSING = "SELECT task_id, count(*) AS n_missing, array_to_string(list_sort(list(row_index))[1:5], ',') AS first_missing FROM src_rows ANTI JOIN spans USING (task_id, row_index) GROUP BY task_id"

add("c01_non_verbatim", lambda t: defects.non_verbatim(t.spans, t.rows), NON_VERBATIM)
add("c02_trailing_punctuation", lambda t: defects.trailing_punctuation(t.spans, t.rows), TRAILING)
add("c03_repeated_spans", lambda t: defects.repeated_spans(t.spans), REPEATED)
add("c04_type_collisions", lambda t: defects.type_collisions(t.spans), COLLIDE)
add("c05_misplaced_shared", lambda t: defects.misplaced_shared(t.spans, t.type_enum), SHARED)
RULES = {"verbatim": NON_VERBATIM, "punctuation": TRAILING, "repeated": REPEATED, "collision": COLLIDE}
add(
    "c05_validators",
    lambda t: registry.violations(t.spans, t.rows).groupBy("rule", "field", "type").agg(F.count("*").alias("n"), F.countDistinct("task_id").alias("n_tasks")),
    " UNION ALL ".join(f"SELECT '{name}' AS rule, field, type, count(*) AS n, count(DISTINCT task_id) AS n_tasks FROM ({sql}) GROUP BY field, type" for name, sql in RULES.items()),
)
add("c06_missing_rows", lambda t: defects.missing_rows(t.rows, t.spans), MISSING)
add(
    "c07_schema_violations",
    lambda t: defects.schema_violations(parse.parse_annotations(t.payloads), t.type_enum, 2),
    PAYLOADS
    + """, own AS (SELECT DISTINCT task_id, row_index, field, type, span FROM spans JOIN wrapped USING (task_id) WHERE ok)
SELECT task_id, 'unreadable' AS rule, '' AS detail FROM wrapped WHERE NOT ok
UNION ALL SELECT DISTINCT task_id, 'too_many', concat(field, '.', type) FROM (SELECT task_id, row_index, field, type FROM own GROUP BY ALL HAVING count(*) > 2)
UNION ALL SELECT DISTINCT task_id, 'type', concat(field, '.', type) FROM own ANTI JOIN type_enum USING (field, type)""",
)
add(
    "c08_first_failure",
    lambda t: defects.first_failure(t.spans, t.rows, t.type_enum),
    f"SELECT task_id, category, n AS n_violations FROM (SELECT task_id, 0 AS rank, 'missing_rows' AS category, count(*) AS n FROM ({MISSING}) GROUP BY task_id UNION ALL SELECT task_id, 1, 'non_verbatim', count(*) FROM ({NON_VERBATIM}) GROUP BY task_id UNION ALL SELECT task_id, 2, 'cross_type', count(*) FROM ({COLLIDE}) GROUP BY task_id UNION ALL SELECT task_id, 3, 'punctuation', count(*) FROM ({TRAILING}) GROUP BY task_id UNION ALL SELECT task_id, 4, 'shared_type', count(*) FROM ({SHARED}) GROUP BY task_id) QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY rank) = 1",
)
add(
    "c09_export_audit",
    lambda t: defects.export_audit(t.spans, t.rows),
    f"SELECT 'duplicate' AS kind, field, type, count(*) AS n FROM ({REPEATED}) GROUP BY ALL UNION ALL SELECT 'non_verbatim', field, type, count(*) FROM ({NON_VERBATIM}) GROUP BY ALL UNION ALL SELECT 'cross_type', field, type, count(*) FROM ({COLLIDE}) GROUP BY ALL",
)
add("c10_template_rows", lambda t: defects.template_rows(t.rows, r"^[A-Z][a-z]+\.$"), "SELECT task_id, count(*) FILTER (regexp_matches(input, '^[A-Z][a-z]+\\.$')) AS n_hits, count(*) AS n_rows, count(*) FILTER (regexp_matches(input, '^[A-Z][a-z]+\\.$')) = count(*) AS pure FROM src_rows GROUP BY task_id HAVING n_hits > 0")
add(
    "c11_hallucination_resets",
    lambda t: defects.hallucination_resets(t.spans, t.rows, least=5, share=0.1),
    f"SELECT task_id, n_spans, n_stripped FROM (SELECT task_id, count(*) AS n_spans FROM spans GROUP BY task_id) JOIN (SELECT task_id, count(*) AS n_stripped FROM ({NON_VERBATIM}) GROUP BY task_id) USING (task_id) WHERE n_stripped >= 5 AND n_stripped >= 0.1 * n_spans",
)
add("c12_placeholders", lambda t: defects.placeholders(t.spans, exempt=("type1",)), r"SELECT task_id, row_index, field, type, pos, span FROM spans WHERE regexp_matches(span, 'X{4,}|x{4,}|\*{3,}|(?i)\[(?:redacted|removed)\]') AND type <> 'type1'")
add(
    "c13_bare_names",
    lambda t: defects.bare_names(t.spans, "typec", "(ed|ing)"),
    "SELECT task_id, row_index, field, type, pos, span FROM spans s WHERE field = 'json_structures' AND type = 'typec' AND (NOT regexp_matches(span, '(ed|ing)') OR EXISTS (FROM spans e WHERE e.field = 'entities' AND e.task_id = s.task_id AND e.row_index = s.row_index AND lower(e.span) = lower(s.span)))",
)
add("c14_nested_spans", lambda t: defects.nested_spans(t.spans), "SELECT DISTINCT a.task_id, a.row_index, a.type, a.span FROM spans a JOIN spans b ON a.task_id = b.task_id AND a.row_index = b.row_index AND a.type = b.type AND a.span <> b.span AND instr(b.span, a.span) > 0")
add(
    "c15_candidate_sentences",
    lambda t: defects.candidate_sentences(defects.non_verbatim(t.spans, t.rows).withColumn("span", F.regexp_replace("span", "X$", "")), t.rows, 2),
    f"SELECT task_id, row_index, span, sentence, score, row_number() OVER (PARTITION BY task_id, row_index, span ORDER BY score DESC, length(sentence), sentence)::INT AS rank FROM (SELECT *, len(list_filter(list_distinct(regexp_split_to_array(lower(span), '\\s+')), lambda w: w <> '' AND contains(lower(sentence), w)))::INT AS score FROM (SELECT DISTINCT f.task_id, f.row_index, f.span, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(r.input, '[.!?。！？\\n]+'), lambda x: trim(x)), lambda x: x <> ''))) AS sentence FROM (SELECT task_id, row_index, regexp_replace(span, 'X$', '') AS span FROM ({NON_VERBATIM})) f JOIN src_rows r ON r.task_id = f.task_id AND r.row_index = f.row_index)) WHERE score > 0 QUALIFY rank <= 2",
)
add(
    "c16_destinations",
    lambda t: defects.destination(t.spans, t.type_enum),
    "SELECT DISTINCT span, type, CASE WHEN n IS NULL THEN 'unknown' WHEN n = 1 THEN f ELSE CASE WHEN instr(span, ' ') > 0 THEN 'json_structures' ELSE 'entities' END END AS destination FROM spans LEFT JOIN (SELECT type, count(*) AS n, min(field) AS f FROM type_enum GROUP BY type) USING (type)",
)
for code, status in (("c17_accepted_with_defects", "accepted"), ("c18_arbitrating_with_defects", "arbitrating")):
    add(code, lambda t, s=status: defects.tasks_with_defects(defects.non_verbatim(t.spans, t.rows), t.tasks, s), f"SELECT task_id, count(*) AS n_violations FROM ({NON_VERBATIM}) JOIN tasks USING (task_id) WHERE status = '{status}' GROUP BY task_id")
add(
    "c19_typical_text",
    lambda t: defects.typical_text(t.spans, t.rows, "the", t.row_masks),
    "SELECT task_id, row_index, input, count(*) OVER () AS n_rows FROM src_rows JOIN (SELECT DISTINCT task_id, row_index FROM spans WHERE lower(span) = 'the') USING (task_id, row_index) ANTI JOIN row_masks USING (task_id, row_index) ORDER BY md5(concat('|', task_id, '|', row_index::VARCHAR)), task_id, row_index LIMIT 1",
)

# --- statistics ------------------------------------------------------------------------------------------------------------

STATS = """, statistics AS (SELECT project_id, lower(span) AS span_lower, type, count(DISTINCT task_id) AS n FROM spans JOIN tasks USING (task_id) WHERE status = 'accepted' AND trim(span) <> '' GROUP BY ALL),
all_stats AS (SELECT span_lower, type, count(DISTINCT task_id) AS n FROM (SELECT task_id, lower(span) AS span_lower, type FROM spans) GROUP BY ALL),
ranked AS (SELECT span_lower, type, n, sum(n) OVER (PARTITION BY span_lower)::BIGINT AS total, row_number() OVER (PARTITION BY span_lower ORDER BY n DESC, type DESC) AS rank FROM all_stats),
summary AS (SELECT a.span_lower, a.total, a.type AS top_type, a.n / a.total AS top_share, b.type AS second_type, coalesce(b.n / a.total, 0.0) AS second_share FROM ranked a LEFT JOIN ranked b ON b.span_lower = a.span_lower AND b.rank = 2 WHERE a.rank = 1),
contested AS (SELECT * FROM summary WHERE total >= 10 AND top_share < 0.80 AND second_share >= 0.20),
decisions AS (SELECT DISTINCT task_id, lower(span) AS span_lower, type FROM spans WHERE trim(span) <> ''),
checked AS (SELECT d.*, total, top_type, top_share, CASE WHEN coalesce(total, 0) < 10 THEN 'cold_start' WHEN top_share >= 0.80 AND top_type <> type THEN 'divergent' ELSE 'agree' END AS verdict FROM decisions d LEFT JOIN summary USING (span_lower)),
own AS (SELECT *, lag(type) OVER w AS p_type, lag(source) OVER w AS p_source, lag(task_id) OVER w AS p_task FROM proposals WINDOW w AS (PARTITION BY span_lower ORDER BY seq)),
folded AS (SELECT span_lower, first(type ORDER BY seq) AS first_type, last(type ORDER BY seq) FILTER (source LIKE 'declared:%') AS declared_type, count(DISTINCT type) AS n_types, count(*) AS evidence, coalesce(last(source ORDER BY seq) FILTER (source LIKE 'declared:%'), first(source ORDER BY seq)) AS source, count(DISTINCT task_id) AS n_tasks FROM own WHERE NOT coalesce(type = p_type AND source = p_source AND task_id = p_task, false) GROUP BY span_lower),
conventions AS (SELECT span_lower, coalesce(declared_type, first_type) AS type, CASE WHEN declared_type IS NOT NULL OR n_types = 1 THEN 'active' ELSE 'disputed' END AS status, source, evidence, n_tasks, declared_type IS NOT NULL AS locked FROM folded)
"""


def everywhere(t):
    """Statistics of all tasks, whatever their status, as one project."""
    return stats.entity_statistics(t.spans, t.tasks.withColumn("status", F.lit("accepted")).withColumn("project_id", F.lit("all")))


def checked(t):
    return stats.prior_check(stats.lower_decisions(t.spans), stats.summaries(everywhere(t)))


def agreed_conventions(t):
    return conventions.from_proposals(t.proposals)


def accepted_decisions(t):
    return stats.accepted(stats.lower_decisions(t.spans), t.tasks)


add("e01_entity_statistics", lambda t: stats.entity_statistics(t.spans, t.tasks), STATS + "SELECT * FROM statistics")
add("e02_recount_span", lambda t: stats.recount_span(stats.entity_statistics(t.spans, t.tasks), t.spans, t.tasks, "the"), STATS + "SELECT * FROM statistics")
add(
    "e03_weighted_statistics",
    lambda t: stats.weighted_statistics(parse.without_masked(t.spans, t.row_masks), t.tasks, parse.effective_annotation(t.artifacts)),
    """, eff AS (SELECT task_id, kind FROM artifacts QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY (kind = 'human_review_answer') DESC, seq DESC) = 1)
SELECT project_id, span_lower, type, sum(w)::BIGINT AS n FROM (SELECT DISTINCT project_id, lower(span) AS span_lower, type, task_id, CASE WHEN kind = 'human_review_answer' THEN 5 ELSE 1 END AS w FROM spans ANTI JOIN row_masks USING (task_id, row_index) JOIN tasks USING (task_id) LEFT JOIN eff USING (task_id) WHERE status = 'accepted') GROUP BY ALL""",
)
add(
    "e04_add_counts",
    lambda t: stats.add_counts(stats.by_span(stats.entity_statistics(t.spans, t.tasks.where("project_id = 'p0'"))), stats.by_span(stats.entity_statistics(t.spans, t.tasks.where("project_id <> 'p0'"))), ["span_lower", "type"]),
    STATS + "SELECT span_lower, type, sum(n)::BIGINT AS n FROM statistics GROUP BY ALL",
)
add("e05_distributions", lambda t: stats.distributions(everywhere(t)), STATS + "SELECT span_lower, sum(n)::BIGINT AS total, count(*) AS n_types, string_agg(concat(type, ':', n::VARCHAR), ',' ORDER BY n DESC, type) AS distribution FROM all_stats GROUP BY span_lower")
add("e06_prior_check", lambda t: checked(t).select("task_id", "span_lower", "type", "verdict"), STATS + "SELECT task_id, span_lower, type, verdict FROM checked")
add(
    "e07_contested_spans",
    lambda t: stats.contested(stats.summaries(everywhere(t))).select("span_lower", "total", "top_type", F.round("top_share", 6).alias("top_share"), "second_type", F.round("second_share", 6).alias("second_share")),
    STATS + "SELECT span_lower, total, top_type, round(top_share, 6) AS top_share, second_type, round(second_share, 6) AS second_share FROM contested",
)
add("e08_type_entropy", lambda t: stats.type_entropy(everywhere(t)), STATS + "SELECT span_lower, round(sum(-(n / total) * log2(n / total)), 6) AS entropy FROM ranked GROUP BY span_lower")
ZIPF = """, words AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(input), '[a-z]+')) AS word FROM src_rows) GROUP BY word),
zipf AS (SELECT word, log10(1e9 * n / (SELECT sum(n) FROM words)) AS zipf FROM words),
scored AS (SELECT span_lower, avg(coalesce(zipf, 0)) AS score FROM (SELECT span_lower, unnest(regexp_extract_all(span_lower, '[a-z]+')) AS word FROM (SELECT DISTINCT lower(span) AS span_lower FROM spans)) LEFT JOIN zipf USING (word) GROUP BY span_lower)
"""
add("e09_low_information", lambda t: stats.low_information(everywhere(t), stats.frequency_scores(t.spans, stats.zipf_table(t.rows))), STATS + ZIPF + "SELECT span_lower, sum(n)::BIGINT AS total, round(any_value(score), 6) AS score FROM all_stats JOIN scored USING (span_lower) WHERE score >= 4.0 GROUP BY span_lower")
add("e10_frequency_scores", lambda t: stats.frequency_scores(t.spans, stats.zipf_table(t.rows)).withColumn("score", F.round("score", 6)), ZIPF + "SELECT span_lower, round(score, 6) AS score FROM scored")
AUDIT = "SELECT c.task_id, c.span_lower, c.type, coalesce(v.type, top_type) AS expected, v.type IS NOT NULL AS by_convention FROM checked c LEFT JOIN conventions v ON v.span_lower = c.span_lower AND v.status = 'active' WHERE verdict = 'divergent' AND c.type <> coalesce(v.type, top_type)"
add("e11_posterior_audit", lambda t: stats.posterior_audit(stats.lower_decisions(t.spans), stats.summaries(everywhere(t)), agreed_conventions(t)), STATS + AUDIT)
add(
    "e12_task_deviations",  # every deviation of every task, with the counts of its task
    lambda t: stats.posterior_audit(stats.lower_decisions(t.spans), stats.summaries(everywhere(t)), agreed_conventions(t)).withColumns({"n": F.count("*").over(Window.partitionBy("task_id")), "n_by_convention": F.count_if("by_convention").over(Window.partitionBy("task_id"))}),
    STATS + f"SELECT *, count(*) OVER (PARTITION BY task_id) AS n, count(*) FILTER (by_convention) OVER (PARTITION BY task_id) AS n_by_convention FROM ({AUDIT})",
)
add(
    "e12_all_task_deviations",
    lambda t: stats.task_deviations(stats.lower_decisions(t.spans), stats.summaries(everywhere(t)), agreed_conventions(t)).withColumn("top_share", F.round("top_share", 6)),
    STATS + f"SELECT a.*, s.total, round(s.top_share, 6) AS top_share FROM ({AUDIT}) a JOIN summary s USING (span_lower)",
)
add("e13_confirmed_tasks", lambda t: stats.confirmed_tasks(checked(t)), STATS + "SELECT task_id, count(*) FILTER (verdict = 'agree') AS good FROM checked GROUP BY task_id HAVING count(*) FILTER (verdict = 'divergent') = 0 AND good > 0")
add(
    "e14_disagreement_messages",
    lambda t: stats.disagreement_messages(checked(t)),
    STATS + "SELECT task_id, span_lower, type, concat('''', span_lower, ''' is ', top_type, ' in ', floor(round(top_share * 100, 6))::INT, '% of tasks, here ', type) AS message FROM checked WHERE verdict = 'divergent'",
)
VOTES = """, votes AS (SELECT span_lower, task_id, max(type) AS type FROM decisions JOIN tasks USING (task_id) WHERE status = 'accepted' GROUP BY ALL),
vote_counts AS (SELECT span_lower, type, count(*) AS n FROM votes GROUP BY ALL),
tallied AS (SELECT span_lower, type, n AS n_agree, total AS n_tasks, total - n AS n_dispute FROM (SELECT *, sum(n) OVER (PARTITION BY span_lower)::BIGINT AS total FROM vote_counts) QUALIFY row_number() OVER (PARTITION BY span_lower ORDER BY n DESC, type DESC) = 1),
recounted AS (SELECT c.span_lower, CASE WHEN locked OR t.type IS NULL THEN c.type ELSE t.type END AS type, status, locked, coalesce(t.n_tasks, 0) AS distinct_tasks, coalesce(n_dispute, 0) AS n_dispute FROM conventions c LEFT JOIN tallied t USING (span_lower))
"""
add("e15_convention_recount", lambda t: conventions.recount(accepted_decisions(t), agreed_conventions(t)), STATS + VOTES + "SELECT * FROM recounted")
add(
    "e16_proposal_tally",
    lambda t: conventions.tally_proposals(t.proposals),
    ", v AS (SELECT span_lower, task_id, last(type ORDER BY seq) AS type FROM proposals WHERE source NOT LIKE 'declared:%' GROUP BY ALL), c AS (SELECT span_lower, type, count(*) AS n FROM v GROUP BY ALL) SELECT span_lower, type, n AS n_agree, total AS n_tasks, total - n AS n_dispute, round((total - n) / total, 6) AS dispute_share FROM (SELECT *, sum(n) OVER (PARTITION BY span_lower)::BIGINT AS total FROM c) QUALIFY row_number() OVER (PARTITION BY span_lower ORDER BY n DESC, type DESC) = 1",
)
add("e17_rebuild_conventions", lambda t: conventions.rebuild(accepted_decisions(t)), STATS + VOTES + "SELECT *, round(n_dispute / n_tasks, 6) AS dispute_share FROM tallied")
add("e18_fold_proposals", lambda t: agreed_conventions(t), STATS + "SELECT * FROM conventions")
#: Settlements of disputes in the middle of the proposals of some spans, on which declarations of later ones have the last word.
SETTLED = f"""select span_lower, 2 * seq as seq, type, task_id, source from {{proposals}}
union all select span_lower, 2 * cast(floor(count(*) / 2) as bigint) + 1 as seq, max(type) as type, cast(null as string) as task_id, 'dispute_resolved_by:lead' as source from {{proposals}} where {one_of("01234567", "concat(span_lower, '|res')")} group by span_lower
union all select span_lower, 2 * cast(count(*) as bigint) + k as seq, min(type) as type, cast(null as string) as task_id, 'declared:operator' as source from {{proposals}} cross join (select 1 as k union all select 2) n where {one_of("01", "concat(span_lower, '|dec')")} group by span_lower, k"""
add(
    "e18_settled_disputes",
    lambda t: conventions.from_proposals(t.sql(SETTLED, proposals=t.proposals)),
    f", settled AS ({SETTLED.format(proposals='proposals')})" + r""", marked AS (SELECT *, source LIKE 'declared:%' OR source LIKE 'dispute\_resolved\_by:%' ESCAPE '\' AS op, source NOT LIKE 'dispute\_resolved\_by:%' ESCAPE '\' AND coalesce(lag(type) OVER w = type AND lag(source) OVER w = source AND lag(task_id) OVER w IS NOT DISTINCT FROM task_id, false) AS again FROM settled WINDOW w AS (PARTITION BY span_lower ORDER BY seq))
SELECT span_lower, coalesce(last(type ORDER BY seq) FILTER (op), first(type ORDER BY seq)) AS type, CASE WHEN bool_or(op) OR count(DISTINCT type) = 1 THEN 'active' ELSE 'disputed' END AS status, coalesce(last(source ORDER BY seq) FILTER (op), first(source ORDER BY seq)) AS source, count(*) FILTER (NOT again) AS evidence, count(DISTINCT task_id) AS n_tasks, bool_or(op) AS locked FROM marked GROUP BY span_lower""",
)
add("e18_cancelled", lambda t: conventions.without_spans(agreed_conventions(t), t.spans.where("type = 'type1'").select("span").distinct()), STATS + "SELECT * FROM conventions WHERE span_lower NOT IN (SELECT lower(trim(span)) FROM spans WHERE type = 'type1')")
add(
    "e19_without_overridden",
    lambda t: conventions.without_overridden(stats.lower_decisions(t.spans), t.artifacts),
    STATS + "SELECT * FROM decisions WHERE task_id NOT IN (SELECT task_id FROM artifacts WHERE kind = 'human_review_answer')",
)
add(
    "e20_statistics_delta",
    lambda t: stats.statistics_delta(everywhere(t), stats.entity_statistics(t.spans, t.tasks)),
    STATS + ", o AS (SELECT span_lower, type, sum(n)::BIGINT AS n FROM statistics GROUP BY ALL) SELECT span_lower, type, coalesce(a.n, 0) AS n_new, coalesce(o.n, 0) AS n_old FROM all_stats a FULL JOIN o USING (span_lower, type) WHERE coalesce(a.n, 0) <> coalesce(o.n, 0)",
)
INJECTABLE = "SELECT span_lower, type, distinct_tasks, locked FROM recounted WHERE status = 'active' AND (locked OR (distinct_tasks >= 5 AND n_dispute < 0.20 * distinct_tasks))"
add("e21_injectable", lambda t: conventions.injectable(conventions.recount(accepted_decisions(t), agreed_conventions(t))), STATS + VOTES + INJECTABLE)


def found_in_text(t):
    t = held(t)
    return conventions.found_in_text(t.rows, conventions.injectable(conventions.recount(accepted_decisions(t), agreed_conventions(t))))


add(
    "e22_found_in_text",
    found_in_text,
    STATS + VOTES + f""", inj AS ({INJECTABLE}), w AS (SELECT DISTINCT task_id, row_index, unnest(regexp_extract_all(lower(input), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM src_rows)
SELECT task_id, span_lower, type AS convention, count(*) AS n_rows FROM w JOIN inj ON regexp_extract(span_lower, '^[\\p{{L}}\\p{{N}}_]+') = word JOIN src_rows r USING (task_id, row_index) WHERE length(span_lower) >= 4 AND (span_lower = word OR CASE WHEN contains(lower(input), span_lower) THEN regexp_matches(concat(' ', lower(input), ' '), concat('[^\\p{{L}}\\p{{N}}_]', regexp_escape(span_lower), '[^\\p{{L}}\\p{{N}}_]')) ELSE false END) GROUP BY task_id, span_lower, type QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY length(span_lower) DESC, span_lower) <= 50""",
)
add("e24_contested_by_type", lambda t: stats.contested_by_type(stats.summaries(everywhere(t)), "other").select("span_lower", "total", "top_type", "second_type"), STATS + "SELECT span_lower, total, top_type, second_type FROM contested WHERE top_type = 'other' OR second_type = 'other'")
add(
    "e25_contested_against_convention",
    lambda t: stats.contested_against_convention(stats.summaries(everywhere(t)), agreed_conventions(t), stats.lower_decisions(t.spans)),
    STATS + "SELECT span_lower, v.type AS convention, count(DISTINCT task_id) AS n_tasks FROM contested JOIN conventions v USING (span_lower) JOIN decisions d USING (span_lower) WHERE v.status = 'active' AND d.type <> v.type GROUP BY ALL",
)
add("e26_first_divergence", lambda t: stats.first_divergence(checked(t)), STATS + "SELECT task_id, span_lower, type, top_type FROM checked WHERE verdict = 'divergent' QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY span_lower, type) = 1")
add("e27_type_statistics", lambda t: stats.type_statistics(t.spans), "SELECT field, type, count(*) AS n, count(DISTINCT task_id) AS n_tasks FROM spans GROUP BY ALL")
add(
    "e28_statistics_page",
    lambda t: stats.statistics_page(everywhere(t), "the", 20, 5),
    STATS + ", page AS (SELECT span_lower, sum(n)::BIGINT AS total FROM all_stats WHERE span_lower IN (SELECT span_lower FROM all_stats WHERE contains(span_lower, 'the') OR contains(type, 'the')) GROUP BY span_lower ORDER BY total DESC, span_lower LIMIT 20 OFFSET 5) SELECT span_lower, total, type, n FROM page JOIN all_stats USING (span_lower)",
)
add("e29_conventions_page", lambda t: conventions.conventions_page(agreed_conventions(t), "active", 25), STATS + "SELECT span_lower, type, n_tasks, evidence FROM conventions WHERE status = 'active' ORDER BY n_tasks DESC, evidence DESC, span_lower LIMIT 25")
add(
    "e30_knowledge_fingerprint",
    lambda t: stats.knowledge_fingerprint(stats.entity_statistics(t.spans, t.tasks), agreed_conventions(t)),
    STATS + "SELECT * FROM (SELECT count(*) AS n_statistics, count(DISTINCT span_lower) AS n_spans, sum(n)::BIGINT AS n_total FROM statistics), (SELECT count(*) AS n_conventions, count(*) FILTER (status = 'active') AS n_active FROM conventions)",
)
add(
    "e30_table_states",
    lambda t: stats.table_states({"events": (t.audit_events, "ts"), "attempts": (t.attempts, "finished_at"), "rules": (t.rules_versions, "created_at")}).withColumn("latest", F.col("latest").cast("timestamp_ntz")),
    "SELECT 'events' AS table_name, count(*) AS n, max(ts) AS latest FROM audit_events UNION ALL SELECT 'attempts', count(*), max(finished_at) FROM attempts UNION ALL SELECT 'rules', count(*), max(created_at) FROM rules_versions",
)
#: Tasks that an arbiter touched, and the prelabels: the first draft.
TOUCHED = one_of("0123", "concat(task_id, '|arb')")
BACKFILL = f""", eff AS (SELECT task_id, kind, json_valid(regexp_extract(regexp_replace(payload, '(?is)<think>.*?</think>', '', 'g'), '(?s)\x7b.*\x7d')) AS usable FROM artifacts QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY (kind = 'human_review_answer') DESC, seq DESC) = 1),
scanned AS (SELECT task_id, kind, usable, {TOUCHED} AS touched FROM tasks LEFT JOIN eff USING (task_id) WHERE status = 'accepted'),
able AS (SELECT task_id, kind FROM scanned WHERE NOT touched AND usable),
fin AS (SELECT task_id, row_index, lower(span) AS span_lower, type, pos FROM spans SEMI JOIN able USING (task_id) WHERE field = 'entities' QUALIFY row_number() OVER (PARTITION BY task_id, row_index, lower(span) ORDER BY pos) = 1),
pre AS (SELECT task_id, row_index, lower(span) AS span_lower, min(type) AS old_type FROM drafts WHERE draft = 1 AND field = 'entities' GROUP BY ALL),
diff AS (SELECT * FROM fin LEFT JOIN pre USING (task_id, row_index, span_lower) WHERE old_type IS NULL OR old_type <> type QUALIFY row_number() OVER (PARTITION BY task_id, span_lower ORDER BY row_index, pos) = 1),
filled AS (SELECT span_lower, row_number() OVER (PARTITION BY span_lower ORDER BY task_id)::INT AS seq, type, task_id, CASE kind WHEN 'human_review_answer' THEN 'hr_correction' ELSE 'qc_consensus' END AS source FROM diff JOIN able USING (task_id))
"""


def backfilled(t):
    pre = t.drafts.where("draft = 1").groupBy("task_id", "row_index", "field", "span").agg(F.min("type").alias("type")).withColumn("pos", F.lit(0))
    return conventions.backfill_proposals(t.spans, pre.groupBy("task_id", "row_index", "field", F.lower("span").alias("span")).agg(F.min("type").alias("type")).withColumn("pos", F.lit(0)), t.tasks, parse.effective_annotation(t.artifacts), t.tasks.where(TOUCHED).select("task_id"))


add("e32_backfill_proposals", backfilled, BACKFILL + "SELECT * FROM filled")
add(
    "e32_convention_backfill",
    lambda t: conventions.from_proposals(backfilled(t)),
    BACKFILL + "SELECT span_lower, first(type ORDER BY seq) AS type, CASE WHEN count(DISTINCT type) = 1 THEN 'active' ELSE 'disputed' END AS status, first(source ORDER BY seq) AS source, count(*) AS evidence, count(DISTINCT task_id) AS n_tasks, false AS locked FROM filled GROUP BY span_lower",
)
add(
    "e32_backfill_counts",
    lambda t: conventions.backfill_counts(t.tasks, parse.effective_annotation(t.artifacts), t.tasks.where(TOUCHED).select("task_id")),
    BACKFILL + "SELECT count(*) AS n_scanned, count(*) FILTER (touched) AS n_touched, count(*) FILTER (NOT touched AND kind IS NULL) AS n_missing, count(*) FILTER (NOT touched AND kind IS NOT NULL AND NOT usable) AS n_unreadable FROM scanned",
)


def shown_proposals(t):
    """Proposals with the head of the row in which their task first says so."""
    rows = t.rows.select("task_id", "row_index", F.substring("input", 1, 80).alias("head"))  # before the join, which then ships heads and not texts
    heads = t.spans.join(rows, ["task_id", "row_index"]).groupBy(F.lower("span").alias("span_lower"), "type", "task_id").agg(F.min_by("head", F.struct("row_index", "pos")).alias("context"))
    return t.proposals.join(heads, ["span_lower", "type", "task_id"])


DIVERSE = """, shown AS (SELECT p.*, context FROM proposals p JOIN (SELECT lower(span) AS span_lower, type, s.task_id, substr(input, 1, 80) AS context FROM spans s JOIN src_rows r ON r.task_id = s.task_id AND r.row_index = s.row_index QUALIFY row_number() OVER (PARTITION BY lower(span), type, s.task_id ORDER BY s.row_index, pos) = 1) h USING (span_lower, type, task_id)),
texts AS (SELECT DISTINCT span_lower, type, concat('[', task_id, '] ', context) AS text FROM shown WHERE trim(context) <> ''),
grams AS (SELECT *, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS items FROM (SELECT *, regexp_extract_all(lower(text), '\\S+') AS w FROM texts)),
p1 AS (SELECT * FROM grams QUALIFY row_number() OVER (PARTITION BY span_lower, type ORDER BY text) = 1),
s1 AS (SELECT g.*, coalesce(len(list_intersect(g.items, p.items)) / nullif(len(list_distinct(list_concat(g.items, p.items))), 0), 0.0) AS near FROM grams g JOIN p1 p USING (span_lower, type) WHERE g.text <> p.text),
p2 AS (SELECT * FROM s1 QUALIFY row_number() OVER (PARTITION BY span_lower, type ORDER BY near, text) = 1),
s2 AS (SELECT g.span_lower, g.type, g.text, greatest(g.near, coalesce(len(list_intersect(g.items, p.items)) / nullif(len(list_distinct(list_concat(g.items, p.items))), 0), 0.0)) AS near FROM s1 g JOIN p2 p USING (span_lower, type) WHERE g.text <> p.text),
p3 AS (SELECT * FROM s2 QUALIFY row_number() OVER (PARTITION BY span_lower, type ORDER BY near, text) = 1),
picked AS (SELECT span_lower, type, 1 AS rank, text FROM p1 UNION ALL SELECT span_lower, type, 2, text FROM p2 UNION ALL SELECT span_lower, type, 3, text FROM p3)
"""
add("f16_diverse_examples", lambda t: similarity.diverse_examples(shown_proposals(t).where(F.trim("context") != "").select("span_lower", "type", F.concat(F.lit("["), "task_id", F.lit("] "), "context").alias("text")), ["span_lower", "type"]), DIVERSE + "SELECT * FROM picked")


def past_experience(t):
    t = held(t)
    return conventions.past_experience(agreed_conventions(t), written(shown_proposals(t)), stats.frequency_scores(t.spans, stats.zipf_table(t.rows)))


add(
    "e23_past_experience",
    past_experience,
    STATS + ZIPF + DIVERSE + "SELECT span_lower, s.type, s.n, coalesce(examples, '') AS examples, coalesce(status, 'none') AS status, c.type AS convention, coalesce(evidence, 0) AS evidence, round(coalesce(score, 0), 3) AS zipf, coalesce(score, 0) >= 5 AND coalesce(evidence, 0) < 5 AS generic_word FROM (SELECT span_lower, type, count(*) AS n FROM shown GROUP BY ALL) s LEFT JOIN (SELECT span_lower, type, string_agg(text, ' | ' ORDER BY rank) AS examples FROM picked GROUP BY ALL) e USING (span_lower, type) LEFT JOIN conventions c USING (span_lower) LEFT JOIN scored USING (span_lower)",
)
add(
    "e31_policy_drift",
    lambda t: conventions.policy_drift(accepted_decisions(t), agreed_conventions(t)),
    STATS + "SELECT span_lower, v.type AS convention, count(DISTINCT task_id) AS n_tasks, string_agg(DISTINCT d.type, ',' ORDER BY d.type) AS types FROM decisions d JOIN tasks USING (task_id) JOIN conventions v USING (span_lower) WHERE tasks.status = 'accepted' AND v.status = 'active' AND d.type <> v.type GROUP BY ALL",
)

# --- consensus -------------------------------------------------------------------------------------------------------------

SUPPORT = ", support AS (SELECT task_id, row_index, field, type, span, count(DISTINCT draft) AS support FROM drafts GROUP BY ALL)\n"
SCORE = "round_even({0}, 4) AS precision, round_even({1}, 4) AS recall, round_even(CASE WHEN {0} + {1} = 0 THEN 0.0 ELSE 2 * {0} * {1} / ({0} + {1}) END, 4) AS f1"
P, Q = "(CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END)", "(CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END)"
add("g01_agreed", lambda t: consensus.agreed(t.drafts), SUPPORT + "SELECT * FROM support WHERE support >= 2")
add("g02_disagreements", lambda t: consensus.disagreements(t.drafts), SUPPORT + "SELECT * FROM support WHERE support < 2")
add(
    "g03_merge_table",
    lambda t: consensus.merge_table(t.drafts, t.rows),
    SUPPORT + "SELECT task_id, row_index, coalesce(string_agg(concat_ws('/', field, type, span), '|' ORDER BY concat_ws('/', field, type, span)) FILTER (support >= 2), '') AS agreed, coalesce(string_agg(concat(concat_ws('/', field, type, span), ':', support::VARCHAR), '|' ORDER BY concat(concat_ws('/', field, type, span), ':', support::VARCHAR)) FILTER (support < 2), '') AS disputed, any_value(length(input))::INT AS n_chars FROM support LEFT JOIN src_rows USING (task_id, row_index) GROUP BY task_id, row_index",
)
add("g04_quorum_errors", lambda t: consensus.quorum_errors(t.drafts, t.tasks, 3), "SELECT task_id, coalesce(n, 0) AS n_drafts FROM tasks LEFT JOIN (SELECT task_id, count(DISTINCT draft) AS n FROM drafts GROUP BY task_id) USING (task_id) WHERE coalesce(n, 0) < 3")
SAMPLE = ", sample AS (SELECT task_id FROM tasks WHERE status = 'accepted' ORDER BY md5(concat('0|', task_id)), task_id LIMIT 60), lines AS (SELECT task_id, row_index, row_number() OVER (ORDER BY task_id, row_index)::INT AS line FROM src_rows SEMI JOIN sample USING (task_id)), chunks AS (SELECT *, ((line - 1) // 30)::INT AS chunk FROM lines)\n"
add(
    "t07_ratio_sample",
    lambda t: consensus.task_sample(t.tasks, ratio=0.13),
    "SELECT task_id FROM (SELECT task_id, row_number() OVER (ORDER BY md5(concat('0|', task_id)), task_id) AS k, count(*) OVER () AS n FROM tasks WHERE status = 'accepted') WHERE k <= greatest(1, ceil(round(n * 0.13, 6)))",
)
add("t07_task_sample", lambda t: consensus.task_sample(t.tasks, n=60), SAMPLE + "SELECT * FROM sample")
add("g05_sampled_rows", lambda t: consensus.sampled_rows(consensus.task_sample(t.tasks, n=60), t.rows), SAMPLE + "SELECT * FROM chunks")
add(
    "g06_chunk_scores",
    lambda t: consensus.chunk_scores(t.judge_failures, t.spans, consensus.sampled_rows(consensus.task_sample(t.tasks, n=60), t.rows)),
    SAMPLE + f""", keyed AS (SELECT *, concat(task_id, ':', row_index::VARCHAR) AS id FROM chunks), n AS (SELECT chunk, count(*) AS n_spans FROM spans JOIN keyed USING (task_id, row_index) GROUP BY chunk),
x AS (SELECT pass, chunk, greatest(any_value(n_spans) - sum(fp_delta), 0)::BIGINT AS tp, sum(fp_delta)::BIGINT AS fp, sum(fn_delta)::BIGINT AS fn FROM judge_failures JOIN keyed USING (id) JOIN n USING (chunk) GROUP BY ALL) SELECT *, {SCORE.format(P, Q)} FROM x""",
)
add("g07_pass_scores", lambda t: consensus.pass_scores(t.judge_failures, t.spans), f", x AS (SELECT pass, greatest((SELECT count(*) FROM spans) - sum(fp_delta), 0)::BIGINT AS tp, sum(fp_delta)::BIGINT AS fp, sum(fn_delta)::BIGINT AS fn FROM judge_failures GROUP BY pass) SELECT *, {SCORE.format(P, Q)} FROM x")
MAJ = ", votes AS (SELECT id, span, sum(fp_delta)::BIGINT AS fp_votes, sum(fn_delta)::BIGINT AS fn_votes FROM judge_failures GROUP BY ALL)\n"
add("g08_majority_failures", lambda t: consensus.majority_failures(t.judge_failures), MAJ + "SELECT *, fp_votes >= 2 AS fp, fn_votes >= 2 AS fn FROM votes WHERE fp_votes >= 2 OR fn_votes >= 2")
add(
    "g09_majority_score",
    lambda t: consensus.majority_score(t.judge_failures, t.spans),
    MAJ + f", x AS (SELECT (SELECT count(*) FROM spans) AS n_spans, count(*) FILTER (fp_votes >= 2) AS fp, count(*) FILTER (fn_votes >= 2) AS fn, (SELECT sum(a)::BIGINT FROM (SELECT max(fp_delta) AS a FROM judge_failures GROUP BY id, span)) AS fp_any, (SELECT sum(b)::BIGINT FROM (SELECT max(fn_delta) AS b FROM judge_failures GROUP BY id, span)) AS fn_any FROM votes), y AS (SELECT *, greatest(n_spans - fp, 0) AS tp FROM x), z AS (SELECT n_spans, fp, fn, fp_any, fn_any, {SCORE.format(P, Q)} FROM y) SELECT *, precision >= 0.98 AND f1 >= 0.95 AS passed FROM z",
)


def strict(rows: list[dict]) -> list[dict]:
    """A judge that flags spans ending in X as wrong, and can't take rows that name an error."""
    if any("quoth" in (r["input"] or "").lower() for r in rows) or len(rows) == 29:
        raise ValueError("no verdict")
    return [{"id": r["id"], "span": s.split("=", 1)[1], "fp_delta": 1, "fn_delta": 0} for r in rows for s in r["spans"] if s.endswith("X")]


add(
    "g14_judged",
    lambda t: consensus.judged(consensus.sampled_rows(consensus.task_sample(t.tasks, n=60), t.rows), t.rows, t.spans, strict, 2),
    SAMPLE + """, own AS (SELECT c.chunk, concat(c.task_id, ':', c.row_index::VARCHAR) AS id, input FROM chunks c JOIN src_rows r ON r.task_id = c.task_id AND r.row_index = c.row_index),
bad AS (SELECT chunk FROM own GROUP BY chunk HAVING count(*) = 29 OR bool_or(contains(lower(input), 'quoth'))),
passes AS (SELECT 1 AS pass UNION ALL SELECT 2)
SELECT pass, chunk, id, span, 1 AS fp_delta, 0 AS fn_delta, NULL::VARCHAR AS error FROM passes, own JOIN (SELECT concat(task_id, ':', row_index::VARCHAR) AS id, span FROM spans WHERE span LIKE '%X') s USING (id) ANTI JOIN bad USING (chunk)
UNION ALL SELECT pass, chunk, NULL, NULL, NULL, NULL, 'ValueError: no verdict' FROM passes, bad""",
)
EVERY_TYPE = [*(f"type{x}" for x in "0123456789abcdef"), "other"]
#: Whom a task may go to: id, enabled, and the types that each doesn't do.
CREW = [("a1", False, []), ("a2", True, EVERY_TYPE[3:16]), ("a3", True, EVERY_TYPE[8:12]), ("a4", True, EVERY_TYPE[:2]), ("a5", True, ["typef"])]
ANNOTATORS = "(VALUES " + ", ".join(f"('{a}', {str(on).lower()}, 'text', {[x for x in EVERY_TYPE if x not in lacks]})" for a, on, lacks in CREW) + ") a(annotator_id, enabled, modality, types)"


def crew(t):
    return t.spark.createDataFrame([(a, on, ["text"], [x for x in EVERY_TYPE if x not in lacks]) for a, on, lacks in CREW], "annotator_id string, enabled boolean, modalities array<string>, types array<string>")


add(
    "g13_chosen_annotators",
    lambda t: consensus.choose_annotator(t.spans.groupBy("task_id").agg(F.collect_set("type").alias("types")).withColumn("modality", F.lit("text")), crew(t)),
    f", w AS (SELECT task_id, list(DISTINCT type) AS types FROM spans GROUP BY task_id) SELECT w.task_id, min(annotator_id) AS annotator_id FROM w LEFT JOIN {ANNOTATORS} ON enabled AND list_has_all(a.types, w.types) GROUP BY w.task_id",
)
OPINION = "CASE substr(md5(concat(task_id, span_lower, 'o')), 1, 1) WHEN '0' THEN NULL WHEN '1' THEN 'third' WHEN '2' THEN top_type WHEN '3' THEN top_type ELSE type END"
DOUBT = "CASE substr(md5(concat(task_id, span_lower, 'c')), 1, 1) WHEN '0' THEN 0.2 ELSE 0.9 END"
add(
    "g15_second_opinions",
    lambda t: consensus.second_opinions(checked(t).where("verdict = 'divergent'").select("task_id", F.col("span_lower").alias("span"), F.col("type").alias("first"), F.col("top_type").alias("prior"), F.expr(OPINION).alias("second"), F.expr(DOUBT).cast("double").alias("confidence"))),
    STATS + f"SELECT *, CASE WHEN confidence < 0.5 OR second IS NULL THEN 'review' WHEN second = first THEN 'keep' WHEN second = prior THEN 'flip' ELSE 'review' END AS action FROM (SELECT task_id, span_lower AS span, type AS first, top_type AS prior, {OPINION} AS second, ({DOUBT})::DOUBLE AS confidence FROM checked WHERE verdict = 'divergent')",
)
GOLD = ", g AS (SELECT DISTINCT task_id, row_index, type, span, 1 AS g FROM spans), p AS (SELECT DISTINCT task_id, row_index, type, span, 1 AS p FROM drafts WHERE draft = 1), by_row AS (SELECT task_id, row_index, count(*) FILTER (g = 1 AND p = 1) AS tp, count(*) FILTER (p IS NULL) AS missing, count(*) FILTER (g IS NULL) AS extra FROM g FULL JOIN p USING (task_id, row_index, type, span) GROUP BY ALL)\n"
add("g10_gold_by_row", lambda t: consensus.gold_by_row(t.spans, t.drafts.where("draft = 1")), GOLD + "SELECT * FROM by_row")
add("g10_gold_score", lambda t: consensus.gold_score(t.spans, t.drafts.where("draft = 1")), GOLD + f", x AS (SELECT sum(tp)::BIGINT AS tp, sum(extra)::BIGINT AS fp, sum(missing)::BIGINT AS fn FROM by_row) SELECT *, {SCORE.format(P, Q)} FROM x")
add("g11_qc_sample", lambda t: consensus.qc_sample(t.rows, 0.3), "SELECT task_id, row_index FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY row_index) AS place, count(*) OVER (PARTITION BY task_id) AS n FROM src_rows) WHERE place <= greatest(1, ceil(round(n * 0.3, 6)))")
add(
    "g12_rescaled",
    lambda t: consensus.rescaled(t.attempts.select("task_id", "seq", "stage", "dur_s", "finished_at"), "stage", "dur_s", ["finished_at", "task_id", "seq"]).select("task_id", "seq", F.round("scaled", 6).alias("scaled")),
    "SELECT task_id, seq, round(CASE WHEN n < 10 OR hi = lo THEN dur_s ELSE (dur_s - lo) / (hi - lo) END, 6) AS scaled FROM (SELECT *, min(dur_s) OVER w AS lo, max(dur_s) OVER w AS hi, count(*) OVER w AS n FROM attempts WINDOW w AS (PARTITION BY stage ORDER BY finished_at, task_id, seq ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))",
)
