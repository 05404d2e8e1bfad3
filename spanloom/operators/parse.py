"""Annotation payloads and their normal form, the span table (task_id, row_index, pos, field, type, span)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import blank, stripped, without_thoughts

KEY = ["task_id", "row_index", "field", "type", "span"]
PAYLOAD = "struct<rows: array<struct<row_index: int, row_id: string, output: struct<entities: map<string, array<string>>, json_structures: map<string, array<string>>>>>>"


def parse_annotations(artifacts: DataFrame, text_col: str = "payload") -> DataFrame:
    """Adds parsed (struct) and ok: model text without thoughts and fences, read whole or from its outermost braces."""
    text = without_thoughts(F.col(text_col))
    whole, inner = F.from_json(text, PAYLOAD), F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), PAYLOAD)
    parsed = F.when(whole.getField("rows").isNotNull(), whole).otherwise(inner)
    return artifacts.withColumn("parsed", parsed).withColumn("ok", F.coalesce(F.col("parsed.rows").isNotNull(), F.lit(False)))


def explode_spans(parsed: DataFrame) -> DataFrame:
    """Span rows of parsed annotations, with type_pos and pos for their order; empty spans are dropped, repeated ones kept."""
    rows = parsed.select("task_id", F.posexplode("parsed.rows").alias("at", "row")).select("task_id", F.coalesce("row.row_index", F.lit(0)).alias("row_index"), "row.output")
    parts = [rows.select("task_id", "row_index", F.lit(f).alias("field"), F.posexplode(F.map_entries(f"output.{f}")).alias("type_pos", "e")) for f in ("entities", "json_structures")]
    both = parts[0].unionByName(parts[1])
    return both.select("task_id", "row_index", "field", "type_pos", F.col("e.key").alias("type"), F.posexplode("e.value").alias("pos", "span")).where(F.col("span") != "")


def row_inputs(sources: DataFrame) -> DataFrame:
    """task_id, row_index, input of imported rows (task_id, rows array<struct<row_index, input>>): a row without an index takes its place in the
    list; of rows with one index the last counts; rows without text are left out."""
    each = sources.select("task_id", F.posexplode("rows").alias("at", "r")).where("r.input is not null")
    last = each.groupBy("task_id", F.coalesce("r.row_index", "at").alias("row_index")).agg(F.max_by("r.input", "at").alias("input"))
    return last.select("task_id", "row_index", "input")


def annotation_json(payload: Column) -> Column:
    """The JSON object of a payload, as text: model text without thoughts and fences, from its outermost braces."""
    return F.regexp_extract(without_thoughts(payload), r"(?s)\{.*\}", 0)


def readable(payload: Column) -> Column:
    """Whether a payload holds a JSON object, as parse_annotations() reads it."""
    return F.try_parse_json(annotation_json(payload)).isNotNull()


def effective_annotation(artifacts: DataFrame, keep_payload: bool = False) -> DataFrame:
    """One row per task: its last human answer, else its last annotation; usable tells whether the payload can be read."""
    rank = F.when(F.col("kind") == "human_review_answer", 1).otherwise(0)
    best = artifacts.groupBy("task_id").agg(F.max_by(F.struct("seq", "kind", "payload"), F.struct(rank, F.col("seq"))).alias("b"))
    return best.select("task_id", "b.seq", "b.kind", F.coalesce(readable(F.col("b.payload")), F.lit(False)).alias("usable"), *(["b.payload"] if keep_payload else []))


def last_readable_annotation(artifacts: DataFrame) -> DataFrame:
    """One row per task (seq, kind): its last human answer; without one, its last annotation that can be read, past those that can't. A task
    whose last human answer can't be read has no row: no annotation stands in for a person's decision."""
    human = F.col("kind") == "human_review_answer"
    can = F.coalesce(readable(F.col("payload")), F.lit(False))
    best = artifacts.where(human | can).select("task_id", "seq", "kind", can.alias("can")).groupBy("task_id").agg(F.max_by(F.struct("seq", "kind", "can"), F.struct(human, F.col("seq"))).alias("b"))
    return best.where("b.can").select("task_id", "b.seq", "b.kind")


def span_decisions(spans: DataFrame) -> DataFrame:
    """Distinct (task_id, span, type) over both fields; blank spans are skipped, case is kept."""
    return spans.where(~blank(F.col("span"))).select("task_id", "span", "type").distinct()


def decisions_with_source(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """Distinct (task_id, span_lower, type) with the first row that holds each and that row's text."""
    folded = spans.where(~blank(F.col("span"))).withColumn("span_lower", F.lower(stripped(F.col("span"))))
    first = folded.groupBy("task_id", "span_lower", "type").agg(F.min(F.struct("row_index", "pos")).alias("f"))
    return first.select("task_id", "span_lower", "type", F.col("f.row_index").alias("row_index")).join(rows, ["task_id", "row_index"], "left").select("task_id", "span_lower", "type", "row_index", F.col("input").alias("content"))


def span_counts(spans: DataFrame) -> DataFrame:
    """Spans of each row: all, and those that aren't blank."""
    return spans.groupBy("task_id", "row_index").agg(F.count("*").alias("n_raw"), F.count_if(~blank(F.col("span"))).alias("n_spans"))


def without_masked(rows: DataFrame, masks: DataFrame) -> DataFrame:
    """Rows of any table keyed by task and row that no mask covers."""
    return rows.join(masks.select("task_id", "row_index"), ["task_id", "row_index"], "left_anti")


def task_text(rows: DataFrame, masks: DataFrame) -> DataFrame:
    """One text per task: its unmasked rows in order, joined by line feeds."""
    kept = without_masked(rows, masks).groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("row_index", "input"))).alias("r"))
    return kept.select("task_id", F.size("r").alias("n_rows"), F.array_join(F.transform("r", lambda x: F.coalesce(x.input, F.lit(""))), "\n").alias("text"))


def rebuild_rows(spans: DataFrame) -> DataFrame:
    """Per row, field and type its sorted distinct spans: the nested payload, one list per row here."""
    return spans.groupBy("task_id", "row_index", "field", "type").agg(F.sort_array(F.collect_set("span")).alias("spans"))


def rebuild_payload(spans: DataFrame) -> DataFrame:
    """task_id and payload, the annotation as JSON text: rows in order, each with its fields' types and sorted spans."""
    lists = rebuild_rows(spans)
    fields = lists.groupBy("task_id", "row_index").agg(*(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("type", "spans"))))).alias(f) for f in ("entities", "json_structures")))
    rows = fields.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("row_index", F.to_json(F.struct("entities", "json_structures")).alias("output")))).alias("r"))
    return rows.select("task_id", F.concat(F.lit('{"rows": ['), F.array_join(F.transform("r", lambda x: F.concat(F.lit('{"row_index": '), x.row_index.cast("string"), F.lit(', "output": '), x.output, F.lit("}"))), ", "), F.lit("]}")).alias("payload"))


def confidence_label(value: Column) -> Column:
    """The word for a confidence, which is clamped to 0..1; null for null and NaN."""
    x = F.when(~F.isnan(value), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))
    return F.when(x >= 0.85, "certain").when(x >= 0.65, "confident").when(x >= 0.40, "tentative").when(x.isNotNull(), "unsure")


def coerce_to_enum(spans: DataFrame, type_enum: DataFrame) -> DataFrame:
    """Adds outcome: 'kept' where the field allows the type, 'moved' where only the other field does (field is then that one), 'dropped'
    where none does."""
    own = type_enum.select(F.col("field").alias("own_field"), F.col("type").alias("own_type"))
    fields = own.groupBy("own_type").agg(F.collect_set("own_field").alias("allowed"))
    joined = spans.join(fields, spans["type"] == fields["own_type"], "left")
    fits = F.coalesce(F.array_contains("allowed", F.col("field")), F.lit(False))
    moved = joined.withColumn("outcome", F.when(fits, "kept").when(F.col("allowed").isNotNull(), "moved").otherwise("dropped"))
    return moved.withColumn("field", F.when(F.col("outcome") == "moved", F.col("allowed")[0]).otherwise(F.col("field"))).drop("allowed", "own_type")


def distinct_in_row(spans: DataFrame) -> DataFrame:
    """The first of equal spans of a row, field and type."""
    return spans.groupBy(*KEY).agg(F.min("pos").alias("pos"))


def missing_row_stubs(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows of the source that the output lacks, as empty outputs."""
    return rows.join(spans.select("task_id", "row_index").distinct(), ["task_id", "row_index"], "left_anti").select("task_id", "row_index", F.lit("{}").alias("output"))


def rename_types(spans: DataFrame, renames: dict[str, str], known: list[str]) -> DataFrame:
    """Spans with types renamed, merged without repeats; unknown types are dropped."""
    new = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in renames.items() for x in kv)), F.col("type")), F.col("type"))
    return spans.withColumn("type", new).where(F.col("type").isin(known)).groupBy(*KEY).agg(F.min("pos").alias("pos"))


def allowed_fields(spans: DataFrame, fields: tuple[str, ...] = ("entities", "json_structures")) -> DataFrame:
    return spans.where(F.col("field").isin(*fields))


def phrase_text(items: Column) -> Column:
    """A JSON list of phrases, bare or as objects with a text, as an array of their texts; others are left out."""
    texts = F.transform(F.from_json(items, "array<string>"), lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.text")).otherwise(x))
    return F.filter(texts, lambda x: x.isNotNull() & (x != ""))


def qc_feedback(decisions: DataFrame) -> DataFrame:
    """One row per failure of a QC decision (task_id, decision: JSON): its values, else the decision's; the confidence on the first only."""
    schema = "struct<category: string, severity: string, message: string, confidence: double, failures: array<struct<category: string, severity: string, message: string>>>"
    read = decisions.select("task_id", F.from_json("decision", schema).alias("d"))
    each = read.select("task_id", "d", F.posexplode_outer("d.failures").alias("at", "f"))
    pick = lambda c: F.coalesce(F.col(f"f.{c}"), F.col(f"d.{c}")).alias(c)
    return each.select("task_id", F.coalesce("at", F.lit(0)).alias("at"), pick("category"), pick("severity"), pick("message"), F.when(F.coalesce("at", F.lit(0)) == 0, F.col("d.confidence")).alias("confidence"))


def extracted_replies(annotations: DataFrame) -> DataFrame:
    """task_id, feedback_id, message of the replies in annotations (task_id, payload): at the top and in each row."""
    reply = "array<struct<feedback_id: string, message: string>>"
    read = annotations.select("task_id", F.from_json("payload", f"struct<discussion_replies: {reply}, rows: array<struct<discussion_replies: {reply}>>>").alias("p"))
    inner = F.flatten(F.filter(F.transform("p.rows", lambda r: r.discussion_replies), lambda x: x.isNotNull()))
    both = F.concat(F.coalesce("p.discussion_replies", F.array().cast(reply)), F.coalesce(inner, F.array().cast(reply)))
    return read.select("task_id", F.explode(both).alias("r")).select("task_id", "r.feedback_id", "r.message")


def discussion_replies(replies: DataFrame, feedback: DataFrame, stored: DataFrame) -> DataFrame:
    """Replies with a message to feedback that exists and isn't answered by the same message yet."""
    own = replies.where(~blank(F.col("message")))
    return own.join(feedback.select("feedback_id"), "feedback_id", "left_semi").join(stored.select("feedback_id", "message"), ["feedback_id", "message"], "left_anti")


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The last row of each key."""
    at = "__latest"
    return rows.withColumn(at, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(at) == 1).drop(at)
