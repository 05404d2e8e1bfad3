"""Repairs of span tables: each gives the repaired spans, or what it changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.runs import meant_pieces
from spanloom.functions.text import EDGES, stripped, without_trailing, word_count
from spanloom.operators.defects import bare_names, nested_spans, placeholders
from spanloom.operators.parse import KEY, missing_row_stubs, rename_types

ROW = ["task_id", "row_index"]


def aligned(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds fixed: the span if its text holds it, else the span without punctuation and quotes at its edges if the text holds that, else
    the first place of the text that differs in white space only; null if there is none. Rows without text leave spans as they are."""
    joined = spans.join(rows, ROW, "left")
    trimmed = F.regexp_replace("span", EDGES, "")
    loose = F.concat(F.lit(r"\Q"), F.regexp_replace(stripped(F.col("span")), r"(?U)\s+", r"\\E\\s+\\Q"), F.lit(r"\E"))
    found = F.coalesce(F.regexp_substr("input", loose), F.lit(""))
    fixed = F.when(F.col("input").isNull() | F.contains("input", "span"), F.col("span")).when((trimmed != "") & F.contains("input", trimmed), trimmed)
    fixed = fixed.when((stripped(F.col("span")) != "") & (found != ""), found)
    return joined.withColumn("fixed", fixed).drop("input")


def safe_fixes(spans: DataFrame, rows: DataFrame, keep_text: bool = False) -> DataFrame:
    """Adds fixed (and, to keep the text, input): a verbatim span without trailing punctuation if the text holds that too; others by their edges; null if nothing fits."""
    joined = spans.join(rows, ROW, "left")
    trimmed, edges = without_trailing(F.col("span")), F.regexp_replace("span", EDGES, "")
    holds = lambda x: F.coalesce(F.contains("input", x), F.lit(False)) & (x != "")
    verbatim = F.col("input").isNull() | holds(F.col("span"))
    fixed = F.when(verbatim, F.when(holds(trimmed), trimmed).otherwise(F.col("span"))).when(holds(edges), edges)
    return joined.withColumn("fixed", fixed).drop(*([] if keep_text else ["input"]))


def rerouted(spans: DataFrame, type_enum: DataFrame) -> DataFrame:
    """Spans of shared types in the field that their words ask for, merged without repeats; moved tells which changed."""
    shared = type_enum.groupBy("type").agg(F.countDistinct("field").alias("n")).where("n = 2").select("type", F.lit(True).alias("both"))
    field = F.when(F.coalesce("both", F.lit(False)), F.when(word_count(F.col("span")) > 1, "json_structures").otherwise("entities")).otherwise(F.col("field"))
    new = spans.join(shared, "type", "left").withColumn("to", field).withColumn("moved", F.col("to") != F.col("field"))
    return new.withColumn("field", F.col("to")).groupBy(*KEY).agg(F.min("pos").alias("pos"), F.bool_or("moved").alias("moved"))


def retyped(spans: DataFrame, decisions: DataFrame, type_enum: DataFrame) -> DataFrame:
    """Spans after decisions (span, old_type, new_type): the span leaves the old type and joins the new one, in its field; a null new
    type deletes it; one that no field allows too. Of several decisions on one span and type the one with the least new type counts."""
    decisions = decisions.groupBy("span", "old_type").agg(F.min("new_type").alias("new_type"))
    fields = type_enum.groupBy(F.col("type").alias("new_type")).agg(F.collect_set("field").alias("allowed"))
    joined = spans.join(decisions.withColumn("hit", F.lit(True)), (spans["span"] == decisions["span"]) & (spans["type"] == decisions["old_type"]), "left").drop(decisions["span"]).join(fields, "new_type", "left")
    by_words = F.when(word_count(F.col("span")) > 1, "json_structures").otherwise("entities")
    to = F.when(F.size("allowed") == 1, F.col("allowed")[0]).otherwise(by_words)
    hit = F.col("hit").isNotNull()
    kept = joined.where(~hit | F.col("allowed").isNotNull())
    return kept.select(*ROW, F.when(hit, to).otherwise(F.col("field")).alias("field"), F.when(hit, F.col("new_type")).otherwise(F.col("type")).alias("type"), "span", "pos").groupBy(*KEY).agg(F.min("pos").alias("pos"))


def picked(spans: DataFrame, picks: DataFrame) -> DataFrame:
    """Spans after operator picks (task_id, row_index, span, field, type): a picked span stands in its target only."""
    rest = spans.select(*KEY).join(picks.select(*ROW, "span"), [*ROW, "span"], "left_anti")
    return rest.select(*KEY).unionByName(picks.select(*KEY)).distinct()


def bulk_removed(spans: DataFrame, unwanted: DataFrame, tasks: DataFrame) -> DataFrame:
    """Spans without those of accepted tasks whose lower-case form is unwanted (span_lower)."""
    accepted = tasks.where("status = 'accepted'").select("task_id")
    low = spans.withColumn("span_lower", F.lower(stripped(F.col("span"))))
    bad = low.join(unwanted.select("span_lower"), "span_lower", "left_semi").join(accepted, "task_id", "left_semi")
    return spans.join(bad.select(*KEY, "pos"), [*KEY, "pos"], "left_anti")


def recovered(spans: DataFrame, rows: DataFrame, keep_text: bool = False) -> DataFrame:
    """Adds fixed (and, to keep the text, input), a piece of the row's text that the span probably means: the span itself if the text holds it; else its first place whatever
    the case; the same without white space at its ends, and with inner white space as single blanks; else their longest common run of
    characters, whatever the case, of at least 4 and 70 % of the span (the first in the text if there are several). Null if there is none.
    Spans of rows without text stay as they are.

    Spans that stand in the text stay with Spark; only the rest goes to Python, once, where neighbours with one text share its lowered form, few
    runs are looked for one by one and for many a suffix automaton of the span reads the text once, and places of the lowered text are taken
    back to the original. Lowering a text for each span in Spark takes longer.
    """
    joined = spans.join(rows, ROW, "left")
    span, text = F.col("span"), F.col("input")
    there = F.contains(text, span)
    # else a filter on what it gives would be pushed below it, and all be worked out twice
    meant = F.pandas_udf(meant_pieces, "string").asNondeterministic()(F.when(~there, span), F.when(~there, text))
    fixed = joined.withColumn("fixed", F.when(text.isNull() | there & (span != ""), span).otherwise(meant))
    return fixed.drop(*([] if keep_text else ["input"]))


def first_types(spans: DataFrame, field: str = "entities") -> DataFrame:
    """Spans without those of a field that stand under another type earlier in the row."""
    w = Window.partitionBy(*ROW, "field", "span").orderBy("pos")
    return spans.withColumn("__first", F.first("type").over(w)).where((F.col("field") != field) | (F.col("type") == F.col("__first"))).drop("__first")


def autocleaned(spans: DataFrame, rows: DataFrame, fields: tuple[str, ...] = ("entities", "json_structures")) -> DataFrame:
    """Spans as a reviewer gets them: allowed fields only, recovered or else dropped, without trailing punctuation where the text holds them
    without, and under the first of several types of a row."""
    kept = recovered(spans.where(F.col("field").isin(*fields)), rows, keep_text=True).where("fixed is not null").withColumn("span", F.col("fixed")).drop("fixed")
    trimmed = without_trailing(F.col("span"))
    bare = kept.withColumn("span", F.when((trimmed != "") & F.contains("input", trimmed), trimmed).otherwise(F.col("span"))).drop("input")
    return first_types(bare).select(*KEY, "pos")


def prelabel_fixes(spans: DataFrame, rows: DataFrame, type_enum: DataFrame, renames: dict[str, str], known: list[str]) -> tuple[DataFrame, DataFrame]:
    """Prelabels fit for import: types renamed and unknown ones dropped, shared types in the field that their words ask for, spans aligned with
    the text or dropped, each entity once per row under its first type; and empty stubs for the rows that the prelabels lack."""
    moved = rerouted(rename_types(spans, renames, known), type_enum).drop("moved")
    whole = aligned(moved, rows).where("fixed is not null").withColumn("span", F.col("fixed")).drop("fixed")
    once = whole.groupBy(*KEY).agg(F.min("pos").alias("pos"))
    return first_types(once).select(*KEY, "pos"), missing_row_stubs(rows, spans)


def write_time(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """Spans as they are stored: safe fixes, then verbatim ones only, then each once per row, field and type. Rows without text keep theirs."""
    return stored_spans(spans, rows).where("there").groupBy(*KEY).agg(F.min("pos").alias("pos"))


def stored_spans(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """Spans after the safe fixes, and there: whether the row's text holds them."""
    fixed = safe_fixes(spans, rows, keep_text=True).withColumn("span", F.coalesce("fixed", "span"))
    return fixed.withColumn("there", F.col("input").isNull() | F.contains("input", "span")).drop("fixed", "input")


def write_time_counts(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """Per task what write_time() sees and strips, and the stubs that its missing rows get."""
    per = stored_spans(spans, rows).groupBy("task_id").agg(F.count("*").alias("n_total"), F.count_if(~F.col("there")).alias("n_stripped"))
    stubs = missing_row_stubs(rows, spans).groupBy("task_id").agg(F.count("*").alias("n_stubs"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return per.join(stubs, "task_id", "full_outer").select("task_id", zero("n_total"), zero("n_stripped"), zero("n_stubs"))


def rules_cleanup(spans: DataFrame, type_name: str, verbs: str) -> DataFrame:
    """Spans without bare names, placeholders and nested spans."""
    out = spans.join(bare_names(spans, type_name, verbs).select(*KEY, "pos"), [*KEY, "pos"], "left_anti")
    out = out.join(placeholders(out).select(*KEY, "pos"), [*KEY, "pos"], "left_anti")
    return out.join(nested_spans(out), [*ROW, "type", "span"], "left_anti")


def recoverable_tasks(spans: DataFrame, rows: DataFrame, tasks: DataFrame, status: str = "human_review") -> DataFrame:
    """Tasks of a status that have no defect left once the safe fixes are in, with the number of changed spans."""
    own = tasks.where(F.col("status") == status).select("task_id")
    fixes = safe_fixes(spans.join(own, "task_id", "left_semi"), rows, keep_text=True).withColumn("changed", F.col("fixed").isNotNull() & (F.col("fixed") != F.col("span")))
    fixed = fixes.withColumn("span", F.coalesce("fixed", "span"))
    trimmed = without_trailing(F.col("span"))
    absent = F.col("input").isNotNull() & ~F.contains("input", "span")
    trailing = F.coalesce((trimmed != F.col("span")) & (trimmed != "") & F.contains("input", trimmed), F.lit(False))
    entity = F.when(F.col("field") == "entities", F.col("type"))
    collides = F.min(entity).over(Window.partitionBy(*ROW, "span")) != F.max(entity).over(Window.partitionBy(*ROW, "span"))
    marked = fixed.withColumn("bad", absent | trailing | F.coalesce(collides, F.lit(False)))
    per = marked.groupBy("task_id").agg(F.count_if("changed").alias("n_changed"), F.bool_or("bad").alias("bad"))
    return per.where("not bad").select("task_id", "n_changed")


def with_row_ids(output: DataFrame, rows: DataFrame) -> DataFrame:
    """Output rows with the source's row_id, else row-<index>."""
    return output.join(rows.select(*ROW, "row_id"), ROW, "left").withColumn("row_id", F.coalesce("row_id", F.concat(F.lit("row-"), F.col("row_index").cast("string"))))


def decision_diff(new: DataFrame, prior: DataFrame) -> DataFrame:
    """First decision per task and span of entities whose type is new or other than before in the same row."""
    def firsts(frame: DataFrame) -> DataFrame:
        low = frame.where("field = 'entities'").withColumn("span_lower", F.lower("span"))
        return low.groupBy(*ROW, "span_lower").agg(F.min_by("type", "pos").alias("type"), F.min("pos").alias("pos"))

    joined = firsts(new).join(firsts(prior).select(*ROW, "span_lower", F.col("type").alias("old_type")), [*ROW, "span_lower"], "left")
    changed = joined.where(F.col("old_type").isNull() | (F.col("old_type") != F.col("type")))
    return changed.groupBy("task_id", "span_lower").agg(F.min(F.struct("row_index", "pos", "type", "old_type")).alias("f")).select("task_id", "span_lower", "f.row_index", "f.type", "f.old_type")


def flip_types(conflicts: DataFrame) -> DataFrame:
    """Decisions (span, old_type, new_type) of second opinions that flip."""
    return conflicts.where("action = 'flip'").select("span", F.col("first").alias("old_type"), F.col("prior").alias("new_type"))
