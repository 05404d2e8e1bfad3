"""Defect finders: each gives one row per violation, from spans and the source rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import stripped, without_trailing, word_count

ROW = ["task_id", "row_index"]
AT = ["task_id", "row_index", "field", "type", "pos", "span"]


def non_verbatim(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """Spans that their row's text doesn't hold letter by letter. Rows without text are skipped."""
    joined = spans.join(rows.where(F.col("input").isNotNull()), ROW)
    return joined.where(~F.contains("input", "span")).select(*AT)


def trailing_punctuation(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """Spans that end in sentence punctuation although the text also holds them without it."""
    trimmed = without_trailing(F.col("span"))
    joined = spans.join(rows, ROW).withColumn("trimmed", trimmed)
    return joined.where((F.col("trimmed") != F.col("span")) & (F.col("trimmed") != "") & F.contains("input", "trimmed")).select(*AT, "trimmed")


def repeated_spans(spans: DataFrame) -> DataFrame:
    """Every occurrence of a span after the first of its row, field and type."""
    w = Window.partitionBy("task_id", "row_index", "field", "type", "span").orderBy("pos")
    return spans.withColumn("n", F.row_number().over(w)).where("n > 1").select(*AT)


def type_collisions(spans: DataFrame, field: str = "entities") -> DataFrame:
    """Spans of a field that stand under another type earlier in the row, with that type."""
    w = Window.partitionBy("task_id", "row_index", "span").orderBy("pos")
    first = spans.where(F.col("field") == field).withColumn("first_type", F.first("type").over(w))
    return first.where(F.col("type") != F.col("first_type")).select(*AT, "first_type")


def misplaced_shared(spans: DataFrame, type_enum: DataFrame) -> DataFrame:
    """Spans of a type that both fields allow which stand in the wrong one: single words belong to entities, longer ones to structures."""
    shared = type_enum.groupBy("type").agg(F.countDistinct("field").alias("n")).where("n = 2").select("type")
    should = F.when(word_count(F.col("span")) > 1, "json_structures").otherwise("entities")
    return spans.join(shared, "type", "left_semi").withColumn("should", should).where("field <> should").select(*AT, "should")


def missing_rows(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Per task the source rows that the output lacks: how many and the first five."""
    lost = rows.join(spans.select(*ROW).distinct(), ROW, "left_anti")
    return lost.groupBy("task_id").agg(F.count("*").alias("n_missing"), F.array_join(F.slice(F.sort_array(F.collect_set("row_index")), 1, 5), ",").alias("first_missing"))


def schema_violations(parsed: DataFrame, type_enum: DataFrame, most_spans: int = 1_000, text_col: str = "payload") -> DataFrame:
    """task_id, rule and detail for parsed annotations that break a rule: unreadable (no JSON object), rows_type (rows isn't a list), no_rows,
    row_output (a row without output), too_many (a type of a row has more than most_spans spans), type (not allowed in its field)."""
    from spanloom.functions.text import without_thoughts
    from spanloom.operators.parse import explode_spans

    text = without_thoughts(F.col(text_col))
    rows = F.coalesce(F.get_json_object(text, "$.rows"), F.get_json_object(F.regexp_extract(text, r"(?s)\{.*\}", 0), "$.rows"))
    bad = parsed.where("not ok").select("task_id", F.when(rows.isNull(), "unreadable").otherwise("rows_type").alias("rule"), F.lit("").alias("detail"))
    good = parsed.where("ok")
    empty = good.where("size(parsed.rows) = 0").select("task_id", F.lit("no_rows").alias("rule"), F.lit("").alias("detail"))
    lacking = F.size(F.filter("parsed.rows", lambda r: r.output.isNull()))
    bare = good.where(lacking > 0).select("task_id", F.lit("row_output").alias("rule"), lacking.cast("string").alias("detail"))
    spans = explode_spans(good)
    each = F.concat_ws(".", "field", "type").alias("detail")
    many = spans.groupBy(*ROW, "field", "type").agg(F.count("*").alias("n")).where(F.col("n") > most_spans).select("task_id", F.lit("too_many").alias("rule"), each).distinct()
    wrong = spans.join(type_enum, ["field", "type"], "left_anti").select("task_id", F.lit("type").alias("rule"), each).distinct()
    return bad.unionByName(empty).unionByName(bare).unionByName(many).unionByName(wrong)


def first_failure(spans: DataFrame, rows: DataFrame, type_enum: DataFrame) -> DataFrame:
    """The first failing check of each task, in a fixed order, and its violations. One join of spans and rows, one window in a row and one
    aggregate by task see all of them."""
    shared = type_enum.groupBy("type").agg(F.countDistinct("field").alias("n")).where("n = 2").select("type", F.lit(True).alias("shared"))
    trimmed = without_trailing(F.col("span"))
    should = F.when(word_count(F.col("span")) > 1, "json_structures").otherwise("entities")
    entity = F.col("field") == "entities"
    w = Window.partitionBy(*ROW, entity, "span").orderBy("pos")
    joined = spans.withColumn("there", F.lit(True)).join(rows.withColumn("is_row", F.lit(True)), ROW, "full_outer").join(shared, "type", "left")
    joined = joined.withColumn("collides", F.col("there") & entity & (F.first("type").over(w) != F.col("type")))
    hits = {
        "missing_rows": F.max(F.when(F.col("is_row") & F.col("there").isNull(), 1)),  # tasks, not rows, are counted
        "non_verbatim": F.count_if(F.col("there") & F.col("input").isNotNull() & ~F.contains("input", "span")),
        "cross_type": F.count_if("collides"),
        "punctuation": F.count_if(F.col("there") & (trimmed != F.col("span")) & (trimmed != "") & F.contains("input", trimmed)),
        "shared_type": F.count_if(F.col("there") & F.col("shared") & (F.col("field") != should)),
    }
    per = joined.groupBy("task_id").agg(*(F.coalesce(n, F.lit(0)).cast("long").alias(name) for name, n in hits.items()))
    first = F.coalesce(*(F.when(F.col(name) > 0, F.struct(F.lit(name).alias("category"), F.col(name).alias("n"))) for name in hits))
    return per.select("task_id", first.alias("f")).where("f is not null").select("task_id", "f.category", F.col("f.n").alias("n_violations"))


def export_audit(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """Violations by kind, field and type."""
    kinds = {"duplicate": repeated_spans(spans), "non_verbatim": non_verbatim(spans, rows), "cross_type": type_collisions(spans)}
    found = None
    for name, frame in kinds.items():
        one = frame.groupBy("field", "type").agg(F.count("*").alias("n")).withColumn("kind", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found.select("kind", "field", "type", "n")


def template_rows(rows: DataFrame, pattern: str) -> DataFrame:
    """Per task with a row that matches: hits, rows, and whether all match."""
    hits = rows.groupBy("task_id").agg(F.count_if(F.col("input").rlike(pattern)).alias("n_hits"), F.count("*").alias("n_rows"))
    return hits.where("n_hits > 0").withColumn("pure", F.col("n_hits") == F.col("n_rows"))


def hallucination_resets(spans: DataFrame, rows: DataFrame, least: int = 50, share: float = 0.7) -> DataFrame:
    """Tasks of which at least `least` spans, and at least that share, aren't in the text."""
    total = spans.groupBy("task_id").agg(F.count("*").alias("n_spans"))
    bad = non_verbatim(spans, rows).groupBy("task_id").agg(F.count("*").alias("n_stripped"))
    return total.join(bad, "task_id").where((F.col("n_stripped") >= least) & (F.col("n_stripped") >= share * F.col("n_spans")))


def placeholders(spans: DataFrame, exempt: tuple[str, ...] = ("time",)) -> DataFrame:
    """Redacted spans: runs of X or of asterisks, or a bracketed redaction mark."""
    mark = F.col("span").rlike(r"X{4,}|x{4,}") | F.col("span").rlike(r"\*{3,}") | F.col("span").rlike(r"(?i)\[(?:redacted|removed)\]")
    return spans.where(mark & ~F.col("type").isin(*exempt)).select(*AT)


def bare_names(spans: DataFrame, type_name: str, verbs: str) -> DataFrame:
    """Structure spans of a type that equal an entity of the row, whatever the case, or hold no verb."""
    entities = spans.where("field = 'entities'").select(*ROW, F.lower("span").alias("low")).distinct()
    names = spans.where((F.col("field") == "json_structures") & (F.col("type") == type_name)).withColumn("low", F.lower("span"))
    marked = names.join(entities.withColumn("known", F.lit(True)), [*ROW, "low"], "left")
    return marked.where(F.col("known").isNotNull() | ~F.col("span").rlike(verbs)).select(*AT)


def nested_spans(spans: DataFrame) -> DataFrame:
    """Spans that are part of another, longer span of the same row and type. The row's distinct spans are compared, never pairs of rows."""
    groups = spans.groupBy(*ROW, "type").agg(F.collect_set("span").alias("all"))
    found = groups.select(*ROW, "type", F.explode(F.filter("all", lambda x: F.exists(F.col("all"), lambda y: (y != x) & F.contains(y, x)))).alias("span"))
    return found


def candidate_sentences(failed: DataFrame, rows: DataFrame, top: int = 6) -> DataFrame:
    """For each failed span the sentences of its row with most of its words; ties go to the shorter, then to the smaller text."""
    sentence = F.explode(F.array_distinct(F.filter(F.transform(F.split("input", "[.!?。！？\n]+"), stripped), lambda s: s != "")))
    words = F.array_distinct(F.split(F.lower("span"), r"\s+"))
    score = F.size(F.filter(words, lambda w: (w != "") & F.contains(F.lower("sentence"), w)))
    scored = failed.join(rows, ROW).select(*ROW, "span", sentence.alias("sentence")).distinct().withColumn("score", score).where("score > 0")
    w = Window.partitionBy(*ROW, "span").orderBy(F.desc("score"), F.length("sentence"), "sentence")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def destination(spans: DataFrame, type_enum: DataFrame) -> DataFrame:
    """Where each (span, type) belongs: its only field, or for a shared type the one its words ask for; 'unknown' for other types."""
    fields = type_enum.groupBy("type").agg(F.collect_set("field").alias("allowed"))
    joined = spans.select("span", "type").distinct().join(fields, "type", "left")
    by_words = F.when(word_count(F.col("span")) > 1, "json_structures").otherwise("entities")
    return joined.select("span", "type", F.when(F.col("allowed").isNull(), "unknown").when(F.size("allowed") == 1, F.col("allowed")[0]).otherwise(by_words).alias("destination"))


def tasks_with_defects(defects: DataFrame, tasks: DataFrame, status: str) -> DataFrame:
    """Tasks of a status with violations, and how many."""
    own = tasks.where(F.col("status") == status).select("task_id")
    return defects.join(own, "task_id", "left_semi").groupBy("task_id").agg(F.count("*").alias("n_violations"))


def typical_text(spans: DataFrame, rows: DataFrame, span: str, exclude: DataFrame | None = None, seed: str = "") -> DataFrame:
    """One row that holds an annotated span, chosen by a hash, and how many there are to choose from."""
    own = spans.where(F.lower("span") == span.lower()).select(*ROW).distinct()
    if exclude is not None:
        own = own.join(exclude, ROW, "left_anti")
    found = own.join(rows, ROW).withColumn("order", F.md5(F.concat_ws("|", F.lit(seed), "task_id", F.col("row_index").cast("string"))))
    picked = found.agg(F.count("*").alias("n_rows"), F.min_by(F.struct("task_id", "row_index", "input"), F.struct("order", "task_id", "row_index")).alias("p"))
    return picked.select("p.task_id", "p.row_index", "p.input", "n_rows")
