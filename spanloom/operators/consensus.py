"""Consensus of annotators, majorities of judges, and accuracy."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.graph import in_ranges, numbered

ITEM = ["task_id", "row_index", "field", "type", "span"]


def support(drafts: DataFrame) -> DataFrame:
    """How many drafts hold each span item, one vote each."""
    return drafts.groupBy(*ITEM).agg(F.countDistinct("draft").alias("support"))


def agreed(drafts: DataFrame, keep: int = 2) -> DataFrame:
    return support(drafts).where(F.col("support") >= keep)


def disagreements(drafts: DataFrame, keep: int = 2) -> DataFrame:
    return support(drafts).where(F.col("support") < keep)


def merge_table(drafts: DataFrame, rows: DataFrame, keep: int = 2) -> DataFrame:
    """Per row its text length, agreed spans and disputed ones with their support."""
    item = F.concat_ws("/", "field", "type", "span")
    grouped = support(drafts).groupBy("task_id", "row_index").agg(
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("support") >= keep, item))), "|").alias("agreed"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("support") < keep, F.concat_ws(":", item, F.col("support").cast("string"))))), "|").alias("disputed")
    )
    return grouped.join(rows.select("task_id", "row_index", F.length("input").alias("n_chars")), ["task_id", "row_index"], "left")


def quorum_errors(drafts: DataFrame, tasks: DataFrame, least: int = 2) -> DataFrame:
    """Tasks with fewer valid drafts than that."""
    n = drafts.groupBy("task_id").agg(F.countDistinct("draft").alias("n_drafts"))
    return tasks.select("task_id").join(n, "task_id", "left").withColumn("n_drafts", F.coalesce("n_drafts", F.lit(0))).where(F.col("n_drafts") < least)


def task_sample(tasks: DataFrame, n: int | None = None, ratio: float | None = None, seed: str = "0") -> DataFrame:
    """A repeatable sample of accepted tasks, in order of a hash: n of them, or that ratio, one at least.

    A ratio finds its place on a histogram of the hash's first digits; only the one bucket in which the place lies is sorted.
    """
    order = tasks.where("status = 'accepted'").select("task_id", F.md5(F.concat_ws("|", F.lit(seed), "task_id")).alias("order"))
    if n is not None:
        return order.orderBy("order", "task_id").limit(n).select("task_id")
    bucket = F.substring("order", 1, 4)
    counts = sorted((r.bucket, r.n) for r in order.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).collect())  # 65,536 at most
    left = max(1, -(-sum(c for _, c in counts) * round(ratio * 1_000_000) // 1_000_000))
    for edge, c in counts:
        if c >= left:
            last = order.where(bucket == edge).orderBy("order", "task_id").limit(left).select("task_id")
            return order.where(bucket < edge).select("task_id").unionByName(last)
        left -= c
    return order.select("task_id")


def sampled_rows(sample: DataFrame, rows: DataFrame, chunk: int = 30) -> DataFrame:
    """Rows of the sampled tasks with flat line numbers and the chunk of each."""
    own = numbered(rows.join(sample, "task_id", "left_semi"), ["task_id", "row_index"], "line")
    return own.select("task_id", "row_index", (F.col("line") + 1).cast("int").alias("line"), F.floor(F.col("line") / chunk).cast("int").alias("chunk"))


def judged(chunks: DataFrame, rows: DataFrame, spans: DataFrame, judge: Callable[[list[dict]], list[dict]], passes: int = 3) -> DataFrame:
    """What a judge says of each chunk of sampled rows in each pass: pass, chunk, id, span, fp_delta, fn_delta, or, where it fails, error alone.

    judge maps rows (id, input, spans as field.type=span) to failures (id, span, fp_delta, fn_delta); it runs in the tasks, for one chunk at a
    time. A chunk without failures gives no row.
    """
    listed = spans.join(chunks.select("task_id", "row_index"), ["task_id", "row_index"], "left_semi").groupBy("task_id", "row_index").agg(F.array_sort(F.collect_list(F.concat(F.col("field"), F.lit("."), F.col("type"), F.lit("="), F.col("span")))).alias("spans"))
    full = chunks.join(rows, ["task_id", "row_index"]).join(listed, ["task_id", "row_index"], "left")
    full = full.select(F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("pass"), "chunk", "line", F.concat_ws(":", "task_id", F.col("row_index").cast("string")).alias("id"), "input", F.coalesce("spans", F.array().cast("array<string>")).alias("spans"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.sort_values("line")
        asked = [{"id": i, "input": t, "spans": list(s)} for i, t, s in zip(own["id"], own["input"], own["spans"], strict=True)]
        try:
            found = [(f["id"], f["span"], int(f["fp_delta"]), int(f["fn_delta"]), None) for f in judge(asked)]
        except Exception as e:  # a judge is foreign code: its failure is a row of the result
            found = [(None, None, None, None, f"{type(e).__name__}: {e}")]
        out = pd.DataFrame(found, columns=["id", "span", "fp_delta", "fn_delta", "error"])
        out.insert(0, "chunk", key[1])
        out.insert(0, "pass", key[0])
        return out

    return full.groupBy("pass", "chunk").applyInPandas(run, "pass int, chunk int, id string, span string, fp_delta int, fn_delta int, error string")


def scores(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision and recall, 1 where nothing counts, and F1, rounded half to even."""
    p = F.when(tp + fp == 0, F.lit(1.0)).otherwise(tp / (tp + fp))
    r = F.when(tp + fn == 0, F.lit(1.0)).otherwise(tp / (tp + fn))
    f = F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
    return tuple(F.bround(x, 4) for x in (p, r, f))


def pass_scores(failures: DataFrame, spans: DataFrame) -> DataFrame:
    """Per judge pass over all spans: tp, fp, fn and scores."""
    n = spans.agg(F.count("*").alias("n_spans"))
    per = failures.groupBy("pass").agg(F.sum("fp_delta").alias("fp"), F.sum("fn_delta").alias("fn")).crossJoin(F.broadcast(n))  # one row
    tp = F.greatest(F.col("n_spans") - F.col("fp"), F.lit(0))
    p, r, f = scores(tp, F.col("fp"), F.col("fn"))
    return per.select("pass", tp.alias("tp"), "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def chunk_scores(failures: DataFrame, spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """As pass_scores(), per pass and chunk of sampled rows; a chunk without failures scores 1."""
    keyed = chunks.withColumn("id", F.concat_ws(":", "task_id", F.col("row_index").cast("string")))
    n = spans.withColumn("id", F.concat_ws(":", "task_id", F.col("row_index").cast("string"))).join(keyed, "id").groupBy("chunk").agg(F.count("*").alias("n_spans"))
    bad = failures.join(keyed.select("id", "chunk"), "id").groupBy("pass", "chunk").agg(F.sum("fp_delta").alias("fp"), F.sum("fn_delta").alias("fn"))
    tp = F.greatest(F.col("n_spans") - F.col("fp"), F.lit(0))
    p, r, f = scores(tp, F.col("fp"), F.col("fn"))
    return bad.join(n, "chunk").select("pass", "chunk", tp.alias("tp"), "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def majority_failures(failures: DataFrame, passes: int = 3) -> DataFrame:
    """Keys (id, span) that more than half of the passes flag, as false positive or as false negative; a key repeated inside a pass
    counts each time."""
    key = failures.groupBy("id", "span").agg(F.sum("fp_delta").alias("fp_votes"), F.sum("fn_delta").alias("fn_votes"))
    need = passes // 2 + 1
    return key.withColumn("fp", F.col("fp_votes") >= need).withColumn("fn", F.col("fn_votes") >= need).where("fp or fn")


def majority_score(failures: DataFrame, spans: DataFrame, passes: int = 3, precision: float = 0.98, f1: float = 0.95) -> DataFrame:
    """Scores by majority over all spans, how many keys any pass flagged, and whether the gate is passed."""
    confirmed = majority_failures(failures, passes).agg(F.count_if("fp").alias("fp"), F.count_if("fn").alias("fn"))
    flagged = failures.groupBy("id", "span").agg(F.max("fp_delta").alias("a"), F.max("fn_delta").alias("b")).agg(F.sum("a").alias("fp_any"), F.sum("b").alias("fn_any"))
    n = spans.agg(F.count("*").alias("n_spans"))
    one = confirmed.crossJoin(flagged).crossJoin(n)  # one row each
    p, r, f = scores(F.greatest(F.col("n_spans") - F.col("fp"), F.lit(0)), F.col("fp"), F.col("fn"))
    out = one.select("n_spans", "fp", "fn", "fp_any", "fn_any", p.alias("precision"), r.alias("recall"), f.alias("f1"))
    return out.withColumn("passed", (F.col("precision") >= precision) & (F.col("f1") >= f1))


def gold_by_row(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per row: true positives, missing and extra distinct (type, span) pairs."""
    key = ["task_id", "row_index", "type", "span"]
    g, p = gold.select(*key).distinct().withColumn("g", F.lit(1)), predicted.select(*key).distinct().withColumn("p", F.lit(1))
    both = g.join(p, key, "full_outer")
    return both.groupBy("task_id", "row_index").agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("g").isNull()).alias("extra"))


def gold_score(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Micro scores over all rows."""
    total = gold_by_row(gold, predicted).agg(F.sum("tp").alias("tp"), F.sum("missing").alias("fn"), F.sum("extra").alias("fp"))
    p, r, f = scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return total.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def qc_sample(rows: DataFrame, ratio: float) -> DataFrame:
    """Rows that quality control looks at: of each task that ratio, one at least, in order."""
    n = rows.groupBy("task_id").agg(F.count("*").alias("n_rows"))
    take = F.greatest(F.lit(1), F.ceil(F.round(F.col("n_rows") * ratio, 6)))
    w = Window.partitionBy("task_id").orderBy("row_index")
    return rows.join(n, "task_id").withColumn("place", F.row_number().over(w)).where(F.col("place") <= take).select("task_id", "row_index")


def rescaled(values: DataFrame, key: str, value: str, order: list[str], frame: int = 200, least: int = 10, size: int = 1 << 16) -> DataFrame:
    """Adds scaled: the value within the least and greatest of the key's last `frame` values; itself before there are enough, or if they are one.

    Rows are cut into ranges of `size` in order of key and time, each with the frame - 1 rows before it, so that a key which holds all rows is
    many tasks. In a range the least of 2, 4, 8, ... values follows from that of half as many, and two of the longest cover the frame, which
    takes as many steps as the frame has binary digits instead of one for each of its rows.
    """
    ranged = in_ranges(values, [key, *order], frame - 1, max(size, frame))
    w = Window.partitionBy("__range", key).orderBy("__place")
    out = ranged.withColumns({"__low": F.col(value), "__high": F.col(value), "__n": F.least(F.row_number().over(w), F.lit(frame))})

    def widened(step: int) -> dict[str, Column]:
        return {"__low": F.least("__low", F.lag("__low", step).over(w)), "__high": F.greatest("__high", F.lag("__high", step).over(w))}

    width = 1
    while 2 * width <= frame:
        out, width = out.withColumns(widened(width)), 2 * width
    if width < frame:
        out = out.withColumns(widened(frame - width))
    low, high = F.col("__low"), F.col("__high")
    scaled = F.when((F.col("__n") < least) | (high == low), F.col(value)).otherwise((F.col(value) - low) / (high - low))
    return out.where(~F.col("__carried")).withColumn("scaled", scaled).drop("__range", "__place", "__carried", "__low", "__high", "__n")


def choose_annotator(tasks: DataFrame, annotators: DataFrame) -> DataFrame:
    """Per task (task_id, modality, types) the least id of an enabled annotator (annotator_id, enabled, modalities, types) that does its
    modality and all its types; null if none does. Annotators are people or models under contract, few by nature."""
    able = annotators.where("enabled").select("annotator_id", F.explode("modalities").alias("modality"), F.col("types").alias("skills"))
    fit = tasks.join(able, "modality").where(F.size(F.array_except("types", "skills")) == 0).groupBy("task_id").agg(F.min("annotator_id").alias("annotator_id"))
    return tasks.select("task_id").join(fit, "task_id", "left")


def second_opinions(conflicts: DataFrame) -> DataFrame:
    """From (task_id, span, first, prior, second, confidence) the action: keep the first type, flip to the prior, or review."""
    sure = F.coalesce(F.col("confidence") >= 0.5, F.lit(False))
    return conflicts.withColumn("action", F.when(~sure | F.col("second").isNull(), "review").when(F.col("second") == F.col("first"), "keep").when(F.col("second") == F.col("prior"), "flip").otherwise("review"))
