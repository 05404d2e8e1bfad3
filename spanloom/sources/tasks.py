"""Task sources and sinks: JSONL rows in and out, batching into tasks, imports, upserts, deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.text import padded
from spanloom.operators.graph import numbered, written


def read_jsonl(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """Rows of JSON lines files; blank lines are skipped. A line that is no object is an error, or, if tolerant, a row with _corrupt_record."""
    if tolerant:
        return spark.read.schema(schema + ", _corrupt_record string").json(path, mode="PERMISSIVE")
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def dealt(files: DataFrame) -> DataFrame:
    """The rows of files, as read, dealt to as many tasks as there are cores where the scan has fewer, since one task reads a whole row group.
    Larger input has more tasks than cores and isn't shuffled."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(cores) if files.rdd.getNumPartitions() < cores else files


#: Groups that are numbered in one task and broadcast, at most.
FEW_GROUPS = 100_000


def batches(rows: DataFrame, size: int, keys: list[str], order: str) -> DataFrame:
    """Adds task_no to rows: tasks of at most size rows with equal keys (null counts as ''), groups in order of first appearance.

    Rows are numbered by ranges of (keys, order), so that no task sorts all rows of a group; the groups' starts and first places are grouped
    sums, a row for each group. Up to FEW_GROUPS groups are put in order in one task, more by ranges as well.
    """
    keyed = rows
    names = [f"__key{i}" for i in range(len(keys))]
    for name, key in zip(names, keys, strict=True):
        keyed = keyed.withColumn(name, F.coalesce(F.col(key).cast("string"), F.lit("")))
    lined = numbered(keyed, [*names, order], "__line")
    groups = lined.groupBy(*names).agg(F.min("__line").alias("__start"), F.min(order).alias("__first"), F.ceil(F.count("*") / size).alias("__tasks"))
    numbers = lambda ahead: ahead.withColumn("task_no", (F.col("__ahead") + F.floor((F.col("__line") - F.col("__start")) / size)).cast("long")).select(*rows.columns, "task_no")
    groups = written(groups)
    if groups.count() <= FEW_GROUPS:
        ahead = F.coalesce(F.sum("__tasks").over(Window.orderBy("__first", *names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return numbers(lined.join(F.broadcast(groups.select(*names, "__start", ahead.alias("__ahead"))), names))  # the count bounds it
    groups = numbered(groups, ["__first", *names], "__place")
    parts = groups.select(F.floor(F.col("__place") / 100_000).alias("__part"), "__tasks").groupBy("__part").agg(F.sum("__tasks").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("__tasks").over(Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = groups.withColumn("__part", F.floor(F.col("__place") / 100_000)).join(F.broadcast(parts.select("__part", before.alias("__before"))), "__part")  # a row for each 100,000 groups
    ahead = ahead.select(*names, "__start", (F.col("__before") + within).alias("__ahead"))
    return numbers(lined.join(ahead, names))


def task_attributes(batched: DataFrame, order: str, source: str, firsts: tuple[str, ...] = ()) -> DataFrame:
    """Per task: rows, first and last line, its distinct sources, and of each column of firsts the first value that isn't null, as first_<name>."""
    found = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"first_{c}") for c in firsts]
    return batched.groupBy("task_no").agg(F.count("*").alias("n_rows"), F.min(order).alias("first_line"), F.max(order).alias("last_line"), F.array_join(F.sort_array(F.collect_set(source)), ",").alias("sources"), *found)


def prelabelled(rows: DataFrame, order: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows (order, input, output: JSON text) that can be imported, from an offset on, as many as the limit: those with an input; an output that
    is a list, as an old form was, or no JSON object counts as {}."""
    shape = F.schema_of_variant(F.try_parse_json("output"))
    own = rows.where(F.col("input").isNotNull()).withColumn("output", F.when(F.coalesce(shape.startswith("OBJECT"), F.lit(False)), F.col("output")).otherwise("{}"))
    if offset or limit is not None:
        own = own.orderBy(order).offset(offset)
        own = own if limit is None else own.limit(limit)
    return own


def import_prelabelled(new: DataFrame, existing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is free, and those that collide."""
    known = existing.select(key)
    return new.join(known, key, "left_anti"), new.join(known, key, "left_semi")


def read_task_directory(spark: SparkSession, path: str, status: str) -> DataFrame:
    """Tasks of *.task.json files under path with a status, and their output rows from the *.jsonl file of the same name."""
    tasks = spark.read.schema("task_id string, status string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.task.json").option("multiLine", True).json(path)
    rows = spark.read.schema("row_index int, input string, text string, output string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(path)
    rows = rows.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.jsonl$", 1).alias("task_id"), "row_index", F.coalesce("input", "text").alias("input"), "output")
    return tasks.where(F.col("status") == status).select("task_id").join(rows, "task_id", "left")


def upsert_external(existing: DataFrame, pulled: DataFrame) -> DataFrame:
    """existing with pulled items (system, item_id, payload) it lacks, under task ids that depend on system and item; the row there wins."""
    task_id = F.concat(F.lit("external-"), F.sha2(F.concat_ws(":", "system", "item_id"), 256).substr(1, 16))
    new = pulled.withColumn("task_id", task_id).groupBy("task_id").agg(F.min("payload").alias("payload"))
    return existing.select("task_id", "payload").unionByName(new.join(existing.select("task_id"), "task_id", "left_anti"))


def write_training_data(rows: DataFrame, path: str) -> None:
    """JSON lines of training rows; as many files as Spark has partitions."""
    rows.write.mode("error").json(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Every table as JSON lines in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("error").json(f"{path}/{name}")


def scan(tasks: DataFrame, project: str | None = None, status: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    out = tasks
    if project is not None:
        out = out.where(F.col("project_id") == project)
    if status is not None:
        out = out.where(F.col("status") == status)
    return out if ids is None else out.join(ids.select("task_id"), "task_id", "left_semi")


def cascade_delete(tables: dict[str, DataFrame], doomed: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table without the rows of doomed tasks (task_id), and how many each loses."""
    left = {n: df.join(doomed.select("task_id"), "task_id", "left_anti") for n, df in tables.items()}
    report = None
    for n, df in tables.items():
        one = df.join(doomed.select("task_id"), "task_id", "left_semi").agg(F.count("*").alias("n_deleted")).select(F.lit(n).alias("table_name"), "n_deleted")
        report = one if report is None else report.unionByName(one)
    return left, report


def migrate(tasks: DataFrame, effective: DataFrame, prefix: str) -> DataFrame:
    """Accepted tasks with readable annotations under new ids prefix-000001 and on, in order of id, with the annotation as their prelabel (where
    effective has payload); others with an error."""
    joined = tasks.where("status = 'accepted'").select("task_id").join(effective, "task_id", "left")
    good = numbered(joined.where("usable").select("task_id"), ["task_id"], "n")
    ids = good.select("task_id", F.concat(F.lit(f"{prefix}-"), padded(F.col("n") + 1, 6)).alias("new_id"))
    carried = [F.when(F.col("new_id").isNotNull(), F.col("payload")).alias("prelabel")] if "payload" in effective.columns else []
    return joined.join(ids, "task_id", "left").select("task_id", "new_id", F.when(F.col("new_id").isNull(), "no readable annotation").alias("error"), *carried)
