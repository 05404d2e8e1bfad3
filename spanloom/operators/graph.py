"""Connected components of an edge table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where the session names none, a local master gets a temporary one; on a
    cluster it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spanloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, whatever store it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def removed(spark: SparkSession, path: str) -> None:
    where, files = hadoop_path(spark, path)
    files.delete(where, True)


def dropped(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing reads any more."""
    for table in tables:
        removed(table.sparkSession, table.written_at)


def complete_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder whose writer has ended well."""
    where, files = hadoop_path(spark, path)
    if not files.exists(where):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(where) if s.isDirectory() and files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with name long: the row's place, from 0 on, in that order of columns. Ranges of rows are sorted side by side and counted, so that no
    task holds more than a range; rows with equal keys are numbered in any order."""
    part, at = f"{name}__part", f"{name}__at"
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    spread = written(spread.withColumn(part, F.spark_partition_id().cast("long")).withColumn(at, F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    counts = spread.groupBy(part).agg(F.count("*").alias("n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row for each range
    return spread.join(F.broadcast(starts), part).withColumn(name, F.col("start") + F.col(at)).drop(part, at, "start")


def in_ranges(rows: DataFrame, order: list[str], carry: int, size: int = 1 << 16) -> DataFrame:
    """rows with __range, __place and __carried: in that order of columns they are cut into ranges of size rows, and each range also holds the
    carry rows before it, marked as carried. A window inside a range then sees as far back as one over all rows would, and no task holds
    more than size + carry rows for it. carry is at most size."""
    placed = numbered(rows, order, "__place")
    own = F.floor(F.col("__place") / size)
    more = F.col("__place") % size >= size - carry
    each = F.when(more, F.array(F.struct(own.alias("r"), F.lit(False).alias("c")), F.struct((own + 1).alias("r"), F.lit(True).alias("c")))).otherwise(F.array(F.struct(own.alias("r"), F.lit(False).alias("c"))))
    return placed.withColumn("__in", F.explode(each)).withColumn("__range", F.col("__in.r")).withColumn("__carried", F.col("__in.c")).drop("__in")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root: each node of edges (a, b) with the least node it is connected to.

    Labels start as the least neighbour; each round takes the least label of the neighbours and then the label of the label, so that
    the number of rounds follows the logarithm of the longest path. Both steps are equi-joins with a grouped minimum.
    """
    both = written(edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a")).distinct())
    labels = written(both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("root")))
    while True:
        around = both.join(labels.select(F.col("node").alias("near"), "root"), "near").groupBy("node").agg(F.min("root").alias("other"))
        better = labels.join(around, "node").select("node", F.least("root", "other").alias("root"))
        jumped = better.join(labels.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root"))
        new = written(jumped)
        settled = new.join(labels.withColumnRenamed("root", "old"), "node").where("root <> old").isEmpty()
        dropped(labels)
        labels = new
        if settled:
            dropped(both)
            return labels
