"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix. DataFrame functions only.

Rows lie in blocks as the input's partitions hold them. How many rows each block sends to each shard is drawn exactly, as a matrix with the blocks' counts as
row sums and the shards' sizes as column sums: a tree halves the range of blocks, and at each node the shard counts of the left half
follow a multivariate hypergeometric law. Rows are permuted within their block, dealt to shards by the drawn counts, exchanged, and
permuted again within the shard; whole rows move. All draws are hashes of the seed and of the row's number in the input or of the
tree node, and numbers are written before they are used, so that a task that runs again draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import fresh, materialise, scratch, text_of

#: Rows in a block at most.
BLOCK_ROWS = 50_000
#: Rows of a small table (a block's sums, a lane's offset) that are broadcast at most, after a count: some 100 MB. More are joined.
BROADCAST_ROWS = 500_000
#: Nodes below one node of the tree of sums, and halvings after which the nodes are dealt to tasks anew.
FAN, DEAL = 512, 3
#: Standard deviations beyond which a hypergeometric count is impossible to double precision (mass under 1e-30).
REACH = 12


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1 from a hash of the parts."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)


def hypergeometric(u: Column, good: Column, bad: Column, drawn: Column) -> Column:
    """How many of drawn items taken from good and bad ones are good: the inverse of the distribution function at u.

    Weights relative to the mode follow from the ratio of neighbours, over the support or REACH deviations of it.
    """
    k, b, m = (c.cast("double") for c in (good, bad, drawn))
    n = k + b
    mode = F.least(F.floor((m + 1) * (k + 1) / (n + 2)), good, drawn)
    deviation = F.sqrt(m * (k / F.greatest(n, F.lit(1.0))) * (b / F.greatest(n, F.lit(1.0))) * ((n - m) / F.greatest(n - 1, F.lit(1.0))))
    width = F.ceil(deviation * REACH) + REACH
    low = F.greatest(F.lit(0), drawn - bad, mode - width)
    high = F.least(good, drawn, mode + width)
    down = lambda f, i: F.when(i == 0, f).otherwise(f * (mode - i + 1) * (b - m + mode - i + 1) / ((k - mode + i) * (m - mode + i)))
    least = F.aggregate(F.sequence(F.lit(0).cast("long"), (mode - low).cast("long")), F.lit(1.0), down)
    up = lambda f, x: f * (k - x) * (m - x) / ((x + 1) * (b - m + x + 1))
    span = F.sequence(low.cast("long"), high.cast("long"))
    total = F.aggregate(span, F.struct(least.alias("f"), F.lit(0.0).alias("sum")), lambda s, x: F.struct(up(s.f, x).alias("f"), (s["sum"] + s.f).alias("sum")), lambda s: s["sum"])
    start = F.struct(least.alias("f"), F.lit(0.0).alias("sum"), (u * total).alias("goal"), low.cast("long").alias("k"))
    walk = F.aggregate(span, start, lambda s, x: F.struct(up(s.f, x).alias("f"), (s["sum"] + s.f).alias("sum"), s.goal.alias("goal"), (s.k + F.when(s["sum"] + s.f < s.goal, 1).otherwise(0)).cast("long").alias("k")), lambda s: s.k)
    return F.least(walk, high.cast("long"))


def multivariate(sizes: Column, drawn: Column, *key: Column) -> Column:
    """How many of drawn items taken at random from groups of the given sizes come from each group, drawn group by group."""
    start = F.struct(F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("rest"), drawn.cast("long").alias("want"), F.array().cast("array<long>").alias("out"))

    def one(s: Column, i: Column) -> Column:
        size = F.element_at(sizes, i)
        x = hypergeometric(uniform(*key, i), size, s.rest - size, s.want)
        return F.struct((s.rest - size).alias("rest"), (s.want - x).alias("want"), F.concat(s.out, F.array(x)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.size(sizes)), start, one, lambda s: s.out)


def halved(nodes: DataFrame, most: int, seed: int, level: int) -> DataFrame:
    """Splits nodes (first, sizes: most of them at most, quota: the shards' counts of all sizes together) by halving until each holds one
    size: first, quota."""
    nodes = nodes.withColumn("first", F.col("first").cast("long"))
    for turn in range((most - 1).bit_length()):
        if turn and turn % DEAL == 0:  # small rows, but each costs time: a fixed number of tasks, which isn't coalesced by size
            nodes = nodes.repartition(min(2 ** (turn + 3), 200), "first")
        half = F.ceil(F.size("sizes") / 2).cast("int")
        left = F.slice("sizes", F.lit(1), half)
        split = F.size("sizes") > 1
        drawn = multivariate(F.col("quota"), F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(seed), F.lit(level), F.col("first"), F.size("sizes"))
        nodes = nodes.withColumn("drawn", F.when(split, drawn))
        one = F.struct("first", left.alias("sizes"), F.col("drawn").alias("quota"))
        two = F.struct((F.col("first") + half).alias("first"), F.slice("sizes", half + 1, F.greatest(F.size("sizes") - half, F.lit(0))).alias("sizes"), F.zip_with("quota", "drawn", lambda q, d: q - d).alias("quota"))
        nodes = nodes.select(F.explode(F.when(split, F.array(one, two)).otherwise(F.array(F.struct("first", "sizes", "quota")))).alias("x")).select("x.*")
    return nodes.select("first", "quota")


def communication_matrix(counts: DataFrame, blocks: int, quotas: list[int], seed: int) -> DataFrame:
    """block, ends array<long>: for each block the running sums of the rows it sends to each shard. counts: block, n, for blocks 0 and on.

    The tree has levels: a node of one holds the sums of up to FAN nodes below it, whose counts it draws by halving. So a row is never
    longer than FAN sums, and the nodes of a level are dealt to tasks.
    """
    spark = counts.sparkSession
    levels = [spark.range(blocks).select(F.col("id").alias("block")).join(counts, "block", "left").select("block", F.coalesce("n", F.lit(0)).cast("long").alias("n"))]
    while FAN ** len(levels) < blocks:
        levels.append(materialise(levels[-1].groupBy(F.floor(F.col("block") / FAN).cast("long").alias("block")).agg(F.sum("n").alias("n"))))
    node = spark.range(1).select(F.col("id").alias("block"), F.array(*(F.lit(q).cast("long") for q in quotas)).alias("quota"))
    for level in range(len(levels) - 1, -1, -1):
        below = levels[level].groupBy(F.floor(F.col("block") / FAN).cast("long").alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "n"))), lambda x: x.n).alias("sizes"))  # FAN at most
        node = node.join(below, "block").select((F.col("block") * FAN).alias("first"), "sizes", "quota")
        node = halved(node, min(FAN, -(-blocks // FAN**level)), seed, level).withColumnRenamed("first", "block")
        if level:
            node = materialise(node)
    ends = F.transform(F.sequence(F.lit(1), F.size("quota")), lambda i: F.aggregate(F.slice("quota", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x))
    return node.select("block", ends.alias("ends"))


@scratch
def shuffle_rows(docs: DataFrame, shards: int = 8, seed: int = 17, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of docs, whole, with shard and slot (fresh names where docs has such columns), written in the shared folder.

    Shard sizes differ by one row at most; slot is the row's place in its shard, gapless from 0. Each file holds whole lanes of shards in
    the order of their slots. Blocks are runs of at most block_rows rows of an input partition; equal rows are drawn one by one. The
    same input in the same partitions gives the same result. Nulls, empty and very long texts move like any other row; nothing is read
    from them. Equal draws are told apart by the row's number. An empty table gives an empty result.
    """
    draw = lambda what, *own: F.xxhash64(F.lit(seed), F.lit(what), *own)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("uid"))
    rows = rows.withColumn("run", F.floor((F.col("uid") - F.shiftleft(F.col("part").cast("long"), 33)) / block_rows).cast("long"))
    # the first permutation: the rows of a partition, sorted by run and draw, are numbered in that order
    rows = rows.sortWithinPartitions("run", draw("place", F.col("uid")), "uid").withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33))
    rows = materialise(rows.withColumn("place", F.col("at") - F.col("run") * block_rows + 1).drop("at"))

    found = rows.groupBy("part", "run").agg(F.count("*").alias("n"))
    found = materialise(found.withColumn("block", (F.row_number().over(Window.orderBy("part", "run")) - 1).cast("long")), 1)  # a row for each block
    blocks, n = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    quotas = [n // shards + (s < n % shards) for s in range(shards)]
    matrix = materialise(communication_matrix(found.select("block", "n"), max(blocks, 1), quotas, seed).join(found, "block").select("part", "run", "ends"), 1)
    lanes = max(1, -(-blocks // shards))
    counted = lambda table, n: F.broadcast(table) if n <= BROADCAST_ROWS else table
    sent = rows.join(counted(matrix, blocks), ["part", "run"]).withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("place"))))
    sent = sent.withColumn("lane", F.pmod(draw("lane", F.col("uid")), F.lit(lanes)).cast("int")).select("row", "uid", "shard", "lane")

    lane_counts = sent.groupBy("shard", "lane").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(lane_counts.select("shard", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), 1)
    within = F.row_number().over(Window.partitionBy("shard", "lane").orderBy(draw("slot", F.col("uid")), "uid"))
    out = sent.withColumn("within", within).join(counted(offsets, shards * lanes), ["shard", "lane"])
    return out.select("row.*", F.col("shard").alias(fresh(docs, "shard")), (F.col("offset") + F.col("within") - 1).cast("long").alias(fresh(docs, "slot")))


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Digests of shuffle_rows(), read from its output: one row per row of docs with its id, size (UTF-8 bytes of the text plus 1),
    text_crc32, law 'rows', shard, slot and grown_shard (null). A null id stays null, a null text counts as empty; repeated rows get slots
    of their own; the rest is as shuffle_rows() says."""
    text = text_of(text_col)
    out = shuffle_rows(docs, shards, seed, block_rows)
    return out.select(
        F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), F.col(fresh(docs, "shard")).alias("shard"), F.col(fresh(docs, "slot")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
