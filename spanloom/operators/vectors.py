"""Clusters of vectors by cosine: candidates by random hyperplanes or all pairs in blocks, exact cosines on executors, components, trim."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.graph import connected_components, written

#: Vectors of a bucket that meet in one task, about, and those of a large bucket that every one of its blocks sees.
BLOCK, LEADERS = 2048, 16
#: Vectors of a batch whose sides of all hyperplanes are held at a time.
ROWS = 512
#: Codes that a vector has in a band beside its own: with one bit flipped, those nearest to their hyperplane.
FLIPS = 2
#: Bands of hyperplanes, at most; a threshold that would need more is searched exactly.
MOST_BANDS = 128
#: Cosines this near to the threshold are computed anew in a fixed order of sums, so that blocks can't change what counts.
NEAR = 1e-9


def double_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v array<double> of vectors that have a direction: not null or empty, of finite components, not all zero."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(F.size("v") > 0, F.lit(False)) & fits & F.col("id").isNotNull())


def cosine(x: Column, y: Column) -> Column:
    """Of two arrays of doubles of one length and a direction."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def distinct_vectors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors (uid, v), each once under its least id, and members (id, uid). Vectors are told apart by 128 bits of hash."""
    hashed = written(rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v")))
    same = ["h1", "h2"]
    low = hashed.groupBy(*same).agg(F.min("id").alias("uid"))
    members = written(hashed.select("id", *same).join(low, same).select("id", "uid"))
    # ids may repeat; equal vectors under one id are one
    own = hashed.join(members.where("id = uid").select("id").distinct(), "id").join(low, same).where("id = uid").groupBy("uid").agg(F.first("v").alias("v"))
    return written(own), members


def bands_for(n: int, threshold: float, recall: float) -> tuple[int, int] | None:
    """Bits of a band and number of bands at which two vectors at the threshold meet with probability recall, for the least work; None if that
    takes more than MOST_BANDS."""
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    plans = []
    for bits in range(FLIPS + 1, 25):
        meet = agree**bits + FLIPS * agree ** (bits - 1) * (1 - agree)
        bands = math.ceil(math.log1p(-recall) / math.log1p(-meet)) if 1e-9 < meet < 1 else 1 if meet >= 1 else MOST_BANDS + 1
        if bands <= MOST_BANDS:
            plans.append((bands * (1 + FLIPS) * (1 + n / 2**bits), bits, bands))
    return min(plans)[1:] if plans else None


def hyperplane_buckets(vectors: DataFrame, bits: int, bands: int, seed: int) -> DataFrame:
    """uid, bucket: in each band the code of a vector (uid, v), a bit for the side of each hyperplane on which it lies, and the codes that differ
    from it in one of the FLIPS bits whose hyperplanes are nearest. Vectors of another dimension have buckets of their own."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, bits * bands))
                every = np.flatnonzero(sizes == d)
                for a in range(0, len(every), ROWS):
                    own = every[a : a + ROWS]
                    side = (lists.take(pa.array(own)).flatten().to_numpy().reshape(-1, d) @ planes[d]).reshape(len(own), bands, bits)
                    code = ((side > 0) << np.arange(bits)).sum(axis=2)
                    nearest = np.argsort(np.abs(side), axis=2)[:, :, :FLIPS]
                    codes = np.concatenate([code[:, :, None], code[:, :, None] ^ (1 << nearest)], axis=2)
                    buckets = (codes + (np.arange(bands)[None, :, None] << bits)).reshape(len(own), -1) + (d << 40)
                    uid = batch.column(0).take(pa.array(np.repeat(own, buckets.shape[1])))
                    yield pa.RecordBatch.from_arrays([uid, pa.array(buckets.reshape(-1))], names=["uid", "bucket"])

    return vectors.select("uid", "v").mapInArrow(run, f"uid {vectors.schema['uid'].dataType.simpleString()}, bucket long")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)


def doubles(column: pa.ChunkedArray) -> np.ndarray:
    return matrix(column).astype(np.float64)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # lengths neither overflow nor vanish
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def similar_pairs(x: np.ndarray, y: np.ndarray, threshold: float, rows: int = 512):
    """Places of the pairs of unit rows whose cosine reaches the threshold, some rows of x at a time."""
    for a in range(0, len(x), rows):
        value = x[a : a + rows] @ y.T
        close = np.abs(value - threshold) < NEAR
        if close.any():
            i, j = np.nonzero(close)
            exact = np.zeros(len(i))
            for k in range(x.shape[1]):
                exact += x[a + i, k] * y[j, k]
            value[i, j] = exact
        i, j = np.nonzero(value >= threshold)
        yield i + a, j


def least_connected(n: int, pairs) -> np.ndarray:
    """The least place that each of n places is connected to. pairs: edges, a part at a time."""
    label = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            low = np.minimum(a, b)
            np.minimum.at(label, np.maximum(a, b), low)
            while True:
                jump = label[label]
                if np.array_equal(jump, label):
                    break
                label = jump
    return label


def tile_links(threshold: float):
    """Links (a, b) that connect what the vectors of one block, or of two, connect: at most one for each vector, whatever the number of pairs."""

    def links(table: pa.Table, label: np.ndarray) -> pa.Table:
        own = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": table["uid"].take(pa.array(own)), "b": table["uid"].take(pa.array(label[own]))})

    def inside(table: pa.Table) -> pa.Table:
        x = unit_rows(matrix(table["v"]))
        return links(table, least_connected(len(x), similar_pairs(x, x, threshold)))

    def across(one: pa.Table, two: pa.Table) -> pa.Table:
        both = pa.concat_tables([one.select(["uid", "v"]), two.select(["uid", "v"])])
        if not len(one) or not len(two):
            return links(both, np.arange(len(both)))
        found = similar_pairs(unit_rows(matrix(one["v"])), unit_rows(matrix(two["v"])), threshold)
        return links(both, least_connected(len(both), ((i, j + len(one)) for i, j in found)))

    return inside, across


def bucket_components(vectors: DataFrame, buckets: DataFrame, threshold: float) -> DataFrame:
    """node, root: components of vectors (uid, v) under cosines at the threshold or above between those that share a bucket (uid, bucket). No such
    link is missed, and no task holds more than two blocks of a bucket.

    Blocks of a bucket are searched inside first, a few vectors of the bucket among each of them. In buckets of several blocks that are then
    not connected as a whole, what lies outside of the largest component meets the whole bucket, block by block.
    """
    kind = vectors.schema["uid"].dataType.simpleString()
    inside, across = tile_links(threshold)
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    spread = F.xxhash64(F.lit(7), "uid", "bucket")
    own = written(buckets.join(sizes, "bucket").withColumn("block", F.pmod(spread, F.col("blocks")).cast("int")).withColumn("draw", F.pmod(F.xxhash64(F.lit(8), "uid", "bucket"), F.lit(1 << 53)) / float(1 << 53)))
    leaders = own.where((F.col("blocks") > 1) & (F.col("draw") < LEADERS / F.col("n"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    seen = own.select("uid", "bucket", "block").unionByName(leaders.select("uid", "bucket", "block")).distinct()
    links = written(seen.join(vectors, "uid").groupBy("bucket", "block").applyInArrow(inside, f"a {kind}, b {kind}").distinct())
    labels = connected_components(links)
    large = own.where("blocks > 1")
    marked = written(large.join(labels.withColumnRenamed("node", "uid"), "uid", "left").select("uid", "bucket", "block", "blocks", "n", F.coalesce("root", "uid").alias("label")))
    parts = marked.groupBy("bucket", "label").agg(F.count("*").alias("own"))
    top = parts.groupBy("bucket").agg(F.max(F.struct("own", "label")).alias("top"), F.sum("own").alias("all")).where("top.own < all")
    top = written(top.select("bucket", F.col("top.label").alias("top"), F.ceil((F.col("all") - F.col("top.own")) / BLOCK).cast("int").alias("rest_blocks")))
    if top.isEmpty():
        return labels
    mixed = marked.join(top, "bucket")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = mixed.where("label <> top").withColumn("rest_block", F.pmod(F.xxhash64(F.lit(9), "uid"), F.col("rest_blocks")).cast("int")).select("uid", "bucket", "rest_block", "blocks").withColumn("block", every("blocks")).drop("blocks")
    whole = mixed.select("uid", "bucket", "block", "rest_blocks").withColumn("rest_block", every("rest_blocks")).drop("rest_blocks")
    key = ["bucket", "rest_block", "block"]
    met = rest.join(vectors, "uid").toDF("uid", "bucket", "rest_block", "block", "v").groupBy(*key).cogroup(whole.join(vectors, "uid").toDF("uid", "bucket", "block", "rest_block", "v").groupBy(*key))
    more = met.applyInArrow(across, f"a {kind}, b {kind}")
    return connected_components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more.where("a <> b")))


def cosine_clusters(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding", mode: str = "exact", excluded: DataFrame | None = None, recall: float = 0.95, seed: int = 5) -> DataFrame:
    """key, rep, cosine, size: members of clusters of two or more. Vectors that links at the threshold connect form a component; its representative is
    the least id that isn't excluded (key), else the least; members keep to it by their own cosine.

    mode 'exact' compares all pairs in blocks; 'lsh' those that share a code of random hyperplanes: of two vectors at the threshold the share
    recall meet, of nearer ones more. Equal vectors are compared once. Vectors that are null, empty, all zero or not finite, and rows without
    an id, are in no cluster.
    """
    distinct, members = distinct_vectors(double_vectors(vectors, id_col, vector_col))
    plan = bands_for(distinct.count(), threshold, recall) if mode == "lsh" else None
    if plan:
        buckets = written(hyperplane_buckets(distinct, *plan, seed).distinct())
    else:
        buckets = distinct.select("uid", F.size("v").cast("long").alias("bucket"))
    roots = bucket_components(distinct, buckets, threshold)
    out = excluded.select(F.col("key").alias("id")).distinct().withColumn("out", F.lit(True)) if excluded is not None else None
    labels = members.join(roots.withColumnRenamed("node", "uid"), "uid", "left").select("id", "uid", F.coalesce("root", "uid").alias("root"))
    labels = written(labels.join(out, "id", "left") if out is not None else labels.withColumn("out", F.lit(None).cast("boolean")))
    best = labels.groupBy("root").agg(F.count("*").alias("n"), F.min(F.when(F.col("out").isNull(), F.struct("id", "uid"))).alias("free"), F.min(F.struct("id", "uid")).alias("any")).where("n > 1")
    reps = best.select("root", F.coalesce("free", "any").alias("r")).select("root", F.col("r.id").alias("rep"), F.col("r.uid").alias("rep_uid"))
    own = labels.join(reps, "root").select("id", "uid", "rep", "rep_uid")
    one, two = distinct.withColumnRenamed("v", "x"), distinct.select(F.col("uid").alias("rep_uid"), F.col("v").alias("y"))
    pairs = own.select("uid", "rep_uid").distinct().join(one, "uid").join(two, "rep_uid").select("uid", "rep_uid", F.when(F.col("uid") == F.col("rep_uid"), F.lit(1.0)).otherwise(cosine(F.col("x"), F.col("y"))).alias("cosine"))
    kept = written(own.join(pairs.where(F.col("cosine") >= threshold), ["uid", "rep_uid"]).select(F.col("id").alias("key"), "rep", "cosine"))
    return kept.join(kept.groupBy("rep").agg(F.count("*").alias("size")).where("size > 1"), "rep").select("key", "rep", "cosine", "size")


#: Pivots of the cells in which neighbours are looked for, at most: a sample of the vectors, chosen by hash.
MOST_PIVOTS = 1024


def pivot_cells(vectors: DataFrame, radius: float, seed: int = 11) -> DataFrame:
    """uid, cell, home: each vector (uid, v) in the cell of its nearest pivot, and as a guest in every cell that may hold a vector within radius of it:
    where the pivot is farther than the nearest one by no more than twice the radius. Vectors of another dimension have cells of their own."""
    n = vectors.count()
    most = max(1, min(MOST_PIVOTS, math.isqrt(n)))
    draw = F.pmod(F.xxhash64(F.lit(seed), "uid"), F.lit(1 << 53)) / float(1 << 53)
    sample: dict[int, list] = {}
    for r in vectors.where(draw < 4 * most / max(n, 1)).select("v").limit(2 * MOST_PIVOTS).collect():  # any sample will do
        if len(sample.setdefault(len(r.v), [])) < most:
            sample[len(r.v)].append(r.v)
    shared = vectors.sparkSession.sparkContext.broadcast({d: np.array(rows) for d, rows in sample.items()})  # most for each dimension

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                x = lists.take(pa.array(own)).flatten().to_numpy().reshape(-1, d)
                pivots = shared.value.get(d, np.zeros((1, d)))
                far = np.sqrt(squares(x, pivots))
                nearest = far.argmin(axis=1)
                row, cell = np.nonzero(far <= far.min(axis=1, keepdims=True) * (1 + NEAR) + 2 * radius + NEAR)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own[row])), pa.array(cell.astype(np.int64) + (d << 40)), pa.array(nearest[row] == cell)], names=["uid", "cell", "home"])

    return vectors.select("uid", "v").mapInArrow(run, f"uid {vectors.schema['uid'].dataType.simpleString()}, cell long, home boolean")


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs of rows."""
    return np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None] - 2 * (x @ y.T), 0)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows side by side, in a fixed order of sums."""
    return np.concatenate([np.zeros(0)] + [((x[a : a + 65536] - y[a : a + 65536]) ** 2).sum(axis=1) for a in range(0, len(x), 65536)])


def near_pairs(x: np.ndarray, y: np.ndarray, radius: float, cells: int = 1 << 22):
    """Places of the pairs of rows within radius, so many pairs at a time. Single precision finds those that may be, where its error is known to be
    small; these and, of many, those near the radius are computed in double precision in a fixed order."""
    long_x, long_y = (x**2).sum(axis=1), (y**2).sum(axis=1)
    longest = long_x.max(initial=0) + long_y.max(initial=0)
    margin = (x.shape[1] + 8) * 2.4e-7 * longest
    single = longest < 1e30 and radius**2 > 1e-25 and margin < radius**2 / 4
    if single:
        # the inner product of these is less than half the squared distance, times -1
        one = np.concatenate([x, -long_x[:, None] / 2, np.ones((len(x), 1))], axis=1).astype(np.float32)
        two = np.concatenate([y, np.ones((len(y), 1)), -long_y[:, None] / 2], axis=1).astype(np.float32)
    rows = max(1, cells // max(len(y), 1))
    for a in range(0, len(x), rows):
        if single:
            i, j = np.nonzero(one[a : a + rows] @ two.T >= np.float32(-(radius**2) / 2 - margin))
            if len(i) < min(rows, len(x) - a) * len(y) / 16:
                within = apart(x[a + i], y[j]) <= radius**2
                yield i[within] + a, j[within]
                continue
        value = squares(x[a : a + rows], y)
        close = np.abs(value - radius**2) < NEAR * (1 + value)
        if close.any():
            i, j = np.nonzero(close)
            value[i, j] = apart(x[a + i], y[j])
        i, j = np.nonzero(value <= radius**2)
        yield i + a, j


#: Vectors of a block where all vectors meet all, in BLOCKs; and pairs that take as long to compare as one vector takes to be sent to a task.
WIDE, SENT = 8, 500


def density_clusters(vectors: DataFrame, radius: float, least: int = 5, smallest: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", by_cells: bool | None = None) -> DataFrame:
    """id, cluster and kind of each vector: core, with at least `least` vectors within radius of it, itself included; border, not core but near one; or noise.
    Cores within radius of each other share a cluster, named by its least core; a border vector belongs to its nearest core's, of equally near
    ones to the least. Members of clusters of fewer than `smallest` vectors are noise, and so are vectors that are null, empty or not finite.

    Distances are those of the whole space, exact. Neighbours are looked for in cells around pivots, a block of a cell's own vectors with a block
    of all that may be near them in a task, or, where most vectors may be near most cells, as in many dimensions, in blocks of all vectors with
    all; by_cells says which, else their costs do. Counts, links and nearest cores leave the task, and no pairs do.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    width = vectors.schema[vector_col].dataType.simpleString()
    width = width if width == "array<float>" else "array<double>"  # vectors travel as they came, and are compared in double precision
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fits = F.coalesce(F.size("v") > 0, F.lit(False)) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.col("id").isNotNull()
    distinct, members = distinct_vectors(rows.where(fits))
    weights = members.groupBy("uid").agg(F.count("*").alias("weight"))
    points = written(distinct.join(weights, "uid"))
    blocks_of = lambda n, size: F.ceil(n / size).cast("int")
    whole = points.groupBy(F.size("v").cast("long").alias("cell")).agg(F.count("*").alias("n")).withColumn("blocks", blocks_of(F.col("n"), WIDE * BLOCK))
    if by_cells is not False:
        found = pivot_cells(points, radius)
        blocks = found.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("n")).where("homes > 0").withColumn("home_blocks", blocks_of(F.col("homes"), BLOCK)).withColumn("blocks", blocks_of(F.col("n"), BLOCK))
        blocks = written(blocks)
        if by_cells is None:
            celled = blocks.agg(F.sum(F.col("homes") * F.col("n") + SENT * (F.col("homes") * F.col("blocks") + F.col("n") * F.col("home_blocks")))).first()[0]
            by_cells = (celled or 0) <= (whole.agg(F.sum(F.col("n") * F.col("n") + 2 * SENT * F.col("n") * F.col("blocks"))).first()[0] or 0)
    if by_cells:
        places = written(found.join(F.broadcast(blocks.select("cell", "home_blocks", "blocks")), "cell")).hint("merge")  # small as a file, but of many rows
    else:
        own = F.size("v").cast("long")
        every_cell = F.broadcast(whole.select("cell", F.col("blocks").alias("home_blocks"), "blocks"))  # a row for each dimension
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "uid"), F.col(n)).cast("int")
    key = ["cell", "h", "g"]

    def tiles(facts: DataFrame, run, schema: str) -> DataFrame:
        columns = [c for c in facts.columns if c != "uid"]
        if by_cells:
            dealt = places.join(facts, "uid")
        else:
            dealt = facts.withColumn("cell", own).join(every_cell, "cell").withColumn("home", F.lit(True))
        sent = ["uid", *key, *(F.col(c).cast(width).alias(c) if c == "v" else c for c in columns)]
        one = dealt.where("home").withColumn("h", at(1, "home_blocks")).withColumn("g", every("blocks")).select(*sent).toDF("uid", *key, *columns)
        two = dealt.withColumn("g", at(2, "blocks")).withColumn("h", every("home_blocks")).select(*sent).toDF("uid", *key, *columns)
        return one.groupBy(*key).cogroup(two.groupBy(*key)).applyInArrow(run, schema)

    def counted(one: pa.Table, two: pa.Table) -> pa.Table:
        n = np.zeros(len(one), np.int64)
        if len(one) and len(two):
            weight = two["weight"].to_numpy()
            for i, j in near_pairs(doubles(one["v"]), doubles(two["v"]), radius):
                n += np.bincount(i, weights=weight[j], minlength=len(n)).astype(np.int64)
        return pa.table({"uid": one["uid"], "n": pa.array(n)})

    around = tiles(points.select("uid", "v", "weight"), counted, f"uid {kind}, n long").groupBy("uid").agg(F.sum("n").alias("n"))
    marked = written(points.join(around, "uid").select("uid", "v", (F.col("n") >= least).alias("core")))

    def linked(one: pa.Table, two: pa.Table) -> pa.Table:
        """Of each core the least one that the tile connects it to; of others the nearest core."""
        none = pa.table({"uid": one["uid"].slice(0, 0), "near": one["uid"].slice(0, 0), "square": pa.array([], pa.float64()), "core": pa.array([], pa.bool_())})
        two = two.filter(two["core"])
        if not len(one) or not len(two):
            return none
        core, x, y = one["core"].to_numpy(), doubles(one["v"]), doubles(two["v"])
        both = pa.concat_tables([one.select(["uid"]), two.select(["uid"])])["uid"]
        rank = np.empty(len(two), np.int64)
        rank[pc.sort_indices(two["uid"]).to_numpy()] = np.arange(len(two))
        best = np.full(len(one), -1)
        square = np.full(len(one), np.inf)

        def edges():
            for i, j in near_pairs(x, y, radius):
                yield i[core[i]], j[core[i]] + len(one)
                i, j = i[~core[i]], j[~core[i]]  # fewer than least of each
                d = apart(x[i], y[j])
                order = np.lexsort((rank[j], d, i))
                i, j, d = i[order], j[order], d[order]
                first = np.flatnonzero(np.diff(i, prepend=-1))
                best[i[first]], square[i[first]] = j[first], d[first]

        label = least_connected(len(both), edges())
        moved = np.flatnonzero(label != np.arange(len(label)))
        border = np.flatnonzero(best >= 0)
        return pa.table({
            "uid": pa.concat_arrays([both.take(pa.array(moved)).combine_chunks(), one["uid"].take(pa.array(border)).combine_chunks()]),
            "near": pa.concat_arrays([both.take(pa.array(label[moved])).combine_chunks(), two["uid"].take(pa.array(best[border])).combine_chunks()]),
            "square": pa.array(np.append(np.zeros(len(moved)), square[border])),
            "core": pa.array(np.append(np.ones(len(moved), bool), np.zeros(len(border), bool))),
        })

    found = written(tiles(marked, linked, f"uid {kind}, near {kind}, square double, core boolean"))
    roots = connected_components(found.where("core and uid <> near").select(F.col("uid").alias("a"), F.col("near").alias("b")))
    cores = marked.where("core").select("uid").join(roots.withColumnRenamed("node", "uid"), "uid", "left").select("uid", F.coalesce("root", "uid").alias("root"))
    border = found.where("not core").groupBy("uid").agg(F.min(F.struct("square", "near")).alias("b")).select("uid", F.col("b.near").alias("core_uid"))
    border = border.join(cores.withColumnRenamed("uid", "core_uid"), "core_uid").select("uid", "root")
    own = written(cores.withColumn("kind", F.lit("core")).unionByName(border.withColumn("kind", F.lit("border"))).join(members, "uid").select("id", "root", "kind"))
    large = own.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= smallest).select("root")
    kept = own.join(large, "root").select("id", F.col("root").alias("cluster"), "kind")
    return vectors.select(F.col(id_col).alias("id")).join(kept.dropDuplicates(["id"]), "id", "left").select(F.col("id").alias(id_col), "cluster", F.coalesce("kind", F.lit("noise")).alias("kind"))
