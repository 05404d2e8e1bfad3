"""Near-duplicate documents by min-max hashing.

Each permutation gives both its least and its greatest value, two signature entries for one evaluation; bands are cut from all
entries. Documents with equal shingle sets form a class first, so that copies cost one row each. The classes of a bucket are linked
to its first class; links are confirmed on full shingle sets. Classes that then still lie in one bucket without being connected are
compared in blocks, first on signatures and then on full sets, so that no component is left apart that a bucket's links join. That takes
time in proportion to a bucket's largest component, but to the square of the number of its classes outside of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import WordHashes, distinct_by_text, materialise, mix, odd_constants, row_ids, scratch, shingle_hashes, text_chunks, text_of, words_of
from spanloom.llm.components import connected_components

#: Permutations, each of which gives two signature entries, and entries in a band. A pair of Jaccard similarity 0.75 meets in one of
#: the 32 bands with probability 1 - (1 - 0.75 ** 4) ** 32, all but 5 in a million.
PERMUTATIONS, BAND = 64, 4
#: Standard errors of the signature estimate by which a candidate may fall short of the threshold before it is verified.
SLACK = 5
#: Bits of the mark table that keeps texts which aren't needed from being shuffled: 8 MB, whatever the input.
MARK_BITS = 26
#: Classes of one bucket that are compared with each other in one task.
BLOCK = 1024


def shingle_sets(texts: list[bytes], hashes: WordHashes, width: int) -> tuple[np.ndarray, np.ndarray]:
    words = [words_of(t) for t in texts]
    shingles, counts = shingle_hashes(hashes([w for ws in words for w in ws]), np.array([len(w) for w in words], np.int64), width)
    return distinct_by_text(shingles, counts)


def min_max(values: np.ndarray, sizes: np.ndarray, permutations: int, seed: int) -> np.ndarray:
    """Signatures of the texts whose sets aren't empty, one row each: all minima, then all maxima."""
    heads = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.empty((len(heads), 2 * permutations), np.uint64)
    for i, (m, x) in enumerate(zip(odd_constants(permutations, seed), odd_constants(permutations, seed + 1), strict=True)):
        hashed = (values ^ x) * m
        out[:, i] = np.minimum.reduceat(hashed, heads)
        out[:, permutations + i] = np.maximum.reduceat(hashed, heads)
    return out


def band_keys(signatures: np.ndarray, band: int) -> np.ndarray:
    n, entries = signatures.shape
    bands = signatures[:, : entries // band * band].reshape(n, -1, band)
    keys = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2])
    for i in range(band):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, i])
    return keys.view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, permutations: int, band: int) -> DataFrame:
    """uid, id, text_hash, n_shingles, set_hi, set_lo (null for an empty set), bands array<long>, signature binary (a byte an entry)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, state = WordHashes(), {}
        for batch, texts in text_chunks(batches, "text"):
            values, sizes = shingle_sets(texts, hashes, width)
            full = sizes > 0
            ends = np.cumsum(sizes)
            keys = [xxhash.xxh3_128_digest(values[e - n : e].tobytes()) for e, n in zip(ends[full].tolist(), sizes[full].tolist(), strict=True)]
            keys = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            signatures = min_max(values, sizes, permutations, 11)
            bands = band_keys(signatures, band)
            at = pa.array(np.where(full, np.cumsum(full) - 1, -1)).to_numpy()
            spread = pa.array(np.where(full, at, 0), pa.int64(), mask=~full)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), bands.shape[1]).cast(pa.list_(pa.int64()))
            small = mix(signatures).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row_ids(len(texts), state)), batch.column(0), batch.column(1), pa.array(sizes), pa.array(keys[:, 0]).take(spread), pa.array(keys[:, 1]).take(spread), lists.take(spread), pa.array([r.tobytes() for r in small], pa.binary()).take(spread)],
                names=["uid", "id", "text_hash", "n_shingles", "set_hi", "set_lo", "bands", "signature"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_hash"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"uid long, id {rows.schema['id'].dataType.simpleString()}, text_hash long, n_shingles long, set_hi long, set_lo long, bands array<long>, signature binary")


def alike(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree well enough for the threshold to be within reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= least_agreement(threshold, x.shape[1])))

    one = nodes.select(F.col("node").alias("a"), F.col("signature").alias("x"))
    two = nodes.select(F.col("node").alias("b"), F.col("signature").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def least_agreement(threshold: float, entries: int) -> float:
    return threshold - SLACK * (threshold * (1 - threshold) / entries) ** 0.5


def marks(hashes: DataFrame) -> np.ndarray:
    """Words of 64 bits, of which a bit is set for each value of text_hash: its highest MARK_BITS bits say which."""
    place = F.shiftrightunsigned("text_hash", 64 - MARK_BITS)
    words = hashes.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(text_hash, %d) & 63 as int))" % (64 - MARK_BITS))).alias("bits")).toArrow()
    out = np.zeros(1 << MARK_BITS - 6, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def node_texts(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, text of the needed nodes (node, id, text_hash); rows with equal ids and texts give one. Texts without a mark stay where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(marks(needed))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(1).to_numpy().view(np.uint64) >> np.uint64(64 - MARK_BITS)
            yield batch.filter(pa.array((shared.value[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = [not (n in seen or seen.add(n)) for n in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(new))

    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_of(text_col)).alias("hash"), text_of(text_col).alias("text"))
    rows = rows.mapInArrow(marked, rows.schema)
    return rows.join(needed, F.col("doc").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash"))).select("node", "text").mapInArrow(once, "node long, text string")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part, one in text_chunks([batch], "x"):
                left, n = shingle_sets(one, hashes, width)
                right, m = shingle_sets([t or b"" for t in part.column(3).cast(pa.binary()).to_pylist()], hashes, width)
                good = []
                for x, y in zip(np.split(left, np.cumsum(n)[:-1]), np.split(right, np.cumsum(m)[:-1]), strict=True):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_arrays(part.columns[:2], names=["a", "b"]).filter(pa.array(good))

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def straddling(buckets: DataFrame, labels: DataFrame, nodes: DataFrame, threshold: float, band: int) -> DataFrame:
    """key, i, j, own, node, label: the classes of a bucket (at, key) that resemble one of another component there. A pair counts in the first
    band in which it agrees only.

    Buckets within one component fall out by grouped counts. In the others, classes of the bucket's largest component never meet each
    other: they lie in blocks of about BLOCK classes, the rest in blocks after those, and each pair of blocks (i, j) of which one is of the rest is a
    group of its own, so that no task holds more than two blocks; own is the block of the class. The largest component may be as large as
    the corpus: its classes come once for each block of the rest.
    """
    member = materialise(buckets.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).select("at", "key", "node", "label"))
    parts = member.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n")).where("labels > 1")
    mixed = mixed.select("key", F.col("top.label").alias("top"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("tops"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("rests"))
    member = member.join(mixed, "key")
    first = F.col("label") == F.col("top")
    own = F.when(first, F.pmod(F.xxhash64("node"), F.col("tops"))).otherwise(F.col("tops") + F.pmod(F.xxhash64("node"), F.col("rests"))).cast("int")
    others = F.sequence(F.when(first, F.col("tops")).otherwise(0), F.col("tops") + F.col("rests") - 1)
    split = member.join(nodes.select("node", "signature"), "node").withColumn("own", own).withColumn("other", F.explode(others))
    split = split.select("at", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "signature")

    def run(table: pa.Table) -> pa.Table:
        label, at = table.column("label").to_numpy(), table.column("at")[0].as_py()
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(label), -1)
        one, two = sides(table)
        least, found = least_agreement(threshold, signature.shape[1]), np.zeros(len(label), bool)
        bands = signature.shape[1] // band
        for x in one.tolist():
            other = two[label[two] != label[x]]
            same = signature[other] == signature[x]
            near = np.flatnonzero(same.mean(axis=1) >= least)
            near = other[near[same[near, : bands * band].reshape(len(near), bands, band).all(axis=2).argmax(axis=1) == at]]
            found[near] = True
            found[x] |= len(near) > 0
        return table.select(["key", "i", "j", "own", "node", "label"]).filter(pa.array(found))

    return split.groupBy("key", "i", "j").applyInArrow(run, "key long, i int, j int, own int, node long, label long")


def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the classes of block i, and of those that each is compared with."""
    own, i, j = table.column("own").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
    one = np.flatnonzero(own == i)
    return one, one if i == j else np.flatnonzero(own == j)


def straddling_links(members: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) on full shingle sets that join components, as few of each group as connect what the group connects."""

    def run(table: pa.Table) -> pa.Table:
        node, root = table.column("node").to_numpy(), table.column("label").to_numpy().copy()
        values, sizes = shingle_sets([t.encode() for t in table.column("text").to_pylist()], WordHashes(), width)
        ids = np.unique(values, return_inverse=True)[1]
        starts = np.cumsum(sizes) - sizes
        one, two = sides(table)
        a, b = [], []
        held = np.zeros(int(ids.max(initial=0)) + 1, bool)
        for x in one.tolist():
            if (root[two] == root[x]).all():
                continue
            mine = ids[starts[x] : starts[x] + sizes[x]]
            held[mine] = True
            shared = np.add.reduceat(held[ids], starts, dtype=np.int64)
            held[mine] = False
            linked = two[(100 * shared[two] >= percent * (sizes[two] + sizes[x] - shared[two])) & (root[two] != root[x])]
            for other, at in zip(*np.unique(root[linked], return_index=True), strict=True):
                a.append(node[x])
                b.append(node[linked[at]])
                root[root == other] = root[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return members.join(texts, "node").groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


@scratch
def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, permutations: int = PERMUTATIONS, band: int = BAND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, text_hash, n_shingles, component_id and kept.

    Rows are linked when 100 * intersection >= percent * union of their sets of distinct word shingles; component_id is the least id
    that links reach, kept marks the row with that id. Nulls: a null text counts as empty; an empty set is linked with nothing and is
    its own component. A row without id takes part; it is kept only where no row of its component has an id. Very long texts are compared
    whole. Repeated rows are linked, and kept together where they share the least id; a similarity of just the threshold links. An empty
    table gives an empty result; other columns aren't read.
    """
    threshold = percent / 100
    rows = materialise(sketches(docs, id_col, text_col, width, permutations, band))
    key = ["set_hi", "set_lo"]
    classes = materialise(rows.where("set_hi is not null").groupBy(*key).agg(F.min("uid").alias("node"), F.min("id").alias("least_id")))
    firsts = materialise(rows.join(classes.select(F.col("node").alias("uid")), "uid", "left_semi").select(F.col("uid").alias("node"), "id", "text_hash", "bands", "signature"))
    entries = firsts.select("node", F.posexplode("bands").alias("at", "key"))
    heads = materialise(entries.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head"))
    buckets = materialise(entries.join(heads, "key"))

    pairs = materialise(alike(buckets.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), firsts, threshold))
    needed = lambda p: p.select(F.col("a").alias("node")).union(p.select("b")).distinct()
    facts = firsts.select("node", "id", "text_hash")
    texts = materialise(node_texts(docs, facts.join(needed(pairs), "node"), id_col, text_col))
    links = materialise(confirmed(pairs, texts, percent, width))
    labels = materialise(connected_components(links))

    members = materialise(straddling(buckets.select("at", "key", "node"), labels, firsts, threshold, band))
    if not members.isEmpty():
        lacking = members.select("node").distinct().join(texts.select("node"), "node", "left_anti")
        texts = texts.unionByName(materialise(node_texts(docs, facts.join(lacking, "node"), id_col, text_col)))
        extra = straddling_links(members, texts, percent, width)
        labels = materialise(connected_components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(extra)))

    rooted = classes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = rooted.join(least, "root").select(*key, "component_id")
    out = rows.select("id", "text_hash", "n_shingles", *key)
    full = out.where("set_hi is not null").join(found, key)
    empty = out.where("set_hi is null").withColumn("component_id", F.col("id"))
    return full.unionByName(empty).select(F.col("id").alias(id_col), "text_hash", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with all their columns. Null and empty texts stay; very long ones are compared whole; rows
    of equal id and text, and null ids as one id, stay or go together. An empty table gives an empty result."""
    out = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where(~F.col("kept")).select(F.col(id_col).alias("out_id"), F.col("text_hash").alias("out_hash")).distinct()
    out = materialise(out)
    return docs.join(out, docs[id_col].eqNullSafe(out["out_id"]) & (F.xxhash64(text_of(text_col)) == out["out_hash"]), "left_anti")
