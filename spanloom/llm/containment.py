"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by the size of their shingle sets, each class at most four times as wide as its smallest set. For a class,
a document's shingles are cut, in text order, into parts no larger than the class's largest set, so that a part which holds a
piece of an item resembles it and a short item can be found in a document of any length. An item is a candidate when, under one
of the class's permutations, the least hash of some part is the item's least hash. The number of permutations follows from the
threshold: over all parts of a document that holds the item, the expected number of such meetings is at least MEETINGS, so the
chance to miss one is at most exp(-MEETINGS). Candidates are verified against the document's whole shingle set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import WordHashes, arrow_type, distinct_by_text, fresh, materialise, odd_constants, shingle_hashes, text_chunks, text_of, words_of

MEETINGS = 14.0


#: Bytes of a block of items, as its index holds them: the executors get one block at a time.
BLOCK_BYTES = 128 << 20


def sketch_parameters(k: int, threshold: float) -> tuple[int, np.ndarray, np.ndarray]:
    """Of size class k: its largest size, and the multipliers and masks of its permutations."""
    low, high = 4**k, 4 ** (k + 1) - 1
    permutations = math.ceil(MEETINGS / (threshold * low / (high + low)))
    return high, odd_constants(permutations, 5 + k), odd_constants(permutations, 1005 + k)


def item_sketches(items: DataFrame, threshold: float, width: int) -> DataFrame:
    """item, shingles binary (sorted distinct hashes) and least binary (under each permutation of its class) of the items that have shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = WordHashes(), {}
        for batch, texts in text_chunks(batches, "text"):
            words = [words_of(t) for t in texts]
            shingles, counts = shingle_hashes(hashes([w for ws in words for w in ws]), np.array([len(w) for w in words], np.int64), width)
            values, sizes = distinct_by_text(shingles, counts)
            sets, least = np.split(values, np.cumsum(sizes)[:-1]), []
            for own in sets:
                k = ItemIndex.size_class(len(own))
                if k >= 0:
                    if k not in known:
                        known[k] = sketch_parameters(k, threshold)
                    least.append(b"".join(((own ^ x) * m).min().tobytes() for m, x in zip(known[k][1], known[k][2], strict=True)))
                else:
                    least.append(None)
            least = pa.array(least, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), least], names=["item", "shingles", "least"]).filter(least.is_valid())

    return items.mapInArrow(run, f"item {items.schema['item'].dataType.simpleString()}, shingles binary, least binary")


class ItemIndex:
    """MinHash index of a block of items: their sets and, item by item, the least hash under each permutation of its class."""

    def __init__(self, sets: list[np.ndarray], least: list[np.ndarray], threshold: float):
        self.sets, self.threshold = sets, threshold
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.classes = []
        classes = np.array([self.size_class(n) for n in self.sizes.tolist()], np.int64)
        for k in np.unique(classes).tolist():
            members = np.flatnonzero(classes == k)
            high, multipliers, masks = sketch_parameters(k, threshold)
            table = np.stack([least[i] for i in members])
            tables = []
            for i, (m, x) in enumerate(zip(multipliers, masks, strict=True)):
                order = np.argsort(table[:, i], kind="stable")
                tables.append((m, x, table[order, i], members[order]))
            self.classes.append((high, tables))

    @staticmethod
    def size_class(n: int) -> int:
        return (n.bit_length() - 1) // 2 if n else -1

    def candidates(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Pairs (text, item), as rows, whose sketches meet. shingles: those of all texts in text order."""
        found = []
        ends = np.cumsum(counts)
        for high, tables in self.classes:
            parts = -(-counts // high)
            owner = np.repeat(np.arange(len(counts)), parts)
            if not len(owner):
                continue
            number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
            heads = np.repeat(ends - counts, parts) + number * high
            for m, x, least, members in tables:
                mine = np.minimum.reduceat((shingles ^ x) * m, heads)
                a, b = np.searchsorted(least, mine, "left"), np.searchsorted(least, mine, "right")
                hit = np.flatnonzero(b > a)
                if len(hit):
                    n = (b - a)[hit]
                    at = np.arange(int(n.sum())) + np.repeat(a[hit] - (np.cumsum(n) - n), n)
                    found.append(np.repeat(owner[hit], n) * len(self.sets) + members[at])
        if not found:
            return np.zeros((0, 2), np.int64)
        pairs = np.unique(np.concatenate(found))
        return np.stack([pairs // len(self.sets), pairs % len(self.sets)], axis=1)

    def search(self, texts: list[bytes], hashes: WordHashes, width: int) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) of each pair whose containment reaches the threshold."""
        words = [words_of(t) for t in texts]
        shingles, counts = shingle_hashes(hashes([w for ws in words for w in ws]), np.array([len(w) for w in words], np.int64), width)
        pairs = self.candidates(shingles, counts)
        out = []
        if len(pairs):
            ends = np.cumsum(counts)
            for text, own in zip(*np.unique(pairs[:, 0], return_index=True), strict=True):
                whole = np.unique(shingles[ends[text] - counts[text] : ends[text]])
                stop = np.searchsorted(pairs[:, 0], text, "right")
                for item in pairs[own:stop, 1].tolist():
                    shared = int(np.isin(self.sets[item], whole, assume_unique=True).sum())
                    if shared >= self.threshold * self.sizes[item] - 1e-9:
                        out.append((int(text), item, shared))
        return out


def contained_items(
    docs: DataFrame, items: DataFrame, threshold: float = 0.75, width: int = 5, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per document and item of which the document holds at least threshold of the distinct shingles: the two ids,
    n_item_shingles, n_shared and containment.

    The items are a stated query set, searched against all documents in blocks of at most block_bytes (or one item), which bounds what a
    task holds and what the driver sends, whatever the length of the items; more items mean more passes over the documents. The items'
    hashes are computed by tasks. Nulls: null ids stay null, null and empty texts hold nothing and are held by nothing; a text of fewer
    than width words is one shingle. Very long texts on either side are searched whole. A containment of just threshold counts. Repeated
    rows on either side give repeated rows; empty tables give an empty result. Only ids, of any type, and texts are read, so other
    columns can't clash.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    own = items.select(F.col(item_id_col).alias("item"), text_of(item_text_col).alias("text"))
    id_type, item_type = (f.schema[c].dataType.simpleString() for f, c in ((rows, "id"), (own, "item")))
    item_arrow = arrow_type(own, "item")
    out = spark.createDataFrame([], f"`{id_col}` {id_type}, `{item_id_col}` {item_type}, n_item_shingles long, n_shared long, containment double")
    for block in item_blocks(item_sketches(own, threshold, width), block_bytes):
        index = ItemIndex([np.frombuffer(r.shingles, np.uint64) for r in block], [np.frombuffer(r.least, np.uint64) for r in block], threshold)
        shared = spark.sparkContext.broadcast((index, pa.array([r.item for r in block], item_arrow)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            (index, item_ids), hashes = shared.value, WordHashes()
            for batch, texts in text_chunks(batches, "text"):
                found = index.search(texts, hashes, width)
                if found:
                    text, item, n = (np.array(x, np.int64) for x in zip(*found, strict=True))
                    size = index.sizes[item]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), item_ids.take(pa.array(item)), pa.array(size), pa.array(n), pa.array(n / size)], names=["id", "item", "n_item_shingles", "n_shared", "containment"])

        part = rows.mapInArrow(run, f"id {id_type}, item {item_type}, n_item_shingles long, n_shared long, containment double")
        out = out.union(part.toDF(*out.columns))
    return out


def item_blocks(sketches: DataFrame, most: int) -> Iterator[list]:
    """Rows of item_sketches(), a block at a time: at most that many bytes of hashes, of which the index holds the least ones twice."""
    block, held = [], 0
    for row in sketches.toLocalIterator():
        size = len(row.shingles) + 2 * len(row.least)
        if block and held + size > most:
            yield block
            block, held = [], 0
        block.append(row)
        held += size
    if block:
        yield block


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that hold no item, with all their columns. Rows that share an id with one that does go too, repeated rows among them; a
    row whose id is null is judged as one with all such rows. Null and empty texts hold nothing and stay; very long ones are searched
    whole. An empty table, or no items, changes nothing."""
    found = contained_items(docs, items, id_col=id_col, **options)
    mark = fresh(docs, "contaminated_id")
    bad = materialise(found.select(F.col(id_col).alias(mark)).distinct())
    return docs.join(bad, docs[id_col].eqNullSafe(bad[mark]), "left_anti")
