"""What the operators of this package share: reading, materialising, Arrow batches and words."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into Python objects at a time.
CHUNK_BYTES = 2 << 20
#: Entries that a task's word cache may hold before it starts anew.
CACHE_WORDS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master gets a temporary one; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths that materialise() has written inside the scratch blocks that this thread has open, the innermost last.
OPEN = threading.local()


def blocks() -> list[list[str]]:
    if not hasattr(OPEN, "blocks"):
        OPEN.blocks = []
    return OPEN.blocks


def materialise(df: DataFrame, files: int | None = None) -> DataFrame:
    """Writes to the shared folder and reads back: cuts lineage, so a lost executor costs no recomputation. files bounds the number of
    files, for tables known to be small."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanloom-{uuid.uuid4().hex}"
    if blocks():
        blocks()[-1].append(path)
    (df if files is None else df.coalesce(files)).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(operator):
    """Decorates a function that returns a DataFrame: the result is materialised, and what the function has materialised before goes, also
    where it fails. The first argument is a DataFrame or a session."""

    @functools.wraps(operator)
    def run(first: DataFrame | SparkSession, *args, **named) -> DataFrame:
        spark = first if isinstance(first, SparkSession) else first.sparkSession
        blocks().append([])
        kept: list[str] = []
        try:
            out = materialise(operator(first, *args, **named))
            kept = blocks()[-1][-1:]
        finally:
            for path in blocks().pop():
                if path not in kept:
                    where = spark._jvm.org.apache.hadoop.fs.Path(path)
                    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if blocks():
            blocks()[-1] += kept
        return out

    return run


def text_of(column: str) -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_ids(n: int, state: dict) -> np.ndarray:
    """Unique within one materialised job: the partition in the high bits, a running number below."""
    start = state.setdefault("next", TaskContext.get().partitionId() << 40)
    state["next"] = start + n
    return np.arange(start, start + n, dtype=np.int64)


def hashed_sample(rows: DataFrame, key: str, group: str, most: int, seed: int) -> DataFrame:
    """About most rows of each value of group, all if there are fewer, chosen by a hash of key: no sort and no shuffle of the rows.

    The number of rows kept has a mean of most and a standard deviation of its root. Groups should be few.
    """
    share = F.lit(0.0)
    for r in rows.groupBy(group).count().collect():
        share = F.when(F.col(group) == r[group], float(min(1.0, most / r["count"]))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    return rows.where(draw < share)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches that hold at most limit bytes of text (or one row), with the texts as UTF-8 bytes; binary columns go as well."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start), [x or b"" for x in texts.slice(start, stop - start).to_pylist()]
            start = stop


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.lower().split()


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, seed: int = 0, bound: int = CACHE_WORDS):
        self.seed, self.bound, self.known = seed, bound, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, seed = self.known, self.seed
        if len(known) > self.bound:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w, seed)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    """The Arrow type that Spark gives a column."""
    return df.select(column).limit(0).toArrow().schema.field(0).type


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(hashes: np.ndarray, lengths: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words of each text, in order, and how many each text has.

    hashes: those of the words of all texts, one text after the other; lengths: words of each text. A text of fewer
    words is one shingle as a whole; a text without words has none.
    """
    weights = odd_constants(width, 97)
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    counts = np.where(lengths >= width, lengths - width + 1, np.minimum(lengths, 1))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    full = np.zeros(len(at), np.uint64)
    if total:
        room = np.repeat(np.minimum(lengths, width), counts)
        for i in range(width):
            full += np.where(room > i, padded[at + i] * weights[i], np.uint64(0))
        full = mix(full + room.astype(np.uint64))
    return full, counts


def distinct_by_text(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text in order of size, and how many each text has."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[first], np.bincount(owner[first], minlength=len(counts)).astype(np.int64)
