"""Line dedup by distinct-site spread: HyperLogLog sketches per line hash, exact counts near the threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import fresh, materialise, scratch, text_chunks

#: Words that a line must have to count as boilerplate.
MIN_WORDS = 3
#: Lines, of 16 bytes each, that a broadcast may hold; more go through a join.
BROADCAST_LINES = 1_000_000


def line_key(line: bytes) -> bytes:
    """Lines are equal if they are after lowering A-Z and making each run of ASCII white space one blank."""
    return b" ".join(line.lower().split())


def line_hashes(text: bytes, min_words: int) -> tuple[list[bytes], list[int]]:
    """The lines of a text and their hashes; 0 for lines that are too short to count."""
    lines = text.split(b"\n")
    keys = map(line_key, lines)
    return lines, [xxhash.xxh3_64_intdigest(k) >> 1 | 1 if k and k.count(b" ") >= min_words - 1 else 0 for k in keys]


def lines_by_site(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_words: int = MIN_WORDS) -> DataFrame:
    """line long, site string, first: each line and site once for each chunk of a task, with the least id that isn't null, of the ids' own type."""
    rows = docs.select(F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "text", 8 << 20):
            pairs: dict[tuple[int, str], int | None] = {}
            for text, site, i in zip(texts, batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for h in set(line_hashes(text, min_words)[1]):
                    if h:
                        seen = pairs.get((h, site))
                        pairs[h, site] = i if seen is None else seen if i is None else min(seen, i)
            if pairs:
                hashes, sites = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(sites, pa.string()), pa.array(list(pairs.values()), batch.column(1).type)], names=["line", "site", "first"])

    return rows.mapInArrow(run, f"line long, site string, first {rows.schema['id'].dataType.simpleString()}")


@scratch
def spread_lines(docs: DataFrame, min_sites: int = 5, lg_k: int = 12, margin: float = 0.1, **columns) -> DataFrame:
    """line long, first: the lines on at least min_sites distinct sites, with the least id of a document that holds each.

    Sketches of lg_k merge by aggregation, from each task's part to the whole. An estimate at least margin above the threshold, or
    as far below it, decides at once; the lines between get exact distinct counts. With lg_k 12 the sketch's standard error is 1.6 %,
    so the default margin lies six of them away. Nulls: a null text has no lines, a null site counts as one site named '', a null id is never
    the first (first is null where no row with the line has an id). Texts are read whole, whatever their length; repeated rows and lines
    change nothing; of equal ids either is the first. An empty table gives no lines; other columns aren't read.
    """
    pairs = materialise(lines_by_site(docs, **columns))
    estimates = pairs.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"), F.min("first").alias("first"))
    estimates = materialise(estimates.where(F.col("sites") > min_sites * (1 - margin)))
    sure = estimates.where(F.col("sites") >= min_sites * (1 + margin))
    near = estimates.where(F.col("sites") < min_sites * (1 + margin))
    exact = pairs.join(near.select("line"), "line", "left_semi").groupBy("line").agg(F.countDistinct("site").alias("exact"), F.min("first").alias("first")).where(F.col("exact") >= min_sites)
    return sure.select("line", "first").unionByName(exact.select("line", "first"))


def drop_spread_lines(
    docs: DataFrame, min_sites: int = 5, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_words: int = MIN_WORDS, counts: tuple[str, str] | None = ("n_lines", "n_removed"), broadcast_lines: int = BROADCAST_LINES, **options
) -> DataFrame:
    """docs with the lines of its text column removed that stand on at least min_sites distinct sites.

    With keep_first such a line stays in the rows with the least id that holds it, so that no text is lost. counts names two columns
    to add, the lines before and the lines removed; None adds none. Lines are cut at \\n; those of fewer than min_words words always
    stay. Nulls: a null text stays null, with 0 lines; a null site counts as one site named ''; a null id is never the first. An
    empty text stays empty; very long texts are treated whole. A line repeated in one row goes or stays as a whole; rows that share the
    least id all keep it. A document may become empty, but keeps its row. An empty table gives an empty result; other columns pass
    through, and columns of docs named like those of counts are replaced. Ids may be of any type that orders.
    """
    spread = spread_lines(docs, min_sites, id_col=id_col, text_col=text_col, site_col=site_col, min_words=min_words, **options)
    if not keep_first:
        spread = spread.withColumn("first", F.lit(None).cast(docs.schema[id_col].dataType))
    names = {"id_col": id_col, "text_col": text_col, "min_words": min_words, "counts": counts}
    if spread.count() <= broadcast_lines:
        found = spread.orderBy("line").toArrow().combine_chunks()
        first = found.column("first").combine_chunks()
        return remove_lines(docs, docs.sparkSession.sparkContext.broadcast((found.column("line").to_numpy(), first)), **names)
    return remove_lines_by_join(docs, spread, **names)


def remove_lines(docs: DataFrame, shared, id_col: str, text_col: str, min_words: int, counts: tuple[str, str] | None, bad_col: str | None = None) -> DataFrame:
    """Takes out the lines of the broadcast arrays (hashes in order, first ids), or those of the row's own array column."""
    out = docs
    for name in counts or ():
        out = out.withColumn(name, F.lit(0).cast("long"))
    drop = [c for c in (bad_col,) if c]

    def bad_lines(batch: pa.RecordBatch, hashes: list[list[int]]) -> list[np.ndarray]:
        flat, lengths = np.array([h for hs in hashes for h in hs], np.int64), [len(h) for h in hashes]
        if bad_col is not None:
            own = batch.column(batch.schema.get_field_index(bad_col)).to_pylist()
            return [np.isin(np.array(h, np.int64), np.array(b or [], np.int64)) for h, b in zip(hashes, own, strict=True)]
        lines, first = shared.value
        if not len(lines):
            return [np.zeros(n, bool) for n in lengths]
        at = np.minimum(np.searchsorted(lines, flat), len(lines) - 1)
        bad = lines[at] == flat
        hit, owner = np.flatnonzero(bad), np.repeat(np.arange(len(lengths)), lengths)
        ids = batch.column(batch.schema.get_field_index(id_col)).cast(first.type)
        own = pc.equal(first.take(pa.array(at[hit])), ids.take(pa.array(owner[hit]))).fill_null(False)  # null ids are never the first
        bad[hit] = ~own.to_numpy(zero_copy_only=False)
        return np.split(bad, np.cumsum(lengths)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, text_col):
            there = batch.column(batch.schema.get_field_index(text_col)).is_valid().to_pylist()
            lines, hashes = zip(*(line_hashes(t, min_words) for t in texts), strict=True)
            bad = bad_lines(batch, hashes)
            new = {text_col: pa.array([b"\n".join([x for x, gone in zip(own, b.tolist(), strict=True) if not gone]).decode() if ok else None for own, b, ok in zip(lines, bad, there, strict=True)], pa.string())}
            if counts:
                new[counts[0]] = pa.array([len(own) if ok else 0 for own, ok in zip(lines, there, strict=True)], pa.int64())
                new[counts[1]] = pa.array([int(b.sum()) if ok else 0 for b, ok in zip(bad, there, strict=True)], pa.int64())
            names = [n for n in batch.schema.names if n not in drop]
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(batch.schema.get_field_index(n))) for n in names], names=names)

    return out.mapInArrow(run, out.drop(*drop).schema)


def remove_lines_by_join(docs: DataFrame, spread: DataFrame, id_col: str, text_col: str, min_words: int, counts: tuple[str, str] | None) -> DataFrame:
    """The way without a broadcast: hashes of each text's lines meet the spread lines in a join and come back by row."""
    row, bad = fresh(docs, "line_row"), fresh(docs, "line_bad")
    base = materialise(docs.withColumn(row, F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, "text", 8 << 20):
            own = [set(line_hashes(t, min_words)[1]) - {0} for t in texts]
            at = pa.array(np.repeat(np.arange(len(own)), [len(o) for o in own]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([h for o in own for h in o], pa.int64())], names=["row", "id", "line"])

    rows = base.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pairs = rows.mapInArrow(run, f"row long, id {rows.schema['id'].dataType.simpleString()}, line long").join(spread, "line")
    found = pairs.where(~F.coalesce(F.col("id") == F.col("first"), F.lit(False))).groupBy("row").agg(F.collect_list("line").alias(bad)).withColumnRenamed("row", row)
    joined = base.join(found, row, "left").select(*docs.columns, bad)
    return remove_lines(joined, None, id_col, text_col, min_words, counts, bad_col=bad)
