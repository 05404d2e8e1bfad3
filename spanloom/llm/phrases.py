"""Phrase collocations: frequent phrases by multikey three-way quicksort of suffix pointers, scored by their weakest cut.

Words and pairs of neighbours are counted first. Those that are rarer than the threshold can't stand in a frequent phrase: they end the suffixes
before them. What is left of the suffix at each word, at least three words, since shorter phrases are counted already, and at most as many as the
longest phrase has, goes as hashes of words to one of many parts by its first three words, so that phrases that begin with the same words come
together. A task adds up equal suffixes and sends those of a part as one row. In a part, pointers to suffixes are sorted by their first word, those
that are equal there by their second, and so on to the greatest depth: the weight of a group of equal pointers is the count of the phrase they
share. Groups whose weight is below the threshold are abandoned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import CACHE_WORDS, materialise, mix, scratch, text_chunks, text_of

#: Suffixes that a task holds at a time before equal ones are added up, and parts that they are dealt to, at least.
HELD, PARTS = 1 << 20, 1 << 10
#: Bits of each of the two filters, of frequent words and pairs, that go to the tasks: a fixed size whatever the vocabulary, 8 MB.
FILTER_BITS = 1 << 26
#: Bits of one bitmap of Spark's bitmap functions.
BITMAP = 32_768

# Letters that are lowered and characters that part pieces, each of which becomes a full stop.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz..........")
STOP = b"."


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case, with STOP between pieces and at the end."""
    return (text.translate(LOWER).replace(STOP, b" . ") + b" .").split()


class WordKeys:
    """64-bit keys of the words of a language, 0 for STOP; remembered up to a bound."""

    def __init__(self):
        self.known: dict[str, dict[bytes, int]] = {}

    def __call__(self, words: list[bytes], lang: str) -> np.ndarray:
        if sum(map(len, self.known.values())) > CACHE_WORDS:
            self.known.clear()
        known = self.known.setdefault(lang, {STOP: 0})
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        for w in set(words).difference(known):
            known[w] = word_key(w, seed)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def word_key(word: bytes, seed: int) -> int:
    """Never 0."""
    key = xxhash.xxh3_64_intdigest(word, seed)
    return (key - (1 << 64) if key >> 63 else key) or 1


def bits(keys: np.ndarray) -> np.ndarray:
    """The place of each key in the filter."""
    return (mix(keys.view(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, word (binary), key, bit, n: occurrences of each word of rows (lang, text), and with an empty word those of all words. Tasks add up
    what they read before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[bytes]] = {}

        def flushed() -> pa.RecordBatch:
            langs, words, keys, n = [], [], [], []
            for lang, own in counts.items():
                own[b""] = sum(own.values())
                seed = xxhash.xxh3_64_intdigest(lang.encode())
                langs += [lang] * len(own)
                words += own.keys()
                keys += [word_key(w, seed) for w in own]
                n += own.values()
            counts.clear()
            keys = np.array(keys, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(keys), pa.array(bits(keys)), pa.array(n, pa.int64())], names=["lang", "word", "key", "bit", "n"])

        for batch, texts in text_chunks(batches, "text"):
            for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                own = counts.setdefault(lang, Counter())
                own.update(tokens(text))
                del own[STOP]
            if sum(map(len, counts.values())) > CACHE_WORDS:
                yield flushed()
        if counts:
            yield flushed()

    partial = rows.mapInArrow(run, "lang string, word binary, key long, bit long, n long")
    return partial.groupBy("lang", "word").agg(F.first("key").alias("key"), F.first("bit").alias("bit"), F.sum("n").alias("n"))


def frequent_filter(found: DataFrame) -> np.ndarray:
    """The packed filter of a table with bit, a place for each frequent word or pair. Its size is fixed; a rare one that shares a place is only
    sorted out later."""
    own = found.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in own.toLocalIterator():  # FILTER_BITS / BITMAP rows of 4 kB at most
        start = (r.bucket - 1) * BITMAP // 8
        out[start : start + BITMAP // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def has(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = bits(keys)
    return (packed[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def pair_keys(flat: np.ndarray) -> np.ndarray:
    """A key of each word and the next one."""
    first, second = flat[:-1].view(np.uint64), flat[1:].view(np.uint64)
    return mix(mix(first) + second).view(np.int64)


def word_runs(rows: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of the words of whole texts, about HELD at a time, with 0 for stops and in place of rare words; a stop ends each text."""
    keys, held, total = WordKeys(), [], 0

    def flushed() -> np.ndarray:
        flat = np.concatenate(held)
        held.clear()
        flat[~has(words, flat)] = 0
        return flat

    for batch, texts in text_chunks(rows, "text"):
        for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            held.append(keys(tokens(text), lang))
            total += len(held[-1])
        if total >= HELD:
            yield flushed()
            total = 0
    if held:
        yield flushed()


def frequent_pairs(rows: DataFrame, words: np.ndarray, least: int) -> DataFrame:
    """w1, w2, n, bit: the pairs of neighbouring frequent words that occur at least `least` times, and the place of each in the filter."""
    shared = rows.sparkSession.sparkContext.broadcast(words)  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for flat in word_runs(batches, shared.value):
            at = np.flatnonzero((flat[:-1] != 0) & (flat[1:] != 0))
            _, first, n = np.unique(pair_keys(flat)[at], return_index=True, return_counts=True)
            order = np.argsort(flat[at[first]])  # equal words stand together, which takes less room
            w1, w2 = flat[at[first]][order], flat[at[first] + 1][order]
            yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), pa.array(n[order].astype(np.int32))], names=["w1", "w2", "n"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1).reshape(-1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits(pair_keys(both)[::2]))], names=["w1", "w2", "n", "bit"])

    counts = rows.mapInArrow(run, "w1 long, w2 long, n int").groupBy("w1", "w2").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least).mapInArrow(placed, "w1 long, w2 long, n long, bit long")


def added_up(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, told apart by 64 bits of hash and then by themselves, and how often each occurs."""
    hashed = np.zeros(len(suffixes), np.uint64)
    for i in range(suffixes.shape[1]):
        hashed = mix(hashed + suffixes[:, i].view(np.uint64))
    order = np.argsort(hashed, kind="stable")
    suffixes = suffixes[order]
    heads = np.flatnonzero(np.append(True, (suffixes[1:] != suffixes[:-1]).any(axis=1))) if len(suffixes) else np.zeros(0, np.int64)
    return suffixes[heads], np.diff(heads, append=len(suffixes))


def suffix_rows(rows: DataFrame, words: np.ndarray, pairs: np.ndarray, longest: int) -> DataFrame:
    """part, suffixes, n: the suffixes at each frequent word, as a packed matrix of their words, 0 beyond their ends, and how often each occurs; a
    suffix ends before a rare word, inside a rare pair, at the end of its piece, and after longest words. Those of fewer than three words are left
    out. The first three words decide on the part; the same suffix comes from several tasks."""
    shared = rows.sparkSession.sparkContext.broadcast((words, pairs))  # a fixed size
    parts = max(PARTS, rows.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = shared.value
        held, total = [], 0

        def flushed() -> pa.RecordBatch:
            distinct, n = added_up(np.concatenate(held))
            held.clear()
            first = mix(pair_keys(distinct[:, :2].reshape(-1))[::2].view(np.uint64) + distinct[:, 2].view(np.uint64))
            part = (first % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, distinct, n = part[order], distinct[order], n[order]
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(starts[1:], len(part))
            packed = [[x[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] for x in (distinct, n)]
            return pa.RecordBatch.from_arrays([pa.array(part[starts]), *(pa.array(x, pa.binary()) for x in packed)], names=["part", "suffixes", "n"])

        for flat in word_runs(batches, words):
            flat = np.append(flat, np.zeros(longest, np.int64))
            goes_on = (flat[:-1] != 0) & (flat[1:] != 0)
            goes_on &= has(pairs, pair_keys(flat))
            long_ = goes_on[:-1] & goes_on[1:]
            for a in range(0, len(flat) - longest, HELD):  # a single text may be longer
                at = a + np.flatnonzero(long_[a : min(a + HELD, len(flat) - longest)])
                suffixes = np.empty((len(at), longest), np.int64)
                open_ = np.ones(len(at), bool)
                for i in range(longest):
                    suffixes[:, i] = np.where(open_, flat[at + i], 0)
                    open_ &= goes_on[np.minimum(at + i, len(goes_on) - 1)]
                held.append(suffixes)
                total += len(at)
                if total >= HELD:
                    yield flushed()
                    total = 0
        if total:
            yield flushed()

    return rows.mapInArrow(run, "part int, suffixes binary, n binary")


def edge_row(suffixes: np.ndarray, pick) -> int:
    """A row that comes first (pick: np.min) or last (np.max) in order."""
    left = np.arange(len(suffixes))
    for i in range(suffixes.shape[1]):
        column = suffixes[left, i]
        left = left[column == pick(column)]
    return int(left[0])


def frequent_prefixes(suffixes: np.ndarray, weight: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multikey three-way quicksort of pointers to suffixes, all parts of a round at once: a row that has each frequent prefix, the prefix's
    length and its weight. Prefixes of the first and the last suffix come whatever their weight.

    Each part of pointers is split by a pivot, the median of three words at the part's depth, into those before, equal and after. The equal
    ones go on with the next word; a part whose weight is below least is abandoned, unless it holds the first or last suffix.
    """
    m, longest = suffixes.shape
    rows, depths, weights = [], [], []
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kept = np.zeros(m, bool)
    kept[[edge_row(suffixes, np.min), edge_row(suffixes, np.max)]] = True
    flat = np.ascontiguousarray(suffixes).reshape(-1)
    at = np.arange(m)
    starts, depth = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(at):
        sizes = np.diff(starts, append=len(at))
        part = np.repeat(np.arange(len(starts)), sizes)
        words = flat[at * longest + depth[part]]
        a, b, c = words[starts], words[starts + sizes // 2], words[starts + sizes - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[part]
        side = (words > pivot).astype(np.int8) + (words >= pivot)  # 0 before, 1 equal, 2 after
        group = part * 3 + side
        n = np.bincount(group, minlength=3 * len(starts))
        heavy = np.bincount(group, weights=weight[at], minlength=3 * len(starts)).astype(np.int64)
        edge = np.bincount(group, weights=kept[at], minlength=3 * len(starts)) > 0
        new_depth = np.repeat(depth, 3) + np.tile([0, 1, 0], len(starts))
        good = (n > 0) & ((heavy >= least) | edge)
        # pointers keep their order inside each side
        place = np.empty(len(at), np.int64)
        first = np.cumsum(n) - n
        for s in range(3):
            own = np.flatnonzero(side == s)
            mine = group[own]
            if len(own):
                heads = np.flatnonzero(np.diff(mine, prepend=-1))
                place[own] = first[mine] + np.arange(len(own)) - np.repeat(heads, np.diff(heads, append=len(own)))
        moved = np.empty_like(at)
        moved[place] = at
        equal = np.flatnonzero(good & (np.arange(len(n)) % 3 == 1))
        one = moved[first[equal]]
        real = flat[one * longest + new_depth[equal] - 1] != 0  # a suffix that ends here has no further words
        good[equal[~real]] = False
        rows.append(one[real])
        depths.append(new_depth[equal][real])
        weights.append(heavy[equal][real])
        good &= new_depth < longest
        at = moved[np.repeat(good, n)]
        starts, depth = (np.cumsum(n[good]) - n[good]), new_depth[good]
    return np.concatenate(rows), np.concatenate(depths), np.concatenate(weights)


def phrase_counts(suffixes: DataFrame, least: int, longest: int) -> DataFrame:
    """phrase array<long> (keys of its words) and n, of three words or more and at least `least`, from suffix_rows()."""
    names = [f"w{i + 1}" for i in range(longest)]

    def run(table: pa.Table) -> pa.Table:
        unpacked = lambda c: np.concatenate([np.frombuffer(x, np.int64) for x in table[c].to_pylist()])
        own = unpacked("suffixes").reshape(-1, longest)
        rows, depth, n = frequent_prefixes(own, unpacked("n"), least)
        whole = (depth > 2) & (n >= least)  # of shorter prefixes only the suffixes of three words or more are here
        rows, depth, n = rows[whole], depth[whole], n[whole]
        return pa.table([*(pa.array(np.where(depth > i, own[rows, i], 0)) for i in range(longest)), pa.array(n)], names=[*names, "n"])

    total = suffixes.groupBy("part").applyInArrow(run, ", ".join(f"{c} long" for c in (*names, "n")))
    return total.select(F.filter(F.array(*names), lambda w: w != 0).alias("phrase"), "n")


def quotient(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)), exact: products of up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = (F.lit(1000).cast("decimal(4,0)") * wide(a)).cast("decimal(23,0)") * wide(n)
    return F.call_function("div", top.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


@scratch
def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int | None = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank from 1, phrase, a, l, r, n, score and k: of each lang the first `top` phrases (None: all) of 2 to longest words that occur at
    least `least` times, best first.

    Texts are lowered (A-Z) and cut into pieces at . , ; : ! ? and line ends, pieces into words at blanks and tabs; n counts the words of a
    lang, a the phrase's occurrences inside pieces, overlaps included. Cut after k words, a phrase scores floor(1000 * a * n / (l * r)), l and
    r the counts of its parts; its worst cut counts, of equal ones that of least k. A phrase inside a longer one that occurs as often is left
    out. Order: score and a descending, then the phrase in byte order.

    Nulls: a null lang is 'und', a null text is empty; empty texts have no words. Very long texts are read whole. Repeated rows count each. An empty
    table gives an empty result. Only lang and text are read, so other columns can't clash. Words are told apart by 64 bits of hash.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    words = materialise(word_counts(rows).where((F.col("n") >= least) | (F.length("word") == 0)))
    dictionary = words.where(F.length("word") > 0)
    known = frequent_filter(dictionary)
    pairs = materialise(frequent_pairs(rows, known, least))
    counts = dictionary.select(F.array("key").alias("phrase"), "n").unionByName(pairs.select(F.array("w1", "w2").alias("phrase"), "n"))
    if longest > 2:
        suffixes = suffix_rows(rows, known, frequent_filter(pairs), longest)
        counts = counts.unionByName(phrase_counts(suffixes, least, longest))
    counts = materialise(counts)
    size = F.size("phrase")
    candidates = counts.where((size > 1) & (size <= longest))
    # only a phrase of one word more needs to be looked at: any longer one that occurs as often holds such a one, which does too
    inside = candidates.where(size > 2).select(F.explode(F.array(F.slice("phrase", F.lit(1), size - 1), F.slice("phrase", F.lit(2), size - 1))).alias("phrase"), F.col("n").alias("longer"))
    inside = inside.groupBy("phrase").agg(F.max("longer").alias("longer"))
    own = candidates.join(inside, "phrase", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("n"))).select("phrase", F.col("n").alias("a"))
    cuts = own.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumn("one", F.slice("phrase", F.lit(1), F.col("k"))).withColumn("two", F.slice("phrase", F.col("k") + 1, size - F.col("k")))
    cuts = cuts.join(counts.select(F.col("phrase").alias("one"), F.col("n").alias("l")), "one").join(counts.select(F.col("phrase").alias("two"), F.col("n").alias("r")), "two")
    total = words.where(F.length("word") == 0).select("lang", F.col("n").alias("total"))
    named = cuts.withColumn("key", F.col("phrase")[0]).join(dictionary.select("key", "lang"), "key").join(total, "lang")
    scored = named.withColumn("score", quotient(F.col("a"), F.col("total"), F.col("l"), F.col("r")))
    worst = materialise(scored.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    spelled = worst.select("lang", "phrase", F.posexplode("phrase").alias("at", "key")).join(dictionary.select("key", F.col("word").cast("string").alias("word")), "key")
    texts = spelled.groupBy("lang", F.col("phrase").alias("keys")).agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))  # longest at most
    out = worst.withColumnRenamed("phrase", "keys").join(texts, ["lang", "keys"]).select("lang", F.array_join(F.transform("w", lambda x: x.word), " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score", "cut.k")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = out.withColumn("rank", rank)
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "k")
