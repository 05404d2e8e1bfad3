"""Hidden Markov language model.

Tokens are words between ASCII white space, A-Z in lower case, and one end token for each text. A state emits one of a bounded
number of symbols: each of the most frequent words is a symbol of its own, every other word belongs to a class, chosen by a hash of
its last letters. Within a class a word's probability comes from its own count, so that every word of the corpus is counted and
scored by itself while the tables that a state needs stay bounded:

    P(word | state) = P(symbol of word | state) * (c(word) + 0.1) / (n(class) + 0.1 * (v(class) + 1))

with n and v the tokens and distinct words of the class; the last share of each class stands for the words never seen in training.
Baum-Welch rounds run forward and backward recursions in each partition, aggregate the expected counts by symbol, and broadcast the
next parameters; their arithmetic is single precision. The scaled forward recursion in double precision gives the exact likelihood of a
text. Long texts are taken a stretch of positions at a time, so that memory is bounded in both.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import CACHE_WORDS, materialise, row_ids, scratch, text_chunks, text_of, words_of

#: The end token: white space, so that no word equals it.
END = b"\n"
#: Symbols: words of their own at most, and classes for the rest. Together they fit 16 bits.
HEAD, CLASSES = 64_000, 1_024
STATES, ROUNDS = 8, 5
#: Bytes of a word beyond which its digest stands for it.
WORD_BYTES = 64
#: Added to counts, as in the base model.
ADDED = 0.1
#: Tokens that a task takes up in one recursion (or one text), and those of which it holds state probabilities at a time.
BATCH_TOKENS, STRETCH_TOKENS = 1_000_000, 1_000_000


@dataclass
class Vocabulary:
    """words: the symbols of their own, with counts; class_tokens and class_words: of each class; tokens and distinct: of all."""

    words: list[bytes]
    counts: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    distinct: int

    def base_log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADDED) / (self.tokens + ADDED * (self.distinct + 1)))

    def prior(self) -> np.ndarray:
        """Probabilities of the symbols in all training tokens."""
        weights = np.concatenate([self.counts + ADDED, self.class_tokens + ADDED * (self.class_words + 1)])
        return weights / weights.sum()


@dataclass
class Parameters:
    """start (K), moves (K x K) and emissions (symbols x K)."""

    start: np.ndarray
    moves: np.ndarray
    emissions: np.ndarray

    def single(self) -> Parameters:
        return Parameters(*(x.astype(np.float32) for x in (self.start, self.moves, self.emissions)))


def held_out(id_col: str, folds: int = 10) -> Column:
    """Rows whose crc32 of the id as text is divisible by folds; never those whose id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def tokens_of(text: bytes) -> list[bytes]:
    words = words_of(text)
    if len(text) > WORD_BYTES and len(max(words, key=len, default=b"")) > WORD_BYTES:
        words = [w if len(w) <= WORD_BYTES else b" " + hashlib.sha256(w).hexdigest().encode() for w in words]
    words.append(END)
    return words


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def count_words(rows: DataFrame) -> DataFrame:
    """word binary, class int, c long, from the texts of rows. Each task adds up its own counts first, a bounded number at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(map(class_of, words), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["word", "class", "c"])
            counts.clear()
            return out

        for _, texts in text_chunks(batches, "text"):
            for t in texts:
                counts.update(tokens_of(t))
            if len(counts) > CACHE_WORDS:
                yield flush()
        yield flush()

    return rows.select("text").mapInArrow(run, "word binary, class int, c long").groupBy("word", "class").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """The words of their own are all those over a count that at most head words reach, found on a histogram of fixed size."""
    step = F.floor(F.log2("c") * 32).cast("int")
    histogram = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum("c").alias("tokens")).collect(), reverse=True)
    cut, reached = 10**6, 0
    for r in histogram:
        reached += r.words
        if reached > head:
            break
        cut = r.step
    own = counts.where((step >= cut) | (F.col("word") == F.lit(END))).select("word", "c").toArrow()
    order = np.argsort(own.column("word").to_numpy(zero_copy_only=False), kind="stable") if len(own) else []
    words = own.column("word").to_pylist()
    rest = counts.where((step < cut) & (F.col("word") != F.lit(END))).groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    tokens, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rest:
        tokens[r["class"]], distinct[r["class"]] = r.n, r.v
    c = own.column("c").to_numpy().astype(np.float64)
    return Vocabulary([words[i] for i in order], c[np.array(order, np.int64)], tokens, distinct, int(sum(r.tokens for r in histogram)), int(sum(r.words for r in histogram)))


def encode(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """uid, id, held_out, n_tokens, head_known, head_base, symbols binary (16 bits each), rest array<struct<word, n>>: its distinct words
    of classes, and how often each stands in it."""
    shared = rows.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, state, known = shared.value, {}, {}
        n_head = len(vocab.words)
        own_base = np.append(vocab.base_log10(vocab.counts), np.zeros(CLASSES))
        for batch, texts in text_chunks(batches, "text"):
            if not known or len(known) > n_head + CACHE_WORDS:
                known = {w: i for i, w in enumerate(vocab.words)}
            tokens, lengths = [], np.empty(len(texts), np.int64)
            for i, t in enumerate(texts):
                own = tokens_of(t)
                lengths[i] = len(own)
                tokens += own
            for w in set(tokens).difference(known):
                known[w] = n_head + class_of(w)
            symbols = np.fromiter(map(known.__getitem__, tokens), np.uint16, len(tokens))
            ends = np.cumsum(lengths)
            starts = ends - lengths
            rare = np.flatnonzero(symbols >= n_head)
            bounds = np.append(0, np.searchsorted(rare, ends))
            each = [Counter(tokens[i] for i in rare[a:b].tolist()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            offsets = np.append(0, np.cumsum([len(c) for c in each], dtype=np.int64))
            base = np.add.reduceat(own_base[symbols], starts)
            raw = symbols.tobytes()
            rest = pa.StructArray.from_arrays([pa.array([w for c in each for w in c], pa.binary()), pa.array([n for c in each for n in c.values()], pa.int32())], names=["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row_ids(len(texts), state)), batch.column(0), batch.column(1), pa.array(lengths), pa.array(lengths - np.diff(bounds)), pa.array(base),
                    pa.array([raw[2 * a : 2 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), rest),
                ],
                names=["uid", "id", "held_out", "n_tokens", "head_known", "head_base", "symbols", "rest"],
            )

    schema = f"uid long, id {rows.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens long, head_known long, head_base double, symbols binary, rest array<struct<word: binary, n: int>>"
    return rows.select("id", "held_out", "text").mapInArrow(run, schema)


class Recursion:
    """Sequences of symbols side by side, the longest first; the tokens of one position lie together."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences], np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # sequences longer than each position
        self.offsets = np.append(0, np.cumsum(self.active))
        flat = np.concatenate([sequences[i] for i in self.order]).astype(np.int64)
        position = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.owner = np.empty(len(flat), np.int64)
        at = self.offsets[position] + np.repeat(np.arange(len(lengths)), lengths)
        self.symbols = np.empty(len(flat), np.int64)
        self.symbols[at] = flat
        self.owner[at] = np.repeat(np.arange(len(lengths)), lengths)

    def stretches(self) -> list[tuple[int, int]]:
        """Runs of positions that hold about STRETCH_TOKENS tokens at most, or one position."""
        cuts = np.flatnonzero(np.diff(self.offsets[1:] // STRETCH_TOKENS, prepend=-1))
        return list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(self.active)], strict=True))

    def forward(self, p: Parameters, first: int, stop: int, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled state probabilities, scales and emissions of the tokens of positions first to stop; before: the state probabilities of the
        position ahead."""
        low = int(self.offsets[first])
        emitted = p.emissions[self.symbols[low : self.offsets[stop]]]
        alpha, scale = np.empty_like(emitted), np.empty((len(emitted), 1), emitted.dtype)
        ones, bounds = np.ones((emitted.shape[1], 1), emitted.dtype), (self.offsets[first : stop + 1] - low).tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            now, c = alpha[a:b], scale[a:b]
            if before is None:
                np.multiply(emitted[a:b], p.start, out=now)
            else:
                np.matmul(before[: b - a], p.moves, out=now)
                now *= emitted[a:b]
            np.matmul(now, ones, out=c)
            now /= c
            before = now
        return alpha, scale, emitted

    def last(self, alpha: np.ndarray, stop: int) -> np.ndarray:
        """The state probabilities of the last position before stop, of those of a stretch."""
        return alpha[len(alpha) - int(self.active[stop - 1]) :].copy()

    def likelihoods(self, p: Parameters) -> np.ndarray:
        """log10 of each sequence's probability, in the order given."""
        sums, before = np.zeros(len(self.order)), None
        for first, stop in self.stretches():
            alpha, scale, _ = self.forward(p, first, stop, before)
            before = self.last(alpha, stop)
            sums += np.bincount(self.owner[self.offsets[first] : self.offsets[stop]], np.log10(scale[:, 0].astype(np.float64)), len(sums))
        out = np.empty(len(sums))
        out[self.order] = sums
        return out

    def expect(self, p: Parameters, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Adds expected emissions to counts (symbols x K); returns expected starts, moves and the log10 likelihood. Where there are several
        stretches, a first pass keeps the state probabilities between them and a second one computes each again, from the last."""
        stretches, heads = self.stretches(), [None]
        for first, stop in stretches[:-1]:
            heads.append(self.last(self.forward(p, first, stop, heads[-1])[0], stop))
        back, k = np.ascontiguousarray(p.moves.T), len(p.start)
        moves, log, after = np.zeros((k, k)), 0.0, None
        for (first, stop), before in zip(reversed(stretches), reversed(heads), strict=True):
            alpha, scale, later = self.forward(p, first, stop, before)
            log += float(np.log10(scale).sum(dtype=np.float64))
            later /= scale  # becomes emission * beta / scale of each token
            low = int(self.offsets[first])
            bounds = (self.offsets[first : stop + 1] - low).tolist()
            gamma = alpha.copy()
            for t in range(stop - first - 1, -1, -1):
                a, b = bounds[t], bounds[t + 1]
                follow = after if t == stop - first - 1 else later[b : bounds[t + 2]]
                if follow is not None:
                    beta = np.matmul(follow, back)
                    gamma[a : a + len(follow)] *= beta
                    later[a : a + len(follow)] *= beta
            symbols = self.symbols[low : low + len(alpha)]
            for i in range(k):
                counts[:, i] += np.bincount(symbols, gamma[:, i], len(counts))
            if after is not None:
                moves += (alpha[bounds[-2] : bounds[-2] + len(after)].T @ after).astype(np.float64)
            n = self.active[first:stop]
            if len(n) > 1:
                previous = np.arange(bounds[1], len(alpha)) - np.repeat(n[:-1], n[1:])
                moves += (alpha[previous].T @ later[bounds[1] :]).astype(np.float64)
            after = later[: bounds[1]].copy()
        return gamma[: bounds[1]].sum(axis=0, dtype=np.float64), moves * p.moves, log


def recursions(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, Recursion]]:
    for batch in batches:
        raw = batch.column(batch.schema.get_field_index(column)).to_pylist()
        start = held = 0
        for i, r in enumerate(raw):
            held += len(r) // 2
            if held >= BATCH_TOKENS or i == len(raw) - 1:
                yield batch.slice(start, i + 1 - start), Recursion([np.frombuffer(x, np.uint16) for x in raw[start : i + 1]])
                start, held = i + 1, 0


def first_parameters(vocab: Vocabulary, states: int, seed: int) -> Parameters:
    """Sticky states that differ by noise. Words of one class share it, so states differ in endings of words and part early."""
    classes = np.array([*map(class_of, vocab.words), *range(CLASSES)])
    noise = 0.5 * np.random.default_rng(seed).standard_normal((CLASSES, states))[classes]
    emissions = vocab.prior()[:, None] * np.exp(noise)
    moves = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1))
    return Parameters(np.full(states, 1 / states), moves, emissions / emissions.sum(axis=0))


def baum_welch(encoded: DataFrame, vocab: Vocabulary, p: Parameters) -> tuple[Parameters, float]:
    """The parameters after one round over all rows of encoded, and the log10 likelihood before it."""
    states, symbols = len(p.start), len(p.emissions)
    shared = encoded.sparkSession.sparkContext.broadcast(p.single())
    names = [f"e{k}" for k in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        counts, moves, start, log = np.zeros((symbols, states)), np.zeros((states, states)), np.zeros(states), 0.0
        for _, recursion in recursions(batches, "symbols"):
            s, m, x = recursion.expect(p, counts)
            start, moves, log = start + s, moves + m, log + x
        used = np.flatnonzero(counts.any(axis=1))
        keys = np.concatenate([used, -1 - np.arange(states), [-1 - states, -2 - states]])
        rows = np.concatenate([counts[used], moves, start[None], np.full((1, states), log)])
        rows = rows.astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array(rows[:, k]) for k in range(states))], names=["key", *names])

    parts = encoded.select("symbols").mapInArrow(run, "key int, " + ", ".join(f"{n} float" for n in names))  # float sums are added up as doubles
    found = parts.groupBy("key").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    keys, rows = found.column("key").to_numpy(), np.stack([found.column(n).to_numpy() for n in names], axis=1)
    get = dict(zip(keys[keys < 0].tolist(), rows[keys < 0], strict=True))
    none = np.zeros(states)
    emissions = np.zeros((symbols, states))
    emissions[keys[keys >= 0]] = rows[keys >= 0]
    total = emissions.sum()
    emissions += (100 + 0.001 * total / states) * vocab.prior()[:, None]
    moves = np.stack([get.get(-1 - k, none) for k in range(states)]) + 0.1
    start = get.get(-1 - states, none) + 0.1
    log = float(get.get(-2 - states, none)[0])
    return Parameters(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emissions / emissions.sum(axis=0)), log


def rest_sums(encoded: DataFrame, counts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """uid, known, base, within: of a text's words of classes, how many are known, and the sums of the base model's log10
    probabilities and of those within the class."""
    spark = encoded.sparkSession
    sizes = spark.createDataFrame([(k, float(n), float(v)) for k, (n, v) in enumerate(zip(vocab.class_tokens, vocab.class_words, strict=True))], "class int, n_class double, v_class double")
    words = encoded.select("uid", F.explode("rest").alias("r")).select("uid", "r.word", "r.n")
    own = (F.crc32(F.substring("word", -3, 3)) % CLASSES).cast("int").alias("class")  # as class_of()
    joined = words.join(counts.select("word", "c"), "word", "left").select("uid", "n", own, F.coalesce("c", F.lit(0)).alias("c"))
    joined = joined.join(F.broadcast(sizes), "class")  # CLASSES rows
    base = F.log10((F.col("c") + ADDED) / F.lit(vocab.tokens + ADDED * (vocab.distinct + 1)))
    within = F.log10((F.col("c") + ADDED) / (F.col("n_class") + ADDED * (F.col("v_class") + 1)))
    return joined.groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"), F.sum(base * F.col("n")).alias("base"), F.sum(within * F.col("n")).alias("within"))


def forward_scores(encoded: DataFrame, p: Parameters) -> DataFrame:
    """The rows of encoded with path, the log10 probability of their symbols, in place of the symbols."""
    shared = encoded.sparkSession.sparkContext.broadcast(p)
    rows = encoded.select("uid", "id", "held_out", "n_tokens", "head_known", "head_base", "symbols")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, recursion in recursions(batches, "symbols"):
            scores = recursion.likelihoods(shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*batch.schema.names[:-1], "path"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", path double")


@scratch
def language_model_scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, head: int = HEAD, folds: int = 10, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", history: list[float] | None = None) -> DataFrame:
    """One row per row of docs: its id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    The model learns from all rows that aren't held out. history, if given, gets the log10 likelihood of the symbols of the training
    rows before each round. Nulls: a null text counts as empty, one end token; a row without id is never held out. Very long texts are
    taken whole, a stretch at a time. Repeated rows count and score again. Words of equal counts are all symbols of their own, or none is.
    Without training rows all words are unknown. An empty table gives an empty result; other columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col, folds).alias("held_out"), text_of(text_col).alias("text"))
    counts = materialise(count_words(rows.where(~F.col("held_out"))))
    vocab = vocabulary(counts, head)
    encoded = materialise(encode(rows, vocab))
    p = first_parameters(vocab, states, seed)
    for _ in range(rounds):
        p, log = baum_welch(encoded.where(~F.col("held_out")), vocab, p)
        if history is not None:
            history.append(log)
    out = forward_scores(encoded, p).join(rest_sums(encoded, counts, vocab), "uid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("head_known") + zero("known")).cast("long").alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("head_base") + zero("base")).alias("base_score"),
        (F.col("path") + zero("within")).alias("score"),
    )
