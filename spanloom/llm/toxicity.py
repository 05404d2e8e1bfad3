"""Convolutional text classifier for toxicity: hashed word embeddings, several filter widths, max pooling, trained in numpy.

A word's embedding is the mean of the hashed embeddings of the word and of its beginnings, so that inflected forms share what they
have learned. Filters of each width run over the words of a text; the greatest value of each filter feeds a linear layer. The
threshold is calibrated for each language on training rows that the weights have not seen: the language is guessed from the text's
function words, and the score is shifted so that 0.5 is the language's threshold.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import CACHE_WORDS, hashed_sample, materialise, scratch, text_chunks, text_of, words_of

BUCKETS, DIMENSION, FILTERS = 1 << 15, 16, 16
WIDTHS = (1, 2, 3)
#: Letters of the beginnings that a word's embedding includes, beside the whole word.
BEGINNINGS = (4, 5)
#: Rows that training and calibration take of each label, about, chosen by a hash of the id. Rows of any length take part, whole.
TRAIN_ROWS, CALIBRATION_ROWS = 2_700, 1_300
#: Words whose embeddings are held at a time; longer texts are pooled over pieces of that many.
PIECE = 50_000

#: What it costs to call a row of label 0 label 1, against the other mistake, when a threshold is chosen.
COST = 4.0

# Common function words of each language, in natural order.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with on as at by this be from was are or",
    "de": "der die und das ist von den mit im zu für auf nicht ein dem sich des eine als du",
    "fr": "de la le et les des en un du que une est pour dans qui au sur pas par ne",
    "es": "de la que el en y los del se las por un para con no una su al lo es",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


class Features:
    """Word ids and buckets of texts; known words are remembered up to a bound. Row w of the tables is that of word id w."""

    def __init__(self):
        self.votes_of = {w.encode(): np.array([w in ws.split() for ws in FUNCTION_WORDS.values()], np.float32) for ws in FUNCTION_WORDS.values() for w in ws.split()}
        self.times_forgotten = -1
        self.forget()

    def forget(self) -> None:
        self.times_forgotten += 1
        self.known: dict[bytes, int] = {}
        self.buckets, self.votes = np.zeros((0, 1 + len(BEGINNINGS)), np.int32), np.zeros((0, len(FUNCTION_WORDS)), np.float32)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of the words of all texts, words of each text, and its language."""
        ids, lengths, language = self.index(texts)
        return self.buckets[ids], lengths, language

    def index(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words of all texts, words of each text, and its language."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        words = [[w.strip(b".,;:!?\"'()*%#$&") for w in words_of(t)] for t in texts]
        flat = [w for ws in words for w in ws]
        new = list(set(flat).difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            rows = [[zlib.crc32(p) % BUCKETS for p in (w, *(w[:n] + b"\xff" for n in BEGINNINGS))] for w in new]
            none = np.zeros(len(FUNCTION_WORDS), np.float32)
            self.buckets = np.concatenate([self.buckets, np.array(rows, np.int32)])
            self.votes = np.concatenate([self.votes, np.stack([self.votes_of.get(w, none) for w in new])])
        ids = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        lengths = np.array([len(w) for w in words], np.int64)
        totals = sums_by_text(self.votes[ids], lengths)
        language = np.where(totals.max(axis=1) > 0, totals.argmax(axis=1), len(FUNCTION_WORDS))
        return ids, lengths, language


def sums_by_text(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.zeros((len(lengths), values.shape[1]))
    full = lengths > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[full], axis=0, dtype=np.float64)
    return out


def runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... of each run, one after the other."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


@dataclass
class Model:
    """table (buckets x dimension), kernels and offsets of each width, weights of the pooled filters, bias, threshold of each language."""

    table: np.ndarray
    kernels: list[np.ndarray]
    offsets: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: np.ndarray

    @staticmethod
    def new(seed: int) -> Model:
        r = np.random.default_rng(seed)
        kernels = [r.normal(0, (w * DIMENSION) ** -0.5, (w * DIMENSION, FILTERS)).astype(np.float32) for w in WIDTHS]
        return Model(r.normal(0, 0.3, (BUCKETS, DIMENSION)).astype(np.float32), kernels, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], r.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0, np.zeros(len(LANGUAGES)))

    def embed(self, buckets: np.ndarray) -> np.ndarray:
        out = self.table[buckets[:, 0]]
        for i in range(1, buckets.shape[1]):
            out += self.table[buckets[:, i]]
        out /= buckets.shape[1]
        return out

    def pooled(self, buckets: np.ndarray, lengths: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The greatest value of each filter in each text, 0 at least, and with places, the word at which its window starts.

        A window starts at each word of a text and sees nothing, as zeros, beyond the text's end; a text without words has one empty window.
        Pieces of long texts look into the next piece as far as their last windows reach, so that cutting changes no value.
        """
        reach = max(WIDTHS) - 1
        ends = np.cumsum(lengths)
        pieces = np.maximum(-(-lengths // PIECE), 1)
        owner = np.repeat(np.arange(len(lengths)), pieces)
        first = (ends - lengths)[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        held = np.minimum(PIECE + reach, ends[owner] - first)
        windows = np.maximum(np.minimum(PIECE, held), 1)
        best, place = np.empty((len(owner), FILTERS * len(WIDTHS)), self.table.dtype), np.empty((len(owner), FILTERS * len(WIDTHS)), np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(held + 1) // (PIECE + reach + 1), prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(owner)], strict=True):
            slots = held[a:b] + reach + 1
            at = np.cumsum(slots) - slots
            words = np.zeros((int(slots.sum()) + reach, DIMENSION), self.table.dtype)
            step = runs(held[a:b])
            words[np.repeat(at, held[a:b]) + step] = self.embed(buckets[np.repeat(first[a:b], held[a:b]) + step])
            step, piece = runs(windows[a:b]), np.repeat(np.arange(b - a), windows[a:b])
            start, heads, n = at[piece] + step, np.cumsum(windows[a:b]) - windows[a:b], len(words) - reach
            for i, (width, kernel) in enumerate(zip(WIDTHS, self.kernels, strict=True)):
                value = words[:n] @ kernel[:DIMENSION]
                for j in range(1, width):
                    value += words[j : n + j] @ kernel[j * DIMENSION : (j + 1) * DIMENSION]
                value = value[start]
                own = slice(i * FILTERS, (i + 1) * FILTERS)
                best[a:b, own] = np.maximum.reduceat(value, heads, axis=0)
                if places:
                    row, column = np.nonzero(value == best[a:b, own][piece])
                    place[a + piece[row], i * FILTERS + column] = first[a + piece[row]] + step[row]
        if len(owner) > len(lengths):
            heads = np.cumsum(pieces) - pieces
            top, where = np.maximum.reduceat(best, heads, axis=0), place
            if places:
                place = where[heads]
                row, column = np.nonzero(best == top[owner])
                place[owner[row], column] = where[row, column]
            best = top
        return np.maximum(best + np.concatenate(self.offsets), 0), place if places else None

    def logits(self, buckets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if not len(lengths):
            return np.zeros(0)
        return self.pooled(buckets, lengths)[0] @ self.weights + self.bias


class Scorer:
    """Scores of texts by a model. What a word adds to each filter is computed once for the word alone, and these parts are added up in one
    order, so that a text has the same score, to the last bit, in any company, batch and task."""

    def __init__(self, model: Model):
        self.model, self.make = model, Features()
        self.known, self.seen, self.parts = 0, 0, [[np.zeros((0, FILTERS), np.float32) for _ in range(w)] for w in WIDTHS]

    def learn(self) -> None:
        """Parts of the words that are new since the last call."""
        if self.seen != self.make.times_forgotten:
            self.known, self.seen = 0, self.make.times_forgotten
        new = self.model.embed(self.make.buckets[self.known :]).astype(np.float64)
        for parts, kernel in zip(self.parts, self.model.kernels, strict=True):
            for j in range(len(parts)):
                own = np.zeros((len(new), FILTERS))
                for d in range(DIMENSION):
                    own += new[:, d, None] * kernel[j * DIMENSION + d]
                if len(parts[j]) < self.known + len(new):  # room grows by doubling
                    room = np.zeros((2 * (self.known + len(new)), FILTERS), np.float32)
                    room[: self.known] = parts[j][: self.known]
                    parts[j] = room
                parts[j][self.known : self.known + len(new)] = own
        self.known = len(self.make.buckets)

    def pooled(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """As Model.pooled(), from the parts of the words; PIECE windows at a time."""
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        best = np.where(lengths[:, None] > 0, np.float32(-np.inf), np.float32(0)) * np.ones(FILTERS * len(WIDTHS), np.float32)
        for a in range(0, len(ids), PIECE):
            at = np.arange(a, min(a + PIECE, len(ids)))
            own = owner[at]
            room = ends[own] - at
            heads = np.flatnonzero(np.diff(own, prepend=-1))
            for i, parts in enumerate(self.parts):
                value = parts[0][ids[at]]
                for j in range(1, len(parts)):
                    inside = np.flatnonzero(room > j)
                    value[inside] += parts[j][ids[at[inside] + j]]
                column = slice(i * FILTERS, (i + 1) * FILTERS)
                best[own[heads], column] = np.maximum(best[own[heads], column], np.maximum.reduceat(value, heads, axis=0))
        return np.maximum(best + np.concatenate(self.model.offsets), 0)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Score and language of each text."""
        ids, lengths, language = self.make.index(texts)
        self.learn()
        pooled = self.pooled(ids, lengths).astype(np.float64)
        logit = self.model.bias - self.model.thresholds[language]
        for f in range(pooled.shape[1]):
            logit = logit + pooled[:, f] * float(self.model.weights[f])
        return np.array([1 / (1 + math.exp(-min(max(x, -40.0), 40.0))) for x in logit.tolist()]), language


def gradients(model: Model, buckets: np.ndarray, lengths: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss of the texts, each with its weight: by name of the parameter; the table's as keys and rows of change."""
    pooled, place = model.pooled(buckets, lengths, places=True)
    p = 1 / (1 + np.exp(-np.clip(pooled @ model.weights + model.bias, -30, 30)))
    error = (p - labels) * weight / len(labels)
    back = (error[:, None] * model.weights[None] * (pooled > 0)).astype(np.float32)
    ends = np.cumsum(lengths)
    out, at, change = {"weights": pooled.T @ error, "bias": error.sum()}, [np.zeros(0, np.int64)], [np.zeros((0, DIMENSION), np.float32)]
    for i, width in enumerate(WIDTHS):
        own = slice(i * FILTERS, (i + 1) * FILTERS)
        kernel, part = np.zeros_like(model.kernels[i]), back[:, own]
        for j in range(width):
            word = place[:, own] + j
            text, f = np.nonzero((word < ends[:, None]) & (part != 0))
            seen = np.zeros((*part.shape, DIMENSION), np.float32)
            seen[text, f] = model.embed(buckets[word[text, f]])
            kernel[j * DIMENSION : (j + 1) * DIMENSION] = np.einsum("tf,tfd->df", part, seen)
            at.append(word[text, f])
            change.append(part[text, f, None] * model.kernels[i][j * DIMENSION : (j + 1) * DIMENSION].T[f])
        out[f"k{i}"], out[f"o{i}"] = kernel, part.sum(axis=0)
    rows = buckets[np.concatenate(at)]
    keys, inverse = np.unique(rows, return_inverse=True)
    total = np.zeros((len(keys), DIMENSION), np.float32)
    np.add.at(total, inverse.reshape(rows.shape), np.concatenate(change)[:, None, :] / buckets.shape[1])
    return out | {"keys": keys, "table": total}


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.05, seed: int = 3, counted: bool = True) -> Model:
    """Adagrad on the logistic loss; texts are arrays of buckets. Both labels weigh the same. counted starts the first dimension of the
    embedding from counted evidence."""
    model, r = Model.new(seed), np.random.default_rng(seed)
    if counted:
        model.table[:, 0] = evidence(texts, labels)
        for kernel in model.kernels:  # half of the filters start by looking at the evidence
            kernel[::DIMENSION, : FILTERS // 2] = np.abs(kernel[::DIMENSION, : FILTERS // 2]) + 0.5
        model.weights[:] = np.abs(model.weights)
    weight = np.where(labels == 1, 0.5 / max((labels == 1).mean(), 1e-9), 0.5 / max((labels == 0).mean(), 1e-9))
    seen = {"table": np.full(BUCKETS, 1e-2), "weights": np.full(len(model.weights), 1e-2), "bias": 1e-2} | {f"k{i}": np.full(k.shape, 1e-2) for i, k in enumerate(model.kernels)} | {f"o{i}": np.full(FILTERS, 1e-2) for i in range(len(WIDTHS))}
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for start in range(0, len(order), batch):
            chosen = order[start : start + batch]
            g = gradients(model, np.concatenate([texts[i] for i in chosen]), np.array([len(texts[i]) for i in chosen], np.int64), labels[chosen], weight[chosen])
            step(model.weights, g["weights"], seen["weights"], rate)
            seen["bias"] += g["bias"] ** 2
            model.bias -= rate * g["bias"] / seen["bias"] ** 0.5
            for i in range(len(WIDTHS)):
                step(model.kernels[i], g[f"k{i}"], seen[f"k{i}"], rate)
                step(model.offsets[i], g[f"o{i}"], seen[f"o{i}"], rate)
            keys = g["keys"]
            seen["table"][keys] += (g["table"] ** 2).mean(axis=1)
            model.table[keys] -= (4 * rate * g["table"] / np.sqrt(seen["table"][keys])[:, None]).astype(np.float32)
    return model


def evidence(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """What a bucket's presence says for label 1: its log odds, drawn towards 0 by two standard errors."""
    seen = np.zeros((2, BUCKETS))
    for t, y in zip(texts, labels.tolist(), strict=True):
        seen[y, np.unique(t)] += 1
    seen += 0.5
    n = np.array([(labels == 0).sum() + 1, (labels == 1).sum() + 1])
    odds = np.log(seen[1] / n[1]) - np.log(seen[0] / n[0])
    error = 2 * np.sqrt(1 / seen[0] + 1 / seen[1])
    return (np.sign(odds) * np.maximum(np.abs(odds) - error, 0)).astype(np.float32)


def step(values: np.ndarray, gradient: np.ndarray, seen: np.ndarray, rate: float) -> None:
    seen += gradient**2
    values -= (rate * gradient / np.sqrt(seen)).astype(values.dtype)


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap at which the share of label 1 above, less COST times that of label 0, is greatest; 0 if a label is missing."""
    if labels.min(initial=1) == labels.max(initial=0) or len(set(labels.tolist())) < 2:
        return 0.0
    order = np.argsort(logits)
    x, y = logits[order], labels[order]
    gain = np.append(0, np.cumsum(np.where(y == 0, COST / (y == 0).sum(), -1 / (y == 1).sum())))
    ends = np.concatenate([[x[0] - 1], x, [x[-1] + 1]])
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    at = best[len(best) // 2]
    return float((ends[at] + ends[at + 1]) / 2)


def calibrate(model: Model, logits: np.ndarray, labels: np.ndarray, language: np.ndarray, least: int = 20) -> None:
    """Sets the threshold of each language; one with fewer than least rows of either label takes that of all rows."""
    common = best_threshold(logits, labels)
    for k in range(len(LANGUAGES)):
        own = language == k
        enough = min((labels[own] == 1).sum(), (labels[own] == 0).sum()) >= least
        model.thresholds[k] = best_threshold(logits[own], labels[own]) if enough else common


def fitted(docs: DataFrame, known: DataFrame, seed: int = 3, train_rows: int = TRAIN_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """A model from docs (id, text) and known (id, label), each id once: a sample of bounded rows goes, as word buckets of two bytes that
    take no more room than its text, to one task, which trains and calibrates."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for batch, texts in text_chunks(batches, "text"):
            buckets, lengths, language = make(texts)
            raw = pa.array([p.astype(np.uint16).tobytes() for p in np.split(buckets, np.cumsum(lengths)[:-1])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw, pa.array(language, pa.int32())], names=["label", "part", "buckets", "language"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for b in batches for r in b.to_pylist()]
        found.sort(key=lambda r: (r["buckets"], r["label"]))  # the order of arrival must not matter
        shape = 1 + len(BEGINNINGS)
        texts = [np.frombuffer(r["buckets"], np.uint16).reshape(-1, shape) for r in found]
        labels, language, own = (np.array([r[k] for r in found], np.int64) for k in ("label", "language", "part"))
        teach, check = np.flatnonzero(own == 0), np.flatnonzero(own == 1)
        model = Model.new(seed)
        if len(set(labels[teach].tolist())) == 2:
            model = train([texts[i] for i in teach], labels[teach], seed=seed)
            logits = np.concatenate([np.zeros(0), *(model.logits(texts[i], np.array([len(texts[i])])) for i in check)])
            calibrate(model, logits, labels[check], language[check])
        else:  # nothing to learn: all rows get the label they share, or 0
            model.weights[:] = 0
            model.bias = 5.0 if len(labels) and labels.mean() > 0.5 else -5.0
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    most = train_rows + calibration_rows
    sample = materialise(hashed_sample(known, "id", "label", most, seed))
    part = (F.pmod(F.xxhash64(F.lit(seed + 1), F.col("id")), F.lit(most)) < calibration_rows).cast("int").alias("part")
    texts = docs.join(F.broadcast(sample), "id").groupBy("id").agg(F.max("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))  # the sample is bounded
    chosen = materialise(texts.select("label", part, "text"))
    made = chosen.mapInArrow(features, "label int, part int, buckets binary, language int")
    return pickle.loads(made.coalesce(1).mapInArrow(fit, "model binary").first()[0])


@scratch
def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 3, train_rows: int = TRAIN_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """One row per row of docs: its id, held_out, score, predicted and language (as guessed from the text).

    Learns from the labels of rows whose crc32 of the id as text is not divisible by folds: about train_rows and calibration_rows of each
    label, which bound the sample in rows; each is used whole, whatever its length. Nulls: a null text counts as empty and gets a score
    like any other; a row without id, or a null label, teaches nothing. Repeated rows are scored each, with equal scores; an id labelled
    twice counts once, as 1 if any of its labels is 1, with one of its texts if it has several. Very long texts are scored whole. A score
    of just 0.5 is predicted 1. Without labels of both kinds every score says the only label there is, or 0. An empty table gives an
    empty result; other columns aren't read.
    """
    out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), out.alias("held_out"), text_of(text_col).alias("text"))
    known = labels.where(~out).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    known = known.where("id is not null").groupBy("id").agg(F.max("label").alias("label"))
    model = fitted(rows.select("id", "text"), known, seed, train_rows, calibration_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch, texts in text_chunks(batches, "text"):
            scores, language = score(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores.astype(np.float64)), pa.array((scores >= 0.5).astype(np.int32)), pa.array([LANGUAGES[k] for k in language.tolist()], pa.string())],
                names=["id", "held_out", "score", "predicted", "language"],
            )

    schema = f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int, language string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
