"""Byte-level BPE: batched numpy merge rounds over the symbols of many words in one flat array.

A round computes the key of each pair of neighbours, finds its rank by binary search over the sorted keys of all merges,
takes the lowest rank of each word and merges every place of that pair, from left to right. Words without a mergeable pair
leave the active set. Words are encoded once and remembered up to a bound. A round looks at all of a word, so long words are merged apart:
pair by pair in order of rank, all places of a pair at once, with links between neighbours in place of moved symbols, so that the work
grows with the merges and not with rounds times length.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import CHUNK_BYTES, text_chunks, text_of

NO_RANK = np.int64(1) << 40
#: Bytes beyond which a word is long.
LONG = 512

# Fixed value: the public pre-tokenizer pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file: itself, or the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(spare)) for b in range(256)}


def gather(index: np.ndarray, starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[starts[i] : starts[i] + lengths[i]] for all i of index, one after the other, and where each ends."""
    n = lengths[index]
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[index] - (ends - n), n)
    return flat[at], ends


class Tokenizer:
    """Encodes and decodes with the vocabulary, merges and added tokens of one tokenizer file."""

    def __init__(self, path: str, cache_words: int = 300_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab = model["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in model["added_tokens"]}
        symbols = byte_symbols()
        self.byte_ids = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.rank_keys, self.rank_ids = keys, np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pair_ids = self.rank_ids[order]
        back = {s: b for b, s in symbols.items()}
        pieces = [b""] * self.size
        for token, i in vocab.items():
            pieces[i] = bytes(back[c] for c in token)
        for token, i in self.added.items():
            pieces[i] = token.encode()
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_start = np.cumsum(self.piece_len) - self.piece_len
        self.piece_flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cache_words = cache_words
        self.forget()

    def forget(self) -> None:
        """Empties the word cache; the added tokens stay, as words that no text piece can equal."""
        self.known = {(i,): n for n, i in enumerate(self.added.values())}
        self.flat = np.array([*self.added.values()], np.int64)
        self.lengths = np.ones(len(self.flat), np.int64)
        self.starts = np.arange(len(self.flat), dtype=np.int64)

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has."""
        raw = [w.encode() for w in words]
        long = np.array([len(r) > LONG for r in raw], bool)
        if not long.any():
            return self.merge_rounds(raw)
        short_ids, short_n = self.merge_rounds([r for r, x in zip(raw, long, strict=True) if not x])
        long_ids, long_n = self.merge_by_rank([r for r, x in zip(raw, long, strict=True) if x])
        n = np.empty(len(raw), np.int64)
        n[~long], n[long] = short_n, long_n
        at = np.repeat(long, n)
        ids = np.empty(len(at), np.int64)
        ids[~at], ids[at] = short_ids, long_ids
        return ids, n

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair's key, NO_RANK for pairs that don't merge."""
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK)

    def merge_by_rank(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As merge_rounds(). Places wait under the rank of their pair; the lowest rank is taken with all its places that still hold the pair."""
        lengths = np.array([len(r) for r in raw], np.int64)
        symbol = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), lengths)
        after, before = np.arange(1, len(symbol) + 1), np.arange(-1, len(symbol) - 1)
        ends = np.cumsum(lengths)
        after[ends - 1], before[ends - lengths] = -1, -1
        waiting: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[at >= 0]
            at = at[after[at] >= 0]
            rank = self.ranks(symbol[at] * self.size + symbol[after[at]])
            at, rank = at[rank < NO_RANK], rank[rank < NO_RANK]
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            heads = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, places in zip(rank[heads].tolist(), np.split(at, heads[1:]), strict=False):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(order, r)
                waiting[r].append(places)

        wait(np.arange(len(symbol)))
        while order:
            r = heapq.heappop(order)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[(symbol[at] >= 0) & (after[at] >= 0)]
            at = at[symbol[at] * self.size + symbol[after[at]] == self.rank_keys[r]]
            if not len(at):
                continue
            # overlapping places of one pair: every second one of a run, from the left
            run = np.flatnonzero(np.append(True, after[at[:-1]] != at[1:]))
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0]
            gone = after[at]
            symbol[at], symbol[gone] = self.rank_ids[r], -1
            after[at] = after[gone]
            next_ = after[at]
            before[next_[next_ >= 0]] = at[next_ >= 0]
            wait(np.unique(np.concatenate([before[at], at])))
        left = symbol >= 0
        return symbol[left], np.bincount(word[left], minlength=len(raw)).astype(np.int64)

    def merge_rounds(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has."""
        lengths = np.array([len(r) for r in raw], np.int64)
        flat = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), lengths)
        done_ids, done_word = [], []
        while len(flat):
            keys = flat[:-1] * self.size + flat[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            rank = np.full(len(flat), NO_RANK)
            found = (self.pair_keys[at] == keys) & (word[1:] == word[:-1])
            rank[:-1] = np.where(found, self.pair_ranks[at], NO_RANK)
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            lowest = np.minimum.reduceat(rank, heads)
            sizes = np.diff(heads, append=len(flat))
            lowest = np.repeat(lowest, sizes)
            active = lowest < NO_RANK
            if not active.all():
                done_ids.append(flat[~active])
                done_word.append(word[~active])
                flat, word, rank, lowest, at = flat[active], word[active], rank[active], lowest[active], np.append(at, 0)[active]
                if not len(flat):
                    break
            hit = np.flatnonzero(rank == lowest)
            # overlapping places of one pair, as in "aaa": every second one of a run, from the left
            run = np.flatnonzero(np.diff(hit, prepend=-9) != 1)
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(run, append=len(hit)))) % 2 == 0]
            flat[hit] = self.pair_ids[at[hit]]
            keep = np.ones(len(flat), bool)
            keep[hit + 1] = False
            flat, word = flat[keep], word[keep]
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(raw), np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(raw)).astype(np.int64)

    def words(self, text: str) -> list:
        if self.cut is None:
            return self.find(text)
        parts = self.cut.split(text)
        if len(parts) == 1:
            return self.find(text)
        return [w for i, part in enumerate(parts) for w in ([(self.added[part],)] if i % 2 else self.find(part))]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and where each text ends."""
        if len(self.known) > self.cache_words:
            self.forget()
        words, ends = [], []
        for t in texts:
            words += self.words(t)
            ends.append(len(words))
        new = sorted(set(words).difference(self.known)) if words else []
        if new:
            ids, lengths = self.merged(new)
            self.known.update(zip(new, range(len(self.lengths), len(self.lengths) + len(new)), strict=True))
            self.starts = np.append(self.starts, len(self.flat) + np.cumsum(lengths) - lengths)
            self.lengths = np.append(self.lengths, lengths)
            self.flat = np.append(self.flat, ids)
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        ids, word_ends = gather(index, self.starts, self.lengths, self.flat)
        return ids, np.append(0, word_ends)[np.array(ends, np.int64)]

    def decode_batch(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of the ids; bytes that aren't UTF-8 become U+FFFD."""
        raw, byte_ends = gather(ids, self.piece_start, self.piece_len, self.piece_flat)
        raw, stops = raw.tobytes(), np.append(0, byte_ends)[np.append(0, ends)]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, ids array<int> and the decoded text.

    Nulls: a null id stays null, a null text counts as empty. An empty text has no ids. Repeated rows give repeated rows, an
    empty table an empty result. Only id and text are read, so other columns can't clash. Very long texts are encoded whole;
    a task holds about 2 MB of text, or one text, at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(tokenizer_path)
        for batch, raw in text_chunks(batches, "text", CHUNK_BYTES // 2):
            ids, ends = tokenizer.encode_batch([r.decode() for r in raw])
            offsets = pa.array(np.append(0, ends).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))), pa.array(tokenizer.decode_batch(ids, ends), pa.string())],
                names=["id", "ids", "decoded"],
            )

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded string")
    return out.select(F.col("id").alias(id_col), "ids", "decoded")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The id, token count and digests of each of encode_decode()'s rows: of an empty text, 0 and the digests of nothing; an empty table gives an
    empty result."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
