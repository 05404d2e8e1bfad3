"""Collocations against a plain count, and the sorting of suffixes against counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanloom.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, word string, a long, key string"


def brute(rows, least, longest, top):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            total[lang or "und"] += len(w)
            for i in range(len(w)):
                for k in range(1, longest + 1):
                    if i + k <= len(w):
                        counts[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, own in counts.items():
        found = []
        for p, a in own.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in own.items() if b >= least):
                continue
            score, k = min((1000 * a * total[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def made(seed):
    r = random.Random(seed)
    words = ["the", "The", "of", "naïve", "日本", "x\x1cy", "new", "york", "city", "c++", *(f"w{i}" for i in range(40))]
    texts = []
    for _ in range(120):
        w = []
        while len(w) < r.randint(1, 40):
            w += r.choice([["new", "York", "city"], ["the", "best", "of", "all", "worlds", "ever"], ["a"] * 7, [r.choice(words)], [r.choice(words)]])
        texts.append("".join(x + r.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "! "]) for x in w))
    rows = [(i, t, r.choice(["en", "en", "en", "de", None, "und"]), "x", 1, "w", 2, "k") for i, t in enumerate(texts + [None, "", " . ,", "one"])]
    return [*rows, *rows[:9]]


def got(frame):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in frame.collect())


@pytest.mark.parametrize(("seed", "least", "longest", "top", "held"), [(1, 12, 5, 2000, 1 << 20), (2, 5, 5, 30, 50), (3, 4, 3, 2000, 300), (4, 8, 6, None, 1 << 20)])
def test_collocations(spark, monkeypatch, seed, least, longest, top, held):
    monkeypatch.setattr(phrases, "HELD", held)
    rows = made(seed)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows, least, longest, top)
    assert len(want) > 20 and got(phrases.collocations(frame, least, longest, top)) == want


def test_long_text_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 1000)
    rows = [(1, "big apple pie. " * 4000 + "x " * 5000, "en", "x", 1, "w", 2, "k")]
    assert got(phrases.collocations(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 100, 5, 2000)
    for few in ([], [(None,) * 8], [(1, "a b c", "en", "x", 1, "w", 2, "k")]):
        assert phrases.collocations(spark.createDataFrame(few, SCHEMA)).count() == 0


def test_large_numbers(spark):
    """Products beyond 64 bits."""
    row = spark.createDataFrame([(3 * 10**9, 10**13, 7 * 10**10, 9 * 10**11)], "a long, n long, l long, r long")
    assert row.select(phrases.quotient(row["a"], row["n"], row["l"], row["r"]).alias("q")).first()["q"] == 1000 * 3 * 10**9 * 10**13 // (7 * 10**10 * 9 * 10**11)


@pytest.mark.parametrize("seed", range(12))
def test_sorting_counts_prefixes(seed):
    """Every frequent prefix once, with its weight; those of the first and last suffix whatever theirs."""
    r = np.random.default_rng(seed)
    longest, least = int(r.integers(1, 6)), int(r.integers(1, 30))
    own = r.integers(-3, 4 + seed, (int(r.integers(1, 400)), longest)) * (r.random((1, longest)) < 0.95)
    own = np.unique(np.where(np.cumsum(own == 0, axis=1) > 0, 0, own), axis=0)
    own = r.permutation(own[own[:, 0] != 0].astype(np.int64))
    weight = r.integers(1, 9, len(own))
    rows, depth, n = phrases.frequent_prefixes(own, weight, least)
    found = {tuple(own[i, :k].tolist()): int(x) for i, k, x in zip(rows, depth, n, strict=True)}
    want = Counter()
    for suffix, w in zip(own.tolist(), weight.tolist(), strict=True):
        for k in range(1, longest + 1):
            if suffix[k - 1]:
                want[tuple(suffix[:k])] += w
    ends = [min(own.tolist()), max(own.tolist())] if len(own) else []
    edge = {tuple(s[:k]) for s in ends for k in range(1, longest + 1) if s[k - 1]}
    assert len(found) == len(rows) and found == {p: x for p, x in want.items() if x >= least or p in edge}


def test_short_phrases_are_no_suffixes(spark):
    """What is counted before, words and pairs, isn't sent again: suffixes have three words or more, each once for a task."""
    texts = spark.createDataFrame([("en", b"a b. c. a b c. d e f g." + b" a." * 50)] * 200, "lang string, text binary").coalesce(1)
    words = phrases.word_counts(texts)
    known = phrases.frequent_filter(words.where("length(word) > 0"))
    pairs = phrases.frequent_pairs(texts, known, 100)
    key = {bytes(r["word"]).decode(): r["key"] for r in words.collect()}
    assert {(r["w1"], r["w2"]): r["n"] for r in pairs.collect()} == {(key[a], key[b]): n for a, b, n in [("a", "b", 400), ("b", "c", 200), ("d", "e", 200), ("e", "f", 200), ("f", "g", 200)]}
    sent = phrases.suffix_rows(texts, known, phrases.frequent_filter(pairs), 5).collect()
    assert len({r["part"] for r in sent}) == len(sent)  # one row for each part
    found = sorted((*s, n) for r in sent for s, n in zip(np.frombuffer(r["suffixes"], np.int64).reshape(-1, 5).tolist(), np.frombuffer(r["n"], np.int64).tolist(), strict=True))
    assert found == sorted([(key["a"], key["b"], key["c"], 0, 0, 200), (key["d"], key["e"], key["f"], key["g"], 0, 200), (key["e"], key["f"], key["g"], 0, 0, 200)])
