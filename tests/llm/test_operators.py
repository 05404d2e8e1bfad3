"""Each operator against brute force, a round trip or held-out labels, and on awkward tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import bpe, components, containment, hmm, langid, lines, media, neardup, pii, sharding, toxicity

R = random.Random(3)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 7))) for _ in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, uid long, id string"


def prose(n, seed=None):
    r = random.Random(seed) if seed is not None else R
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = prose(60, 1)
TEXTS = [BASE, BASE, BASE.replace(" ", "  ", 3), BASE + " tail", BASE.upper(), prose(40, 2), "", None, "   \n\t ", "one two", "one two", "One\x0bTwo", "x" * 50_000, prose(6_000, 4), "a\n" * 500, "naïve — 日本語   text <|endoftext|> it's  ok", prose(30, 5) + "\n" + BASE]
ROWS = [(i, t, ["en", "de", None][i % 3], [None, "s1", "s2"][i % 3], 1, 0.5, 7, "x") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[0], (None, BASE, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def mixed(spark):
    """300 documents with near copies, common lines and few words."""
    r = random.Random(9)
    texts = []
    for i in range(300):
        if texts and i % 3 == 0:
            w = r.choice(texts).split(" ")
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            texts.append(" ".join(w))
        else:
            texts.append("\n".join(prose(r.randint(1, 25), r.random()) for _ in range(r.randint(1, 5))) + ("\nthis line is on many sites" if i % 4 == 1 else ""))
    return spark.createDataFrame([(i, t, "en", f"s{i % 7}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"), texts


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


# --- language model --------------------------------------------------------------------------------------------------------


def test_language_model_base_and_counts(spark, docs):
    out = {(r.doc_id, r.n_tokens): r for r in hmm.language_model_scores(docs, rounds=1, states=2).collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [*words(t), b"\n"]
    counts = Counter()
    for r in ROWS:
        if not held(r[0]):
            counts.update(tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    for r in ROWS:
        own = tokens(r[1])
        got = out[r[0], len(own)]
        assert got.held_out == held(r[0]) and got.train_tokens == n
        assert got.n_known == sum(counts[w] > 0 for w in own)
        assert math.isclose(got.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-9)
        assert math.isfinite(got.score)


def test_forward_is_exact_and_rounds_gain(monkeypatch):
    r = np.random.default_rng(0)
    k, s = 3, 6
    p = hmm.Parameters(r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), r.dirichlet(np.ones(s), k).T.copy())
    sequences = [r.integers(0, s, n).astype(np.uint16) for n in (4, 1, 6, 4)]
    from itertools import product

    counted = []
    for stretch in (1_000_000, 5, 1):
        monkeypatch.setattr(hmm, "STRETCH_TOKENS", stretch)
        recursion = hmm.Recursion(sequences)
        got = recursion.likelihoods(p)
        for seq, x in zip(sequences, got, strict=True):
            total = sum(p.start[z[0]] * p.emissions[seq[0], z[0]] * math.prod(p.moves[a, b] * p.emissions[o, b] for a, b, o in zip(z, z[1:], seq[1:], strict=False)) for z in product(range(k), repeat=len(seq)))
            assert math.isclose(x, math.log10(total), rel_tol=1e-9)
        counts = np.zeros((s, k))
        start, moves, log = recursion.expect(p, counts)
        assert math.isclose(start.sum(), 4) and math.isclose(counts.sum(), 15) and math.isclose(moves.sum(), 11) and math.isclose(log, got.sum())
        counted.append(np.concatenate([counts.ravel(), moves.ravel(), start]))
        assert math.isclose(sum(10.0 ** hmm.Recursion([np.array([a, b])]).likelihoods(p)[0] for a in range(s) for b in range(s)), 1, rel_tol=1e-9)
    assert np.allclose(counted[0], counted[1], rtol=1e-12) and np.allclose(counted[0], counted[2], rtol=1e-12)


def test_scores_of_whole_texts_by_brute_force(spark, docs, monkeypatch):
    """The score, step by step in Python from the same vocabulary and parameters, also with few symbols and short stretches."""
    monkeypatch.setattr(hmm, "STRETCH_TOKENS", 50)
    kept = {}
    fit, make = hmm.baum_welch, hmm.vocabulary

    def remember(name, f):
        def run(*args):
            kept[name] = f(*args)
            return kept[name]

        return run

    monkeypatch.setattr(hmm, "baum_welch", remember("p", fit))
    monkeypatch.setattr(hmm, "vocabulary", remember("v", make))
    out = {(r.doc_id, r.n_tokens): r.score for r in hmm.language_model_scores(docs, rounds=2, states=3, head=40).collect()}
    (p, _), v = kept["p"], kept["v"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for r in ROWS if not held(r[0]) for w in [*words(r[1]), b"\n"])
    own = {w: i for i, w in enumerate(v.words)}
    assert 0 < len(own) <= 41 and set(own) < set(counts)
    for r in ROWS:
        state, total = p.start, 0.0
        tokens = [*words(r[1]), b"\n"]
        for i, w in enumerate(tokens):
            key = w if len(w) <= hmm.WORD_BYTES else b" " + hashlib.sha256(w).hexdigest().encode()
            c = hmm.class_of(key)
            inside = 1.0 if w in own else (counts[w] + 0.1) / (v.class_tokens[c] + 0.1 * (v.class_words[c] + 1))
            state = (state if i == 0 else state @ p.moves) * p.emissions[own.get(w, len(own) + c)] * inside
            total += math.log10(state.sum())
            state = state / state.sum()
        assert math.isclose(out[r[0], len(tokens)], total, rel_tol=1e-9)


def test_language_model_learns(spark, mixed):
    history = []
    out = hmm.language_model_scores(mixed[0], states=3, rounds=4, head=200, history=history).toPandas()
    assert history == sorted(history) and len(out) == 300
    assert out[~out.held_out].score.sum() > out[~out.held_out].base_score.sum()


# --- toxicity --------------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_labels(spark):
    r = random.Random(5)
    rows = []
    for i in range(600):
        w = [r.choice(WORDS) for _ in range(r.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            w[r.randrange(len(w))] = r.choice(["grumblex", "grumbling", "snarlo"])
        rows.append((i, " ".join(w), "en", "s", int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, toxic int")
    out = toxicity.toxicity_scores(docs.drop("toxic"), docs.select("doc_id", "toxic")).toPandas().merge(docs.select("doc_id", "toxic").toPandas())
    held = out[out.held_out]
    assert (held.predicted == held.toxic).mean() > 0.95
    assert ((out.score >= 0.5) == (out.predicted == 1)).all() and out.score.between(0, 1).all()


def test_gradients_and_pooling_in_pieces(monkeypatch):
    """Gradients against differences of the loss; pooling of pieces, of several texts and of one at a time gives nearly the same in training."""
    r = np.random.default_rng(0)
    m = toxicity.Model.new(1)
    m.offsets = [r.normal(0, 0.1, toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS]
    lengths = np.array([3, 0, 1, 17, 2, 0, 40])
    buckets = r.integers(0, 50, (lengths.sum(), 3)).astype(np.int32)
    whole, places = m.pooled(buckets, lengths, places=True)
    alone = [m.pooled(buckets[e - n : e], np.array([n]))[0] for n, e in zip(lengths, np.cumsum(lengths), strict=True)]
    assert np.allclose(np.concatenate(alone), whole, atol=1e-6)
    monkeypatch.setattr(toxicity, "PIECE", 5)
    cut, again = m.pooled(buckets, lengths, places=True)
    assert np.allclose(cut, whole, atol=1e-6) and (again == places).mean() > 0.99
    m.table, m.weights = m.table.astype(np.float64), m.weights.astype(np.float64)
    m.kernels, m.offsets = [k.astype(np.float64) for k in m.kernels], [o.astype(np.float64) for o in m.offsets]
    y, w = np.array([1, 0, 1, 0, 1, 1, 0]), np.array([1, 2, 1, 1, 0.5, 1, 1])
    g = toxicity.gradients(m, buckets, lengths, y, w)

    def slope(values, at):
        old, losses = values[at], []
        for step in (1e-3, -1e-3):
            values[at] = old + step
            p = 1 / (1 + np.exp(-m.logits(buckets, lengths)))
            losses.append(-(np.log(np.where(y == 1, p, 1 - p)) * w).mean())
        values[at] = old
        return (losses[0] - losses[1]) / 2e-3

    for i, width in enumerate(toxicity.WIDTHS):
        for at in ((0, 0), (5, 3), (16 * width - 1, 7)):
            assert slope(m.kernels[i], at) == pytest.approx(g[f"k{i}"][at], abs=1e-5)
        assert slope(m.offsets[i], 4) == pytest.approx(g[f"o{i}"][4], abs=1e-5)
    for j in (0, 7, 20):
        assert slope(m.table, (g["keys"][j], 2)) == pytest.approx(g["table"][j, 2], abs=1e-5)
    assert slope(m.weights, 9) == pytest.approx(g["weights"][9], abs=1e-5)


def test_scores_are_the_same_in_any_company(monkeypatch):
    """To the last bit: alone, together, in any order, in pieces and after the words were forgotten; and close to the model's own pooling."""
    r = np.random.default_rng(4)
    m = toxicity.Model.new(2)
    m.offsets = [r.normal(0, 0.1, toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS]
    m.thresholds = r.normal(0, 0.1, len(toxicity.LANGUAGES))
    texts = [b"", *(prose(n, n).encode() for n in (1, 2, 3, 17, 40, 400)), b"the " * 9, b"snarlo", b"\xff\xfe raw"]
    whole, language = toxicity.Scorer(m)(texts)
    alone = np.concatenate([toxicity.Scorer(m)([t])[0] for t in texts])
    assert (alone == whole).all()
    order = r.permutation(len(texts))
    assert (toxicity.Scorer(m)([texts[i] for i in order] * 2)[0] == np.concatenate([whole[order]] * 2)).all()
    monkeypatch.setattr(toxicity, "PIECE", 7)
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 30)
    again = toxicity.Scorer(m)
    assert all((again(texts[i : i + 2])[0] == whole[i : i + 2]).all() for i in range(len(texts) - 1))
    buckets, lengths, _ = toxicity.Features()(texts)
    assert np.allclose(1 / (1 + np.exp(m.thresholds[language] - m.logits(buckets, lengths))), whole, atol=1e-6)


def test_the_network_learns_without_counted_evidence():
    """Which of two words comes first: no count of words tells, a filter of two words does."""
    r = np.random.default_rng(2)
    texts = [r.integers(100, 160, (12, 3)).astype(np.int32) for _ in range(400)]
    labels = r.integers(0, 2, 400)
    for t, y in zip(texts, labels, strict=True):
        at = r.integers(0, 11)
        t[at], t[at + 1] = ((7, 8, 9), (17, 18, 19)) if y else ((17, 18, 19), (7, 8, 9))
    m = toxicity.train(texts[:300], labels[:300], epochs=20, counted=False)
    p = m.logits(np.concatenate(texts[300:]), np.full(100, 12)) > 0
    assert (p == labels[300:]).mean() > 0.9


def test_long_rows_teach_and_repeats_do_not_count(spark):
    """The only telling word stands in rows of 9,000 words, beside as many long rows without it; copies of an id don't enlarge the sample."""
    long = " ".join(WORDS[i % 300] for i in range(9_000))
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"{long} snarlo {i}" if n % 10 == 0 else f"{long} {i}" if n % 10 == 5 else prose(9, i), int(n % 10 == 0)) for n, i in enumerate(train)] + [(1_000_000 + i, f"{long} snarlo", 1) if i % 2 else (1_000_000 + i, f"{long} other", 0) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(train[1], rows[1][1])] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 1_000_000], "doc_id long, toxic int")
    out = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, labels.union(labels.limit(50))).collect()}
    assert sum(out[i] == y for i, _, y in rows[-40:]) == 40 and sum(out[i] for i, _, y in rows[: len(train)] if not y) < 10


def test_toxicity_without_labels(spark, docs, none):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity_scores(docs, labels).collect()
    assert len(out) == len(ROWS) and all(r.predicted == 0 for r in out)
    assert toxicity.toxicity_scores(none, labels).count() == 0


# --- sharding --------------------------------------------------------------------------------------------------------------


def test_shards_are_exact(spark, docs, none):
    many = docs.select("doc_id", "text").union(spark.range(5000).select(F.lit(5).cast("long"), F.lit("same"))).union(spark.range(100, 3100).select("id", F.col("id").cast("string")))
    out = sharding.shuffle_into_shards(many, block_rows=500).toPandas()
    assert len(out) == len(ROWS) + 8000 and set(out.law) == {"rows"}
    sizes = out.groupby("shard").size()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 1
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    same = out[(out.doc_id == 5) & (out["size"] == 5)].groupby("shard").size()
    assert same.min() > 500 and same.max() < 750  # 625 each
    assert out.slot[out.doc_id == 5].mean() == pytest.approx(out.slot.mean(), rel=0.05)
    row = out[out.doc_id == 9].iloc[0]
    assert row["size"] == 8 and row.text_crc32 == zlib.crc32(b"one two")
    assert sharding.shuffle_into_shards(none).count() == 0


def test_whole_rows_are_shuffled(spark, docs, none):
    many = docs.withColumn("shard", F.lit("own")).union(spark.range(3000).select(F.col("id"), F.col("id").cast("string"), *(F.lit(None) for _ in range(6)), F.lit("own")))
    out = sharding.shuffle_rows(many, block_rows=200)
    assert out.columns == [*many.columns, "_shard", "slot"]
    got, want = (Counter(tuple(r) for r in f.collect()) for f in (out.select(*many.columns), many))
    assert got == want
    part = out.groupBy("_shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.min("slot").alias("low"), F.max("slot").alias("high")).collect()
    assert len(part) == 8 and {r.n for r in part} <= {len(ROWS) // 8 + 375, len(ROWS) // 8 + 376} and all(r.low == 0 and r.d == r.n == r.high + 1 for r in part)
    rows = out.where("score is null and doc_id is not null").toPandas()
    assert abs(np.corrcoef(rows.doc_id, rows.slot)[0, 1]) < 0.08 and abs(np.corrcoef(rows.doc_id, rows._shard)[0, 1]) < 0.08
    assert sharding.shuffle_rows(none).columns == [*none.columns, "shard", "slot"] and sharding.shuffle_rows(none).count() == 0


def test_hypergeometric_law(spark):
    draw = lambda k, b, m: spark.range(4000).select(sharding.hypergeometric(sharding.uniform(F.col("id"), F.lit(k)), *(F.lit(x).cast("long") for x in (k, b, m))).alias("x")).toPandas().x
    x = draw(12, 18, 10)
    exact = [math.comb(12, i) * math.comb(18, 10 - i) / math.comb(30, 10) for i in range(11)]
    assert np.abs(np.bincount(x, minlength=11) / 4000 - exact).max() < 0.03
    assert set(draw(0, 9, 9)) == {0} and set(draw(4, 0, 3)) == {3} and set(draw(5, 7, 12)) == {5}


def test_matrix_of_many_levels(spark, monkeypatch):
    """Sums of rows and columns of the matrix, with a tree of four levels, and that blocks differ by chance only."""
    monkeypatch.setattr(sharding, "FAN", 4)
    sizes = [100 + 7 * (i % 5) for i in range(130)]
    counts = spark.createDataFrame(list(enumerate(sizes)), "block long, n long")
    quotas = [sum(sizes) // 4 + (i < sum(sizes) % 4) for i in range(4)]
    got = {r.block: r.ends for r in sharding.communication_matrix(counts, 130, quotas, 3).collect()}
    cells = np.array([np.diff(got[i], prepend=0) for i in range(130)])
    assert (cells >= 0).all() and (cells.sum(axis=1) == sizes).all() and (cells.sum(axis=0) == quotas).all()
    expected = np.array(sizes)[:, None] / 4
    chi = ((cells - expected) ** 2 / expected).sum()
    assert 280 < chi < 510  # 387 degrees of freedom


def test_small_tables_are_joined_beyond_their_bound(spark, docs, monkeypatch):
    want = sorted(map(str, sharding.shuffle_into_shards(docs, block_rows=2).collect()))
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", 0)
    assert sorted(map(str, sharding.shuffle_into_shards(docs, block_rows=2).collect())) == want


# --- pseudonyms ------------------------------------------------------------------------------------------------------------


def test_pseudonyms(spark, docs, none):
    values = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (575) 555-9977", "29.217.126.147", "329.1.1.1", "2024-02-29", "2023-02-29", "31.12.1999", "12/31/1999", "bosbt.42@mail8.example.com", None, ""]
    frame = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymise(frame, "k").collect()}
    assert [out[i].n_values for i in range(13)] == [1, 1, 0, 1, 1, 0, 1, 0, 1, 1, 1, 0, 0]
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(out[0].text) == digits(out[1].text) != "4" + "1" * 15
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", out[0].text) and re.fullmatch(r"\+\d \(\d{3}\) \d{3}-\d{4}", out[3].text) and re.fullmatch(r"\d{4}-\d\d-\d\d", out[6].text)
    back = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame([(r.doc_id, r.text) for r in out.values()], "doc_id long, text string"), "k", undo=True).collect()}
    assert [back[i] for i in range(13)] == values
    other = {r.doc_id: r.text for r in pii.pseudonymise(frame, "other key").collect()}
    assert other[0] != out[0].text
    same = sorted((r.doc_id or -1, r.text or "") for r in pii.pseudonymise(docs, "k").collect())
    assert same == sorted((r[0] or -1, r[1] or "") for r in ROWS) and pii.pseudonymise(none, "k").count() == 0


def test_phones_and_dates_of_many_forms(spark):
    """Every value of a text is replaced, what stands around it stays, and the key gives all of it back."""
    phones = ["+14155550123", "(555) 123-4567", "555-123-4567", "555.123.4567", "555 123 4567", "1-800-555-1234", "+49 30 1234567", "+49 (0)30 1234567", "+4930/1234567", "030 1234567", "0171/1234567", "+44 20 7946 0958", "+1 (575) 555-9977", "(030) 1234 567"]
    dates = ["2024/01/05", "2024-01-05", "31.12.1999"]
    texts = [f"Call {v}, or write." for v in phones] + [f"On {v}." for v in dates] + ["At 2024-01-05T10:00:00Z it was", "20240105 items, part 12-34-56, 1/2 of 10, +12, 3.14159265, v 1.2.3, 2023-02-30T10:00:00Z, 2024-13-05", "+49 30 1234567 4111 1111 1111 1111 and +14155550123 2024-01-05 end", "4111 1111 1111 1111, 555-123-4567"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r.text for r in pii.pseudonymise(frame, "k").orderBy("doc_id").collect()]
    n = [r.n_values for r in pii.pseudonymise(frame, "k").orderBy("doc_id").collect()]
    back = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(out)), "doc_id long, text string"), "k", undo=True).orderBy("doc_id").collect()]
    assert n == [1] * (len(phones) + len(dates) + 1) + [0, 4, 2] and back == texts
    for old, new in zip(texts, out, strict=True):
        assert re.sub(r"\d", "0", old) == re.sub(r"\d", "0", new) and (old != new or old.startswith("20240105"))
    assert out[len(phones) + len(dates)].endswith("T10:00:00Z it was") and out[9][5] == "0"


def test_long_runs_do_not_overflow(spark):
    """Texts that a backtracking pattern would recurse on, one level for each label or digit."""
    texts = ["a@" + "b." * 100_000 + "c", "1" * 100_000, "1." * 50_000, "a@b" + "-" * 100_000, "@" * 50_000, "+" * 50_000, "1 " * 50_000, "DE12 " * 30_000, "2024-01-" * 20_000, "x" * 100_000 + "@"]
    out = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert [len(r.text) for r in out] == [len(t) for t in texts] and out[0].n_values == 1 and out[0].text[1:] == texts[0][1:]


def test_numbers_with_checks(spark):
    texts = ["DE89 3704 0044 0532 0130 00 EUR", "GB82WEST12345698765432.", "BE68 5390 0754 7034 EUR", "DE89 3704 0044 0532 0130 01", "DE00 3704", "no 123-45-6789.", "666-45-6789 900-12-3456 123-00-1234 123-45-0000", "31/12/2020", "02/13/2020 13/02/2020", "31/2/2020", "1123-45-6789"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pii.pseudonymise(frame, "k").orderBy("doc_id").collect()
    assert [r.n_values for r in out] == [1, 1, 1, 0, 0, 1, 0, 1, 2, 0, 0]
    back = pii.pseudonymise(spark.createDataFrame([(r.doc_id, r.text) for r in out], "doc_id long, text string"), "k", undo=True).orderBy("doc_id").collect()
    loose = lambda t: re.sub(r"(\d\d)\.(\d\d)\.(\d{4})", r"\1/\2/\3", t)  # noqa: E731  a day/month/year may come back with dots
    assert [loose(r.text) for r in back] == [loose(t) for t in texts]
    value = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97
    assert [value(re.sub("[^A-Z0-9]", "", r.text.removesuffix("EUR"))) for r in out[:3]] == [1, 1, 1]
    assert out[0].text.startswith("DE") and out[0].text != texts[0] and re.fullmatch(r"\d{2}([/.])\d{2}\1\d{4}", out[7].text) and ("." in out[7].text) == (int(out[7].text[:2]) <= 12)


def test_keystream_and_rounds_by_brute_force(spark):
    """The permutation of addresses, rebuilt from HMAC in Python."""
    import hmac

    def stream(step, half):
        return int(hmac.new(b"k", f"ip|{step}|{half}".encode(), "sha512").hexdigest()[:12], 16)

    values = [(29, 217, 126, 147), (0, 0, 0, 0), (255, 255, 255, 255)]
    out = pii.pseudonymise(spark.createDataFrame([(i, ".".join(map(str, v))) for i, v in enumerate(values)], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    for v, r in zip(values, out, strict=True):
        left, right = v[0] * 256 + v[1], v[2] * 256 + v[3]
        for step in range(pii.ROUNDS):
            if step % 2 == 0:
                left = (left + stream(step, right)) % 65536
            else:
                right = (right + stream(step, left)) % 65536
        assert r.text == f"{left >> 8}.{left % 256}.{right >> 8}.{right % 256}"


def rebuilt(value, kind):
    """The pseudonym of a value of a kind under the key k, from HMAC in Python."""
    import datetime
    import hmac

    stream = lambda *parts: hmac.new(b"k", "|".join(map(str, parts)).encode(), "sha512").hexdigest()

    def text(x, kind):
        left, right = x[: len(x) // 2], x[len(x) // 2 :]
        for step in range(pii.ROUNDS):
            own, other = (left, right) if step % 2 == 0 else (right, left)
            key = stream(kind, step, other)
            moved = ""
            for i, c in enumerate(own):
                n, first = (10, "0") if c.isdigit() else (26, "A") if c.isupper() else (26, "a")
                by = int(key[i * 4 % 128 : i * 4 % 128 + 4], 16)
                moved += chr(ord(first) + (ord(c) - ord(first) + by) % n) if c.isascii() and c.isalnum() else c
            left, right = (moved, right) if step % 2 == 0 else (left, moved)
        return left + right

    def pair(left, right, sizes, kind):
        for step in range(pii.ROUNDS):
            if step % 2 == 0:
                left = (left + int(stream(kind, step, right)[:12], 16)) % sizes[0]
            else:
                right = (right + int(stream(kind, step, left)[:12], 16)) % sizes[1]
        return left, right

    if kind == "card":
        body = text(value[:-1], "card")
        luhn = lambda n: sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(n)))) % 10 == 0
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "iban":
        account = text(value[4:], "iban")
        return value[:2] + f"{98 - int(''.join(str(int(c, 36)) for c in account + value[:2] + '00')) % 97:02}" + account
    if kind == "mail":
        at = value.index("@")
        return text(value[:at], "email") + value[at:]
    if kind == "phone" and len(value) == 11 and value[0] != "1":
        left, right = pair(int(value[0]) - (value[0] > "1"), int(value[1:]), (9, 10**10), "phone")
        return f"{left + (left > 0)}{right:010}"
    if kind == "phone":
        return text(value, "phone")
    if kind == "ssn":
        area, group, serial = map(int, value.split("-"))
        left, right = pair(area - (2 if area > 666 else 1), (group - 1) * pii.SERIALS + serial - 1, (pii.AREAS, 99 * pii.SERIALS), "ssn")
        return f"{left + (2 if left >= 665 else 1):03}-{right // pii.SERIALS + 1:02}-{right % pii.SERIALS + 1:04}"
    first = datetime.date.fromisoformat(pii.FIRST_DAY)
    number = (datetime.date.fromisoformat(value) - first).days
    left, right = pair(number // pii.DAYS[1], number % pii.DAYS[1], pii.DAYS, "date")
    return (first + datetime.timedelta(left * pii.DAYS[1] + right)).isoformat()


def test_every_kind_by_brute_force(spark):
    kinds = {"card": ["4111111111111111", "5500000000000004", "340000000000009"], "iban": ["DE89370400440532013000", "GB82WEST12345698765432"], "mail": ["ann.LEE+7@mail.example.com"], "phone": ["+493012345678", "+442079460958", "+49301234567", "+01234567890"], "ssn": ["123-45-6789", "667-01-0001"], "date": ["2020-12-31", "1800-01-01", "2199-12-31", "2024-02-29"]}
    flat = [(k, v) for k, vs in kinds.items() for v in vs]
    out = pii.pseudonymise(spark.createDataFrame([(i, v) for i, (_, v) in enumerate(flat)], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    for (kind, value), r in zip(flat, out, strict=True):
        want = "+" + rebuilt(value[1:], kind) if kind == "phone" else rebuilt(value, kind)
        assert r.text == want != value, (kind, value)


def test_one_day_and_one_number_have_one_pseudonym(spark):
    """Whatever the layout; and all of them can be undone."""
    import datetime

    days = [datetime.date(1800, 1, 1) + datetime.timedelta(i) for i in range(0, 146_097, 1499)]
    layouts = ["{0:%Y}-{0:%m}-{0:%d}", "{0:%Y}/{0.month}/{0.day}", "{0:%d}.{0:%m}.{0:%Y}", "{0:%m}/{0:%d}/{0:%Y}", "{0:%d}/{0:%m}/{0:%Y}"]
    rows = [(i, f.format(d)) for i, d in enumerate(days) for k, f in enumerate(layouts) if k < 4 or d.day > 12]
    read = lambda t: datetime.date(*map(int, t.split("-"))) if "-" in t else datetime.date(*map(int, t.split("/"))) if re.match(r"\d{4}/", t) else datetime.date(*map(int, reversed(t.split(".")))) if "." in t else datetime.date(int(t[-4:]), int(t[:2]), int(t[3:5])) if int(t[:2]) <= 12 else datetime.date(int(t[-4:]), int(t[3:5]), int(t[:2]))
    schema = "doc_id long, text string"
    out = [(r.doc_id, r.text) for r in pii.pseudonymise(spark.createDataFrame(rows, schema).coalesce(1), "k").collect()]
    for (i, old), (j, new) in zip(rows, out, strict=True):
        assert i == j and read(new).isoformat() == rebuilt(days[i].isoformat(), "date"), (old, new)
    back = [(r.doc_id, read(r.text)) for r in pii.pseudonymise(spark.createDataFrame(out, schema).coalesce(1), "k", undo=True).collect()]
    assert back == [(i, days[i]) for i, _ in rows]
    phones = ["+1 415 555 2671", "415-555-2671", "(415) 555-2671", "1-415-555-2671", "+14155552671"]
    new = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(phones)), schema).coalesce(1), "k").collect()]
    assert len({re.sub(r"\D", "", t)[-10:] for t in new}) == 1 and re.sub(r"\D", "", new[1]) == rebuilt("4155552671", "phone") and new[0].startswith("+1 ")


def test_dates_are_permuted(spark):
    days = spark.range(0, 146097, 97).select(F.col("id").alias("doc_id"), F.date_format(F.date_add(F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    out = pii.pseudonymise(days, "k").toPandas()
    assert out.text.nunique() == len(out) and (out.n_values == 1).all()


# --- near-duplicates -------------------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = lambda g: min((x for x in g if x is not None), default=None)
    return Counter((rows[i][0], len(sets[i]), least(groups[find(i)])) for i in range(len(rows)))


def test_near_duplicates(spark, docs, none, mixed):
    for frame, rows in ((docs, [(r[0], r[1]) for r in ROWS]), (mixed[0], list(enumerate(mixed[1])))):
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame).collect())
        assert got == brute_components(rows)
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.keep_one(mixed[0])
    assert kept.columns == mixed[0].columns and kept.count() == len({k[2] for k in brute_components(list(enumerate(mixed[1])))})


def test_links_beyond_the_first_class_of_a_bucket(spark, monkeypatch):
    """A chain whose ends aren't alike, and blocks of two classes."""
    monkeypatch.setattr(neardup, "BLOCK", 2)
    base = prose(80, 11).split(" ")
    rows = []
    for i in range(24):
        base = base[2:] + [f"new{i}", f"word{i}"]
        rows.append((i, " ".join(base)))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)


def test_a_hot_bucket_of_one_component(spark, monkeypatch):
    """A large group of near copies and a few others that share its passage, in small blocks: no link is lost."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    base = prose(60, 21).split(" ")
    rows = []
    for i in range(120):
        w = list(base)
        w[i % 60] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(base[:44] + [f"own{i}x{j}" for j in range(12)])) for i in range(3)]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[start] == min(seen)
    assert got.keys() == near.keys()
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- lines -----------------------------------------------------------------------------------------------------------------


def brute_lines(rows, sites, least=3):
    key = lambda line: b" ".join(words(line))
    where, first = {}, {}
    for (i, t), s in zip(rows, sites, strict=True):
        for line in (t or "").split("\n"):
            if len(words(line)) >= 3:
                where.setdefault(key(line), set()).add(s or "")
                first.setdefault(key(line), []).append(i)
    bad = {k: min((x for x in first[k] if x is not None), default=None) for k, s in where.items() if len(s) >= least}
    return Counter((i, None if t is None else "\n".join(x for x in t.split("\n") if not (key(x) in bad and (i is None or bad[key(x)] != i)))) for i, t in rows)


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_line_dedup(spark, docs, none, mixed, broadcast):
    got = Counter((r.doc_id, r.text) for r in lines.drop_spread_lines(mixed[0], 3, broadcast_lines=broadcast).collect())
    assert got == brute_lines(list(enumerate(mixed[1])), [f"s{i % 7}" for i in range(300)])
    awkward = lines.drop_spread_lines(docs, 2, broadcast_lines=broadcast)
    assert Counter((r.doc_id, r.text) for r in awkward.collect()) == brute_lines([(r[0], r[1]) for r in ROWS], [r[3] for r in ROWS], 2)
    assert awkward.columns == [*docs.columns, "n_lines", "n_removed"]
    assert lines.drop_spread_lines(none, broadcast_lines=broadcast).count() == 0


@pytest.mark.parametrize("kind", ["large", "string"])
def test_line_ids_keep_their_type(spark, kind):
    """Ids beyond 2^53, some of them null, and ids that are text: both ways take out the same lines."""
    name = (lambda i: 2**60 + i) if kind == "large" else (lambda i: f"doc{i:03}")
    line = "this line is on many sites"
    rows = [(name(i), f"{line}\nown words of {i}", f"s{i}") for i in range(6)] + [(None, f"another line on many sites\nand {i}", f"s{i}") for i in range(6)]
    docs = spark.createDataFrame(rows, f"doc_id {'long' if kind == 'large' else 'string'}, text string, source string")
    want = brute_lines([r[:2] for r in rows], [r[2] for r in rows], 5)
    for broadcast in (1_000_000, 0):
        out = lines.drop_spread_lines(docs, broadcast_lines=broadcast).collect()
        assert Counter((r.doc_id, r.text) for r in out) == want
        assert sorted(r.n_removed for r in out if r.doc_id is not None) == [0, 1, 1, 1, 1, 1]


def test_spread_lines_of_nothing(spark, none, docs):
    assert lines.spread_lines(none).count() == 0
    assert {r["first"] for r in lines.spread_lines(docs.union(docs), 2).collect()} <= set(range(len(ROWS)))


# --- language ID -----------------------------------------------------------------------------------------------------------

SAMPLES = {"en": "the and of to in that with for this from", "de": "der die und das nicht mit auch über für schön", "fr": "le la les et une dans pour être où déjà", "es": "el los las que una para señor niño según más"}


def sentence(lang, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(SAMPLES[lang].split()) for _ in range(25))


def test_languages(spark, none):
    known = spark.createDataFrame([(i, sentence(lang, i), lang) for i, lang in enumerate(list(SAMPLES) * 20)], "doc_id long, text string, lang string")
    pages = [(i, f"https://{lang}.example.com/x", f"<html lang='{lang}'><style>the the the</style><p>{sentence(lang, i + 999)} &amp; x</p>") for i, lang in enumerate(list(SAMPLES) * 5)]
    pages += [(90, None, None), (91, "http://de.example.com/", ""), (92, "nonsense", "<p>" + sentence("fr", 7)), (93, "https://en.example.com", f'<html lang="de"><p>{sentence("en", 5)}'), (94, "https://en.example.com", "<html lang='en'><!-- der die das --><p>12 34")]
    out = {r.page_id: r for r in langid.page_languages(spark.createDataFrame(pages, "page_id long, url string, html string"), known).collect()}
    assert all(out[i].language == lang and out[i].accepted for i, lang in enumerate(list(SAMPLES) * 5))
    assert out[90].language == out[91].language == out[94].language == "und" and not out[90].accepted
    assert out[92].language == "fr" and out[93].language == "en" and out[93].declared == "de" and len(out) == 25
    assert langid.page_languages(spark.createDataFrame([], "page_id long, url string, html string"), none).count() == 0


def test_host_prior_decides_what_text_leaves_open(spark):
    known = spark.createDataFrame([(i, sentence(lang, i), lang) for i, lang in enumerate(list(SAMPLES) * 20)], "doc_id long, text string, lang string")
    pages = [(i, "http://de.example.org/", "<p>" + sentence("de", i)) for i in range(30)] + [(i, "http://fr.example.net/", "<p>" + sentence("fr", i)) for i in range(30, 60)] + [(60, "http://de.example.org/", "<p>qx"), (61, "http://fr.example.net/", "<p>qx")]
    out = {r.page_id: r.language for r in langid.page_languages(spark.createDataFrame(pages, "page_id long, url string, html string"), known).collect()}
    assert out[60] == "de" and out[61] == "fr"


def test_posterior_by_brute_force(spark):
    """All evidence fused again in Python from what the rows hold, by broadcast and by join, with keys split into shares."""
    r = random.Random(8)
    rows = []
    for i in range(400):
        hot = r.random() < 0.5
        p = np.exp(np.array([r.uniform(-6, 0) for _ in range(4)]))
        rows.append((i, "hot.org" if hot else f"h{r.randrange(60)}.d{r.randrange(9)}.com", r.choice(["", "en", "de", "xx"]), 0 if i % 17 == 0 else 30, [float(x) for x in p / p.max()], i % 29 == 0))
    frame = spark.createDataFrame(rows, "uid long, host string, declared string, n_trigrams long, likelihood array<double>, foreign boolean")
    frame = frame.withColumn("domain", langid.domain_of(F.col("host"))).withColumn("suffix", langid.suffix_of(F.col("host")))
    languages = langid.LANGUAGES
    votes = {x[0]: np.array(x[4]) / sum(x[4]) if x[3] and not x[5] else np.zeros(4) for x in rows}
    domain = {x[0]: "hot.org" if x[1] == "hot.org" else x[1].split(".", 1)[1] for x in rows}
    total = sum(votes.values())
    base = (total + 1) / (total + 1).sum()

    def others(i, key):
        return np.maximum(sum((votes[x[0]] for x in rows if key(x) == key(rows[i])), np.zeros(4)) - votes[i], 0)

    for limits in ({}, {"groups": 0, "parts": 10}):
        got = {x.uid: x for x in langid.fused(frame, languages, 0.5, **limits).collect()}
        assert len(got) == 400
        for i, x in enumerate(rows):
            d, h = others(i, lambda y: domain[y[0]]), others(i, lambda y: y[1])
            prior = (d + 10 * base) / (d.sum() + 10)
            prior = (h + 10 * prior) / (h.sum() + 10)
            given = lambda c: (c + 10 * base) / (np.maximum(total - votes[i], 0) + 10)  # noqa: B023, E731
            said = given(others(i, lambda y: y[2])) if x[2] else np.ones(4)
            post = np.array(x[4]) * prior * said * given(others(i, lambda y: y[1].rsplit(".", 1)[1]))
            post /= post.sum()
            seen = x[3] > 0 and not x[5]
            assert got[i].confidence == pytest.approx(post.max(), rel=1e-9) and got[i].language == (languages[post.argmax()] if seen else "und")
            assert got[i].accepted == (seen and post.max() >= 0.5)


def test_domains_and_suffixes(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "uk"), "b.co.uk": ("b.co.uk", "uk"), "www.example.com": ("example.com", "com"), "localhost": ("localhost", "localhost"), "10.0.0.1": ("10.0.0.1", ""), "": ("", ""), "x.company.de": ("company.de", "de")}
    out = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", langid.domain_of(F.col("h")).alias("d"), langid.suffix_of(F.col("h")).alias("s")).collect()
    assert {r.h: (r.d, r.s) for r in out} == hosts


def test_foreign_texts_are_undetermined(spark):
    """A fifth language and a fifth script, both declared to be English, among documents of the four."""
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [(-1, "это предложение написано на другом языке и другими буквами, которых модель не знает", "en", "s"), (-2, "ez egy magyar nyelvű szöveg amelyet azért írtunk hogy kipróbáljuk vele a nyelv felismerését", "en", "s"), (-3, None, None, None), (-4, "", "en", "s")]
    docs = known.union(spark.createDataFrame(rows, known.schema))
    out = langid.text_languages(docs).where("doc_id < 0 or not accepted").collect()
    assert {r.doc_id: r.language for r in out if r.doc_id < 0} == dict.fromkeys(range(-4, 0), "und") and not any(r.accepted for r in out)
    assert known.join(langid.keep_identified(docs), "doc_id", "left_anti").where(r"text rlike '[A-Za-z]{3}'").count() <= 2


def test_keep_identified(spark, docs):
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {0, 5, 13} and not {6, 7, 8} & {r.doc_id for r in kept.collect()}


# --- decontamination -------------------------------------------------------------------------------------------------------


def test_containment(spark, docs, none, mixed):
    texts = list(mixed[1])
    items = [(1, " ".join(BASE.split()[5:30])), (2, prose(20, 77)), (3, " ".join(texts[1].split()[:9])), (4, "one two"), (5, ""), (6, None), (None, BASE), (1, " ".join(BASE.split()[5:30]))]
    items += [(100 + i, " ".join(texts[i].split()[2:60])) for i in range(0, 60, 3)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for frame, rows in ((docs, [(r[0], r[1]) for r in ROWS]), (mixed[0], list(enumerate(texts)))):
        want = Counter()
        for i, t in rows:
            for k, x in items:
                s = shingles(x)
                both = len(s & shingles(t))
                if s and both >= 0.75 * len(s):
                    want[i, k, len(s), both] += 1
        for block in (containment.BLOCK_BYTES, 1):
            got = Counter((r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in containment.contained_items(frame, bench, block_bytes=block).collect())
            assert got == want
    left = containment.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {5, 6, 7, 8, 12, 13, 14, 15}
    assert containment.contained_items(none, bench).count() == 0 and containment.drop_contaminated(docs, bench.limit(0)).count() == len(ROWS)


# --- BPE -------------------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    want = Counter()
    for r in ROWS:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.digests(bpe.encode_decode(docs, path)).collect()) == want
    assert bpe.encode_decode(none, path).count() == 0


def test_bpe_on_random_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.Tokenizer(path, cache_words=50)
    r = random.Random(2)
    for _ in range(400):
        text = "".join(r.choice("abc ABé1ñ.,!\n\t'sdtll<|endoftext|>  日 \x1c ") for _ in range(r.randint(0, 60)))
        ids, ends = own.encode_batch([text, "", text])
        assert library.encode(text, add_special_tokens=False).ids == ids[: ends[0]].tolist() and ends[0] == ends[1]
        assert own.decode_batch(ids, ends) == [text, "", text]
    assert own.decode_batch(np.array([own.byte_ids[0xFF]]), np.array([1])) == ["�"]


# --- media -----------------------------------------------------------------------------------------------------------------


def test_png_round_trip(spark, docs, none):
    images = media.store_images(docs)
    out = media.image_features(images, keep=("n_bytes",)).collect()
    want = Counter()
    for r in ROWS:
        raw = (r[1] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want[r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want
    assert all(len(r.feature) == 16 and r.error is None for r in out) and media.image_features(media.store_images(none)).count() == 0


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_every_filter(channels):
    r = np.random.default_rng(channels)
    pixels = r.integers(0, 256, (11, 7, channels)).astype(np.uint8)
    rows = pixels.reshape(11, -1)
    assert (media.decode_png(media.encode_png(pixels if channels > 1 else rows)).reshape(rows.shape) == rows).all()
    raw = np.zeros((11, rows.shape[1] + 1), np.uint8)
    for y in range(11):  # filters in turn, by the definition
        kind = y % 5
        raw[y, 0] = kind
        for x in range(rows.shape[1]):
            a = int(rows[y, x - channels]) if x >= channels else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - channels]) if y and x >= channels else 0
            nearest = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            raw[y, x + 1] = (int(rows[y, x]) - [0, a, b, (a + b) // 2, nearest][kind]) % 256
    assert (media.unfilter(raw, channels) == rows).all()


def test_feature_by_brute_force(spark):
    """The hash from the definition: a cosine transform by sums over samples, of the image shrunk by shares of area."""
    texts = [prose(n, n) for n in (3, 200, 900)]
    out = media.image_features(media.store_images(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).orderBy("doc_id").collect()
    for text, r in zip(texts, out, strict=True):
        raw = text.encode()
        raw += b"\xff" * (-len(raw) % 576)
        pixels = np.frombuffer(raw, np.uint8).reshape(r.height, r.width).astype(float)

        def shrunk(x):
            fine = np.repeat(x, 32, axis=0)  # each of the 32 cells holds as many of these as there are rows
            return fine.reshape(32, len(x), -1).mean(axis=1)

        small = shrunk(shrunk(pixels).T).T
        low = [sum(small[y, x] * math.cos(math.pi * v * (2 * y + 1) / 64) * math.cos(math.pi * u * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for v in range(8) for u in range(8)]
        low = np.round(low, 6)
        bits = "".join("1" if x > np.median(low[1:]) else "0" for x in low)
        assert r.feature == f"{int(bits, 2):016x}" and r.error is None


def test_damaged_images(spark):
    good = media.encode_png(np.arange(64, dtype=np.uint8).reshape(8, 8))
    bad = [good[:-1], good[:40] + b"\0" + good[41:], b"", good[8:], None]
    out = media.image_features(spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate([good, *bad])], "doc_id long, media binary")).collect()
    assert [r.error is None for r in sorted(out)] == [True] + [False] * 5


def test_cosine_hash_keeps_to_the_picture():
    r = np.random.default_rng(1)
    smooth = media.cosines(96, 8).T @ r.normal(0, 12, (8, 8)) @ media.cosines(64, 8)
    smooth = (smooth - smooth.min()) / (smooth.max() - smooth.min()) * 200 + 20
    distance = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    a = media.cosine_hash(smooth.astype(np.uint8))
    assert distance(a, media.cosine_hash((smooth + r.normal(0, 3, smooth.shape)).astype(np.uint8))) <= 12
    assert distance(a, media.cosine_hash(r.integers(0, 256, (96, 64)).astype(np.uint8))) > 15


def test_bpe_of_long_words():
    """Words without blanks, merged by rank, against merged in rounds and against the library; a million letters take seconds."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.Tokenizer(path)
    r = random.Random(8)
    words = ["a" * 5_000, "ab" * 2_000, "é日" * 900, "".join(r.choice("etaoinshrdlu") for _ in range(6_000)), "".join(r.choice(WORDS) for _ in range(900)), "x" * (bpe.LONG + 1), "aaab" * 700]
    for raw in ([w.encode() for w in words], [w.encode() for w in words + WORDS[:50]]):
        rounds, ranked = own.merge_rounds(raw), own.merge_by_rank(raw)
        assert (rounds[0] == ranked[0]).all() and (rounds[1] == ranked[1]).all()
    texts = [*words, "short " + words[3] + " words " + words[4], " ".join(WORDS)]
    ids, ends = own.encode_batch(texts)
    for t, a, b in zip(texts, np.append(0, ends[:-1]), ends, strict=True):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids
    huge = "".join(r.choice("etaoinshrdlu") for _ in range(1_000_000))
    start = time.time()
    ids, ends = own.encode_batch([huge])
    assert time.time() - start < 60 and own.decode_batch(ids, ends) == [huge]
    assert ids.tolist() == library.encode(huge, add_special_tokens=False).ids
